import random
import re

from llm_cases import awkward, empty, words
from telespark.llm import licenses, queries


def test_query_finds_every_notice_line(spark, sf):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = queries.op1_license_scan(spark, sf).collect()
    for name, text in licenses.TEMPLATES:
        for doc_id, body in docs.items():
            if text in body:
                assert any(r.doc_id == doc_id and r.license == name and r.containment == 1 for r in found)
    allowed = [set(re.findall(r"[^\W_]+", t.lower())) for _, t in licenses.TEMPLATES]
    for r in found:
        span = re.findall(r"[^\W_]+", docs[r.doc_id].lower())[r.start_word : r.end_word]
        assert max(len(a.intersection(span)) / len(a) for a in allowed) >= 0.5


def test_places_edits_and_repeats(spark):
    draw = random.Random(6)
    rows, truth = [], {}
    for i in range(120):
        name, text = licenses.TEMPLATES[i % len(licenses.TEMPLATES)]
        before = draw.randint(0, 60)
        rows.append((i, f"{words(i, before)} {text} {words(i + 500, draw.randint(0, 40))}"))
        truth[i] = (name, before)
    long = next(t for n, t in licenses.TEMPLATES if n == "BSD-3-Clause").split()
    rows.append((900, words(1, 9) + " " + " ".join([*long[:-1], "satisfied"])))  # one word changed at the end
    rows.append((901, words(1, 9) + " " + " ".join(long[:8]) + " " + words(3, 30)))  # less than half of it
    rows.append((902, ("Released under the MIT License. " + words(2, 6) + " ") * 40))
    rows += [(1000 + i, words(i + 40, 300)) for i in range(30)]
    found = licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    at = {i: [(r.license, r.start_word) for r in found if r.doc_id == i] for i, _ in rows}
    assert all(truth[i] in at[i] for i in truth)
    assert [r.license for r in found if r.doc_id == 900] == ["BSD-3-Clause"]
    assert at[901] == [] and not any(at[i] for i in range(1000, 1030))
    assert len(at[902]) == 40


def test_no_exact_notice_is_lost(spark):
    """One-shingle templates at the beginning and inside of texts, each with other neighbours."""
    notice = "Released under the MIT License."
    around = words(3, 120_000, 5000).split()
    rows = [(i, " ".join([*around[30 * i : 30 * i + i % 3 * 7], notice, *around[30 * i + 15 : 30 * i + 27]])) for i in range(4000)]
    found = licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8))
    assert {(r.doc_id, r.start_word) for r in found.where("license = 'MIT'").collect()} == {(i, i % 3 * 7) for i, _ in rows}


def test_awkward(spark):
    docs = awkward(spark)
    assert licenses.scan(docs).count() == 0
    assert licenses.scan(empty(spark)).count() == 0
    twice = spark.createDataFrame([(None, "x Released under the MIT License. y", 1)] * 2, "doc_id bigint, text string, h int")
    assert [(r.doc_id, r.license) for r in licenses.scan(twice).collect()] == [(None, "MIT")] * 2
    none = licenses.templates(spark, [("short", "MIT License")])
    assert licenses.scan(docs, none).columns == licenses.scan(docs).columns
    assert licenses.scan(twice, none).count() == 0


def test_plan_is_native(spark, sf):
    plan = queries.op1_license_scan(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
