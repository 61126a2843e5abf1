import re
from collections import defaultdict

import pytest
from llm_cases import awkward, empty, words
from pyspark.sql import functions as F
from telespark.llm import mixing, queries


def plain_targets(sizes):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, rest, open_ = dict.fromkeys(order, 0.0), 1.5 * sum(sizes.values()), set(order)
    while rest > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        adds, rest = {s: rest * weight[s] / total for s in open_}, 0.0
        for s, more in adds.items():
            target[s] += more
            if target[s] >= 2 * sizes[s]:
                rest += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                open_.discard(s)
    return target


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "text").collect()
    source = {d.doc_id: d.source for d in docs}
    size = {d.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", d.text or "")) for d in docs}
    rows = queries.op10_mixing(spark, sf).collect()
    assert {r.doc_id: r["size"] for r in rows} == size
    sizes, taken, goal = defaultdict(int), defaultdict(int), {}
    for r in rows:
        sizes[source[r.doc_id]] += r["size"]
        taken[source[r.doc_id]] += r.taken
        goal[source[r.doc_id]] = r.target
        assert 0 <= r.taken <= 2 * r["size"]
    expected = plain_targets(sizes)
    for s in sizes:
        assert goal[s] == pytest.approx(expected[s])
        assert abs(taken[s] - goal[s]) <= 3 * mixing.BLOCK
    again = queries.op10_mixing(spark.newSession(), sf).repartition(3).collect()
    assert {r.doc_id: r.taken for r in again} == {r.doc_id: r.taken for r in rows}


@pytest.mark.parametrize("seats", [0, 1, 7, 100, 1001])
@pytest.mark.parametrize("votes", [[53.0, 24.0, 23.0], [1.0], [0.0, 5.0, 5.0], [1000.0] + [1.0] * 30, [3.0, 3.0, 3.0, 3.0]])
def test_apportion_takes_highest_quotients(spark, seats, votes):
    frame = spark.createDataFrame([("g", i, v, seats) for i, v in enumerate(votes)], "g string, i int, votes double, seats bigint")
    got = {r.i: r.quota for r in mixing.apportion(frame, ["g"], ["i"]).collect()}
    claims = sorted(((v / (2 * k + 1), -i) for i, v in enumerate(votes) if v > 0 for k in range(seats)), reverse=True)[:seats]
    expected = defaultdict(int)
    for _, i in claims:
        expected[-i] += 1
    assert got == {i: expected[i] for i in range(len(votes))}


def test_hot_source_over_shards(spark):
    rows = [(i, f"s{max(0, i - 290) % 5}", words(i, 20 + i % 7)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    out = mixing.mix(docs, block=8, shard_words=500)
    assert out.select(F.sum("size")).first()[0] == sum(len(t.split()) for _, _, t in rows)
    per = out.groupBy("row.source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    for r in per:
        assert abs(r.taken - r.target) <= 8 * 20
    pieces = mixing.mixed_rows(out).collect()
    assert sum(len(r.text.split()) for r in pieces) == sum(r.taken for r in per)
    texts = {i: t for i, _, t in rows}
    assert all(r.text in texts[r.doc_id] for r in pieces)


def test_awkward(spark):
    out = mixing.mix(awkward(spark)).select("row.*", F.col("size").alias("words"), "taken", "target").collect()
    assert len(out) == 12
    assert all(r.taken == 0 for r in out if not (r.text or "").split())
    assert sum(r.words for r in out if r.doc_id == 5) == 120
    assert mixing.mixed_rows(mixing.mix(awkward(spark))).columns == awkward(spark).columns
    assert mixing.mix(empty(spark)).count() == 0
    blank = awkward(spark).where("text is null or text = ''")
    assert [r.taken for r in mixing.mix(blank).collect()] == [0, 0]
