import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import awkward, empty

from telespark.llm import grammars, periodic
from telespark.llm.queries import op11_periodic_runs


def plain_runs(words):
    """Every period by itself; of one stretch the smallest period counts."""
    seen = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            begin = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i > begin and i + q - begin >= max(6, 4 * q):
                seen.setdefault((begin, i + q), q)
            i += i == begin
    return sorted(((a, b, q) for (a, b), q in seen.items()), key=lambda x: (x[0], x[2]))


def check(sequences):
    expected, at = [], 0
    for s in sequences:
        expected += [(a + at, b + at, q) for a, b, q in plain_runs(s)]
        at += len(s)
    got = grammars.runs(np.array(sum(sequences, []), dtype=np.int64), np.cumsum(list(map(len, sequences))).astype(np.int64))
    assert list(zip(*(x.tolist() for x in got), strict=True)) == expected


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=60), min_size=1, max_size=5))
def test_runs_of_few_symbols(sequences):
    check(sequences)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=12), st.integers(1, 9), st.lists(st.integers(0, 3), max_size=4)), min_size=1, max_size=4))
def test_runs_of_repeated_roots(parts):
    check([sum((root * times + rest for root, times, rest in parts), [])])


def test_long_periods_and_nested_runs():
    draw = random.Random(3)
    root = [draw.randrange(1000) for _ in range(700)]
    inner = [1, 2] * 9
    check([[5] * 3000, root * 5 + root[:350], (inner + [3]) * 8, root * 3, root])


def test_every_boundary_is_a_rule_and_derivations_are_equal():
    draw = random.Random(4)
    t = np.array([draw.randrange(4) for _ in range(500)] * 2)
    ends = np.array([300, 500, 1000])
    joined = Counter()
    for r in grammars.rules(t, ends):
        for place, rule in zip(r.places, r.of_place, strict=True):
            size = r.length[rule]
            assert (t[place : place + size] == t[r.start[rule] : r.start[rule] + size]).all()
            joined[int(place + r.left[rule])] += 1
    assert joined == Counter(i for i in range(1, 1000) if i not in (300, 500))


def expected(rows):
    out = []
    for doc_id, text in rows:
        words = (text or "").encode().split()
        words = periodic.refrain(doc_id, words)
        found = plain_runs(words)
        gone = {i for a, b, q in found for i in range(a + q, b)}
        best = min(((a - b, a, q) for a, b, q in found), default=None)
        row = (None,) * 4 if best is None else (best[1], -best[0], best[2], -best[0] * 1000 // best[2])
        lines = "".join(f"{a},{b - a},{q}\n" for a, b, q in found)
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((doc_id, len(found), *row, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def test_query_equals_brute_force(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 30000")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert Counter(map(tuple, op11_periodic_runs(spark, str(tmp_path)).collect())) == expected(docs.select("doc_id", "text").collect())


def test_awkward_rows(spark, tmp_path):
    rows = awkward(spark).where("doc_id is null or doc_id != 4")
    rows = rows.union(spark.createDataFrame([(i, t, *[None] * 12) for i, t in ((20, "a " * 7), (20, "a " * 7), (21, "a b\tc\n" * 4), (22, "x " * 5))], rows.schema))
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    assert Counter(map(tuple, op11_periodic_runs(spark, str(tmp_path)).collect())) == expected(rows.select("doc_id", "text").collect())


@pytest.mark.parametrize("block_words", [1, 500])
def test_blocks_change_nothing(spark, sf, block_words):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    whole, cut = (Counter(map(str, periodic.collapse_runs(docs, with_refrains=True, **k).collect())) for k in ({}, {"block_words": block_words}))
    assert whole == cut


def test_empty_table(spark):
    assert periodic.collapse_runs(empty(spark)).collect() == []
