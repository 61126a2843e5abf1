import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import awkward, empty, words

from telespark.llm import suffix_dedup, suffixes
from telespark.llm.oracles import ORACLES
from telespark.llm.queries import op12_suffix_dedup


def check_array(data):
    t = np.frombuffer(data, dtype=np.uint8)
    order = suffixes.suffix_array(t)
    assert order.tolist() == sorted(range(len(data)), key=lambda i: data[i:])
    if len(data):
        shared = suffixes.permuted_prefixes(t, order)
        for a, b in zip(order, order[1:], strict=False):
            size = next((k for k in range(len(data) - max(a, b)) if data[a + k] != data[b + k]), len(data) - max(a, b))
            assert shared[b] == size
        assert shared[order[0]] == 0


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.binary(max_size=80), st.text("ab", max_size=120).map(str.encode), st.tuples(st.text("abc", min_size=1, max_size=9), st.integers(1, 20)).map(lambda x: (x[0] * x[1]).encode())))
def test_suffix_array_and_prefixes(data):
    check_array(data)


@pytest.mark.parametrize("few", [0, 1])
def test_recursion_and_doubling_of_names(few, monkeypatch):
    monkeypatch.setattr(suffixes, "FEW_NAMES", few)
    draw = random.Random(few)
    for _ in range(60):
        check_array(bytes(draw.choice(b"abc") for _ in range(draw.randint(0, 400))))


def plain(rows):
    """All strings of 50 bytes in a table of their smallest documents."""
    first = {}
    for doc_id, text in sorted(((i, t) for i, t in rows if i is not None), key=lambda x: x[0]):
        data = (text or "").encode()
        for p in range(len(data) - 49):
            first.setdefault(data[p : p + 50], doc_id)
    out = []
    for doc_id, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - 49) if doc_id is not None else ():
            if first[data[p : p + 50]] < doc_id:
                gone[p : p + 50] = b"\1" * 50
        spans = sum(1 for a, b in zip(b"\0" + gone, gone, strict=False) if b and not a)
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        out.append((doc_id, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def queried(spark, docs, path):
    docs.write.parquet(f"{path}/documents.parquet")
    return Counter(map(tuple, op12_suffix_dedup(spark, str(path)).collect()))


def test_query_equals_brute_force(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert queried(spark, docs, tmp_path) == plain(docs.select("doc_id", "text").collect())


def test_query_equals_its_sql(spark, sf):
    from compare import connect, spark_rows, sql_rows

    assert spark_rows(op12_suffix_dedup(spark, sf)) == sql_rows(connect(sf), ORACLES["op12_suffix_dedup"])


def test_awkward_rows(spark, tmp_path):
    docs = awkward(spark)
    assert queried(spark, docs, tmp_path) == plain(docs.select("doc_id", "text").collect())


def overlapping():
    """Passages of all lengths around 50 bytes, repeated lines, and one phrase in ever new surroundings."""
    draw = random.Random(8)
    passages = [words(100 + i, 40)[: 48 + i] for i in range(8)] + [words(7, 300)]
    rows = []
    for i in range(120):
        parts = [words(1000 + i, draw.randint(0, 12), 40)]
        for _ in range(draw.randint(0, 4)):
            p = draw.choice(passages)
            a = draw.randint(0, 20)
            parts += [p[a : a + draw.randint(30, 400)], words(2000 + i, 3), "one phrase that everyone has " + str(i)]
        rows.append((i, "\n".join(parts) + "line again and again\n" * draw.choice([0, 0, 9])))
    return rows


@pytest.mark.parametrize("limits", [{}, {"crowded": 2}, {"crowded": 3, "bundle": 700, "shard": 900}])
def test_crowded_marks_and_small_parts(spark, limits):
    rows = overlapping()
    found = suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6), **limits).collect()
    got = Counter((r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in found)
    assert got == plain(rows)
    texts = dict(rows)
    for r in found:
        data, at, kept = texts[r.doc_id].encode(), 0, b""
        for s in r.spans:
            kept, at = kept + data[at : s.start], s.end
        assert kept + data[at:] == r.kept


def test_text_is_not_dealt_out_again(spark, sf):
    plan = suffix_dedup.dedup(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange" in line]
    assert "Bucketed: true" in plan and exchanges and not [x for x in exchanges if "ids" in x]


def test_empty_table(spark):
    assert suffix_dedup.dedup(empty(spark)).collect() == []


def sharded(texts):
    """The answers of one shard, a bundle for each text, by document."""
    docs = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    bundles = list(suffix_dedup._bundled(1, 1)(iter([docs])))
    codes = pa.table({"bundle": [b["bundle"][0] for b in bundles], "shard": [0] * len(texts), "codes": pa.array([b["codes"][0][0] for b in bundles], pa.binary())})
    states = {x.pop("bundle"): x for x in suffix_dedup._judged(256)(codes).to_pylist()}
    kind, pieces = pa.list_(pa.struct([("shard", pa.int64()), ("states", pa.binary())])), []
    for b in bundles:
        judged = [states[x] for x in [b["bundle"][0].as_py()] if x in states]
        row = pa.RecordBatch.from_arrays([*(b[c] for c in ("bundle", "ids", "ends", "data")), pa.array([judged], kind)], names=["bundle", "ids", "ends", "data", "judged"])
        pieces += [x for x in suffix_dedup._cut_up(1)(iter([row]))]
    shard = pa.Table.from_batches(pieces)
    shard = shard.filter(pc.equal(shard["shard"], 0))
    names = [b["bundle"][0].as_py() for b in bundles]
    return {names.index(x["bundle"]): int(np.unpackbits(np.frombuffer(x["data"], dtype=np.uint8)).sum()) for x in suffix_dedup._sorted_shard(shard).to_pylist()}


def test_shard_sorts_what_may_repeat_only(monkeypatch):
    draw, sorted_sizes = random.Random(3), []
    array = suffixes.suffix_array
    monkeypatch.setattr(suffix_dedup, "suffix_array", lambda t: sorted_sizes.append(len(t)) or array(t))
    noise = lambda n: "".join(draw.choices("abcdefghijklmnop", k=n))
    phrases, passage = [noise(30) for _ in range(50)], noise(120)
    # Phrases of 30 bytes bring pieces to the shard, but no string of 50 bytes is in two documents.
    texts = ["".join(noise(40) + p for p in phrases) for _ in range(4)]
    assert sum(sharded(texts).values()) == 0 and sum(sorted_sizes) == 0
    found = sharded([texts[0], texts[1] + passage + noise(60), texts[2] + noise(70) + passage, noise(90) + passage])
    assert found[2] == found[3] == 71 and found.get(0, 0) == found[1] == 0
    assert 0 < sum(sorted_sizes) < 3000
