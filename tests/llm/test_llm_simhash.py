import itertools
import random

import pytest
import xxhash
from llm_cases import awkward, empty, union_find, words
from pyspark.sql import functions as F
from telespark.llm import queries, simhash
from telespark.llm.components import connected_components


def plain(text):
    parts = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        parts = parts.replace(c, " ")
    parts = [w for w in parts.split(" ") if w]
    if not parts:
        return 0
    shingles = [" ".join(parts[i : i + 3]) for i in range(len(parts) - 2)] or [" ".join(parts)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(values):
    near = [(i, j) for (i, a), (j, b) in itertools.combinations(enumerate(values), 2) if (a ^ b).bit_count() <= 2]
    sets = union_find(len(values), near)
    return [sets.find(i) for i in range(len(values))]


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    prints = [plain(d.text) for d in docs]
    roots = groups(prints)
    expected = {d.doc_id: (f"{p:016x}", docs[r].doc_id) for d, p, r in zip(docs, prints, roots, strict=True)}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op8_simhash_near_dedup(spark, sf).collect()}
    assert got == expected


@pytest.mark.parametrize("hot", [0, 3, 1000])
def test_every_link_is_found_whatever_is_hot(spark, hot):
    draw = random.Random(2)
    values = {0, (1 << 64) - 1}
    for _ in range(12):
        value = draw.getrandbits(64)
        for _ in range(12):
            values.add(value)
            value ^= sum(1 << b for b in draw.sample(range(64), draw.choice((1, 2, 2, 3))))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    got = {tuple(r) for r in simhash.links(spark.createDataFrame([(v,) for v in [*signed, signed[0], None]], "fp bigint"), hot).collect()}
    expected = {(min(a, b), max(a, b)) for a, b in itertools.combinations(signed, 2) if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2}
    assert got == expected


def test_awkward(spark):
    rows = simhash.near_duplicates(awkward(spark)).collect()
    assert len(rows) == 12
    by_id = {r.doc_id: r for r in rows}
    assert by_id[1].fp == by_id[2].fp == by_id[3].fp == 0
    assert by_id[3].component_id == 1
    assert by_id[6].component_id == 5
    assert by_id[None].component_id is None
    assert simhash.near_duplicates(empty(spark)).count() == 0
    kept = simhash.one_of_each(awkward(spark))
    assert kept.columns == awkward(spark).columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(5) == 1
    assert 6 not in ids and None in ids and 1 in ids and 2 not in ids


def test_one_group_of_all(spark):
    base = words(1, 200)
    docs = spark.createDataFrame([(i, base if i % 3 else base + f" w{i}") for i in range(150)], "doc_id bigint, text string")
    prints = [plain(r.text) for r in docs.orderBy("doc_id").collect()]
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, hot=2).collect()}
    assert got == dict(enumerate(groups(prints)))


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    draw = random.Random(seed)
    edges = [(draw.randrange(60), draw.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)] + [(200, 201 + i) for i in range(20)]
    frame = spark.createDataFrame([*edges, (None, 3), edges[0], (7, 7)], "a bigint, b bigint")
    got = {r.node: r.root for r in connected_components(frame).collect()}
    sets = union_find(300, edges)
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: sets.find(x) for x in nodes}
    assert connected_components(frame.where(F.lit(False))).count() == 0
