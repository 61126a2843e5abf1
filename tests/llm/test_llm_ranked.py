import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from llm_cases import awkward, empty, words

from telespark.llm import ranked

ITEMS = "item_id bigint, text string, rank int, score int, key int"


def terms(text):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", folded)


def plain(docs, items, top=10):
    """Scores of all documents for all items."""
    texts = [(i, Counter(t), len(t)) for i, t in ((i, terms(x)) for i, x in docs) if t]
    n, total = len(texts), sum(x[2] for x in texts)
    df = Counter(t for _, tf, _ in texts for t in tf)
    out = []
    for item, text in items:
        asked, found = Counter(terms(text)), []
        for doc, tf, size in texts:
            m = 25 + 75 * size * n // total
            score = sum(k * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 8 * m)) for t, k in asked.items() if t in tf)
            if score > 0:
                found.append((-score, math.inf if doc is None else doc))
        out += [(item, r, None if d == math.inf else d, -s) for r, (s, d) in enumerate(sorted(found)[:top], 1)]
    return Counter(out)


def found(spark, docs, items, **limits):
    items = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in items], ITEMS)
    return Counter(map(tuple, ranked.search(docs, items, **limits).collect()))


def test_terms():
    for text in ("", "a-B c_d É9!ÑZ\x00x\x7fy\x85z\xa0w", "one\ntwo\x1cthree"):
        assert [t.decode() for t in ranked.terms_of(text.encode())] == terms(text)


def test_query_equals_brute_force(spark, sf):
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    got = Counter(map(tuple, ranked.search(docs, items).collect()))
    assert got == plain(docs.select("doc_id", "text").collect(), items.select("item_id", "text").collect())


def test_query_equals_its_sql(spark, sf):
    from compare import connect, spark_rows, sql_rows

    from telespark.llm.queries import llm_oracles, op13_ranked_search

    assert spark_rows(op13_ranked_search(spark, sf)) == sql_rows(connect(sf), llm_oracles()["op13_ranked_search"])


def test_awkward_rows(spark):
    docs = awkward(spark)
    items = [(1, None), (2, ""), (3, "!!"), (None, "the quick fox the"), (4, words(5, 20)), (4, words(5, 20)), (5, "12345 É nothing one"), (6, words(4, 3000))]
    assert found(spark, docs, items) == plain(docs.select("doc_id", "text").collect(), items)


def many(seed, n=900):
    draw = random.Random(seed)
    pool = [f"w{int(draw.paretovariate(0.6))}" for _ in range(3000)]
    rows = [(i, " ".join(draw.choice(pool) for _ in range(int(draw.paretovariate(0.7) * 8) % 2500))) for i in range(n)]
    return rows + rows[:30], [(i, " ".join(draw.choice(pool) for _ in range(draw.randint(1, 40)))) for i in range(25)]


@pytest.mark.parametrize(("top", "limits"), [(10, {}), (3, {"pass_terms": 150}), (10, {"pass_terms": 400})])
def test_passes_and_ties(spark, top, limits):
    docs, items = many(top)
    assert found(spark, spark.createDataFrame(docs, "doc_id bigint, text string").repartition(7), items, top=top, **limits) == plain(docs, items, top)


def test_bounds_hold_and_exclude():
    docs, items = many(5)
    hashes, rows = ranked._Hashes(), []
    for i, text in docs:
        if tf := Counter(ranked.terms_of(text.encode())):
            rows.append((i, text.encode(), np.array([hashes[x] for x in tf], dtype=np.uint64), np.array(list(tf.values()))))
    total = sum(int(r[3].sum()) for r in rows)
    queries = ranked.Queries([(i, dict(Counter(ranked.terms_of(t.encode())))) for i, t in items], len(rows), total)
    queries.weigh(Counter(int(h) for r in rows for h in r[2]))
    block = ranked._block(1 << 14, rows)
    lengths = block["lengths"][0].values.to_numpy()
    bounds = queries.bounds(lengths, 1 << 14, np.frombuffer(block["slices"][0].as_py(), np.uint8).reshape(1 << 14, -1))
    scores = np.array([[queries.score(i, Counter(ranked.terms_of(r[1])), queries.share(int(r[3].sum()))) for r in rows] for i in range(len(items))])
    assert (bounds >= scores).all()
    tenth = np.sort(scores, axis=1)[:, -10]
    assert (bounds >= tenth[:, None]).mean() < 0.2


def test_empty_tables(spark):
    none = spark.createDataFrame([], ITEMS)
    assert ranked.search(empty(spark), none).collect() == []
    assert ranked.search(empty(spark), spark.createDataFrame([(1, "a", 1, 2, 3)], ITEMS)).collect() == []
    assert ranked.search(awkward(spark), none).collect() == []
