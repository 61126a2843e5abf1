from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from telespark.llm import queries, topk


def plain(ids, vectors, asks, k):
    out = set()
    for i in np.flatnonzero(asks):
        score = vectors @ vectors[i]
        best = [j for j in np.lexsort((ids, -score)) if j != i][:k]
        out |= {(int(ids[i]), r + 1, int(ids[j]), int(score[j])) for r, j in enumerate(best)}
    return out


def test_query(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    ids = np.array([r.vec_id for r in rows])
    vectors = np.floor(64 * np.array([r.embedding for r in rows], dtype=np.float64)).astype(np.int64)
    assert {tuple(r) for r in queries.op7_exact_top_k(spark, sf).collect()} == plain(ids, vectors, ids % 20 == 0, 20)


@pytest.mark.parametrize(("n", "d", "high"), [(3, 2, 3), (400, 6, 2), (400, 3, 50), (300, 8, 3000), (200, 4, 10**8)])
def test_blocks_and_ties(spark, n, d, high):
    draw = np.random.default_rng(n + d)
    vectors = draw.integers(-high, high + 1, (n, d))
    vectors[n // 2 :] = vectors[: n - n // 2]  # every score comes twice
    frame = spark.createDataFrame([(i, v) for i, v in enumerate((vectors / 64).tolist())], "vec_id bigint, embedding array<double>")
    got = topk.top_k(frame, F.col("id") % 7 == 0, k=5, candidates_most=64, queries_most=16).collect()
    ids = np.arange(n)
    assert {tuple(r) for r in got} == plain(ids, np.floor(64 * (vectors / 64)).astype(np.int64), ids % 7 == 0, 5)


def test_early_stopping_is_exact():
    """A few far candidates win at once, so that reading stops early."""
    draw = np.random.default_rng(5)
    candidates = draw.integers(-2, 3, (2000, 8))
    candidates[:60] *= 40
    queries_ = draw.integers(-3, 4, (50, 8))
    i, j, score = topk.best_of_block(queries_, candidates, -np.arange(50) - 1, np.arange(2000), np.arange(2000), 10)
    for q in range(50):
        exact = candidates @ queries_[q]
        assert list(j[i == q]) == list(np.lexsort((np.arange(2000), -exact))[:10])
        assert list(score[i == q]) == sorted(exact, reverse=True)[:10]


def test_awkward(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], "a"), (0, [1.0, 2.0], "a"), (20, [0.5, 0.5], "a"), (1, None, "b"), (2, [], "b"), (3, [None, 1.0], "b"), (4, [nan, 1.0], "b"), (5, [inf, 1.0], "b"), (None, [1.0, 1.0], "c"), (7, [1.0], "c"), (40, None, "c"), (9, [-1.0, 3.0], "d")]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, id string").withColumn("v", F.lit(1)).withColumn("d", F.lit(2))
    got = Counter(tuple(r) for r in topk.top_k(frame, F.col("id") % 20 == 0).collect())
    of_both = [(0, 1, 0, 64 * 64 * 5), (0, 2, 9, 64 * 64 * 5), (0, 3, 20, 64 * 96)] * 2
    assert got == Counter([*of_both, (20, 1, 0, 64 * 96), (20, 2, 0, 64 * 96), (20, 3, 9, 64 * 64)])
    assert topk.top_k(frame.where(F.lit(False)), F.col("id") % 20 == 0).count() == 0


def test_rows_that_share_an_id_equal_the_sql(spark, tmp_path):
    import duckdb

    rows = [(20, [1.0, 1.0]), (20, [5.0, 5.0]), (0, [2.0, 1.0]), (0, [2.0, 1.0]), (3, [1.0, 0.5]), (3, [-1.0, 4.0])]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = Counter(map(tuple, queries.op7_exact_top_k(spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert got == Counter(con.execute(queries.llm_oracles()["op7_exact_top_k"]).fetchall())
    assert got[(0, 1, 20, 960 * 64)] == 2


def test_huge_components(spark):
    rows = [(0, [1e300, 1.0]), (1, [1e300, -1e300]), (2, [-1e300, 1.0]), (3, [0.0, 1.0]), (4, [1e9, 1.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.col("id") == 0).collect()
    most = (1 << 63) - 1
    assert [tuple(r) for r in sorted(got)] == [(0, 1, 1, most), (0, 2, 4, most), (0, 3, 3, 64 * 64), (0, 4, 2, -most - 1)]


def test_query_equals_its_sql(spark, sf):
    from compare import connect, spark_rows, sql_rows

    assert spark_rows(queries.op7_exact_top_k(spark, sf)) == sql_rows(connect(sf), queries.llm_oracles()["op7_exact_top_k"])
