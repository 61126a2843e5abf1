"""Per-key sequential logic without per-key tasks.

A single key may hold a large share of all rows, so nothing here hands a whole key to one task.
Keys are cut into time (or value) slices; each slice is solved on its own, the small per-slice
summaries are combined in order, and the result is joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType, VariantType

# Spark prunes rank filters before the shuffle only up to this rank
# (spark.sql.optimizer.windowGroupLimitThreshold).
RANK_PUSHDOWN_LIMIT = 1000
SALTS = 64


def time_slice(ts: Column, seconds: int) -> Column:
    """Number of the slice; never NULL, so that joins on it add no filter and equal shuffles are reused."""
    return F.coalesce(F.floor(F.unix_micros(ts) / F.lit(seconds * 1_000_000)).cast("bigint"), F.lit(0))


def top_n_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rn") -> DataFrame:
    """First n rows per key in the given order.

    Up to the push-down limit each map task keeps only n rows per key before the shuffle. Larger n
    first ranks inside salted parts of the key, so no task sorts more than a part of it.
    """
    if n > RANK_PUSHDOWN_LIMIT:
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(*_hashable(df)), F.lit(SALTS)))
        part = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = salted.withColumn("_part_rn", F.row_number().over(part)).filter(F.col("_part_rn") <= n).drop("_part_rn", "_salt")
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= n)


def _hashable(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, AtomicType) and not isinstance(f.dataType, VariantType)]


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return top_n_per_key(df, keys, order, 1).drop("rn")


def carry_forward(
    df: DataFrame, key: str, order: list[str], slice_column: str, decisive: str, output: str, previous: str, initial: Column
) -> DataFrame:
    """Last non-NULL `decisive` value up to each row (`output`) and up to the row before it (`previous`).

    `slice_column` must not decrease along `order`.
    """
    position = F.struct(*order)
    in_slice = Window.partitionBy(key, slice_column).orderBy(*order)
    local = df.withColumn("_here", F.last(decisive, ignorenulls=True).over(in_slice.rowsBetween(Window.unboundedPreceding, 0)))
    local = local.withColumn("_before", F.last(decisive, ignorenulls=True).over(in_slice.rowsBetween(Window.unboundedPreceding, -1)))

    per_slice = df.groupBy(key, slice_column).agg(
        F.max_by(decisive, F.when(F.col(decisive).isNotNull(), position)).alias("_slice_last")
    )
    earlier = Window.partitionBy(key).orderBy(slice_column).rowsBetween(Window.unboundedPreceding, -1)
    carried = per_slice.select(key, slice_column, F.last("_slice_last", ignorenulls=True).over(earlier).alias("_carried"))

    return (
        local.join(carried, [key, slice_column])
        .withColumn(output, F.coalesce("_here", "_carried", initial))
        .withColumn(previous, F.coalesce("_before", "_carried", initial))
        .drop("_here", "_before", "_carried")
    )


def running_position(df: DataFrame, keys: list[str], order: list[str], slice_column: str, output: str) -> DataFrame:
    """1-based position of each row within its key: position in the slice plus all earlier slices."""
    in_slice = Window.partitionBy(*keys, slice_column).orderBy(*order)
    local = df.withColumn("_local", F.row_number().over(in_slice))
    counts = df.groupBy(*keys, slice_column).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy(slice_column).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, slice_column, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    return (
        local.join(offsets, [*keys, slice_column])
        .withColumn(output, F.col("_local") + F.col("_offset"))
        .drop("_local", "_offset", slice_column)
    )


def order_statistics(df: DataFrame, key: str, value: str, ranks: dict[str, Column]) -> DataFrame:
    """Exact values at given 0-based ranks per key: one row per key with a column per rank.

    `ranks` maps output names to expressions over the key's row count `n`. A count per unit-wide
    value slice finds the slice that holds each rank; only the rows of those slices are then
    ranked, by distinct value. Work per task is bounded by one slice of one key.
    """
    sliced = df.filter(F.col(value).isNotNull()).select(key, value, F.floor(value).alias("_slice"))
    histogram = sliced.groupBy(key, "_slice").agg(F.count(F.lit(1)).alias("_in_slice"))
    up_to = Window.partitionBy(key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, 0)
    cumulative = histogram.withColumn("_upto", F.sum("_in_slice").over(up_to)).withColumn(
        "n", F.sum("_in_slice").over(Window.partitionBy(key))
    )
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), rank.cast("bigint").alias("rank")) for name, rank in ranks.items()])
    start = F.col("_upto") - F.col("_in_slice")
    targets = (
        cumulative.withColumn(
            "_wanted", F.filter(wanted, lambda w: (w["rank"] >= start) & (w["rank"] < F.col("_upto")))
        )
        .filter(F.size("_wanted") > 0)
        .select(key, "_slice", start.alias("_start"), "_wanted")
    )
    values = sliced.join(targets.select(key, "_slice"), [key, "_slice"], "left_semi").groupBy(key, "_slice", value).agg(
        F.count(F.lit(1)).alias("_copies")
    )
    by_value = Window.partitionBy(key, "_slice").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = values.withColumn("_last", F.sum("_copies").over(by_value)).join(targets, [key, "_slice"])
    hit = ranked.select(
        key,
        value,
        F.explode(
            F.filter(
                "_wanted",
                lambda w: (w["rank"] - F.col("_start") < F.col("_last"))
                & (w["rank"] - F.col("_start") >= F.col("_last") - F.col("_copies")),
            )
        ).alias("_w"),
    )
    return hit.groupBy(key).agg(
        *[F.max(F.when(F.col("_w.name") == name, F.col(value))).alias(name) for name in ranks]
    )
