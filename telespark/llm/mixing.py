"""Mixing sources to target weights by Sainte-Laguë apportionment of equal blocks of words."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telespark.llm.common import WORD
from telespark.session import write_and_read

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
BLOCK = 64
SHARD_WORDS = 1 << 20
SEED = 20


def n_words(text: Column | str) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """`sources` (source, source_size: one row each) with `place`, `weight` and `target` in words.

    Sources in code-point order, null last, take the weights in turn and share `share` times all words by weight. A target
    stops at `most` times its source's size and the excess goes to the others by weight: all open sources then stand at one
    level of words per weight, and those whose cap lies below the level are full. Sorted by cap per weight, the full ones
    come first, which makes the level a running sum. Only one row per source passes through this window.
    """
    ordered = sources.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    turn = F.element_at(F.array(*map(F.lit, weights)), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    capped = ordered.withColumn("weight", turn).withColumn("cap", F.col("source_size") * F.lit(most))
    everything = Window.partitionBy()
    below = Window.orderBy(F.col("cap") / F.col("weight"), "place").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("cap").over(below), F.lit(0))
    open_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(below), F.lit(0))
    level = capped.withColumn("level", left / open_weight)
    full = F.col("cap") <= F.col("level") * F.col("weight")
    level = level.withColumn("full", full).withColumn("level", F.max(F.when(~F.col("full"), F.col("level"))).over(everything))
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("level") * F.col("weight"))
    return level.select("source", "source_size", "place", "weight", target.alias("target"))


def apportion(votes: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """`votes` (group..., order..., votes, seats) with `quota`: in each group the `seats` highest quotients votes / (2 k + 1).

    Two divisors bracket the right one: with n claimants and V votes in all, rounding by V / (seats - n / 2) gives at most
    `seats`, by V / (seats + n / 2) at least. Only the at most 2 n quotients between them are ranked, so that the work
    grows with the claimants, not with the seats. Ties go by `order`.
    """
    within = Window.partitionBy(*group)
    n, total = F.count(F.lit(1)).over(within), F.sum("votes").over(within)
    rounded = lambda seats: F.when(total > 0, F.floor(F.col("votes") * F.greatest(seats, F.lit(0.0)) / total + F.lit(0.5))).otherwise(F.lit(0))
    bracket = votes.withColumn("base", rounded(F.col("seats") - n / 2).cast("bigint")).withColumn("top", (rounded(F.col("seats") + n / 2) + 1).cast("bigint"))
    # A divisor that rounds up a tie may give one seat too many, which the ranking would not take back.
    bracket = bracket.withColumn("base", F.greatest(F.col("base") - 1, F.lit(0)).cast("bigint"))
    bracket = bracket.withColumn("rest", F.col("seats") - F.sum("base").over(within))
    claims = bracket.select("*", F.explode(F.expr("sequence(base, top)")).alias("k"))
    best = Window.partitionBy(*group).orderBy((F.col("votes") / (2 * F.col("k") + 1)).desc(), *order, "k")
    won = claims.withColumn("won", (F.row_number().over(best) <= F.col("rest")) & (F.col("votes") > 0))
    keys = [*group, *order]
    return won.groupBy(*keys, "votes", "seats", "base").agg(F.sum(F.col("won").cast("bigint")).alias("more")).select(*keys, (F.col("base") + F.col("more")).alias("quota"))


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", seed: int = SEED, block: int = BLOCK, shard_words: int = SHARD_WORDS, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Rows of `docs` as struct `row`, with size, source_size, target, `taken` and `pieces`, the word ranges the mix takes.

    The documents of a source are dealt over shards of about `shard_words` words by a seeded hash of their id, so that
    no source is one task. Blocks of `block` words are apportioned to the sources by their targets, and each source's
    blocks to its shards by their size. A shard's documents, in seeded order, make a tape that is read `most` times
    over; of its blocks it takes its quota in a ring from a seeded block on. So whole documents are taken but for those where the
    ring's arc begins and ends, none more than `most` times, and each source comes within a few blocks of its target.

    Null and blank texts have size 0 and are never taken. A null source is a source. Rows with a null id share a shard
    and repeated rows count each time. Reruns agree: nothing depends on partitions. An empty table gives no rows.
    """
    sized = docs.select(F.struct("*").alias("row"), F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"))
    return _mix(sized, seed, block, shard_words, weights, share, most)


def _mix(sized: DataFrame, seed: int, block: int, shard_words: int, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    # Words are counted once: the later passes read this table.
    sized = write_and_read(sized.withColumn("draw", F.xxhash64("doc_id", F.lit(seed))), "mix-sizes")
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = targets(per_source, weights, share, most)
    seats = F.round(F.sum("target").over(Window.partitionBy()) / block).cast("bigint")
    goals = goals.withColumn("seats", seats)
    quotas = apportion(goals.select(F.lit(0).alias("all"), "place", F.col("target").alias("votes"), "seats"), ["all"], ["place"])
    goals = goals.drop("seats").join(quotas.select("place", "quota"), "place").withColumn("shards", F.greatest(F.ceil(F.col("source_size") / shard_words), F.lit(1)).cast("bigint"))
    goals = write_and_read(goals, "mix-goals")  # one row per source
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    dealt = sized.join(goals.drop("weight"), same(sized, goals)).drop(goals["source"]).withColumn("shard", F.pmod("draw", "shards"))
    shards = dealt.groupBy("place", "shard", "quota").agg(F.sum("size").alias("shard_size"))
    shares = apportion(shards.select("place", "shard", F.col("shard_size").cast("double").alias("votes"), F.col("quota").alias("seats")), ["place"], ["shard"])
    shares = shares.withColumnRenamed("quota", "blocks")
    along = Window.partitionBy("place", "shard").orderBy(F.xxhash64("draw", F.lit(seed + 1)), F.col("doc_id").asc_nulls_last(), "size")
    taped = dealt.withColumn("end", F.sum("size").over(along.rowsBetween(Window.unboundedPreceding, 0))).withColumn("tape", F.sum("size").over(Window.partitionBy("place", "shard")))
    taped = taped.join(shares, ["place", "shard"])
    ring = F.col("tape") * most
    count = F.ceil(ring / block).cast("bigint")
    blocks = F.least(F.col("blocks"), count)
    first = F.when(count > 0, F.pmod(F.xxhash64("place", "shard", F.lit(seed + 2)), count)).otherwise(F.lit(0))
    arcs = [(first * block, F.least((first + blocks) * block, ring)), (F.lit(0).cast("bigint"), F.least(F.greatest((first + blocks - count) * block, F.lit(0)), first * block))]
    pieces = []
    for lap in range(most):
        start = F.col("end") - F.col("size") + F.col("tape") * lap
        for low, high in arcs:
            pieces.append(F.struct((F.greatest(low, start) - start).cast("bigint").alias("start"), (F.least(high, start + F.col("size")) - start).cast("bigint").alias("end")))
    taken = F.filter(F.array(*pieces), lambda p: p["end"] > p["start"])
    out = taped.withColumn("pieces", taken)
    words = F.aggregate("pieces", F.lit(0).cast("bigint"), lambda total, p: total + p["end"] - p["start"])
    keep = ["row"] if "row" in sized.columns else []
    return out.select(*keep, "doc_id", "size", "source_size", "target", words.alias("taken"), "pieces")


def sizes_mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED) -> DataFrame:
    """mix() without the rows themselves: only ids and sizes are shuffled."""
    sized = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"))
    return _mix(sized, seed, BLOCK, SHARD_WORDS, WEIGHTS, SHARE, MOST)


_WORD = re.compile(WORD)


@F.arrow_udf(T.StringType())
def words_between(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    """The part of a text from word `start` to word `end` (exclusive), as it stands there; null for null."""
    for texts, starts, ends in batches:
        out = []
        for text, start, end in zip(texts.to_pylist(), starts.to_pylist(), ends.to_pylist(), strict=True):
            if text is None:
                out.append(None)
                continue
            spans = [m.span() for m in _WORD.finditer(text)]
            out.append(text if start == 0 and end == len(spans) else text[spans[start][0] : spans[end - 1][1]] if start < end else "")
        yield pa.array(out, pa.string())


def mixed_rows(mixed: DataFrame, text: str = "text") -> DataFrame:
    """The rows that a mix consists of: each of mix()'s pieces is one row of the original columns, its text cut to the piece."""
    rows = mixed.select("row", F.explode("pieces").alias("piece"))
    part = words_between(F.col("row")[text], F.col("piece")["start"], F.col("piece")["end"])
    return rows.select(F.col("row").withField(text, part).alias("row")).select("row.*")
