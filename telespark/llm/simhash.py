"""SimHash near-duplicates by deletion-variant signatures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telespark.llm.common import cut, small_batches
from telespark.llm.components import connected_components
from telespark.session import write_and_read

SHINGLE = 3
SEED = 42
HALF = 32
HOT = 64


def fingerprint_of(text: bytes) -> int:
    """64-bit fingerprint, as a signed integer, of one text in UTF-8."""
    words = text.lower().split()  # of bytes: A-Z and the six ASCII white-space characters only
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, SEED) for s in shingles], dtype=">u8")
    ones = np.zeros(64, dtype=np.int64)
    for start in range(0, len(hashes), 8192):
        ones += np.unpackbits(hashes[start : start + 8192].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big", signed=True)


def fingerprint(text: Column | str) -> Column:
    """bigint fingerprint of a text column; a null or blank text has fingerprint 0."""

    @F.arrow_udf("bigint")
    def compute(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([fingerprint_of(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in batch.cast(pa.binary())], pa.int64())

    return compute(text)


def fingerprint_text(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def links(prints: DataFrame, hot: int = HOT) -> DataFrame:
    """Pairs (a, b), a < b, of the distinct values of `fp` that differ in at most two bits.

    A fingerprint is cut into two halves, so that of two linked ones some half differs by at most one bit. Every
    fingerprint is filed under each half unchanged (the other half may then differ by two bits), and under the upper half
    with each of its bits as a wildcard (both halves then differ by one). Equal keys meet in an equi-join and are verified.

    A key with more than `hot` fingerprints is filed again under longer variants, which add the other half with two
    wildcards, or with one where the upper half has one: members of such a key differ only in the wildcards, so that
    a key holds at most four and no group makes pairs with its square. The result doesn't depend on `hot`.
    """
    low = F.lit((1 << HALF) - 1)
    distinct = prints.select("fp").where(F.col("fp").isNotNull()).distinct()
    upper, lower = F.shiftrightunsigned("fp", HALF), F.col("fp").bitwiseAND(low)
    key = lambda kind, *parts: F.struct(F.lit(kind).alias("kind"), F.xxhash64(F.lit(kind), *parts).alias("key"))
    variants = [key(0, upper), key(1, lower)]
    variants += [key(2, F.lit(i), upper.bitwiseAND(F.lit(~(1 << i) & ((1 << HALF) - 1)))) for i in range(HALF)]
    filed = distinct.select("fp", F.explode(F.array(*variants)).alias("v")).select("fp", "v.kind", "v.key")
    met = filed.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key"))).where("n > 1")
    met = write_and_read(met, "simhash-met")  # only fingerprints that share a key with another
    few = met.where(F.col("n") <= hot).select("key", "fp")
    many = met.where(F.col("n") > hot)
    bits = [1 << i for i in range(HALF)]
    single = F.array([F.lit(x).cast("bigint") for x in bits])
    double = F.array([F.lit(x | y).cast("bigint") for x in bits for y in bits if x < y])
    # Of a hot key the shared half is known, so that only the other half is filed, with its wildcards cleared.
    other = F.when(F.col("kind") == 0, lower).when(F.col("kind") == 1, upper).otherwise(lower)
    masks = F.when(F.col("kind") == 2, single).otherwise(double)
    longer = many.select("fp", "key", other.alias("other"), F.explode(masks).alias("mask"))
    longer = longer.select(F.xxhash64("key", "mask", F.col("other").bitwiseAND(F.bitwise_not("mask"))).alias("key"), "fp")
    pool = few.union(longer)
    pairs = pool.select("key", F.col("fp").alias("a")).join(pool.select("key", F.col("fp").alias("b")), "key")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2
    return pairs.where((F.col("a") < F.col("b")) & near).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """One row per row of `docs`: its id, `row_key` (a hash of id and text), `fp`, `group` (the group's smallest fingerprint) and
    `component_id`, the smallest id of the group.

    Fingerprints are linked once per distinct value, however many documents share it. Null and blank texts share
    fingerprint 0 and are linked like any other; rows with a null id keep their place and never name a group unless it
    has no other id, when its component_id is null. Repeated rows come back as often as they came. Other columns of
    `docs` are ignored. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    wanted = docs.select(F.col(doc_id).alias("doc_id"), row_key(doc_id, text).alias("row_key"), fingerprint(F.col(text)).alias("fp"))
    prints = write_and_read(wanted, "simhash-fp")
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    roots = connected_components(cut(links(prints, hot)))
    rooted = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("group"))
    named = rooted.groupBy("group").agg(F.min("first_id").alias("component_id"))
    lookup = rooted.join(named, "group").select("fp", "group", "component_id")
    return prints.join(lookup, "fp").select("doc_id", "row_key", "fp", "group", "component_id")


def row_key(doc_id: str, text: str) -> Column:
    return F.xxhash64(F.col(doc_id).cast("string"), F.col(text))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """`docs` with one row of each group of near-duplicates: that of the smallest id, null last. All columns stay."""
    groups = near_duplicates(docs, doc_id, text, hot)
    first = groups.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row_key")).alias("first"))
    kept = first.select(F.col("first.row_key").alias("row_key"))
    rows = docs.select(F.struct("*").alias("row"), row_key(doc_id, text).alias("row_key"))
    same = Window.partitionBy("row_key").orderBy("row_key")  # equal ids and texts
    return rows.join(kept.distinct(), "row_key").withColumn("copy", F.row_number().over(same)).where("copy = 1").select("row.*")
