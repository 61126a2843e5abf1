"""The operators of this subpackage as named queries over the given tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telespark.llm import bpe, langid, licenses, media, mixing, paragraphs, periodic, ranked, secrets, simhash, suffix_dedup, topk, toxicity
from telespark.llm.common import remainder, table
from telespark.llm.oracles import ORACLES

Query = Callable[[SparkSession, str], DataFrame]


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.repeated_anywhere(table(spark, sf_dir, "documents"))


def op2_verbatim_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.verbatim(table(spark, sf_dir, "documents"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = docs.select("doc_id", bpe.encode(spark, "text", ranks, public_tokenizers.PATTERN).alias("ids"))
    both = coded.select("doc_id", "ids", bpe.decode(spark, "ids", ranks).alias("decoded"))
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return both.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(listed.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"), toxicity.score(spark, "text", model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= toxicity.THRESHOLD).cast("int"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs)
    found = docs.select("doc_id", F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), langid.predict(spark, "text", model).alias("p"))
    return found.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")
    digest = F.sha2(secrets.spans_text("base").cast("binary"), 256)
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), digest.alias("base_sha256"), secrets.spans_text("spans").alias("spans"))


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.fingerprint_text(F.col("fp")).alias("fingerprint"), "component_id")


def op9_media_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No table holds pictures: Spark renders one of each embedding, and edited copies of every tenth."""
    return media.copies(media.rendered_media(table(spark, sf_dir, "embeddings")))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.sizes_mixed(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.collapse_runs(table(spark, sf_dir, "documents"), with_refrains=True).withColumn("best", periodic.longest(F.col("runs")))
    best = [F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")]
    exponent = F.expr("best.length * 1000 div best.period").alias("exponent_milli")
    digests = [F.sha2(c.cast("binary"), 256).alias(name) for c, name in ((periodic.runs_text(F.col("runs")), "runs_sha256"), (F.col("collapsed"), "collapsed_sha256"))]
    return found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), *best, exponent, *digests)


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.dedup(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def llm_queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_license_scan, op2_substring_dedup, op2_verbatim_passages, op3_byte_bpe, op4_toxicity, op5_language_id, op6_secret_scan, op7_exact_top_k, op8_simhash_near_dedup, op9_media_copies, op10_mixing, op11_periodic_runs, op12_suffix_dedup, op13_ranked_search)}


def llm_oracles() -> dict[str, str]:
    return dict(ORACLES)
