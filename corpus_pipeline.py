"""From raw documents to token ids: language, near-duplicates, secrets, mixture, byte-level BPE."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telespark.llm import bpe, langid, mixing, secrets, simhash
from telespark.session import write_and_read

#: Documents whose words are of no known language are rejected: their words' best languages have a lower mean posterior than this. Texts that mix known languages are kept.
LEAST_CONFIDENCE = 0.4


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language. A null `lang` becomes the predicted one; texts without letters, and those whose words are of no known language, go."""
    model = langid.train(docs)
    # Behind a one-element generator the prediction is made once a row.
    judged = docs.select(F.struct("*").alias("row"), langid.predict(spark, "text", model).alias("p"))
    judged = judged.select("row", F.explode(F.array("p")).alias("p")).where((F.col("p.lang") != langid.UNKNOWN) & (F.col("p.confidence") >= LEAST_CONFIDENCE))
    return judged.select(F.col("row").withField("lang", F.coalesce("row.lang", "p.lang")).alias("row")).select("row.*")


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.one_of_each(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents, each stretch of secrets replaced by a mark, and n_chars counted anew where that changed the text."""
    found = secrets.scan(docs.select(F.struct("*").alias("row"), F.col("text").alias("text")))
    clean = found.select("row", F.size("spans").alias("n"), secrets.redact(F.col("text"), F.col("spans")).alias("text"))
    length = F.when(F.col("n") > 0, F.length("text").cast("bigint")).otherwise(F.col("row.n_chars"))
    return clean.select(F.col("row").withField("text", F.col("text")).withField("n_chars", length).alias("row")).select("row.*")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: documents as often as it takes them, whole or in part, with n_chars of the part."""
    mixed = mixing.mixed_rows(mixing.mix(docs))
    return mixed.withColumn("n_chars", F.length("text").cast("bigint"))


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with a check that they decode to its text."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = docs.select("doc_id", "lang", "source", F.col("text").cast("binary").alias("bytes"), bpe.encode(spark, "text", ranks, public_tokenizers.PATTERN).alias("ids"))
    checked = coded.select("doc_id", "lang", "source", "ids", (bpe.decode(spark, "ids", ranks) == F.coalesce("bytes", F.lit(b""))).alias("round_trip"))
    return checked.select("doc_id", "lang", "source", F.size("ids").cast("bigint").alias("n_tokens"), "ids", "round_trip")


STAGES = [
    ("language ID", language_stage),
    ("SimHash near-dedup", dedup_stage),
    ("secret scans", secrets_stage),
    ("mixing sources", mixing_stage),
    ("byte-level BPE", tokens_stage),
]

#: Classifier, components and tokenizer have no SQL form; tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = write_and_read(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
