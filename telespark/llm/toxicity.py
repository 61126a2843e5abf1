"""Toxicity by a counterfactual-regularised logistic classifier."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from telespark.llm.common import remainder, small_batches
from telespark.session import write_and_read

#: Most labelled documents that the model is fitted on, and most words that it weighs.
TRAIN_DOCS = 20_000
TRAIN_TERMS = 2000
LEAST_DOCS = 3
#: Standard deviations by which a weighed word's toxic share departs from the whole's.
LEAST_SCORE = 4.5
THRESHOLD = 0.7
PAIRING = 5.0
# Terms that name groups of people, each list one set of interchangeable terms.
IDENTITY = (
    ("women", "men", "woman", "man", "female", "male", "girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "african", "european", "american"),
    ("gay", "straight", "lesbian", "heterosexual", "homosexual", "transgender", "bisexual"),
    ("frauen", "männer"), ("muslime", "christen", "juden"), ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"),
    ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"),
)
_LETTERS = re.compile(r"[^\W\d_]+")


def terms_of(text: str | None) -> set[str]:
    """Different words of a text, in lower case."""
    return set(_LETTERS.findall(text.lower())) if text else set()


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    bias: float

    def score(self, text: str | None) -> float:
        found = terms_of(text)
        total = self.bias + sum(self.weights[w] for w in found.intersection(self.weights))
        return float(1 / (1 + np.exp(-np.clip(total, -500, 500))))


def counterfactuals(docs: list[set[str]], identity: tuple[tuple[str, ...], ...]) -> list[tuple[int, str, str]]:
    """(document, term, other term of its set) for each identity term of each document."""
    other = {t: [o for o in group if o != t] for group in identity for t in group}
    return [(i, t, o) for i, terms in enumerate(docs) for t in sorted(terms.intersection(other)) for o in other[t]]


def fit(docs: list[set[str]], labels: np.ndarray, vocabulary: list[str], identity: tuple[tuple[str, ...], ...] = IDENTITY, pairing: float = PAIRING, decay: float = 0.02, rounds: int = 400, rate: float = 0.1) -> Model:
    """Weights of `vocabulary` and of all identity terms met, for presence of a word in a text.

    Minimised are the cross-entropy, a penalty on large weights, and `pairing` times the mean squared change of the logit
    when an identity term in a labelled text is swapped for another of its set. The vocabulary is what the texts are judged by
    besides; labels weigh alike in sum, so that rare toxic texts count.
    """
    swaps = counterfactuals(docs, identity)
    columns = {t: j for j, t in enumerate(dict.fromkeys([*vocabulary, *(t for _, *pair in swaps for t in pair)]))}
    if not len(docs) or labels.min() == labels.max():
        return Model({}, 0.0 if not len(docs) else (4.0 if labels.max() else -4.0))
    hits = [sorted(columns[t] for t in d.intersection(columns)) for d in docs]
    row = np.repeat(np.arange(len(docs)), [len(x) for x in hits])
    col = np.array([j for x in hits for j in x], dtype=np.int64)
    share = labels.mean()
    case = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share)) / len(labels)
    gain = np.array([columns[o] for _, _, o in swaps], dtype=np.int64)
    loss = np.array([columns[t] for _, t, _ in swaps], dtype=np.int64)
    new = np.array([o not in docs[i] for i, _, o in swaps], dtype=np.float64)
    w, b = np.zeros(len(columns)), 0.0
    m, v = np.zeros(len(columns) + 1), np.zeros(len(columns) + 1)
    for step in range(1, rounds + 1):
        logit = b + np.bincount(row, w[col], len(labels))
        error = (1 / (1 + np.exp(-np.clip(logit, -500, 500))) - labels) * case
        slope = np.bincount(col, error[row], len(w)) + decay * w / len(w)
        if swaps:
            change = (new * w[gain] - w[loss]) * (2 * pairing / len(swaps))
            slope += np.bincount(gain, change * new, len(w)) - np.bincount(loss, change, len(w))
        g = np.append(slope, error.sum())
        m += 0.1 * (g - m)
        v += 0.001 * (g * g - v)
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w -= move[:-1]
        b -= move[-1]
    return Model({t: float(w[j]) for t, j in columns.items()}, float(b))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", docs_most: int = TRAIN_DOCS, **options) -> Model:
    """A model learned from at most `docs_most` labelled documents, drawn by a hash of their id.

    Documents whose crc32(id) mod 3 is 1 are held out; null labels, ids and texts are not used, and of several labels of a document
    the highest counts. The drawn ids are bounded and so are the words: those of at least LEAST_DOCS drawn documents whose
    share of toxic ones departs most from the whole's, by LEAST_SCORE deviations at least, TRAIN_TERMS at most. Spark counts them; only presence of these words comes to the driver.
    """
    drawn = labels.where((remainder(doc_id, 3) != 1) & F.col(toxic).isNotNull()).groupBy(F.col(doc_id).alias("doc_id")).agg(F.max(toxic).alias("toxic"))
    drawn = drawn.orderBy(F.xxhash64("doc_id"), "doc_id").limit(docs_most)
    split = F.array_distinct(F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"\p{L}+"), F.lit(0)))
    texts = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    # At most docs_most ids and labels are broadcast.
    sample = texts.join(F.broadcast(drawn), "doc_id").select("toxic", split.alias("terms"), F.xxhash64("doc_id", "text").alias("row"))
    sample = write_and_read(sample, "toxicity-sample")
    n, positive = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not n:
        return fit([], np.zeros(0), [])
    share = positive / n
    words = sample.select("toxic", F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("t")).where(F.col("n") >= LEAST_DOCS)
    score = F.abs(F.col("t") - F.col("n") * share) / F.sqrt(F.col("n") * F.lit(max(share * (1 - share), 1e-9)))
    vocabulary = [r[0] for r in words.where(score >= LEAST_SCORE).orderBy(F.desc(score), "term").limit(TRAIN_TERMS).select("term").collect()]
    groups = options.get("identity", IDENTITY)
    wanted = F.array(*[F.lit(t) for t in sorted({*vocabulary, *(t for g in groups for t in g)})])
    rows = sample.select("row", "toxic", F.array_intersect("terms", wanted).alias("terms")).orderBy("row").collect()
    return fit([set(r["terms"]) for r in rows], np.array([r["toxic"] for r in rows]), vocabulary, **options)


def score(spark: SparkSession, text: Column | str, model: Model) -> Column:
    """Probability-like score, 0 to 1, of whole texts; a null or empty text gets the score of no words."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def compute(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        for batch in batches:
            yield pa.array([model.score(v.as_py()) for v in batch], pa.float64())

    return compute(text)
