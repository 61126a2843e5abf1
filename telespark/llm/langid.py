"""Language of words and texts by a linear-chain conditional random field."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from telespark.llm.common import remainder, small_batches

UNKNOWN = "und"
#: Documents and most words of each that the model is fitted on, places of a text that these come from, least documents of a label, most labels.
TRAIN_DOCS = 1500
TRAIN_WORDS = 160
PLACES = 8
LABEL_DOCS = 20
LABELS = 256
BUCKETS = 1 << 16
STRETCH = 128
KNOWN_WORDS = 200_000
BATCH_WORDS = 200_000
#: Words whose emissions are summed together.
NEW_WORDS = 1 << 12
#: Words of a prediction's chains at once, times labels.
CHAIN_CELLS = 1 << 21


_RUNS = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Runs of letters, in lower case."""
    words = _RUNS.findall(text.lower()) if text else []
    if all(map(str.isalpha, words)):
        return words
    # Fractions, superscripts and other numbers are word characters, but no letters.
    return [part for w in words for part in "".join(c if c.isalpha() else " " for c in w).split()]


def features(word: str) -> list[int]:
    """Hashed features: the word itself (a lexicon entry), affixes of up to four letters and n-grams of two and three."""
    marked = f"^{word}$"
    names = [f"w{word}", "b"]
    names += [f"p{word[:n]}" for n in range(1, min(len(word), 4) + 1)]
    names += [f"s{word[-n:]}" for n in range(1, min(len(word), 4) + 1)]
    names += [marked[i : i + n] for n in (2, 3) for i in range(len(marked) - n + 1)]
    return [crc32(x.encode()) % BUCKETS for x in names]


_NONE = 0xFFFFFFFF  # a checksum's register before the first byte
#: What a byte does to the register.
_STEPS = np.array([crc32(bytes([b])) ^ _NONE ^ (_NONE >> 8) for b in range(256)], dtype=np.uint32)[np.arange(256) ^ 255]


def listed_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(number of the word, feature), in order, of many words at once: those of `features`, each once. All words' checksums go on together, a letter at a time."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    codes = np.frombuffer(("^" + "$^".join(words) + "$").encode("utf-32-le"), dtype=np.uint32)
    extra = (codes >= 0x80).astype(np.uint32) + (codes >= 0x800) + (codes >= 0x10000)  # bytes of UTF-8 after the first
    lead = np.array([0, 0xC0, 0xE0, 0xF0], dtype=np.uint32)[extra] | (codes >> (6 * extra))
    longest = int(extra.max())

    def fed(register: np.ndarray, at: np.ndarray) -> np.ndarray:
        register = _STEPS[(register ^ lead[at]) & 255] ^ (register >> 8)
        for j in range(longest):
            rest = np.flatnonzero(extra[at] > j)
            code, old = codes[at[rest]] >> (6 * (extra[at[rest]] - j - 1)), register[rest]
            register[rest] = _STEPS[(old ^ (0x80 | code & 63)) & 255] ^ (old >> 8)
        return register

    begins = np.cumsum(sizes + 2) - (sizes + 2)  # of the mark before each word
    owner = np.repeat(np.arange(len(words)), sizes + 2)
    number = np.arange(len(words))
    found = [(number, np.fromiter((crc32(b"w" + w.encode()) for w in words), np.uint32, len(words)) ^ _NONE), (number, np.full(len(words), crc32(b"b") ^ _NONE, dtype=np.uint32))]
    prefix = np.full(len(words), crc32(b"p") ^ _NONE, dtype=np.uint32)
    for n in range(1, 5):
        number = np.flatnonzero(sizes >= n)
        prefix[number] = fed(prefix[number], begins[number] + n)
        found.append((number, prefix[number]))
        suffix = np.full(len(number), crc32(b"s") ^ _NONE, dtype=np.uint32)
        for i in range(n):
            suffix = fed(suffix, begins[number] + sizes[number] + 1 - n + i)
        found.append((number, suffix))
    ends = np.zeros(len(codes) + 1, dtype=bool)
    ends[begins + sizes + 1] = True
    at = np.flatnonzero(~ends[:-1])
    pair = fed(fed(np.full(len(at), _NONE, dtype=np.uint32), at), at + 1)
    found.append((owner[at], pair))
    inner = ~ends[at + 1]
    found.append((owner[at[inner]], fed(pair[inner], at[inner] + 2)))
    number, registers = (np.concatenate(x) for x in zip(*found, strict=True))
    pairs = np.sort(number * BUCKETS + ((registers ^ np.uint32(_NONE)) % BUCKETS).astype(np.int64))
    pairs = pairs[np.diff(pairs, prepend=-1) > 0]
    return pairs // BUCKETS, pairs % BUCKETS


@dataclass(frozen=True)
class Model:
    labels: tuple[str, ...]
    weights: np.ndarray  # BUCKETS x labels
    transitions: np.ndarray  # labels x labels
    start: np.ndarray


def posteriors(emissions: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over many chains at once, longest first: (labels of each word, expected transitions).

    `emissions` is chains x time x labels; what lies beyond a chain's length is ignored.
    """
    chains, steps, k = emissions.shape
    # A floor keeps every label possible, so that no step of a chain vanishes in single precision.
    potential = np.exp(np.maximum(emissions - emissions.max(axis=2, keepdims=True), -25))
    move = np.exp(transitions - transitions.max())
    forward = np.zeros_like(potential)
    backward = np.ones_like(potential)
    active = [int(np.count_nonzero(lengths > t)) for t in range(steps)]
    if steps:
        first = potential[:, 0] * np.exp(start - start.max())
        forward[:, 0] = first / first.sum(axis=1, keepdims=True)
    for t in range(1, steps):
        n = active[t]
        step = (forward[:n, t - 1] @ move) * potential[:n, t]
        forward[:n, t] = step / step.sum(axis=1, keepdims=True)
    for t in range(steps - 2, -1, -1):
        n = active[t + 1]
        step = (backward[:n, t + 1] * potential[:n, t + 1]) @ move.T
        backward[:n, t] = step / step.sum(axis=1, keepdims=True)
    both = forward * backward
    marginal = both / np.maximum(both.sum(axis=2, keepdims=True), np.finfo(both.dtype).tiny)
    inner = np.arange(1, steps)[None, :] < lengths[:, None]
    left, right = forward[:, :-1][inner], (potential * backward)[:, 1:][inner]
    scale = ((left @ move) * right).sum(axis=1, keepdims=True)
    expected = move * ((left / np.maximum(scale, np.finfo(scale.dtype).tiny)).T @ right)
    return marginal, expected


def fit(sequences: list[tuple[list[str], list[int]]], labels: tuple[str, ...], epochs: int = 6, rate: float = 0.1, decay: float = 1e-5) -> Model:
    """Maximum likelihood of labelled word sequences by Adam on batches of chains."""
    k = len(labels)
    weights, transitions, start = np.zeros((BUCKETS, k)), np.zeros((k, k)), np.zeros(k)
    params = [weights, transitions, start]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    vocabulary: dict[str, int] = {}
    rows = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words]) for words, _ in sequences]
    listed = [np.unique(features(w)) for w in vocabulary]
    flat = np.concatenate(listed) if listed else np.zeros(0, dtype=np.int64)
    ends = np.cumsum([len(x) for x in listed]) if listed else np.zeros(0, dtype=np.int64)
    begins = ends - [len(x) for x in listed] if listed else ends
    draw = np.random.default_rng(5)
    step = 0
    for _ in range(epochs if sequences else 0):
        order = draw.permutation(len(sequences))
        for at in range(0, len(order), 128):
            batch = sorted(order[at : at + 128], key=lambda i: -len(rows[i]))
            lengths = np.array([len(rows[i]) for i in batch])
            words, place = np.unique(np.concatenate([rows[i] for i in batch]), return_inverse=True)
            used = np.concatenate([flat[begins[w] : ends[w]] for w in words])
            of_word = np.repeat(np.arange(len(words)), [ends[w] - begins[w] for w in words])
            scores = np.zeros((len(words), k))
            np.add.at(scores, of_word, weights[used])
            emissions = np.zeros((len(batch), lengths.max(), k))
            truth = np.zeros_like(emissions)
            inside = np.arange(lengths.max())[None, :] < lengths[:, None]
            emissions[inside] = scores[place]
            gold = [np.array(sequences[i][1]) for i in batch]
            truth[inside] = np.eye(k)[np.concatenate(gold)]
            marginal, expected = posteriors(emissions, lengths, transitions, start)
            error = (marginal - truth)[inside]
            n = len(error)
            by_word = np.zeros((len(words), k))
            np.add.at(by_word, place, error)
            seen = np.zeros((k, k))
            for g in gold:
                np.add.at(seen, (g[:-1], g[1:]), 1)
            slope = np.zeros_like(weights)
            np.add.at(slope, used, by_word[of_word])
            gradients = [slope / n + decay * weights, (expected - seen) / n + decay * transitions, (marginal[:, 0] - truth[:, 0]).mean(axis=0)]
            step += 1
            for p, g, (m, v) in zip(params, gradients, moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Model(labels, weights, transitions, start)


def code_switched(rows: list[tuple[str, str]], labels: tuple[str, ...]) -> list[tuple[list[str], list[int]]]:
    """Training chains: pieces of differing length from texts in turn, so that languages change within a chain."""
    number = {label: i for i, label in enumerate(labels)}
    draw = np.random.default_rng(7)
    pieces = []
    for text, label in rows:
        words = words_of(text)
        at = 0
        while at < min(len(words), TRAIN_WORDS):
            n = int(draw.integers(4, 40))
            pieces.append((words[at : at + n], number[label]))
            at += n
    order = draw.permutation(len(pieces))
    chains = []
    for at in range(0, len(order), 3):
        words, gold = [], []
        for i in order[at : at + 3]:
            words += pieces[i][0]
            gold += [pieces[i][1]] * len(pieces[i][0])
        chains.append((words, gold))
    return chains


def _drawn(parts: list[str], seed: int) -> str:
    """At most TRAIN_WORDS words of a whole text, or of parts cut from its PLACES stretches, in equal shares."""
    n = TRAIN_WORDS // PLACES
    if len(parts) > 1:
        kept = [words_of(part) for part in parts]
        return " ".join(" ".join((words[1:-1] or words)[:n]) for words in kept)  # the cut may go through the words at the ends
    words = words_of(parts[0])
    step = len(words) // PLACES
    if len(words) <= TRAIN_WORDS:
        return " ".join(words)
    begins = np.random.default_rng(seed % (1 << 63)).integers(0, step - n + 1, PLACES) + step * np.arange(PLACES)
    return " ".join(" ".join(words[i : i + n]) for i in begins.tolist())


def train(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", docs_most: int = TRAIN_DOCS, labels_most: int = LABELS) -> Model:
    """A model of all labels in `lang`, learned from `docs_most` documents, or from LABEL_DOCS of each label where that is more.

    Documents whose crc32(id) mod 4 is 2 are held out; null labels and null ids are not used. The sample is drawn by a hash of the id and
    is bounded: these documents and TRAIN_WORDS words of each are all that comes to the driver, the words from places drawn by the same hash in each of
    PLACES equal stretches of the whole text. Prediction reads whole texts. Every label has an equal
    part of it, so that rare languages are learned too. The model grows with the labels (0.5 MB each); more than `labels_most` raise an error, none is left out.
    """
    usable = docs.where((remainder(doc_id, 4) != 2) & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    usable = usable.select(F.col(lang).alias("label"), F.xxhash64(doc_id).alias("draw"), F.col(text).alias("text"))
    ids = usable.select("label", "draw").distinct()
    sizes = {r[0]: r[1] for r in ids.groupBy("label").agg(F.count(F.lit(1))).limit(labels_most + 1).collect()}
    labels = tuple(sorted(sizes))
    if len(labels) > labels_most:
        raise ValueError(f"`{lang}` has more than {labels_most} labels; pass a larger labels_most")
    if not labels:
        return Model((), np.zeros((BUCKETS, 0)), np.zeros((0, 0)), np.zeros(0))
    each = max(LABEL_DOCS, docs_most // len(labels))
    # Draws are uniform: of a label's ids, those below this limit are at least `each`, and few enough to be ordered in one place.
    limits = F.create_map(*[F.lit(x) for label, n in sizes.items() for x in (label, (2 * each + 64) / n)])
    first = lambda *by: F.row_number().over(Window.partitionBy("label").orderBy(*by))
    picked = ids.where(F.col("draw") / F.lit(2.0**64) + 0.5 <= F.element_at(limits, F.col("label"))).withColumn("order", first("draw")).where(F.col("order") <= each)
    ranked = usable.join(F.broadcast(picked.select("label", "draw")), ["label", "draw"]).withColumn("order", first("draw", "text")).where(F.col("order") <= each)
    reach, length = TRAIN_WORDS * 12 // PLACES, F.length("text")
    stretch = F.floor(length / PLACES).cast("int")
    part = lambda i: F.substring("text", (stretch * i + 1 + F.pmod(F.xxhash64("draw", F.lit(i)), stretch - reach + 1)).cast("int"), F.lit(reach))
    parts = F.when(length <= reach * PLACES, F.array("text")).otherwise(F.array(*[part(i) for i in range(PLACES)]))
    sample = ranked.select(parts.alias("parts"), "label", "draw", "order").collect()
    rows = [(_drawn(r["parts"], r["draw"]), r["label"]) for r in sorted(sample, key=lambda r: (r["label"], r["order"]))]
    return fit(code_switched(rows, labels), labels)


class _Words(dict):
    """Emission rows of words, and their potentials: exponentials relative to the best label.

    A word that is met gets its number at once; the rows are summed for some thousand words together, feature by feature.
    """

    def __init__(self, model: Model):
        self.model, self.rows = model, np.zeros((1 << 12, len(model.labels)), dtype=np.float32)
        self.potentials, self.done = np.zeros((len(model.labels), 0), dtype=np.float32), 0
        self.new: list[str] = []  # the last words, without rows as yet

    def __missing__(self, word: str) -> int:
        if len(self.new) == NEW_WORDS:
            self.emissions()
        self.new.append(word)
        self[word] = i = len(self)
        return i

    def emissions(self) -> np.ndarray:
        """Rows by number, of all words so far."""
        if not self.new:
            return self.rows
        while len(self) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        number, listed = listed_features(self.new)
        sizes = np.bincount(number)
        order = np.argsort(-sizes, kind="stable")
        starts = (np.cumsum(sizes) - sizes)[order]
        left = np.searchsorted(-sizes[order], -np.arange(1, int(sizes.max()) + 1), side="right")  # words with more than t features
        sums = self.model.weights[listed[starts]]
        for t in range(1, len(left)):
            sums[: left[t]] += self.model.weights[listed[starts[: left[t]] + t]]
        self.rows[order + (len(self) - len(self.new))] = sums
        self.new = []
        return self.rows

    def clear(self) -> None:
        super().clear()
        self.done, self.new = 0, []

    def by_label(self) -> np.ndarray:
        """Potentials, labels x words."""
        self.emissions()
        if self.potentials.shape[1] != len(self.rows):
            wider = np.zeros((len(self.model.labels), len(self.rows)), dtype=np.float32)
            wider[:, : self.done] = self.potentials[:, : self.done]
            self.potentials = wider
        if self.done < len(self):
            new = self.rows[self.done : len(self)]
            self.potentials[:, self.done : len(self)] = np.exp(np.maximum(new - new.max(axis=1, keepdims=True), -25)).T
            self.done = len(self)
        return self.potentials


def _chains(index: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start among all words, length, text) of the stretches of up to STRETCH words, longest first."""
    sizes = np.array(list(map(len, index)), dtype=np.int64)
    many = -(-sizes // STRETCH)
    text = np.repeat(np.arange(len(sizes)), many)
    within = STRETCH * (np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many))
    lengths = np.minimum(sizes[text] - within, STRETCH)
    order = np.argsort(-lengths, kind="stable")
    return ((np.cumsum(sizes) - sizes)[text] + within)[order], lengths[order], text[order]


def text_sums(texts: list[str | None], model: Model, known: _Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of each text, sums of their posteriors by label, sums of their largest posteriors): those of label_words, without keeping each word's.

    Chains run side by side, a step of all of them at a time, labels by chains.
    """
    if len(known) > KNOWN_WORDS:
        known.clear()
    index = [np.fromiter(map(known.__getitem__, words_of(t)), dtype=np.int64) for t in texts]
    k = len(model.labels)
    sums, tops = np.zeros((len(texts), k)), np.zeros(len(texts))
    counts = np.array(list(map(len, index)), dtype=np.int64)
    if not counts.sum() or not k:
        return counts, sums, tops
    flat, potentials = np.concatenate(index), known.by_label()
    starts, lengths, text = _chains(index)
    move = np.exp(model.transitions - model.transitions.max()).astype(np.float32)
    onward, start = np.ascontiguousarray(move.T), np.exp(model.start - model.start.max()).astype(np.float32)[:, None]
    size = max(16, CHAIN_CELLS // (STRETCH * k))
    for at in range(0, len(starts), size):
        begin, n = starts[at : at + size], lengths[at : at + size]
        steps = int(n[0])
        active = np.searchsorted(-n, -np.arange(1, steps + 1), side="right")  # chains with more than t words
        words = flat[np.minimum(begin[None, :] + np.arange(steps)[:, None], len(flat) - 1)]
        own = [potentials[:, words[t, : active[t]]] for t in range(steps)]
        forward = [own[0] * start]
        forward[0] /= forward[0].sum(axis=0)
        for t in range(1, steps):
            f = (onward @ forward[-1][:, : active[t]]) * own[t]
            f /= f.sum(axis=0)
            forward.append(f)
        backward = np.ones((k, len(n)), dtype=np.float32)
        chain, top = np.zeros((k, len(n)), dtype=np.float32), np.zeros(len(n), dtype=np.float32)
        for t in range(steps - 1, -1, -1):
            m = active[t]
            both = forward[t] * backward[:, :m]
            both /= np.maximum(both.sum(axis=0), np.finfo(np.float32).tiny)
            chain[:, :m] += both
            top[:m] += both.max(axis=0)
            b = move @ (own[t] * backward[:, :m])
            backward[:, :m] = b / b.sum(axis=0)
        np.add.at(sums, text[at : at + size], chain.T)
        np.add.at(tops, text[at : at + size], top)
    return counts, sums, tops


def label_words(texts: list[str | None], model: Model, known: _Words | None = None) -> list[np.ndarray]:
    """Posteriors (words x labels) of each text's words; chains are stretches of up to STRETCH words, and whole texts are read."""
    if not model.labels:
        return [np.zeros((len(words_of(t)), 0), dtype=np.float32) for t in texts]
    known = _Words(model) if known is None else known
    if len(known) > KNOWN_WORDS:
        known.clear()
    index = [np.fromiter(map(known.__getitem__, words_of(t)), dtype=np.int64) for t in texts]
    flat = np.concatenate(index) if index else np.zeros(0, dtype=np.int64)
    out = np.zeros((len(flat), len(model.labels)), dtype=np.float32)
    starts, lengths, at = [], [], 0
    for words in index:
        for begin in range(0, len(words), STRETCH):
            starts.append(at + begin)
            lengths.append(min(STRETCH, len(words) - begin))
        at += len(words)
    starts, lengths = np.array(starts, dtype=np.int64), np.array(lengths, dtype=np.int64)
    order = np.argsort(-lengths, kind="stable")
    for i in range(0, len(order), 1024):
        part = order[i : i + 1024]
        n = lengths[part]
        time = np.arange(n.max())
        inside = time[None, :] < n[:, None]
        places = (starts[part][:, None] + time[None, :])[inside]
        emissions = np.zeros((*inside.shape, len(model.labels)), dtype=np.float32)
        emissions[inside] = known.emissions()[flat[places]]
        marginal, _ = posteriors(emissions, n, model.transitions.astype(np.float32), model.start.astype(np.float32))
        out[places] = marginal[inside]
    bounds = np.cumsum([0, *map(len, index)])
    return [out[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def predict(spark: SparkSession, text: Column | str, model: Model) -> Column:
    """struct<lang, score, confidence, n_words, shares> of a text column.

    `lang` has the largest mean posterior over all words of the text, `score` is that mean, and `shares` the means of all
    languages, which show code-switching. `confidence` is the mean of each word's largest posterior: high for a text in several known languages too. A null text, one without letters and any text under a model without labels is `und`, with score 0.
    """
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang: string, score: double, confidence: double, n_words: bigint, shares: map<string, double>>")
    def compute(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        known = _Words(model)

        def summaries(texts: list[str | None]) -> Iterator[tuple]:
            for n, total, top in zip(*text_sums(texts, model, known), strict=True):
                if not n or not model.labels:
                    yield UNKNOWN, 0.0, 0.0, n, []
                    continue
                mean = total / n
                best = int(mean.argmax())
                yield model.labels[best], min(float(mean[best]), 1.0), min(float(top / n), 1.0), n, list(zip(model.labels, mean.tolist(), strict=True))

        for batch in batches:
            rows, pending, size = [], [], 0
            for value in batch:
                pending.append(value.as_py())
                size += len(pending[-1] or "")
                if size >= BATCH_WORDS * 5:
                    rows += summaries(pending)
                    pending, size = [], 0
            rows += summaries(pending)
            names = ("lang", "score", "confidence", "n_words", "shares")
            kinds = (pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.map_(pa.string(), pa.float64()))
            yield pa.StructArray.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names)

    return compute(text)
