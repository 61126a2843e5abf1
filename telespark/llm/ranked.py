"""Ranked lexical search with bit-sliced Bloom signatures: upper bounds of all documents' scores, exact scores of those not excluded."""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from telespark.llm.common import small_batches
from telespark.session import scratch_dir, write_and_read

TOP = 10
#: Bits of a signature for each of the most entries that its class may have, and bits that are set for an entry.
ENTRY_BITS, HASHES = 8, 4
#: Of a block: documents, bits, bytes of text.
BLOCK_DOCS, BLOCK_BITS, BLOCK_TEXT = 1024, 1 << 24, 4 << 20
#: Terms of the queries that are answered in one pass over the index; so much goes through the driver and to every task.
PASS_TERMS = 200_000
#: Words whose hashes a task remembers.
KNOWN_WORDS = 200_000
#: Bounds are sums of doubles; this share more than they are is certainly enough.
SLACK = 1e-9
_LEVEL = 0xD6E8FEB86659FD93
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: ASCII letters in lower case, digits and all bytes beyond ASCII stay; the rest parts terms.
_FOLD = bytes(c | 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLD).split()


class _Hashes(dict):
    """64-bit hashes of words, kept for the last ones met."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _levels(hashes: np.ndarray, level: int) -> np.ndarray:
    """Hashes of the entries `term occurs 2**level times or more`."""
    h = (hashes ^ np.uint64(level * _LEVEL % (1 << 64))) * _MIX
    return h ^ (h >> np.uint64(32))


def _slices_of(entries: np.ndarray, size: int) -> np.ndarray:
    """The HASHES slices (of `size`, a power of two) of each entry."""
    low, step = entries & np.uint64(0xFFFFFFFF), (entries >> np.uint64(32)) | np.uint64(1)
    return ((low[:, None] + step[:, None] * np.arange(HASHES, dtype=np.uint64)) & np.uint64(size - 1)).astype(np.int64)


_INDEX = "block string, ids array<bigint>, lengths array<bigint>, size int, slices binary, terms binary, counts binary, texts array<binary>"


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of documents with about equally many entries: a bitmap over the documents for each bit of their signatures, and the terms with the documents that have them."""
    hashes = _Hashes()
    waiting: dict[int, list] = {}
    held: Counter[int] = Counter()
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
            text = text.as_py()
            tf = Counter(terms_of(text))
            if not tf:
                continue
            terms = np.fromiter(map(hashes.__getitem__, tf), np.uint64, len(tf))
            times = np.fromiter(tf.values(), np.int64, len(tf))
            entries = int(np.frexp(times.astype(np.float64))[1].sum())  # a term has as many levels as its count has bits
            size = max(64, 1 << (entries * ENTRY_BITS - 1).bit_length())
            block = waiting.setdefault(size, [])
            block.append((doc_id, text, terms, times))
            held[size] += len(text)
            if len(block) >= min(BLOCK_DOCS, max(8, BLOCK_BITS // size)) or held[size] >= BLOCK_TEXT:
                yield _block(size, waiting.pop(size))
                held[size] = 0
    for size, block in waiting.items():
        yield _block(size, block)


def _block(size: int, rows: list) -> pa.RecordBatch:
    ids, texts, terms, times = zip(*rows)
    doc = np.repeat(np.arange(len(rows)), list(map(len, terms)))
    terms, times = np.concatenate(terms), np.concatenate(times)
    bits = np.zeros((size, -(-len(rows) // 8) * 8), dtype=bool)
    level, at = 0, np.arange(len(terms))
    while len(at):
        bits[_slices_of(_levels(terms[at], level), size), doc[at][:, None]] = True
        level += 1
        at = at[times[at] >= 1 << level]
    lengths = np.bincount(doc, weights=times).astype(np.int64)
    known, counts = np.unique(terms, return_counts=True)
    columns = [pa.array([uuid.uuid4().hex]), pa.array([ids], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int64())), pa.array([size], pa.int32())]
    columns += [pa.array([np.packbits(bits, axis=1).tobytes()]), pa.array([known.tobytes()]), pa.array([counts.astype(np.int32).tobytes()]), pa.array([texts], pa.list_(pa.binary()))]
    return pa.RecordBatch.from_arrays(columns, names=["block", "ids", "lengths", "size", "slices", "terms", "counts", "texts"])


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The index of all documents with terms, as a written table of blocks."""
    small_batches(docs.sparkSession)
    path = scratch_dir(docs.sparkSession, "ranked-index")
    made = docs.select(F.col(doc_id).cast("bigint"), F.col(text)).mapInArrow(_indexed, _INDEX)
    made.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(_INDEX).parquet(path)


def _counted(wanted: np.ndarray):
    """(term, documents) of the wanted terms (sorted hashes) in each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for terms, counts in zip(batch.column(0), batch.column(1)):
                known, counts = np.frombuffer(terms.as_buffer(), np.uint64), np.frombuffer(counts.as_buffer(), np.int32)
                at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
                hit = known[at] == wanted
                yield pa.RecordBatch.from_arrays([pa.array(wanted[hit].astype(np.int64)), pa.array(counts[at[hit]].astype(np.int64))], names=["term", "n"])

    return run


class Queries:
    """The items of one pass: their terms, hashes, weights and repeats, and the corpus's counts. Bounded by PASS_TERMS, unless one item has more."""

    def __init__(self, items: list[tuple[int, dict[bytes, int]]], documents: int, words: int) -> None:
        self.items, self.documents, self.words = items, documents, words
        self.terms = sorted({t for _, tf in items for t in tf})
        self.hashes = np.array([xxhash.xxh3_64_intdigest(t) for t in self.terms], dtype=np.uint64)

    def weigh(self, found: dict[int, int]) -> None:
        """`found`: documents by hash of a term."""
        ratio = lambda h: (2 * self.documents + 2) / (2 * found.get(int(h), 0) + 1)
        self.weights = [math.floor(1000 * math.log(ratio(h))) for h in self.hashes]
        at = {t: i for i, t in enumerate(self.terms)}
        self.places = [np.array([at[t] for t in tf]) for _, tf in self.items]
        self.shares = [np.array([n * self.weights[at[t]] for t, n in tf.items()], dtype=np.float64) for _, tf in self.items]
        self.exact = [[(t, n * self.weights[at[t]]) for t, n in tf.items()] for _, tf in self.items]

    def share(self, length: int) -> int:
        """The m of a document with so many terms."""
        return 25 + 75 * length * self.documents // self.words

    def score(self, item: int, tf: dict[bytes, int], m: int) -> int:
        return sum(w * (10**9 * tf[t] // (1000 * tf[t] + 8 * m)) for t, w in self.exact[item] if t in tf)

    def bounds(self, lengths: np.ndarray, size: int, slices: np.ndarray) -> np.ndarray:
        """No score of an item (row) for a document of the block (column) is higher.

        For each level the documents that may have a term 2**level times: the AND of the entry's slices. The weights of an item's
        terms are added over those, and times what a term of that level can add to the score of a document of that length.
        """
        n = len(lengths)
        m = np.array([self.share(int(x)) for x in lengths])
        out = np.zeros((len(self.items), n))
        live = np.arange(len(self.terms))
        there = None
        before, level = np.zeros(n, dtype=np.int64), 0
        while len(live):
            mine = np.bitwise_and.reduce(slices[_slices_of(_levels(self.hashes[live], level), size)], axis=1)
            there = mine if there is None else there & mine
            some = there.any(axis=1)
            live, there = live[some], there[some]
            most = np.minimum(2 ** (level + 1) - 1, lengths)
            gain = 10**9 * most // (1000 * most + 8 * m)
            row = np.full(len(self.terms), -1)
            row[live] = np.arange(len(live))
            present = np.unpackbits(there, axis=1, count=n).astype(np.float32)
            for i, (places, shares) in enumerate(zip(self.places, self.shares)):
                at = row[places]
                if (at >= 0).any():
                    out[i] += (shares[at >= 0] @ present[at[at >= 0]]) * (gain - before)
            before, level = gain, level + 1
            if level > 40 or (1 << level) > lengths.max():
                break
        return out * (1 + SLACK)


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(len(batch)):
            row = {name: batch.column(name)[i] for name in batch.schema.names}
            row["lengths"] = row["lengths"].values.to_numpy()
            if "slices" in row:
                size = row["size"].as_py()
                row["slices"], row["size"] = np.frombuffer(row["slices"].as_buffer(), np.uint8).reshape(size, -1), size
            yield row


def _best_bounds(queries: Queries, top: int):
    """(item, block, place, bound) of the documents with the highest bounds of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows_of(batches):
            bounds = queries.bounds(row["lengths"], row["size"], row["slices"])
            k = min(top, bounds.shape[1])
            place = np.argpartition(-bounds, k - 1, axis=1)[:, :k]
            value = np.take_along_axis(bounds, place, axis=1).ravel()
            item = np.repeat(np.arange(len(bounds)), k)
            some = value > 0
            columns = [pa.array(item[some]), pa.array([row["block"].as_py()] * int(some.sum()), pa.string()), pa.array(place.ravel()[some]), pa.array(value[some])]
            yield pa.RecordBatch.from_arrays(columns, names=["item", "block", "place", "bound"])

    return run


def _scored(queries: Queries, chosen: dict[str, list] | None, least: np.ndarray | None, top: int):
    """(item, doc_id, score) of the chosen (item, place) of each block, or of all whose bound reaches the item's least score; of a block the `top` best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows_of(batches):
            if chosen is None:
                bounds = queries.bounds(row["lengths"], row["size"], row["slices"])
                pairs = np.argwhere((bounds >= least[:, None]) & (bounds > 0)).tolist()
            else:
                pairs = chosen.get(row["block"].as_py(), [])
            wanted: dict[int, list[int]] = {}
            for item, place in pairs:
                wanted.setdefault(place, []).append(item)
            found: dict[int, list] = {}
            for place, items in wanted.items():
                tf, m = Counter(terms_of(row["texts"][place].as_py())), queries.share(int(row["lengths"][place]))
                for item in items:
                    score = queries.score(item, tf, m)
                    if score > 0:
                        found.setdefault(item, []).append((-score, row["ids"][place].as_py()))
            missing = 1 << 64  # a null id comes after all others
            rows = [(item, i, -s) for item, x in found.items() for s, i in sorted(x, key=lambda y: (y[0], missing if y[1] is None else y[1]))[:top]]
            columns = list(zip(*rows)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["item", "doc_id", "score"])

    return run


def search(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", top: int = TOP, pass_terms: int = PASS_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the `top` highest-scoring documents of each item, scores above 0 only, ties by doc_id.

    Terms, weights and scores are those of the query's contract, in integers. The index holds every document; the driver gets the terms of the
    items of a pass, their document counts and a score for each item. That is the `top`-th exact score among the documents with the highest bounds; no other document can
    reach it with a lower bound, so all documents whose bound reaches it are scored exactly. Null texts, and texts and items without terms, take no part; every row of `items`
    is an item and every row of `docs` a document, whatever ids repeat; a null doc_id comes last among ties.
    """
    spark = docs.sparkSession
    index = build_index(docs, doc_id, text)
    total = index.agg(F.sum(F.size("lengths")), F.sum(F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, b: a + b))).first()
    asked = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")).withColumn("key", F.monotonically_increasing_id())
    asked = write_and_read(asked, "ranked-items")  # keys are settled
    passes = 1 + (asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // (8 * pass_terms)
    results = [_pass(index, asked.where(F.pmod(F.xxhash64("key"), F.lit(passes)) == i), total, top) for i in range(passes)] if total[0] else []
    results = [r for r in results if r is not None]
    if not results:
        return asked.limit(0).select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("bigint").alias("doc_id"), F.lit(0).cast("bigint").alias("score"))
    found = results[0]
    for r in results[1:]:
        found = found.union(r)
    order = Window.partitionBy("key").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(asked.select("key", "item_id"), "key").select("item_id", "rank", "doc_id", "score")


def _pass(index: DataFrame, asked: DataFrame, total, top: int) -> DataFrame | None:
    """(key, doc_id, score) of the items of one pass: of each block, the best of the documents that its bounds do not exclude."""
    spark = index.sparkSession
    items = [(r["key"], dict(Counter(terms_of((r["text"] or "").encode())))) for r in asked.select("key", "text").collect()]
    items = [x for x in items if x[1]]
    if not items:
        return None
    queries = Queries(items, total[0], total[1])
    counted = index.select("terms", "counts").mapInArrow(_counted(np.sort(queries.hashes)), "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    queries.weigh({r["term"] & (1 << 64) - 1: r["n"] for r in counted.collect()})
    bounds = index.select("block", "lengths", "size", "slices").mapInArrow(_best_bounds(queries, top), "item bigint, block string, place bigint, bound double")
    order = Window.partitionBy("item").orderBy(F.desc("bound"), "block", "place")
    chosen: dict[str, list] = {}
    for r in bounds.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).collect():
        chosen.setdefault(r["block"], []).append((r["item"], r["place"]))
    kinds = "item bigint, doc_id bigint, score bigint"
    some = index.where(F.col("block").isin(list(chosen))).select("block", "ids", "lengths", "texts").mapInArrow(_scored(queries, chosen, None, top), kinds)
    least = np.ones(len(items))
    for r in some.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("low")).collect():
        if r["n"] >= top:
            least[r["item"]] = r["low"]
    found = index.select("block", "ids", "lengths", "size", "slices", "texts").mapInArrow(_scored(queries, None, least, top), kinds)
    keys = spark.createDataFrame([(i, k) for i, (k, _) in enumerate(items)], "item bigint, key bigint")
    return found.join(F.broadcast(keys), "item").select("key", "doc_id", "score")
