"""Exact substring deduplication with suffix arrays of shards.

Every string of LENGTH bytes has a mark, the least hash among its stretches of MARK bytes. Neighbouring strings share marks, so that a text falls
into pieces of one mark each, which overlap by LENGTH - 1 bytes. All places of a string have the same mark; pieces are dealt to shards by
mark, and no match crosses shards. Marks that only one document has are left out first, and in each shard the strings whose longer marks
only one document has. Each shard sorts the suffixes of the others by induction, computes permuted common prefixes, and answers for each string the smallest document that has it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telespark.llm.common import small_batches
from telespark.llm.suffixes import permuted_prefixes, suffix_array, words_at
from telespark.session import scratch_dir, shuffles_removed

LENGTH = 50
MARK = 16
#: Marks that so many bundles hold are common phrases in ever new surroundings: their strings are dealt by longer marks instead.
CROWDED, LONG_MARK = 256, 40
#: Bytes of text that are handled together, and of text for each shard.
BUNDLE = 3 << 20
SHARD = 4 << 20
#: Strings whose marks are computed together.
BLOCK = 1 << 15
_MIX = np.uint64(0x9E3779B97F4A7C15)
_TURN = np.uint64(0xC2B2AE3D27D4EB4F)
_ONE = np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


def _stretches(words: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the `length` bytes (8 or more) from each place."""
    n = max(0, len(words) - length + 1)
    h = words[:n] * _MIX
    more = np.empty_like(h)
    for at in [*range(8, length - 7, 8), *([length - 8] if length % 8 else [])]:
        # In place: fresh memory costs more than the arithmetic.
        np.right_shift(h, np.uint64(31), out=more)
        np.bitwise_xor(h, more, out=h)
        np.multiply(words[at : at + n], _TURN, out=more)
        np.add(h, more, out=h)
        np.multiply(h, _MIX, out=h)
    np.right_shift(h, np.uint64(32), out=more)
    return np.bitwise_xor(h, more, out=h)


def _least(values: np.ndarray, n: int) -> np.ndarray:
    """The least of each n neighbours."""
    if len(values) < n:
        return values[:0]
    size = 1
    while size < n:
        step = min(size, n - size)
        values = np.minimum(values[: len(values) - step], values[step:])
        size += step
    return values


def _marks(text: np.ndarray, length: int) -> np.ndarray:
    """The mark of each string of the text: the least hash among its stretches of `length` bytes. In blocks that a CPU's cache holds."""
    marks = np.empty(max(0, len(text) - LENGTH + 1), dtype=np.uint64)
    for at in range(0, len(marks), BLOCK):
        words = words_at(text[at : at + BLOCK + LENGTH - 1])
        marks[at : at + BLOCK] = _least(_stretches(words, length), LENGTH - length + 1)
    return marks


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, start + 1, … of each row, in one array."""
    begins = np.cumsum(sizes) - sizes
    return np.repeat(starts - begins, sizes) + np.arange(int(sizes.sum()))


class _Bundle:
    """Some documents' bytes, the marks of their strings, and the runs of neighbouring strings with one mark."""

    def __init__(self, data: bytes, ends: np.ndarray, known: np.ndarray) -> None:
        """`known`: the documents that have an id; strings of the others count nowhere."""
        self.text = np.frombuffer(data, dtype=np.uint8)
        least = _marks(self.text, MARK)
        # A run ends where the mark changes, where a document begins, and behind the last string of a document.
        first = np.zeros(len(least) + 1, dtype=bool)
        np.not_equal(least[1:], least[:-1], out=first[1 : len(least)])
        first[0] = True
        behind = ends - LENGTH + 1
        for border in (ends, behind):
            first[border[(border >= 0) & (border < len(first))]] = True
        first[-1] = True
        borders = np.flatnonzero(first)
        begins, counts = borders[:-1], np.diff(borders)
        docs = np.searchsorted(ends, begins, side="right")
        inside = (begins < behind[docs]) & known[docs] if len(begins) else np.zeros(0, dtype=bool)
        self.begins, self.counts, self.run_docs = begins[inside], counts[inside], docs[inside]
        self.run_marks = _mixed(least[self.begins])
        self.unique, self.of_run = np.unique(self.run_marks, return_inverse=True)

    def several(self) -> np.ndarray:
        """Which unique marks more than one document has."""
        low = np.full(len(self.unique), np.iinfo(np.int64).max)
        high = np.full(len(self.unique), -1)
        np.minimum.at(low, self.of_run, self.run_docs)
        np.maximum.at(high, self.of_run, self.run_docs)
        return low < high

    def pieces(self, states: np.ndarray) -> None:
        """Keeps the runs of marks with a state: 1 by their mark, 2 by the longer marks of their strings. A piece is LENGTH - 1 bytes longer than its count.

        Equal pieces of a bundle are one: of at most 2 * LENGTH bytes, they have equal first and last LENGTH bytes.
        """
        of_run = states[self.of_run]
        kept = np.flatnonzero(of_run)
        starts, counts, docs, marks, of_run = self.begins[kept], self.counts[kept], self.run_docs[kept], self.run_marks[kept], of_run[kept]
        places = _ragged(starts, counts)
        first = np.zeros(len(places), dtype=bool)
        first[np.cumsum(counts) - counts] = True
        if (of_run == 2).any():
            longer = _mixed(_marks(self.text, LONG_MARK)[places])
            of_string = np.where(np.repeat(of_run == 2, counts), longer, np.repeat(marks, counts))
            first[1:] |= of_string[1:] != of_string[:-1]
            begins = np.flatnonzero(first)
            marks, docs = of_string[begins], np.repeat(docs, counts)[begins]
        else:
            begins = np.flatnonzero(first)
        # A mark that recurs at once, as in repeated lines, would make a piece of any length.
        counts = np.diff(np.append(begins, len(places)))
        many = -(-counts // LENGTH)
        within = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        self.starts = np.repeat(places[begins], many) + LENGTH * within
        self.counts = np.minimum(np.repeat(counts, many) - LENGTH * within, LENGTH)
        self.run_docs, self.run_marks = np.repeat(docs, many), np.repeat(marks, many)


def _identity(words: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A hash of each piece."""
    h = counts.astype(np.uint64) * _TURN
    for begin in (starts, starts + counts - 1):
        for at in [*range(0, LENGTH - 7, 8), LENGTH - 8]:
            h = _mixed(h ^ (words[begin + at] * _TURN))
    return h


def _shard_of(marks: np.ndarray, shards: int) -> np.ndarray:
    """Shards are ranges of marks."""
    return ((marks >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)


def _bundled(shards: int, size: int):
    """Rows (id, text) to rows of a bundle: its documents, bytes and, by shard, 31 bits of each mark with a bit for those of several documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, held = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                ids.append(doc_id)
                texts.append(text.as_py() or b"")
                held += len(texts[-1])
                if held >= size:
                    yield one(ids, texts)
                    ids, texts, held = [], [], 0
        if ids:
            yield one(ids, texts)

    def one(ids: list, texts: list[bytes]) -> pa.RecordBatch:
        data, ends = b"".join(texts), np.cumsum(list(map(len, texts)))
        bundle = _Bundle(data, ends, np.array([i is not None for i in ids]))
        codes = ((bundle.unique & np.uint64(0xFFFFFFFF)).astype(np.uint32) & np.uint32(0xFFFFFFFE)) | bundle.several()
        shard = _shard_of(bundle.unique, shards)
        found, begins = np.unique(shard, return_index=True)
        blobs = [codes[a:b].tobytes() for a, b in zip(begins, np.append(begins[1:], len(codes)))]
        name = uuid.uuid4().int >> 65
        columns = [pa.array([name], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([ends.astype(np.int64)], pa.list_(pa.int64()))]
        columns += [pa.array([data], pa.binary()), pa.array([found.astype(np.int64)], pa.list_(pa.int64())), pa.array([blobs], pa.list_(pa.binary()))]
        return pa.RecordBatch.from_arrays(columns, names=["bundle", "ids", "ends", "data", "shards", "codes"])

    return run


def _judged(crowded: int):
    """Of one shard: for each bundle the states of its marks, where any has one."""

    def run(table: pa.Table) -> pa.Table:
        blobs = [np.frombuffer(b.as_buffer(), dtype=np.uint32) for b in table["codes"]]
        sizes = np.array(list(map(len, blobs)))
        codes = np.concatenate(blobs)
        order = np.argsort(codes >> np.uint32(1), kind="stable")
        ordered = codes[order]
        begins = np.flatnonzero(np.append(True, (ordered[1:] >> np.uint32(1)) != (ordered[:-1] >> np.uint32(1))))
        held = np.diff(np.append(begins, len(ordered)))
        several = np.maximum.reduceat(ordered & np.uint32(1), begins) > 0
        state = np.where(held >= crowded, 2, ((held > 1) | several).astype(np.int64)).astype(np.uint8)
        states = np.empty(len(codes), dtype=np.uint8)
        states[order] = np.repeat(state, held)
        ends = np.cumsum(sizes)
        rows = [i for i, (a, b) in enumerate(zip(ends - sizes, ends)) if states[a:b].any()]
        out = [states[ends[i] - sizes[i] : ends[i]].tobytes() for i in rows]
        return pa.table({"bundle": table["bundle"].take(pa.array(rows, pa.int64())), "shard": table["shard"].take(pa.array(rows, pa.int64())), "states": pa.array(out, pa.binary())})

    return run


def _cut_up(shards: int):
    """Bundles with their marks' states to pieces by shard; a row with shard -1 says which piece stands where."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                name, ids, ends, data, judged = (batch.column(i)[row] for i in range(5))
                ids = ids.as_py()
                bundle = _Bundle(data.as_buffer(), np.array(ends.as_py()), np.array([i is not None for i in ids]))
                shard = _shard_of(bundle.unique, shards)
                states = np.zeros(len(bundle.unique), dtype=np.uint8)
                for x in judged.as_py():
                    a, b = np.searchsorted(shard, [x["shard"], x["shard"] + 1])
                    states[a:b] = np.frombuffer(x["states"], dtype=np.uint8)
                bundle.pieces(states)
                yield pieces_of(name.as_py(), np.array([0 if i is None else i for i in ids]), bundle)

    def pieces_of(name: int, ids: np.ndarray, bundle: _Bundle) -> pa.RecordBatch:
        shard = _shard_of(bundle.run_marks, shards).astype(np.int64)
        identity = _identity(words_at(bundle.text), bundle.starts, bundle.counts)
        order = np.lexsort((identity, shard))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (identity[order][1:] != identity[order][:-1]) | (shard[order][1:] != shard[order][:-1])
        piece = np.empty(len(order), dtype=np.int32)
        piece[order] = np.cumsum(new) - 1
        begins = np.flatnonzero(new)
        some = order[begins]
        first = np.minimum.reduceat(ids[bundle.run_docs[order]], begins) if len(begins) else begins
        counts, starts = bundle.counts[some], bundle.starts[some]
        gaps = _packed(np.diff(bundle.starts, prepend=0).astype(np.int64))
        rows = [(-1, bundle.counts.astype(np.uint8).tobytes(), gaps, piece.tobytes())]
        found, begins = np.unique(shard[some], return_index=True)
        for s, a, b in zip(found, begins, np.append(begins[1:], len(some))):
            text = bundle.text[_ragged(starts[a:b], counts[a:b] + LENGTH - 1)]
            rows.append((int(s), counts[a:b].astype(np.uint8).tobytes(), _packed(first[a:b].astype(np.int64)), _packed(text)))
        shard_, counts_, numbers, data = zip(*rows)
        columns = [pa.array([name] * len(rows), pa.int64()), pa.array(shard_, pa.int64()), pa.array(counts_, pa.binary()), pa.array(numbers, pa.binary()), pa.array(data, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["bundle", "shard", "counts", "numbers", "data"])

    return run


def _packed(values: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(values).data, "zstd", asbytes=True)


def _unpacked(data, size: int, kind) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, int(size) * np.dtype(kind).itemsize, "zstd"), dtype=kind)


def _sorted_shard(table: pa.Table) -> pa.Table:
    """Of one shard: for each bundle a bit for each string of its pieces, whether a document has it that is smaller than the piece's first in the bundle."""
    parts = [np.frombuffer(b.as_buffer(), dtype=np.uint8) for b in table["counts"]]
    ends = np.cumsum(list(map(len, parts)))
    begins = np.append(0, ends[:-1])
    counts = np.concatenate(parts).astype(np.int64)
    sums = np.add.reduceat(counts + LENGTH - 1, begins)  # no bundle's part is empty
    first = np.concatenate([_unpacked(b.as_buffer(), len(p), np.int64) for b, p in zip(table["numbers"], parts)])
    ids, first = np.unique(first, return_inverse=True)
    first = first.astype(np.int32)  # ranks of documents from here on
    data = np.concatenate([_unpacked(b.as_buffer(), n, np.uint8) for b, n in zip(table["data"], sums)])
    _, some, which = np.unique(_identity(words_at(data), _begins(counts), counts), return_index=True, return_inverse=True)
    lowest = np.full(len(some), len(ids), dtype=np.int32)
    np.minimum.at(lowest, which, first)
    # The shard's different pieces, one after the other. Strings across their borders are no one's.
    own = counts[some]
    text = data[_ragged(_begins(counts)[some], own + LENGTH - 1)]
    del data
    best, offsets = np.repeat(lowest, own), np.cumsum(own) - own
    rows, first_kept, kept = _shared(text, own, lowest)
    if len(rows):
        text = text[_ragged(_begins(own)[rows] + first_kept, kept + LENGTH - 1)]
        places = _ragged(_begins(kept), kept)
        docs = np.full(len(text), len(ids), dtype=np.int32)
        docs[places] = np.repeat(lowest[rows], kept)
        sa = suffix_array(text)
        groups = np.flatnonzero(permuted_prefixes(text, sa)[sa] < LENGTH)  # of equal strings
        docs[sa] = np.repeat(np.minimum.reduceat(docs[sa], groups), np.diff(np.append(groups, len(sa))))
        best[_ragged(offsets[rows] + first_kept, kept)] = docs[places]
    out = []
    for a, b in zip(begins, ends):
        mine = which[a:b]
        earlier = best[_ragged(offsets[mine], counts[a:b])] < np.repeat(first[a:b], counts[a:b])
        out.append(np.packbits(earlier).tobytes())
    nothing = pa.nulls(len(out), pa.binary())
    return pa.table({"bundle": table["bundle"], "shard": table["shard"], "counts": table["counts"], "numbers": nothing, "data": pa.array(out, pa.binary())})


def _shared(text: np.ndarray, own: np.ndarray, lowest: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, first, n) of the pieces of which some strings may also be in a piece of another document, with the stretch of strings from the first to the last such.

    Told by the longer marks of the strings, which equal strings share: where all pieces with a mark have one smallest document, sorting would find no other.
    """
    marks = _marks(text, LONG_MARK)[_ragged(_begins(own), own)]
    ends = np.cumsum(own)
    new = np.append(True, marks[1:] != marks[:-1])
    new[ends[:-1]] = True
    begins = np.flatnonzero(new)  # of runs of neighbouring strings with one mark
    sizes, marks = np.diff(np.append(begins, len(marks))), marks[begins]
    piece = np.searchsorted(ends, begins, side="right")
    order = np.argsort(marks)
    groups = np.flatnonzero(np.append(True, marks[order][1:] != marks[order][:-1]))
    docs = lowest[piece[order]]
    several = np.minimum.reduceat(docs, groups) < np.maximum.reduceat(docs, groups)
    shared = np.empty(len(order), dtype=bool)
    shared[order] = np.repeat(several, np.diff(np.append(groups, len(order))))
    runs = np.flatnonzero(shared)
    rows, at = np.unique(piece[runs], return_index=True)
    last = runs[np.append(at[1:], len(runs)) - 1] if len(rows) else runs
    first = begins[runs[at]] - (ends - own)[rows]
    return rows, first, begins[last] + sizes[last] - (ends - own)[rows] - first


def _begins(counts: np.ndarray) -> np.ndarray:
    """Where pieces of so many strings begin, one after the other."""
    return np.cumsum(counts + LENGTH - 1) - (counts + LENGTH - 1)


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document of a bundle: the bytes that stay and the spans of those that go."""
    kinds = (pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary())
    for batch in batches:
        for row in range(len(batch)):
            ids, ends, data, answers = (batch.column(i)[row] for i in range(4))
            ids, ends, text = ids.as_py(), np.array(ends.as_py()), np.frombuffer(data.as_buffer(), dtype=np.uint8)
            gone = np.zeros(len(text) + 1, dtype=bool)
            answers = sorted(answers.as_py() or [], key=lambda x: x["shard"])
            if len(answers) > 1:
                numbers = np.array([np.iinfo(np.int64).min if i is None else i for i in ids])
                _mark(gone, ends, numbers, answers)
            border = np.zeros(len(gone), dtype=bool)
            border[np.append(0, ends)] = True
            begins = np.flatnonzero(gone & (border | ~np.append(False, gone[:-1])))
            stops = np.flatnonzero(gone[:-1] & (border[1:] | ~gone[1:])) + 1
            first, out = 0, [[], [], [], []]
            for i, end in enumerate(ends):
                a, b = np.searchsorted(begins, [first, end])
                spans = np.stack([begins[a:b], stops[a:b]], axis=1) - first
                kept = text[first:end][~gone[first:end]].tobytes() if b > a else text[first:end].tobytes()
                for column, value in zip(out, (ids[i], int(end - first), [{"start": int(x), "end": int(y)} for x, y in spans], kept)):
                    column.append(value)
                first = end
                if len(out[0]) == 500:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["doc_id", "n_bytes", "spans", "kept"])
                    out = [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["doc_id", "n_bytes", "spans", "kept"])


def _mark(gone: np.ndarray, ends: np.ndarray, ids: np.ndarray, answers: list[dict]) -> None:
    """Sets the bytes to go: of strings that an earlier document has, in this bundle or another."""
    stands, *answers = answers
    counts = np.frombuffer(stands["counts"], dtype=np.uint8).astype(np.int64)
    starts = np.cumsum(_unpacked(stands["numbers"], len(counts), np.int64))
    piece = np.frombuffer(stands["data"], dtype=np.int32)
    owner = ids[np.searchsorted(ends, starts, side="right")]
    per_piece = np.concatenate([np.frombuffer(x["counts"], dtype=np.uint8) for x in answers]).astype(np.int64)
    first = np.full(len(per_piece), np.iinfo(np.int64).max)
    np.minimum.at(first, piece, owner)
    sizes = [int(np.frombuffer(x["counts"], dtype=np.uint8).sum(dtype=np.int64)) for x in answers]
    earlier = np.concatenate([np.unpackbits(np.frombuffer(x["data"], dtype=np.uint8), count=n) for x, n in zip(answers, sizes)]).astype(bool)
    later = earlier[_ragged((np.cumsum(per_piece) - per_piece)[piece], counts)] | np.repeat(owner > first[piece], counts)
    steps = np.zeros(len(gone) + LENGTH, dtype=np.int32)
    places = _ragged(starts, counts)[later]
    steps[places] += 1  # a place is a string's start once
    np.subtract.at(steps, places + LENGTH, 1)
    gone[:] = np.cumsum(steps)[: len(gone)] > 0


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", crowded: int = CROWDED, bundle: int = BUNDLE, shard: int = SHARD) -> DataFrame:
    """(doc_id, n_bytes, spans, kept) for each row: `kept` are the bytes of UTF-8 left after those in `spans` (start, end; maximal) went.

    A byte goes if a string of LENGTH bytes around it also starts in a document with a smaller id, judged on the input. Null and empty texts have no bytes and stay.
    A row with a null id neither loses bytes nor makes others lose any; repeated rows of one id are one document, each with its result.

    Texts are written once, in bundles that later steps join by name without dealing them out again; what is dealt are marks (four bytes each),
    pieces that may repeat, once a bundle, and answers. A shard holds different pieces only, so a passage that a third of all documents hold is there once. Exact but for equal hashes of 64
    bits; equal marks of 31 bits only let a piece through to its shard, which decides.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = max(least, -(-total // shard))
    made = texts.mapInArrow(_bundled(shards, bundle), "bundle bigint, ids array<bigint>, ends array<bigint>, data binary, shards array<bigint>, codes array<binary>")
    table = _bucketed(made, "bundle", shards)
    codes = table.select("bundle", F.explode(F.arrays_zip("shards", "codes")).alias("x")).select("bundle", F.col("x.shards").alias("shard"), F.col("x.codes").alias("codes"))
    judged = codes.groupBy("shard").applyInArrow(_judged(crowded), "bundle bigint, shard bigint, states binary")
    states = judged.groupBy("bundle").agg(F.collect_list(F.struct("shard", "states")).alias("judged"))
    bundles = table.select("bundle", "ids", "ends", "data")
    kinds = "bundle bigint, shard bigint, counts binary, numbers binary, data binary"
    path = scratch_dir(spark, "suffix-pieces")
    with shuffles_removed(spark):  # the marks' shuffle files go with the writing
        bundles.join(states.hint("shuffle_hash"), "bundle").mapInArrow(_cut_up(shards), kinds).write.option("compression", "zstd").parquet(path)
    pieces = spark.read.schema(kinds).parquet(path)
    best = pieces.where("shard >= 0").groupBy("shard").applyInArrow(_sorted_shard, kinds)
    answers = pieces.where("shard < 0").union(best).groupBy("bundle").agg(F.collect_list(F.struct("shard", "counts", "numbers", "data")).alias("answers"))
    both = bundles.join(answers.hint("shuffle_hash"), "bundle", "left").select("ids", "ends", "data", "answers")
    return both.mapInArrow(_kept, "doc_id bigint, n_bytes bigint, spans array<struct<start: bigint, end: bigint>>, kept binary")


def _bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """The same rows from a written table that joins by `key` need not deal out again. The catalog only hands the table over: its name is gone on return."""
    spark = df.sparkSession
    name = f"bundles_{uuid.uuid4().hex}"
    df.write.option("path", scratch_dir(spark, name)).option("compression", "zstd").bucketBy(buckets, key).saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return table
