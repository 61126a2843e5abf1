"""Byte-level BPE: merges replayed over blocks of words through an inverted index, and decoding."""

from __future__ import annotations

import base64
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterator
from functools import cache
from heapq import heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from telespark.llm.common import small_batches

KNOWN_WORDS = 100_000
KNOWN_PAIRS = 200_000
BLOCK_BYTES = 2 << 20
FEW = 24


class Merges:
    """A vocabulary of byte strings by rank, and the replay of its merges over many words at once."""

    def __init__(self, tokens: list[bytes | None]):
        self.tokens = tokens
        self.ranks = {t: i for i, t in enumerate(tokens) if t is not None}
        missing = [b for b in range(256) if bytes([b]) not in self.ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks single bytes: {missing}")
        self.byte_rank = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self._merged: dict[int, int | None] = {}
        #: Ranks that can meet a neighbour with which they make a token of lower rank.
        self.early = {part for token, rank in self.ranks.items() for i in range(1, len(token)) for part in (self.ranks.get(token[:i]), self.ranks.get(token[i:])) if part is not None and part > rank}

    def replay(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word.

        All words lie in one row of symbols. The index holds, by the rank that a pair merges into, the positions of its
        left symbols. Ranks are taken lowest first and their positions left to right; a merge looks at its two neighbours
        alone and files the pairs that it makes. Should such a pair have a lower rank, the rest of the current positions
        wait for it, as they would in a word-by-word encoder.
        """
        whole = list(map(self.ranks.get, words))
        text = b"".join(w if r is None else b"" for w, r in zip(words, whole, strict=True))
        sizes = np.array([0 if r is not None else len(w) for w, r in zip(words, whole, strict=True)], dtype=np.int64)
        # A symbol below 0 ends each word, so that no pair reaches into the next one.
        base = np.full(len(text) + len(words) + 1, -1, dtype=np.int32)
        base[np.arange(len(text)) + np.repeat(np.arange(len(words)), sizes) + 1] = self.byte_rank[np.frombuffer(text, dtype=np.uint8)]
        self._start(base)
        while self._heap:
            rank = heappop(self._heap)
            parts = self._index.pop(rank)
            if len(parts) > 1 or isinstance(parts[0], np.ndarray):
                chunks, singles = [c for c in parts if isinstance(c, np.ndarray)], [c for c in parts if not isinstance(c, np.ndarray)]
                positions = np.unique(np.concatenate([*chunks, np.array(singles, dtype=np.int32)]))
                if len(positions) >= FEW and rank not in self.early and self._merge_all(rank, positions):
                    continue
                parts = positions.tolist()
            self._merge_each(rank, parts)
        # What merging left over, word after word.
        row = self._symbols
        kept = row >= 0
        counts = np.bincount((np.cumsum(row == -1) - 1)[kept], minlength=len(words))
        ends, ids = np.cumsum(counts), row[kept]
        return [np.array([r], dtype=np.int32) if r is not None else ids[e - c : e] for r, c, e in zip(whole, counts.tolist(), ends.tolist(), strict=False)]

    def _start(self, base: np.ndarray) -> None:
        """The row, and the index of its pairs of single bytes. Each array is seen by numpy and, one item at a time, by Python."""
        n = len(base)
        self._symbol, self._after, self._before, self._rank = (array("i", bytes(4 * (n + 1))) for _ in range(4))
        self._symbols, self._afters, self._befores, self._pair_ranks = (np.frombuffer(x, dtype=np.int32)[:n] for x in (self._symbol, self._after, self._before, self._rank))
        self._symbols[:] = base
        self._afters[:] = np.arange(1, n + 1)
        self._befores[:] = np.arange(-1, n - 1)
        self._pair_ranks[:] = -1
        self._index: dict[int, list] = {}
        self._heap: list[int] = []
        inner = np.flatnonzero((base[:-1] >= 0) & (base[1:] >= 0)).astype(np.int32)
        self._file(inner, base[inner].astype(np.int64) << 32 | base[inner + 1])

    def _file(self, positions: np.ndarray, keys: np.ndarray) -> None:
        """Files the pairs that begin at `positions`; `keys` are their two symbols in one number."""
        order = np.argsort(keys, kind="stable")
        keys, positions = keys[order], positions[order]
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
        ends = [*starts[1:].tolist(), len(keys)]
        for key, start, end in zip(keys[starts].tolist(), starts.tolist(), ends, strict=False):
            rank = self._merged[key] if key in self._merged else self._for_pair(key)
            if rank is None:
                continue
            part = positions[start:end]
            self._pair_ranks[part] = rank
            if rank not in self._index:
                self._index[rank] = []
                heappush(self._heap, rank)
            self._index[rank].append(part) if end - start > 1 else self._index[rank].append(int(part[0]))

    def _merge_all(self, rank: int, positions: np.ndarray) -> bool:
        """Merges at all positions at once; False, with nothing done, where two of them overlap."""
        symbols, afters, befores = self._symbols, self._afters, self._befores
        positions = positions[self._pair_ranks[positions] == rank]  # an earlier merge took one of the two elsewhere
        gone = afters[positions]
        if (self._pair_ranks[gone] == rank).any():
            return False
        symbols[positions], symbols[gone] = rank, -2
        self._pair_ranks[positions] = self._pair_ranks[gone] = -1
        following = afters[gone]
        afters[positions] = following
        befores[following] = positions
        other = symbols[following]
        inner = other >= 0
        preceding = befores[positions]
        first = symbols[preceding]
        lead = (first >= 0) & (first != rank)  # two merged neighbours are filed once, from the left
        self._pair_ranks[preceding[first >= 0]] = -1
        keys = np.concatenate([np.int64(rank) << 32 | other[inner].astype(np.int64), first[lead].astype(np.int64) << 32 | rank])
        twins = (first == rank) & (first >= 0)
        keys = np.concatenate([keys, first[twins].astype(np.int64) << 32 | rank])
        self._file(np.concatenate([positions[inner], preceding[lead], preceding[twins]]), keys)
        return True

    def _merge_each(self, rank: int, positions: list[int]) -> None:
        """Merges from left to right; where that makes a pair of lower rank, the rest of the positions waits."""
        symbol, after, before, rank_at = self._symbol, self._after, self._before, self._rank
        merged, index = self._merged, self._index
        for i, p in enumerate(positions):
            if rank_at[p] != rank:
                continue  # an earlier merge took one of the two
            q = after[p]
            n = after[q]
            b = before[p]
            symbol[p], symbol[q], rank_at[p], rank_at[q] = rank, -2, -1, -1
            after[p] = n
            before[n] = p
            lowest = rank
            first, other = symbol[b], symbol[n]
            for at, key in ((p, rank << 32 | other if other >= 0 else -1), (b, first << 32 | rank if first >= 0 else -1)):
                if key < 0:
                    continue
                new = merged[key] if key in merged else self._for_pair(key)
                if new is None:
                    rank_at[at] = -1
                    continue
                rank_at[at] = new
                if new in index:
                    index[new].append(at)
                else:
                    index[new] = [at]
                    heappush(self._heap, new)
                if new < lowest:
                    lowest = new
            if lowest < rank and i + 1 < len(positions):
                if rank not in index:
                    index[rank] = []
                    heappush(self._heap, rank)
                index[rank].extend(positions[i + 1 :])
                return

    def _for_pair(self, key: int) -> int | None:
        if len(self._merged) > KNOWN_PAIRS:
            self._merged.clear()
        rank = self._merged[key] = self.ranks.get(self.tokens[key >> 32] + self.tokens[key & 0xFFFFFFFF])
        return rank


def read_ranks(path: str) -> list[bytes | None]:
    """Tokens by rank from a file of base64 tokens and ranks, one pair a line; None where a rank is unused."""
    with open(path, "rb") as lines:
        pairs = [(int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, lines)]
    tokens: list[bytes | None] = [None] * (max((r for r, _ in pairs), default=-1) + 1)
    for rank, token in pairs:
        tokens[rank] = token
    return tokens


@cache
def _class(kind: str, last: int) -> str:
    """The characters up to `last` of a general category, or white space, as the inside of a character class."""
    space = {*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000}
    inside = space.__contains__ if kind == "s" else lambda c: unicodedata.category(chr(c))[0] == kind
    out, start = [], None
    for c in range(last + 2):
        here = c <= last and inside(c)
        if here and start is None:
            start = c
        elif not here and start is not None:
            out.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return "".join(out)


def splitter(pattern: str):
    """A function that gives all matches of a tokenizer's pattern, which may name the categories L and N and white space.

    These are spelled out for Python's own expressions, whose white space has other members; for texts in Latin-1 alone
    in a shorter, faster form.
    """

    def spelled(last: int):
        parts = re.split(r"(\[[^\]]*\])", pattern)
        for i, part in enumerate(parts):
            for name, kind in ((r"\p{L}", "L"), (r"\p{N}", "N"), (r"\s", "s")):
                part = part.replace(name, _class(kind, last) if i % 2 else f"[{_class(kind, last)}]")
            parts[i] = part.replace(r"\S", f"[^{_class('s', last)}]")
        return re.compile("".join(parts)).findall

    narrow, wide = spelled(0xFF), None

    def split(text: str) -> list[str]:
        nonlocal wide
        if text.isascii() or max(text) <= "\xff":
            return narrow(text)
        wide = wide or spelled(sys.maxunicode)
        return wide(text)

    return split


def encode(spark: SparkSession, text: Column | str, ranks_path: str, pattern: str) -> Column:
    """array<int> of ids for a text column; a null text encodes as the empty one, with no ids.

    Each match of `pattern` is encoded separately, without special tokens. The corpus is replayed in blocks: the words of
    some MB of text that a task has not met yet go through Merges.replay together. A task remembers the ids of the first
    KNOWN_WORDS different words. Nothing is shuffled, and no text is cut, however long. The vocabulary is read
    once, on the driver, and broadcast: its size is the file's.
    """
    small_batches(spark)
    shared = spark.sparkContext.broadcast(read_ranks(ranks_path))

    @F.arrow_udf("array<int>")
    def compute(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        merges = Merges(shared.value)
        split = splitter(pattern)
        known: dict[str, bytes] = {}
        for batch in batches:
            offsets, values = [0], bytearray()
            pending: list[list[str]] = []
            size = 0

            def flush() -> None:
                fresh = list({w for words in pending for w in words}.difference(known))
                new = dict(zip(fresh, (ids.tobytes() for ids in merges.replay([w.encode() for w in fresh])), strict=True))
                room = KNOWN_WORDS - len(known)
                both = known if len(fresh) <= room else known | new
                known.update(new if len(fresh) <= room else islice(new.items(), max(room, 0)))
                for words in pending:
                    values.extend(b"".join(map(both.__getitem__, words)))
                    offsets.append(len(values) // 4)
                pending.clear()

            for value in batch:
                text = value.as_py() or ""
                pending.append(split(text))
                size += len(text)
                if size >= BLOCK_BYTES:
                    flush()
                    size = 0
            flush()
            ids = pa.Array.from_buffers(pa.int32(), offsets[-1], [None, pa.py_buffer(values)])
            yield pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), ids)

    return compute(text)


def decode(spark: SparkSession, ids: Column | str, ranks_path: str) -> Column:
    """binary: the bytes that a column of id arrays stands for. Null ids give null; an id outside the vocabulary is an error."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast(read_ranks(ranks_path))

    @F.arrow_udf("binary")
    def compute(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        token = dict(enumerate(shared.value)).__getitem__
        for batch in batches:
            offsets, values, missing = [0], bytearray(), []
            for v in batch:
                values.extend(b"".join(map(token, v.values.to_numpy().tolist())) if v.is_valid else b"")
                offsets.append(len(values))
                missing.append(not v.is_valid)
            valid = None if not any(missing) else pa.array([not m for m in missing]).buffers()[1]
            ends = pa.array(offsets, pa.int32()).buffers()[1]
            yield pa.Array.from_buffers(pa.binary(), len(batch), [valid, ends, pa.py_buffer(values)])

    return compute(ids)
