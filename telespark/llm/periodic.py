"""Periodic runs of words, found in grammars of their texts, and texts without the repeats."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telespark.llm import grammars
from telespark.llm.common import small_batches

#: Words of the texts that share a grammar; a longer text has one of its own.
BLOCK_WORDS = 200_000
_KINDS = (pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])), pa.string())


def refrain(doc_id: int | None, words: list) -> list:
    """For one id in ten the words with their end made periodic, as the query's contract has it; other lists as they are."""
    draw, kind = divmod(zlib.crc32(b"%d" % doc_id), 10) if doc_id is not None else (0, 1)
    n = len(words)
    if kind or not n:
        return words
    a = draw % n
    p = 1 + (n - a) // (3 + draw % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def _found(with_refrains: bool, block_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, held = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                words = (text.as_py() or b"").split()  # of bytes: by the six white-space characters of ASCII only
                ids.append(doc_id)
                texts.append(refrain(doc_id, words) if with_refrains else words)
                held += len(words)
                if held >= block_words or len(ids) == 2000:
                    yield block(ids, texts)
                    ids, texts, held = [], [], 0
        if ids:
            yield block(ids, texts)

    def block(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
        sizes = np.array(list(map(len, texts)))
        ends = np.cumsum(sizes)
        number: defaultdict[bytes, int] = defaultdict(count().__next__)
        t = np.fromiter(map(number.__getitem__, chain.from_iterable(texts)), np.int64, int(ends[-1]))
        start, end, period = grammars.runs(t, ends)
        steps = np.zeros(len(t) + 1, dtype=np.int64)
        np.add.at(steps, start + period, 1)
        np.subtract.at(steps, end, 1)
        stays = np.cumsum(steps)[:-1] == 0
        low, high = np.searchsorted(start, ends - sizes), np.searchsorted(start, ends)
        runs, collapsed = [], []
        for words, first, last, a, b in zip(texts, ends - sizes, ends, low, high):
            if a == b:
                runs.append([])
                collapsed.append(b" ".join(words))
            else:
                runs.append([{"start": int(start[i] - first), "length": int(end[i] - start[i]), "period": int(period[i])} for i in range(a, b)])
                collapsed.append(b" ".join([words[i] for i in np.flatnonzero(stays[first:last])]))
        columns = [pa.array(ids, _KINDS[0]), pa.array(runs, _KINDS[1]), pa.array(collapsed, pa.binary()).cast(_KINDS[2])]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "runs", "collapsed"])

    return run


def collapse_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", with_refrains: bool = False, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, runs, collapsed) for each row: its periodic runs by start and period, and its words, joined by one space, without the repeats.

    Words are parted by ASCII white space and numbered from 0. A run (start, length, period) is a longest stretch of words with that smallest period, of four
    periods and six words at least; of each run the words after the first period are repeats. `with_refrains` judges every tenth id's text with its end made
    periodic (see `refrain`). Null, empty and blank texts have no words and no runs; a null id is a document like any other, without a refrain; repeated rows have
    a result each. Texts share a grammar with their neighbours of a block, which changes no result; nothing is shuffled, and a task holds one block.
    """
    small_batches(docs.sparkSession)
    kinds = "doc_id bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
    return docs.select(F.col(doc_id).cast("bigint"), F.col(text)).mapInArrow(_found(with_refrains, block_words), kinds)


def longest(runs: Column) -> Column:
    """Of the longest runs the first, of these the one with the smallest period; null if there is none."""
    best = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    return F.when(best.isNotNull(), F.struct((-best["start"]).alias("start"), best["length"].alias("length"), (-best["period"]).alias("period")))


def runs_text(runs: Column) -> Column:
    """One line `start,length,period` for each run."""
    return F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
