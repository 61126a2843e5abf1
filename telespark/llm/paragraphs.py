"""Substring deduplication: paragraphs that repeat across documents, by MinHash banding; verbatim passages wherever they lie, by the least shingle of each."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from telespark.llm.common import cut, small_batches
from telespark.llm.components import connected_components
from telespark.session import write_and_read

SHINGLE = 5
SIMILAR = 0.8
LEAST_WORDS = 10
PASSAGE_WORDS = 50
#: Words of a mark: of the shingles of this length in PASSAGE_WORDS words, the least.
MARK_WORDS = 25
#: At a similarity of 0.8 a band of 3 agrees with chance 0.51, one of 8 bands with 0.997.
BANDS, BAND_ROWS = 8, 3
HOT = 8
#: Stands for a null id.
MISSING = -(1 << 62)
_DRAW = np.random.default_rng(11)
_FACTORS = (_DRAW.integers(1, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_SHIFTS = _DRAW.integers(1, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def lines_of(text: bytes) -> list[tuple[int, int, list[bytes]]]:
    """(start byte, end byte, words in lower case) of each line with words."""
    out, at = [], 0
    for line in text.split(b"\n"):
        words = line.lower().split()
        if words:
            out.append((at, at + len(line), words))
        at += len(line) + 1
    return out


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingle_hashes(h: np.ndarray) -> np.ndarray:
    """64-bit hashes of the five-word shingles of hashed words, in order; of the whole sequence where it is shorter."""
    n = max(1, len(h) - SHINGLE + 1)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(min(SHINGLE, len(h))):
        out = (out ^ h[i : i + n]) * _MIX
        out ^= out >> np.uint64(29)
    return out


def _scan(batches: Iterator[pa.RecordBatch], within: bool) -> Iterator[pa.RecordBatch]:
    """A row for each paragraph of LEAST_WORDS words or more, with its band keys; one without a place for each text that has one or PASSAGE_WORDS words, with its marks."""
    salts = np.arange(1, BANDS + 1, dtype=np.uint64) * _MIX
    for batch in batches:
        for at in range(0, len(batch), 256):
            docs, keys, texts = batch.slice(at, 256).columns
            rows: list[list] = [[] for _ in range(9)]
            for doc, key, text in zip(docs.to_pylist(), keys.to_pylist(), texts.cast(pa.binary()).to_pylist(), strict=True):
                lines = lines_of(text or b"")
                first = np.cumsum([0, *[len(x[2]) for x in lines]])
                found = [i for i, x in enumerate(lines) if len(x[2]) >= LEAST_WORDS]
                if not found and first[-1] < PASSAGE_WORDS:
                    continue
                hashed = word_hashes([w for x in lines for w in x[2]])
                marks = marks_of(shingle_hashes(hashed)) if within and len(hashed) >= PASSAGE_WORDS else None
                for column, value in zip(rows, (doc, key, None, len(text) - len(text.lstrip()), len(text.rstrip()), len(hashed), None, None, marks), strict=True):
                    column.append(value)
                if not found:
                    continue
                hashes = [shingle_hashes(hashed[first[i] : first[i + 1]]) for i in found]
                starts = np.cumsum([0, *map(len, hashes[:-1])])
                flat = np.concatenate(hashes)
                least = np.stack([np.minimum.reduceat(flat * f + s, starts) for f, s in zip(_FACTORS, _SHIFTS, strict=True)], axis=1)
                least = least.reshape(len(found), BANDS, BAND_ROWS)
                bands = np.broadcast_to(salts, (len(found), BANDS)).copy()
                for i in range(BAND_ROWS):
                    bands = (bands ^ least[:, :, i]) * _MIX
                    bands ^= bands >> np.uint64(31)
                for i, (start, end, words) in enumerate(lines[j] for j in found):
                    exact = xxhash.xxh3_64_intdigest(b" ".join(words))
                    exact = exact - (1 << 64) if exact >> 63 else exact
                    for column, value in zip(rows, (doc, key, i, start, end, len(words), exact, bands[i].astype(np.int64), None), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            names = ("doc", "text_key", "place", "start", "end", "n_words", "exact", "bands", "marks")
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names=list(names))


def _wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each text, the different shingles of the wanted paragraphs, and a row for each passage of PASSAGE_WORDS words whose mark is wanted."""
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in (0, 1, 2, 4, 5)]
        exacts, sets, passages = [], [], [np.zeros((7, 0), dtype=np.int64)]
        for doc, high, which, lines, marks, text in zip(*columns, batch.column(3).cast(pa.binary()).to_pylist(), strict=True):
            lines = set(lines or ())
            for _, _, words in lines_of(text) if lines else ():
                exact = xxhash.xxh3_64_intdigest(b" ".join(words))
                exact = exact - (1 << 64) if exact >> 63 else exact
                if exact in lines:
                    lines.discard(exact)
                    exacts.append(exact)
                    sets.append(np.unique(shingle_hashes(word_hashes(words))).astype(np.int64))
            at, start, end, own = passages_of(text, marks or [])
            passages.append(np.stack([*[np.full(len(at), x) for x in (doc, high, which)], at, start, end - start, own]))
        rest = np.concatenate(passages, axis=1)
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        n, m = len(exacts), rest.shape[1]
        one = [pa.concat_arrays([pa.array(exacts, pa.int64()), pa.nulls(m, pa.int64())]), pa.concat_arrays([pa.array(sets, pa.list_(pa.int64())), pa.nulls(m, pa.list_(pa.int64()))])]
        other = [pa.concat_arrays([pa.nulls(n, k), pa.array(x).cast(k)]) for x, k in zip(rest, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays([*one, *other], names=["exact", "shingles", "doc", "high", "which", "at", "start", "length", "passage"])


def _verified(pairs: DataFrame, sets: DataFrame, *more: str) -> DataFrame:
    """`pairs` (a, b) with their exact Jaccard similarity; `more`: the shingles in which they differ, and how many each has."""
    a = sets.select(F.col("exact").alias("a"), F.col("shingles").alias("sa"))
    b = sets.select(F.col("exact").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(a, "a").join(b, "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    differs = F.concat(F.array_except("sa", "sb"), F.array_except("sb", "sa"))
    extra = {"differs": differs, "na": F.size("sa"), "nb": F.size("sb")}
    return both.select("a", "b", (shared / (F.size("sa") + F.size("sb") - shared)).alias("similarity"), *[extra[c].alias(c) for c in more])


def _met(found: DataFrame) -> DataFrame:
    """exact, key and n of the wordings that share a band with n - 1 others."""
    filed = found.groupBy("exact").agg(F.min("bands").alias("bands")).select("exact", F.explode("bands").alias("key"))
    return write_and_read(filed.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key"))).where("n > 1"), "paragraphs-met")


def links(met: DataFrame, sets: DataFrame, hot: int = HOT) -> DataFrame:
    """Pairs (a, b) of different paragraphs that share a band and are similar.

    `met`: as of `_met`; `sets`: the shingles of its wordings. Bands with up to `hot` wordings make all their pairs. In larger
    ones every wording is compared with one of them, that which meets most wordings over all bands, in practice the text that the others were
    made from; those that are similar to it are linked already, the others meet by what they don't share with it (`_by_difference`). So groups of near
    copies make no pairs with their square unless their changes are the same, and components are those of all pairs.
    """
    few, many = met.where(F.col("n") <= hot), met.where(F.col("n") > hot)
    left, right = few.select("key", F.col("exact").alias("a")), few.select("key", F.col("exact").alias("b"))
    pairs = left.join(right, "key").where(F.col("a") < F.col("b")).select("a", "b")
    meets = met.groupBy("exact").agg(F.sum("n").alias("meets"))
    centre = F.max(F.struct("meets", "exact")).over(Window.partitionBy("key"))["exact"]
    centred = many.join(meets, "exact").select("key", F.col("exact").alias("a"), centre.alias("b"))
    star = write_and_read(_verified(centred.select("a", "b").where("a != b").distinct(), sets, "differs", "na", "nb"), "paragraphs-stars")
    pairs = pairs.union(_by_difference(star))
    checked = _verified(pairs.distinct(), sets).union(star.select("a", "b", "similarity"))
    return checked.where(F.col("similarity") >= SIMILAR)


def _by_difference(star: DataFrame) -> DataFrame:
    """Pairs (a, b) of wordings compared with one centre that can be similar though `a` is not similar to the centre.

    `star`: a, b (the centre), differs (the shingles that only one of them has), na and nb (their numbers of shingles). Two wordings differ in what one of their two differences
    from the centre holds and the other doesn't. At a similarity of 0.8 that is at most a ninth of their shingles; if one of them differs from the centre in more, the differences share
    shingles, and the least t of them that they share bounds the place of the first: the rarest first, it is not among the last t - 1 of either. So only rare changes are compared. Exact.
    """
    size = F.size("differs")
    far = F.col("far")
    kept = star.select(F.col("b").alias("centre"), "a", "na", F.col("nb").alias("nc"), "differs", size.alias("n"), (9 * size > F.col("na") + F.col("nb")).alias("far"))
    wanted = kept.where(far).select("centre").distinct()
    parts = kept.join(wanted, "centre").select("centre", "a", "na", "nc", "n", "far", F.explode("differs").alias("shingle"))
    parts = write_and_read(parts, "paragraphs-differences")
    often = parts.groupBy("centre", "shingle").agg(F.count(F.lit(1)).alias("often"))
    place = F.row_number().over(Window.partitionBy("centre", "a").orderBy("often", "shingle"))
    # Every member may be the partner of a far one; whoever that is, they share more than this.
    shared = F.floor((9 * F.col("n") + F.col("nc") - F.col("na")) / 18)
    placed = parts.join(often, ["centre", "shingle"]).withColumn("place", place)
    first = write_and_read(placed.where((F.col("often") > 1) & (far | (F.col("place") <= F.col("n") - shared))), "paragraphs-rare")
    columns = lambda x: ["centre", "shingle", *[F.col(c).alias(f"{x}_{c}") for c in ("a", "na", "n", "place", "far")]]
    left = first.where(far & (F.col("place") <= F.col("n") + 1 - F.ceil((9 * F.col("n") - F.col("na") - F.col("nc")) / 18)))
    both = left.select(*columns("p")).join(first.where(F.col("place") <= F.col("n") - shared).select(*columns("q")), ["centre", "shingle"])
    least = F.ceil((9 * (F.col("p_n") + F.col("q_n")) - F.col("p_na") - F.col("q_na")) / 18)
    sizes = 5 * F.least("p_na", "q_na") >= 4 * F.greatest("p_na", "q_na")
    # Two far ones meet from one side only.
    once = (F.col("p_a") < F.col("q_a")) | (~F.col("q_far") & (F.col("p_a") != F.col("q_a")))
    meet = once & sizes & (F.col("p_place") <= F.col("p_n") - least + 1) & (F.col("q_place") <= F.col("q_n") - least + 1)
    return both.where(meet).select(F.least("p_a", "q_a").alias("a"), F.greatest("p_a", "q_a").alias("b"))


def repeated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """Paragraphs (lines) that repeat across documents as part of a passage of PASSAGE_WORDS words or more.

    A row each: doc_id, place (among the text's paragraphs of LEAST_WORDS words or more), start and end in bytes of UTF-8, n_words,
    `first_doc`, `first_place` (the component's first paragraph), `passage_words`, and `removed`: false for the first paragraph, which stays. Paragraphs count as similar at a Jaccard
    similarity of SIMILAR of their five-word shingles, lower-cased; identical wordings are one class however often they occur. A passage is a row of paragraphs of a
    document, each of which occurs in another document too. Null and empty texts have no paragraphs; a null id is one document; repeated rows of
    one id are one document, whose paragraphs come back as often.
    """
    return _repeats(docs, doc_id, text, hot, within=False)


def repeated_anywhere(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """The rows of `repeated`, and a row without places for each stretch of PASSAGE_WORDS words or more that another document holds word for word, in whatever lines it stands.

    Stretches are found as by `verbatim`, between different texts; a text that several documents have is a stretch as a whole. `first_doc` is the document where the stretch's first passage
    occurs first; `removed` is false for first occurrences. A document has rows of its own for what is first and what occurs before, and for the whole where its text has copies; they may overlap each other and the paragraphs.
    """
    return _repeats(docs, doc_id, text, hot, within=True)


def _repeats(docs: DataFrame, doc_id: str, text: str, hot: int, within: bool) -> DataFrame:
    small_batches(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col(doc_id).cast("bigint"), F.lit(MISSING)).alias("doc"), F.xxhash64(text).alias("text_key"), F.col(text).alias("text"))
    kinds = "doc bigint, text_key bigint, place int, start bigint, end bigint, n_words int, exact bigint, bands array<bigint>, marks array<bigint>"
    scanned = write_and_read(texts.mapInArrow(lambda batches: _scan(batches, within), kinds), "paragraphs")
    found, whole = scanned.where("place is not null").drop("marks"), scanned.where("place is null").drop("place", "exact", "bands")
    met = _met(found)
    lines = found.groupBy("exact").agg(F.min("text_key").alias("text_key")).join(met.select("exact").distinct(), "exact")
    lines = lines.groupBy("text_key").agg(F.collect_list("exact").alias("lines"))  # paragraphs of one text
    # Of the copies of a text, the one with the smallest id is read again.
    copies = whole.groupBy("text_key").agg(F.min("doc").alias("doc"), F.max("doc").alias("high"))
    wanted = copies.withColumn("which", F.row_number().over(Window.partitionBy("doc").orderBy("text_key"))).join(lines, "text_key", "left")
    wanted = wanted.join(_shared_marks(whole), "doc", "left") if within else wanted.withColumn("marks", F.lit(None).cast("array<bigint>"))
    read = texts.join(wanted.where("lines is not null or marks is not null"), ["doc", "text_key"]).select("doc", "high", "which", "text", "lines", "marks")
    kinds = "exact bigint, shingles array<bigint>, doc bigint, high bigint, which int, at int, start bigint, length bigint, passage bigint"
    read = write_and_read(read.mapInArrow(_wanted, kinds), "paragraphs-read")
    sets = read.where("exact is not null").groupBy("exact").agg(F.first("shingles").alias("shingles"))
    roots = connected_components(cut(links(met, write_and_read(sets, "paragraphs-shingles"), hot).select("a", "b")))
    rooted = found.drop("bands").join(roots.withColumnRenamed("node", "exact"), "exact", "left").withColumn("root", F.coalesce("root", "exact"))
    first = F.min(F.struct("doc", "place"))
    groups = rooted.groupBy("root").agg(first.alias("first"), F.max("doc").alias("high")).where("first.doc < high")
    hit = rooted.join(groups.select("root", F.col("first.doc").alias("first_doc"), F.col("first.place").alias("first_place")), "root")
    row = Window.partitionBy("doc", "text_key").orderBy("place")
    # Equal rows of one document have equal places, so that a dense rank counts on.
    run = hit.withColumn("run", F.col("place") - F.dense_rank().over(row))
    words = F.sum("n_words").over(Window.partitionBy("doc", "text_key", "run"))
    times = F.count(F.lit(1)).over(Window.partitionBy("doc", "text_key", "run", "place"))
    rows = run.withColumn("times", times).withColumn("passage_words", (words / F.col("times")).cast("bigint")).where(F.col("passage_words") >= PASSAGE_WORDS)
    removed = (F.col("doc") != F.col("first_doc")) | (F.col("place") != F.col("first_place"))
    rows = rows.select("doc", "place", "start", "end", "n_words", "first_doc", "first_place", "passage_words", removed.alias("removed"))
    if within:
        copied = whole.drop("marks").distinct().join(copies.select("text_key", F.col("doc").alias("first_doc"), "high"), "text_key").where((F.col("first_doc") < F.col("high")) & (F.col("n_words") >= PASSAGE_WORDS))
        copied = copied.withColumn("removed", F.col("doc") != F.col("first_doc"))
        both = copied.select("doc", "start", "end", "n_words", "first_doc", "removed").union(_stretches(read.where("passage is not null")))
        none = F.lit(None).cast("int")
        rows = rows.union(both.select("doc", none, "start", "end", "n_words", "first_doc", none, F.col("n_words").cast("bigint"), "removed"))
    named = lambda c: F.when(F.col(c) != MISSING, F.col(c))
    return rows.select(named("doc").alias("doc_id"), "place", "start", "end", "n_words", named("first_doc").alias("first_doc"), "first_place", "passage_words", "removed")


def _shared_marks(whole: DataFrame) -> DataFrame:
    """doc and the marks that texts of it, where it is the first to have them, share with other texts of other documents."""
    texts = whole.groupBy("text_key").agg(F.min("doc").alias("doc"), F.max("doc").alias("high"), F.first("marks").alias("marks"))
    by_mark = Window.partitionBy("mark")
    filed = texts.select("doc", "high", F.explode("marks").alias("mark"))
    filed = filed.select("doc", "mark", F.min("doc").over(by_mark).alias("low"), F.max("high").over(by_mark).alias("most"), F.count(F.lit(1)).over(by_mark).alias("n"))
    return filed.where("n > 1 and low < most").groupBy("doc").agg(F.collect_set("mark").alias("marks"))


def _stretches(passages: DataFrame) -> DataFrame:
    """Longest rows of overlapping passages that other texts of other documents hold too: all first of their wording, or all later ones."""
    same = Window.partitionBy("passage")
    text = F.struct("doc", "which")
    first = F.min(F.struct("doc", "which", "at")).over(same)
    known = passages.drop("exact", "shingles").select("*", first.alias("first"), F.max("high").over(same).alias("most"), (F.min(text).over(same) != F.max(text).over(same)).alias("several"))
    hit = known.where("several and first.doc < most").select("doc", "which", "at", "start", "length", F.col("first.doc").alias("first_doc"), (F.struct("doc", "which", "at") != F.col("first")).alias("removed"))
    kind = Window.partitionBy("doc", "which", "removed").orderBy("at")
    begins = F.col("at") - F.lag("at", 1, -PASSAGE_WORDS - 1).over(kind) > PASSAGE_WORDS
    runs = hit.withColumn("begins", begins.cast("int")).withColumn("run", F.sum("begins").over(kind))
    spans = runs.groupBy("doc", "which", "removed", "run").agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("length")).alias("end"), (F.max("at") - F.min("at") + PASSAGE_WORDS).alias("n_words"), F.min_by("first_doc", "at").alias("first_doc"))
    return spans.select("doc", "start", "end", "n_words", "first_doc", "removed")


def windows_of(fives: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the MARK_WORDS-word shingles, and of each passage of PASSAGE_WORDS words its least such hash and its own hash."""
    n = len(fives) + SHINGLE - MARK_WORDS
    marks = np.zeros(n, dtype=np.uint64)
    for i in range(0, MARK_WORDS, SHINGLE):
        marks = (marks ^ fives[i : i + n]) * _MIX
        marks ^= marks >> np.uint64(29)
    m = n + MARK_WORDS - PASSAGE_WORDS
    own = np.zeros(m, dtype=np.uint64)
    for i in (0, PASSAGE_WORDS - MARK_WORDS):
        own = (own ^ marks[i : i + m]) * _MIX
        own ^= own >> np.uint64(31)
    return marks, _slid(marks, PASSAGE_WORDS - MARK_WORDS + 1, np.minimum), own


def _slid(values: np.ndarray, n: int, least: np.ufunc) -> np.ndarray:
    """Least (or most) of each n neighbours."""
    size, out = 1, values
    while size < n:
        step = min(size, n - size)
        out = least(out[: len(out) - step], out[step:])
        size += step
    return out


def marks_of(fives: np.ndarray) -> np.ndarray:
    """The marks of a text: the shingles that are least in some passage."""
    width = PASSAGE_WORDS - MARK_WORDS
    marks, least, _ = windows_of(fives)
    wide = np.concatenate([np.zeros(width, dtype=np.uint64), least, np.zeros(width, dtype=np.uint64)])
    return np.unique(marks[_slid(wide, width + 1, np.maximum) == marks]).astype(np.int64)


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The marks of each text."""
    for batch in batches:
        for at in range(0, len(batch), 256):
            docs, keys, texts = batch.slice(at, 256).columns
            rows: list[list] = [[], [], []]
            for doc, key, text in zip(docs.to_pylist(), keys.to_pylist(), texts.cast(pa.binary()).to_pylist(), strict=True):
                words = (text or b"").lower().split()
                if len(words) < PASSAGE_WORDS:
                    continue
                for column, value in zip(rows, (doc, key, marks_of(shingle_hashes(word_hashes(words)))), strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names=["doc", "text_key", "marks"])


_SPACE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))


def passages_of(text: bytes, marks: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First word's number, first byte, end byte and hash of each passage of PASSAGE_WORDS words whose mark is among `marks`."""
    words = text.lower().split() if len(marks) else []
    if len(words) < PASSAGE_WORDS:
        return (np.zeros(0, dtype=np.int64),) * 4
    _, least, own = windows_of(shingle_hashes(word_hashes(words)))
    at = np.flatnonzero(np.isin(least.astype(np.int64), marks))
    space = np.concatenate([[True], _SPACE[np.frombuffer(text, dtype=np.uint8)], [True]])
    starts, ends = np.flatnonzero(space[:-1] & ~space[1:]), np.flatnonzero(~space[:-1] & space[1:])
    return at, starts[at], ends[at + PASSAGE_WORDS - 1], own[at].astype(np.int64)


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each passage of PASSAGE_WORDS words whose mark is wanted: its first word's number, its bytes and its hash."""
    for batch in batches:
        docs, keys, texts, wanted = (c.to_pylist() for c in (batch.column(0), batch.column(1), batch.column(2).cast(pa.binary()), batch.column(3)))
        for doc, key, text, marks in zip(docs, keys, texts, wanted, strict=True):
            at, start, end, own = passages_of(text, marks)
            columns = [pa.array(np.full(len(at), doc)), pa.array(np.full(len(at), key)), pa.array(at.astype(np.int32)), pa.array(start), pa.array(end), pa.array(own)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc", "text_key", "at", "start", "end", "passage"])


def verbatim(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Stretches of PASSAGE_WORDS words or more that occur word for word in another document, in whatever lines they stand.

    A row each: doc_id, `text_key` (a hash of the text), start and end in bytes of UTF-8, n_words, `first_doc` (where the stretch's first passage occurs first) and `removed`: a
    stretch is a longest row of overlapping passages that are all the first of their wording, which stay, or all later ones. Stretches of the two kinds
    may overlap; each word of a removed one has a copy that stays. Words are parted by ASCII white space and lower-cased in ASCII; line ends count as any white space.

    Exact but for equal 64-bit hashes: the least of the MARK_WORDS-word shingles of a passage is the same wherever the passage occurs, so that only
    passages whose mark other documents have too are compared, by their own hash. Nothing is compared in pairs. Texts of fewer words have no rows; a null
    id is one document; repeated rows of one id and text have their rows once.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col(doc_id).cast("bigint"), F.lit(MISSING)).alias("doc"), F.xxhash64(text).alias("text_key"), F.col(text).alias("text"))
    marked = write_and_read(texts.mapInArrow(_marks, "doc bigint, text_key bigint, marks array<bigint>"), "passages-marks")
    filed = marked.select("doc", "text_key", F.explode("marks").alias("mark"))
    shared = filed.groupBy("mark").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high").select("mark")
    wanted = filed.join(shared, "mark").groupBy("doc", "text_key").agg(F.collect_set("mark").alias("marks"))
    kinds = "doc bigint, text_key bigint, at int, start bigint, end bigint, passage bigint"
    met = write_and_read(texts.join(wanted, ["doc", "text_key"]).select("doc", "text_key", "text", "marks").mapInArrow(_passages, kinds), "passages-met")
    known = met.groupBy("passage").agg(F.min(F.struct("doc", "text_key", "at")).alias("first"), F.max("doc").alias("high")).where("first.doc < high")
    hit = met.join(known.select("passage", "first"), "passage").withColumn("removed", F.struct("doc", "text_key", "at") != F.col("first"))
    kind = Window.partitionBy("doc", "text_key", "removed").orderBy("at")
    begins = F.col("at") - F.lag("at", 1, -PASSAGE_WORDS - 1).over(kind) > PASSAGE_WORDS
    runs = hit.withColumn("begins", begins.cast("int")).withColumn("run", F.sum("begins").over(kind))
    spans = runs.groupBy("doc", "text_key", "removed", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), (F.max("at") - F.min("at") + PASSAGE_WORDS).alias("n_words"), F.min_by("first.doc", "at").alias("first_doc"))
    named = lambda c: F.when(F.col(c) != MISSING, F.col(c))
    return spans.select(named("doc").alias("doc_id"), "text_key", "start", "end", "n_words", named("first_doc").alias("first_doc"), "removed")
