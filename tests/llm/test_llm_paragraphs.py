import itertools
import random
import re
from collections import defaultdict

import pytest
from llm_cases import awkward, empty, union_find, words
from telespark.llm import paragraphs, queries


def plain(docs):
    """{(doc_id, place)} of paragraphs in passages that repeat, by comparing all wordings that share a shingle."""
    lines = {d: [w for x in (t or "").split("\n") if len(w := tuple(x.encode().lower().split())) >= 10] for d, t in docs}
    occurs = defaultdict(list)
    for d, found in lines.items():
        for i, w in enumerate(found):
            occurs[w].append((d, i))
    known = list(occurs)
    shingles = [{w[i : i + 5] for i in range(len(w) - 4)} for w in known]
    where = defaultdict(list)
    for i, s in enumerate(shingles):
        for x in s:
            where[x].append(i)
    near = {(i, j) for at in where.values() for i, j in itertools.combinations(at, 2)}
    near = [(i, j) for i, j in near if len(shingles[i] & shingles[j]) >= 0.8 * len(shingles[i] | shingles[j])]
    sets, documents = union_find(len(known), near), defaultdict(set)
    for i, w in enumerate(known):
        documents[sets.find(i)] |= {d for d, _ in occurs[w]}
    repeats = {w: len(documents[sets.find(i)]) > 1 for i, w in enumerate(known)}
    out = set()
    for d, found in lines.items():
        for hit, run in itertools.groupby(range(len(found)), key=lambda i: repeats[found[i]]):
            run = list(run)
            if hit and sum(len(found[i]) for i in run) >= 50:
                out |= {(d, i) for i in run}
    return out


def test_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = [r for r in queries.op2_substring_dedup(spark, sf).collect() if r.place is not None]
    assert {(r.doc_id, r.place) for r in rows} == plain(docs)
    texts = dict(docs)
    for r in rows:
        part = texts[r.doc_id].encode()[r.start : r.end].decode()
        assert len(part.split()) == r.n_words
        assert r.removed == ((r.doc_id, r.place) != (r.first_doc, r.first_place))


@pytest.mark.parametrize("hot", [1, 1000])
def test_near_copies_of_one_passage(spark, hot):
    """Copies with one to four words changed: some are similar to the original, some only to one another."""
    draw = random.Random(8)
    base = words(3, 70).split()
    docs = []
    for i in range(60):
        copy = list(base)
        for _ in range(draw.randint(0, 4)):
            copy[draw.randrange(70)] = f"w{draw.randrange(40)}"
        docs.append((i, words(i, 15) + "\n" + " ".join(copy) + "\n" + words(i + 900, 30)))
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert {(r.doc_id, r.place) for r in paragraphs.repeated(frame, hot=hot).collect()} == plain(docs)


def test_crowded_band_makes_no_square(spark, monkeypatch):
    """Copies with changes of their own, too many to be similar to the original: some are made from one another, the others are hardly compared."""
    draw, base, docs = random.Random(5), words(3, 70).split(), []
    for i in range(240):
        copy = list(base)
        for k in range(7):
            copy[draw.randrange(70)] = f"own{i}x{k}"
        docs.append(copy)
        if i % 12 == 0:
            copy = list(copy)
            copy[draw.randrange(70)] = f"again{i}"
            docs.append(copy)
    docs = [(i, words(i, 15) + "\n" + " ".join(copy)) for i, copy in enumerate(docs)] + [(1000, " ".join(base))]
    compared, real = [], paragraphs._verified
    monkeypatch.setattr(paragraphs, "_verified", lambda pairs, *more: compared.append(pairs.count()) or real(pairs, *more))
    rows = paragraphs.repeated(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    truth = plain(docs)
    assert 20 < len(truth) < 100 and {(r.doc_id, r.place) for r in rows} == truth
    assert sum(compared) < 5 * len(docs)

def test_awkward(spark):
    rows = paragraphs.repeated(awkward(spark)).collect()
    assert sorted((r.doc_id, r.n_words, r.removed) for r in rows) == [(5, 60, False), (5, 60, False), (6, 60, True)]
    assert paragraphs.repeated(empty(spark)).count() == 0
    once = spark.createDataFrame([(1, words(1, 80)), (1, words(1, 80)), (2, words(2, 80))], "doc_id bigint, text string")
    assert paragraphs.repeated(once).count() == 0


def covered(docs):
    """{(doc_id, byte)} of the words in runs of 50 words that another document holds too, by comparing all runs."""
    tokens = {d: [(m.start(), m.group().lower()) for m in re.finditer(rb"[^ \t\n\v\f\r]+", (t or "").encode())] for d, t in docs}
    where = defaultdict(set)
    runs = {d: [tuple(w for _, w in found[i : i + 50]) for i in range(len(found) - 49)] for d, found in tokens.items()}
    for d, found in runs.items():
        for run in found:
            where[run].add(d)
    return {(d, tokens[d][i + k][0]) for d, found in runs.items() for i, run in enumerate(found) if len(where[run]) > 1 for k in range(50)}


def spans_covered(docs, rows):
    texts = {d: (t or "").encode() for d, t in docs}
    out, gone = set(), set()
    for r in rows:
        at = [r.start + m.start() for m in re.finditer(rb"[^ \t\n\v\f\r]+", texts[r.doc_id][r.start : r.end])]
        assert len(at) == r.n_words >= 50
        out |= {(r.doc_id, a) for a in at}
        gone |= {(r.doc_id, a) for a in at} if r.removed else set()
    return out, gone


def test_verbatim_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    truth = covered(docs)
    assert truth and spans_covered(docs, queries.op2_verbatim_passages(spark, sf).collect())[0] == truth


def test_passages_inside_longer_lines_and_across_short_ones(spark):
    shared, wrapped, short = words(1, 57), words(2, 50).split(), words(3, 49)
    lines = "\n".join(" ".join(wrapped[i : i + 8]) for i in range(0, 50, 8))
    docs = [
        (1, f"{words(11, 80, 900)} {shared} {words(12, 60, 900)}"), (2, f"{words(13, 5, 900)} {shared.upper()}\u00a0x {words(14, 40, 900)}"),
        (3, f"{words(15, 30, 900)}\n{lines}\n{words(16, 9, 900)}"), (4, f"{words(17, 90, 900)} {' '.join(wrapped)}"),
        (5, f"{short} a {words(18, 30, 900)}"), (6, f"{short} b {words(19, 30, 900)}"), (7, "w " * 70), (8, "w " * 55), (9, None), (10, ""),
    ]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    rows = paragraphs.verbatim(frame).collect()
    found, gone = spans_covered(docs, rows)
    assert found == covered(docs)
    assert {r.doc_id for r in rows} == {1, 2, 3, 4, 7, 8}
    assert {r.doc_id: r.first_doc for r in rows if r.removed} == {2: 1, 4: 3, 7: 7, 8: 7}
    assert [r.n_words for r in rows if r.doc_id < 3] == [56, 56]
    assert paragraphs.verbatim(empty(spark)).count() == 0
    twice = spark.createDataFrame([(1, words(1, 80)), (1, words(1, 80)), (None, words(2, 80)), (None, words(2, 80)), (3, words(2, 80))], "doc_id bigint, text string")
    assert sorted((r.doc_id or 0, r.n_words, r.removed) for r in paragraphs.verbatim(twice).collect()) == [(0, 80, False), (3, 80, True)]


def test_query_finds_passages_inside_longer_lines(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = queries.op2_substring_dedup(spark, sf).collect()
    truth = covered(docs)
    assert {d for d, _ in truth} - {d for d, _ in plain(docs)}
    assert spans_covered(docs, [r for r in rows if r.place is None])[0] == truth


def test_repeated_anywhere(spark):
    """Stretches inside longer lines and over short ones, copies of whole texts, and texts that share passages with copied ones."""
    shared, copied = words(1, 57), words(2, 80)
    tail = " ".join(copied.split()[20:])
    docs = [
        (1, f"{words(11, 80, 900)} {shared} {words(12, 60, 900)}"), (2, f"{words(13, 5, 900)} {shared.upper()}\u00a0x {words(14, 40, 900)}"),
        (4, f" {copied}\n"), (5, f" {copied}\n"), (5, f" {copied}\n"), (3, f"{words(15, 70, 900)} {tail} {words(16, 70, 900)}"), (6, "w " * 70), (7, "w " * 55), (8, "v " * 70), (9, words(17, 49)), (10, words(17, 49)),
        (None, words(18, 60)), (None, words(18, 60)), (11, None), (12, words(18, 60)), (13, words(19, 60)), (13, words(19, 60) + " b"),
    ]
    rows = [r for r in paragraphs.repeated_anywhere(spark.createDataFrame(docs, "doc_id bigint, text string")).collect() if r.place is None]
    found, gone = spans_covered(docs, rows)
    assert found == covered(docs)
    assert {r.doc_id for r in rows} == {None, 1, 2, 3, 4, 5, 6, 7, 12}
    assert {(r.doc_id, r.n_words, r.first_doc) for r in rows if r.removed} == {(2, 56, 1), (4, 60, 3), (5, 80, 4), (6, 69, 6), (7, 55, 6), (12, 60, None)}
    assert [r.n_words for r in rows if r.doc_id == 3] == [60]
    assert paragraphs.repeated_anywhere(empty(spark)).count() == 0


def test_far_wordings_meet_once(spark):
    """Two wordings that differ from the centre in 20 of their 50 shingles, 19 of these in common: five common ones are early enough to meet by, from one side."""
    star = [(1, 9, list(range(20)), 50, 50), (2, 9, list(range(1, 21)), 50, 50)]
    pairs = paragraphs._by_difference(spark.createDataFrame(star, "a bigint, b bigint, differs array<bigint>, na int, nb int")).collect()
    assert [(r.a, r.b) for r in pairs] == [(1, 2)] * 5
