"""Awkward documents shared by the tests: nulls, blanks, ties, repeated rows, a long text, clashing column names."""

import random
from types import SimpleNamespace

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, fp string, key int, row int, spans string, base string, h int, n int, p int, label string"


def words(seed, n, size=400):
    draw = random.Random(seed)
    pool = ["".join(draw.choice("abcdefghiklmnoprstuv") for _ in range(draw.randint(2, 9))) for _ in range(size)]
    return " ".join(draw.choice(pool) for _ in range(n))


def awkward(spark, schema=SCHEMA):
    rows = [
        (1, None, "en", None), (2, "", "en", "a"), (3, " \n\t ", "fr", "a"), (None, "the quick brown fox jumps over it", None, None),
        (4, words(4, 30_000), "en", "b"), (5, words(5, 60), "en", "a"), (5, words(5, 60), "en", "a"), (6, words(5, 60), "de", "a"),
        (7, "12345 !!! 678", None, "c"), (8, "É" * 500 + " ñandú çà", "es", "c"), (9, "one", "en", None), (10, "\x00 \x1c\x85 ", None, "a"),
    ]
    extra = ("x", 1, 2, "s", "b", 3, 4, 5, "l")
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), *extra) for r in rows], schema)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def union_find(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return SimpleNamespace(find=find)
