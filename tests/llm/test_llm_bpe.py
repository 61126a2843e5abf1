import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from llm_cases import awkward, empty

from telespark.llm import bpe, queries

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_query_equals_the_library(spark, library):
    from conftest import SF

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.op3_byte_bpe(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_awkward_texts(spark, library):
    docs = awkward(spark)
    coded = docs.select("text", bpe.encode(spark, "text", PATH, public_tokenizers.PATTERN).alias("ids"))
    for r in coded.select("text", "ids", bpe.decode(spark, "ids", PATH).alias("back")).collect():
        assert r.ids == library.encode_ordinary(r.text or "")
        assert bytes(r.back) == (r.text or "").encode()
    assert empty(spark).select(bpe.encode(spark, "text", PATH, public_tokenizers.PATTERN)).count() == 0
    assert spark.createDataFrame([(None,)], "ids array<int>").select(bpe.decode(spark, "ids", PATH).alias("b")).first().b is None


def test_odd_characters_split_as_in_the_library(library):
    draw, merges, split = random.Random(1), bpe.Merges(bpe.read_ranks(PATH)), bpe.splitter(public_tokenizers.PATTERN)
    texts = ["".join(draw.choice("aaabbcdAB  \n\té中ß123'!\x1c\x85\xa0²½ª़ٞⅣ 😀ſ'S") for _ in range(draw.randint(1, 60))) for _ in range(1500)]
    pieces = sorted({w for t in texts for w in split(t)})
    known = dict(zip(pieces, merges.replay([w.encode() for w in pieces]), strict=True))
    for t in texts:
        assert [i for w in split(t) for i in known[w].tolist()] == library.encode_ordinary(t)


@pytest.mark.parametrize("seed", range(6))
def test_any_vocabulary(seed):
    """Vocabularies whose merges make tokens of lower rank than their parts."""
    draw = random.Random(seed)
    longer = list({"".join(draw.choice("abc") for _ in range(draw.randint(2, 5))).encode() for _ in range(40)})
    draw.shuffle(longer)
    tokens = [bytes([b]) for b in range(256)]
    at = draw.randint(0, 200)
    tokens[at:at] = longer
    merges = bpe.Merges(tokens)
    words = list({"".join(draw.choice("abc") for _ in range(draw.randint(1, 14))).encode() for _ in range(600)})

    def plain(word):
        if word in merges.ranks:
            return [merges.ranks[word]]
        parts = [bytes([b]) for b in word]
        while True:
            best = min(((merges.ranks[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in merges.ranks), default=None)
            if best is None:
                return [merges.ranks[p] for p in parts]
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    assert [r.tolist() for r in merges.replay(words)] == [plain(w) for w in words]


def test_a_vocabulary_needs_all_bytes():
    with pytest.raises(ValueError, match="lacks"):
        bpe.Merges([b"a"])


def test_plan_has_no_shuffle(spark, sf):
    plan = queries.op3_byte_bpe(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
