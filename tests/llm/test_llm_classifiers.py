import itertools
import zlib

import numpy as np
import pytest
from llm_cases import awkward, empty, words
from telespark.llm import langid, queries, toxicity

SF = "/root/testdata/sf0.01"


def crc(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def test_forward_backward_equals_enumeration():
    draw = np.random.default_rng(0)
    k, lengths = 3, np.array([5, 4, 1])
    emissions, moves, start = draw.normal(size=(3, 5, k)), draw.normal(size=(k, k)), draw.normal(size=k)
    marginal, expected = langid.posteriors(emissions, lengths, moves, start)
    counts = np.zeros((k, k))
    for c, n in enumerate(lengths):
        paths = list(itertools.product(range(k), repeat=int(n)))
        score = np.array([start[p[0]] + sum(emissions[c, t, p[t]] for t in range(n)) + sum(moves[p[t], p[t + 1]] for t in range(n - 1)) for p in paths])
        weight = np.exp(score - score.max())
        weight /= weight.sum()
        for p, w in zip(paths, weight, strict=True):
            for a, b in itertools.pairwise(p):
                counts[a, b] += w
        for t in range(n):
            exact = [sum(w for p, w in zip(paths, weight, strict=True) if p[t] == label) for label in range(k)]
            assert marginal[c, t] == pytest.approx(exact)
    assert expected == pytest.approx(counts)


def test_language_of_held_out_documents(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    rows = queries.op5_language_id(spark, SF).collect()
    assert len(rows) == len(lang)
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (crc(r.doc_id, 4) == 2) and 0 <= r.score <= 1 for r in rows)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) >= 0.98


def test_every_label_and_the_whole_text_are_learned(spark):
    common = "12 " * 900 + words(0, 700) + " "
    names = [f"l{i:02}" for i in range(70)]
    own = {name: words(i + 1, 40, 12) for i, name in enumerate(names)}
    few = spark.createDataFrame([(2 * j + i % 2, common + own[names[i]], names[i]) for j in range(12) for i in range(2)], "doc_id bigint, text string, lang string")
    many = spark.createDataFrame([(i + 70 * j, own[name], name) for j in range(2 + 4) for i, name in enumerate(names)], "doc_id bigint, text string, lang string")
    for frame, wanted in ((few, names[:2]), (many, names)):
        model = langid.train(frame)
        assert list(model.labels) == wanted
        best = [model.labels[p.mean(axis=0).argmax()] for p in langid.label_words([own[x] for x in wanted], model)]
        assert np.mean([a == b for a, b in zip(best, wanted, strict=True)]) >= 0.95
    with pytest.raises(ValueError, match="labels_most"):
        langid.train(many, labels_most=69)


def test_words_of_code_switched_text():
    rows = [("the cat and the dog are in the house with a ball " * 3, "en"), ("der hund und die katze sind in dem haus mit einem ball " * 3, "de")] * 20
    model = langid.fit(langid.code_switched(rows, ("de", "en")), ("de", "en"), epochs=20)
    text = "the dog and the cat are in the house der hund und die katze sind in dem haus"
    labels = [model.labels[i] for i in langid.label_words([text], model)[0].argmax(axis=1)]
    assert labels[:8] == ["en"] * 8
    assert labels[-7:] == ["de"] * 7


def test_words_are_letters_only():
    assert langid.words_of("½ ² ③ a1b x²y É_ñ Ⅷ 12ab ªº") == ["a", "b", "x", "y", "é", "ñ", "ab", "ªº"]
    assert langid.words_of("½ ² ③ Ⅷ 7 _") == langid.words_of(None) == []


def test_numbers_that_look_like_letters_have_no_language(spark):
    model = langid.train(awkward(spark).where("text like '%e%'"))
    rows = spark.createDataFrame([("½ ² ③",), ("Ⅷ ½",), ("one ½",)], "text string").select(langid.predict(spark, "text", model)["lang"]).collect()
    assert [r[0] == "und" for r in rows] == [True, True, False]


def test_sums_are_those_of_the_words():
    rows = [("the cat and the dog " * 9, "en"), ("der hund und die katze " * 9, "de"), ("le chat et le chien " * 9, "fr")] * 9
    model = langid.fit(langid.code_switched(rows, ("de", "en", "fr")), ("de", "en", "fr"), epochs=4)
    texts = [None, "", "½", "cat", "der cat et", " ".join(t for t, _ in rows[:20]) * 3, "hund " * 128, "chien " * 129, "zzz " * 500]
    words = langid.label_words(texts, model)
    counts, sums, tops = langid.text_sums(texts, model, langid._Words(model))
    assert counts.tolist() == list(map(len, words))
    np.testing.assert_allclose(sums, [w.sum(axis=0) for w in words], rtol=1e-3, atol=1e-3)
    np.testing.assert_allclose(tops, [w.max(axis=1).sum() if len(w) else 0 for w in words], rtol=1e-3, atol=1e-3)


def test_language_of_awkward_texts(spark):
    model = langid.train(awkward(spark).where("text like '%e%'"))
    rows = awkward(spark).select("doc_id", "text", langid.predict(spark, "text", model).alias("q")).collect()
    assert len(rows) == 12
    for r in rows:
        has_letters = any(c.isalpha() for c in r.text or "")
        assert (r.q.lang == "und") == (not has_letters)
        assert 0 <= r.q.score <= 1
    assert next(r.q.n_words for r in rows if r.doc_id == 4) == 30_000
    nothing = langid.train(empty(spark))
    assert {r[0] for r in awkward(spark).select(langid.predict(spark, "text", nothing)["lang"]).collect()} == {"und"}
    assert empty(spark).select(langid.predict(spark, "text", model)).count() == 0


def test_toxicity_of_held_out_documents(spark):
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rows = queries.op4_toxicity(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    for r in rows:
        assert r.held_out == (crc(r.doc_id, 3) == 1)
        assert r.predicted == int(r.score >= 0.7)
        assert 0 <= r.score <= 1
    held = [(r.predicted, toxic[r.doc_id]) for r in rows if r.held_out and toxic.get(r.doc_id) is not None]
    assert np.mean([p == t for p, t in held]) >= 0.93
    assert np.mean([p == 0 for p, t in held if t == 0]) >= 0.98


def test_pairing_spares_neutral_mentions():
    """Insults come with one group's name more often than with the other's; the name alone must not make a text toxic."""
    draw = np.random.default_rng(1)
    texts, labels = [], []
    for i in range(400):
        toxic = i % 2
        group = "muslim" if draw.random() < (0.9 if toxic else 0.1) else "christian"
        insult = {"vile"} if toxic and draw.random() < 0.7 else set()
        texts.append({group, f"w{draw.integers(20)}"} | insult)
        labels.append(toxic)
    gap = {}
    for pairing in (0.0, 50.0):
        model = toxicity.fit(texts, np.array(labels), ["vile", "muslim", "christian"], pairing=pairing)
        gap[pairing] = abs(model.score("a muslim family") - model.score("a christian family"))
        assert model.score("vile muslim") > 0.7
    assert gap[0.0] > 0.3
    assert gap[50.0] < 0.05


def test_toxicity_of_awkward_texts(spark):
    labels = spark.createDataFrame([(4, 0), (5, 1), (5, 1), (None, 1), (7, None), (6, 1), (8, 0), (3, 0)], "doc_id bigint, toxic int")
    model = toxicity.train(awkward(spark), labels)
    scores = [r[0] for r in awkward(spark).select(toxicity.score(spark, "text", model)).collect()]
    assert len(scores) == 12 and all(0 <= s <= 1 for s in scores)
    for some in (empty(spark), awkward(spark)):
        none = toxicity.train(some, labels.where("toxic > 5"))
        assert 0 <= none.score(None) <= 1
    assert 0 <= toxicity.train(awkward(spark), labels.where("toxic = 1")).score("x") <= 1


def test_features_of_many_words():
    """The features of words hashed together are those of each word, and their rows the sums of its weights."""
    words = ["a", "straße", "naïve", "漢字", "𝒳yz", "aaaaaaa", "x" * 40, "été", "mañana", *(f"{chr(97 + i % 26)}w{'oé'[i % 2] * (i % 7)}" for i in range(200))]
    words = list(dict.fromkeys(words))
    number, listed = langid.listed_features(words)
    assert list(zip(number.tolist(), listed.tolist(), strict=True)) == [(i, f) for i, w in enumerate(words) for f in sorted(set(langid.features(w)))]
    weights = np.random.default_rng(3).normal(size=(langid.BUCKETS, 3))
    known = langid._Words(langid.Model(("a", "b", "c"), weights, np.zeros((3, 3)), np.zeros(3)))
    numbers = [known[w] for w in words[:50]] + [known[w] for w in reversed(words)]
    want = [weights[sorted(set(langid.features(w)))].sum(axis=0) for w in (*words[:50], *reversed(words))]
    assert np.allclose(known.emissions()[numbers], want, atol=1e-5)
