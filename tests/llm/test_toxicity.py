"""Operator 3: the decoder on disguised words, and the scores on labels it has not seen."""

import itertools

import numpy as np
import pytest

from corvane.llm import toxicity
from corvane.llm.toxicity import Model, language_model, lattice, restore, tokens, trigrams


@pytest.fixture(scope="module")
def big(spark):
    return [spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels")]


@pytest.fixture(scope="module")
def model(big):
    return toxicity.train(*big)


def test_trigrams_are_counted_over_breaks():
    code = lambda s: [int(toxicity.CLASS[ord(c)]) for c in s]
    want = [tuple(code(s)) for s in ("  a", " ab", "ab ", "b c", " c ")]
    got = [(x // 784, x // 28 % 28, x % 28) for x in trigrams("Ab, c").tolist()]
    assert got == want
    assert trigrams("").size <= 1


def test_language_model_grows_with_the_corpus(big):
    docs = toxicity.columns(big[0], "doc_id", "text")
    lm = language_model(docs)
    assert np.allclose(np.exp(lm).sum(2), 1, atol=1e-6)


def test_viterbi_equals_trying_every_reading(model):
    for token in ("sc0mm", "1d10t", "w0rthl3ss", "s t u p", "stuuupid", "p@th"):
        best = None
        for path in itertools.product(*lattice(token)):
            text, cost, p, q = "", 0.0, 0, 0
            for reading, extra in [*path, (" ", 0.0)]:
                cost += extra
                for ch in reading:
                    x = int(toxicity.CLASS[ord(ch)])
                    if x == 0 and q == 0:
                        continue
                    cost -= model.lm[p, q, x]
                    p, q = q, x
                text += reading
            best = min(best, (cost, text.strip())) if best else (cost, text.strip())
        assert restore(token, model.lm)[0] == best[1]


def test_disguise(model):
    clean = "The of and thing anly there with"
    assert model.score(clean) < 0.1
    for word in ("stupid", "1d10t", "w0rthl3ss", "s t u p i d", "p4thetic", "stuuuuupid", "m.o.r.o.n", "tr@sh", "cl0wn", "Scum!", "sc-u-m"):
        assert model.score(f"{clean} {word} and the {clean}") > 0.5, word


def test_disguise_of_any_length_and_place(model):
    words = "the of and thing with there and the thing of there with the and thing".split()
    for join in (" ", "."):
        assert model.score(join.join("".join(words))) < 0.5
        for k in range(1, 14):
            for toxic in ("moron", "worthless", "idiot"):
                letters = "".join([*words[:k], toxic, *words[k:k + 5]])
                assert model.score(join.join(letters)) > 0.5, (join, k, toxic)
    assert model.score("the st" + "u" * 60 + "pid thing") > 0.5
    assert tokens("he is b a d and b o o b too a b") == ["he", "is", "b a d", "and", "b o o b", "too", "a", "b"]
    assert "ab" * 30 in model.features("ab" * 30)


def test_held_out_labels(spark, big, model):
    docs, labels = big
    rows = docs.join(labels, "doc_id").filter(toxicity.held_out(docs.doc_id)).select(
        "toxic", toxicity.score_column(spark, model, docs.text).alias("s")).collect()
    pos, neg = [r.s for r in rows if r.toxic], [r.s for r in rows if not r.toxic]
    assert len(pos) > 3
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert auc > 0.93  # a few labels stand on documents without any toxic word
    assert sum(n >= 0.5 for n in neg) <= 0.02 * len(neg)


def test_odd_rows(spark, odd, empty, model):
    rows = odd.select(toxicity.held_out(odd.doc_id).alias("h"), toxicity.score_column(spark, model, odd.text).alias("s")).collect()
    assert len(rows) == odd.count() and all(0 <= r.s < 0.5 and r.h is not None for r in rows)
    none = spark.createDataFrame([(None, 1), (1, None)], "doc_id long, toxic int")
    m = toxicity.train(odd, none)
    assert not m.weights and m.score("stupid") < 0.01
    assert toxicity.train(empty, none).score("") < 0.01


def test_spaced_letters():
    assert tokens("He is s t u p i d ok") == ["he", "is", "s t u p i d", "ok"]
    assert tokens("a a a a b") == ["a", "a", "a", "a", "b"]
    assert isinstance(Model(np.zeros((28, 28, 28))), Model)
