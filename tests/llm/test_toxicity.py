"""Noisy-channel decoding against brute force, lexicon induction, held-out accuracy and edge cases."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from quarry.llm import toxicity as X


def model_of(texts):
    grams = {}
    for t in texts:
        c = [0, *X.classes_of(t.lower()).tolist(), 0]
        for a, b, d in zip(c, c[1:], c[2:], strict=False):
            k = (a * X.N_CLASSES + b) * X.N_CLASSES + d
            grams[k] = grams.get(k, 0) + 1
    return X.CharModel(grams)


@pytest.fixture(scope="module")
def model():
    return model_of(["an idiot and a loser met the stupid clown in the house of trash"] * 20 + ["worthless pathetic scum book look"] * 20)


def test_viterbi_is_optimal(model):
    r = random.Random(1)
    for _ in range(150):
        token = "".join(r.choice("abit01$o ll!33") for _ in range(r.randint(1, 7)))
        best = None
        for path in itertools.product(*X.lattice(token)):
            word, cost = "".join(p[0] for p in path), sum(p[1] for p in path)
            a = b = 0
            for c in [*map(X.letter_class, word), 0]:
                cost += model.cost(a, b, c)
                a, b = b, c
            best = min(best, cost) if best is not None else cost
        got = X.decode(token, model)
        a = b = 0
        least = min(sum(p[1] for p in path) for path in itertools.product(*X.lattice(token)) if "".join(p[0] for p in path) == got)
        for c in [*map(X.letter_class, got), 0]:
            least += model.cost(a, b, c)
            a, b = b, c
        assert abs(least - best) < 1e-9


@pytest.mark.parametrize("text,word", [("1d10t", "idiot"), ("l0ser!", "loser"), ("$tup1d", "stupid"), ("i d i o t", "idiot"),
                                       ("l.o.s.e.r", "loser"), ("idiooooot", "idiot"), ("LOOOSER", "loser"), ("tr@sh,", "trash"),
                                       ("s-c-u-m", "scum"), ("c l 0 w n", "clown"), ("w*o*r*t*h*l*e*s*s", "worthless")])
def test_restores(model, text, word):
    assert word in X.Words(model).forms(f"the {text} book")


@pytest.mark.parametrize("text,words", [
    ("he is a l o s e r", {"loser"}), ("s t u p i d i d i o t", {"stupid", "idiot"}), ("a s s", {"ass"}),
    (" ".join("scumandtrashandaloserandanidiotmetthestupidclown"), {"scum", "trash", "loser", "idiot", "stupid", "clown"}),
    ("idi" + "o" * 60 + "t", {"idiot"}), ("-".join("1d10tandal0ser"), {"idiot", "loser"})])
def test_restores_runs_of_any_length_and_several_words(text, words):
    r = random.Random(2)  # words that follow one another freely, as in a corpus
    known = "an idiot and a loser met the stupid clown in house of trash scum you are ass book look".split()
    model = model_of([" ".join(r.choice(known) for _ in range(2000))])
    assert words <= X.Words(model).forms(f"the {text}, book")


def test_decoding_is_linear(model):
    assert X.decode("idiot" * 20_000, model) == "idiot" * 20_000
    assert "idiot" in X.words_in("idiot" * 4_000, model)


def test_plain_words_stay(model):
    assert X.Words(model).forms("The book, LOOK!") == {"the", "book", "look"}


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet")
    m = X.fit(docs, labels, where=~X.held_out(F.col("id")))
    got = X.score(docs, m).join(labels, "doc_id").where(X.held_out(F.col("doc_id"))).select("score", "toxic").collect()
    s, y = np.array([r[0] for r in got]), np.array([r[1] for r in got])
    rank = s.argsort().argsort() + 1.0
    for v in np.unique(s):
        rank[s == v] = rank[s == v].mean()
    auc = (rank[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / ((y == 1).sum() * (y == 0).sum())
    assert auc > 0.93 and ((s >= 0.5) == (y == 1)).mean() > 0.97


def test_edges(spark, docs, clash, empty, rows):
    labels = spark.createDataFrame([(i, int(i in (87, 3))) for i in range(90)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    m = X.fit(docs, labels, least_docs=1)
    got = X.score(docs, m)
    assert got.columns == [*docs.columns, "score"] and got.count() == len(rows)
    assert all(0 <= r["score"] <= 1 for r in got.collect())
    again = X.score(clash.drop("score"), m).select("doc_id", "score")
    assert sorted(map(str, again.collect())) == sorted(map(str, got.select("doc_id", "score").collect()))
    none = X.fit(empty, labels.limit(0))
    assert X.score(empty, none).count() == 0 and len({r["score"] for r in X.score(docs, none).collect()}) == 1
