"""Language identification against plain kernel ridge regression and held-out labels."""

import numpy as np
import pytest

from quarry.llm import language_id as li
from quarry.llm.common import table
from quarry.llm.queries import op13_language_id

SF = "/root/testdata/sf0.01"


def grams_by_hand(text):
    plain = " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "
    return set() if plain == "  " else {plain[i:i + n] for n in (1, 2, 3) for i in range(len(plain) - n + 1)}


def key(gram):
    k = 0
    for c in gram:
        k = k << li.BITS | ord(c)
    return k


def test_ngrams_of_whole_texts(monkeypatch):
    for text in ("", "...", "Ab, ab1c", "éÈ ß\n😀x", "a" * 50, "The quick  brown_fox 12 jumps"):
        assert li.ngrams(text).tolist() == sorted(map(key, grams_by_hand(text)))
    text = "".join(chr(97 + i * i % 26) for i in range(500))
    whole = li.ngrams(text).tolist()
    monkeypatch.setattr(li, "SLICE", 7)
    assert li.ngrams(text).tolist() == whole


def test_kernel_and_weights_equal_plain_ones():
    texts = ["the cat sat", "the dog", "le chat noir", "un chien et un chat", "the dog"]
    sets, arrays = [grams_by_hand(t) for t in texts], [li.ngrams(t) for t in texts]
    want = np.array([[len(a & b) / np.sqrt(len(a) * len(b)) for b in sets] for a in sets])
    spectra = li.Spectra(arrays)
    k = spectra.kernel(arrays)
    assert np.allclose(k, want)
    # all texts as landmarks: Nyström is exact, so its ridge equals the kernel one
    y, root = np.array([[1.0], [1], [-1], [-1], [1]]), li.inverse_root(k)
    assert np.allclose(root @ root.T @ k @ k, k, atol=1e-4)
    features = k @ root
    got = features @ li.ridge(features, y, 0.1)
    assert np.allclose(got, k @ np.linalg.solve(k + 0.1 * np.eye(5), y), atol=1e-4)


@pytest.fixture(scope="module")
def small(spark):
    words = {"en": "the of and with this reading", "fr": "le des avec une lecture où", "de": "der und mit eine Lesung für"}
    rows = [(i, " ".join(w.split()[j % 6] for j in range(i, i + 4 + i % 9)), lang) for i in range(60) for lang, w in words.items()]
    return spark.createDataFrame([*rows, (900, None, "en"), (901, "", None), (902, "12 ...", "fr"), (None, "the of", None)],
                                 "doc_id long, text string, lang string")


def test_predictions_and_odd_rows(small):
    model = li.fit(small, max_train=60, landmarks=12)
    assert model["langs"] == ["de", "en", "fr"]
    got = li.predict(small, model).collect()
    assert len(got) == small.count()
    for r in got:
        if r["text"] is None or not any(c.isalpha() for c in r["text"]):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        else:
            assert r["lang_pred"] == (r["lang"] or "en") and 0.5 < r["score"] <= 1


def test_clashing_columns_empty_tables_and_long_texts(spark, clash, empty, small):
    model = li.fit(small, max_train=60, landmarks=12)
    out = li.predict(clash, model)
    assert out.columns.count("score") == 1 and out.select("score", "lang_pred").count() == clash.count()
    nothing = li.fit(empty)
    assert {r["lang_pred"] for r in li.predict(small, nothing).collect()} == {"und"}
    assert li.predict(empty, model).count() == 0
    long = spark.createDataFrame([(1, "avec une lecture " * 100_000)], "doc_id long, text string")
    assert li.predict(long, model).first()["lang_pred"] == "fr"


def test_training_counts_equal_texts_once(spark):
    rows = [("the same text", "en")] * 500 + [(f"text number {'abcdefghij'[i]}", "en") for i in range(10)]
    t = li.training_texts(spark.createDataFrame(rows, "text string, lang string"), "lang", "text", 4)
    assert t.count() == 4 and t.select("h").distinct().count() == 4


def test_held_out_accuracy(spark):
    labels = {r["doc_id"]: r["lang"] for r in table(spark, SF, "documents").select("doc_id", "lang").collect()}
    got = [r for r in op13_language_id(spark, SF).collect() if r["held_out"] and r["lang_pred"] != "und"]
    right = sum(labels[r["doc_id"]] == r["lang_pred"] for r in got)
    assert len(got) > 100 and right / len(got) > 0.97
