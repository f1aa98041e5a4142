"""Weak labels: EM against known accuracies, the scorer against held-out labels, edge cases."""

import random

import numpy as np
from quarry.llm import classifier as C


def test_em_recovers_accuracies():
    r = random.Random(1)
    truth = [0.95, 0.9, 0.8, 0.7, 0.9, 0.85, 0.75, 0.8, 0.7, 0.9]
    counts, right = {}, []
    for _ in range(20000):
        good, code = r.random() < 0.7, 0
        for a in reversed(truth):
            v = 0 if r.random() < 0.2 else (C.GOOD if good == (r.random() < a) else C.BAD)
            code = code * 3 + v
        counts[code] = counts.get(code, 0) + 1
        right.append((code, good))
    post, accuracy, prior = C.label_model(counts)
    assert abs(prior - 0.7) < 0.03
    assert all(abs(a - b) < 0.05 for a, b in zip(accuracy.values(), truth, strict=True))
    assert np.mean([(post[c] > 0.5) == g for c, g in right]) > 0.95


def test_against_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    scored = C.score(docs, C.fit(docs)).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").select("score", "quality").collect()
    good, bad = [r[0] for r in scored if r[1] == 1], [r[0] for r in scored if r[1] == 0]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.95
    assert np.mean([g >= 0.5 for g in good]) > 0.98 and np.mean([b < 0.5 for b in bad]) > 0.85


def test_edges(spark, docs, clash, empty, rows):
    model = C.fit(docs)
    got = C.score(docs, model)
    assert got.columns == [*docs.columns, "score"] and got.count() == len(rows)
    assert all(r["score"] == 0 for r in got.where("text is null or text = ''").collect())
    again = C.score(clash.drop("score"), model).select("doc_id", "score").collect()
    assert sorted(map(str, again)) == sorted(map(str, got.select("doc_id", "score").collect()))
    assert C.score(empty, C.fit(empty)).count() == 0 and C.keep_good(empty).columns == empty.columns
    kept = C.keep_good(clash)
    assert kept.columns == clash.columns and 0 < kept.count() <= len(rows)
