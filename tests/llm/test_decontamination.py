"""Pigeonhole edit matching against a plain dynamic program."""

import random

import pytest
from quarry.llm import decontamination as D


def nearest(pattern, text):
    """(edits, first end) over all passages of text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, c in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (p != c)))
        row = new
    return min((v, j) for j, v in enumerate(row))


def test_myers():
    r = random.Random(2)
    for _ in range(300):
        p = "".join(r.choice("abc") for _ in range(r.randint(1, 90)))
        t = "".join(r.choice("abc") for _ in range(r.randint(0, 120)))
        best = nearest(p, t)
        got = D.myers_search(p, t, len(p))
        if best[0] < len(p) or got:
            assert got[0] == best[0] and (got[1] == best[1] or best[1] == 0)
        assert D.myers_search(p, t, best[0] - 1) is None


def edited(r, text, edits):
    s = list(text)
    for _ in range(edits):
        i = r.randrange(len(s))
        s[i:i + 1] = r.choice([["q"], [], [s[i], "z"]])
    return "".join(s)


def setup(seed=4):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8)))
    items = [(i, " ".join(word() for _ in range(r.randint(1, 40)))) for i in range(25)] + [(98, None), (99, ""), (97, " ?! ")]
    docs = []
    for i in range(80):
        t = " ".join(word() for _ in range(r.randint(0, 120)))
        if i % 2:
            item = items[i % 25][1]
            t += " " + edited(r, item, r.randint(0, len(item) // 12)) + " " + word()
        if i % 10 == 1:
            t = t.upper().replace(" ", ",\n ")
        docs.append((i, t))
    return items, docs + [(100, None), (101, ""), (3, docs[3][1]), (None, docs[3][1])]


@pytest.mark.parametrize("block_bytes", [32 << 20, 2000])
def test_against_brute_force(spark, block_bytes):
    items, docs = setup()
    want = set()
    for i, t in docs:
        text = D.normalise(t or "")
        for k, item in items:
            p = D.normalise(item or "")
            if len(p) >= 16 and text:
                e, end = nearest(p, text)
                if e <= max(1, len(p) // 16) - 1:
                    want.add((i, k, e))
    b = spark.createDataFrame(items, "item_id int, text string")
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' as item_id", "'y' as start").repartition(4)
    got = D.benchmark_matches(d, b, block_bytes=block_bytes).collect()
    assert {tuple(r)[:3] for r in got} == want and len(want) > 20
    texts = dict(docs)
    for r in got:
        assert abs(len(D.normalise(texts[r["doc_id"]][r["start"]:r["end"]])) - len(D.normalise(items[[k for k, _ in items].index(r["item_id"])][1]))) <= r["n_edits"]
    left = D.without_contaminated(d, b)
    hit = {w[0] for w in want}
    assert left.columns == d.columns and sorted((r[0] for r in left.collect()), key=str) == sorted((i for i, _ in docs if i not in hit), key=str)


def test_empty(spark, docs, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.benchmark_matches(docs, none).count() == 0
    assert D.benchmark_matches(empty, spark.createDataFrame([(1, "some words")], "item_id long, text string")).count() == 0
