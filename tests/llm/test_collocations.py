"""Collocations against counting by hand, tiles against plain counts."""

import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from quarry.llm import collocations as co


def by_hand(rows, least, top, cover):
    count, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            total[lang or "und"] += len(w)
            for m in range(1, 5):
                count[lang or "und"].update(tuple(w[i:i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, c in count.items():
        kept = []
        for p, a in c.items():
            if len(p) < 2 or a < least:
                continue
            score, k = min((2000000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
            longer = [f for q, f in c.items() if len(q) > len(p) and f >= least and any(q[i:i + len(p)] == p for i in range(len(q)))]
            if not longer or 100 * max(longer) < cover * a:
                kept.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for i, (s, a, p, left, right) in enumerate(sorted(kept)[:top]):
            out.append((lang, i + 1, p.decode(), -a, left, right, total[lang], -s))
    return sorted(out)


def phrases(seed=4):
    r = random.Random(seed)
    words = ["new", "York", "é", "of", "the", "x y", "a", "b\x00c", "ÉCOLE", "z"]
    rows = []
    for i in range(160):
        text = ""
        for _ in range(r.randint(0, 60)):
            text += r.choice(["New York City", "of the", *words]) + r.choice([" ", "  ", "\t", " ", " ", ". ", "\n", ",", "\x0b"])
        rows.append((r.choice(["en", "en", "fr", None]), text))
    return [*rows, ("en", None), (None, ""), ("de", "one two"), ("xx", "again " * 90), rows[0], rows[0]]


@pytest.mark.parametrize(("block_words", "most_here", "least", "top", "cover"),
                         [(50, 0, 6, 25, 50), (700, 15, 30, 2000, 80), (1 << 20, 1 << 20, 30, 2000, 80)])
def test_equal_to_counting_by_hand(spark, block_words, most_here, least, top, cover):
    rows = phrases()
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    got = co.collocations(df, least, top, cover, block_words=block_words, most_here=most_here)
    assert sorted(map(tuple, got.collect())) == by_hand(rows, least, top, cover)
    assert [f.dataType.simpleString() for f in got.schema] == ["string", "bigint", "string"] + ["bigint"] * 5


def test_empty_and_clashing(empty, clash, docs):
    assert co.collocations(empty).count() == 0
    assert sorted(co.collocations(clash, 3).collect()) == sorted(co.collocations(docs, 3).collect())


def test_tiles_equal_plain_counts():
    r = np.random.default_rng(2)
    for n in (0, 1, 5000):
        left, right = (r.zipf(1.3, n) % 3000 - 1 + (r.zipf(1.3, n) % 3000 == 0) for _ in "lr")
        left, right = np.maximum(left, 0), np.maximum(right, 0)
        keys, counts = co.tile_counts(left, right, side=8, dense=4)
        want = Counter((left << co.SHIFT | right).tolist())
        assert dict(zip(keys.tolist(), counts.tolist(), strict=True)) == want and (np.diff(keys) > 0).all()


def test_slices_of_a_long_text(monkeypatch):
    text = "Ab c. d\te\x0bf! " * 500 + "g h"
    whole = [w for part in co.words_of(text) for w in part]
    monkeypatch.setattr(co, "SLICE", 16)
    parts = list(co.words_of(text))
    assert len(parts) > 100 and [w for p in parts for w in p] == whole and whole[:6] == [b"ab", b"c", b"\xff", b"d", b"e", b"\xff"]


def test_scores_beyond_64_bits(spark):
    big = 4_000_000_000_000_000_000
    found = spark.createDataFrame([("x", "a", 1, big), ("x", "b", 1, big), ("x", "a b", 2, big - 1)], "lang string, phrase string, size int, f long")
    assert co.scored(found).first()["score"] == 2000000 * (big - 1) // (2 * big)


def test_cells_are_plain_rows_in_bounded_batches(spark, monkeypatch):
    rows = phrases()
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    blocks = co.word_blocks(df, "text", "lang", 50)
    assert not [f.name for f in blocks.schema if f.dataType.typeName() == "array"]
    words = Counter()
    for r in blocks.where("key is not null").collect():
        words[r["lang"], r["key"]] += r["n"]
    want = Counter()
    for lang, text in rows:
        for part in co.words_of(text or ""):
            want.update((lang or "und", w.decode()) for w in part if w != co.BREAK)
    assert words == want
    co.collocations(df, 6).count()
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == was
    monkeypatch.setattr(co, "CELLS", 7)
    made = list(co.block_rows(5, "en", b"", b"b", b"", pa.array(range(30)), np.arange(30)))
    assert [b.num_rows for b in made] == [1, 7, 7, 7, 7, 2]
    assert [r["key"] for b in made for r in b.to_pylist() if r["base"] is None] == list(range(30))


def test_tiles_need_few_bytes_a_pair():
    r = np.random.default_rng(5)
    left, right = (r.integers(0, 100_000, 400_000) for _ in "lr")
    tracemalloc.start()
    co.tile_counts(left, right)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 72 * len(left)
