"""Quality rules, line dedup and sharding against plain Python."""

import re
import zlib
from collections import Counter, defaultdict

import pytest
from quarry.llm import line_dedup, quality_rules, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    w = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    wins = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
    c, cov = Counter(wins), set()
    for i, x in enumerate(wins):
        if c[x] > 1:
            cov.update(range(i, i + 8))
    n = len(w)
    return (n, sum(map(len, w)), sum(len(re.findall(r"[#*$%&|<>]", x)) for x in w), len(lines) - len(set(lines)),
            len(cov), n < 20 or 100 * len(cov) > 30 * n)


def key(rows):
    return sorted(rows, key=str)


def test_base_measures(docs, rows):
    got = [tuple(r) for r in quality_rules.base_measures(docs).collect()]
    assert key(got) == key([(r[0], *base(r[1])) for r in rows])


def removed_words(rows, limit):
    norm = lambda x: " ".join(WORD.findall(x.lower()))
    where = defaultdict(set)
    for i, t, _, host, _ in rows:
        for x in (t or "").split("\n"):
            if norm(x):
                where[host, norm(x)].add(t)
    out = defaultdict(int)
    for i, t, _, host, _ in rows:
        out[i] += sum(len(WORD.findall(x)) for x in (t or "").split("\n") if norm(x) and len(where[host, norm(x)]) > limit)
    copies = Counter(r[0] for r in rows)
    return {i: n // copies[i] for i, n in out.items()}


@pytest.mark.parametrize("limit", [0, 1, 2, 50])
def test_line_frequency(docs, rows, limit):
    got = quality_rules.quality_rules(docs, max_docs_per_host=limit).collect()
    lost = removed_words(rows, limit)
    want = []
    for r in rows:
        b = base(r[1])
        want.append((r[0], *b, lost[r[0]], not b[-1] and b[0] - lost[r[0]] >= 0.2 * b[0]))
    assert key(tuple(r) for r in got) == key(want)


def test_without_frequent_lines(docs, rows):
    got = quality_rules.without_frequent_lines(docs, max_docs_per_host=1)
    assert got.columns == docs.columns and got.count() == len(rows)
    assert got.where("text is null").count() == sum(r[1] is None for r in rows)


@pytest.mark.parametrize("min_sites", [2, 3, 6])
def test_line_dedup(docs, rows, min_sites):
    norm = lambda x: " ".join(WORD.findall(x.lower()))
    sites = defaultdict(set)
    for i, t, _, s, _ in rows:
        for x in (t or "").split("\n"):
            if norm(x) and s is not None:
                sites[norm(x)].add(s)
    want = []
    for i, t, _, _, _ in rows:
        parts = (t or "").split("\n")
        stay = [x for x in parts if not (norm(x) and len(sites[norm(x)]) >= min_sites)]
        n = len(WORD.findall(t or ""))
        if t is not None and n - len(WORD.findall("\n".join(stay))) <= 0.5 * n:
            new = "\n".join(stay)
            want.append((i, new, len([x for x in parts if norm(x)]), sum(bool(norm(x)) for x in parts) - sum(bool(norm(x)) for x in stay)))
        else:
            want.append((i, t, len([x for x in parts if norm(x)]), 0))
    got = line_dedup.remove_boilerplate(docs, min_sites=min_sites).select("doc_id", "text", "__n_lines", "__n_removed").collect()
    assert key(tuple(r) for r in got) == key(want)
    assert any(w[3] for w in want)


def test_best_fit_decreasing_equals_one_by_one():
    import random
    r = random.Random(3)
    for trial in range(60):
        classes = list(Counter(r.choice([1, 2, 3, 5, 8, 13, 40, 99]) for _ in range(r.randint(1, 80))).items())
        cap = r.randint(99, 200)
        runs, used = sharding.best_fit_decreasing(classes, cap)
        bins, placed = [], defaultdict(list)
        for size, n in sorted(classes, reverse=True):
            for _ in range(n):
                fits = [(room, b) for b, room in enumerate(bins) if room >= size]
                if not fits:
                    bins.append(cap)
                    fits = [(cap, len(bins) - 1)]
                b = min(fits)[1]
                bins[b] -= size
                placed[size].append(b)
        assert used == len(bins)
        for size, n in classes:
            assert [b for s, lo, hi, b in runs if s == size for _ in range(lo, hi)] == placed[size]


@pytest.mark.parametrize("shards", [1, 3, 24])
def test_shards(docs, rows, shards):
    got = sharding.best_fit_shards(docs, shards=shards).collect()
    size = lambda t: len((t or "").encode()) + 8
    assert key((r[0], r[1], r[2]) for r in got) == key((r[0], size(r[1]), zlib.crc32((r[1] or "").encode())) for r in rows)
    load, slots, where = Counter(), defaultdict(list), defaultdict(set)
    for r in got:
        load[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        where[r["text_crc32"], r["size"]].add(r["shard"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert set(load) <= set(range(shards))
    limit = -(-sum(load.values()) // shards)
    total = Counter((r["text_crc32"], r["size"]) for r in got)
    assert all(len(v) == 1 for k, v in where.items() if total[k] * k[1] <= limit)


def test_shards_by_capacity(docs, rows):
    got = sharding.best_fit_shards(docs, shards=None, capacity=31000).collect()
    load = Counter()
    for r in got:
        load[r["shard"]] += r["size"]
    assert len(got) == len(rows) and max(load.values()) <= 31000


def test_hot_group_is_cut(spark):
    d = spark.createDataFrame([(i, "same text" if i < 400 else f"text {i}", "s") for i in range(1000)], "doc_id long, text string, source string")
    load = Counter()
    for r in sharding.best_fit_shards(d, shards=10).collect():
        load[r["shard"]] += r["size"]
    assert max(load.values()) - min(load.values()) < 0.1 * max(load.values())


@pytest.mark.parametrize("run", [quality_rules.quality_rules, line_dedup.remove_boilerplate, sharding.best_fit_shards])
def test_empty_and_clashing(run, empty, docs, clash, rows):
    assert run(empty).count() == 0
    pick = lambda df: key(tuple(r) for r in df.select(*[c for c in df.columns if c in ("doc_id", "text", "kept", "shard", "slot", "size")]).collect())
    a, b = run(docs), run(clash)
    if run is line_dedup.remove_boilerplate:
        a, b = a.select("doc_id", "text"), b.select("doc_id", "text")
    assert pick(a) == pick(b) and a.count() == len(rows)
