"""Order MinHash classes against all-pairs alignment on small corpora."""

import random
from collections import Counter

import numpy as np
import pytest
from quarry.llm import near_dup as N


def tokens(text):
    w = text.lower().split()
    s = [tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))] if w else []
    seen, out = Counter(), []
    for x in s:
        seen[x] += 1
        out.append((x, seen[x]))
    return out


def similarity(a, b):
    """Longest common subsequence of the labelled shingles over their union, plain dynamic program."""
    if not a or not b:
        return 0.0
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(row[j - 1] + 1 if x == y else max(row[j], new[-1]))
        row = new
    return row[-1] / (len(a) + len(b) - row[-1])


def classes(rows, least=0.8):
    texts = sorted({r[1] for r in rows if r[1] and r[1].split()})
    tok = [tokens(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if min(len(tok[i]), len(tok[j])) >= least * max(len(tok[i]), len(tok[j])) and set(tok[i]) & set(tok[j]) \
                    and similarity(tok[i], tok[j]) >= least:
                root[find(i)] = find(j)
    return {t: find(i) for i, t in enumerate(texts)}


def family(seed=3):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghijkl") for _ in range(r.randint(2, 7)))
    passage = " ".join(word() for _ in range(25))
    out = []
    for f in range(14):
        base = [word() for _ in range(r.choice([3, 4, 5, 8, 30, 80, 150]))]
        for c in range(r.choice([1, 1, 2, 5, 9])):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 60))):
                w[r.randrange(len(w))] = word()
            text = " ".join(w)
            out.append(text if f % 3 else passage + " " + text)
    out += out[:6] + [" ".join(out[7].split()[::-1])] + ["A b\tc  d e f", "a b c d e f"]
    return [(i, t) for i, t in enumerate(out)]


def as_sets(pairs):
    by = {}
    for i, c in pairs:
        by.setdefault(c, set()).add(i)
    return sorted(map(sorted, by.values()))


@pytest.mark.parametrize("seed", [3, 8])
def test_classes_equal_all_pairs(spark, seed):
    rows = family(seed)
    want = classes(rows)
    d = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, h1 string, node string").repartition(5)
    got = [tuple(r) for r in N.near_duplicate_classes(d).collect()]
    assert as_sets(got) == as_sets([(i, want[t]) for i, t in rows])
    assert all(c == min(i for i, k in got if k == c) for c in {c for _, c in got})
    left = N.one_of_each(d)
    assert left.columns == d.columns and sorted(r["doc_id"] for r in left.collect()) == sorted({c for _, c in got})


def test_alignment():
    r = random.Random(5)
    for _ in range(200):
        a = [r.randrange(60) for _ in range(r.randint(0, 60))]
        b = [x if r.random() < 0.95 else r.randrange(60) for x in a]
        if r.random() < 0.3 and len(b) > 5:
            k = r.randrange(len(b))
            b = b[k:] + b[:k]
        lab = lambda s: N.labelled(N.mix(np.array(s, np.uint64) + np.uint64(1))) if s else np.zeros(0, np.uint64)
        pairs = lambda s: [(x, s[:i].count(x)) for i, x in enumerate(s)]
        for least in (0.5, 0.8):
            want = similarity(pairs(a), pairs(b))
            got = N.aligned_similarity(lab(a), lab(b), least)
            assert (got >= least) == (want >= least - 1e-12)
            if got >= least:
                assert abs(got - want) < 1e-9


def test_order_matters_and_labels_count():
    a, b = N.shingles("a b c d e f g h"), N.shingles("a b c d e a b c d e a b c d e")
    assert len(set(b.tolist())) == len(b) == 11 and len(a) == 4
    assert (N.order_minhash(a) != N.order_minhash(a[::-1].copy())).all()
    assert N.shingles(" \n").size == 0 and N.shingles("x y").size == 1


def test_components(spark):
    r = random.Random(2)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(160)] + [(i, i + 1) for i in range(400, 440)]
    links = [(min(p), max(p)) for p in links if p[0] != p[1]]
    root = {}
    for a, b in links:
        root.setdefault(a, a), root.setdefault(b, b)
    for _ in range(400):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    got = {x["node"]: x["root"] for x in N.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == root
    assert N.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_rows(docs, clash, empty, rows):
    got = N.near_duplicate_classes(docs).collect()
    assert sorted(map(str, (r["doc_id"] for r in got))) == sorted(str(r[0]) for r in rows)
    blank = {r[0] for r in rows if not (r[1] or "").split()}
    assert all(r["class_id"] == r["doc_id"] for r in got if r["doc_id"] in blank)
    assert sorted(map(str, N.near_duplicate_classes(clash).collect())) == sorted(map(str, got))
    kept = N.one_of_each(clash)
    assert kept.columns == clash.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == len(set(ids)) and {c for c in (r["class_id"] for r in got) if c is not None and abs(c) < 1000} == {i for i in ids if i is not None}
    assert N.near_duplicate_classes(empty).count() == 0 and N.one_of_each(empty).count() == 0


def test_one_id_for_several_texts(spark):
    long = " ".join(f"w{i}" for i in range(60))
    d = spark.createDataFrame([(1, long), (1, long + " more"), (1, "other text here"), (None, long + " end"), (2, "other text here"), (1, long)], "doc_id long, text string")
    got = N.near_duplicate_classes(d).collect()
    assert len(got) == 6 and len({r["class_id"] for r in got}) == 2
    assert N.one_of_each(d).count() == 2


def test_star_whose_original_has_a_middle_id(spark):
    """Variants near enough to the original but not to one another are all of its class."""
    r = random.Random(4)
    original = [f"w{r.randrange(10 ** 6)}" for _ in range(400)]
    texts = []
    for _ in range(60):
        w = list(original)
        for at in r.sample(range(0, 400, 10), 8):
            w[at + r.randrange(10)] = f"v{r.randrange(10 ** 9)}"
        texts.append(" ".join(w))
    s = [N.shingles(t) for t in texts]
    assert all(N.aligned_similarity(N.shingles(" ".join(original)), x, 0.8) for x in s)
    assert sum(N.aligned_similarity(s[i], s[j], 0.8) > 0 for i in range(60) for j in range(i)) < 20
    rows = [(i if i < 30 else i + 1, t) for i, t in enumerate(texts)] + [(30, " ".join(original))]
    got = N.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 61 and {r["class_id"] for r in got} == {0}


def test_bounds_keep_every_near_pair(spark):
    r = random.Random(6)
    rows = []
    for i in range(200):
        a = [f"w{r.randrange(400)}" for _ in range(r.choice([6, 30, 300]))]
        b = [x if r.random() < 0.97 else "new" for x in a] + ["end"] * r.randint(0, 3)
        x, y = N.shingles(" ".join(a)), N.shingles(" ".join(b))
        rows.append((i, len(x), len(y), N.parities(x).tolist(), N.parities(y).tolist(), N.aligned_similarity(x, y, 0.8) > 0))
    d = spark.createDataFrame(rows, "i long, na long, nb long, x array<long>, y array<long>, near boolean")
    got = d.withColumn("may", N.may_reach("na", "nb", "x", "y", 0.8)).collect()
    assert any(g["near"] for g in got) and any(not g["may"] for g in got)
    assert all(g["may"] for g in got if g["near"])


def test_a_common_passage_makes_no_rounds(spark, monkeypatch):
    """Texts that share a long passage but no more are never compared: their rarest shingles differ."""
    r = random.Random(7)
    word = lambda: f"w{r.randrange(10 ** 6)}"
    passage = [word() for _ in range(40)]
    rows = [(i, " ".join([*passage, *(word() for _ in range(20))])) for i in range(300)]
    rows += [(1000 + i, rows[i][1] + " tail") for i in range(20)]
    made = []
    plain = N.written
    monkeypatch.setattr(N, "written", lambda df, name, *more: made.append(name) or plain(df, name, *more))
    got = N.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(x["doc_id"], x["class_id"]) for x in got} == {(i, i) for i in range(300)} | {(1000 + i, i) for i in range(20)}
    assert made.count("hubs") <= 2


def test_rare_shingles_meet(spark):
    """Every two texts at the threshold share one of their rarest shingles, whatever the counts."""
    r = random.Random(9)
    rows, near = [], []
    for i in range(0, 120, 2):
        a = [f"w{r.randrange(300)}" for _ in range(r.choice([5, 12, 80]))]
        b = [x if r.random() < 0.98 else "new" for x in a] + ["end"] * r.randint(0, 2)
        rows += [(i, " ".join(a)), (i + 1, " ".join(b))]
        if N.aligned_similarity(N.shingles(rows[-2][1]), N.shingles(rows[-1][1]), 0.8) > 0:
            near.append((i, i + 1))
    keys = {}
    for x in N.rare_shingles(spark.createDataFrame(rows, "node long, text string"), 0.8).collect():
        keys.setdefault(x["node"], set()).add(x["key"])
    assert len(near) > 20 and all(keys[a] & keys[b] for a, b in near)


@pytest.mark.parametrize("tile", [3, 1024])
def test_members_of_a_bucket_meet_where_they_are_grouped(spark, monkeypatch, tile):
    """Only pairs that the bounds allow are rows, whatever the tiles; each member's nearest comes first."""
    monkeypatch.setattr(N, "TILE", tile)
    r = random.Random(11)
    base = [[f"w{r.randrange(10 ** 6)}" for _ in range(200)] for _ in range(6)]
    texts = [" ".join(w if r.random() < 0.993 else f"v{r.randrange(10 ** 6)}" for w in base[i % 6]) for i in range(40)]
    h = [N.shingles(t) for t in texts]
    odd = [N.parities(x).view(np.uint64) for x in h]  # bitwise_count takes absolute values of signed numbers
    rows = [(k, i, len(h[i]), bytearray(odd[i].tobytes()), i if i % 5 else 0, 40) for k in (1, 2) for i in range(40)]
    rest = spark.createDataFrame(rows, "key long, node long, n long, parity binary, root long, members long").repartition(7)
    most = 0.2 / 1.8
    may = {(i, j) for i in range(40) for j in range(i + 1, 40) if (i % 5 or j % 5)
           and min(len(h[i]), len(h[j])) >= 0.8 * max(len(h[i]), len(h[j])) - 1e-6
           and int(np.bitwise_count(odd[i] ^ odd[j]).sum()) <= (len(h[i]) + len(h[j])) * most + 1e-6}
    got = [(x["a"], x["b"]) for x in N.bucket_pairs(rest, 0.8, False).collect()]
    assert 20 < len(may) < 300 and len(got) == len(may) and set(got) == may
    near = {(x["a"], x["b"]) for x in N.bucket_pairs(rest, 0.8, True).collect()}
    assert near <= may and {i for p in near for i in p} == {i for p in may for i in p}


@pytest.mark.parametrize("edges", [5, 1 << 20])
def test_links_meet_in_few_passes(spark, monkeypatch, edges):
    """Links that are stars already take one pass; chains, shared leaves and pieces of a few links end in the same roots."""
    monkeypatch.setattr(N, "EDGES", edges)
    made = []
    plain = N.written
    monkeypatch.setattr(N, "written", lambda df, name, *more: made.append(name) or plain(df, name, *more))
    frame = lambda links: spark.createDataFrame(links, "a long, b long").repartition(6)
    stars = [(h, h + 1 + i) for h in (0, 1000, 2000) for i in range(200)]
    assert {x["node"]: x["root"] for x in N.components(frame(stars)).collect()} == {n: h for h, x in stars for n in (h, x)}
    assert made == ["edges", "roots"]
    made.clear()
    links = stars + [(3000 + i, 3001 + i) for i in range(60)] + [(50, 1050), (1060, 2060), (199, 5000), (-7, 5000)] + [(i, 9000) for i in range(4000, 4050)]
    want = {n: -7 for n in [-7, 5000, *(x for s in stars for x in s)]} | {3000 + i: 3000 for i in range(61)} | {n: 4000 for n in [9000, *range(4000, 4050)]}
    got = N.components(frame(links)).collect()
    assert len(got) == len(want) and {x["node"]: x["root"] for x in got} == want
    assert made.count("edges") <= 8


def test_forest_never_has_more_links():
    r = np.random.default_rng(4)
    for _ in range(50):
        x = r.integers(0, 80, (2, r.integers(1, 90)))
        x = x[:, x[0] != x[1]]
        if not x.size:
            continue
        node, root = N.forest(x.max(0), x.min(0))
        want = {n: n for n in x.ravel().tolist()}
        for _ in range(80):
            for a, b in x.T.tolist():
                want[a] = want[b] = min(want[a], want[b])
        assert dict(zip(node.tolist(), root.tolist(), strict=True)) == want and (node != root).sum() <= x.shape[1]


def test_open_texts_are_read_once(spark, monkeypatch):
    """Texts of finer buckets are fetched once, for their shingles and for every comparison that follows."""
    r = random.Random(4)
    original = [f"w{r.randrange(10 ** 6)}" for _ in range(400)]
    texts = []
    for _ in range(60):
        w = list(original)
        for at in r.sample(range(0, 400, 10), 8):
            w[at + r.randrange(10)] = f"v{r.randrange(10 ** 9)}"
        texts.append(" ".join(w))
    rows = [(i if i < 30 else i + 1, t) for i, t in enumerate(texts)] + [(30, " ".join(original))]
    made = []
    plain = N.written
    monkeypatch.setattr(N, "written", lambda df, name, *more: made.append(name) or plain(df, name, *more))
    N.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert made.count("met") == 2 and made.count("open-texts") == 1
    assert made.count("pair-texts") <= 2 and made.count("pairs") <= 2
    assert made.count("links") > made.count("pair-texts")


def test_first_pairs_take_the_hub_met_most(spark):
    rows = [(1, 9, 2), (2, 9, 2), (3, 9, 1), (4, 8, 3), (5, 8, 1), (6, 3, 3), (7, 8, 1), (8, 8, 3)]
    got = N.first_pairs(spark.createDataFrame(rows, "key long, node long, lo long")).collect()
    assert {(x["a"], x["b"]) for x in got} == {(2, 9), (1, 8)} and len(got) == 2
