"""Near-duplicate classes by Order MinHash and banded alignment.

The k-mers are shingles of five words, labelled by occurrence (the second copy of a shingle in a
text is another k-mer).  Each of ``BANDS`` hash orders samples the ``PICK`` least labelled shingles
and keeps them in text order; texts that share a sample are candidates.  A candidate pair is
verified by aligning the two shingle sequences inside the band that the similarity allows.

Equal texts are one node from the start.  Inside a bucket no pairs are expanded: every member meets
the bucket's least and greatest member, first the one it shares most buckets with, then those that
no chain of links joins to it yet.  Texts of a bucket that then still holds several components are
dealt to finer buckets, one for each of their rarest shingles: texts similar enough share one, texts
that only share a common passage do not.  There the members are compared by sizes and shingle parities
where they are grouped, and only pairs that these bounds allow are verified: first each member's
nearest, then all that lie in different components still.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import discard, quoted, written

WORDS = 5
BANDS = 24
PICK = 4
SLOTS = 1 << 20
KEPT = 1 << 20  # powers that a worker keeps from text to text
PARITY = 16  # longs of a text's parity sketch
TILE = 1024  # members of a bucket that one task compares with as many others
EDGES = 1 << 20  # links that a task joins to components at once
# A character that str.split() takes for part of a word.
NO_SPACE = r"[^\x09-\x0d\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
BASE = np.uint64(0x9E3779B97F4A7C15)
ODD = (np.random.default_rng(20).integers(1, 1 << 63, BANDS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a 64-bit hash."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse mod 2 ** 64 for i < n; a worker keeps them up to KEPT only."""
    if len(_POWERS[0]) >= n:
        return _POWERS[0][:n], _POWERS[1][:n]
    size = 1 << int(n - 1).bit_length()
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    made = [np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, b), dtype=np.uint64)]) for b in (BASE, inverse)]
    if size <= KEPT:
        _POWERS[:] = made
    return made[0][:n], made[1][:n]


def shingles(text: str) -> np.ndarray:
    """Occurrence-labelled hashes of the five-word shingles of a text, in text order.

    Words are lower-cased runs between white space; a text of one to four words has one shingle.
    """
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    raw = np.frombuffer((" ".join(words) + " ").encode("utf-8", "surrogatepass"), np.uint8)
    up, down = powers(len(raw) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:len(raw)], dtype=np.uint64)])
    ends = np.flatnonzero(raw == 32)
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(WORDS, len(words))
    starts, ends = starts[:len(words) - k + 1], ends[k - 1:]
    return labelled(mix((total[ends] - total[starts]) * down[starts]))


def labelled(h: np.ndarray) -> np.ndarray:
    """Mixes each hash with the number of equal hashes before it."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    new = np.concatenate([[True], s[1:] != s[:-1]])
    if new.all():
        return h
    first = np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))
    seen = np.empty(len(s), np.uint64)
    seen[order] = (np.arange(len(s)) - first).astype(np.uint64)
    return np.where(seen > 0, mix(h + seen * BASE), h)


def order_minhash(h: np.ndarray, bands: int = BANDS, pick: int = PICK) -> np.ndarray:
    """One 64-bit key per band: the ``pick`` least labelled shingles of the band's order, in text order."""
    keys = np.empty(bands, np.uint64)
    step = max(1, (1 << 20) // max(1, len(h)))
    for a in range(0, bands, step):
        value = h[None, :] * ODD[a:a + step, None]
        if len(h) > pick:
            at = np.sort(np.argpartition(value, pick - 1, axis=1)[:, :pick], axis=1)
        else:
            at = np.broadcast_to(np.arange(len(h)), value.shape)
        key = np.arange(a, a + len(value), dtype=np.uint64) + np.uint64(1)
        for c in range(at.shape[1]):
            key = mix(key * BASE + h[at[:, c]])
        keys[a:a + step] = key
    return keys


def parities(h: np.ndarray) -> np.ndarray:
    """One bit for each of 64 * PARITY hash slots: whether an odd number of the shingles lies in it."""
    odd = np.bincount((h % np.uint64(64 * PARITY)).astype(np.int64), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def may_reach(na: str, nb: str, pa_: str, pb: str, least: float) -> Column:
    """False for pairs that cannot reach ``least``, by their sizes or parities alone.

    A pair that reaches it leaves at most (n + m) * (1 - least) / (1 + least) shingles unmatched, and
    each slot whose parities differ holds one of them.
    """
    differ = F.lit(0)
    for k in range(PARITY):
        differ = differ + F.bit_count(F.col(pa_)[k].bitwiseXOR(F.col(pb)[k]))
    unmatched = (F.col(na) + F.col(nb)) * ((1 - least) / (1 + least)) + 1e-6
    return (F.least(na, nb) >= least * F.greatest(na, nb) - 1e-6) & (differ <= unmatched)


def aligned_similarity(a: np.ndarray, b: np.ndarray, least: float) -> float:
    """Shared shingles of the best order-keeping alignment over all shingles of both texts.

    Labelled shingles are unique within a text, so the alignment is a longest increasing run of
    places.  Only places inside the band count: a pair that reaches ``least`` leaves at most
    (n + m) * (1 - least) / (1 + least) shingles unmatched, so no match of it lies further off the
    diagonal.  Returns 0 for pairs that cannot reach ``least``.
    """
    n, m = len(a), len(b)
    need = least / (1 + least) * (n + m) - 1e-9
    if not n or not m or min(n, m) < need:
        return 0.0
    order = np.argsort(b, kind="stable")
    at = np.searchsorted(b, a, sorter=order)
    at = order[np.minimum(at, m - 1)]
    match = b[at] == a
    places, own = at[match], np.flatnonzero(match)
    near = np.abs(places - own) <= (n + m) * (1 - least) / (1 + least) + 1
    places = places[near]
    if len(places) < need:
        return 0.0
    if (np.diff(places) > 0).all():
        run = len(places)
    else:
        tails: list[int] = []
        for p in places.tolist():
            k = bisect_left(tails, p)
            tails[k:k + 1] = [p]
        run = len(tails)
    return run / (n + m - run) if run >= need else 0.0


def identity(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(29), text).alias("h2")]


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, h1, h2 (identity of the text), n (shingles), keys (one per band), parity; both NULL without words."""
    t = docs.select(quoted(id_col).cast("long").alias("doc_id"), F.coalesce(quoted(text_col), F.lit("")).alias("text"))
    t = t.select("doc_id", "text", *identity(F.col("text")))

    def body(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            n, keys, odd = [], [], []
            for text in b.column("text").to_pylist():
                h = shingles(text)
                n.append(len(h))
                keys.append(order_minhash(h).view(np.int64) if len(h) else None)
                odd.append(parities(h) if len(h) else None)
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("h1"), b.column("h2"), pa.array(n, pa.int64()),
                                              pa.array(keys, longs), pa.array(odd, longs)],
                                             ["doc_id", "h1", "h2", "n", "keys", "parity"])

    return t.mapInArrow(body, "doc_id long, h1 long, h2 long, n long, keys array<long>, parity array<long>")


def text_nodes(rows: DataFrame) -> DataFrame:
    """One row per different text with words: node, h1, h2, n, keys, parity.

    node is the least doc_id of the text; a text without an id, or whose id also names another
    text, goes by its hash.
    """
    t = rows.where("n > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("keys").alias("keys"),
                                                   F.first("parity").alias("parity"))
    shared = F.count(F.lit(1)).over(Window.partitionBy(F.coalesce("id", "h1"))) > 1
    return t.select(F.when(F.col("id").isNull() | shared, F.col("h1")).otherwise(F.col("id")).alias("node"), "h1", "h2", "n", "keys", "parity")


def with_hubs(buckets: DataFrame) -> DataFrame:
    """Members (key, node) of buckets of two or more, with the bucket's least and greatest node (lo, hi).

    The hubs come from partial aggregates; the join back is one that Spark can split by size.
    """
    hubs = buckets.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi")
    return buckets.join(hubs, "key")


def ordered(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def first_pairs(members: DataFrame) -> DataFrame:
    """One pair for each member: with the hub that it meets in most buckets (the least such)."""
    return members.where("node != lo").groupBy("node").agg(F.mode("lo", True).alias("a")).select("a", F.col("node").alias("b"))


def hub_pairs(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs a < b of members and their hubs that no chain of links joins yet."""
    pairs = members.where("node != lo").select(*ordered("node", "lo")).unionByName(
        members.where("node != hi").select(*ordered("node", "hi"))).distinct()
    return apart(pairs, "a", "b", roots)


def apart(rows: DataFrame, x: str, y: str, roots: DataFrame) -> DataFrame:
    """The rows whose two nodes lie in different components."""
    of = lambda c, out: roots.select(F.col("node").alias(c), F.col("root").alias(out))
    j = rows.join(of(x, "__rx"), x, "left").join(of(y, "__ry"), y, "left")
    return j.where(F.coalesce("__rx", x) != F.coalesce("__ry", y)).select(*rows.columns)


def rows_of(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row of ``docs`` for each wanted node (node, h1, h2), with ``__node``: the row that gave the
    node its id, or any row of a text that goes by its hash.

    Texts are filtered where they are read by a table of SLOTS hash slots (its size is bounded by
    construction, whatever the corpus), so that few others are shuffled; the joins that follow are
    exact.  Joining by id and text keeps the copies of a text apart.
    """
    a, b = identity(F.coalesce(quoted(text_col), F.lit("")))
    slot = lambda *c: F.pmod(F.xxhash64(*c), F.lit(SLOTS)).alias("__slot")
    on = ["__name", "__h1", "__h2"]
    # a row answers to its id and to the hash of its text
    t = docs.select("*", a.alias("__h1"), b.alias("__h2"), quoted(id_col).cast("long").alias("__id"))
    t = t.select("*", F.explode(F.array("__id", "__h1")).alias("__name")).select("*", slot("__name", "__h1"))
    slots = F.broadcast(wanted.select(slot("node", "h1")).distinct())  # at most SLOTS rows
    n = wanted.select(*[F.col(k).alias(c) for k, c in zip(["node", "h1", "h2"], on, strict=True)], F.col("node").alias("__node"))
    one = F.row_number().over(Window.partitionBy(*on).orderBy(F.lit(1)))
    found = t.join(slots, "__slot", "left_semi").join(n, on).withColumn("__row", one)
    return found.where("__row = 1").select(*[quoted(c) for c in docs.columns], "__node")


def texts_of(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, name: str) -> DataFrame:
    """node, text of the wanted nodes (node, h1, h2)."""
    found = rows_of(docs, wanted, id_col, text_col)
    return written(found.select(F.col("__node").alias("node"), F.coalesce(quoted(text_col), F.lit("")).alias("text")), name)


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str, least: float) -> DataFrame:
    """The pairs whose aligned similarity reaches ``least``; texts are read for those that the bounds allow only."""
    side = lambda c: nodes.select(F.col("node").alias(c), F.col("n").alias("n" + c), F.col("parity").alias("p" + c),
                                  F.struct("node", "h1", "h2").alias("of" + c))
    p = pairs.join(side("b"), "b").join(side("a"), "a").where(may_reach("na", "nb", "pa", "pb", least))
    p = written(p.select("a", "b", "ofa", "ofb"), "pairs")
    if p.isEmpty():
        return p.select("a", "b")
    texts = texts_of(docs, p.select(F.explode(F.array("ofa", "ofb")).alias("of")).select("of.*").distinct(), id_col, text_col, "pair-texts")
    found = aligned(p.select("a", "b"), texts, least)
    discard(p, texts)
    return found


def aligned(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs whose texts (node, text) have an aligned similarity of ``least`` or more."""
    both = (pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
            .join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b"))

    def body(batches: Iterator[pa.RecordBatch]):
        cache: dict = {}

        def sequence(node, text):
            if node not in cache:
                while len(cache) >= 64:
                    cache.pop(next(iter(cache)))
                cache[node] = shingles(text)
            return cache[node]

        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("a", "b", "ta", "tb")]
            keep = [aligned_similarity(sequence(x, s), sequence(y, t), least) >= least for x, y, s, t in zip(*cols, strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return written(both.select("a", "b", "ta", "tb").mapInArrow(body, "a long, b long"), "links")


def near_roots(links: DataFrame, jumps: int = 2) -> DataFrame:
    """node, root of the nodes b of links with one a for each b: a node of the same component, found in a fixed few steps.

    Each node takes its a, then that one's, and so on.  Equal roots mean one component; different
    roots may still be one, so this only spares pairs that need no checking.
    """
    up = links.select(F.col("b").alias("node"), F.col("a").alias("root"))
    for _ in range(jumps):
        over = up.select(F.col("node").alias("root"), F.col("root").alias("__up"))
        up = written(up.join(over, "root", "left").select("node", F.coalesce("__up", "root").alias("root")), "roots")
    return up


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some links, ascending, and the least node of each one's component."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    x, y, root = at[:len(u)], at[len(u):], np.arange(len(ids))
    while (root[x] != root[y]).any():
        low = np.minimum(root[x], root[y])
        up = np.arange(len(ids))
        np.minimum.at(up, root[x], low)
        np.minimum.at(up, root[y], low)
        while (up[up] != up).any():
            up = up[up]
        root = up[root]
    return ids, ids[root]


def contracted(edges: DataFrame) -> DataFrame:
    """Links (u, v), u > v, that join the same nodes, never more: those that lie in one task become stars around their least node.

    A task holds EDGES links at once.  The last u of a piece and its root stand in the next piece, so
    links that are sorted by u meet all others of their u.
    """
    def stars(u, v):
        node, root = forest(u, v)
        kept = node != root
        return pa.RecordBatch.from_arrays([pa.array(node[kept]), pa.array(root[kept])], ["u", "v"]), root[np.searchsorted(node, u[-1])]

    def body(batches: Iterator[pa.RecordBatch]):
        held, n = [], 0
        for b in batches:
            held.append([b.column(c).to_numpy() for c in ("u", "v")])
            n += b.num_rows
            if n >= EDGES:
                u, v = map(np.concatenate, zip(*held, strict=True))
                found, root = stars(u, v)
                yield found
                held, n = [[u[-1:], np.array([root])]], 1
        if n:
            yield stars(*map(np.concatenate, zip(*held, strict=True)))[0]

    return edges.select("u", "v").mapInArrow(body, "u long, v long")


def components(links: DataFrame) -> DataFrame:
    """node, root (least node of its component) for every linked node, as a written table.

    Links become stars wherever they lie.  While a node still has two links to lesser nodes, or a
    centre has one, each link to a centre goes to the centre's least node and the links of a node
    meet in one task to become stars again.  Every round drops links or lowers their ends; tables are
    written, so no lineage grows.
    """
    edges = written(contracted(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))), "edges")
    while True:
        to = edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")))
        up = written(to.groupBy("node").agg(F.min("root").alias("root"), F.max("root").alias("other")), "roots")
        if up.where("root != other").isEmpty():
            discard(edges)
            return up.select("node", "root")
        over = up.select(F.col("node").alias("v"), "root")
        moved = edges.join(over, "v").select("u", F.col("root").alias("v")).repartition("u").sortWithinPartitions("u")
        last, edges = edges, written(contracted(moved), "edges")
        discard(last, up)


def mixed(buckets: DataFrame, roots: DataFrame) -> DataFrame:
    """Members of the buckets that hold several components, with their root and the bucket's number of members."""
    j = buckets.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    several = j.groupBy("key").agg(F.min("root").alias("__lo"), F.max("root").alias("__hi"), F.count(F.lit(1)).alias("members"))
    return j.join(several.where("__lo < __hi").select("key", "members"), "key").select(*buckets.columns, "root", "members")


def rare_shingles(texts: DataFrame, least: float) -> DataFrame:
    """key, node, n, parity: the rarest shingles of each text (node, text), as many as make the comparison exact.

    Two texts of n and m shingles that reach ``least`` share least * max(n, m) of them or more, so under
    any one order of all shingles the first n - ceil(least * n) + 1 of one and of the other have one in
    common.  The order is rare first: by a table of counts over SLOTS hash slots (bounded whatever the
    corpus), then by hash.  A passage that many texts share stands last and makes no bucket unless it is
    most of the text.
    """
    def counted(batches: Iterator[pa.RecordBatch]):
        total = np.zeros(SLOTS, np.int64)
        for b in batches:
            for x in b.column("text"):
                total += np.bincount((shingles(x.as_py()) % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(total[held], pa.int64())], ["slot", "n"])

    slots = texts.select("text").mapInArrow(counted, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # at most SLOTS rows
    counts = np.zeros(SLOTS, np.int64)
    counts[slots.column("slot").to_numpy()] = slots.column("n").to_numpy()
    shared = texts.sparkSession.sparkContext.broadcast(counts)

    def body(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for at in range(b.num_rows):
                h = shingles(b.column("text")[at].as_py())
                n, odd = len(h), parities(h).tobytes()
                first = len(h) - math.ceil(least * len(h) - 1e-9) + 1
                h = h[np.lexsort((h, shared.value[(h % np.uint64(SLOTS)).astype(np.int64)]))][:first]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), *(pa.array([v] * len(h), pa.int64()) for v in (b.column("node")[at].as_py(), n)),
                     pa.array([odd] * len(h), pa.binary())], ["key", "node", "n", "parity"])

    return texts.select("node", "text").mapInArrow(body, "key long, node long, n long, parity binary")


def may_meet(root: np.ndarray, n: np.ndarray, odd: np.ndarray, x: np.ndarray, y: np.ndarray, least: float):
    """Places i in ``x`` and j in ``y`` of members of different components that ``may_reach`` allows, and the share of
    their shingles that surely differ; a piece at a time."""
    most = (1 - least) / (1 + least)
    rows = max(1, (1 << 16) // max(1, len(y)))
    for at in range(0, len(x), rows):
        part = x[at:at + rows]
        small, large = np.minimum(n[part, None], n[y]), np.maximum(n[part, None], n[y])
        i, j = np.nonzero((root[part, None] != root[y]) & (small >= least * large - 1e-6))
        i, j = part[i], y[j]
        differ = np.bitwise_count(odd[i] ^ odd[j]).sum(1, dtype=np.int64)
        both = n[i] + n[j]
        kept = differ <= both * most + 1e-6
        yield i[kept], j[kept], differ[kept] / both[kept]


def bucket_pairs(rest: DataFrame, least: float, nearest: bool) -> DataFrame:
    """Pairs a < b of members of one bucket (key, node, n, parity, root, members) in different components that ``may_reach`` allows.

    ``nearest`` gives for each member only the one whose parities differ least, of those it meets in one
    task.  Members are compared where they are grouped, so pairs that a bound excludes are never rows.
    Buckets of more than TILE members are dealt to tiles, and every two tiles meet in a group of their own.
    """
    tiles = F.ceil(F.col("members") / F.lit(TILE)).cast("int")
    t = rest.withColumn("tiles", tiles).withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    t = t.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    t = t.select("key", F.least("tile", "other").alias("lo"), F.greatest("tile", "other").alias("hi"), "tile", "node", "n", "root", "parity")
    groups = t.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")

    def compared(lo, hi, tile, node, n, root, odd):
        x, y = np.flatnonzero(tile == lo[0]), np.flatnonzero(tile == hi[0])
        found = [np.concatenate(p) for p in zip(*may_meet(root, n, odd, x, y, least), strict=True)] if len(x) and len(y) else []
        if not found or not len(found[0]):
            return None
        i, j, differ = found
        if nearest:
            order = np.argsort(differ, kind="stable")
            best = np.unique(np.concatenate([order[np.unique(v[order], return_index=True)[1]] for v in (i, j)]))
            i, j = i[best], j[best]
        pairs = np.unique(np.column_stack([np.minimum(node[i], node[j]), np.maximum(node[i], node[j])]), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    def columns(t: pa.Table):
        odd = np.frombuffer(b"".join(t.column("parity").to_pylist()), np.uint64).reshape(t.num_rows, PARITY)
        return [t.column("key").to_numpy(), *(t.column(c).to_numpy() for c in ("lo", "hi", "tile", "node", "n", "root")), odd]

    def body(batches: Iterator[pa.RecordBatch]):
        held: list = []  # the rows of the group that is still open: at most two tiles
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([*held, b])
            key, *rest = columns(t)
            new = np.flatnonzero((key[1:] != key[:-1]) | (rest[0][1:] != rest[0][:-1]) | (rest[1][1:] != rest[1][:-1])) + 1
            starts = np.concatenate([[0], new]).tolist()
            for low, high in zip(starts, starts[1:], strict=False):
                if (found := compared(*(v[low:high] for v in rest))) is not None:
                    yield found
            held = t.slice(starts[-1]).combine_chunks().to_batches()
        if held and (found := compared(*columns(pa.Table.from_batches(held))[1:])) is not None:
            yield found

    return groups.mapInArrow(body, "a long, b long").distinct()


def every_pair(members: DataFrame, nodes: DataFrame, links: DataFrame, docs: DataFrame, id_col: str, text_col: str, least: float) -> DataFrame:
    """node, root of the components once no two members of a bucket (key, node, lo, hi) are left to compare.

    Texts in buckets that still hold several components get finer buckets, one for each of their
    rarest shingles; texts that reach ``least`` share one.  First each member meets the one of each
    bucket that its parities are nearest to, which joins most of what belongs together; then every
    two members of different components meet unless a bound excludes them or they met before.
    """
    roots = components(links)
    # the least and greatest node of a bucket have met all its members
    still = mixed(members.where("node != lo and node != hi").select("key", "node"), roots).select("node").distinct()
    texts = texts_of(docs, nodes.join(still, "node").select("node", "h1", "h2"), id_col, text_col, "open-texts")
    rare = written(rare_shingles(texts, least), "rare")
    seen = None
    for nearest in (True, False):
        pairs = bucket_pairs(mixed(rare, roots), least, nearest)
        pairs = written(pairs if seen is None else pairs.join(seen, ["a", "b"], "left_anti"), "met")
        found = pairs if pairs.isEmpty() else aligned(pairs, texts, least)  # both bounds hold already
        if not found.isEmpty():
            roots = components(roots.where("node != root").select(F.col("root").alias("a"), F.col("node").alias("b")).unionByName(found))
        seen = pairs
    discard(rare, texts)
    return roots


def text_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8) -> DataFrame:
    """Class of every different text with words: h1, h2, node, class_id (least node linked to it)."""
    nodes = written(text_nodes(sketches(docs, id_col, text_col)), "nodes")
    check = lambda pairs: verified(pairs, nodes, docs, id_col, text_col, least)
    members = written(with_hubs(nodes.select("node", F.explode("keys").alias("key"))), "members")
    # most members of a class meet one hub again and again: that pair settles them
    links = check(first_pairs(members))
    # the other hubs, where they might join what is still apart
    links = links.unionByName(check(hub_pairs(members, near_roots(links))))
    # what is still apart: finer buckets, and new hubs until none has anything left to compare
    roots = every_pair(members, nodes, links, docs, id_col, text_col, least)
    return nodes.select("h1", "h2", "node").join(roots, "node", "left").select(
        "h1", "h2", "node", F.coalesce("root", "node").alias("class_id"))


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8) -> DataFrame:
    """doc_id, class_id: one row per input row.

    Rows share a class if their texts are equal or linked by a chain of pairs whose aligned
    similarity over five-word shingles is ``least`` or more.  class_id is the least doc_id of the
    class (the hash of a text that has no id or shares its id with another text takes part as its
    id).  NULL, empty and blank texts are never duplicates: their class is their own doc_id.
    """
    classes = text_classes(docs, id_col, text_col, least)
    t = docs.select(quoted(id_col).alias("doc_id"), *identity(F.coalesce(quoted(text_col), F.lit(""))))
    return t.join(classes, ["h1", "h2"], "left").select("doc_id", F.coalesce("class_id", F.col("doc_id").cast("long")).alias("class_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8) -> DataFrame:
    """``docs`` with one row of each near-duplicate class, that of its class_id; same columns.

    Texts without words all stay, but equal rows of them become one.
    """
    classes = text_classes(docs, id_col, text_col, least)
    kept = rows_of(docs, classes.where("node = class_id").select("node", "h1", "h2"), id_col, text_col).drop("__node")
    blank = docs.where(~F.coalesce(quoted(text_col), F.lit("")).rlike(NO_SPACE))
    return kept.unionByName(blank.distinct())
