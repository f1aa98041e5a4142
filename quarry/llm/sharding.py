"""Best-fit-decreasing sharding of indivisible groups into fixed-capacity shards.

Groups are the rows with equal text.  Spark sums the groups and counts them by size class; the
best-fit-decreasing packing then runs over size classes, largest first, and moves whole runs of a
class at a time: the tightest bin with room takes as many groups of the class as fit, because it
stays the tightest until it is full.  So the packing costs (classes + bins) tree operations however
many groups there are, and the number of classes is bounded (see ``size_class``).
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import quoted, written

# Sizes below 2^EXACT_BITS are classes of their own; above it, classes keep EXACT_BITS leading
# bits (rounded up).  At most 2^EXACT_BITS * (64 - EXACT_BITS) / 2 + 2^EXACT_BITS classes in all,
# of two longs each: about 1.7 million rows for 64-bit sizes, 230,000 up to 10^9 bytes.
EXACT_BITS = 16


def size_class(size: Column) -> Column:
    """Size rounded up to ``EXACT_BITS`` significant bits: an upper bound within 1/32768."""
    shift = F.greatest(F.lit(0), F.length(F.bin(size)) - EXACT_BITS)
    step = F.call_function("shiftleft", F.lit(1).cast("long"), shift)
    return F.call_function("shiftleft", F.floor((size + step - 1) / step).cast("long"), shift)


class BinTree:
    """Balanced tree (treap) of (remaining capacity, bin): insert, delete, least entry at or above."""

    def __init__(self, seed: int = 7):
        self.root, self.rng = None, random.Random(seed)

    def _split(self, node, key):
        """(entries < key, entries >= key)."""
        if node is None:
            return None, None
        if node[0] < key:
            low, high = self._split(node[3], key)
            return (node[0], node[1], node[2], low), high
        low, high = self._split(node[2], key)
        return low, (node[0], node[1], high, node[3])

    def _merge(self, a, b):
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            return a[0], a[1], a[2], self._merge(a[3], b)
        return b[0], b[1], self._merge(a, b[2]), b[3]

    def insert(self, key):
        low, high = self._split(self.root, key)
        self.root = self._merge(self._merge(low, (key, self.rng.random(), None, None)), high)

    def delete(self, key):
        low, rest = self._split(self.root, key)
        _, high = self._split(rest, (key[0], key[1] + 1))
        self.root = self._merge(low, high)

    def ceiling(self, key):
        """Least entry >= key, or None."""
        node, best = self.root, None
        while node is not None:
            if node[0] >= key:
                node, best = node[2], node[0]
            else:
                node = node[3]
        return best


def best_fit_decreasing(classes: list[tuple[int, int]], capacity: int, bins: int | None = None):
    """Pack (size, count) classes; returns (runs, bins used) with runs (size, first, last, bin).

    Groups of a size are numbered from 0; a run puts groups first..last (exclusive) into a bin.
    With ``bins`` given, None is returned when they do not all fit; without it bins are opened as
    needed.  A size above the capacity gets a bin of its own.
    """
    tree, runs, used = BinTree(), [], 0
    if bins:
        for b in range(bins):
            tree.insert((capacity, b))
        used = bins
    for size, count in sorted(classes, reverse=True):
        at = 0
        while at < count:
            found = tree.ceiling((size, -1))
            if found is None:
                if bins:
                    return None
                tree.insert((max(capacity, size), used))
                used += 1
                continue
            room, b = found
            take = min(count - at, room // size) if size else count - at
            tree.delete(found)
            tree.insert((room - take * size, b))
            runs.append((size, at, at + take, b))
            at += take
    return runs, used


def even_packing(classes: list[tuple[int, int]], shards: int):
    """Best-fit-decreasing runs for exactly ``shards`` bins at the least capacity that works.

    The capacity starts at the mean load and grows by a doubling fraction of it until everything
    fits (a capacity of the whole load always does).
    """
    total = sum(s * n for s, n in classes)
    mean, slack = -(-total // shards), 0
    while True:
        done = best_fit_decreasing(classes, max(1, mean + slack), shards)
        if done:
            return done[0]
        slack = max(slack * 2, mean // 20000, 1)


def best_fit_shards(docs: DataFrame, shards: int | None = 24, capacity: int | None = None, id_col: str = "doc_id",
                    text_col: str = "text", overhead: int = 8, buckets: int = 256) -> DataFrame:
    """Shard and slot of every row: doc_id, size, text_crc32, shard, slot.

    size is the UTF-8 length of the text (NULL: none) plus ``overhead``.  Give ``shards`` (shard
    sizes as equal as whole groups allow) or ``capacity`` (the fewest shards best-fit-decreasing
    finds).  Rows with equal text stay in one shard; only a group larger than a whole shard (the mean
    load, or the capacity) is cut, by doc_id hash into parts of about an eighth of a shard.  NULL
    text groups with empty text.  Slots number each shard's rows without gaps from 0 in
    (doc_id hash bucket, doc_id) order.  An empty table gives an empty result.
    """
    t = docs.select(quoted(id_col).alias("doc_id"), F.coalesce(quoted(text_col), F.lit("")).alias("t"))
    t = t.select("doc_id", (F.octet_length("t") + overhead).cast("long").alias("size"),
                 F.crc32(F.col("t").cast("binary")).alias("text_crc32"),
                 F.xxhash64("t").alias("h1"), F.xxhash64(F.lit(17), "t").alias("h2"))
    rows = written(t, "shard-rows")
    same = ["h1", "h2", "size"]
    groups = rows.groupBy(*same).agg((F.sum("size")).alias("bytes"))
    total = rows.agg(F.sum("size").alias("n")).first()["n"] or 0
    limit = capacity or max(1, -(-total // shards))
    # fewer than total / limit groups can be larger than the limit: no more than there are shards
    cut = F.broadcast(groups.where(F.col("bytes") > limit).select(
        *same, F.ceil(F.col("bytes") / F.lit(max(1, limit // 8))).cast("int").alias("parts")))
    parted = rows.join(cut, same, "left").withColumn(
        "part", F.when(F.col("parts").isNull(), F.lit(0)).otherwise(
            F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.col("parts")).cast("int"))).drop("parts")
    same = [*same, "part"]
    sized = parted.groupBy(*same).agg(F.sum("size").alias("bytes"))
    bucket = F.pmod(F.xxhash64("h1", "h2", "part"), F.lit(buckets)).cast("int")
    sized = sized.select(*same, size_class(F.col("bytes")).alias("class"), bucket.alias("bucket"))
    sized = written(sized, "shard-groups")
    # rank of a group in its class: offset of its hash bucket plus its place in it
    counts = sized.groupBy("class", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("class").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("class", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("off"))
    place = F.row_number().over(Window.partitionBy("class", "bucket").orderBy("h1", "h2", "part", "size")) - 1
    ranked = sized.withColumn("place", place).join(offsets, ["class", "bucket"]).withColumn(
        "rank", F.col("off") + F.col("place"))
    classes = [(r["class"], r["n"]) for r in counts.groupBy("class").agg(F.sum("n").alias("n")).collect()]
    runs = best_fit_decreasing(classes, capacity)[0] if capacity else even_packing(classes, shards)
    plan = docs.sparkSession.createDataFrame(runs, "class long, lo long, hi long, shard int")
    # one row per class and bin boundary: at most classes + bins rows, bounded as in size_class
    put = ranked.join(F.broadcast(plan), "class").where("rank >= lo and rank < hi").select(*same, "shard")
    placed = parted.join(put, same)
    # slots: offset of (shard, bucket) plus the place in it; the bucket comes from the doc_id
    slot_bucket = F.pmod(F.xxhash64(F.lit(3), "doc_id", "text_crc32"), F.lit(buckets)).cast("int")
    placed = written(placed.select("doc_id", "size", "text_crc32", "shard", slot_bucket.alias("bucket")), "shard-placed")
    counts = placed.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("off"))
    place = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32")) - 1
    return (placed.withColumn("place", place).join(offsets, ["shard", "bucket"])
            .select("doc_id", "size", "text_crc32", "shard", (F.col("off") + F.col("place")).cast("long").alias("slot")))
