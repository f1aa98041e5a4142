"""Phrase collocations by direct-address tiling.

Words of a language are numbered by falling frequency, so pairs of frequent words crowd into the
first tiles of the id x id plane.  A tile that holds many pairs is counted with a dense bincount over
its cells, the others together as a sorted coordinate list.  Frequent pairs are numbered by frequency
again and take the place of the left word, which gives phrases of three words, then of four.

A task works in blocks of about a million words of one language and counts inside a block first.
Spark sums the blocks' counts, ranks what is frequent with a distributed index, and sends each block
the numbers of its own words or phrases; no vocabulary stands whole in one place.  In Spark a block
is one row of state and a plain row for each cell: an array of a million cells would be held whole,
several blocks at once, by whatever reads it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import discard, pack, quoted, unpack, written
from quarry.operators import order

BREAK = b"\xff"  # no byte of UTF-8
# Ends of pieces (fixed set) become breaks, tabs blanks.
PLAIN = bytes(0xFF if b in b".,;:!?\x0a\x0b\x0c\x0d" else 0x20 if b == 9 else b for b in range(256))
SIDE = 512  # ids along a side of a tile
DENSE = 16  # a tile is dense from one pair on DENSE cells
SHIFT = 31  # a pair's key: left id << SHIFT | right id
BLOCK_WORDS = 1 << 20
KEYS_HERE = 1 << 20  # frequent keys that are sent to every task
SLICE = 1 << 20  # bytes of a text split at once
CELLS = 1 << 15  # rows of an Arrow batch of cells
TEXTS, STATES = 1000, 2  # rows of an Arrow batch of texts, of blocks
LONGEST = 4


def words_of(text: str) -> Iterator[list[bytes]]:
    """Words of a text in order, BREAK between its pieces, in slices that end at a break."""
    raw = text.encode("utf-8", "surrogatepass").lower().translate(PLAIN)
    low = 0
    while low < len(raw):
        high = raw.find(BREAK, low + SLICE) if len(raw) - low > SLICE else -1
        high = len(raw) if high < 0 else high + 1
        yield raw[low:high].replace(BREAK, b" \xff ").split()
        low = high


def keys_of(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return left.astype(np.int64) << SHIFT | right


def tile_counts(left: np.ndarray, right: np.ndarray, side: int = SIDE, dense: int = DENSE) -> tuple[np.ndarray, np.ndarray]:
    """Different pairs as sorted keys, and how often each occurs."""
    if not len(left):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    tile = left.astype(np.int64)
    tile //= side
    tile *= int(right.max()) // side + 1
    tile += right // side
    by_tile = np.argsort(tile, kind="stable")
    tile, left, right = tile[by_tile], left[by_tile], right[by_tile]
    del by_tile
    first = np.flatnonzero(np.concatenate([[True], tile[1:] != tile[:-1]]))
    del tile
    size = np.diff(np.append(first, len(left)))
    sparse = np.ones(len(left), bool)
    keys, counts = [], []
    for low, n in zip(first[size * dense >= side * side].tolist(), size[size * dense >= side * side].tolist(), strict=True):
        part = slice(low, low + n)
        sparse[part] = False
        cells = np.bincount(left[part] % side * side + right[part] % side, minlength=side * side)
        held = np.flatnonzero(cells)
        keys.append((int(left[low]) // side * side + held // side) << SHIFT | int(right[low]) // side * side + held % side)
        counts.append(cells[held])
    key = keys_of(left[sparse], right[sparse])
    del left, right, sparse, first, size
    key.sort()
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[:len(key)])
    key, n = key[first], np.diff(np.append(first, len(key)))
    if not keys:
        return key, n
    keys, counts = np.concatenate([*keys, key]), np.concatenate([*counts, n])
    in_order = np.argsort(keys, kind="stable")
    return keys[in_order], counts[in_order]


def pairs_at(base: np.ndarray, gram: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, left ids, right ids) of the phrases of ``n`` words that may be frequent.

    base holds word ids + 1 and gram the ids + 1 of the frequent phrases of n - 1 words that start at
    a place; 0 is a break or something infrequent.  Both parts of n - 1 words must be frequent.
    """
    if len(base) < n:
        return (np.zeros(0, np.int64),) * 3
    left, right, rest = gram[:len(base) - n + 1], base[n - 1:], gram[1:len(base) - n + 2]
    at = np.flatnonzero((left > 0) & (right > 0) & (rest > 0))
    return at, left[at] - 1, right[at] - 1


class Words(dict):
    """Word -> place in order of appearance, from 1; a break is 0."""

    def __init__(self):
        super().__init__({BREAK: 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


BLOCK_COLUMNS = ["block", "lang", "words", "base", "gram", "key", "n"]
BLOCK_SCHEMA = "block long, lang string, words binary, base binary, gram binary, key {}, n long"
STATE, CELL = "base is not null", "key is not null"


def block_rows(block: int, lang: str, words: bytes, base: bytes, gram: bytes, keys: pa.Array, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A block's row of state, then a row for each of its cells in batches of ``CELLS`` at most."""
    none = pa.nulls(1, keys.type), pa.nulls(1, pa.int64())
    state = [pa.array([x], pa.binary()) for x in (words, base, gram)]
    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([lang], pa.string()), *state, *none], BLOCK_COLUMNS)
    for low in range(0, len(keys), CELLS):
        key = keys.slice(low, CELLS)
        of = [pa.repeat(pa.scalar(block, pa.int64()), len(key)), pa.repeat(pa.scalar(lang, pa.string()), len(key))]
        yield pa.RecordBatch.from_arrays([*of, *[pa.nulls(len(key), pa.binary())] * 3, key, pa.array(counts[low:low + CELLS], pa.int64())], BLOCK_COLUMNS)


@contextmanager
def arrow_rows(spark: SparkSession, most: int):
    """While open, Arrow batches that go to Python workers have ``most`` rows at most."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(name)
    spark.conf.set(name, str(min(most, int(was)) if int(was) > 0 else most))
    try:
        yield
    finally:
        spark.conf.set(name, was)


def word_blocks(docs: DataFrame, text_col: str, lang_col: str, block_words: int) -> DataFrame:
    """Blocks of texts of one language: base (places of words), words (joined by blanks, by place); a cell for each word."""
    t = docs.select(quoted(text_col).cast("string").alias("text"), F.coalesce(quoted(lang_col).cast("string"), F.lit("und")).alias("lang"))

    def rows(block: int, lang: str, words: Words, parts: list) -> Iterator[pa.RecordBatch]:
        places = np.concatenate(parts)
        counts = np.bincount(places, minlength=len(words))[1:]
        names = list(words)[1:]
        yield from block_rows(block, lang, b" ".join(names), pack(places), b"", pa.array(names, pa.binary()).cast(pa.string()), counts)

    def body(batches: Iterator[pa.RecordBatch]):
        made, open_blocks, size = TaskContext.get().partitionId() << 32, {}, {}

        def closed(lang: str) -> Iterator[pa.RecordBatch]:
            nonlocal made
            made += 1
            size.pop(lang)
            return rows(made, lang, *open_blocks.pop(lang))

        for batch in batches:
            for at in range(batch.num_rows):
                text, lang = batch.column("text")[at].as_py(), batch.column("lang")[at].as_py()
                for some in words_of(text or ""):
                    words, parts = open_blocks.setdefault(lang, (Words(), []))
                    parts.append(np.array([*map(words.__getitem__, some), 0], np.uint32))
                    size[lang] = size.get(lang, 0) + len(parts[-1])
                    if size[lang] >= block_words:
                        yield from closed(lang)
                    elif sum(size.values()) >= 4 * block_words:  # many languages at once: the fullest block goes
                        yield from closed(max(size, key=size.get))
        for lang in list(open_blocks):
            yield from closed(lang)

    return t.mapInArrow(body, BLOCK_SCHEMA.format("string"))


def ranked(blocks: DataFrame, least: int) -> DataFrame:
    """lang, key, f, id: the keys of all blocks with ``least`` or more occurrences, numbered from 0 by falling f."""
    n = blocks.where(CELL).select("lang", "key", "n").repartition("lang", "key").groupBy("lang", "key").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    out = order.row_index(n, [F.col("f").desc(), "key"], by=["lang"], out="id")
    return written(out.withColumn("id", F.col("id") - 1), "ranked")


def numbers(words: bytes, known: pa.Array | np.ndarray, ids: np.ndarray, n: int) -> Callable:
    """ids + 1 (0: infrequent) for keys of phrases, or for places of a block's words if n is 1, given the frequent keys in order."""
    if n == 1:
        named = pc.split_pattern(pa.array([words], pa.binary()).cast(pa.string()), " ").values
        place = pc.index_in(known, value_set=named)
        to = np.zeros(len(named) + 1, np.uint32)
        to[place.drop_null().to_numpy() + 1] = ids[place.is_valid().to_numpy(zero_copy_only=False)] + 1
        return to.__getitem__

    def number(keys: np.ndarray) -> np.ndarray:
        if not len(known):
            return np.zeros(len(keys), np.uint32)
        where = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        return np.where(known[where] == keys, ids[where] + 1, 0)

    return number


def renumbered(block: int, lang: str, words: bytes, base: bytes, gram: bytes, known: pa.Array | np.ndarray, ids: np.ndarray, n: int) -> Iterator[pa.RecordBatch]:
    """A block's rows once its phrases of n words are numbered by ``ids`` of the keys ``known``, with the cells of n + 1 words."""
    number = numbers(words, known, ids, n)
    base = unpack(base).astype(np.uint32)
    if n == 1:
        base = gram = number(base)
    else:
        at, left, right = pairs_at(base, base if n == 2 else unpack(gram).astype(np.uint32), n)
        gram = np.zeros(len(base), np.uint32)
        for low in range(0, len(at), CELLS):
            some = slice(low, low + CELLS)
            gram[at[some]] = number(keys_of(left[some], right[some]))
        del at, left, right
    cells, counts = tile_counts(*pairs_at(base, gram, n + 1)[1:])
    # nothing reads the ids behind the last level, nor the words' ids twice
    kept = (pack(base), pack(gram) if n > 1 else b"") if n + 1 < LONGEST else (b"", b"")
    del base, gram
    yield from block_rows(block, lang, b"", *kept, pa.array(cells), counts)


def numbered_here(blocks: DataFrame, ranks: DataFrame, n: int) -> DataFrame:
    """``next_blocks`` with the frequent keys of all languages in every task: no shuffle."""
    table, held = ranks.select("lang", "key", "id").toArrow(), {}
    for lang in pc.unique(table.column("lang")).to_pylist():
        mine = table.filter(pc.equal(table.column("lang"), lang)).sort_by("key")
        keys, ids = (mine.column(c).combine_chunks() for c in ("key", "id"))
        held[lang] = keys if n == 1 else keys.to_numpy(), ids.to_numpy()
    spark = blocks.sparkSession
    shared = spark.sparkContext.broadcast(held)
    none = pa.array([], pa.string()) if n == 1 else np.zeros(0, np.int64), np.zeros(0, np.int64)

    def body(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for at in range(batch.num_rows):
                block, lang, *state = (c[at].as_py() for c in batch.columns)
                yield from renumbered(block, lang, *state, *shared.value.get(lang, none), n)

    states = blocks.where(STATE).select(BLOCK_COLUMNS[:-2])
    with arrow_rows(spark, STATES):
        out = written(states.mapInArrow(body, BLOCK_SCHEMA.format("long")), "phrase-blocks", "zstd")
    shared.destroy()
    return out


def numbered_by_join(blocks: DataFrame, ranks: DataFrame, n: int) -> DataFrame:
    """``next_blocks`` where each block is sent the numbers of its own keys only."""
    places = blocks.where(CELL).select(F.col("block").alias("of"), "lang", "key")
    found = places.join(ranks.select("lang", "key", "id"), ["lang", "key"]).select("of", "key", "id")

    def body(block: pa.Table, mine: pa.Table) -> pa.Table:
        key, ids = mine.column("key").combine_chunks(), mine.column("id").to_numpy()
        if n > 1:
            key = key.to_numpy()
            in_order = np.argsort(key)
            key, ids = key[in_order], ids[in_order]
        return pa.Table.from_batches(renumbered(*(c[0].as_py() for c in block.columns), key, ids, n))

    states = blocks.where(STATE).select(BLOCK_COLUMNS[:-2])
    out = states.groupBy("block").cogroup(found.groupBy("of")).applyInArrow(body, BLOCK_SCHEMA.format("long"))
    return written(out, "phrase-blocks", "zstd")


def next_blocks(blocks: DataFrame, ranks: DataFrame, n: int, most_here: int = KEYS_HERE) -> DataFrame:
    """The blocks with ``gram`` numbered by ``ranks`` (phrases of n words) and the cells of phrases of n + 1 words.

    Up to ``most_here`` frequent keys (and as many times 16 bytes of words) go to every task; beyond,
    each block gets its own by joins.  Both give the same blocks.
    """
    size = ranks.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length(F.col("key").cast("string"))), F.lit(0))).first()
    here = size[0] <= most_here and (n > 1 or size[1] <= 16 * most_here)
    return (numbered_here if here else numbered_by_join)(blocks, ranks, n)


def frequent_phrases(docs: DataFrame, least: int = 30, text_col: str = "text", lang_col: str = "lang",
                     block_words: int = BLOCK_WORDS, most_here: int = KEYS_HERE) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, f) of all phrases of 1 to 4 words with ``least`` or more occurrences, and (lang, n).

    n counts all words.  Text is taken whole (NULL: empty), A-Z in lower case, cut into pieces at
    ``.,;:!?`` and line ends; phrases lie inside a piece, overlapping occurrences all count, repeated
    rows too.  A NULL language is ``und``.  Columns of other names are not read.
    """
    with arrow_rows(docs.sparkSession, TEXTS):
        blocks = written(word_blocks(docs, text_col, lang_col, block_words), "word-blocks", "zstd")
    total = blocks.groupBy("lang").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n"))
    ranks = ranked(blocks, least)
    words = ranks.select("lang", "id", F.col("key").alias("phrase"), "f")
    parts, found = words, words.withColumn("size", F.lit(1))
    total = written(total, "words")
    for n in range(2, LONGEST + 1):
        last, blocks = blocks, next_blocks(blocks, ranks, n - 1, most_here)
        discard(last)
        ranks = ranked(blocks, least)
        left = parts.select("lang", F.col("id").alias("__l"), F.col("phrase").alias("__left"))
        right = words.select("lang", F.col("id").alias("__r"), F.col("phrase").alias("__right"))
        spelt = (ranks.withColumn("__l", F.shiftright("key", SHIFT)).withColumn("__r", F.col("key").bitwiseAND(F.lit((1 << SHIFT) - 1)))
                 .join(left, ["lang", "__l"]).join(right, ["lang", "__r"]))
        parts = written(spelt.select("lang", "id", F.concat_ws(" ", "__left", "__right").alias("phrase"), "f"), "phrases")
        found = found.unionByName(parts.withColumn("size", F.lit(n)))
    discard(blocks)
    return found.select("lang", "phrase", "size", "f"), total


def part(first: Column | int, length: Column | int) -> Column:
    return F.array_join(F.slice("words", first, length), " ")


def wide(c: str) -> Column:
    return F.col(c).cast("decimal(20,0)")


def scored(found: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, score of the phrases of two words or more, by their lowest-scoring cut.

    score is floor(2000000 a / (l + r)) in exact arithmetic; of equal cuts the first counts.
    """
    c = found.where("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"), F.split("phrase", " ").alias("words"))
    c = c.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    c = c.select("lang", "phrase", "a", "k", part(1, F.col("k")).alias("__first"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("__rest"))
    of = lambda name, n: found.select("lang", F.col("phrase").alias(name), F.col("f").alias(n))
    c = c.join(of("__first", "l"), ["lang", "__first"]).join(of("__rest", "r"), ["lang", "__rest"])
    c = c.withColumn("score", F.expr("(cast(2000000 as decimal(7,0)) * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))"))
    best = c.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    return best.select("lang", "phrase", "a", "b.l", "b.r", "b.score")


def inside_longer(found: DataFrame) -> DataFrame:
    """lang, phrase, longest_f: phrases that lie inside longer ones, with the greatest count of those."""
    c = found.where("size > 2").select("lang", "f", "size", F.split("phrase", " ").alias("words"))
    c = c.withColumn("__m", F.explode(F.sequence(F.lit(2), F.col("size") - 1)))
    c = c.withColumn("__at", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("__m") + 1)))
    return c.groupBy("lang", part(F.col("__at"), F.col("__m")).alias("phrase")).agg(F.max("f").alias("longest_f"))


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, cover: int = 80, text_col: str = "text",
                 lang_col: str = "lang", block_words: int = BLOCK_WORDS, most_here: int = KEYS_HERE) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` phrases of two to four words.

    See ``frequent_phrases`` for words and counts and ``scored`` for scores.  A phrase goes if a longer
    frequent phrase around it has at least ``cover`` percent of its count.  Order: score and a falling,
    phrase rising by its bytes.  An empty table, or texts without a frequent pair, give no rows.
    """
    found, total = frequent_phrases(docs, least, text_col, lang_col, block_words, most_here)
    c = scored(found).join(inside_longer(found), ["lang", "phrase"], "left")
    c = c.where(F.col("longest_f").isNull() | (100 * wide("longest_f") < cover * wide("a")))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase"))
    c = c.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top)
    return c.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
