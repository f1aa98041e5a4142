"""Alignment of two tokenizers by products of sparse incidence matrices.

Tokens of a text cover its bytes, so a tokenization is an incidence matrix tokens x bytes.  With A
and B of one text, the nonzeros of A·Bᵀ are the token pairs whose byte ranges overlap, and their
values are the shared bytes.  Offsets where tokens of both end cut the text into groups; the
product of the two tokens x groups matrices holds the pairs that share a group.  The matrices are
compressed sparse rows built here, multiplied row by row (Gustavson) in blocks of bounded size.

Corpus counts of linked id pairs never travel a row per occurrence: a task works in blocks of a few
MB of text, gives each block's different pairs with their counts, and keeps a documents x pairs
matrix for each block.  Spark sums the counts, sends each block the counts of its own pairs, and
the block's matrix times that vector gives the sums of its documents.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm import bpe
from quarry.llm.common import pack, quoted, unpack, written

A_FILE = public_tokenizers.path("byte_bpe_50k.json")
B_FILE = public_tokenizers.path("piece_bpe_32k.model")
MARK = "▁"  # stands for a space in pieces
BLOCK_BYTES = 4 << 20  # text of a block; a longer document is a block of its own
PRODUCTS = 1 << 20  # expanded products held at once


# --------------------------------------------------------------------------- sparse rows


@dataclass
class Rows:
    """Compressed sparse rows: row i has columns ``cols[start[i]:start[i + 1]]`` with ``values``."""

    start: np.ndarray
    cols: np.ndarray
    values: np.ndarray
    width: int

    @property
    def height(self) -> int:
        return len(self.start) - 1

    def transposed(self) -> Rows:
        """Counting sort of the entries by column; a column's rows stay in order."""
        start = np.concatenate([[0], np.cumsum(np.bincount(self.cols, minlength=self.width))])
        owner = np.repeat(np.arange(self.height, dtype=self.cols.dtype), np.diff(self.start))
        if (self.cols[1:] >= self.cols[:-1]).all():  # as in every incidence matrix
            return Rows(start, owner, self.values, self.height)
        order = np.argsort(self.cols, kind="stable")
        return Rows(start, owner[order], self.values[order], self.height)

    def times(self, x: np.ndarray) -> np.ndarray:
        """Matrix times vector."""
        total = np.concatenate([[0], np.cumsum(self.values * x[self.cols])])
        return total[self.start[1:]] - total[self.start[:-1]]

    def products(self, other: Rows, most: int = PRODUCTS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, cols, values) of self · other, in row order, a block of whole rows at a time.

        Row i of the product is the sum of the rows of ``other`` that row i names.  A block expands
        at most ``most`` products, or those of a single row.
        """
        sizes = np.diff(other.start)
        expanded = np.concatenate([[0], np.cumsum(sizes[self.cols])])[self.start]
        low = 0
        while low < self.height:
            high = max(low + 1, int(np.searchsorted(expanded, expanded[low] + most, side="right")) - 1)
            yield self._rows(other, low, high, sizes)
            low = high

    def _rows(self, other: Rows, low: int, high: int, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        part = slice(self.start[low], self.start[high])
        inner, n = self.cols[part], sizes[self.cols[part]]
        row = np.repeat(np.repeat(np.arange(low, high), np.diff(self.start[low:high + 1])), n)
        place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(other.start[inner], n)
        key = row * other.width + other.cols[place]
        value = np.repeat(self.values[part], n) * other.values[place]
        if (key[1:] < key[:-1]).any():
            order = np.argsort(key, kind="stable")
            key, value = key[order], value[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        value = np.add.reduceat(value, first) if len(first) else value
        return key[first] // other.width, key[first] % other.width, value


def token_bytes_matrix(ends: np.ndarray) -> Rows:
    """Tokens x bytes of tokens that end at ``ends`` and cover every byte."""
    n = int(ends[-1]) if len(ends) else 0
    return Rows(np.concatenate([[0], ends]).astype(np.int64), np.arange(n, dtype=np.int32), np.ones(n, np.int32), n)


def common_ends(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Byte offsets where tokens of both end."""
    return np.intersect1d(a, b, assume_unique=True)


def token_groups_matrix(ends: np.ndarray, cuts: np.ndarray) -> Rows:
    """Tokens x groups, the groups being the stretches between ``cuts``."""
    group = np.searchsorted(cuts, ends, side="left")
    return Rows(np.arange(len(ends) + 1), group, np.ones(len(ends), np.int64), len(cuts))


def overlap_links(a_ends: np.ndarray, b_ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(A places, B places, shared bytes) of all overlapping tokens: nonzeros of A·Bᵀ."""
    yield from token_bytes_matrix(a_ends).products(token_bytes_matrix(b_ends).transposed())


def shared_group_links(a_ends: np.ndarray, b_ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(A places, B places, 1) of all tokens in one group, in blocks: nonzeros of the group product."""
    cuts = common_ends(a_ends, b_ends)
    yield from token_groups_matrix(a_ends, cuts).products(token_groups_matrix(b_ends, cuts).transposed())


def shared_group_counts(a_ends: np.ndarray, b_ends: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Number of shared-group links of each A token: the group product times ones, never expanded."""
    b = token_groups_matrix(b_ends, cuts).transposed()
    return token_groups_matrix(a_ends, cuts).times(b.times(np.ones(b.width, np.int64)))


# --------------------------------------------------------------------------- the two tokenizers


class Pieces:
    """A sentencepiece model: ids of a text and the bytes of each id.

    Long texts go in slices.  That is exact where no piece holds a space mark behind another
    character: merges then never cross from a word into the space behind it.  A model with such a
    piece gets whole texts.
    """

    def __init__(self, path: str, most: int = 1 << 16):
        from sentencepiece import SentencePieceProcessor
        self.model = SentencePieceProcessor(model_file=path)
        self.size, self.most = self.model.vocab_size(), most
        names = [self.model.id_to_piece(i) for i in range(self.size)]
        self.bytes = [bytes([int(x[3:5], 16)]) if self.model.is_byte(i) else x.replace(MARK, " ").encode()
                      for i, x in enumerate(names)]
        self.lengths = np.array([len(x) for x in self.bytes], np.int64)
        crossing = re.compile(f"[^{MARK}]{MARK}")
        kept = b"".join(self.bytes[i] for i in self.model.encode("x  y "))  # with its space in front, other spaces untouched
        self.sliced = kept == b" x  y " and not any(crossing.search(x) for x in names)
        self.cut = re.compile(f"(?<=[^ {MARK}]) (?=[^ {MARK}])")

    def encode(self, text: str) -> np.ndarray:
        if not self.sliced or len(text) <= self.most:
            return np.array(self.model.encode(text, num_threads=1), np.int32)
        found, low = [], 0
        while low < len(text):
            cut = self.cut.search(text, low + self.most)
            high = cut.start() if cut else len(text)
            found.append(np.array(self.model.encode(text[low:high], num_threads=1), np.int32))
            low = high + 1  # the model puts the space before the next slice itself
        return np.concatenate(found)


@dataclass
class Aligned:
    """Tokens of one text by both tokenizers: ids, byte offsets of their ends, common ends."""

    a: np.ndarray
    b: np.ndarray
    a_ends: np.ndarray
    b_ends: np.ndarray
    cuts: np.ndarray


class Aligner:
    """Both tokenizers of a worker."""

    def __init__(self, a_file: str, b_file: str):
        self.first, self.second = bpe.codec(a_file), Pieces(b_file)
        self.n_a, self.n_b = len(self.first.token_bytes), self.second.size
        decimal = [str(i) for i in range(max(self.n_a, self.n_b))]
        # an id followed by ',', '|' or ';'
        self.spelt = np.array([d + mark for mark in ",|;" for d in decimal], dtype=object)
        self.stride = len(decimal)

    def __call__(self, text: str | None) -> Aligned | None:
        """None for NULL and empty texts and for those that a tokenizer does not give back byte by byte."""
        if not text:
            return None
        raw = (" " + text).encode()
        a = self.first.encode(" " + text).astype(np.int64)
        if self.first.decode_bytes(a.tolist()) != raw:
            return None
        b = self.second.encode(text).astype(np.int64)
        if b"".join(map(self.second.bytes.__getitem__, b.tolist())) != raw:
            return None
        a_ends, b_ends = np.cumsum(self.first.lengths[a]), np.cumsum(self.second.lengths[b])
        return Aligned(a, b, a_ends, b_ends, common_ends(a_ends, b_ends))

    def spelling(self, x: Aligned) -> str:
        """The groups as text: ids of A joined by commas, a bar, ids of B; groups joined by semicolons."""
        a_group, b_group = np.searchsorted(x.cuts, x.a_ends), np.searchsorted(x.cuts, x.b_ends)
        a_last = np.concatenate([a_group[1:] != a_group[:-1], [True]])
        b_last = np.concatenate([b_group[1:] != b_group[:-1], [True]])
        out = np.empty(len(x.a) + len(x.b), np.int64)
        out[np.arange(len(x.a)) + np.searchsorted(b_group, a_group)] = x.a + np.where(a_last, self.stride, 0)
        out[np.arange(len(x.b)) + np.searchsorted(a_group, b_group, side="right")] = x.b + np.where(b_last, 2 * self.stride, 0)
        return "".join(self.spelt[out].tolist())[:-1]


_ALIGNERS: dict = {}


def aligner(a_file: str, b_file: str) -> Aligner:
    """One pair of tokenizers per worker process."""
    if (a_file, b_file) not in _ALIGNERS:
        _ALIGNERS[a_file, b_file] = Aligner(a_file, b_file)
    return _ALIGNERS[a_file, b_file]


# --------------------------------------------------------------------------- operators


def align(docs: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, a_ids, b_ids, cuts, link_a, link_b, link_bytes: one row per input row, no shuffle.

    cuts are the byte offsets (of space + text) where groups end; the link arrays hold the places of
    overlapping tokens and the bytes they share.  NULL and empty texts, and texts that a tokenizer
    does not give back byte by byte, have empty arrays.  Only the two named columns are read, so
    other columns may have any name; repeated rows are aligned each for itself.
    """
    t = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).cast("string").alias("text"))
    longs, names = pa.list_(pa.int64()), ["a_ids", "b_ids", "cuts", "link_a", "link_b", "link_bytes"]

    def body(batches: Iterator[pa.RecordBatch]):
        both = aligner(a_file, b_file)
        for batch in batches:
            for at in range(batch.num_rows):
                x = both(batch.column("text")[at].as_py())
                if x is None:
                    got = [[]] * len(names)
                else:
                    links = [np.concatenate(c) for c in zip(*overlap_links(x.a_ends, x.b_ends), strict=True)]
                    got = [x.a, x.b, x.cuts, *links]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, 1), *[pa.array([g], longs) for g in got]], ["doc_id", *names])

    return t.mapInArrow(body, T.StructType([T.StructField("doc_id", t.schema["doc_id"].dataType),
                                            *[T.StructField(n, T.ArrayType(T.LongType())) for n in names]]))


class Block:
    """Links of some documents, gathered until they hold enough text."""

    def __init__(self):
        self.ids, self.facts, self.links, self.bytes = [], [], [], 0

    def add(self, doc_id: pa.Array, x: Aligned | None, both: Aligner) -> None:
        self.ids.append(doc_id)
        if x is None:
            self.facts.append((0, 0, 0, 0, 0, ""))
            self.links.append(np.zeros(0, np.int64))
            return
        keys = [x.a[i] * both.n_b + x.b[j] for i, j, _ in overlap_links(x.a_ends, x.b_ends)]
        keys = np.concatenate(keys) if len(keys) > 1 else keys[0]
        shared = int(shared_group_counts(x.a_ends, x.b_ends, x.cuts).sum())
        digest = hashlib.sha256(both.spelling(x).encode()).hexdigest()
        self.facts.append((len(x.a), len(x.b), len(x.cuts), len(keys), shared, digest))
        self.links.append(keys)
        self.bytes += int(x.a_ends[-1])

    def row(self, block: int) -> pa.RecordBatch:
        """One row: the documents' facts, the different pairs with counts, and the documents x pairs matrix."""
        sizes = np.array([len(k) for k in self.links])
        pairs, place = np.unique(np.concatenate(self.links), return_inverse=True)
        width = max(1, len(pairs))
        entry, times = np.unique(np.repeat(np.arange(len(sizes)), sizes) * width + place.ravel(), return_counts=True)
        start = np.searchsorted(entry, np.arange(len(sizes) + 1) * width)
        counts = np.bincount(place.ravel(), minlength=len(pairs))
        packed = [pack(start), pack(np.diff(entry, prepend=0)), pack(times)]
        n_a, n_b, n_groups, n_links, shared, digest = zip(*self.facts, strict=True)
        longs = pa.list_(pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array([block], pa.int64()), pa.ListArray.from_arrays([0, len(self.ids)], pa.concat_arrays(self.ids)),
             *[pa.array([x], longs) for x in (n_a, n_b, n_groups, n_links, shared)], pa.array([digest], pa.list_(pa.string())),
             pa.array([pairs], longs), pa.array([counts], longs), *[pa.array([p], pa.binary()) for p in packed]], BLOCK_COLUMNS)


BLOCK_COLUMNS = ["block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_group_links", "groups_sha256",
                 "pairs", "counts", "start", "entries", "times"]


def link_blocks(docs: DataFrame, a_file: str, b_file: str, id_col: str, text_col: str, block_bytes: int) -> DataFrame:
    """The blocks of ``docs``, one row each; see ``Block.row``."""
    t = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).cast("string").alias("text"))
    kind = t.schema["doc_id"].dataType

    def body(batches: Iterator[pa.RecordBatch]):
        both, block, made = aligner(a_file, b_file), Block(), 0
        task = TaskContext.get().partitionId()
        for batch in batches:
            for at in range(batch.num_rows):
                block.add(batch.column("doc_id").slice(at, 1), both(batch.column("text")[at].as_py()), both)
                if block.bytes >= block_bytes or len(block.ids) >= 1 << 16:
                    yield block.row(task << 32 | made)
                    block, made = Block(), made + 1
        if block.ids:
            yield block.row(task << 32 | made)

    kinds = {"block": T.LongType(), "doc_id": T.ArrayType(kind), "groups_sha256": T.ArrayType(T.StringType()),
             "start": T.BinaryType(), "entries": T.BinaryType(), "times": T.BinaryType()}
    return t.mapInArrow(body, T.StructType([T.StructField(c, kinds.get(c, T.ArrayType(T.LongType()))) for c in BLOCK_COLUMNS]))


def pair_counts(blocks: DataFrame, n_b: int) -> DataFrame:
    """pair, n, best: how many links hold each id pair (A id * n_b + B id), and whether none of its B id has more."""
    cells = blocks.select(F.explode(F.arrays_zip("pairs", "counts")).alias("c")).select("c.pairs", "c.counts")
    n = cells.groupBy(F.col("pairs").alias("pair")).agg(F.sum("counts").alias("n")).withColumn("__b", F.col("pair") % n_b)
    top = n.groupBy("__b").agg(F.max("n").alias("__top"))
    return n.join(top, "__b").select("pair", "n", (F.col("n") == F.col("__top")).alias("best"))


def link_statistics(docs: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE, id_col: str = "doc_id", text_col: str = "text",
                    block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, n_group_links, groups_sha256.

    n_links counts overlapping token pairs; a pair's count is how many links of the whole corpus join
    its two ids; n_best counts the links whose count no other pair of their B id exceeds (ties count),
    count_sum adds the counts up.  n_group_links counts token pairs that share a group.  Zeros and ''
    for NULL and empty texts and for texts that a tokenizer does not give back byte by byte.  An empty
    table gives an empty one; repeated rows count each; ids may be NULL or repeated, as documents are
    told apart by their place in a block.
    """
    kind = docs.select(quoted(id_col).alias("doc_id")).schema["doc_id"].dataType
    blocks = written(link_blocks(docs, a_file, b_file, id_col, text_col, block_bytes), "link-blocks")
    counts = pair_counts(blocks, Pieces(b_file).size)
    cells = blocks.select(F.col("block").alias("of"), F.explode("pairs").alias("pair")).join(counts, "pair")
    out = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "n_group_links", "groups_sha256"]

    def sums(block: pa.Table, found: pa.Table) -> pa.Table:
        order = np.argsort(found.column("pair").to_numpy())
        n, best = (found.column(c).to_numpy().astype(np.int64)[order] for c in ("n", "best"))
        start, entries, times = (unpack(block.column(c)[0].as_py()) for c in ("start", "entries", "times"))
        matrix = Rows(start, np.cumsum(entries) % max(1, len(n)), times, len(n))
        got = {c: block.column(c).combine_chunks().flatten() for c in out if c not in ("n_best", "count_sum")}
        got |= {"n_best": pa.array(matrix.times(best)), "count_sum": pa.array(matrix.times(n))}
        return pa.table([got[c] for c in out], out)

    schema = T.StructType([T.StructField("doc_id", kind), *[T.StructField(c, T.LongType()) for c in out[1:-1]],
                           T.StructField("groups_sha256", T.StringType())])
    plain = blocks.drop("pairs", "counts")
    return plain.groupBy("block").cogroup(cells.groupBy("of")).applyInArrow(sums, schema)
