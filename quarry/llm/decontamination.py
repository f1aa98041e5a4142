"""Benchmark decontamination by pigeonhole edit matching.

A test item with an error budget of k edits is cut into k + 1 pieces: any passage within k edits
holds one piece unchanged.  Exact piece hits come from one Aho-Corasick pass over each whole text,
and every hit is verified by Myers' bit-parallel edit distance in the window that the budget allows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from quarry.llm.common import quoted, with_arrow_column

GAP = re.compile(r"[\W_]+")


def normalise(text: str) -> str:
    """Lower case, every run of characters other than letters and digits as one blank, trimmed."""
    return GAP.sub(" ", text.lower()).strip()


def pieces(item: str, piece: int) -> list[tuple[int, str]]:
    """(offset, piece) for the budget + 1 equal pieces of at least ``piece`` characters."""
    n = max(1, len(item) // piece)
    cuts = [i * len(item) // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def myers_search(pattern: str, text: str, budget: int) -> tuple[int, int] | None:
    """(edits, end) of the passage of ``text`` nearest to the whole pattern (first on ties), or None.

    Bit-parallel: bit i of the vectors holds the step between pattern rows i and i + 1; a match may
    begin anywhere in the text, so row 0 costs nothing.
    """
    m = len(pattern)
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best = full, 0, m, None
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        plus, minus = down | ~(diagonal | up) & full, up & diagonal
        score += bool(plus & top) - bool(minus & top)
        if score <= budget and (best is None or score < best[0]):
            best = (score, j + 1)
        plus, minus = plus << 1, minus << 1
        right = eq | down
        up, down = (minus | ~(right | plus)) & full, plus & right & full
    return best


class PieceIndex:
    """Aho-Corasick automaton over the pieces of a block of items."""

    def __init__(self, items: list[tuple], piece: int):
        self.items, self.automaton = [], ahocorasick.Automaton()
        places: dict[str, list] = {}
        for item_id, text in items:
            norm = normalise(text or "")
            if len(norm) < piece:
                continue
            parts = pieces(norm, piece)
            self.items.append((item_id, norm, len(parts) - 1))
            for at, p in parts:
                places.setdefault(p, []).append((len(self.items) - 1, at))
        for p, where in places.items():
            self.automaton.add_word(p, (len(p), where))
        if places:
            self.automaton.make_automaton()

    def matches(self, text: str) -> list[tuple]:
        """(item_id, edits, start, end) of the best passage per item; places in the normalised text."""
        if not self.items:
            return []
        windows: dict[int, list] = {}
        for end, (size, where) in self.automaton.iter(text):
            for k, at in where:
                begin = end + 1 - size - at
                _, norm, budget = self.items[k]
                lo, hi = max(0, begin - budget), min(len(text), begin + len(norm) + budget)
                old = windows.setdefault(k, [])
                if old and lo <= old[-1][1] and hi <= old[-1][1] + 2 * budget and lo >= old[-1][0]:
                    old[-1][1] = max(hi, old[-1][1])
                else:
                    old.append([lo, hi])
        out = []
        for k, spans in windows.items():
            item_id, norm, budget = self.items[k]
            best = None
            for lo, hi in {tuple(s) for s in spans}:
                got = myers_search(norm, text[lo:hi], budget)
                if got and (best is None or (got[0], lo + got[1]) < best):
                    best = (got[0], lo + got[1])
            if best:
                edits, end = best
                # the reversed search from the end finds where the passage begins
                back = myers_search(norm[::-1], text[max(0, end - len(norm) - edits):end][::-1], edits)
                out.append((item_id, edits, end - (back[1] if back else len(norm)), end))
        return out


def original_span(text: str, start: int, end: int) -> tuple[int, int]:
    """Character span in the text of a span of its normalised form."""
    lowered, places = text.lower(), []
    exact = len(lowered) == len(text)
    for c in re.finditer(r"[^\W_]+", lowered):
        if places:
            places.append(c.start() - 1)
        places.extend(range(c.start(), c.end()))
    a, b = places[start], places[end - 1] + 1
    return (a, b) if exact else (min(a, len(text)), min(b, len(text)))


def item_blocks(benchmark: DataFrame, block_bytes: int, item_id_col: str, item_text_col: str):
    """The items (item_id, text) and their broadcast blocks, made one after the other: each holds
    about half of ``block_bytes`` of item text, by hash of the item; an item is never split."""
    items = benchmark.select(quoted(item_id_col).alias("item_id"), quoted(item_text_col).alias("text")).where("text is not null")
    total = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    n = max(1, -(-2 * total // block_bytes))
    mine = lambda k: items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
    return items, (benchmark.sparkSession.sparkContext.broadcast([tuple(r) for r in mine(k).collect()]) for k in range(n))


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, piece: int = 16, block_bytes: int = 32 << 20,
                      id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id",
                      item_text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Best passage of each item in each document, if within the budget of len // piece - 1 edits.

    Columns: doc_id, item_id, n_edits, start, end (character span in the text), then ``keep``.
    One row per (row of docs, item) with a match.  Items are compared in normalised form; NULL and
    empty items or texts match nothing, nor do items shorter than a piece (a word or two says
    nothing); items shorter than two pieces must stand unchanged.  The
    query set is taken in blocks of at most ``block_bytes`` of item text, one pass over the
    documents each, so no task ever holds more of it than a block; an item is never split.
    """
    items, blocks = item_blocks(benchmark, block_bytes, item_id_col, item_text_col)
    t = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).alias("text"), *[quoted(c) for c in keep])
    schema = T.StructType([t.schema["doc_id"], T.StructField("item_id", items.schema["item_id"].dataType),
                           T.StructField("n_edits", T.IntegerType()), T.StructField("start", T.IntegerType()),
                           T.StructField("end", T.IntegerType()), *[t.schema[c] for c in keep]])
    item_type, out = to_arrow_type(items.schema["item_id"].dataType), None
    for block in blocks:
        def body(batches: Iterator[pa.RecordBatch], block=block):
            index = PieceIndex(block.value, piece)
            for b in batches:
                hits, rows = [], []
                for i, text in enumerate(b.column("text").to_pylist()):
                    for item_id, edits, start, end in index.matches(normalise(text)) if text else []:
                        hits.append((item_id, edits, *original_span(text, start, end)))
                        rows.append(i)
                kept = b.select(["doc_id", *keep]).take(pa.array(rows, pa.int64()))
                cols = [pa.array(list(c), k) for c, k in zip(zip(*hits, strict=True) if hits else [[]] * 4,
                                                             [item_type, pa.int32(), pa.int32(), pa.int32()], strict=True)]
                yield pa.RecordBatch.from_arrays([kept.column("doc_id"), *cols, *[kept.column(c) for c in keep]], schema.names)

        part = t.mapInArrow(body, schema)
        out = part if out is None else out.unionByName(part)
    return out


def without_contaminated(docs: DataFrame, benchmark: DataFrame, piece: int = 16, block_bytes: int = 32 << 20, text_col: str = "text",
                         item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text holds a passage of the benchmark; same columns, no shuffle."""
    _, blocks = item_blocks(benchmark, block_bytes, item_id_col, item_text_col)
    at, out = docs.columns.index(text_col), docs
    for block in blocks:

        def body(batches: Iterator[pa.RecordBatch], block=block):
            index = PieceIndex(block.value, piece)
            for b in batches:
                hit = [bool(text and index.matches(normalise(text))) for text in b.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(hit, pa.bool_())], [*b.schema.names, "added"])

        out = with_arrow_column(out, body, "__hit", T.BooleanType()).where("not __hit").drop("__hit")
    return out
