"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or abstain on every whole text.  Spark counts the
vote patterns of all documents; expectation-maximisation over those counts estimates each
labeller's accuracy and the posterior of every pattern.  The posteriors label a bounded sample that
trains a linear scorer over hashed features, which then scores every document.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import quoted, with_arrow_column, written

ABSTAIN, GOOD, BAD = 0, 1, 2
DIM = 1024
# Measures in 0..1 of a whole text; a labeller votes bad at or above its limit and abstains below.
# The kinds of junk overlap on purpose: each one trips two labellers or more.
LIMITS = {
    "symbols": 0.30,      # symbols a word
    "odd_words": 0.45,    # words that aren't letters with at most one mark behind
    "capitals": 0.50,     # words in capitals
    "shouting": 0.20,     # exclamation marks a word
    "bars": 0.20,         # words that are a table bar
    "stutter": 0.30,      # words equal to the word before
    "same_pairs": 0.50,   # word pairs seen before in the text
    "repeats": 0.50,      # five-word windows seen before in the text
    "same_lines": 0.60,   # lines equal to an earlier line
}
# The one labeller for good text: votes good where every measure stays at or below its share of the limit.
PROSE = 0.4
LABELLERS = (*LIMITS, "prose")
SYMBOL = re.compile(r"[#*$%&<>^~=]")
RUNS = [(re.compile(r"[^\W\d_]+"), lambda m: "A" if m[0].isupper() and len(m[0]) > 1 else "a"),
        (re.compile(r"\d+"), "0"), (re.compile(r"(\W)\1+"), r"\1\1")]


def measures(text: str, words: list[str]) -> list[float]:
    """One value in 0..1 for each of LIMITS."""
    n = len(words)
    if not n:
        return [0.0] * len(LIMITS)
    lines = [x for x in text.split("\n") if x.strip()]
    pairs = len(set(zip(words, words[1:], strict=False)))
    windows = len(set(zip(words, words[1:], words[2:], words[3:], words[4:], strict=False)))
    caps = sum(1 for w in words if w.isupper() and len(w) > 1)
    plain = sum(1 for w in words if w.isalpha() or w[:-1].isalpha())
    return [min(1.0, v) for v in (
        len(SYMBOL.findall(text)) / n, 1 - plain / n, caps / n, text.count("!") / n, words.count("|") / n,
        sum(map(eq, words, words[1:])) / n, 1 - pairs / (n - 1) if n > 1 else 0.0,
        1 - windows / (n - 4) if n > 4 else 0.0, 1 - len(set(lines)) / len(lines))]


def votes(values: list[float], n_words: int, least_words: int = 8) -> int:
    """Vote pattern as a base-3 number; texts under ``least_words`` words get abstentions only."""
    if n_words < least_words:
        return 0
    code = GOOD if all(v <= PROSE * limit for v, limit in zip(values, LIMITS.values(), strict=True)) else ABSTAIN
    for v, limit in zip(reversed(values), reversed(LIMITS.values()), strict=True):
        code = code * 3 + (BAD if v >= limit else ABSTAIN)
    return code


def shape_index(word: str) -> int:
    """Hashed feature of a word's shape: letter runs as a or A, digit runs as 0, symbol runs of two."""
    for pattern, to in RUNS:
        word = pattern.sub(to, word)
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % DIM


class Featurizer(dict):
    """Word -> hashed shape, in a table of at most ``keep`` words."""

    def __init__(self, keep: int = 200_000):
        super().__init__()
        self.keep = keep

    def __missing__(self, word: str) -> int:
        if len(self) >= self.keep:
            self.clear()
        k = shape_index(word)
        if len(word) <= 64:
            self[word] = k
        return k

    def __call__(self, words: list[str], values: list[float]) -> tuple[np.ndarray, np.ndarray]:
        """(indices, values): share of the words of each shape, and the bucket of each measure."""
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.float32)
        index, count = np.unique(np.fromiter(map(self.__getitem__, words), np.int64, len(words)), return_counts=True)
        stats = [zlib.crc32(f"{name}:{int(10 * v + 0.5)}".encode()) % DIM for name, v in zip(LIMITS, values, strict=True)]
        return np.concatenate([index, stats]), np.concatenate([count / len(words), np.ones(len(stats))]).astype(np.float32)


def label_model(patterns: dict[int, int], rounds: int = 500) -> tuple[dict[int, float], dict[str, float], float]:
    """EM over vote patterns: (P(good) of each pattern, accuracy of each labeller, prior of good).

    A vote is right with its labeller's accuracy, independently given the class; abstaining carries
    no evidence.  Accuracies start at 0.9 and keep a weak Beta prior there (a tenth of the labeller's
    votes), so that a labeller without overlap keeps its standing.  Ends when no posterior moves.
    """
    codes = np.array(sorted(patterns), np.int64)
    weight = np.array([patterns[c] for c in codes.tolist()], float)
    table = codes[:, None] // 3 ** np.arange(len(LABELLERS)) % 3
    sign = (table == GOOD).astype(float) - (table == BAD)
    cast = (weight[:, None] * np.abs(sign)).sum(0)
    accuracy, prior, post = np.full(len(LABELLERS), 0.9), 0.5, np.full(len(codes), 0.5)
    for _ in range(rounds):
        odds = np.log(prior / (1 - prior)) + sign @ np.log(accuracy / (1 - accuracy))
        new = 1 / (1 + np.exp(-odds))
        right = (weight[:, None] * np.where(sign > 0, new[:, None], np.where(sign < 0, 1 - new[:, None], 0))).sum(0)
        accuracy = np.clip((right + 0.09 * cast + 0.9) / (1.1 * cast + 1), 0.55, 0.995)
        prior = float(np.clip((weight * new).sum() / max(weight.sum(), 1), 0.02, 0.98))
        moved, post = np.abs(new - post).max(initial=0), new
        if moved < 1e-7:
            break
    return dict(zip(codes.tolist(), post.tolist(), strict=True)), dict(zip(LABELLERS, accuracy.tolist(), strict=True)), prior


def train_linear(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, steps: int = 200, l2: float = 1e-4):
    """Logistic regression on soft labels by full-batch Adam: (weights, bias)."""
    x = np.zeros((len(rows), DIM), np.float32)
    for i, (k, v) in enumerate(rows):
        np.add.at(x[i], k, v)
    y = labels.astype(np.float32)
    w, b = np.zeros(DIM, np.float32), np.float32(0)
    m, s, mb, sb = np.zeros(DIM, np.float32), np.zeros(DIM, np.float32), 0.0, 0.0
    for t in range(1, steps + 1):
        err = (1 / (1 + np.exp(-(x @ w + b))) - y) / max(len(rows), 1)
        g, gb = x.T @ err + l2 * w, float(err.sum())
        m, s, mb, sb = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * sb + 0.01 * gb * gb
        fix, fix2 = 1 - 0.9 ** t, 1 - 0.99 ** t
        w = w - 0.1 * (m / fix) / (np.sqrt(s / fix2) + 1e-8)
        b = b - np.float32(0.1 * (mb / fix) / (np.sqrt(sb / fix2) + 1e-8))
    return w, float(b)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_train: int = 10_000) -> dict:
    """The model of a corpus: weights, bias, and the label model's accuracies, prior and patterns.

    Vote patterns are counted over all documents (at most 3 ** labellers different ones reach the
    driver).  The scorer is trained on a sample of about ``max_train`` documents, those with the
    lowest hashes of id and text; that bound does not grow with the corpus.  Without documents the
    model scores everything 0.5.
    """
    n = docs.count()
    t = docs.select(quoted(text_col).alias("text"), F.xxhash64(quoted(id_col), quoted(text_col)).alias("h"))
    limit = min(2 ** 63 - 1, int(max_train / max(n, 1) * 2 ** 64) - 2 ** 63)
    t = t.select("text", (F.col("h") <= F.lit(limit)).alias("chosen"))

    def body(batches: Iterator[pa.RecordBatch]):
        shapes = Featurizer()
        for b in batches:
            code, index, value = [], [], []
            for text, chosen in zip(b.column("text").to_pylist(), b.column("chosen").to_pylist(), strict=True):
                words = (text or "").split()
                m = measures(text or "", words)
                code.append(votes(m, len(words)))
                k, v = shapes(words, m) if chosen else (None, None)
                index.append(None if k is None else k.astype(np.int16).tobytes())
                value.append(None if v is None else v.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(code, pa.int64()), pa.array(index, pa.binary()), pa.array(value, pa.binary())],
                                             ["code", "index", "value"])

    seen = written(t.mapInArrow(body, T.StructType([T.StructField("code", T.LongType()), T.StructField("index", T.BinaryType()),
                                                    T.StructField("value", T.BinaryType())])), "votes")
    patterns = {r["code"]: r["n"] for r in seen.groupBy("code").agg(F.count(F.lit(1)).alias("n")).collect()}
    post, accuracy, prior = label_model(patterns) if patterns else ({}, {}, 0.5)
    rows = seen.where("index is not null").collect()
    x = [(np.frombuffer(r["index"], np.int16).astype(np.int64), np.frombuffer(r["value"], np.float32)) for r in rows]
    w, b = train_linear(x, np.array([post[r["code"]] for r in rows])) if rows else (np.zeros(DIM, np.float32), 0.0)
    return {"weights": w, "bias": b, "accuracy": accuracy, "prior": prior, "patterns": post}


def score(docs: DataFrame, model: dict, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with all its columns and ``out``: P(good quality) of every whole text in 0..1.

    NULL texts and texts without a word score 0.  No shuffle; columns pass through as they are.
    """
    w, bias = np.asarray(model["weights"], float), float(model["bias"])
    at = docs.columns.index(text_col)

    def body(batches: Iterator[pa.RecordBatch]):
        shapes = Featurizer()
        for b in batches:
            scores = []
            for text in b.column(at).to_pylist():
                words = (text or "").split()
                k, v = shapes(words, measures(text or "", words))
                scores.append(float(1 / (1 + np.exp(-(w[k] @ v + bias)))) if words else 0.0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64())], [*b.schema.names, "added"])

    return with_arrow_column(docs, body, out, T.DoubleType())


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5, max_train: int = 10_000) -> DataFrame:
    """``docs`` without the documents the fitted model rejects (score below ``least``); same columns."""
    model = fit(docs, id_col, text_col, max_train)
    return score(docs, model, text_col, "__score").where(F.col("__score") >= least).drop("__score")
