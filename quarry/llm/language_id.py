"""Language identification with string kernels.

The blended-spectrum presence kernel of two texts counts the character n-grams of one to three
letters that both hold, over the root of the product of their numbers of different n-grams.  A few
landmark texts a language span the kernel space (Nyström): a text's features are its kernel values
against the landmarks times the inverse root of the landmarks' own kernel matrix.  Kernel ridge
regression fits one output a language, one language against the rest.

Scoring is a product of matrices a batch: n-gram presence (texts x n-grams, one row of places a
text) with landmark presence, then with the folded weights.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import quoted, with_arrow_column, written

ORDERS = (1, 2, 3)
BITS = 21  # a code point takes 21 bits, so three fit a long
SLICE = 1 << 20  # characters of a text at once
BATCH = 256  # texts of one matrix product in scoring
CELLS = 1 << 20  # matrix cells picked at once
NO_LETTER = re.compile(r"[\W\d_]+")
UNKNOWN = "und"


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def ngrams(text: str) -> np.ndarray:
    """Different n-grams of a whole text as sorted longs.

    Letters are lower-cased and every run of other signs is one blank, one at either end too.
    """
    plain = f" {NO_LETTER.sub(' ', text.lower()).strip()} "
    if plain == "  ":
        return np.zeros(0, np.int64)
    code = np.frombuffer(plain.encode("utf-32-le", "surrogatepass"), np.uint32)
    found = []
    for low in range(0, len(code), SLICE):
        part = code[low:low + SLICE + ORDERS[-1] - 1].astype(np.int64)
        for n in ORDERS:
            key = part[:max(0, len(part) - n + 1)]
            for i in range(1, n):
                key = key << BITS | part[i:len(part) - n + 1 + i]
            found.append(np.unique(key))
    return np.unique(np.concatenate(found))


class Spectra:
    """Landmark texts: their n-grams, presence matrix (n-grams x landmarks) and sizes."""

    def __init__(self, texts: list[np.ndarray]):
        self.keys = np.unique(np.concatenate(texts)) if texts else np.zeros(0, np.int64)
        self.presence = np.zeros((len(self.keys), len(texts)), np.uint8)
        for j, t in enumerate(texts):
            self.presence[np.searchsorted(self.keys, t), j] = 1
        self.roots = np.sqrt(np.maximum(1, [len(t) for t in texts]))

    def places(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Presence of the landmarks' n-grams as sparse rows: (start of each text's row, places)."""
        start, found = [0], []
        for t in texts:
            at = np.minimum(np.searchsorted(self.keys, t), len(self.keys) - 1)
            found.append(at[self.keys[at] == t] if len(self.keys) else at[:0])
            start.append(start[-1] + len(found[-1]))
        return np.array(start), np.concatenate(found) if found else np.zeros(0, np.int64)

    def product(self, texts: list[np.ndarray], matrix: np.ndarray) -> np.ndarray:
        """Presence rows of some texts times ``matrix`` (n-grams x k), over the root of the texts' sizes.

        As many texts at once as pick at most CELLS cells of the matrix, or one.
        """
        start, at = self.places(texts)
        total, low = np.zeros((len(texts), matrix.shape[1])), 0
        while low < len(texts):
            high = max(low + 1, int(np.searchsorted(start, start[low] + CELLS // max(1, matrix.shape[1]), side="right")) - 1)
            some = low + np.flatnonzero(np.diff(start[low:high + 1]))
            if len(some):
                total[some] = np.add.reduceat(matrix[at[start[low]:start[high]]], start[some] - start[low], axis=0, dtype=np.float64)
            low = high
        return total / np.sqrt(np.maximum(1, [len(t) for t in texts]))[:, None]

    def kernel(self, texts: list[np.ndarray]) -> np.ndarray:
        """Kernel values (texts x landmarks)."""
        return self.product(texts, self.presence) / self.roots

    def folded(self, weights: np.ndarray) -> np.ndarray:
        """Presence matrix times weights (landmarks x k), so that a text's product with it is its kernel's."""
        weights = weights / self.roots[:, None]
        step = max(1, CELLS // max(1, len(self.roots)))
        parts = [self.presence[low:low + step] @ weights for low in range(0, len(self.keys), step)]
        return np.concatenate(parts) if parts else np.zeros((0, weights.shape[1]))


def inverse_root(k: np.ndarray, least: float = 1e-6) -> np.ndarray:
    """K^(-1/2) over the eigenvalues above ``least`` of the greatest (equal landmarks lose rank, no more)."""
    value, vector = np.linalg.eigh((k + k.T) / 2)
    keep = value > least * max(value.max(initial=0), 1e-12)
    return vector[:, keep] / np.sqrt(value[keep])


def ridge(x: np.ndarray, y: np.ndarray, penalty: float) -> np.ndarray:
    """Weights of least squares with a penalty on their squares."""
    return np.linalg.solve(x.T @ x + penalty * np.eye(x.shape[1]), x.T @ y)


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text mod 4 is 2; those documents are not learned from (no id counts as '')."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def training_texts(docs: DataFrame, lang_col: str, text_col: str, max_train: int) -> DataFrame:
    """lang, h, grams (sorted longs) of at most about ``max_train`` different texts, as many of each language.

    Of a language the texts with the least hashes are taken; equal texts count once.
    """
    t = docs.select(quoted(lang_col).cast("string").alias("lang"), quoted(text_col).cast("string").alias("text"))
    t = t.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).withColumn("h", F.xxhash64("text"))
    seen = t.select("lang", "h").distinct()
    sizes = written(seen.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "languages")  # one row a language
    quota = max(1, max_train // max(1, sizes.count()))
    # hashes are spread evenly: the first four quotas' worth of a language hold its first quota
    low = F.col("h") / F.lit(2.0 ** 64) + 0.5 <= 4.0 * (quota + 25) / F.col("n")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    few = seen.join(sizes, "lang").where(low).withColumn("place", place).where(F.col("place") <= quota).select("lang", "h")
    chosen = t.join(F.broadcast(few), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text"))

    def body(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            grams = [ngrams(x.as_py()).tobytes() for x in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("h"), pa.array(grams, pa.binary())], ["lang", "h", "grams"])

    return chosen.mapInArrow(body, "lang string, h long, grams binary")


def fit(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", max_train: int = 2000, landmarks: int = 256,
        penalty: float = 1e-2) -> dict:
    """The model of labelled documents: landmark n-grams, their folded weights, languages.

    Learns from at most ``max_train`` different texts (one a language at least), of which
    ``landmarks`` (one a language at least) span the kernel space; neither bound grows with the
    corpus.  NULL languages and texts without a letter are left out; without rows every text is und.
    """
    rows = sorted(written(training_texts(docs, lang_col, text_col, max_train), "language-texts").collect(), key=lambda r: (r["lang"], r["h"]))
    langs = sorted({r["lang"] for r in rows})
    if not rows:
        return {"langs": [], "keys": np.zeros(0, np.int64), "weights": np.zeros((0, 0))}
    texts = [np.frombuffer(r["grams"], np.int64) for r in rows]
    each = max(1, landmarks // len(langs))
    first = {lang: next(i for i, r in enumerate(rows) if r["lang"] == lang) for lang in langs}
    marks = [i for i, r in enumerate(rows) if i - first[r["lang"]] < each]
    spectra = Spectra([texts[i] for i in marks])
    root = inverse_root(spectra.kernel([texts[i] for i in marks]))
    y = np.where(np.array([r["lang"] for r in rows])[:, None] == np.array(langs)[None, :], 1.0, -1.0)
    weights = ridge(spectra.kernel(texts) @ root, y, penalty * len(rows) / len(langs))
    return {"langs": langs, "keys": spectra.keys, "weights": spectra.folded(root @ weights)}


def predict(docs: DataFrame, model: dict, text_col: str = "text", out: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with all its columns, ``out`` and ``score``: the likeliest learned language of every whole text.

    score is half of one plus the winning output, cut to 0..1; ties go to the language that sorts
    first.  Texts that are NULL or hold no letter are ``und`` with score 0.  Columns of ``docs`` that
    already have these names are replaced.  No shuffle.
    """
    docs = docs.drop(*[c for c in (out, score) if c != text_col])
    langs, at = model["langs"], docs.columns.index(text_col)
    spectra, weights = Spectra([]), model["weights"]
    spectra.keys = model["keys"]

    def body(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for low in range(0, b.num_rows, BATCH):
                part = b.slice(low, BATCH)
                raw = [x.as_py() or "" for x in part.column(at)]
                known = [bool(langs) and has_letter(t) for t in raw]
                got = spectra.product([ngrams(t) if k else np.zeros(0, np.int64) for t, k in zip(raw, known, strict=True)], weights)
                best = [{"lang": langs[int(g.argmax())], "score": float(min(1.0, max(0.0, (1 + g.max()) / 2)))} if k else
                        {"lang": UNKNOWN, "score": 0.0} for g, k in zip(got, known, strict=True)]
                kind = pa.struct([("lang", pa.string()), ("score", pa.float64())])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(best, kind)], [*part.schema.names, "added"])

    kind = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())])
    found = with_arrow_column(docs, body, "__language", kind)
    return found.select(*[quoted(c) for c in docs.columns], F.col("__language.lang").alias(out), F.col("__language.score").alias(score))
