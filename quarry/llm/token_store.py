"""Token-id shards as wavelet matrices: one compressed file image per shard.

Documents are range-partitioned and sorted by doc_id, tokenised, and each run of at most
``max_tokens`` tokens becomes one file: document table, and one bit-plane per id bit (highest
first) with its rank directory, every part compressed on its own so that a lookup opens only what
it needs.  Files are the binary rows of a Parquet table in the shared folder, so that Spark's
commit protocol covers them on any store.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.bpe import codec
from quarry.llm.common import quoted, written

MAGIC = b"QWM1"
BLOCK = 512  # bits per entry of the rank directory
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def pack(ids: np.ndarray, doc_ids: np.ndarray, lengths: np.ndarray) -> bytes:
    """File image of the concatenated ids of consecutive documents.

    Layout: magic, header (tokens, documents, planes), part sizes, then the compressed parts:
    doc_ids (int64), lengths (int64), and per plane its bits and its rank directory (ones before
    each block, uint32).  A plane is followed by the stable partition of the ids by its bit.
    """
    press = zstandard.ZstdCompressor(level=1).compress
    x = ids.astype(np.uint32) if ids.size and int(ids.max()) > 0xFFFF else ids.astype(np.uint16)
    planes = max(1, int(x.max()).bit_length()) if x.size else 1
    parts = [press(doc_ids.astype("<i8").tobytes()), press(lengths.astype("<i8").tobytes())]
    for p in range(planes - 1, -1, -1):
        bit = (x & x.dtype.type(1 << p)) != 0
        packed = np.packbits(bit, bitorder="little")
        parts += [press(packed.tobytes()), press(directory(packed).tobytes())]
        x = np.concatenate([np.compress(~bit, x), np.compress(bit, x)])
    head = struct.pack("<4sQQI", MAGIC, len(ids), len(doc_ids), planes)
    return head + struct.pack(f"<{len(parts)}Q", *map(len, parts)) + b"".join(parts)


def directory(packed: np.ndarray) -> np.ndarray:
    """Ones before each block of BLOCK bits, and in all as the last entry."""
    step = BLOCK // 8
    padded = np.concatenate([packed, np.zeros(-len(packed) % step, np.uint8)])
    ones = np.bitwise_count(padded).reshape(-1, step).sum(axis=1, dtype=np.uint32)
    return np.concatenate([[0], np.cumsum(ones, dtype=np.uint32)]).astype("<u4")


class WaveletMatrix:
    """Reader of a file image; planes are unpacked when first touched."""

    def __init__(self, image: bytes):
        magic, self.n, self.n_docs, self.planes = struct.unpack_from("<4sQQI", image)
        if magic != MAGIC:
            raise ValueError("not a token file")
        count, at = 2 + 2 * self.planes, struct.calcsize("<4sQQI")
        sizes = struct.unpack_from(f"<{count}Q", image, at)
        starts = np.concatenate([[0], np.cumsum(sizes)]) + at + 8 * count
        self._parts = [(int(a), int(b)) for a, b in zip(starts, starts[1:], strict=False)]
        self._image, self._open = image, {}

    def _part(self, i: int, dtype: str) -> np.ndarray:
        if i not in self._open:
            a, b = self._parts[i]
            self._open[i] = np.frombuffer(zstandard.ZstdDecompressor().decompress(self._image[a:b]), dtype)
        return self._open[i]

    @property
    def doc_ids(self) -> np.ndarray:
        return self._part(0, "<i8")

    @property
    def lengths(self) -> np.ndarray:
        return self._part(1, "<i8")

    def _bits(self, level: int) -> np.ndarray:
        return self._part(2 + 2 * level, "u1")

    def _dir(self, level: int) -> np.ndarray:
        return self._part(3 + 2 * level, "<u4")

    def _rank1(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        block, bits = i // BLOCK, self._bits(level)
        tail = bits[block * BLOCK // 8:i // 8]
        last = int(bits[i // 8]) & ((1 << i % 8) - 1) if i % 8 else 0
        return int(self._dir(level)[block]) + int(np.bitwise_count(tail).sum()) + last.bit_count()

    def _zeros(self, level: int) -> int:
        return self.n - int(self._dir(level)[-1])

    def _select(self, level: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) bit of a value in a plane: block by the directory, then within it."""
        ones = self._dir(level).astype(np.int64)
        before = ones if bit else np.minimum(np.arange(len(ones)) * BLOCK, self.n) - ones
        block = int(np.searchsorted(before, k, side="right")) - 1
        chunk = np.unpackbits(self._bits(level)[block * BLOCK // 8:(block + 1) * BLOCK // 8], bitorder="little")
        chunk = chunk[:self.n - block * BLOCK]
        return block * BLOCK + int(np.flatnonzero(chunk == bit)[k - int(before[block])])

    def access(self, i: int) -> int:
        """Token at place i."""
        value = 0
        for level in range(self.planes):
            bit = int(self._bits(level)[i // 8]) >> i % 8 & 1
            ones = self._rank1(level, i)
            i = self._zeros(level) + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        """Where the token's occurrences among places lo..hi end up below the last plane."""
        if token >> self.planes:
            return 0, 0
        for level in range(self.planes):
            a, b = self._rank1(level, lo), self._rank1(level, hi)
            z = self._zeros(level)
            lo, hi = (z + a, z + b) if token >> (self.planes - 1 - level) & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of a token among places lo..hi (exclusive)."""
        a, b = self._range(token, lo, self.n if hi is None else hi)
        return b - a

    def select(self, token: int, k: int) -> int:
        """Place of the k-th (from 0) occurrence of a token; IndexError beyond the last."""
        a, b = self._range(token, 0, self.n)
        if not 0 <= k < b - a:
            raise IndexError(k)
        i = a + k
        for level in range(self.planes - 1, -1, -1):
            bit = token >> (self.planes - 1 - level) & 1
            i = self._select(level, bit, i - self._zeros(level) if bit else i)
        return i

    def ids(self) -> np.ndarray:
        """All tokens, by undoing the partitions from the last plane up."""
        x = np.zeros(self.n, np.uint32 if self.planes > 16 else np.uint16)
        for level in range(self.planes - 1, -1, -1):
            bit = np.unpackbits(self._bits(level), count=self.n, bitorder="little").view(bool)
            z, up = self._zeros(level), np.empty_like(x)
            up[np.flatnonzero(~bit)] = x[:z]
            up[np.flatnonzero(bit)] = x[z:] | x.dtype.type(1 << (self.planes - 1 - level))
            x = up
        return x


def write_shards(docs: DataFrame, path: str = VOCABULARY, end_id: int = 2, shards: int | None = None,
                 max_tokens: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise whole texts (NULL: empty), append ``end_id`` to each and write the shard files.

    Returns the written table: part (number of the range partition, in order), seq (the file's place
    in it), n_docs, n_tokens, image.  Both numbers are data of the committed files, so whoever reads
    them later sees the same ones.  Documents stand in ascending doc_id order (NULL ids first; equal
    ids by text hash) within and over files.  A document is never split, so a file holds more than
    ``max_tokens`` only if one document does.  ids are integers.
    """
    t = docs.select(quoted(id_col).cast("long").alias("doc_id"), F.coalesce(quoted(text_col), F.lit("")).alias("text"))
    t = t.withColumn("h", F.xxhash64("text"))
    n = shards or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    t = t.repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h")

    def body(batches: Iterator[pa.RecordBatch]):
        bpe, end = codec(path), np.array([end_id], np.uint32)
        run, ids, size, seq, part = [], [], 0, 0, TaskContext.get().partitionId()

        def file():
            keys = np.array([r[0] if r[0] is not None else -(1 << 63) for r in run], np.int64)
            image = pack(np.concatenate(ids), keys, np.array([r[2] for r in run], np.int64))
            return pa.RecordBatch.from_arrays(
                [*(pa.array([x], pa.int64()) for x in (part, seq, len(run), size)), pa.array([image], pa.binary())],
                ["part", "seq", "n_docs", "n_tokens", "image"])

        for b in batches:
            for d, h, text in zip(b.column("doc_id").to_pylist(), b.column("h").to_pylist(), b.column("text").to_pylist(), strict=True):
                got = bpe.encode(text).astype(np.uint32 if end_id > 0xFFFF or bpe.dtype.itemsize > 2 else np.uint16)
                if run and size + len(got) + 1 > max_tokens:
                    yield file()
                    run, ids, size, seq = [], [], 0, seq + 1
                run.append((d, h, len(got) + 1))
                ids += [got, end.astype(got.dtype)]
                size += len(got) + 1
        if run:
            yield file()

    files = t.mapInArrow(body, "part long, seq long, n_docs long, n_tokens long, image binary")
    return written(files, "token-shards")


def read_shards(files: DataFrame) -> DataFrame:
    """Per document from the files: doc_id, start (tokens before it over all files), n_tokens, ids_crc32.

    File offsets are running sums in two steps: over the files of a part, and over the parts.
    """
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # one row per range partition
    parts = parts.select("part", F.coalesce(F.sum("n").over(before().orderBy("part")), F.lit(0)).alias("part_start"))
    offsets = files.select("part", "seq", F.coalesce(F.sum("n_tokens").over(before("part").orderBy("seq")), F.lit(0)).alias("in_part"))
    offsets = offsets.join(parts, "part").select("part", "seq", (F.col("part_start") + F.col("in_part")).alias("file_start"))

    def body(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for i in range(b.num_rows):
                m = WaveletMatrix(b.column("image")[i].as_py())
                ids, lengths = m.ids().astype("<u4"), m.lengths
                ends = np.cumsum(lengths)
                starts, raw = ends - lengths, ids.data.cast("B")
                crc = [zlib.crc32(raw[4 * a:4 * z]) for a, z in zip(starts.tolist(), ends.tolist(), strict=True)]
                n, null = len(lengths), m.doc_ids == -(1 << 63)
                same = lambda c: pa.array([b.column(c)[i].as_py()] * n, pa.int64())  # noqa: E731,B023
                yield pa.RecordBatch.from_arrays(
                    [same("part"), same("seq"), pa.array(m.doc_ids, pa.int64(), mask=null),
                     pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())],
                    ["part", "seq", "doc_id", "at", "n_tokens", "ids_crc32"])

    docs = files.select("part", "seq", "image").mapInArrow(body, "part long, seq long, doc_id long, at long, n_tokens long, ids_crc32 long")
    return docs.join(offsets, ["part", "seq"]).select("doc_id", (F.col("file_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
