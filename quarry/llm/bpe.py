"""Byte-level BPE over Arrow batches with the tokenizers library.

``ByteBPE`` wraps a tokenizers model: a JSON file as it is, or a rank file (token bytes in base64
and rank a line) rebuilt as a BPE model whose merges are every split of a token into two tokens,
in rank order.  White space before a word always starts a new pre-token, so a text is cut into
chunks there and each distinct chunk is encoded by the library once and kept in a bounded table.
Decoding maps tokens back through the byte table; characters that are split over tokens come
together again because bytes are joined before they are read as UTF-8.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import quoted

# Unicode White_Space, the class that \s means in the pre-token pattern (fixed values).
SPACE = "\x09-\x0d \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# A leading run of common letters with an ASCII non-letter behind it is a pre-token; else everything up
# to white space is one chunk, which the library cuts further.
CHUNK = re.compile(f" ?[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+(?![A-Za-z\x80-\U0010ffff])"
                   f"| ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def byte_characters() -> list[str]:
    """Character of each byte: printable bytes stand for themselves, the others follow from U+0100."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def tokenizer_of_ranks(path: str, pattern: str):
    """A tokenizers BPE tokenizer equal to the rank file's byte-level encoding."""
    from tokenizers import Regex, Tokenizer
    from tokenizers.models import BPE
    from tokenizers.pre_tokenizers import ByteLevel, Sequence, Split
    char = byte_characters()
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
    spell = lambda t: "".join(char[b] for b in t)
    merges = [(spell(t[:i]), spell(t[i:])) for t, _ in sorted(ranks.items(), key=lambda x: x[1]) if len(t) > 1
              for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
    tok = Tokenizer(BPE({spell(t): r for t, r in ranks.items()}, merges, ignore_merges=True))
    tok.pre_tokenizer = Sequence([Split(Regex(pattern), "isolated"), ByteLevel(add_prefix_space=False, use_regex=False)])
    return tok


class ByteBPE(dict):
    """Chunk -> ids (little-endian bytes), filled by the library on a miss.

    Two generations of at most ``keep`` chunks each: when the young one is full it becomes the old
    one, whose chunks come back as they are used.
    """

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN, keep: int = 250_000):
        from tokenizers import Tokenizer
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path) if path.endswith(".json") else tokenizer_of_ranks(path, pattern)
        self.tokenizer.encode_special_tokens = True  # their spelling in a text is ordinary text
        self.model = self.tokenizer.model  # for single pre-tokens whose bytes are mapped here
        self.spelling = dict(enumerate(byte_characters()))
        self.keep, self.old = keep, {}
        value = {c: b for b, c in enumerate(byte_characters())}
        vocab = self.tokenizer.get_vocab()
        size = max(vocab.values()) + 1
        self.letter, self.dtype = ("H", np.dtype("<u2")) if size <= 1 << 16 else ("I", np.dtype("<u4"))
        self.token_bytes = [b""] * size
        for t, i in vocab.items():
            self.token_bytes[i] = bytes(value[c] for c in t) if all(c in value for c in t) else t.encode()
        self.lengths = np.array([len(t) for t in self.token_bytes], np.int64)
        self.decimals = [str(i) for i in range(size)]

    def __missing__(self, chunk: str) -> bytes:
        ids = self.old.get(chunk)
        if ids is None:
            if chunk.isalpha() or chunk[1:].isalpha() and chunk[0] == " ":
                found = [t.id for t in self.model.tokenize(chunk.encode().decode("latin-1").translate(self.spelling))]
            else:
                found = self.tokenizer.encode(chunk, add_special_tokens=False).ids
            ids = struct.pack(f"<{len(found)}{self.letter}", *found)
        if len(self) >= self.keep:
            self.old = dict(self)
            self.clear()
        if len(chunk) <= 64:
            self[chunk] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.__getitem__, CHUNK.findall(text))), self.dtype)

    def byte_starts(self, ids: np.ndarray) -> np.ndarray:
        """Offset in the UTF-8 text of each token's first byte."""
        return np.concatenate([[0], np.cumsum(self.lengths[ids])])[:len(ids)].astype(np.int64)

    def decode_bytes(self, ids) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, ids))

    def decode(self, ids) -> str:
        """Text of the ids; bytes that are no UTF-8 (a cut character) become U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", "replace")


_CODECS: dict = {}


def codec(path: str, pattern: str = public_tokenizers.PATTERN) -> ByteBPE:
    """One codec per worker process and file."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = ByteBPE(path, pattern)
    return _CODECS[path, pattern]


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    return [x or "" for x in batch.column(column).to_pylist()]


def _mapped(docs: DataFrame, id_col: str, cols: dict, body, schema: T.StructType) -> DataFrame:
    """``mapInArrow`` of the id and the given columns only; other columns stay behind."""
    picked = docs.select(quoted(id_col).alias("doc_id"), *[quoted(c).alias(k) for k, c in cols.items()])
    schema = T.StructType([T.StructField("doc_id", picked.schema["doc_id"].dataType), *schema.fields])
    return picked.mapInArrow(body, schema)


def encode(docs: DataFrame, path: str = RANKS, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """doc_id, ids (array<int>), byte_starts (array<long>: each token's first byte in the UTF-8 text).

    One row per input row in place (no shuffle); NULL and empty texts give empty arrays.  The
    vocabulary file must be readable at ``path`` on every worker.
    """
    def body(batches: Iterator[pa.RecordBatch]):
        bpe = codec(path, pattern)
        for b in batches:
            got = [bpe.encode(x) for x in texts_of(b, "text")]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([x.astype(np.int32) for x in got], pa.list_(pa.int32())),
                 pa.array([bpe.byte_starts(x) for x in got], pa.list_(pa.int64()))], ["doc_id", "ids", "byte_starts"])

    return _mapped(docs, id_col, {"text": text_col}, body, T.StructType([
        T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("byte_starts", T.ArrayType(T.LongType()))]))


def decode(encoded: DataFrame, path: str = RANKS, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id",
           ids_col: str = "ids") -> DataFrame:
    """doc_id, text, bytes of arrays of ids (NULL: empty); see ``ByteBPE.decode`` for cut characters."""
    def body(batches: Iterator[pa.RecordBatch]):
        bpe = codec(path, pattern)
        for b in batches:
            raw = [bpe.decode_bytes(x or []) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([x.decode("utf-8", "replace") for x in raw], pa.string()),
                                              pa.array(raw, pa.binary())], ["doc_id", "text", "bytes"])

    return _mapped(encoded, id_col, {"ids": ids_col}, body,
                   T.StructType([T.StructField("text", T.StringType()), T.StructField("bytes", T.BinaryType())]))


def round_trip(docs: DataFrame, path: str = RANKS, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """Encode, then decode the ids: doc_id, n_tokens, ids_sha256, decoded_sha256, exact.

    Digests of the decimal ids joined by commas and of the decoded bytes; ``exact`` says whether
    the decoded bytes are the text's.  NULL texts count as empty.
    """
    def body(batches: Iterator[pa.RecordBatch]):
        bpe = codec(path, pattern)
        for b in batches:
            n, ids_sha, text_sha, exact = [], [], [], []
            for text in texts_of(b, "text"):
                ids = bpe.encode(text).tolist()
                raw = bpe.decode_bytes(ids)
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join(map(bpe.decimals.__getitem__, ids)).encode()).hexdigest())
                text_sha.append(hashlib.sha256(raw).hexdigest())
                exact.append(raw == text.encode())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()),
                                              pa.array(text_sha, pa.string()), pa.array(exact, pa.bool_())],
                                             ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "exact"])

    return _mapped(docs, id_col, {"text": text_col}, body, T.StructType([
        T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()), T.StructField("exact", T.BooleanType())]))
