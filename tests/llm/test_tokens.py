"""BPE round trips and wavelet token files against the libraries and plain Python."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from quarry.llm import bpe, token_store
from tokenizers import Tokenizer


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(token_store.VOCABULARY)
    t.encode_special_tokens = True
    return t


def odd_texts():
    r = random.Random(5)
    every = [chr(c) for c in range(0x3100) if not 0xD800 <= c < 0xE000]
    alphabet = "ab 'stré\n\t\r\x0b\x1c\x85\xa0   　1²٣_.!😀"
    out = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(600)]
    out += [f"x {c} y{c}z {c}{c} \n{c}" for c in every]
    out += ["a" * n for n in range(1, 70)] + ["ab" * n for n in range(1, 40)] + [" " * n + "x" for n in range(1, 40)]
    out += ["aaaa" * 5 + "b" * n for n in range(20)] + ["<|endoftext|>", "it's we'll I'VE 's't", "  \n  a  \n"]
    return out


def test_equals_tiktoken(reference):
    codec = bpe.ByteBPE(bpe.RANKS)
    for t in odd_texts():
        ids = codec.encode(t)
        assert ids.tolist() == reference.encode_ordinary(t), repr(t)
        assert codec.decode(ids) == t
        assert codec.byte_starts(ids).tolist() == [sum(map(len, reference.decode_tokens_bytes(ids.tolist())[:i])) for i in range(len(ids))]


def test_equals_tokenizers(library):
    codec = bpe.ByteBPE(token_store.VOCABULARY, keep=50)
    for t in odd_texts():
        assert codec.encode(t).tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_cut_characters():
    codec = bpe.codec(bpe.RANKS)
    ids = codec.encode("𓀀").tolist()
    assert len(ids) > 1 and codec.decode(ids[:1]) == "�" and codec.decode(ids) == "𓀀"


def test_round_trip(docs, clash, rows, reference):
    want = []
    for r in rows:
        t = r[1] or ""
        ids = reference.encode_ordinary(t)
        want.append((r[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest(), True))
    assert sorted((tuple(r) for r in bpe.round_trip(docs).collect()), key=str) == sorted(want, key=str)
    assert sorted((tuple(r) for r in bpe.round_trip(clash).collect()), key=str) == sorted(want, key=str)


def test_encode_decode_frames(docs, empty, rows):
    back = bpe.decode(bpe.encode(docs)).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in back), key=str) == sorted(((r[0], r[1] or "") for r in rows), key=str)
    assert bpe.encode(empty).count() == 0 and bpe.round_trip(empty).count() == 0


@pytest.mark.parametrize("top", [1, 2, 300, 50257, 70000])
def test_wavelet_matrix(top):
    r = np.random.default_rng(top)
    for n in (0, 1, 7, 511, 512, 513, 5000):
        ids = (r.integers(0, top, n) ** 2 // max(1, top)).astype(np.uint32)
        m = token_store.WaveletMatrix(token_store.pack(ids, np.array([4, 9]), np.array([n, 0])))
        assert m.ids().tolist() == ids.tolist() and m.doc_ids.tolist() == [4, 9] and m.lengths.tolist() == [n, 0]
        for i in r.integers(0, max(n, 1), 15 if n else 0).tolist():
            assert m.access(i) == ids[i]
            t, lo = int(ids[i]), n // 3
            assert m.count(t) == (ids == t).sum() and m.count(t, lo, i) == (ids[lo:i] == t).sum() or i < lo
            places = np.flatnonzero(ids == t)
            k = int(r.integers(0, len(places)))
            assert m.select(t, k) == places[k]
            with pytest.raises(IndexError):
                m.select(t, len(places))
        assert m.count(top + 5) == 0 and m.count(1 << 20) == 0


@pytest.mark.parametrize("most", [1 << 22, 300, 1])
def test_shard_files(docs, clash, rows, library, most):
    got = sorted((tuple(r) for r in token_store.read_shards(token_store.write_shards(docs, max_tokens=most)).collect()), key=lambda r: r[1])
    ids = {r: library.encode(r or "", add_special_tokens=False).ids + [2] for r in {r[1] for r in rows}}
    crc = lambda t: zlib.crc32(np.array(ids[t], "<u4").tobytes())
    assert sorted(((r[0], len(ids[r[1]]), crc(r[1])) for r in rows), key=str) == sorted(((r[0], r[2], r[3]) for r in got), key=str)
    at = 0
    for r in got:
        assert r[1] == at
        at += r[2]
    order = [-1 if r[0] is None else r[0] for r in got]
    assert order == sorted(order)
    if most == 300:
        again = token_store.read_shards(token_store.write_shards(clash, max_tokens=most))
        assert sorted(tuple(r) for r in again.drop("start").na.fill(-1).collect()) == sorted((-1 if r[0] is None else r[0], *r[2:]) for r in got)


def test_no_documents(empty):
    assert token_store.read_shards(token_store.write_shards(empty)).count() == 0
