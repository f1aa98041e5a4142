"""Cross-tokenizer links against explicit byte ranges."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest

from quarry.llm import token_links as tl


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer
    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


def by_hand(texts, libraries):
    """Facts of each text from the libraries' own output and byte-range comparisons."""
    a_lib, b_lib = libraries
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    value = {(chr(b) if b in own else chr(next(rest))): b for b in range(256)}
    found, count = [], Counter()
    for text in texts:
        a = a_lib.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_lib.encode(text, num_threads=1) if text else []
        a_raw = [bytes(value[c] for c in a_lib.id_to_token(i)) for i in a]
        b_raw = [bytes([int(b_lib.id_to_piece(i)[3:5], 16)]) if b_lib.is_byte(i) else
                 b_lib.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or b"".join(a_raw) != (" " + text).encode() or b"".join(b_raw) != (" " + text).encode():
            found.append(None)
            continue
        spans = lambda raw: [(sum(map(len, raw[:i])), sum(map(len, raw[:i + 1]))) for i in range(len(raw))]
        sa, sb = spans(a_raw), spans(b_raw)
        links = [(i, j) for i, (p, q) in enumerate(sa) for j, (r, s) in enumerate(sb) if max(p, r) < min(q, s)]
        cuts = sorted({e for _, e in sa} & {e for _, e in sb})
        groups = [([i for i, (_, e) in enumerate(sa) if low < e <= high], [j for j, (_, e) in enumerate(sb) if low < e <= high])
                  for low, high in zip([0, *cuts], cuts, strict=False)]
        count.update((a[i], b[j]) for i, j in links)
        found.append((a, b, groups, links))
    top = defaultdict(int)
    for (_, y), n in count.items():
        top[y] = max(top[y], n)
    out = []
    for f in found:
        if f is None:
            out.append((0, 0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, groups, links = f
        line = ";".join(",".join(str(a[i]) for i in x) + "|" + ",".join(str(b[j]) for j in y) for x, y in groups)
        out.append((len(a), len(b), len(groups), len(links), sum(count[a[i], b[j]] == top[b[j]] for i, j in links),
                    sum(count[a[i], b[j]] for i, j in links), sum(len(x) * len(y) for x, y in groups),
                    hashlib.sha256(line.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("block_bytes", [200, 1 << 20])
def test_statistics_equal_explicit_byte_ranges(docs, rows, libraries, block_bytes):
    short = [r for r in rows if len(r[1] or "") < 3000]
    kept = docs.where("text is null or length(text) < 3000")
    got = sorted((tuple(r) for r in tl.link_statistics(kept, block_bytes=block_bytes).collect()), key=str)
    facts = by_hand([r[1] for r in short], libraries)
    assert got == sorted(((r[0], *f) for r, f in zip(short, facts, strict=True)), key=str)
    assert any(f[0] == 0 for f in facts) and any(f[4] < f[3] for f in facts)


def test_marks_in_the_text_have_no_tokens(spark, libraries):
    texts = ["a ▁ b", "plain words", "<s> <0x0A> <|endoftext|>", " ", "  two ", "\x00"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r[0]: tuple(r)[1:] for r in tl.link_statistics(df).collect()}
    assert [got[i] for i in range(len(texts))] == by_hand(texts, libraries)
    assert got[0] == (0, 0, 0, 0, 0, 0, 0, "") and got[2][0] > 0


def test_real_links_and_extra_columns(clash, empty, rows):
    got = tl.align(clash).collect()
    assert len(got) == len(rows)
    for r in got:
        assert sum(r["link_bytes"]) == (r["cuts"][-1] if r["cuts"] else 0)
        if r["cuts"]:
            assert r["link_a"] == sorted(r["link_a"]) and r["link_a"][-1] == len(r["a_ids"]) - 1
    assert tl.link_statistics(clash).count() == len(rows)
    assert tl.link_statistics(empty).count() == 0 and tl.align(empty).count() == 0


def test_slices_of_a_long_text_are_exact(libraries):
    text = "\n".join(f"word{i}  and {'x' * (i % 40)}, é{i} \t ▁ {' ' * (i % 9)}" for i in range(3000))
    assert tl.Pieces(tl.B_FILE, most=100).encode(text).tolist() == libraries[1].encode(text, num_threads=1)
    x = tl.aligner(tl.A_FILE, tl.B_FILE)("word " * 200_000)
    assert sum(int(v.sum()) for _, _, v in tl.overlap_links(x.a_ends, x.b_ends)) == x.cuts[-1] == 1_000_001


def test_row_products_equal_dense_ones():
    r = np.random.default_rng(3)
    for _ in range(20):
        x, y = r.integers(0, 3, (7, 5)) * (r.random((7, 5)) < 0.4), r.integers(0, 3, (5, 6)) * (r.random((5, 6)) < 0.4)
        rows = lambda m: tl.Rows(np.concatenate([[0], np.cumsum((m != 0).sum(1))]), np.nonzero(m)[1], m[m != 0], m.shape[1])
        z = np.zeros((7, 6), int)
        for i, j, v in rows(x).products(rows(y), most=4):
            z[i, j] += v
        assert (z == x @ y).all() and (rows(x).times(np.arange(5)) == x @ np.arange(5)).all()
        back = np.zeros((5, 7), int)
        t = rows(x).transposed()
        back[np.repeat(np.arange(5), np.diff(t.start)), t.cols] = t.values
        assert (back == x.T).all()


def test_shared_groups():
    a, b = np.array([2, 5, 7, 9]), np.array([3, 5, 6, 8, 9])
    pairs = [(i, j) for x, y, _ in tl.shared_group_links(a, b) for i, j in zip(x.tolist(), y.tolist(), strict=True)]
    assert pairs == [(0, 0), (0, 1), (1, 0), (1, 1), (2, 2), (2, 3), (2, 4), (3, 2), (3, 3), (3, 4)]
    assert tl.shared_group_counts(a, b, tl.common_ends(a, b)).tolist() == [2, 2, 3, 3]
