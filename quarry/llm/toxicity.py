"""Toxicity by noisy-channel deobfuscation.

Disguised words (digits and signs for letters, letters spaced out, letters repeated) span a lattice
of possible spellings; Viterbi finds the likeliest one under a character trigram model counted over
the whole corpus and channel costs for each disguise.  Runs and words of any length are decoded; the
separators of a run may stand for word boundaries, so that it can hold several words.  The score looks words and restored words up
in a lexicon of stems that is induced from labelled documents.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import quoted, with_arrow_column, written

# Character classes of the language model: 0 no letter, 1 other letter, then a-z and the Latin letters to U+017F.
N_CLASSES = 192
FIRST, LAST = 0xDF, 0x17F
# What a sign may stand for (channel table).
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s",
        "!": "i", "|": "il", "+": "t", "€": "e", "(": "c", "*": "", "#": ""}
SIGN_COST, DROP_COST, REPEAT_COST = 1.0, 3.0, 0.5
SEPARATORS = " .-_*"
MARGIN, LONGEST = 5.0, 32
SIGNS = "".join(re.escape(c) for c in LEET)
EDGE = ".,;:?*#%&()[]{}<>\"'`~^_=/\\-|!+$"
DISGUISED = re.compile(rf"[^\W\d_][{SIGNS}]+[^\W\d_]|^[{SIGNS}][^\W\d_]{{2}}|[^\W\d_]{{2}}\d$|[^\W\d_][.\-_][^\W\d_]")
REPEATED = re.compile(r"([^\W\d_])\1\1")
SPACED = re.compile(rf"(?<![\w{SIGNS}])(?:[^\W_]|[@$!|+]){{1}}(?:[ .\-_*](?:[^\W_]|[@$!|+])){{2,}}(?![\w])")
PREFIXES = (4, 5, 6, 7)
SHORT = 3


def class_table() -> np.ndarray:
    """Class of each code point below U+3000; letters beyond the table's own range share class 1."""
    t = np.zeros(0x3000, np.int32)
    for c in range(0x3000):
        if chr(c).isalpha():
            t[c] = 1
    for c in range(26):
        t[ord("a") + c] = 2 + c
    t[FIRST:LAST + 1] = 28 + np.arange(LAST + 1 - FIRST)
    t[0xF7] = 0
    return t


CLASSES = class_table()


def classes_of(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(codes < len(CLASSES), CLASSES[np.minimum(codes, len(CLASSES) - 1)], 1)


def trigram_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Character trigrams of all whole lower-cased texts: gram (three classes in base N_CLASSES), n."""
    def body(batches: Iterator[pa.RecordBatch]):
        total = np.zeros(N_CLASSES ** 3, np.int64)
        for b in batches:
            for text in b.column(0).to_pylist():
                if text:
                    c = np.concatenate([[0], classes_of(text.lower()), [0]]).astype(np.int64)
                    grams, n = np.unique((c[:-2] * N_CLASSES + c[1:-1]) * N_CLASSES + c[2:], return_counts=True)
                    total[grams] += n
        grams = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(grams, pa.int64()), pa.array(total[grams], pa.int64())], ["gram", "n"])

    return docs.select(quoted(text_col).alias("text")).mapInArrow(body, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


class CharModel:
    """Interpolated character trigram model: -log P(c | a, b) over classes."""

    def __init__(self, grams: dict[int, int]):
        self.tri = grams
        self.bi, self.uni, self.left, self.mid = Counter(), Counter(), Counter(), Counter()
        for g, n in grams.items():
            ab, c = divmod(g, N_CLASSES)
            b = ab % N_CLASSES
            self.left[ab] += n
            self.bi[b * N_CLASSES + c] += n
            self.mid[b] += n
            self.uni[c] += n
        self.total = max(1, sum(self.uni.values()))

    def cost(self, a: int, b: int, c: int) -> float:
        p = 0.05 * (self.uni.get(c, 0) + 0.5) / (self.total + 0.5 * N_CLASSES)
        ab = a * N_CLASSES + b
        if self.mid.get(b):
            p += 0.25 * self.bi.get(b * N_CLASSES + c, 0) / self.mid[b]
        if self.left.get(ab):
            p += 0.7 * self.tri.get(ab * N_CLASSES + c, 0) / self.left[ab]
        return -math.log(p + 1e-9)


def letter_class(c: str) -> int:
    return int(CLASSES[ord(c)]) if ord(c) < len(CLASSES) else int(c.isalpha())


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """Steps of (letters, channel cost): runs of a letter may shrink to two or one, signs may be read or dropped."""
    steps, i = [], 0
    while i < len(token):
        c, j = token[i], i
        while j < len(token) and token[j] == c:
            j += 1
        run = j - i
        if c.isalpha():
            steps.append([(c * k, REPEAT_COST * (run - k) ** 0.5 if run > k else 0.0) for k in range(1, min(run, 2) + 1)
                          if run > 2 or k == run])
        else:
            read = [(x, SIGN_COST + REPEAT_COST * (run > 1)) for x in LEET.get(c, "")]
            drop = 0.0 if c in SEPARATORS else DROP_COST
            steps.append([*read, ("", drop)])
        i = j
    return steps


def decode(token: str, model: CharModel) -> str:
    """Likeliest spelling of a disguised token: Viterbi over the lattice, state = last two letter classes.

    Time and memory are linear in the token: states keep a link to the state before, not their text.
    """
    best: dict = {(0, 0): (0.0, None)}
    for step in [*lattice(token), [("\0", 0.0)]]:
        new: dict = {}
        for (a, b), (cost, link) in best.items():
            for letters, channel in step:
                x, y, total = a, b, cost + channel
                for c in letters:
                    k = 0 if c == "\0" else letter_class(c)
                    total += model.cost(x, y, k)
                    x, y = y, k
                if (x, y) not in new or total < new[x, y][0]:
                    new[x, y] = (total, (link, letters))
        best = new
    link, out = min(best.values(), key=lambda v: v[0])[1], []
    while link is not None:
        link, letters = link
        out.append(letters)
    return "".join(reversed(out)).rstrip("\0")


def words_in(run: str, model: CharModel) -> set[str]:
    """Words of a run of letters whose separators may be word boundaries: those of every reading that
    costs at most MARGIN more than the best one (forward and backward Viterbi, linear in the run).

    A word inside has at most LONGEST letters; a longer one gives its first LONGEST, which hold all its
    marked prefixes.
    """
    g, n = [0, *map(letter_class, run)], len(run)
    cost = model.cost
    # least cost up to letter k (1..n) as the first of a word, and from there to the end
    ahead, inside = [0.0, cost(0, 0, g[1])], math.inf  # inside: letter k - 1 within a word, its boundary not yet read
    for k in range(2, n + 1):
        first = min(ahead[k - 1] + cost(0, g[k - 1], 0), inside + cost(g[k - 2], g[k - 1], 0)) + cost(g[k - 1], 0, g[k])
        inside = min(ahead[k - 1] + cost(0, g[k - 1], g[k]), inside + cost(g[k - 2], g[k - 1], g[k]))
        ahead.append(first)
    back, within = [0.0] * (n + 2), 0.0
    for k in range(n, 0, -1):  # back[k]: after letter k as a first letter; within: after it inside a word
        end = 0.0 if k == n else cost(g[k], 0, g[k + 1]) + back[k + 1]
        go_on = math.inf if k == n else within
        here = cost(g[k - 1], g[k], 0) + end, (cost(g[k - 1], g[k], g[k + 1]) + go_on if k < n else math.inf)
        back[k] = min(cost(0, g[k], 0) + end, cost(0, g[k], g[k + 1]) + go_on if k < n else math.inf)
        within = min(here)
    limit, found = ahead[1] + back[1] + MARGIN, set()
    for i in range(1, n + 1):
        if ahead[i] + back[i] > limit:
            continue
        total, before = ahead[i], 0
        for k in range(i, min(n, i + LONGEST - 1) + 1):
            end = 0.0 if k == n else cost(g[k], 0, g[k + 1]) + back[k + 1]
            if total + cost(before, g[k], 0) + end <= limit:
                found.add(run[i - 1:k])
            if k < n:
                total, before = total + cost(before, g[k], g[k + 1]), g[k]
        else:
            if n >= i + LONGEST and total <= limit:
                found.add(run[i - 1:i - 1 + LONGEST])
    return found


class Words(dict):
    """Token -> tuple of the word forms to look up: its letters, and the restored spelling if disguised."""

    def __init__(self, model: CharModel, keep: int = 200_000):
        super().__init__()
        self.model, self.keep = model, keep

    def __missing__(self, token: str) -> tuple[str, ...]:
        if len(self) >= self.keep:
            self.clear()
        core = token.strip(EDGE)
        forms = [core] if core else []
        signed = token.strip(".,;:?\"'%&*#")
        for t in dict.fromkeys((core, signed)):
            if DISGUISED.search(t) or REPEATED.search(t):
                word = decode(t, self.model)
                if word and word not in forms:
                    forms.append(word)
        forms = tuple(forms)
        if len(token) <= 64:
            self[token] = forms
        return forms

    def forms(self, text: str) -> set[str]:
        """All word forms of a whole text: plain, restored, and restored from spaced-out letters."""
        text = text.lower()
        out = {f for token in set(text.split()) for f in self[token]}
        for m in SPACED.finditer(text):
            out.update(self[re.sub(r"[ .\-_*]", "", m[0])])
            run = decode(m[0], self.model)
            if run:
                out.update((run, *words_in(run, self.model)))
        return out


def stems(word: str) -> list[str]:
    """A word form and its prefixes (marked), so that inflections share one."""
    return [word, *[word[:k] + "~" for k in PREFIXES if len(word) >= k]]


def features(forms: set[str]) -> set[str]:
    """Stems of a text's word forms; prefixes of two and of three different forms also count as
    features of their own (a stem that recurs in many inflections says more than a chance one)."""
    n = Counter(s for f in forms for s in stems(f))
    return {*n, *(s + "2" for s, k in n.items() if k > 1), *(s + "3" for s, k in n.items() if k > 2)}


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, where: Column | None,
                  max_train: int) -> DataFrame:
    """text, y of at most about ``max_train`` labelled documents (lowest hashes of the id)."""
    y = labels.select(quoted(id_col).alias("id"), quoted(label_col).cast("int").alias("y")).where("id is not null and y is not null")
    if where is not None:
        y = y.where(where)
    n = y.count()
    limit = min(2 ** 63 - 1, int(max_train / max(n, 1) * 2 ** 64) - 2 ** 63)
    y = y.where(F.xxhash64("id") <= F.lit(limit)).groupBy("id").agg(F.max("y").alias("y"))
    return docs.select(quoted(id_col).alias("id"), quoted(text_col).alias("text")).join(y, "id").select("text", "y")


def induce_lexicon(toxic: list[set[str]], counts: dict[str, tuple[int, int]], n_clean: int):
    """Greedy cover of the toxic documents by stems: [(stem, P(toxic | stem))], share of toxic ones left.

    Each turn takes the stem that covers most uncovered documents less five times its clean
    documents, and ends when a stem gains fewer than three; a copied document's chance words thus
    never enter once its toxic word has.  Then stems join that stand beside eight or more different
    sets of lexicon stems: toxic words mix freely, the words of copies always stand with the same
    ones.  Ties: the longer stem, then the alphabetically first.
    """
    by: dict[str, set[int]] = {}
    for i, feats in enumerate(toxic):
        for f in feats:
            by.setdefault(f, set()).add(i)
    left, chosen, live = set(range(len(toxic))), [], dict(by)
    while left and live:
        gain = {f: len(d & left) - 5 * counts[f][1] for f, d in live.items()}
        live = {f: d for f, d in live.items() if gain[f] >= 3}
        if not live:
            break
        f = min(live, key=lambda f: (-gain[f], -len(f), f))
        chosen.append(f)
        left -= live.pop(f)
    first = set(chosen)
    signature = [frozenset(feats & first) for feats in toxic]
    chosen += sorted(f for f, d in by.items() if f not in first and counts[f][1] <= 0.02 * counts[f][0]
                     and len({signature[i] for i in d} - {frozenset()}) >= 8)
    uncovered = (len(left) + 0.5) / (len(left) + n_clean + 1.0)
    return [(f, (counts[f][0] + 0.5) / (sum(counts[f]) + 1.0)) for f in chosen], uncovered


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        where: Column | None = None, max_train: int = 20_000, least_docs: int = 5) -> dict:
    """Character model of the whole corpus and a stem lexicon from labelled documents.

    ``where`` (over column ``id``) limits the labels that may be learned from.  The lexicon is
    learned from at most about ``max_train`` labelled rows, a bound that does not grow.  Without
    labels the lexicon is empty and every text scores the same.
    """
    grams = {r["gram"]: r["n"] for r in trigram_counts(docs, text_col).collect()}  # at most N_CLASSES ** 3, by construction
    shared = docs.sparkSession.sparkContext.broadcast(grams)
    rows = training_rows(docs, labels, id_col, text_col, label_col, where, max_train)

    def body(batches: Iterator[pa.RecordBatch]):
        words = Words(CharModel(shared.value))
        for b in (whole.slice(k, 100) for whole in batches for k in range(0, whole.num_rows, 100)):  # bounds the strings held
            feats = [sorted(features(words.forms(t))) if t else [] for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(feats, pa.list_(pa.string())), b.column("y")], ["feats", "y"])

    seen = written(rows.mapInArrow(body, T.StructType([T.StructField("feats", T.ArrayType(T.StringType())),
                                                       T.StructField("y", T.IntegerType())])), "stems")
    toxic = (F.col("y") == 1).cast("long")
    by = seen.select(F.explode("feats").alias("f"), "y").groupBy("f").agg(F.sum(toxic).alias("t"), F.count(F.lit(1)).alias("n"))
    useful = by.where((F.col("t") >= least_docs) & (F.col("n") - F.col("t") <= 0.2 * F.col("t")))
    counts = {r["f"]: (r["t"], r["n"] - r["t"]) for r in useful.collect()}
    # of the bounded training rows, one set of useful stems each
    found = [set(r["feats"]) & counts.keys() for r in seen.where("y = 1").select("feats").toLocalIterator()]
    n_clean = seen.where("y = 0").count()
    lexicon, rest = induce_lexicon(found, counts, n_clean)
    return {"grams": shared, "lexicon": dict(lexicon), "rest": rest}


def score(docs: DataFrame, model: dict, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with all its columns and ``out``: P(toxic) of every whole text, 0..1.

    1 - (1 - rest) * product of (1 - P(toxic | stem)) over the lexicon stems among the text's word
    forms.  NULL and empty texts have none and score as any text without a stem.  No shuffle.
    """
    at, grams, lexicon, rest = docs.columns.index(text_col), model["grams"], model["lexicon"], model["rest"]
    heads = {s[:SHORT] for s in lexicon}

    def body(batches: Iterator[pa.RecordBatch]):
        words = Words(CharModel(grams.value))
        for b in batches:
            scores = []
            for text in b.column(at).to_pylist():
                forms = words.forms(text) if text else set()
                near = {f for f in forms if f[:SHORT] in heads}  # only these can hold a lexicon stem
                clean = 1 - rest
                for s in features(near) & lexicon.keys() if near else ():
                    clean *= 1 - lexicon[s]
                scores.append(1 - clean)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64())], [*b.schema.names, "added"])

    return with_arrow_column(docs, body, out, T.DoubleType())


def held_out(doc_id: Column) -> Column:
    """The rows whose labels are never learned from: crc32 of the id as text, mod 5, is 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0
