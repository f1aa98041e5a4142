"""Quality rules: base text measures plus cross-document line frequency, all native Spark SQL.

Lines are normalised (lower case, runs of white space as one blank, trimmed) and hashed together
with their host.  A line is frequent when it stands in more than ``max_docs_per_host`` documents
of different content of one host; exact copies of a text count as one document, they are the
business of deduplication.  Frequent lines are removed, and a document left with less than
``min_left`` of its words is depleted and rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import quoted

# The white space of the word rule, as a Java pattern.
GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8


def bound(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, GAP), "")


def n_repeat_words(words: Column) -> Column:
    """Words covered by ``WINDOW``-word windows that stand twice or more in the array.

    Windows are compared by a 64-bit hash.  Arrays without a repeated window (nearly all) stop
    after counting the distinct hashes; only the others sort their windows.
    """
    def covered(pairs: Column) -> Column:
        twice = F.filter(pairs, lambda p, i: (p["h"] == F.get(pairs, i - 1)["h"])
                         | (p["h"] == F.get(pairs, i + 1)["h"]))
        starts = F.sort_array(F.transform(twice, lambda p: p["at"]))
        return bound(starts, lambda s: F.aggregate(
            F.transform(s, lambda at, i: F.least(F.lit(WINDOW), F.coalesce(F.get(s, i + 1) - at, F.lit(WINDOW)))),
            F.lit(0).cast("long"), lambda total, x: total + x))

    def count(hashes: Column) -> Column:
        sorted_pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")) \
                .otherwise(bound(sorted_pairs, covered))

    def hashes_of(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(w, i, WINDOW)))

    return bound(words, lambda w: F.when(F.size(w) <= WINDOW, F.lit(0).cast("long"))
                 .otherwise(bound(hashes_of(w), count)))


def base_measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the base measures of every whole text (NULL text: no words).

    n_words, word_chars (code points in words), n_symbols, n_dup_lines (lines with a word that
    equal an earlier line), n_repeat_words, base_failed.  One row per input row, repeated rows
    included; no shuffle.
    """
    t = docs.select(quoted(id_col).alias("doc_id"), F.coalesce(quoted(text_col), F.lit("")).alias("t"))
    t = t.select("doc_id", "t", words_of(F.col("t")).alias("w"))
    t = t.select("doc_id", F.col("w"), F.array_join("w", "").alias("joined"),
                 F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    t = t.select(
        "doc_id", F.size("w").cast("long").alias("n_words"), F.length("joined").cast("long").alias("word_chars"),
        (F.length("joined") - F.length(F.regexp_replace("joined", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        n_repeat_words(F.col("w")).alias("n_repeat_words"))
    return t.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def host_lines(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """One row per line with a word: doc_id, content (hash of the whole text), line (hash of host
    and normalised line), n (words of the line).  A NULL host is a host of its own."""
    t = docs.select(quoted(id_col).alias("doc_id"), quoted(host_col).alias("host"), quoted(text_col).alias("t"))
    t = t.where(F.col("t").isNotNull()).select(
        "doc_id", "host", F.xxhash64("t").alias("content"),
        F.explode(F.split(F.lower("t"), "\n")).alias("line"))
    t = t.select("doc_id", "host", "content", words_of(F.col("line")).alias("w")).where(F.size("w") > 0)
    return t.select("doc_id", "content", F.size("w").cast("long").alias("n"),
                    F.xxhash64(F.col("host").isNull(), "host", F.array_join("w", " ")).alias("line"))


def frequent_lines(lines: DataFrame, max_docs_per_host: int) -> DataFrame:
    """Lines of more than ``max_docs_per_host`` different documents: line, n_docs.

    The first grouping is by line and content, so the rows of one very common line are dealt over
    all tasks; the second one only sums partial counts.
    """
    once = lines.groupBy("line", "content").agg(F.lit(1).alias("one"))
    return once.groupBy("line").agg(F.count("one").alias("n_docs")).where(F.col("n_docs") > max_docs_per_host)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
                  max_docs_per_host: int = 50, min_left: float = 0.2) -> DataFrame:
    """Base measures, words lost to frequent lines and the verdict, one row per input row.

    Columns: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    n_removed_words, kept.  ``kept`` is false for a base failure and for a depleted document.
    NULL and empty texts have no words and fail the base rules.  Rows that share a doc_id (NULL
    ids included) count as one document: they share n_removed_words, the sum over their rows
    divided by the number of rows.
    """
    base = base_measures(docs, id_col, text_col)
    lines = host_lines(docs, id_col, text_col, host_col)
    hits = lines.join(frequent_lines(lines, max_docs_per_host).select("line"), "line")
    lost = hits.groupBy(F.col("doc_id").alias("lost_id")).agg(F.sum("n").alias("lost"))
    rows_of = base.groupBy(F.col("doc_id").alias("rows_id")).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    out = (base.join(lost, F.col("doc_id").eqNullSafe(F.col("lost_id")), "left")
           .join(rows_of, F.col("doc_id").eqNullSafe(F.col("rows_id")), "left"))
    removed = F.floor(F.coalesce("lost", F.lit(0)) / F.coalesce("copies", F.lit(1))).cast("long")
    out = out.withColumn("n_removed_words", removed)
    depleted = (F.col("n_words") - F.col("n_removed_words")) < min_left * F.col("n_words")
    return out.select(*base.columns, "n_removed_words", (~F.col("base_failed") & ~depleted).alias("kept"))


def without_frequent_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
                           max_docs_per_host: int = 50) -> DataFrame:
    """``docs`` with its frequent lines removed from the text; all columns kept, NULL text stays NULL."""
    lines = host_lines(docs, id_col, text_col, host_col)
    frequent = frequent_lines(lines, max_docs_per_host).select("line")
    bad = (lines.join(frequent, "line").groupBy(F.col("doc_id").alias("__id"))
           .agg(F.collect_set("line").alias("__bad")))
    key = lambda x: F.xxhash64(quoted(host_col).isNull(), quoted(host_col),
                               F.array_join(words_of(F.lower(x)), " "))
    rest = F.array_join(F.filter(F.split(quoted(text_col), "\n"), lambda x: ~F.array_contains("__bad", key(x))), "\n")
    joined = docs.join(bad, quoted(id_col).eqNullSafe(F.col("__id")), "left")
    return joined.select(*[F.when(F.col("__bad").isNull(), quoted(c)).otherwise(rest).alias(c) if c == text_col
                           else quoted(c) for c in docs.columns])
