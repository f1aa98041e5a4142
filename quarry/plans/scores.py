"""Model evaluation (R ROCR/caret and sklearn in the reference): confusion, cutoff sweep,
KS, lift/gain, multi-class report, ntile and running totals.  Bound to `orders`
with label = status 'F' and a deterministic score."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import evaluate, rank
from quarry.plans.tables import scores, with_ctes

# fixed values: the sweep grid of the R study, 100 cutoffs from .01 to .80
CUTOFFS = [0.01 + i * (0.80 - 0.01) / 99 for i in range(100)]
CUTOFFS_SQL = "(VALUES " + ", ".join(f"({c!r})" for c in CUTOFFS) + ") AS c(cutoff)"
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def q_confusion(spark, sf):
    """L1: confusion matrix at cutoff 0.5 (R rule: score >= cutoff)."""
    return evaluate.confusion(scores(spark, sf), "label", "score", 0.5, inclusive=True)


SQL_CONFUSION = with_ctes("""SELECT label AS actual, CAST(score >= 0.5 AS INTEGER) AS predicted, count(*) AS n
FROM scores GROUP BY 1, 2""", "scores")


def q_binary_metrics(spark, sf):
    """L2: accuracy, sensitivity, specificity at 0.44 (Python rule: score > cutoff)."""
    m = evaluate.binary_metrics(scores(spark, sf), "label", "score", 0.44, inclusive=False)
    return m.select("tp", "fp", "tn", "fn", *[F.round(c, 10).alias(c) for c in ("accuracy", "sensitivity", "specificity")])


SQL_BINARY_METRICS = with_ctes("""
, m AS (SELECT count(*) FILTER (WHERE label = 1 AND score > 0.44) AS tp,
               count(*) FILTER (WHERE label = 0 AND score > 0.44) AS fp,
               count(*) FILTER (WHERE label = 0 AND NOT score > 0.44) AS tn,
               count(*) FILTER (WHERE label = 1 AND NOT score > 0.44) AS fn FROM scores)
SELECT tp, fp, tn, fn, round((tp + tn) / (tp + fp + tn + fn), 10) AS accuracy, round(tp / (tp + fn), 10) AS sensitivity,
       round(tn / (tn + fp), 10) AS specificity FROM m""", "scores")

SWEEP_SQL = f"""
, sweep AS (SELECT cutoff, count(*) FILTER (WHERE label = 1 AND score >= cutoff) AS tp,
       count(*) FILTER (WHERE label = 0 AND score >= cutoff) AS fp,
       count(*) FILTER (WHERE label = 0 AND score < cutoff) AS tn,
       count(*) FILTER (WHERE label = 1 AND score < cutoff) AS fn
       FROM scores, {CUTOFFS_SQL} GROUP BY cutoff)
, metrics AS (SELECT cutoff, tp, fp, tn, fn, (tp + tn) / (tp + fp + tn + fn) AS accuracy,
       tp / (tp + fn) AS sensitivity, tn / (tn + fp) AS specificity FROM sweep)"""


def _sweep(spark, sf):
    return evaluate.cutoff_sweep(scores(spark, sf), "label", "score", CUTOFFS, inclusive=True)


def q_cutoff_sweep(spark, sf):
    """L3: 100 cutoffs from one pass over the scored rows."""
    s = _sweep(spark, sf)
    return s.select("cutoff", "tp", "fp", "tn", "fn",
                    *[F.round(c, 10).alias(c) for c in ("accuracy", "sensitivity", "specificity")])


SQL_CUTOFF_SWEEP = with_ctes(SWEEP_SQL + """
SELECT cutoff, tp, fp, tn, fn, round(accuracy, 10) AS accuracy, round(sensitivity, 10) AS sensitivity,
       round(specificity, 10) AS specificity FROM metrics""", "scores")


def q_best_cutoffs(spark, sf):
    """L4: cutoffs of best accuracy and where sensitivity meets specificity."""
    b = evaluate.best_cutoffs(_sweep(spark, sf), tol=0.01)
    return b.select("kind", "cutoff", *[F.round(c, 10).alias(c) for c in ("accuracy", "sensitivity", "specificity")])


SQL_BEST_CUTOFFS = with_ctes(SWEEP_SQL + """
SELECT 'max_accuracy' AS kind, cutoff, round(accuracy, 10) AS accuracy, round(sensitivity, 10) AS sensitivity,
 round(specificity, 10) AS specificity FROM metrics WHERE accuracy = (SELECT max(accuracy) FROM metrics)
UNION ALL SELECT 'crossing', cutoff, round(accuracy, 10), round(sensitivity, 10), round(specificity, 10)
FROM metrics WHERE abs(sensitivity - specificity) < 0.01""", "scores")


def q_ks_table(spark, sf):
    """KS statistic per cutoff and its maximum."""
    k = evaluate.ks_table(_sweep(spark, sf))
    return k.select("cutoff", F.round("ks", 10).alias("ks"), "is_max")


SQL_KS_TABLE = with_ctes(SWEEP_SQL + """
, k AS (SELECT cutoff, sensitivity - (1 - specificity) AS ks FROM metrics)
SELECT cutoff, round(ks, 10) AS ks, ks = max(ks) OVER () AS is_max FROM k""", "scores")


def q_max_ks(spark, sf):
    """The cutoff of maximal KS, ties to the largest cutoff (Q24 made explicit)."""
    k = evaluate.max_ks(_sweep(spark, sf), prefer="largest")
    return k.select("cutoff", F.round("ks", 10).alias("ks"))


SQL_MAX_KS = with_ctes(SWEEP_SQL + """
SELECT cutoff, round(ks, 10) AS ks FROM (SELECT cutoff, sensitivity - (1 - specificity) AS ks FROM metrics)
ORDER BY ks DESC, cutoff DESC LIMIT 1""", "scores")


def q_lift_table(spark, sf):
    """Gain and lift by score decile."""
    t = evaluate.lift_table(scores(spark, sf), "label", "score", ["id"], 10)
    return t.select("bucket", "total", "responses", "cum_responses",
                    *[F.round(c, 8).alias(c) for c in ("gain", "cum_lift", "perfect_gain")])


SQL_LIFT_TABLE = with_ctes("""
, b AS (SELECT label, ntile(10) OVER (ORDER BY score DESC, id) AS bucket FROM scores)
, g AS (SELECT bucket, count(*) AS total, sum(label) AS responses FROM b GROUP BY bucket)
, c AS (SELECT bucket, total, responses, sum(responses) OVER (ORDER BY bucket) AS cum_responses,
        sum(total) OVER (ORDER BY bucket) AS cum_total, sum(responses) OVER () AS pos FROM g)
SELECT bucket, total, CAST(responses AS BIGINT) AS responses, CAST(cum_responses AS BIGINT) AS cum_responses,
 round(cum_responses * 100.0 / pos, 8) AS gain, round((cum_responses * 100.0 / pos) / (bucket * 10.0), 8) AS cum_lift,
 round(least(100.0, cum_total * 100.0 / pos), 8) AS perfect_gain FROM c""", "scores")


def q_ntile_bucket(spark, sf):
    """Score deciles (descending, ties by id): rows and score range per decile."""
    b = rank.ntile_bucket(scores(spark, sf), "score", 10, ["id"])
    return b.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("min_score"),
                                   F.max("score").alias("max_score"), F.min("id").alias("min_id"))


SQL_NTILE_BUCKET = with_ctes("""SELECT CAST(bucket AS BIGINT) AS bucket, count(*) AS n, min(score) AS min_score,
 max(score) AS max_score, min(id) AS min_id FROM (SELECT *, ntile(10) OVER (ORDER BY score DESC, id) AS bucket FROM scores)
GROUP BY bucket""", "scores")


def _cents(spark, sf):
    return scores(spark, sf).withColumn("cents", F.round(F.col("amount") * 100).cast("long"))


def q_cumulative(spark, sf):
    """Running total of order value (in cents) by date then key, exact and distributed."""
    c = rank.cumulative(_cents(spark, sf), [F.col("ordered"), F.col("id")], "cents", out="cum_cents")
    return c.select("id", "cum_cents")


SQL_CUMULATIVE = with_ctes("""SELECT id, CAST(sum(CAST(round(amount * 100) AS BIGINT)) OVER (ORDER BY ordered, id
 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cum_cents FROM scores""", "scores")


def q_share_of_total(spark, sf):
    """Each order's share of the grand total and the cumulative share by date."""
    s = rank.share_of_total(_cents(spark, sf), "cents", order=[F.col("ordered"), F.col("id")])
    return s.select("id", F.round("share", 12).alias("share"), F.round("cum_share", 12).alias("cum_share"))


SQL_SHARE_OF_TOTAL = with_ctes("""
, c AS (SELECT id, ordered, CAST(round(amount * 100) AS BIGINT) AS cents FROM scores)
SELECT id, round(cents / sum(cents) OVER (), 12) AS share,
 round(sum(cents) OVER (ORDER BY ordered, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
       / sum(cents) OVER (), 12) AS cum_share FROM c""", "scores")


def _predicted(spark, sf):
    s = scores(spark, sf)
    guess = F.element_at(F.array(*[F.lit(p) for p in PRIORITIES]), (F.col("id") % 5 + 1).cast("int"))
    return s.withColumn("predicted", F.when(F.col("id") % 3 == 0, guess).otherwise(F.col("priority")))


def q_multiclass_report(spark, sf):
    """Per-class report of a 5-class prediction, with accuracy and kappa."""
    r = evaluate.multiclass_report(_predicted(spark, sf), "priority", "predicted")
    return r.select("class", *[F.round(c, 10).alias(c) for c in r.columns if c != "class"])


SQL_MULTICLASS_REPORT = with_ctes("""
, p AS (SELECT priority AS actual, CASE WHEN id % 3 = 0 THEN ['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED',
        '5-LOW'][id % 5 + 1] ELSE priority END AS predicted FROM scores)
, a AS (SELECT actual AS cls, count(*) AS n_actual FROM p GROUP BY 1)
, q AS (SELECT predicted AS cls, count(*) AS n_pred FROM p GROUP BY 1)
, d AS (SELECT actual AS cls, count(*) AS tp FROM p WHERE actual = predicted GROUP BY 1)
, t AS (SELECT a.cls, n_actual, coalesce(n_pred, 0) AS n_pred, coalesce(tp, 0) AS tp FROM a
        LEFT JOIN q USING (cls) LEFT JOIN d USING (cls))
, z AS (SELECT *, sum(n_actual) OVER () AS N, sum(tp) OVER () AS correct,
        sum(n_actual * n_pred) OVER () AS pe FROM t)
, m AS (SELECT cls, CAST(tp AS DOUBLE) AS tp, CAST(n_pred - tp AS DOUBLE) AS fp, CAST(n_actual - tp AS DOUBLE) AS fn,
        CAST(N - n_pred - n_actual + tp AS DOUBLE) AS tn, CAST(N AS DOUBLE) AS N, n_actual, n_pred,
        correct / N AS acc, pe / (N * N) AS pe FROM z)
SELECT cls AS class, round(tp / (tp + fn), 10) AS sensitivity, round(tn / (tn + fp), 10) AS specificity,
 round(tp / (tp + fp), 10) AS ppv, round(tn / (tn + fn), 10) AS npv, round(n_actual / N, 10) AS prevalence,
 round(tp / N, 10) AS detection_rate, round(n_pred / N, 10) AS detection_prevalence,
 round((tp / (tp + fn) + tn / (tn + fp)) / 2, 10) AS balanced_accuracy, round(acc, 10) AS accuracy,
 round((acc - pe) / (1 - pe), 10) AS kappa FROM m""", "scores")


QUERIES = {
    "confusion": q_confusion, "binary_metrics": q_binary_metrics, "cutoff_sweep": q_cutoff_sweep,
    "best_cutoffs": q_best_cutoffs, "ks_table": q_ks_table, "max_ks": q_max_ks, "lift_table": q_lift_table,
    "ntile_bucket": q_ntile_bucket, "cumulative": q_cumulative, "share_of_total": q_share_of_total,
    "multiclass_report": q_multiclass_report,
}
ORACLE = {
    "confusion": SQL_CONFUSION, "binary_metrics": SQL_BINARY_METRICS, "cutoff_sweep": SQL_CUTOFF_SWEEP,
    "best_cutoffs": SQL_BEST_CUTOFFS, "ks_table": SQL_KS_TABLE, "max_ks": SQL_MAX_KS, "lift_table": SQL_LIFT_TABLE,
    "ntile_bucket": SQL_NTILE_BUCKET, "cumulative": SQL_CUMULATIVE, "share_of_total": SQL_SHARE_OF_TOTAL,
    "multiclass_report": SQL_MULTICLASS_REPORT,
}
