"""Evaluation of scores and predictions.

A cutoff sweep is one pass over the scored rows: each row gets the number of
cutoffs it passes, counts per (that number, label) form a table of at most
2 x (cutoffs + 1) rows, and every cutoff's confusion matrix is a sum over that
small table.  Deciles use the exact ntile of :mod:`rank`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.order import q
from quarry.operators.rank import ntile_bucket
from quarry.operators.select import count_below


def _pred(score: Column, cutoff, inclusive: bool) -> Column:
    return (score >= F.lit(cutoff)) if inclusive else (score > F.lit(cutoff))


def confusion(df: DataFrame, label: str, score: str, cutoff: float, inclusive: bool = True) -> DataFrame:
    """L1: (actual, predicted, n) at a cutoff; ``>=`` (R) when inclusive, ``>`` (Python) otherwise."""
    p = _pred(q(score), cutoff, inclusive).cast("int")
    return df.groupBy(q(label).cast("int").alias("actual"), p.alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def _metrics(tp, fp, tn, fn):
    tot = tp + fp + tn + fn
    return [F.try_divide((tp + tn).cast("double"), tot.cast("double")).alias("accuracy"),
            F.try_divide(tp.cast("double"), (tp + fn).cast("double")).alias("sensitivity"),
            F.try_divide(tn.cast("double"), (tn + fp).cast("double")).alias("specificity")]


def binary_metrics(df: DataFrame, label: str, score: str, cutoff: float, inclusive: bool = True,
                   positive: int = 1) -> DataFrame:
    """L2: accuracy, sensitivity, specificity at a cutoff; the positive class is explicit (Q19)."""
    act = q(label).cast("int") == F.lit(positive)
    pr = _pred(q(score), cutoff, inclusive)
    if positive != 1:
        pr = ~pr
    row = df.agg(F.count_if(act & pr).alias("tp"), F.count_if(~act & pr).alias("fp"),
                 F.count_if(~act & ~pr).alias("tn"), F.count_if(act & ~pr).alias("fn"))
    tp, fp, tn, fn = (F.col(x).cast("long") for x in ("tp", "fp", "tn", "fn"))
    return row.select(tp.alias("tp"), fp.alias("fp"), tn.alias("tn"), fn.alias("fn"), *_metrics(tp, fp, tn, fn))


def cutoff_sweep(df: DataFrame, label: str, score: str, cutoffs: Sequence[float], inclusive: bool = True) -> DataFrame:
    """L3: confusion counts and L2 metrics for every cutoff, in one pass over the data.

    Output: cutoff, tp, fp, tn, fn, accuracy, sensitivity, specificity.  Rows without a score or a
    label take no part.
    """
    cs = sorted(float(c) for c in cutoffs)
    arr = F.array(*[F.lit(c) for c in cs])
    s = q(score).cast("double")
    # each row goes to the number of cutoffs it passes, found by bisection: at most 2 x (cutoffs + 1)
    # groups, counted map-side
    rows = df.where(s.isNotNull() & q(label).isNotNull()).select(s.alias("__v"), q(label).cast("int").alias("__y"))
    counts = count_below(rows, F.col("__v"), arr, len(cs), "__b", inclusive).groupBy("__b", "__y").agg(F.count(F.lit(1)).alias("__n"))
    # a zero-count identity row gives every cutoff a row even when there is no data
    zero = df.sparkSession.range(1).select(F.lit(0).alias("__b"), F.lit(0).alias("__y"), F.lit(0).cast("long").alias("__n"))
    counts = counts.select("__b", "__y", F.col("__n").cast("long").alias("__n")).unionByName(zero)
    # each of the <= 2 x (cutoffs + 1) + 1 count rows meets every cutoff through a generator
    j = counts.select("__b", "__y", "__n", F.posexplode(arr).alias("__i", "cutoff")).withColumn("__i", F.col("__i") + 1)
    predicted = F.col("__b") >= F.col("__i")
    pos = F.col("__y") == 1
    g = j.groupBy("cutoff").agg(
        F.sum(F.when(predicted & pos, F.col("__n")).otherwise(0)).cast("long").alias("tp"),
        F.sum(F.when(predicted & ~pos, F.col("__n")).otherwise(0)).cast("long").alias("fp"),
        F.sum(F.when(~predicted & ~pos, F.col("__n")).otherwise(0)).cast("long").alias("tn"),
        F.sum(F.when(~predicted & pos, F.col("__n")).otherwise(0)).cast("long").alias("fn"))
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    return g.select("cutoff", "tp", "fp", "tn", "fn", *_metrics(tp, fp, tn, fn))


def best_cutoffs(sweep: DataFrame, tol: float = 0.01) -> DataFrame:
    """L4: cutoffs of maximal accuracy, and cutoffs where sensitivity and specificity
    cross (|difference| < tol) -> (kind, cutoff, accuracy, sensitivity, specificity)."""
    w = Window.partitionBy()  # the sweep holds one row per cutoff
    best = sweep.withColumn("__m", F.max("accuracy").over(w)).where(F.col("accuracy") == F.col("__m")) \
        .select(F.lit("max_accuracy").alias("kind"), "cutoff", "accuracy", "sensitivity", "specificity")
    cross = sweep.where(F.abs(F.col("sensitivity") - F.col("specificity")) < tol) \
        .select(F.lit("crossing").alias("kind"), "cutoff", "accuracy", "sensitivity", "specificity")
    return best.unionByName(cross)


def ks_table(sweep: DataFrame) -> DataFrame:
    """KS = TPR - FPR per cutoff, with a flag on the maximum (ties: every tied cutoff flagged)."""
    ks = F.col("sensitivity") - (F.lit(1.0) - F.col("specificity"))
    t = sweep.select("cutoff", ks.alias("ks"))
    return t.withColumn("is_max", F.col("ks") == F.max("ks").over(Window.partitionBy()))


def max_ks(sweep: DataFrame, prefer: str = "largest") -> DataFrame:
    """The single cutoff of maximal KS; ties resolved explicitly (Q24): 'largest' cutoff
    (the reference's effective choice) or 'smallest'.  An aggregate over the sweep rows."""
    ks = F.col("sensitivity") - (F.lit(1.0) - F.col("specificity"))
    c = F.col("cutoff") if prefer == "smallest" else -F.col("cutoff")
    best = sweep.agg(F.min(F.struct((-ks).alias("__k"), c.alias("__c"))).alias("__b"))
    out_c = F.col("__b.__c") if prefer == "smallest" else -F.col("__b.__c")
    return best.select(out_c.alias("cutoff"), (-F.col("__b.__k")).alias("ks"))


def lift_table(df: DataFrame, label: str, score: str, key: Sequence[str], groups: int = 10) -> DataFrame:
    """Gain and lift by score decile (descending): bucket, total, responses, cumulative
    responses, gain %, cumulative lift, and the perfect-model gain (computed, Q26)."""
    need = list(dict.fromkeys([label, score, *key]))
    b = ntile_bucket(df.select(*[q(c) for c in need]), score, groups, key, descending=True, out="bucket")
    g = b.groupBy("bucket").agg(F.count(F.lit(1)).alias("total"),
                                F.sum(q(label).cast("long")).alias("responses"))
    w = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)  # `groups` rows
    all_w = Window.partitionBy()
    g = (g.withColumn("cum_responses", F.sum("responses").over(w))
          .withColumn("cum_total", F.sum("total").over(w))
          .withColumn("__pos", F.sum("responses").over(all_w)))
    gain = F.col("cum_responses") * F.lit(100.0) / F.col("__pos")
    return g.select("bucket", "total", "responses", "cum_responses", gain.alias("gain"),
                    (gain / (F.col("bucket") * F.lit(100.0 / groups))).alias("cum_lift"),
                    F.least(F.lit(100.0), F.col("cum_total") * F.lit(100.0) / F.col("__pos")).alias("perfect_gain"))


def multiclass_report(df: DataFrame, label: str, pred: str) -> DataFrame:
    """Per class sensitivity, specificity, PPV, NPV, prevalence, detection rate,
    detection prevalence, balanced accuracy, plus overall accuracy and Cohen's kappa.

    One ``groupBy(label, pred).count()``; everything else is arithmetic on that
    k x k table and its margins.
    """
    cm = df.groupBy(q(label).alias("actual"), q(pred).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    act = cm.groupBy(F.col("actual").alias("cls")).agg(F.sum("n").alias("n_actual"))
    prd = cm.groupBy(F.col("predicted").alias("cls")).agg(F.sum("n").alias("n_pred"))
    dia = cm.where(F.col("actual") == F.col("predicted")).select(F.col("actual").alias("cls"), F.col("n").alias("tp"))
    classes = act.select("cls").unionByName(prd.select("cls")).distinct()
    t = classes.join(act, "cls", "left").join(prd, "cls", "left").join(dia, "cls", "left").fillna(
        0, ["n_actual", "n_pred", "tp"])
    all_w = Window.partitionBy()  # k rows
    t = t.withColumn("N", F.sum("n_actual").over(all_w)).withColumn("correct", F.sum("tp").over(all_w)) \
        .withColumn("pe", F.sum(F.col("n_actual").cast("double") * F.col("n_pred")).over(all_w))
    N = F.col("N").cast("double")
    tp, na, np_ = F.col("tp").cast("double"), F.col("n_actual").cast("double"), F.col("n_pred").cast("double")
    fp, fn = np_ - tp, na - tp
    tn = N - tp - fp - fn
    acc = F.col("correct") / N
    pe = F.col("pe").cast("double") / (N * N)
    sens = F.try_divide(tp, tp + fn)
    spec = F.try_divide(tn, tn + fp)
    return t.select(F.col("cls").alias("class"), sens.alias("sensitivity"), spec.alias("specificity"),
                    F.try_divide(tp, tp + fp).alias("ppv"), F.try_divide(tn, tn + fn).alias("npv"),
                    (na / N).alias("prevalence"), (tp / N).alias("detection_rate"),
                    (np_ / N).alias("detection_prevalence"), ((sens + spec) / 2).alias("balanced_accuracy"),
                    acc.alias("accuracy"), F.try_divide(acc - pe, F.lit(1.0) - pe).alias("kappa"))


def forecast_accuracy(df: DataFrame, by: Sequence[str], actual: str, forecast: str) -> DataFrame:
    """ME, RMSE, MAE, MPE, MAPE of forecasts against actuals, per series."""
    a, f = q(actual).cast("double"), q(forecast).cast("double")
    e = a - f
    return df.groupBy(*[q(b) for b in by]).agg(
        F.avg(e).alias("me"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
        F.avg(F.try_divide(e, a) * 100).alias("mpe"), F.avg(F.abs(F.try_divide(e, a)) * 100).alias("mape"))
