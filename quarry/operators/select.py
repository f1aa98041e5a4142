"""Exact order statistics without sorting: brackets around the wanted ranks, narrowed pass by pass.

A mergeable sketch proposes cut values for each group; they need not be exact.  One pass counts the
rows between (and at) the cuts, so every wanted rank is known to lie at a cut or between two.  Rows
between two cuts that hold a wanted rank are gathered when they are few, and cut again when they are
many.  Each pass is an aggregate over the column; rows are neither range-partitioned, sorted nor
written, and only cuts and counts travel through the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quarry.operators.order import q, row_index, running_total
from quarry.session import cut_lineage

LIMIT = 50_000  # rows between two cuts that one buffer gathers; more are cut again
GROUPS = 64  # groups whose cuts go through the driver; more are written as a small table
MOST_CUTS = 1024  # a pass narrows a bracket by about this factor


def count_below(df: DataFrame, value: Column, cuts: Column, size: int, out: str, inclusive: bool = True) -> DataFrame:
    """Adds ``out``: how many of the sorted array ``cuts`` (at most ``size``) are <= ``value`` (or < it).

    A bisection in log2(size) comparisons of generated code, one projection each.
    """
    df, step = df.withColumn(out, F.lit(0)), 1 << max(0, size.bit_length() - 1)
    while step and size:
        there = F.get(cuts, F.col(out) + (step - 1))
        passed = there <= value if inclusive else there < value
        df, step = df.withColumn(out, F.when(passed, F.col(out) + step).otherwise(F.col(out))), step >> 1
    return df


def _local(spark: SparkSession, rows: list[tuple], schema: T.StructType) -> DataFrame:
    """A small table of the driver as a local relation (no Python worker), to be broadcast."""
    kinds = to_arrow_schema(schema)
    columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
    arrays = [pa.array(list(c), f.type) for c, f in zip(columns, kinds, strict=True)]
    return F.broadcast(spark.createDataFrame(pa.Table.from_arrays(arrays, schema=kinds), schema))


def _fixed(df: DataFrame, most: int) -> tuple[DataFrame, Callable[[Column], bool]]:
    """A small table as data, so that every later pass sees the same rows: through the driver when it has
    at most ``most`` rows, else written.  With it a test whether some row meets a condition."""
    rows = df.limit(most + 1).toArrow()
    if rows.num_rows > most:
        table = cut_lineage(df, "cuts")
        return table, lambda cond: not table.where(cond(F.col)).isEmpty()
    facts = {c: rows.column(c).to_numpy(zero_copy_only=False) for c in ("n", "c", "i") if c in rows.column_names}
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema)), lambda cond: bool(np.any(cond(facts.__getitem__)))


def _matched(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on keys that may be NULL, with the key columns of ``left``."""
    r = right.select(*[F.col(k).alias(f"__m_{k}") for k in keys], *[F.col(c) for c in right.columns if c not in keys])
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__m_{k}"))
    return left.join(r, cond).drop(*[f"__m_{k}" for k in keys])


def _sorted_ranks(values: DataFrame, keys: Sequence[str], want: DataFrame) -> DataFrame:
    """The wanted ranks by a distributed running total over the distinct values (for what no sketch can cut)."""
    counts = values.groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("c"))
    cum = running_total(counts, ["v"], F.col("c"), list(keys), "cum")
    j = _matched(cum, want, keys).withColumn("before", F.col("cum") - F.col("c"))
    hit = F.filter("ranks", lambda r: (r > F.col("before")) & (r <= F.col("cum")))
    return j.select(*keys, F.explode(hit).alias("k"), "v", "before", F.col("c").alias("ties"))


def _gathered(rows: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The wanted ranks of intervals (keys, i) whose few rows are gathered in one sorted buffer each."""
    mine = [*keys, "i"]
    vs = _matched(rows, wanted.select(*mine), mine).groupBy(*mine).agg(F.array_sort(F.collect_list("v")).alias("vs"))
    found = _matched(vs, wanted.select(*mine, "before", "n", "ranks"), mine).select("*", F.explode("ranks").alias("k"))
    found = found.withColumn("v", F.element_at("vs", (F.col("k") - F.col("before")).cast("int")))
    found = found.withColumn("before", F.col("before") + F.array_position("vs", F.col("v")) - 1)
    return found.withColumn("ties", F.size(F.filter("vs", lambda y: y == F.col("v"))).cast("long"))


def select_ranks(values: DataFrame, keys: Sequence[str], want: Callable[[Column], Column] | DataFrame, m: int,
                 limit: int | None = None, depth: int = 0) -> DataFrame:
    """Values at 1-based ranks (ascending) of the non-NULL column ``v`` within ``keys``.

    ``want`` maps a group's size to an array of ranks, or is a table (keys, ranks); ``m`` is about how
    many ranks a group has and only sets the number of cuts.  Returns (keys, k, v, before, ties, n):
    ``before`` rows are less than v, ``ties`` rows equal it, ``n`` is the group's size.
    """
    keys, limit = list(keys), LIMIT if limit is None else limit
    kind = values.schema["v"].dataType
    n_cuts = min(MOST_CUTS, max(256, 4 * m))
    grid = F.expr(f"array({', '.join(f'{i / (n_cuts + 1)!r}D' for i in range(1, n_cuts + 1))})")
    numeric = isinstance(kind, T.NumericType)
    # a sketch of a group that is gathered whole anyway is thrown away
    cuts = F.percentile_approx("v", grid, 4 * n_cuts) if numeric else F.lit(None).cast(T.ArrayType(kind))
    sizes = values.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), cuts.alias("s"))
    empty = F.array().cast(T.ArrayType(kind))
    sizes = sizes.withColumn("s", F.when(F.col("n") > limit, F.array_distinct("s")).otherwise(empty))
    if callable(want):
        state = sizes.withColumn("ranks", want(F.col("n")))
    else:
        state = _matched(sizes, want, keys)
    state, some = _fixed(state, GROUPS)
    columns = [*keys, "k", "v", "before", "ties", "n"]
    if not some(lambda c: c("n") > limit):  # every group is gathered whole
        whole = state.withColumns({"i": F.lit(0), "before": F.lit(0).cast("long")})
        return _gathered(values.withColumn("i", F.lit(0)), whole, keys).select(*columns)
    if not numeric:
        found = _sorted_ranks(values, keys, state.select(*keys, "ranks"))
        return _matched(found, state.select(*keys, "n"), keys)
    # place of a row: 2i between cut i and the next, 2i - 1 at cut i
    j = _matched(values, state.select(*keys, "s"), keys)
    j = count_below(j, F.col("v"), F.col("s"), n_cuts, "__le")
    at = F.coalesce(F.get("s", F.col("__le") - 1) == F.col("v"), F.lit(False))
    at = F.when((F.col("__le") > 0) & at, F.lit(1)).otherwise(F.lit(0))
    j = j.select(*keys, "v", (2 * F.col("__le") - at).alias("i"))
    counts = j.groupBy(*keys, "i").agg(F.count(F.lit(1)).alias("c"))
    total = F.sum("c").over(Window.partitionBy(*keys).orderBy("i"))  # at most 2 * n_cuts + 1 rows a group
    counts = _matched(counts.withColumn("before", total - F.col("c")), state, keys)
    hit = F.filter("ranks", lambda r: (r > F.col("before")) & (r <= F.col("before") + F.col("c")))
    held = counts.select(*keys, "i", "before", "c", "n", hit.alias("ranks"),
                         F.when(F.col("i") % 2 == 1, F.get("s", F.floor(F.col("i") / 2).cast("int"))).alias("x"))
    held, some = _fixed(held.where(F.size("ranks") > 0), 4096)
    # wanted ranks at a cut
    single = held.where(F.col("i") % 2 == 1).select(*keys, F.explode("ranks").alias("k"), F.col("x").alias("v"), "before",
                                                    F.col("c").alias("ties"), "n").select(*columns)
    # between cuts, few rows: gathered and sorted
    between = held.where((F.col("i") % 2 == 0) & (F.col("c") <= limit)).drop("x")
    out = single.unionByName(_gathered(j, between, keys).select(*columns))
    # between cuts, many rows: the same again, by themselves
    if not some(lambda c: (c("i") % 2 == 0) & (c("c") > limit)):
        return out
    wide = held.where((F.col("i") % 2 == 0) & (F.col("c") > limit)).drop("x")
    inner = f"__i{depth}"
    part = _matched(j, wide.select(*keys, "i"), [*keys, "i"]).withColumnRenamed("i", inner)
    local = wide.select(*keys, F.col("i").alias(inner), F.transform("ranks", lambda r: r - F.col("before")).alias("ranks"))
    deeper = [*keys, inner]
    stuck = some(lambda c: (c("i") % 2 == 0) & (c("c") > limit) & (c("c") == c("n")))  # values that the sketch cannot tell apart
    found = _sorted_ranks(part, deeper, local) if stuck else select_ranks(part, deeper, local, m, limit, depth + 1).drop("n")
    offset = wide.select(*keys, F.col("i").alias(inner), F.col("before").alias("__off"), "n")
    found = _matched(found, offset, deeper)
    found = found.withColumn("k", F.col("k") + F.col("__off")).withColumn("before", F.col("before") + F.col("__off"))
    return out.unionByName(found.select(*columns))


def order_statistics(df: DataFrame, c: str, positions: Callable[[Column], Column], by: Sequence[str] = (),
                     m: int = 10, limit: int | None = None) -> DataFrame:
    """Values at 1-based ranks of the non-NULL values of ``c`` (within ``by``): (by..., __k, __v, __n).

    ``positions(n)`` maps a group's count to an array<long> of wanted ranks.  NaN is the greatest value.
    """
    by = list(by)
    keys = [f"__b{i}" for i in range(len(by))] or ["__one"]
    named = [q(b).alias(k) for b, k in zip(by, keys, strict=True)] if by else [F.lit(1).alias("__one")]
    values = df.where(q(c).isNotNull()).select(*named, q(c).alias("v"))
    found = select_ranks(values, keys, positions, m, limit)
    return found.select(*[F.col(k).alias(b) for k, b in zip(keys, by, strict=False)], F.col("k").alias("__k"),
                        F.col("v").alias("__v"), F.col("n").alias("__n"))


def _plain(x):
    """One object for every NaN, so that tuples with it are equal."""
    return math.nan if isinstance(x, float) and math.isnan(x) else x


Order = Sequence[tuple[str, bool]]  # column name, descending


def order_bounds(df: DataFrame, order: Order, ranks: Callable[[int], Sequence[int]], limit: int | None = None) -> tuple[list[int], list[tuple] | None]:
    """The wanted 1-based ranks of the rows in ``order`` (``ranks`` maps the row count to them), and for
    each the order columns of the row there, as tuples on the driver.

    NULLs come first in rising and last in falling order, as Spark sorts.  A tuple stops at the first
    column that tells its row from all others.  No tuples (None) if some rank falls between rows that
    are equal in every order column.
    """
    limit = LIMIT if limit is None else limit
    names = [f"c{i}" for i in range(len(order))]
    rows = df.select(*[q(c).alias(n) for (c, _), n in zip(order, names, strict=True)])
    spark, done, wanted_ranks = df.sparkSession, {}, []
    open_ranks = {}  # values of the order columns so far -> {rank: rank among the rows that share them}
    for level, (name, (_, falling)) in enumerate(zip(names, order, strict=True)):
        keys = names[:level] or ["__one"]
        part = rows if level else rows.withColumn("__one", F.lit(1))
        if level:  # the rows that share the order columns so far with a wanted one
            schema = T.StructType([T.StructField(k, rows.schema[k].dataType) for k in keys])
            part = _matched(part, _local(spark, list(open_ranks), schema), keys)
        sizes = {_group(r, names[:level]): (r["a"], r["a"] - r["b"]) for r in
                 part.groupBy(*keys).agg(F.count(F.lit(1)).alias("a"), F.count(name).alias("b")).collect()}
        if not level:
            wanted_ranks = list(ranks(sizes.get((), (0, 0))[0]))
            open_ranks = {(): {r: r for r in wanted_ranks}} if wanted_ranks else {}
        if not open_ranks:
            break
        wanted, back, nxt, few = [], {}, {}, {}

        def settle(g, value, local, ties, original):
            if ties == 1:
                done[original] = (*g, value)
            else:
                (few if ties <= limit else nxt).setdefault((*g, value), {})[original] = local  # noqa: B023

        for g, at in open_ranks.items():
            n, nulls = sizes[g]
            asc = []
            for original, r in at.items():
                first, last = (0, n - nulls) if falling else (nulls, n)
                if first < r <= last:
                    a = (n - nulls) - (r - first) + 1 if falling else r - first
                    asc.append(a)
                    back.setdefault((g, a), []).append((original, r - first))
                else:
                    settle(g, None, r - (0 if not falling else n - nulls), nulls, original)
            if asc:
                wanted.append((*(g or (1,)), sorted(set(asc))))
        if wanted:
            schema = T.StructType([T.StructField(k, part.schema[k].dataType) for k in keys] + [T.StructField("ranks", T.ArrayType(T.LongType()))])
            values = part.where(F.col(name).isNotNull()).select(*keys, F.col(name).alias("v"))
            for r in select_ranks(values, keys, _local(spark, wanted, schema), len(wanted_ranks), limit).collect():
                g = _group(r, names[:level])
                for original, rank in back[g, r["k"]]:
                    ahead = r["n"] - r["before"] - r["ties"] if falling else r["before"]
                    settle(g, _plain(r["v"]), rank - ahead, r["ties"], original)
        if few and not _ranked_ties(rows, order, names, level + 1, few, done):
            return wanted_ranks, None
        open_ranks = nxt
    for g, at in open_ranks.items():  # equal in every order column: fine where the block ends at the rank
        same = F.lit(True)
        for n, x in zip(names, g, strict=True):
            same = same & F.col(n).eqNullSafe(F.lit(x))
        ties = rows.where(same).count()
        if any(local < ties for local in at.values()):
            return wanted_ranks, None
        done.update(dict.fromkeys(at, g))
    return wanted_ranks, [done[r] for r in wanted_ranks]


def _group(row, names: Sequence[str]) -> tuple:
    return tuple(_plain(row[k]) for k in names)


def _ranked_ties(rows: DataFrame, order: Order, names: Sequence[str], level: int, few: dict, done: dict) -> bool:
    """Settles the ranks within groups of few rows that share ``level`` order columns, by ranking those rows.

    False if a rank falls between rows that are equal in every order column.
    """
    keys, rest = names[:level], list(zip(names, order, strict=True))[level:]
    schema = T.StructType([T.StructField(k, rows.schema[k].dataType) for k in keys]
                          + [T.StructField("ranks", T.ArrayType(T.LongType()))])
    wanted = [(*g, sorted({r for x in at.values() for r in (x, x + 1)})) for g, at in few.items()]
    w = Window.partitionBy(*keys).orderBy(*[F.col(n).desc() if falling else F.col(n).asc() for n, (_, falling) in rest] or [F.lit(1)])
    part = _matched(rows, _local(rows.sparkSession, wanted, schema), keys).withColumn("__r", F.row_number().over(w))
    found = {}
    for r in part.where(F.array_contains("ranks", F.col("__r").cast("long"))).select(*names, "__r").collect():
        found[_group(r, keys), r["__r"]] = _group(r, names)
    for g, at in few.items():
        for original, local in at.items():
            if found[g, local] == found.get((g, local + 1)):
                return False
            done[original] = found[g, local]
    return True


def after_bound(order: Order, bound: tuple) -> Column:
    """Whether a row comes after the one that ``bound`` names (see ``order_bounds``)."""
    later, same = F.lit(False), F.lit(True)
    for (c, falling), x in zip(order, bound, strict=False):
        col = q(c)
        if x is None:
            here = F.lit(False) if falling else col.isNotNull()
        else:
            here = F.coalesce(col < F.lit(x) if falling else col > F.lit(x), F.lit(falling))
        later, same = later | (same & here), same & col.eqNullSafe(F.lit(x))
    return later


def indexed(df: DataFrame, order: Order, out: str) -> DataFrame:
    """Row index in ``order`` by a distributed running total, for orders that are not total."""
    return row_index(df, [q(c).desc() if falling else q(c).asc() for c, falling in order], out=out)
