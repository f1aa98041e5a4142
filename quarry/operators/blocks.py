"""Sums of products over blocks of rows: Gram matrices, pairwise moments, batched IRLS and hinge fits in one pass each.

A task turns its Arrow batches into numpy blocks and adds up dense products, so p columns cost one
matrix product a block and not p * p expressions.  Its result is the matrix in pieces of rows; these are
merged in two grouped sums, first over FAN parts of the tasks, then over the parts.  Only p-sized
matrices reach the driver, and every pass reads the table once whatever the number of fits.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Generator, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.order import q
from quarry.session import cut_lineage

FAN = 64  # tasks' results are added in this many parts first
CELLS = 1 << 16  # matrix cells of one merged piece


def summed_rows(df: DataFrame, width: int, rows: int, step: Callable[[np.ndarray, np.ndarray], None]) -> np.ndarray:
    """The sum over all tasks of a rows x width matrix that ``step(total, block)`` adds a block of rows to.

    ``df`` holds double columns only; a NULL is NaN in the block.
    """
    lows = range(0, rows, max(1, CELLS // width))

    def body(batches: Iterator[pa.RecordBatch]):
        total = np.zeros((rows, width))
        for b in batches:
            if b.num_rows:
                step(total, np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns]))
        part = TaskContext.get().partitionId() % FAN
        pieces = [total[low:low + lows.step].ravel() for low in lows]
        yield pa.RecordBatch.from_arrays([pa.array(lows, pa.int32()), pa.array([part] * len(lows), pa.int32()),
                                          pa.array(pieces, pa.list_(pa.float64()))], ["low", "part", "v"])

    def added(t: pa.Table) -> pa.Table:
        v = t.column("v").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1).sum(0)
        return pa.table({"low": t.column("low")[:1], "part": t.column("part")[:1], "v": pa.array([v], pa.list_(pa.float64()))})

    schema = "low int, part int, v array<double>"
    parts = df.mapInArrow(body, schema).groupBy("low", "part").applyInArrow(added, schema)
    found = parts.withColumn("part", F.lit(0)).groupBy("low", "part").applyInArrow(added, schema).toArrow()
    out = np.zeros((rows, width))
    for low, v in zip(found.column("low").to_pylist(), found.column("v"), strict=True):
        out[low:low + lows.step] = v.values.to_numpy().reshape(-1, width)
    return out


def doubles(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*[q(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)])


def gram_blocks(df: DataFrame, cols: Sequence[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """Over the rows without NULLs: X'X (uncentred), column sums, number of rows."""
    p = len(cols)

    def step(total, x):
        x = np.column_stack([x, np.ones(len(x))])
        total += x.T @ x

    g = summed_rows(doubles(df, cols).dropna(), p + 1, p + 1, step)
    return g[:p, :p], g[p, :p], int(round(g[p, p]))


def correlations(df: DataFrame, cols: Sequence[str]) -> np.ndarray:
    """Pearson correlations of all pairs, each over the rows where both are present (NaN: one row or no spread)."""
    p, x = len(cols), doubles(df, cols)
    mean = x.agg(*[F.avg(c) for c in x.columns]).first()  # sums around the means do not cancel
    mean = np.array([m if m is not None else 0.0 for m in mean])

    def step(total, x):
        there = ~np.isnan(x)
        x, m = np.where(there, x - mean, 0.0), there.astype(float)
        total[:, :p] += m.T @ m
        total[:, p:2 * p] += x.T @ m
        total[:, 2 * p:3 * p] += (x * x).T @ m
        total[:, 3 * p:] += x.T @ x

    n, s, ss, xy = np.split(summed_rows(x, 4 * p, p, step), 4, axis=1)
    with np.errstate(all="ignore"):
        spread = np.sqrt((ss - s * s / n) * (ss - s * s / n).T)
        r = (xy - s * s.T / n) / spread
    return np.where(n > 1, r, np.nan)


@dataclass
class Fit:
    """A logistic fit: coefficients (constant last), their covariance, deviance, aic, and how it ended."""

    cols: tuple[str, ...]
    beta: np.ndarray
    covariance: np.ndarray
    deviance: float
    aic: float
    n: int
    iterations: int
    converged: bool

    def p_values(self) -> dict[str, float]:
        """Two-sided p-value of each column's z."""
        z = np.abs(self.beta) / np.sqrt(np.diag(self.covariance))
        return {c: math.erfc(v / math.sqrt(2)) for c, v in zip(self.cols, z, strict=False)}

    def inflation(self) -> dict[str, float]:
        """Variance inflation factors: diag(inv(R)), R the correlations of the columns' coefficients."""
        v = self.covariance[:-1, :-1]
        d = np.sqrt(np.diag(v))
        return dict(zip(self.cols, np.diag(np.linalg.inv(v / np.outer(d, d))).tolist(), strict=True))


def logit_fits(df: DataFrame, y: str, sets: Sequence[Sequence[str]], max_iter: int = 50, tol: float = 1e-8) -> list[Fit]:
    """Binomial GLMs (logit link, constant) of ``y`` on each set of columns, by iterated weighted least squares.

    All fits that still move share each pass over the rows without NULLs in any of the columns, so the
    passes of a batch are the iterations of its slowest fit.  A fit ends when its deviance changes by
    less than ``tol`` of itself; ``converged`` says whether it did.
    """
    names = list(dict.fromkeys(c for s in sets for c in s))
    place = {c: i for i, c in enumerate(names)}
    at = [[*(place[c] for c in s), len(names)] for s in sets]
    x = doubles(df, [*names, y]).dropna()
    state = [{"beta": np.zeros(len(a)), "deviance": math.inf, "ended": False, "iterations": 0, "h": None} for a in at]
    width = max(map(len, at), default=1)
    n = 0
    for turn in range(max_iter + 1):
        live = [i for i, s in enumerate(state) if not s["ended"]]
        if not live:
            break
        betas, tall = [state[i]["beta"] for i in live], width + 1

        def step(total, block, live=live, betas=betas, tall=tall):
            y, m = block[:, -1], np.column_stack([block[:, :-1], np.ones(len(block))])
            for k, (i, beta) in enumerate(zip(live, betas, strict=True)):
                z, low, p = m[:, at[i]], k * tall, len(at[i])
                eta = np.clip(z @ beta, -30, 30)
                mu = 1 / (1 + np.exp(-eta))
                total[low:low + p, :p] += (z * (mu * (1 - mu))[:, None]).T @ z
                total[low + width, :p] += z.T @ (y - mu)
                total[low + width, width] += 2 * (np.logaddexp(0, eta) - y * eta).sum()
                total[low + width, width + 1] += len(y)

        found = summed_rows(x, width + 2, tall * len(live), step)
        for k, i in enumerate(live):
            s, p, low = state[i], len(at[i]), k * tall
            s["h"], gradient = found[low:low + p, :p], found[low + width, :p]
            deviance, n = float(found[low + width, width]), int(round(found[low + width, width + 1]))
            close = abs(s["deviance"] - deviance) <= tol * (abs(deviance) + 0.1)
            s["deviance"], s["iterations"] = deviance, turn
            if close or turn == max_iter or not n:
                s["ended"], s["converged"] = True, bool(close)
            else:
                s["beta"] = s["beta"] + np.linalg.pinv(s["h"], hermitian=True) @ gradient
    return [Fit(tuple(c), s["beta"], np.linalg.pinv(s["h"], hermitian=True), s["deviance"], s["deviance"] + 2 * len(a), n,
                s["iterations"], s["converged"]) for c, a, s in zip(sets, at, state, strict=True)]


def packed(df: DataFrame, label: str, features: str, fold: str | None = None) -> DataFrame:
    """x (the features as packed doubles), y, fold of every row with features, written once for many passes.

    ``features`` is an array of doubles; packed cells reach the tasks as one buffer a batch.
    """
    rows = df.where(q(features).isNotNull()).select(
        q(features).alias("x"), q(label).cast("double").alias("y"), (q(fold) if fold else F.lit(0)).cast("int").alias("fold"))

    def body(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            if not b.num_rows:
                continue
            flat = b.column("x").flatten().to_numpy(zero_copy_only=False)
            d = len(flat) // b.num_rows
            if (np.diff(b.column("x").offsets.to_numpy()) != d).any():
                raise ValueError("feature vectors differ in length")
            most = max(1, (1 << 26) // (8 * max(1, d)))
            for at in range(0, b.num_rows, most):
                part = b.slice(at, most)
                n = part.num_rows
                offsets = np.arange(n + 1, dtype=np.int32) * np.int32(8 * d)
                data = np.ascontiguousarray(flat[at * d:(at + n) * d], np.float64)
                x = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([x, part.column("y"), part.column("fold")], ["x", "y", "fold"])

    return cut_lineage(rows.mapInArrow(body, "x binary, y double, fold int"), "packed")


def packed_block(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """x (rows x features), y and fold of a batch of ``packed`` rows."""
    x = b.column("x")
    ends = np.frombuffer(x.buffers()[1], np.int32)[x.offset:x.offset + len(x) + 1]
    values = np.frombuffer(x.buffers()[2], np.float64, (int(ends[-1]) - int(ends[0])) // 8, int(ends[0]))
    return values.reshape(len(x), -1), b.column("y").to_numpy(zero_copy_only=False), b.column("fold").to_numpy(zero_copy_only=False)


def summed_blocks(df: DataFrame, parts: int, width: int, rows: int, step: Callable[[np.ndarray, tuple], None]) -> np.ndarray:
    """As ``summed_rows`` over ``packed`` rows of ``parts`` partitions, for many short passes.

    One matrix reaches the driver: tasks' totals are merged FAN at a time before.
    """
    def body(batches: Iterator[pa.RecordBatch]):
        total = np.zeros((rows, width))
        for b in batches:
            if b.num_rows:
                step(total, packed_block(b))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])

    def added(batches: Iterator[pa.RecordBatch]):
        total = np.zeros(rows * width)
        for b in batches:
            for v in b.column("v"):
                total += np.frombuffer(v.as_buffer(), np.float64)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])

    found = df.mapInArrow(body, "v binary")
    while parts > 1:
        parts = -(-parts // FAN)
        found = found.repartition(parts).mapInArrow(added, "v binary")
    out = np.zeros(rows * width)
    for v in found.toArrow().column("v"):
        out += np.frombuffer(v.as_buffer(), np.float64)
    return out.reshape(rows, width)


@dataclass
class Hinge:
    """One linear machine to fit: rows of label ``positive`` against all others, of every fold but ``without``."""

    positive: float
    without: int | None
    penalty: float  # regParam
    weights: np.ndarray | None = None
    bias: float = 0.0
    iterations: int = 0


def hinge_fits(rows: DataFrame, fits: Sequence[Hinge], max_iter: int, tol: float = 1e-6) -> None:
    """Fits linear machines with a constant on ``packed`` rows: mean hinge loss plus L2 penalty of the plain weights.

    The objective, the scaling by standard deviations and the optimizer are those of Spark's LinearSVC
    (``standardization`` off); here all fits share each pass, so the passes are those of the longest fit
    whatever their number.  What reaches the driver is one gradient a point, in all.
    """
    first = rows.select("x").first()
    if first is None or not fits:
        return
    d, folds = len(first["x"]) // 8, 1 + max([f.without for f in fits if f.without is not None], default=0)
    place = lambda fold: np.arange(folds)[:, None] == fold[None, :]

    def sums(total, block):
        x, _, fold = block
        total[:, :d] += place(fold).astype(float) @ x
        total[:, d] += place(fold).sum(1)

    parts = rows.rdd.getNumPartitions()
    by_fold = summed_blocks(rows, parts, d + 1, folds, sums)
    mean = by_fold[:, :d].sum(0) / by_fold[:, d].sum()
    if not np.isfinite(mean).all():
        raise ValueError("feature vectors must not hold NaN or infinity")

    def spreads(total, block):
        x, _, fold = block
        x = x - mean
        total[:folds] += place(fold).astype(float) @ x
        total[folds:] += place(fold).astype(float) @ (x * x)

    around = summed_blocks(rows, parts, d, 2 * folds, spreads)
    moments = {}
    for k in {f.without for f in fits}:
        kept = np.arange(folds) != (-1 if k is None else k)
        n, s, ss = by_fold[kept, d].sum(), around[:folds][kept].sum(0), around[folds:][kept].sum(0)
        var = np.maximum(ss - s * s / n, 0) / max(n - 1, 1)
        at = mean + s / n
        scale = np.where(var > 1e-32 * at * at, 1 / np.sqrt(np.where(var > 0, var, 1.0)), 0.0)  # 0: no spread
        moments[k] = n, scale, at * scale

    searches = [owlqn(np.zeros(d + 1), max_iter, tol) for _ in fits]
    asked = {i: next(s) for i, s in enumerate(searches)}
    while asked:
        points = [(i, p) for i, wanted in asked.items() for p in wanted]
        scale, centre = (np.array([moments[fits[i].without][k] for i, _ in points]) for k in (1, 2))
        at = np.array([p for _, p in points])
        w, b = (at[:, :d] * scale).T.copy(), at[:, d] - (at[:, :d] * centre).sum(1)
        positive = np.array([fits[i].positive for i, _ in points])
        without = np.array([-1 if fits[i].without is None else fits[i].without for i, _ in points])

        def step(total, block, w=w, b=b, positive=positive, without=without):
            for low in range(0, len(block[0]), 4096):
                x, y, fold = (v[low:low + 4096] for v in block)
                sign = np.where(y[:, None] == positive, 1.0, -1.0)
                loss = 1.0 - sign * (x @ w + b)
                hit = (loss > 0) & (fold[:, None] != without)
                pull = np.where(hit, -sign, 0.0)
                total[:d] += x.T @ pull
                total[d] += pull.sum(0)
                total[d + 1] += np.where(hit, loss, 0.0).sum(0)

        found = summed_blocks(rows, parts, len(points), d + 2, step)
        answers: dict = {}
        for k, (i, p) in enumerate(points):
            n, scale, centre = moments[fits[i].without]
            gradient = np.append(scale * found[:d, k] - centre * found[d, k], found[d, k]) / n
            pulled = p[:d] * scale * scale
            gradient[:d] += fits[i].penalty * pulled
            answers.setdefault(i, []).append((found[d + 1, k] / n + 0.5 * fits[i].penalty * (p[:d] @ pulled), gradient))
        asked = {}
        for i, got in answers.items():
            try:
                asked[i] = searches[i].send(got)
            except StopIteration as end:
                x, fits[i].iterations = end.value
                _, scale, centre = moments[fits[i].without]
                fits[i].weights, fits[i].bias = x[:d] * scale, float(x[d] - x[:d] @ centre)


class NoStep(Exception):
    """A search direction or step length that does not exist."""


def owlqn(x: np.ndarray, max_iter: int, tol: float, memory: int = 10) -> Generator[list, list, tuple[np.ndarray, int]]:
    """Limited-memory quasi-Newton search as in Breeze's OWLQN without an L1 term, the optimizer of LinearSVC.

    Yields lists of points, takes their (value, gradient) and returns the last point and the iterations.
    A step keeps each coordinate's sign (a coordinate that would change it stops at 0).  The search ends after
    ``max_iter`` steps, when the value has moved by less than ``tol`` of its start over 20 steps, when the
    gradient is small, or when no step is found twice running.
    """
    (value, grad), = yield [x]
    start, turn, shown, failed = value, 0, 0, False
    values, steps = [math.inf], []
    while not (turn >= max_iter or (len(values) >= 2 and abs(value - max(values)) <= tol * abs(start))
               or np.linalg.norm(grad) <= max(tol * value, 1e-8)):
        shown += 1
        try:
            way = descent(grad, steps)
            way = np.where(way * grad < 0, way, 0.0)
            orthant = np.where(x != 0, np.sign(x), np.sign(-grad))

            def moved(length, x=x, way=way, orthant=orthant):
                to = x + length * way
                return np.where(np.sign(to) == orthant, to, 0.0)

            slope, shrink = float(way @ grad), 0.1 if turn < 1 else 0.5
            length = 0.5 / np.linalg.norm(grad) if turn < 1 else 1.0
            # the first length's value is not looked at: with a slope below 0 it always shrinks once
            lengths = [length, length * shrink] if slope < 0 else [length]
            known = dict(zip(lengths, (yield [moved(a) for a in lengths]), strict=True))
            seen, pull = value, float(known[length][1] @ way)
            for tried in range(20):
                last = length
                if seen > value + length * slope * 1e-4:
                    length *= shrink
                elif pull < 0.9 * slope:
                    length *= 2.1
                elif pull > -0.9 * slope:
                    length *= shrink
                else:
                    break
                if not 1e-10 <= length <= 1e10:
                    raise NoStep
                if length not in known:  # with the length after it, which is often wanted next
                    lengths = [length, length * shrink]
                    known.update(zip(lengths, (yield [moved(a) for a in lengths]), strict=True))
                seen, pull = known[length][0], float(known[length][1] @ way)
            to, (seen, slopes) = moved(last), known[last]
            steps = [(to - x, slopes - grad), *steps][:memory]
            x, value, grad, turn, failed = to, seen, slopes, turn + 1, False
            values = [*values, value][-20:]
        except NoStep:
            if failed:
                break
            failed, steps = True, []
    return x, shown


def descent(grad: np.ndarray, steps: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The quasi-Newton direction by the last steps (moves and changes of the gradient, newest first)."""
    way, shares = grad.copy(), []
    with np.errstate(all="ignore"):
        if steps:
            sy = steps[0][0] @ steps[0][1]
            diagonal = sy / (steps[0][1] @ steps[0][1])
            if sy < 0 or math.isnan(sy):
                raise NoStep
        for move, change in steps:
            shares.append(((move @ way) / (move @ change), move @ change))
            if math.isnan(shares[-1][0]):
                raise NoStep
            way = way - shares[-1][0] * change
        if steps:
            way = way * diagonal
        for (move, change), (share, along) in zip(reversed(steps), reversed(shares), strict=True):
            way = way + (share - (change @ way) / along) * move
    return -way


def long_matrix(spark, names: Sequence[str], m: np.ndarray, out: str) -> DataFrame:
    """A square matrix as rows (a, b, out), made on the driver; NULL where it has no value."""
    p = len(names)
    pdf = pd.DataFrame({"a": np.repeat(list(names), p), "b": np.tile(list(names), p), out: m.ravel()})
    return spark.createDataFrame(pdf, f"a string, b string, {out} double")
