"""Column -> Column helpers.  All are built-in Spark expressions,
so they stay inside whole-stage codegen; none is a Python UDF.

Plain built-ins are used as they are for substring, length, lower, concat,
date parts and trig bases (D1, D4, D5, D7, D12, D16).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_int(c: ColumnOrName) -> Column:
    """Text -> int; unparseable text gives NULL instead of an error (ANSI safe)."""
    return _c(c).try_cast("int")


def parse_suffixed(c: ColumnOrName, suffix: str = "%") -> Column:
    """D3: strip a trailing unit sign and parse as double ('10.65%' -> 10.65).

    Text without the suffix is parsed as it is; bad text gives NULL.
    """
    col = F.trim(_c(c))
    stripped = F.when(col.endswith(suffix),
                      F.substring(col, F.lit(1), F.length(col) - F.lit(len(suffix)))).otherwise(col)
    return stripped.try_cast("double")


def first_token(c: ColumnOrName, sep: str = " ") -> Column:
    """Text before the first separator; the whole text if there is none (Q15 fixed)."""
    return F.substring_index(_c(c), sep, 1)


def round_even(c: ColumnOrName, digits: int = 0) -> Column:
    """Round half to even (banker's rounding), as R round() and numpy do."""
    return F.bround(_c(c), digits)


def ratio(a: ColumnOrName, b: ColumnOrName, pct: bool = False) -> Column:
    """A / b, NULL when b is 0 or NULL; times 100 when pct."""
    r = F.try_divide(_c(a).cast("double"), _c(b).cast("double"))
    return r * F.lit(100.0) if pct else r


def parse_date(c: ColumnOrName, pattern: str) -> Column:
    """Text -> wall-clock timestamp (TIMESTAMP_NTZ) with one pattern; text that does not
    fit gives NULL.  The result does not depend on the session time zone.

    Two-digit years ('yy') resolve into 2000-2099, as Spark defines it.
    """
    return F.try_to_timestamp(_c(c), F.lit(pattern)).cast("timestamp_ntz")


def parse_any(c: ColumnOrName, patterns: Iterable[str]) -> Column:
    """First pattern that parses wins, per row."""
    return F.coalesce(*[parse_date(c, p) for p in patterns])


_UNIT_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}


def elapsed(start: ColumnOrName, end: ColumnOrName, unit: str = "second") -> Column:
    """End - start; whole seconds (long, truncated toward zero) for unit='second',
    otherwise the exact difference (microsecond resolution) in that unit as a double."""
    # on wall-clock (NTZ) timestamps the difference does not depend on the session time zone
    micros = F.timestamp_diff("MICROSECOND", _c(start), _c(end))
    if unit == "second":
        return (micros / F.lit(1_000_000)).cast("long")
    return micros.cast("double") / F.lit(1e6 * _UNIT_SECONDS[unit])


def rate(qty: ColumnOrName, start: ColumnOrName, end: ColumnOrName, per: str = "hour") -> Column:
    """Quantity per unit of elapsed time (e.g. miles per hour); NULL on zero time."""
    return F.try_divide(_c(qty).cast("double") * F.lit(float(_UNIT_SECONDS[per])),
                        elapsed(start, end).cast("double"))


def cap_value(c: ColumnOrName, lo=None, hi=None) -> Column:
    """C12 helper: clamp into [lo, hi], NULL stays NULL (least/greatest would drop the NULL)."""
    col = _c(c)
    out = col
    if hi is not None:
        out = F.when(col > F.lit(hi), F.lit(hi)).otherwise(out)
    if lo is not None:
        out = F.when(col < F.lit(lo), F.lit(lo)).otherwise(out)
    return out


def bucket_label(c: ColumnOrName, edges: list, labels: list[str]) -> Column:
    """C4 helper: half-open intervals [edges[i], edges[i+1]) -> labels[i]; NULL outside."""
    if len(labels) != len(edges) - 1:
        raise ValueError("need one label per interval")
    col = _c(c)
    expr = None
    for lo, hi, lab in zip(edges[:-1], edges[1:], labels):
        cond = (col >= F.lit(lo)) & (col < F.lit(hi))
        expr = F.when(cond, F.lit(lab)) if expr is None else expr.when(cond, F.lit(lab))
    return expr


def class_label(c: ColumnOrName, classes: dict, default=None) -> Column:
    """C5 helper: {label: [values]} membership -> label (first match wins)."""
    col = _c(c)
    expr = None
    for lab, values in classes.items():
        cond = col.isin(list(values))
        expr = F.when(cond, F.lit(lab)) if expr is None else expr.when(cond, F.lit(lab))
    return expr.otherwise(F.lit(default)) if default is not None else expr


def recode_value(c: ColumnOrName, mapping: dict, default: str = "keep") -> Column:
    """C3 helper: dictionary recode through a literal map.

    default='keep' leaves unmapped values as they are (pandas .loc / replace);
    default='null' turns them into NULL (pandas .map).
    """
    col = _c(c)
    if not mapping:
        return col if default == "keep" else F.lit(None)
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    looked = F.try_element_at(m, col)
    if default == "keep":
        return F.coalesce(looked, col)
    return looked
