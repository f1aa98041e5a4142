"""Helpers for the tests' hand-made frames."""


def rows(df, order=None):
    """Collected rows as tuples, sorted (tests only: tiny frames)."""
    out = [tuple(r) for r in df.collect()]
    return sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r)) if order is None else out
