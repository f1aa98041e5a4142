"""Case studies of the reference composed from quarry operators, bound to the driver tables.

Each module exposes ``QUERIES`` (name -> callable(spark, sf_dir) -> DataFrame)
and ``ORACLE`` (name -> DuckDB SQL over the same tables).
"""

from __future__ import annotations

import importlib

MODULES = ["violations", "trips", "funding", "loans", "rides", "scores", "quality", "sales", "attrition", "digits"]


def _mods():
    return [importlib.import_module(f"quarry.plans.{m}") for m in MODULES]


def all_queries() -> dict:
    out = {}
    for m in _mods():
        for k, v in m.QUERIES.items():
            if k in out:
                raise ValueError(f"duplicate query {k}")
            out[k] = v
    return out


def all_oracle_sql() -> dict:
    out = {}
    for m in _mods():
        out.update(m.ORACLE)
    return out
