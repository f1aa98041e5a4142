"""quarry: table analysis operators that take and return Spark DataFrames.

Layout:
    quarry.sources    scans and sinks (CSV, staged text, partitioned ORC/parquet)
    quarry.functions  Column -> Column helpers (parsing, rounding, ratios, time)
    quarry.operators  DataFrame -> DataFrame operators (profile, clean, joins,
                      aggregates, ranking, reshape, features, models,
                      evaluation, time series)
    quarry.plans      case studies composed from the operators, bound to tables
"""

from quarry.session import get_spark, checkpoint_dir, cut_lineage  # noqa: F401

__version__ = "0.1.0"
