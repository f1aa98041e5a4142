"""Property test of the core distributed primitive against pandas (random groups, NULL keys, weights,
partition counts)."""

import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.operators.order import running_total

rows_st = st.lists(st.tuples(st.sampled_from(["a", "b", "c", None]), st.integers(-5, 5)), min_size=0, max_size=60)


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(rows=rows_st, parts=st.integers(1, 6))
def test_running_total_matches_pandas(spark, rows, parts):
    data = [(i, g, w) for i, (g, w) in enumerate(rows)]
    df = spark.createDataFrame(data, "id long, g string, w long").repartition(parts)
    got = {r.id: r.c for r in running_total(df, ["id"], F.col("w"), by=["g"], out="c").collect()}
    pdf = pd.DataFrame(data, columns=["id", "g", "w"]).astype({"id": "int64", "w": "int64"})
    pdf = pdf.fillna({"g": "<null>"}).sort_values(["g", "id"])
    pdf["c"] = pdf.groupby("g")["w"].cumsum()
    assert got == dict(zip(pdf.id, pdf.c))
