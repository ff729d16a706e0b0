"""Property tests: distributed numbering equals Spark's single-task windows."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from storelens.operators.ranking import asc, desc, ntile, row_numbers

rows = st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.integers(0, 3)), min_size=1, max_size=60)


def _sorted(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()),
                  key=lambda r: tuple((v is None, v if v is not None else 0) for v in r))


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(data=rows, slices=st.integers(1, 70), k=st.integers(1, 12))
def test_numbering_matches_windows(spark, data, slices, k):
    df = spark.createDataFrame([(i, g, v) for i, (g, v) in enumerate(data)], "id long, g string, v long")
    order = [desc("v"), asc("id")]
    got = row_numbers(df, order, partition_by=["g"], num_slices=slices)
    want = df.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("v"), F.asc("id"))))
    assert _sorted(got, "id", "rn") == _sorted(want, "id", "rn")
    got_t = ntile(df, k, order, name="t")
    want_t = df.withColumn("t", F.ntile(k).over(Window.orderBy(F.desc("v"), F.asc("id"))))
    assert _sorted(got_t, "id", "t") == _sorted(want_t, "id", "t")
