"""Plan shape guards: no all-pairs joins and no Python evaluation in any query."""

import pytest

from storelens.plans.registry import ENTRIES, run

from conftest import SMALL_DIR

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython",
             "FlatMapGroupsInPandas", "MapInPandas")


@pytest.mark.parametrize("key", list(ENTRIES))
def test_no_forbidden_operators(spark, key):
    df = run(key, spark, SMALL_DIR)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [op for op in FORBIDDEN if op in plan]


# numbering writes its input and counts its slices while the plan is built
NUMBERED = {"price_quartiles", "top_decile_customers", "sample_top_percent", "sample_repeated", "sample_stratified", "value_chart",
            "median_order_by_month", "top_customer_placemarks"}


def test_building_a_query_starts_no_job(spark):
    tracker = spark.sparkContext.statusTracker()
    for key in ENTRIES:
        if key not in NUMBERED:
            spark.sparkContext.setJobGroup(f"build-{key}", key)
            run(key, spark, SMALL_DIR)
            # reading a Parquet schema is a job of Spark's own; one per table read
            assert len(tracker.getJobIdsForGroup(f"build-{key}")) <= 5, key
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("key, scans", [("value_model_state", 2), ("value_model_channel_payment", 3), ("lookup_product_dow", 2), ("lookup_zip_payment", 1),
                                        ("zip_keys_unmatched", 2), ("best_sellers_prev_next", 2)])
def test_each_input_is_read_once(spark, key, scans):
    plan = run(key, spark, SMALL_DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == scans


def test_signature_reads_orders_once(spark):
    plan = run("state_signature", spark, SMALL_DIR)._jdf.queryExecution().optimizedPlan().toString()
    reads = [line for line in plan.splitlines() if "Relation [" in line]
    assert len(reads) == 4 and sum("o_orderkey" in line for line in reads) == 1


def test_census_is_not_dealt_by_state(spark):
    off = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in off}
    try:
        for k, v in off.items():
            spark.conf.set(k, v)
        plan = run("distance_to_state_reference_sphere", spark, SMALL_DIR)._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    # by state go only the rows that the partial group limit leaves
    assert plan.count("FileScan parquet") == 2 and "WindowGroupLimit" in plan
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning(Stab" in line]
    assert sum("_salt" not in line and "_jsalt" not in line for line in dealt) <= 2
