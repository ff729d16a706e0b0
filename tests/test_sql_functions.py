"""SQL table functions against the DataFrame functions, two calls each as in the reference."""

import math

import pytest

from storelens.plans import parameterised as s6
from storelens.plans.sql_functions import SHARED, register_functions, table


@pytest.fixture(scope="module")
def fns(tables):
    return register_functions(tables, prefix="fx_")


def _same(sql_df, lib_df, approx_cols=()):
    a = sorted(tuple(r) for r in sql_df.collect())
    b = sorted(tuple(r) for r in lib_df.collect())
    assert len(a) == len(b)
    for x, y in zip(a, b):
        for i, (u, v) in enumerate(zip(x, y)):
            if isinstance(u, float) and isinstance(v, float):
                assert math.isclose(u, v, rel_tol=1e-9, abs_tol=1e-6)
            else:
                assert u == v


CALLS = [
    ("orders_with_delay", "10", s6.orders_with_delay, {"days": 10}),
    ("orders_with_delay", "100", s6.orders_with_delay, {"days": 100}),
    ("top_products", "10", s6.top_products, {"n": 10}),
    ("top_products", "15", s6.top_products, {"n": 15}),
    ("areas_closest_in_size", "34.02, 10", s6.areas_closest_in_size, {"area": 34.02, "n": 10}),
    ("areas_closest_in_size", "154.54, 20", s6.areas_closest_in_size, {"area": 154.54, "n": 20}),
    ("customers_by_purchase", "1963.00, 39950.00", s6.customers_by_purchase, {"lo": 1963.0, "hi": 39950.0}),
    ("customers_by_purchase", "5678.99, 9876.54", s6.customers_by_purchase, {"lo": 5678.99, "hi": 9876.54}),
    ("areas_named_like", "'brand#1'", s6.areas_named_like, {"text": "brand#1"}),
    ("areas_named_like", "'BRAND#2'", s6.areas_named_like, {"text": "BRAND#2"}),
    ("active_subscribers", "DATE'1999-10-12'", s6.active_subscribers, {"cutoff": __import__("datetime").date(1999, 10, 12)}),
    ("areas_around_point", "37.25, -92.51, 100", s6.areas_around_point, {"lat": 37.25, "lon": -92.51, "radius": 100}),
    ("areas_around_point", "37.25, -92.51, 300", s6.areas_around_point, {"lat": 37.25, "lon": -92.51, "radius": 300}),
    ("state_info", "'S07'", s6.state_info, {"state": "S07"}),
    ("customers_per_month", "1996", s6.customers_per_month, {"year": 1996}),
]


@pytest.mark.parametrize("name,args,fn,params", CALLS)
def test_sql_function_equals_dataframe(spark, tables, fns, name, args, fn, params):
    sql_df = spark.sql(f"SELECT * FROM fx_{name}({args})")
    lib = fn(tables, **params)
    if name == "areas_other_language":
        lib = lib.drop("zcta5")
    _same(sql_df, lib)


def test_scalar_and_defaults(spark, tables, fns):
    for days in (10, 100):
        n = spark.sql(f"SELECT fx_count_orders_with_delay({days}) AS n").first().n
        assert n == s6.orders_with_delay(tables, days).count()
    assert spark.sql("SELECT * FROM fx_areas_closest_in_size()").count() == 10
    ratio = spark.sql("SELECT * FROM fx_areas_other_language(0.66)").count()
    assert ratio == s6.areas_other_language(tables, 0.66).count()


@pytest.mark.parametrize("name", ["state_top_payment", "state_top_group", "state_orders", "state_signature", "three_years_of_sales"])
def test_cutoff_functions(spark, tables, fns, name):
    import datetime as dt

    from storelens.plans import classify

    got = spark.sql(f"SELECT * FROM fx_{name}(DATE'2000-01-01')")
    want = getattr(classify, name)(tables, dt.date(2000, 1, 1))
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_shared_functions_leave_no_views_and_keep_columns(spark, tables, fns):
    before = {v.name for v in spark.catalog.listTables()}
    args = {"orders_with_delay": [10], "top_products": [3], "customers_by_purchase": [1, 2], "areas_named_like": ["x"],
            "active_subscribers": [__import__("datetime").date(2000, 1, 1)], "state_info": ["S01"]}
    for name, values in args.items():
        names = [p.split()[0] for p in SHARED[name].parameters.split(", ")]
        lib = table(tables, name, **dict(zip(names, values)))
        literals = ", ".join(f"'{v}'" if isinstance(v, str) else f"DATE'{v}'" if hasattr(v, "year") else str(v) for v in values)
        sql = spark.sql(f"SELECT * FROM fx_{name}({literals})")
        assert sql.dtypes == lib.dtypes, name
    assert {v.name for v in spark.catalog.listTables()} == before


def test_quotes_in_a_parameter_stay_text(tables):
    assert s6.areas_named_like(tables, "x') OR ('1' = '1").count() == 0


@pytest.mark.parametrize("call", ["top_products(10)", "areas_closest_in_size(34.02, 10)"])
def test_numbered_rows_are_limited_before_they_meet(spark, fns, call):
    plan = spark.sql(f"SELECT * FROM fx_{call}")._jdf.queryExecution().executedPlan().toString()
    window = plan.index("Window [row_number()")
    assert "TakeOrderedAndProject(limit=10" in plan[window:]
