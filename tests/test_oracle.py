"""Every keyed query against its DuckDB text at sf0.01 (the driver's check)."""

import pytest

from storelens.oracle import oracle_texts
from storelens.oracle.check import compare
from storelens.plans.registry import ENTRIES, run

from conftest import SF_DIR

TEXTS = oracle_texts()


def test_every_key_has_an_oracle():
    assert set(ENTRIES) == set(TEXTS)


@pytest.mark.parametrize("key", list(ENTRIES))
def test_matches_oracle(key, spark, tables, duck):
    df = run(key, spark, SF_DIR, tables)
    assert compare(df, duck, TEXTS[key]) is None
