import os
import subprocess
import sys

import __spark_entry__ as entry_mod


def test_entry_runs(spark):
    df = entry_mod.entry(spark)
    assert df.columns == ["customer_id", "total_price_customer"]
    assert df.count() > 0


def test_contract_keys():
    from storelens.plans.registry import ENTRIES

    assert set(ENTRIES) <= set(entry_mod.oracle_sql()) <= set(entry_mod.queries())
    assert len(entry_mod.queries()) >= 111


def test_core_queries_stay_without_an_optional_package():
    code = "import sys; sys.modules['public_tokenizers'] = None; import __spark_entry__ as e; print(len(e.queries()), any(k.startswith('op') for k in e.oracle_sql()))"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-W", "ignore", "-c", code], cwd=root, capture_output=True, text=True, check=True).stdout
    n, optional = out.split()
    assert int(out.split()[0]) >= 122
