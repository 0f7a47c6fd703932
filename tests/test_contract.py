"""The entry point: it works with and without the text subpackage, and core queries equal their SQL."""

import math
import subprocess
import sys
from collections import Counter
from decimal import Decimal
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


def test_core_does_not_import_llm():
    for p in (ROOT / "billspark").rglob("*.py"):
        if "llm" not in p.parts:
            assert "billspark.llm" not in p.read_text(), p
    code = "import sys; sys.modules['billspark.llm'] = None; import __spark_entry__ as e; assert 'ledger_totals' in e.queries() and 'p6_ids' not in e.queries(); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())


def _cell(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    return round(float(x), 6) if isinstance(x, (float, Decimal)) else x


def _core():
    from billspark.plans import registry

    return sorted(registry.oracle_sql())


@pytest.mark.parametrize("name", _core())
def test_equals_sql(spark, sf, name):
    import duckdb

    from billspark.plans import registry

    con = duckdb.connect()
    for p in Path(sf).iterdir():
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    want = con.execute(registry.oracle_sql()[name])
    names = [c[0] for c in want.description]
    rows = [dict(zip(names, r)) for r in want.fetchall()]
    got = registry.queries()[name](spark, sf)
    assert sorted(got.columns) == sorted(names)
    key = lambda r: tuple(_cell(r[c]) for c in sorted(names))
    assert Counter(map(key, rows)) == Counter(key(r) for r in got.collect())
