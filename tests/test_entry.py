"""The driver's three functions, and independence from the optional subpackage."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry


def test_contract(spark):
    assert entry.entry(spark).limit(3).count() == 3
    q, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(q)


def test_core_does_not_import_llm():
    root = Path(__file__).resolve().parent.parent
    code = "import sys; sys.modules['scholion.llm'] = None; import __spark_entry__ as e; assert 'q12_load' in e.queries() and 'p6_found' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
