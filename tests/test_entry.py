"""The driver's contract: names, SQL for known queries only, and the core without the optional subpackage."""

from __future__ import annotations

import subprocess
import sys

from conftest import DATA, ROOT


def test_contract(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 70
    assert e.entry(spark).count() == 3
    assert e.queries()["agg_sum"](spark, DATA).count() > 0


def test_core_stands_alone():
    code = "import sys; sys.modules['lakelens.llm'] = None; import __spark_entry__ as e; assert e.llm is None and len(e.queries()) > 60"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
