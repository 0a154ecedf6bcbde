"""Every registered query against its SQL text on the smallest given tables."""

import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from sluice import plans
from tools.check import connect, spark_rows, sql_rows

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="given tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_query_has_a_counterpart():
    assert set(plans.queries()) == set(plans.oracle_sql())


@pytest.mark.parametrize("name", list(plans.queries()))
def test_query(spark, con, name):
    columns, rows = spark_rows(plans.queries()[name](spark, FOLDER))
    names, wanted = sql_rows(con, plans.oracle_sql()[name])
    assert columns == names and rows == wanted


def test_text_operators_are_optional():
    """Without the text subpackage the entry still imports and offers everything else."""
    code = ("import sys; sys.modules['corpus_pipeline'] = None; sys.modules['sluice.llm'] = None\n"
            "import __spark_entry__ as e; from sluice import plans; assert set(e.queries()) == set(plans.queries())")
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(entry.__file__))


def test_entry(spark):
    assert entry.entry(spark).columns == ["key", "status"]
