"""Every query with SQL equals it at sf0.01."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from seqloom.queries import ORACLES, QUERIES
from seqloom.sources.views import coded
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", ORACLES)
def test_equals_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    assert compare(df, ORACLES[name], con) == (0, 0)
    assert df.limit(1).count() == 1


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_implanted_motifs_are_found(spark):
    for name in ("accuracy", "accuracy_structured"):
        (row,) = QUERIES[name](spark, SF).collect()
        assert row.found >= 0.6 * row.total


def test_unknown_values_are_an_error(spark):
    rows = spark.createDataFrame([("view",), (None,)], "x string").select(coded(F.col("x"), ["click", "view"]).alias("y"))
    assert [r.y for r in rows.collect()] == ["1", None]
    with pytest.raises(PySparkException):
        spark.createDataFrame([("other",)], "x string").select(coded(F.col("x"), ["click"]).alias("y")).collect()


def test_without_the_llm_folders(tmp_path):
    """The entry imports without them, and doesn't hide what one of them can't import."""
    root = Path(__file__).resolve().parent.parent
    copy = tmp_path / "repo"
    shutil.copytree(root / "seqloom", copy / "seqloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", copy)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    run = lambda: subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, timeout=120)
    assert run().stdout.split() == [str(len(QUERIES)), str(len(ORACLES))]
    (copy / "seqloom/llm").mkdir()
    (copy / "seqloom/llm/__init__.py").write_text("")
    (copy / "seqloom/llm/queries.py").write_text("import no_such_module")
    assert "no_such_module" in run().stderr
