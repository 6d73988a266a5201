from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

from waybook.session import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(8, 4, spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")))
    yield session
    session.stop()


@pytest.fixture()
def one(spark):
    """Evaluate a column over one text per row and return the values."""
    import pyarrow as pa
    from pyspark.sql import functions as F

    def run(column, *texts):
        table = pa.table({"i": pa.array(range(len(texts)), pa.int32()), "t": pa.array(texts, pa.string())})
        made = spark.createDataFrame(table).select("i", column(F.col("t")).alias("v")).collect()
        return [r["v"] for r in sorted(made, key=lambda r: r["i"])]

    return run
