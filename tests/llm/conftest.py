import glob
import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(__file__))

from conftest_llm import SCHEMA, SF, odd_rows  # noqa: E402


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="session")
def clashing(odd):
    """The same with columns named like those that operators make."""
    from pyspark.sql import functions as F

    return odd.withColumns({c: F.lit("x") for c in ("kept", "n_words", "spans", "share", "host", "score", "signature", "start", "length", "id", "u", "v", "a", "b")})


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.where("false")
