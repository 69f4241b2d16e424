"""Every query of the library against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from quireflow.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def rows(records):
    return sorted(repr(tuple(round(v, 6) if isinstance(v, float) else v for v in r)) for r in records)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, duck, name):
    found = QUERIES[name](spark, SF)
    expected = duck.execute(ORACLES[name])
    names = [d[0] for d in expected.description]
    assert sorted(found.columns) == sorted(names)
    assert rows(tuple(r[c] for c in names) for r in found.collect()) == rows(expected.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_kernel_equals_relational_twin(spark):
    """The dense kernels give what the relational operators give."""
    from pyspark.sql import functions as F

    from quireflow.operators import raster
    from quireflow.queries import px_table

    px = px_table(spark, SF)
    twin = {r["page"]: (r["t"], r["kind"], r["n_ink"], round(r["damage"], 6)) for r in raster.otsu(px).join(raster.classify(px), "page").join(raster.sauvola(px).groupBy("page").agg(F.count_if("ink").alias("n_ink")), "page").join(raster.damage(raster.sauvola(px), 4, 8, 8), "page").collect()}
    assert {r["page"]: (r["otsu"], r["kind"], r["n_ink"], r["damage"]) for r in QUERIES["kernel_pages"](spark, SF).collect()} == twin
