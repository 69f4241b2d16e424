"""Session helpers of the training-data operators: the shared folder, scratch tables and safe clean-up."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quireflow.plans.storage import LOCAL_CHECKPOINT_DIR, scratch_path, shared_dir, stored  # noqa: F401


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch path through Hadoop's file system, so that any store works."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once a row: an optimiser that merges projections can't move it into body's lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
