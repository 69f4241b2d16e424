"""A batch of files from opening to results: sources to rows, jobs, results joined to rows, what failed."""

from __future__ import annotations

import os
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quireflow.operators import outcomes
from quireflow.sources import catalog

#: Environment variable that may name a folder to open.
FOLDER_VARIABLE = "QUIREFLOW_FOLDER"
RESULT = ["tag", "copy_reason", "output_bytes", "encodings"]


def folder_argument(environment: Mapping[str, str] = os.environ) -> str | None:
    """The folder that the environment names, if it exists and is one."""
    folder = environment.get(FOLDER_VARIABLE)
    return folder if folder and os.path.isdir(folder) else None


def open_sources(spark: SparkSession, sources: list[str], batch: DataFrame | None = None) -> DataFrame:
    """src, rel_path of a new batch, or of the batch under review with the sources' new files behind its own."""
    if batch is None:
        return catalog.items(spark, sources).select("src", "rel_path")
    return batch.select("src", "rel_path").unionByName(catalog.items(spark, sources, batch).select("src", "rel_path"))


def jobs(rows: DataFrame) -> DataFrame:
    """Rows that are converted or copied: included ones that could be inspected."""
    return outcomes.participated(rows)


def with_results(rows: DataFrame, results: DataFrame, key: str = "rel_path") -> DataFrame:
    """rows with the columns of their result, and its error where it failed. Rows without a result keep their own error.

    One shuffle by the key, or none where the results are small.
    """
    kept = [c for c in RESULT if c in results.columns]
    found = results.select(F.col(key), *kept, F.col("error").alias("__error"))
    return rows.drop(*kept).join(found, key, "left").withColumn("error", F.coalesce("__error", "error")).drop("__error")


def failure_text(rows: DataFrame) -> DataFrame:
    """One row: n_failed, and text (null if nothing failed) of a batch with results."""
    failed = rows.agg(F.count_if(F.col("included") & F.col("error").isNotNull() & F.col("tag").isNull()).alias("n_failed"))
    return failed.withColumn("text", F.when(F.col("n_failed") > 0, _failed(F.col("n_failed"))))


def _failed(n: Column) -> Column:
    return F.concat(outcomes.plural_text(n, "1 file", "files"), F.lit(" failed"))
