"""A folder watched as a stream: new files are appended to a catalog, each source once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quireflow.sources import catalog

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def watch(spark: SparkSession, folder: str, catalog_path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append new PDF files below folder to the Parquet catalog (src, rel_path, file_bytes), uniquely named against what it has.

    Idempotent: a batch that runs again finds its sources in the catalog.
    """
    files = spark.readStream.format("binaryFile").schema(SCHEMA).option("pathGlobFilter", "*.[pP][dD][fF]").option("recursiveFileLookup", "true").load(folder)
    listed = files.select(F.regexp_replace("path", "^file:/+", "/").alias("src"), F.col("length").alias("file_bytes"), F.col("modificationTime").cast("double").alias("seq_time"))

    def append(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("rel_path", F.element_at(F.split("src", "/"), -1)).withColumn("seq", F.xxhash64("src"))
        known = _known(spark, catalog_path)
        rows = catalog.first_by_source(rows)
        if known is not None:
            rows = catalog.append_anti(rows, known)
        catalog.unique_names(rows.select("src", "rel_path", "seq", "file_bytes"), known).drop("seq").write.mode("append").parquet(catalog_path)

    writer = listed.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")).start()


def _known(spark: SparkSession, path: str) -> DataFrame | None:
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None
