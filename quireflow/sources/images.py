"""Image files as 8-bit gray pages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Shares of blue, green and red in gray, in thousandths.
LUMA = np.array([114, 587, 299], np.int64)


def gray_images(spark: SparkSession, path: str) -> DataFrame:
    """src, w, h, gray (row-major bytes) of the image files that Spark's image source can decode; others are left out by it.

    Alpha is ignored. One image is a row, so a task holds a page at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                pixels = np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], r["nChannels"])
                gray = pixels[:, :, 0] if r["nChannels"] == 1 else ((pixels[:, :, :3] @ LUMA + 500) // 1000).astype(np.uint8)
                yield pa.RecordBatch.from_pylist([{"src": r["origin"], "w": r["width"], "h": r["height"], "gray": gray.tobytes()}], pa.schema([("src", pa.string()), ("w", pa.int32()), ("h", pa.int32()), ("gray", pa.binary())]))

    images = spark.read.format("image").option("dropInvalid", "true").load(path)
    return images.select("image.origin", "image.width", "image.height", "image.nChannels", "image.data").mapInArrow(run, "src string, w int, h int, gray binary")
