"""Sinks: a mirrored tree of output files, written whole or not at all, with the sources' times."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class WouldOverwrite(ValueError):
    """An output path is its own source."""


def guard(rows: DataFrame, out_folder: str) -> None:
    """Raise if an output (out_folder/rel_path) is its row's source (src)."""
    out = F.concat(F.lit(os.path.normpath(os.path.abspath(out_folder)) + "/"), F.col("rel_path"))
    bad = rows.where(out == F.col("src")).select("rel_path").first()
    if bad:
        raise WouldOverwrite(f"Output would overwrite the source: {os.path.basename(bad[0])}")


def write_file(path: str, data: bytes, mtime: float | None) -> None:
    """Write under another name and rename, so that retries and speculative tasks are harmless; times are best effort."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    context = TaskContext.get()
    part = f"{path}.{context.taskAttemptId() if context else 'driver'}.{os.getpid()}.part"
    with open(part, "wb") as out:
        out.write(data)
    if mtime is not None:
        try:
            os.utime(part, (mtime, mtime))
        except OSError:
            pass
    os.replace(part, path)


def write_tree(rows: DataFrame, out_folder: str) -> DataFrame:
    """Write rows (src, rel_path, output, mtime) below out_folder (shared by all executors); rel_path, out_path, n_bytes of what was written."""
    guard(rows, out_folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = []
            for r in batch.to_pylist():
                path = os.path.join(out_folder, r["rel_path"])
                write_file(path, r["output"], r["mtime"])
                done.append({"rel_path": r["rel_path"], "out_path": path, "n_bytes": len(r["output"])})
            if done:
                yield pa.RecordBatch.from_pylist(done)

    return rows.where("output is not null").select("src", "rel_path", "output", "mtime").mapInArrow(run, "rel_path string, out_path string, n_bytes long")
