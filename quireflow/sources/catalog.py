"""File catalog: recursive discovery, de-duplication, unique names, natural order, appending to a batch."""

from __future__ import annotations

import os
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ITEM = "src string, rel_path string, seq long"
#: Folders with these endings count as one file and are not entered.
PACKAGES = (".app", ".bundle", ".framework", ".pkg", ".photoslibrary", ".rtfd", ".pages", ".numbers", ".key")


def normalised(path: str) -> str:
    return os.path.normpath(os.path.abspath(path))


def list_folder(root: str) -> list[tuple[str, str]]:
    """(path, path relative to root) of all PDF files below root; hidden files and the insides of packages are left out."""
    found = []
    for folder, folders, files in os.walk(root):
        folders[:] = sorted(f for f in folders if not f.startswith(".") and not f.lower().endswith(PACKAGES))
        for name in sorted(files):
            path = os.path.join(folder, name)
            if not name.startswith(".") and name.lower().endswith(".pdf") and os.path.isfile(path):
                found.append((normalised(path), os.path.relpath(path, root)))
    return found


def expand(sources: list[str], has_existing: bool = False) -> list[tuple[str, str]]:
    """(path, relative path) of all sources in order: folders are searched, other files that are no PDF are ignored."""
    several = len(sources) > 1 or has_existing
    out = []
    for source in sources:
        if os.path.isdir(source):
            prefix = f"{Path(source).name}/" if several else ""
            out += [(path, prefix + rel) for path, rel in list_folder(source)]
        elif source.lower().endswith(".pdf"):
            out.append((normalised(source), os.path.basename(source)))
    return out


def items(spark: SparkSession, sources: list[str], existing: DataFrame | None = None) -> DataFrame:
    """src, rel_path of the sources' new files, unique against the batch, in natural order.

    The listing is metadata of the driver; everything after it is a DataFrame.
    """
    has = existing is not None and not existing.isEmpty()
    listed = spark.createDataFrame([(s, r, n) for n, (s, r) in enumerate(expand(sources, has))], ITEM)
    return natural_sort(unique_names(append_anti(first_by_source(listed), existing) if has else first_by_source(listed), existing if has else None))


def from_object_store(spark: SparkSession, root: str) -> DataFrame:
    """path, length, modificationTime of PDF files below a root that Spark reads (content stays unread unless selected)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[pP][dD][fF]").load(root)
    return files.select("path", "length", "modificationTime")


def first_by_source(listed: DataFrame) -> DataFrame:
    """One row per src: the first by seq."""
    return listed.withColumn("__k", F.row_number().over(Window.partitionBy("src").orderBy("seq"))).where("__k = 1").drop("__k")


def append_anti(new: DataFrame, existing: DataFrame) -> DataFrame:
    """New rows whose source the batch doesn't have."""
    return new.join(existing.select("src"), "src", "left_anti")


def without_extension(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[^./]+$", "")


def numbered(rows: DataFrame) -> DataFrame:
    """rel_path made unique by -2, -3, ... in the order of seq, where no name clashes with a numbered one."""
    k = F.row_number().over(Window.partitionBy("rel_path").orderBy("seq"))
    return rows.withColumn("__k", k).withColumn("rel_path", F.when(F.col("__k") == 1, F.col("rel_path")).otherwise(F.concat(without_extension(F.col("rel_path")), F.lit("-"), F.col("__k").cast("string"), F.lit(".pdf")))).drop("__k")


def inserted(paths: list[str], old: list[bool]) -> list[str]:
    """Names that paths get when they are inserted in this order; old ones keep theirs.

    Names are never freed, so each base's search goes on where its last one
    ended: time in proportion to the paths.
    """
    seen: set[str] = set()
    following: dict[str, int] = {}
    names = []
    for path, kept in zip(paths, old, strict=True):
        name = path
        if name in seen and not kept:
            base = re.sub(r"\.[^./]+$", "", path)
            n = following.get(base, 2)
            while (name := f"{base}-{n}.pdf") in seen:
                n += 1
            following[base] = n + 1
        seen.add(name)
        names.append(name)
    return names


def unique_names(rows: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """rel_path unique within rows and against the batch, as by inserting the rows in the order of seq.

    Repeated names are numbered by a window. Only stems (names without -n) in
    which a numbered name meets a natural one need the sequential rule; they are
    found by counting names and are inserted group by group.
    """
    all_rows = rows.withColumn("__old", F.lit(False))
    if existing is not None:
        all_rows = all_rows.unionByName(existing.select("rel_path", F.lit(True).alias("__old")), allowMissingColumns=True)
    all_rows = all_rows.withColumn("__stem", F.regexp_replace(without_extension(F.col("rel_path")), r"(-[0-9]+)+$", ""))
    all_rows = all_rows.withColumn("__k", F.row_number().over(Window.partitionBy("rel_path").orderBy(F.desc("__old"), "seq")))
    all_rows = all_rows.withColumn("__name", F.when(F.col("__k") == 1, F.col("rel_path")).otherwise(F.concat(without_extension(F.col("rel_path")), F.lit("-"), F.col("__k").cast("string"), F.lit(".pdf"))))
    clashes = all_rows.groupBy("__name").agg(F.count("*").alias("n"), F.max("__stem").alias("__stem")).where("n > 1").select("__stem").distinct()
    columns = [c for c in rows.columns]
    plain = all_rows.join(clashes, "__stem", "left_anti").where("not __old").withColumn("rel_path", F.col("__name")).select(columns)

    def insert(group):
        group = group.sort_values(["__old", "seq"], ascending=[False, True], na_position="first")
        return group.assign(rel_path=inserted(group["rel_path"].tolist(), group["__old"].tolist()))[[*columns, "__old"]]

    several = all_rows.join(clashes, "__stem", "left_semi").groupBy("__stem").applyInPandas(insert, all_rows.select(*columns, "__old").schema)
    return plain.unionByName(several.where("not __old").select(columns))


def natural_key(path: Column) -> Column:
    """Sorts text by case-folded parts and runs of digits by value."""
    padded = F.regexp_replace(F.lower(path), r"([0-9]+)", "0000000000000000000$1")
    return F.regexp_replace(padded, r"0+([0-9]{20})(?![0-9])", "$1")


def natural_sort(rows: DataFrame) -> DataFrame:
    return rows.orderBy(natural_key(F.col("rel_path")), "rel_path")


def output_collides(rows: DataFrame, out_folder: str) -> DataFrame:
    """Included rows whose output path is some row's source."""
    out = rows.where("included").withColumn("out_path", F.concat(F.lit(out_folder.rstrip("/") + "/"), F.col("rel_path")))
    return out.join(rows.select(F.col("src").alias("out_path")), "out_path", "left_semi")
