"""Results of a run: acceptance by size, savings, labels, totals, tables for review and for results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENCODINGS = [("g4", "1-bit"), ("gray4", "grayscale"), ("jpeg", "JPEG")]
#: Labels of encodings and help of copied files.
INSUFFICIENT = "Converting saved too little — original copied unchanged"
COPIED = "Copied through byte-identical"


def accepted(input_bytes: Column, output_bytes: Column, min_saving: float) -> Column:
    return output_bytes.cast("double") <= input_bytes.cast("double") * F.lit(1 - min_saving)


def outcomes(results: DataFrame, min_saving: float = 0.2) -> DataFrame:
    """tag, copy_reason and final output_bytes of results (verdict, input_bytes, built_bytes)."""
    good = accepted(F.col("input_bytes"), F.col("built_bytes"), min_saving)
    reason = F.when(F.col("verdict") != "convert", "passThrough").when(~good, "insufficientSaving")
    return results.withColumns({"tag": F.when(reason.isNull(), "converted").otherwise("copied"), "copy_reason": reason, "output_bytes": F.when(reason.isNull(), F.col("built_bytes")).otherwise(F.col("input_bytes"))})


def saving_fraction(tag: Column, input_bytes: Column, output_bytes: Column) -> Column:
    return F.when((tag == "converted") & (input_bytes > 0), 1 - output_bytes.cast("double") / input_bytes)


def encoding_count(encodings: Column, name: str) -> Column:
    return F.size(F.filter(encodings, lambda e: e == name))


def outcome_label(tag: Column, error: Column) -> Column:
    return F.when(error.isNotNull() & tag.isNull(), "Failed").when(tag == "converted", "Converted").when(tag == "copied", "Copied").otherwise("—")


def outcome_help(tag: Column, copy_reason: Column, encodings: Column, error: Column) -> Column:
    """Counts by encoding (zero counts left out), or why the file was copied or failed."""
    parts = [F.when(encoding_count(encodings, e) > 0, F.concat(F.lit(f"{label} ×"), encoding_count(encodings, e).cast("string"))) for e, label in ENCODINGS]
    pages = F.concat(F.lit("Pages: "), F.array_join(F.array(*parts), " · "))
    return F.when(error.isNotNull() & tag.isNull(), error).when(tag == "converted", pages).when(copy_reason == "insufficientSaving", INSUFFICIENT).when(tag == "copied", COPIED).otherwise("")


def participated(rows: DataFrame) -> DataFrame:
    """Rows that a run takes: included ones with a verdict."""
    return rows.where(F.col("included") & F.col("verdict").isNotNull())


def totals(rows: DataFrame) -> DataFrame:
    """One row: sums over the batch (included, verdict, estimated_bytes, input_bytes, output_bytes, tag, error).

    total_input and total_estimate are over included rows, total_output over all
    rows with a result; saved_bytes is their difference if positive, and
    saved_bytes_of_results leaves failed files out.
    """
    has_result = F.col("tag").isNotNull()
    out = rows.agg(
        F.coalesce(F.sum(F.when(F.col("included"), F.col("input_bytes"))), F.lit(0)).alias("total_input"),
        F.coalesce(F.sum(F.when(F.col("included"), F.col("estimated_bytes"))), F.lit(0)).alias("total_estimate"),
        F.coalesce(F.sum(F.when(has_result, F.col("output_bytes"))), F.lit(0)).alias("total_output"),
        F.coalesce(F.sum(F.when(has_result, F.col("input_bytes"))), F.lit(0)).alias("result_input"),
        F.count_if(F.col("tag") == "converted").alias("n_converted"),
        F.count_if(F.col("error").isNotNull() & ~has_result).alias("n_failed"),
    )
    saved = lambda a: F.when(F.col(a) > F.col("total_output"), F.col(a) - F.col("total_output"))
    return out.withColumns({"saved_bytes": saved("total_input"), "saved_bytes_of_results": saved("result_input")}).drop("result_input")


def plural_text(n: Column, one: str, many: str) -> Column:
    return F.when(n == 1, F.lit(one)).otherwise(F.concat(n.cast("string"), F.lit(f" {many}")))


def source_label(names: Column) -> Column:
    """None, the one source's name, or how many there are."""
    return F.when(F.size(names) == 0, F.lit("")).when(F.size(names) == 1, F.get(names, F.lit(0))).otherwise(F.concat(F.size(names).cast("string"), F.lit(" sources")))


def byte_label(n: Column) -> Column:
    """Bytes (long, or a decimal without a fraction) in decimal units, rounded half up in whole numbers: a double has too few digits for large ones."""
    parts = lambda unit: F.call_function("div", n, F.lit(unit)) + F.when(n % unit >= unit // 2, 1).otherwise(0)
    mega, giga = parts(100_000), parts(10_000_000)
    text = lambda whole, digits: F.concat(F.call_function("div", whole, F.lit(10**digits)).cast("string"), F.lit("."), F.lpad((whole % 10**digits).cast("string"), digits, "0"))
    return F.when(n < 1000, F.concat(n.cast("string"), F.lit(" bytes"))).when(n < 1_000_000, F.concat(parts(1000).cast("string"), F.lit(" KB"))).when(n < 1_000_000_000, F.concat(text(mega, 1), F.lit(" MB"))).otherwise(F.concat(text(giga, 2), F.lit(" GB")))


def review_table(rows: DataFrame) -> DataFrame:
    estimate = F.when(F.col("verdict") == "convert", byte_label(F.col("estimated_bytes"))).otherwise("unchanged")
    return rows.select("included", "rel_path", "n_pages", byte_label(F.col("file_bytes")).alias("size"), "verdict", estimate.alias("estimated"))


def results_table(rows: DataFrame) -> DataFrame:
    saved = saving_fraction(F.col("tag"), F.col("input_bytes"), F.col("output_bytes"))
    return participated(rows).select("rel_path", "input_bytes", "output_bytes", F.when(saved.isNull(), "–").otherwise(F.format_string("%.0f%%", 100 * saved)).alias("saved"), outcome_label(F.col("tag"), F.col("error")).alias("outcome"))


def preview_path(src: Column, out: Column) -> Column:
    return F.coalesce(out, src)


def error_text(kind: Column, detail: Column) -> Column:
    return F.when(kind == "wouldOverwrite", F.concat(F.lit("Output would overwrite the source: "), detail)).otherwise(detail)
