"""Page kinds, file verdicts and size estimates, as column expressions over a table of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quireflow.settings import PRODUCER, Settings

#: Bytes per pixel of 1-bit and of 4-bit pages, bytes per page at least, and bytes per scanned page that are small already.
G4_DENSITY, GRAY4_DENSITY, PAGE_FLOOR, SMALL_PAGE = 0.0023, 0.11, 8000, 45000
COMPACT_FILTERS = ["CCITTFaxDecode", "JBIG2Decode"]


def rounded(x: Column) -> Column:
    """Half away from zero, for what isn't negative."""
    return F.floor(x + 0.5)


def own_producer(producer: Column) -> Column:
    """Whether the producer is the engine's marker, alone or with a version."""
    return F.coalesce((producer == PRODUCER) | producer.startswith(f"{PRODUCER} "), F.lit(False))


def compact_image(bits: Column, filters: Column | None = None) -> Column:
    packed = bits.isin(1, 4)
    if filters is None:
        return packed
    return packed | F.coalesce(F.arrays_overlap(filters, F.array(*[F.lit(f) for f in COMPACT_FILTERS])), F.lit(False))


def oriented_size(width: Column, height: Column, rotation: Column) -> tuple[Column, Column]:
    """Width and height as shown: swapped by odd quarter turns."""
    turned = F.pmod(rotation, F.lit(180)) != 0
    return F.when(turned, height).otherwise(width), F.when(turned, width).otherwise(height)


def largest_image(pages: DataFrame, keys: list[str]) -> DataFrame:
    """The image of each page's array `images` (w, h, bpc, filters) with the largest area; the first of equals."""
    best = F.aggregate(
        F.filter("images", lambda i: i["w"] * i["h"] > 0), F.lit(None).cast(pages.schema["images"].dataType.elementType),
        lambda a, i: F.when(a.isNull() | (i["w"].cast("long") * i["h"] > a["w"].cast("long") * a["h"]), i).otherwise(a),
    )
    return pages.withColumn("image", best).drop("images")


def scan_dpi(width: Column, height: Column, image_width: Column, image_height: Column) -> Column:
    """Resolution of a page that its largest image covers; null for a born-digital one."""
    page, image = width / height, image_width / image_height
    dpi_x, dpi_y = image_width / (width / 72), image_height / (height / 72)
    matches = (F.abs(page - image) / page < 0.2) | (F.abs(page - 1 / image) / page < 0.2)
    covers = matches & (dpi_x >= 40) & (dpi_x <= 1300) & (F.abs(dpi_x - dpi_y) / dpi_x < 0.35)
    return F.when(covers, rounded(dpi_x).cast("int"))


def page_estimate(width: Column, height: Column, dpi: Column, defaults: Settings = Settings()) -> Column:
    """Bytes that a page is expected to take after conversion (under default settings)."""
    low = dpi.isNotNull() & (dpi < defaults.min_g4_dpi)
    at = F.when(low, dpi.cast("double")).otherwise(float(defaults.dpi_cap))
    pixels = width / 72 * at * (height / 72 * at)
    return F.greatest(F.lit(PAGE_FLOOR).cast("long"), F.floor(pixels * F.when(low, GRAY4_DENSITY).otherwise(G4_DENSITY)).cast("long"))


def reports(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n_pages, scans, verdict, estimated_bytes from pages (key, file_bytes, producer, wpt, hpt, dpi, compact).

    One aggregation by file: pages of a file are combined before the shuffle.
    """
    scan = F.col("dpi").isNotNull()
    files = pages.groupBy(key).agg(
        F.max("file_bytes").alias("file_bytes"), F.bool_or(own_producer(F.col("producer"))).alias("own"), F.count("*").alias("n_pages"), F.count_if(scan).alias("scans"),
        F.coalesce(F.bool_and(F.when(scan, F.col("compact"))), F.lit(True)).alias("all_compact"), F.sum(page_estimate(F.col("wpt"), F.col("hpt"), F.col("dpi"))).alias("estimate"),
    )
    verdict = (
        F.when(F.col("own"), "alreadyProcessed").when(F.col("scans") == 0, "bornDigital").when(F.col("all_compact"), "alreadyCompact")
        .when(F.floor(F.col("file_bytes") / F.col("scans")) < SMALL_PAGE, "alreadySmall").otherwise("convert")
    )
    return files.withColumn("verdict", verdict).select(key, "file_bytes", "n_pages", "scans", "verdict", F.when(F.col("verdict") == "convert", F.col("estimate")).otherwise(F.col("file_bytes")).alias("estimated_bytes"))


def included_by_default(verdict: Column, error: Column | None = None) -> Column:
    chosen = verdict.eqNullSafe(F.lit("convert"))
    return chosen if error is None else chosen & error.isNull()


def with_included(rows: DataFrame, overrides: DataFrame | None = None, key: str = "rel_path") -> DataFrame:
    """included: the default, or the user's override (key, included) on rows without an error."""
    out = rows.withColumn("included", included_by_default(F.col("verdict"), F.col("error")))
    if overrides is None:
        return out
    out = out.join(overrides.select(key, F.col("included").alias("__chosen")), key, "left")
    return out.withColumn("included", F.when(F.col("error").isNull(), F.coalesce("__chosen", "included")).otherwise(F.col("included"))).drop("__chosen")


def all_included(rows: DataFrame, value: bool) -> DataFrame:
    """Tick or untick all rows without an error."""
    return rows.withColumn("included", F.when(F.col("error").isNull(), F.lit(value)).otherwise(F.col("included")))


#: Label and help of each verdict.
VERDICT_TEXTS = {
    "convert": ("Re-compress", "Scanned pages that will be re-compressed to compact 1-bit"),
    "bornDigital": ("Born digital", "Real text/vector PDF — rasterising it would only make it worse"),
    "alreadyProcessed": ("Already converted", f"Produced by {PRODUCER} — converting again would only re-encode it"),
    "alreadyCompact": ("Already compact", "Pages are already archival-compact (1-bit or 4-bit)"),
    "alreadySmall": ("Already small", "Already compact for its page count"),
}


def verdict_text(verdict: Column, error: Column, which: int = 0) -> Column:
    """The verdict's label (0) or help (1)."""
    text = F.when(error.isNotNull(), F.lit("Unreadable") if which == 0 else error)
    for name, texts in VERDICT_TEXTS.items():
        text = text.when(verdict == name, texts[which])
    return text.otherwise("…" if which == 0 else "")


def ladder(pages: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """encoding and out_dpi of pages (is_text, dpi, damage): 1-bit, 4-bit gray or JPEG."""
    native = F.coalesce("dpi", F.lit(settings.dpi_cap))
    one_bit = F.col("is_text") & (native >= settings.min_g4_dpi) & (F.col("damage") <= settings.max_g4_damage)
    gray = F.greatest(F.lit(72), F.least(native, F.lit(settings.photo_dpi_cap)))
    demoted = F.lit("gray4" if settings.demoted_text_format == "gray4" else "jpeg")
    return pages.withColumns({"encoding": F.when(one_bit, "g4").when(F.col("is_text"), demoted).otherwise("jpeg"), "out_dpi": F.when(one_bit, F.lit(settings.text_dpi)).otherwise(gray).cast("int")})
