"""Arithmetic of text layers, page boxes and paper sizes, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Standard sizes in millimetres, in order of preference; the first four are for snapping.
PAPERS = [("A6", 105.0, 148.0), ("A5", 148.0, 210.0), ("A4", 210.0, 297.0), ("Letter", 216.0, 279.0), ("4×6″", 101.6, 152.4), ("5×7″", 127.0, 177.8), ("8×10″", 203.2, 254.0)]


def pdf_escape(text: Column) -> Column:
    """Parentheses and backslashes escaped, everything but printable ASCII as one space a code point."""
    return F.regexp_replace(F.regexp_replace(text, r"[^\x20-\x7F]", " "), r"([()\\])", r"\\$1")


def word_layout(words: DataFrame) -> DataFrame:
    """escaped, x, y, size, tz of words (text, box x, y, w, h of 0 to 1; page pt_w, pt_h, ox, oy). Words without text are left out."""
    size = F.greatest(F.lit(4.0), F.col("h") * F.col("pt_h"))
    out = words.withColumns({"escaped": pdf_escape(F.col("text")), "size": size}).where("escaped != ''")
    nominal = F.length("escaped") * F.col("size") * 0.5
    tz = F.when(nominal > 0, F.col("w") * F.col("pt_w") / nominal * 100).otherwise(100.0)
    return out.withColumns({"px": F.col("ox") + F.col("x") * F.col("pt_w"), "py": F.col("oy") + F.col("y") * F.col("pt_h"), "tz": F.least(F.lit(500.0), F.greatest(F.lit(20.0), tz))})


def page_box(pages: DataFrame) -> DataFrame:
    """box_w, box_h, ox, oy of pages (pt_w, pt_h, page_w, page_h, bed_x, bed_y): the image on its place in a box that holds it."""
    out = pages.withColumns({"box_w": F.greatest(F.coalesce("page_w", "pt_w"), F.col("pt_w")), "box_h": F.greatest(F.coalesce("page_h", "pt_h"), F.col("pt_h"))})
    return out.withColumns({"ox": F.least(F.col("bed_x"), F.col("box_w") - F.col("pt_w")), "oy": F.col("box_h") - F.col("pt_h") - F.least(F.col("bed_y"), F.col("box_h") - F.col("pt_h"))})


def paper_table(snap_only: bool = False) -> list[tuple[str, float, float]]:
    """Portrait and landscape of each size, in order of preference."""
    return [row for n, w, h in (PAPERS[:4] if snap_only else PAPERS) for row in ((n, w, h), (f"{n} landscape", h, w))]


def paper_name(sizes: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """sizes (width_mm, height_mm) with name: the first paper within the tolerance."""
    return _first_fit(sizes, paper_table(), lambda pw, ph: (F.abs(F.col("width_mm") - pw) <= tolerance) & (F.abs(F.col("height_mm") - ph) <= tolerance))


def paper_snap(crops: DataFrame, slack: float = 25.0) -> DataFrame:
    """crops (x0, y0, x1, y1, img_w, img_h, dpi) with s_x0 .. s_y1: grown to the first paper that holds them within the slack; null if none does."""
    per_mm = F.col("dpi") / 25.4
    crops = crops.withColumns({"width_mm": (F.col("x1") - F.col("x0")) / per_mm, "height_mm": (F.col("y1") - F.col("y0")) / per_mm})
    w, h = F.col("width_mm"), F.col("height_mm")
    out = _first_fit(crops, paper_table(True), lambda pw, ph: (w <= pw) & (pw <= w + slack) & (h <= ph) & (ph <= h + slack))
    tw, th = F.floor(F.col("pw") * per_mm).cast("int"), F.floor(F.col("ph") * per_mm).cast("int")
    out = out.withColumns({"s_x0": F.least(F.col("x0"), F.greatest(F.lit(0), F.col("img_w") - tw)), "s_y0": F.least(F.col("y0"), F.greatest(F.lit(0), F.col("img_h") - th))})
    out = out.withColumns({"s_x1": F.least(F.col("img_w"), F.col("s_x0") + tw), "s_y1": F.least(F.col("img_h"), F.col("s_y0") + th)})
    return out.withColumns({c: F.when(F.col("pw").isNotNull(), F.col(c)) for c in ("s_x0", "s_y0", "s_x1", "s_y1")})


def _first_fit(rows: DataFrame, papers: list[tuple[str, float, float]], fits: Callable[[Column, Column], Column]) -> DataFrame:
    """rows with the first paper (name, pw, ph) that fits(pw, ph): arms of one CASE over at most fourteen papers, so nothing is joined."""
    arms = None
    for name, w, h in papers:
        value = F.struct(F.lit(name).alias("name"), F.lit(w).alias("pw"), F.lit(h).alias("ph"))
        arms = (F if arms is None else arms).when(fits(F.lit(w), F.lit(h)), value)
    return rows.withColumn("__paper", arms).select("*", "__paper.name", "__paper.pw", "__paper.ph").drop("__paper")
