"""Plans over whole archives: inspection of files, conversion page by page, assembly, and the dense kernels by group.

Files become rows (path, content); pages become rows with their pixels' encoded
bytes. Page kernels run in Arrow batches of a few rows; a file's pages meet
again in one shuffle by file.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireflow.functions import codecs, kernels
from quireflow.functions.pdf import PageContent, Pdf, PdfError, build, page_image, page_pixels, render_pixels
from quireflow.operators import outcomes, verdicts
from quireflow.plans.storage import stored
from quireflow.settings import Settings

PAGES = "path string, file_bytes long, producer string, page_no int, wpt double, hpt double, rotation int, images array<struct<w:int,h:int,bpc:int,filters:array<string>>>, error string"


def read_pages(files: DataFrame) -> DataFrame:
    """PAGES of files (path, content): a row per page, or one with the error of a file that can't be read. No pixel is decoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                blank = {"path": path, "file_bytes": len(content or b""), "producer": None, "page_no": None, "wpt": None, "hpt": None, "rotation": None, "images": None, "error": None}
                try:
                    pdf = Pdf(content or b"")
                    if pdf.locked:
                        raise PdfError("PDF is password-protected")
                    pages = pdf.pages()
                    if not pages:
                        raise PdfError("Cannot open PDF")
                    rows = []
                    for n, page in enumerate(pages, 1):
                        w, h, rotation = pdf.media_box(page)
                        images = [{k: i[k] for k in ("w", "h", "bpc", "filters")} for i in pdf.images(page)]
                        rows.append({**blank, "producer": pdf.producer(), "page_no": n, "wpt": w, "hpt": h, "rotation": rotation, "images": images})
                except (ValueError, KeyError, IndexError, TypeError, RecursionError) as e:
                    rows = [{**blank, "error": str(e) or "Cannot open PDF"}]
                yield pa.RecordBatch.from_pylist(rows, schema)

    image = pa.struct([("w", pa.int32()), ("h", pa.int32()), ("bpc", pa.int32()), ("filters", pa.list_(pa.string()))])
    schema = pa.schema([("path", pa.string()), ("file_bytes", pa.int64()), ("producer", pa.string()), ("page_no", pa.int32()), ("wpt", pa.float64()), ("hpt", pa.float64()), ("rotation", pa.int32()), ("images", pa.list_(image)), ("error", pa.string())])
    return files.select("path", "content").mapInArrow(run, PAGES)


def page_kinds(pages: DataFrame) -> DataFrame:
    """pages with dpi (null: born digital) and compact, by the largest image."""
    w, h = verdicts.oriented_size(F.col("wpt"), F.col("hpt"), F.coalesce("rotation", F.lit(0)))
    out = verdicts.largest_image(pages.withColumns({"wpt": w, "hpt": h}), ["path", "page_no"])
    dpi = F.when(F.col("image").isNotNull() & (F.col("image.h") > 0) & (F.col("hpt") > 0), verdicts.scan_dpi(F.col("wpt"), F.col("hpt"), F.col("image.w"), F.col("image.h")))
    return out.withColumns({"dpi": dpi, "compact": F.coalesce(verdicts.compact_image(F.col("image.bpc"), F.col("image.filters")), F.lit(False))}).drop("image")


def inspect(files: DataFrame) -> DataFrame:
    """path, file_bytes, n_pages, scans, verdict, estimated_bytes, error of files (path, content)."""
    return _reports(page_kinds(read_pages(files)))


def _reports(pages: DataFrame) -> DataFrame:
    good = verdicts.reports(pages.where("error is null"), "path").withColumn("error", F.lit(None).cast("string"))
    bad = pages.where("error is not null").select("path", "file_bytes", "error")
    return good.unionByName(bad, allowMissingColumns=True)


def convert_page(render: Callable[[int], np.ndarray], native: int | None, settings: Settings, ocr: Callable | None = None) -> PageContent:
    """One page, drawn by render at a resolution, through the ladder: text to 1-bit unless too coarse or damaged, then 4-bit gray; pictures to JPEG."""
    native = settings.dpi_cap if native is None else native
    clean = settings.remove_scan_edges
    probe = render(settings.probe_render_dpi)
    probe = kernels.clean_edges(probe, settings.probe_render_dpi) if clean else probe

    def prepared(dpi: int, cleaned: bool) -> np.ndarray:
        if dpi == settings.probe_render_dpi and cleaned == clean:
            return probe
        gray = render(dpi)
        return kernels.clean_edges(gray, dpi) if cleaned else gray

    is_text, gray, dpi, content = kernels.classify(probe) == "text", None, settings.text_dpi, None
    if is_text and native >= settings.min_g4_dpi:
        gray = prepared(dpi, clean)
        ink = kernels.sauvola(gray, dpi)
        if kernels.damage(gray, ink) <= settings.max_g4_damage:
            ink = kernels.despeckle(ink)
            content = PageContent("g4", codecs.g4_encode(ink), ink.shape[1], ink.shape[0], dpi)
    if content is None:
        dpi = settings.gray_dpi(native)
        gray = kernels.scaled(gray, dpi / settings.text_dpi) if gray is not None else prepared(dpi, is_text and clean)
        packed = is_text and settings.demoted_text_format == "gray4"
        content = PageContent("gray4" if packed else "jpeg", codecs.gray4_encode(gray) if packed else codecs.jpeg_encode(gray, settings.jpeg_quality, dpi), gray.shape[1], gray.shape[0], dpi)
    if settings.ocr and ocr is not None:
        content.words = ocr(kernels.scaled(gray, settings.ocr_dpi / dpi) if dpi > settings.ocr_dpi else gray)
    return content


ENCODED = "path string, page_no int, kind string, data binary, width int, height int, dpi int, words array<struct<text:string,x:double,y:double,w:double,h:double>>, error string"


def page_streams(files: DataFrame) -> DataFrame:
    """path, page_no, head (JSON: the page's box and its image without the stream), raw, error of every page of files (path, content).

    A page's stream is cut out of its file here, so that only it is shuffled and
    no task that draws a page parses the file again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("page_no", pa.int32()), ("head", pa.string()), ("raw", pa.binary()), ("error", pa.string())])
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                pdf = Pdf(content)
                for n, page in enumerate(pdf.pages(), 1):
                    row = {"path": path, "page_no": n, "head": None, "raw": None, "error": None}
                    try:
                        image = page_image(pdf, page) or {"raw": None}
                        raw = image.pop("raw")
                        row |= {"head": json.dumps({"box": pdf.media_box(page), "image": image or None}), "raw": raw}
                    except (ValueError, KeyError, IndexError, TypeError) as e:
                        row["error"] = str(e)
                    yield pa.RecordBatch.from_pylist([row], schema)

    return files.select("path", "content").mapInArrow(run, "path string, page_no int, head string, raw binary, error string")


def encode_pages(files: DataFrame, pages: DataFrame, settings: Settings = Settings(), ocr: Callable | None = None) -> DataFrame:
    """ENCODED: a row per page of pages (path, page_no, dpi) of files (path, content). Pages of one file may run in different tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word = pa.struct([("text", pa.string()), *((c, pa.float64()) for c in "xywh")])
        schema = pa.schema([("path", pa.string()), ("page_no", pa.int32()), ("kind", pa.string()), ("data", pa.binary()), ("width", pa.int32()), ("height", pa.int32()), ("dpi", pa.int32()), ("words", pa.list_(word)), ("error", pa.string())])
        for batch in batches:
            for row in batch.to_pylist():
                out = {"path": row["path"], "page_no": row["page_no"]}
                try:
                    if row["error"] is not None:
                        raise PdfError(row["error"])
                    head = json.loads(row["head"])
                    image = head["image"] and head["image"] | {"raw": row["raw"]}
                    pixels = page_pixels(image)
                    p = convert_page(lambda dpi: render_pixels(pixels, head["box"], dpi), row["dpi"], settings, ocr)  # noqa: B023
                    out |= {"kind": p.kind, "data": p.data, "width": p.width, "height": p.height, "dpi": p.dpi, "words": [dict(zip(("text", "x", "y", "w", "h"), x, strict=True)) for x in p.words]}
                except (ValueError, KeyError, IndexError, TypeError) as e:
                    out["error"] = str(e)
                yield pa.RecordBatch.from_pylist([out], schema)

    wanted = pages.select("path", "page_no", "dpi")
    joined = wanted.join(page_streams(files.join(wanted.select("path").distinct(), "path", "left_semi")), ["path", "page_no"])
    return joined.repartition("path", "page_no").select("path", "page_no", "dpi", "head", "raw", "error").mapInArrow(run, ENCODED)


def assemble(encoded: DataFrame) -> DataFrame:
    """path, built (the new file), encodings, error: one shuffle by file; a file's pages in order."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["page_no"])
        error = next((r["error"] for r in rows if r["error"]), None)
        built = None if error else build([PageContent(r["kind"], r["data"], r["width"], r["height"], r["dpi"], [tuple(w.values()) for w in r["words"] or []]) for r in rows])
        return pa.table({"path": [key[0].as_py()], "built": pa.array([built], pa.binary()), "encodings": pa.array([[r["kind"] for r in rows]], pa.list_(pa.string())), "error": pa.array([error], pa.string())})

    return encoded.groupBy("path").applyInArrow(run, "path string, built binary, encodings array<string>, error string")


def converted(files: DataFrame, settings: Settings = Settings(), ocr: Callable | None = None) -> DataFrame:
    """path, verdict, input_bytes, output_bytes, tag, copy_reason, encodings, built (the new file's bytes, of converted files), error of files (path, content).

    Files are read twice, for their pages' metadata (stored, as several steps
    need it) and for the pages' streams of those to convert. A page that can't be
    drawn fails its file (it is never left out).
    """
    pages = page_kinds(stored(read_pages(files), "pages"))
    reports = _reports(pages)
    wanted = pages.join(reports.where("verdict = 'convert'").select("path"), "path", "left_semi")
    built = assemble(encode_pages(files, wanted, settings, ocr))
    joined = reports.select("path", "verdict", F.col("file_bytes").alias("input_bytes"), F.col("error").alias("read_error")).join(built, "path", "left")
    joined = joined.withColumns({"error": F.coalesce("read_error", "error"), "built_bytes": F.length("built").cast("long")})
    out = outcomes.outcomes(joined, settings.min_saving_fraction)
    good = F.col("error").isNull()
    new = good & (F.col("tag") == "converted")
    return out.select("path", "verdict", "input_bytes", *[F.when(good, F.col(c)).alias(c) for c in ("output_bytes", "tag", "copy_reason")], *[F.when(new, F.col(c)).alias(c) for c in ("encodings", "built")], "error")


def convert(files: DataFrame, settings: Settings = Settings(), ocr: Callable | None = None) -> DataFrame:
    """converted() with output (bytes) in the place of built: files that pass through, or that saved too little, keep their bytes."""
    out = converted(files, settings, ocr).join(files.select("path", "content"), "path")
    output = F.when(F.col("error").isNull(), F.when(F.col("tag") == "converted", F.col("built")).otherwise(F.col("content")))
    return out.select("path", "verdict", "input_bytes", "output_bytes", "tag", "copy_reason", "encodings", output.alias("output"), "error")


def images(px: DataFrame) -> DataFrame:
    """page, w, h, gray (bytes): dense pages from px; one page's pixels meet in one task."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        y, x, g = (table[c].to_numpy() for c in ("y", "x", "g"))
        gray = np.full((int(y.max()) + 1, int(x.max()) + 1), 255, np.uint8)
        gray[y, x] = g
        return pa.table({"page": pa.array([key[0].as_py()], pa.int32()), "w": pa.array([gray.shape[1]], pa.int32()), "h": pa.array([gray.shape[0]], pa.int32()), "gray": pa.array([gray.tobytes()], pa.binary())})

    return px.groupBy("page").applyInArrow(run, "page int, w int, h int, gray binary")


def page_map(pages: DataFrame, kernel: Callable[[int, np.ndarray], dict], schema: str) -> DataFrame:
    """kernel(page, gray) of each dense page, as rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [kernel(r["page"], np.frombuffer(r["gray"], np.uint8).reshape(r["h"], r["w"])) for r in batch.to_pylist()]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, arrow)

    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary()}
    arrow = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")])
    return pages.mapInArrow(run, schema)


def _px(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quireflow.queries import px_table

    return px_table(spark, sf_dir)


def despeckle_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ink darker than 64 in 8-connected parts of at least four pixels, and in smaller ones."""

    def kernel(page: int, gray: np.ndarray) -> dict:
        ink = gray < 64
        kept = int(kernels.despeckle(ink).sum())
        return {"page": page, "kept": kept, "removed": int(ink.sum()) - kept}

    return page_map(images(_px(spark, sf_dir)), kernel, "page int, kept long, removed long").where("kept + removed > 0")


def edge_flood_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels darker than 110 that are 4-connected with the border through such pixels, and how deep they reach."""

    def kernel(page: int, gray: np.ndarray) -> dict:
        labels, n = kernels.components(gray < 110, False)
        border = np.unique(np.concatenate([labels[0], labels[-1], labels[:, 0], labels[:, -1]]))
        ys, xs = np.nonzero(np.isin(labels, border[border > 0]))
        h, w = gray.shape
        depth = np.minimum(np.minimum(xs, w - 1 - xs), np.minimum(ys, h - 1 - ys))
        return {"page": page, "reached": len(ys), "depth": int(depth.max()) if len(ys) else 0}

    return page_map(images(_px(spark, sf_dir)), kernel, "page int, reached long, depth int").where("reached > 0")


def kernel_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All dense kernels on the raster's pages."""

    def kernel(page: int, gray: np.ndarray) -> dict:
        ink = kernels.sauvola(gray, 100)
        crop = kernels.content_crop(ink, 100) or (0, 0, 0, 0)
        return {
            "page": page, "otsu": kernels.otsu(gray), "kind": kernels.classify(gray), "n_ink": int(ink.sum()), "damage": round(kernels.damage(gray, ink, 4, 8, 8), 6), "cleaned": int((kernels.clean_edges(gray, 100) != gray).sum()),
            "crop_x1": crop[2], "g4_bytes": len(codecs.g4_encode(ink)), "gray4_bytes": len(codecs.gray4_encode(gray)), "jpeg_bytes": len(codecs.jpeg_encode(gray, 0.6)),
        }

    return page_map(images(_px(spark, sf_dir)), kernel, "page int, otsu int, kind string, n_ink long, damage double, cleaned long, crop_x1 int, g4_bytes long, gray4_bytes long, jpeg_bytes long")


def convert_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversion of small scans made of the raster's pages: each a one-page file at 100 dpi."""

    def kernel(page: int, gray: np.ndarray) -> dict:
        big = np.repeat(np.repeat(gray, 6, axis=0), 6, axis=1)
        return {"path": f"scan-{page}.pdf", "content": build([PageContent("jpeg", codecs.jpeg_encode(big, 0.95), big.shape[1], big.shape[0], 100)], "Test Scanner")}

    files = stored(page_map(images(_px(spark, sf_dir)), kernel, "path string, content binary"), "scans")
    return converted(files, Settings(ocr=False, min_saving_fraction=-1.0)).drop("built")
