"""Opening, results and failures of a batch; image files."""

import struct
import zlib

import numpy as np
from pyspark.sql import functions as F

from quireflow.functions import kernels
from quireflow.operators import outcomes
from quireflow.plans import batch
from quireflow.sources import images


def png(pixels):
    """A PNG file of gray (h, w) or RGB (h, w, 3) pixels."""
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    h, w = pixels.shape[:2]
    rows = b"".join(b"\0" + row.tobytes() for row in pixels)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2 if pixels.ndim == 3 else 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def test_gray_images(spark, tmp_path):
    gray = np.arange(63, dtype=np.uint8).reshape(7, 9)
    color = np.random.RandomState(1).randint(0, 256, (5, 4, 3)).astype(np.uint8)
    (tmp_path / "g.png").write_bytes(png(gray))
    (tmp_path / "c.png").write_bytes(png(color))
    (tmp_path / "x.png").write_bytes(b"no image")
    found = {r["src"][-5:]: np.frombuffer(r["gray"], np.uint8).reshape(r["h"], r["w"]) for r in images.gray_images(spark, str(tmp_path)).collect()}
    assert set(found) == {"g.png", "c.png"} and (found["g.png"] == gray).all()
    assert np.abs(found["c.png"] - color @ [0.299, 0.587, 0.114]).max() <= 0.51


def test_cropped():
    page = np.arange(30, dtype=np.uint8).reshape(5, 6)
    assert kernels.cropped(page, 1, 2, 4, 4).tolist() == [[13, 14, 15], [19, 20, 21]]
    assert kernels.cropped(page, 2, 2, 2, 4).size == 0


def test_open_and_append(spark, tmp_path):
    for name in ("b/in2.pdf", "b/in10.PDF", "c.pdf", "b/note.txt"):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(b"")
    first = batch.open_sources(spark, [str(tmp_path / "b")])
    assert [r["rel_path"] for r in first.collect()] == ["in2.pdf", "in10.PDF"]
    more = batch.open_sources(spark, [str(tmp_path / "b"), str(tmp_path / "c.pdf")], first)
    assert sorted(r["rel_path"] for r in more.collect()) == ["c.pdf", "in10.PDF", "in2.pdf"]
    assert batch.folder_argument({batch.FOLDER_VARIABLE: str(tmp_path)}) == str(tmp_path)
    assert batch.folder_argument({batch.FOLDER_VARIABLE: str(tmp_path / "c.pdf")}) is None and batch.folder_argument({}) is None


def test_failures(spark):
    rows = spark.createDataFrame([("a", True, None), ("b", True, None), ("c", False, None), ("d", True, "Cannot open PDF")], "rel_path string, included boolean, error string")
    none = spark.createDataFrame([], "rel_path string, tag string, output_bytes long, error string")
    one = spark.createDataFrame([("a", "converted", 5, None), ("b", None, None, "disk")], none.schema)
    assert batch.failure_text(batch.with_results(rows.where("rel_path != 'd'"), none)).first()["text"] is None
    joined = {r["rel_path"]: (r["tag"], r["output_bytes"], r["error"]) for r in batch.with_results(rows, one).collect()}
    assert joined == {"a": ("converted", 5, None), "b": (None, None, "disk"), "c": (None, None, None), "d": (None, None, "Cannot open PDF")}
    assert batch.failure_text(batch.with_results(rows.where("rel_path != 'd'"), one)).first()["text"] == "1 file failed"
    assert batch.failure_text(batch.with_results(rows, one)).first()["text"] == "2 files failed"


def test_byte_label_in_whole_numbers(spark):
    """Half up to the last digit where a double has no room for it; null without bytes."""
    from decimal import Decimal

    expected = {
        0: "0 bytes", 999: "999 bytes", 1000: "1 KB", 1499: "1 KB", 1500: "2 KB", 999_999: "1000 KB", 1_049_999: "1.0 MB", 1_050_000: "1.1 MB", 999_950_000: "1000.0 MB", 1_004_999_999: "1.00 GB", 1_005_000_000: "1.01 GB",
        677_211_580_125_000_000: "677211580.13 GB", 677_211_580_124_999_999: "677211580.12 GB", 2**63 - 1: "9223372036.85 GB",
    }
    rows = spark.createDataFrame([(n, Decimal(n)) for n in expected] + [(None, None)], "n long, d decimal(38,0)")
    found = rows.select("n", outcomes.byte_label(F.col("n")).alias("a"), outcomes.byte_label(F.col("d")).alias("b")).collect()
    assert {r["n"]: (r["a"], r["b"]) for r in found} == {n: (v, v) for n, v in expected.items()} | {None: (None, None)}
    assert spark.createDataFrame([(Decimal(10**24 + 5_000_000),)], "d decimal(38,0)").select(outcomes.byte_label(F.col("d"))).first()[0] == "1000000000000000.01 GB"
