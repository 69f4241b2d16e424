import os
import time

import numpy as np
import pytest
from test_kernels import block_page, photo_page, text_page

from quireflow.functions import codecs, pdf
from quireflow.functions.pdf import PageContent, Pdf, build, escape
from quireflow.plans import archive, sinks
from quireflow.settings import PRODUCER, Settings
from quireflow.sources import catalog
from quireflow.streaming.watch import watch


def scan(page, dpi, quality=0.95, producer="Test Scanner"):
    return build([PageContent("jpeg", codecs.jpeg_encode(page, quality), page.shape[1], page.shape[0], dpi)], producer)


def files(spark, contents):
    return spark.createDataFrame([(k, bytearray(v)) for k, v in contents.items()], "path string, content binary")


BORN = b"%PDF-1.4\n1 0 obj\n<</Type/Catalog/Pages 2 0 R>>\nendobj\n2 0 obj\n<</Type/Pages/Kids[3 0 R]/Count 1/MediaBox[0 0 595 842]>>\nendobj\n3 0 obj\n<</Type/Page/Parent 2 0 R/Rotate 90>>\nendobj\ntrailer\n<</Root 1 0 R>>\n%%EOF"


def test_inspect(spark):
    g4 = np.zeros((1754, 1240), bool)
    found = archive.inspect(
        files(
            spark,
            {
                "born": BORN,
                "convert": scan(np.random.RandomState(1).randint(0, 256, (400, 300)).astype(np.uint8), 50),
                "small": scan(block_page(), 75, 0.3),
                "compact": build([PageContent("g4", codecs.g4_encode(g4), 1240, 1754, 150)], "Test Scanner"),
                "own": scan(block_page(), 75, producer=f"{PRODUCER} 1.2"),
                "other": scan(block_page(), 75, producer=f"{PRODUCER}ish"),
                "bad": b"nothing",
                "empty": b"",
                "locked": BORN.replace(b"/Root 1 0 R", b"/Root 1 0 R/Encrypt 9 0 R"),
            },
        )
    )
    rows = {r["path"]: r for r in found.collect()}
    verdict = {k: r["verdict"] for k, r in rows.items()}
    assert verdict == {"born": "bornDigital", "convert": "convert", "small": "alreadySmall", "compact": "alreadyCompact", "own": "alreadyProcessed", "other": "alreadySmall", "bad": None, "empty": None, "locked": None}
    assert rows["bad"]["error"] == "Cannot open PDF" and "password" in rows["locked"]["error"]
    kinds = archive.page_kinds(archive.read_pages(files(spark, {"x": scan(np.full((1754, 1240), 250, np.uint8), 150)}))).first()
    assert (kinds["dpi"], kinds["compact"]) == (150, False)


def test_convert(spark):
    contents = {
        "text": scan(np.repeat(np.repeat(text_page(300, 400), 2, 0), 2, 1), 150),
        "low": scan(text_page(300, 400), 75),
        "photo": scan(photo_page(310, 438), 150),
        "born": BORN,
        "bad": b"?",
    }
    settings = Settings(ocr=False, dpi_cap=150, min_saving_fraction=-5.0)
    # verdicts of small files: the ladder is tested on pages, the outcome on files
    pages = archive.page_kinds(archive.read_pages(files(spark, contents))).where("error is null and dpi is not null")
    encoded = archive.encode_pages(files(spark, contents), pages, settings)
    built = {r["path"]: r for r in archive.assemble(encoded).collect()}
    assert {k: r["encodings"] for k, r in built.items()} == {"text": ["g4"], "low": ["gray4"], "photo": ["jpeg"]}
    assert b"CCITTFaxDecode" in built["text"]["built"] and b"/BitsPerComponent 4" in built["low"]["built"] and b"DCTDecode" in built["photo"]["built"]
    again = archive.inspect(files(spark, {k: r["built"] for k, r in built.items()}))
    assert {r["verdict"] for r in again.collect()} == {"alreadyProcessed"}
    out = {r["path"]: r for r in archive.convert(files(spark, contents), settings).collect()}
    assert out["born"]["tag"] == "copied" and bytes(out["born"]["output"]) == BORN and out["bad"]["error"] and out["bad"]["tag"] is None


def test_files_are_read_twice_and_pages_decoded_once(spark, tmp_path, monkeypatch):
    def noted(batches):
        for batch in batches:
            for name in batch.column(0).to_pylist():
                (tmp_path / f"{name}-{time.time_ns()}-{os.getpid()}").touch()
            yield batch

    content = scan(np.random.RandomState(2).randint(0, 256, (500, 380)).astype(np.uint8), 60, 0.98)
    source = files(spark, {"a": content, "b": BORN}).mapInArrow(noted, "path string, content binary")
    rows = {r["path"]: r for r in archive.converted(source, Settings(ocr=False, min_saving_fraction=-1.0)).collect()}
    assert (rows["a"]["tag"], rows["b"]["tag"], rows["b"]["built"]) == ("converted", "copied", None) and rows["a"]["output_bytes"] == len(rows["a"]["built"])
    assert len(list(tmp_path.glob("a-*"))) == 2
    image, calls = pdf.page_image(Pdf(content), Pdf(content).pages()[0]), []
    monkeypatch.setattr(codecs, "jpeg_decode", lambda raw, f=codecs.jpeg_decode: calls.append(1) or f(raw))
    pixels = pdf.page_pixels(image)
    page = archive.convert_page(lambda dpi: pdf.render_pixels(pixels, (456.0, 600.0, 0), dpi), 60, Settings(ocr=False))
    assert page.kind == "jpeg" and len(calls) == 1


def test_acceptance(spark):
    content = scan(np.random.RandomState(2).randint(0, 256, (500, 380)).astype(np.uint8), 60, 0.98)
    kept = archive.convert(files(spark, {"a": content}), Settings(ocr=False, min_saving_fraction=0.9999)).first()
    assert (kept["tag"], kept["copy_reason"], bytes(kept["output"])) == ("copied", "insufficientSaving", content)


def test_ocr_layer_and_escape():
    page = PageContent("jpeg", codecs.jpeg_encode(photo_page(40, 40), 0.6), 40, 40, 72, [("a(b)", 0.1, 0.1, 0.3, 0.1), ("", 0, 0, 1, 1)])
    data = build([page])
    assert b"3 Tr" in data and b"(a\\(b\\)) Tj" in data and b"/Font" in data and Pdf(data).producer() == PRODUCER
    assert escape("é\\") == " \\\\" and b"/Font<<" not in build([PageContent("jpeg", b"", 1, 1, 72)])


def tree(root, *names):
    for name in names:
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"x")


def rel(df):
    return [r["rel_path"] for r in df.collect()]


def test_catalog(spark, tmp_path):
    folder = tmp_path / "Folder"
    tree(folder, "a.pdf", "b/inner/c.pdf", "b/d.PDF", "note.txt", ".hidden.pdf", "x.app/in.pdf", "_y.pdf")
    assert rel(catalog.items(spark, [str(folder)])) == ["_y.pdf", "a.pdf", "b/d.PDF", "b/inner/c.pdf"]
    tree(tmp_path, "loose.pdf", "other/scan.pdf", "more/scan.pdf", "note.txt", "f2.pdf", "f10.pdf")
    assert rel(catalog.items(spark, [str(folder), str(tmp_path / "loose.pdf")]))[-1] == "loose.pdf"
    scans = catalog.items(spark, [str(tmp_path / "other/scan.pdf"), str(tmp_path / "more/scan.pdf")])
    assert sorted(rel(scans)) == ["scan-2.pdf", "scan.pdf"]
    assert rel(catalog.items(spark, [str(tmp_path / "note.txt")])) == []
    assert len(rel(catalog.items(spark, [str(folder), str(folder / "a.pdf")]))) == 4
    assert rel(catalog.items(spark, [str(tmp_path / "more/scan.pdf")], catalog.items(spark, [str(tmp_path / "other/scan.pdf")]))) == ["scan-2.pdf"]
    assert rel(catalog.items(spark, [str(tmp_path / "other/scan.pdf")], catalog.items(spark, [str(tmp_path / "other/scan.pdf")]))) == []
    assert rel(catalog.items(spark, [str(tmp_path / "f10.pdf"), str(tmp_path / "f2.pdf")])) == ["f2.pdf", "f10.pdf"]


def test_numbers_that_meet_natural_names(spark):
    rows = spark.createDataFrame([("/1", "a.pdf", 1), ("/2", "a-2.pdf", 2), ("/3", "a.pdf", 3), ("/4", "a.pdf", 4)], "src string, rel_path string, seq long")
    assert {r["src"]: r["rel_path"] for r in catalog.unique_names(rows).collect()} == {"/1": "a.pdf", "/2": "a-2.pdf", "/3": "a-3.pdf", "/4": "a-4.pdf"}


def test_many_names_are_inserted_in_proportion():
    """As by trying every number from 2, in a time that doesn't grow with the square of a name's repeats."""
    rng = np.random.RandomState(5)
    paths = [f"{'abc'[k % 3]}{rng.choice(['', '-2', '-3', '-2-2', '-40'])}{rng.choice(['.pdf', '.PDF', ''])}" for k in range(600)]
    old = [k < 60 for k in range(600)]
    seen, expected = set(), []
    for path, kept in zip(paths, old, strict=True):
        base, n, name = os.path.splitext(path)[0], 2, path
        while name in seen and not kept:
            name, n = f"{base}-{n}.pdf", n + 1
        seen.add(name)
        expected.append(name)
    assert catalog.inserted(paths, old) == expected
    began = time.perf_counter()
    names = catalog.inserted(["a.pdf"] * 30000 + ["a-30001.pdf"] + ["a.pdf"] * 30000, [False] * 60001)
    assert len(set(names)) == 60001 and names[30001] == "a-30002.pdf" and time.perf_counter() - began < 20


def test_sink(spark, tmp_path):
    rows = spark.createDataFrame([("/in/a.pdf", "d/a.pdf", bytearray(b"x"), 1e9)], "src string, rel_path string, output binary, mtime double")
    done = sinks.write_tree(rows, str(tmp_path)).collect()
    path = tmp_path / "d/a.pdf"
    assert done[0]["n_bytes"] == 1 and path.read_bytes() == b"x" and os.path.getmtime(path) == 1e9
    with pytest.raises(sinks.WouldOverwrite):
        sinks.write_tree(rows.selectExpr(f"'{path}' as src", "rel_path", "output", "mtime"), str(tmp_path))


def test_watch(spark, tmp_path):
    tree(tmp_path / "in", "a.pdf", "s/a.pdf")
    for _ in range(2):
        watch(spark, str(tmp_path / "in"), str(tmp_path / "cat"), str(tmp_path / "check")).awaitTermination()
        tree(tmp_path / "in", "b.pdf")
    assert sorted(r["rel_path"] for r in spark.read.parquet(str(tmp_path / "cat")).collect()) == ["a-2.pdf", "a.pdf", "b.pdf"]


@pytest.mark.parametrize("colors", [1, 3])
def test_png_row_filters(colors):
    """All five filters, against the definition written the other way round."""
    rng = np.random.RandomState(4)
    width, rows = 7 * colors, rng.randint(0, 256, (10, 7 * colors))
    raw, above = bytearray(), [0] * width
    for y, row in enumerate(rows.tolist()):
        kind = y % 5
        raw.append(kind)
        for k, x in enumerate(row):
            a, b, c = row[k - colors] if k >= colors else 0, above[k], above[k - colors] if k >= colors else 0
            p = a + b - c
            paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            raw.append((x - [0, a, b, (a + b) // 2, paeth][kind]) & 255)
        above = row
    assert np.array_equal(np.frombuffer(pdf._unpredict(bytes(raw), 8 * width, colors), np.uint8).reshape(10, width), rows)


@pytest.mark.parametrize("black_is_1,decode,inverted", [(False, [], False), (True, [], True), (True, [1, 0], False), (False, [1, 0], True)])
def test_fax_polarity(black_is_1, decode, inverted):
    ink = np.zeros((20, 40), bool)
    ink[4:9, 3:30] = True
    image = {"w": 40, "h": 20, "bpc": 1, "filters": ["CCITTFaxDecode"], "parms": [{"K": -1, "BlackIs1": black_is_1}], "decode": decode, "raw": codecs.g4_encode(ink)}
    assert np.array_equal(pdf.decode_image(image) == 0, ink ^ inverted)
    with pytest.raises(ValueError, match="Group 3"):
        pdf.decode_image(image | {"parms": [{"K": 0}]})


def test_unreadable_pages_are_kept():
    data = b"%PDF-1.4\n1 0 obj<</Type/Catalog/Pages 2 0 R>>endobj\n2 0 obj<</Type/Pages/Count 2/Kids[3 0 R 9 0 R]>>endobj\n3 0 obj<</Type/Page/MediaBox[0 0 100 200]>>endobj\ntrailer<</Root 1 0 R>>"
    found = pdf.Pdf(data)
    assert [found.media_box(p)[:2] for p in found.pages()] == [(100.0, 200.0), (595.0, 842.0)]
