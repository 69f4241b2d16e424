import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quireflow.functions import codecs, kernels


def noise(seed: int = 0x5EED):
    state = seed
    while True:
        state = (state * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        yield (state >> 33) & 0xFF


def text_page(w=600, h=800, noisy=False):
    rng = noise()
    page = np.full((h, w), 250, np.uint8)
    if noisy:
        page[:] = np.array([244 + next(rng) % 12 for _ in range(w * h)], np.uint8).reshape(h, w)
    for line in range(60, h - 60, 24):
        for row in range(10):
            r, x = noise(line), 50
            while x < w - 50:
                dash = 12 + next(r) % 30
                page[line + row, x : min(x + dash, w - 50)] = 15
                x += dash + 8 + next(r) % 10
    return page


def block_page():
    page = np.full((800, 600), 250, np.uint8)
    page[300:340, 150:450] = 20
    return page


def photo_page(w=600, h=800):
    return ((np.arange(w)[None, :] + np.arange(h)[:, None]) * 255 // (w + h)).astype(np.uint8)


def mixed_page():
    page = np.full((800, 600), 250, np.uint8)
    for top, bottom, level in ((60, 360, 15), (440, 740, 205)):
        for y in range(top, bottom, 24):
            for x in range(50, 550):
                if x // 30 % 2 == 0:
                    page[y : y + 10, x] = level
    return page


@pytest.mark.parametrize("page, kind", [(text_page(), "text"), (text_page(noisy=True), "text"), (photo_page(), "photo"), (np.full((200, 200), 248, np.uint8), "text"), (np.zeros((0, 0), np.uint8), "text")])
def test_classify(page, kind):
    assert kernels.classify(page) == kind


def test_otsu_of_flat_and_of_two_levels():
    assert kernels.otsu(np.full((5, 5), 9, np.uint8)) == 128
    assert kernels.otsu(np.array([[10, 10, 200, 200]], np.uint8)) == 11


def test_sauvola_finds_faint_and_strong_ink():
    ink = kernels.sauvola(mixed_page(), 300)
    assert ink[65, 60] and ink[445, 60] and not ink[400, 10] and not ink[410, 300]
    assert not kernels.sauvola(np.full((400, 400), 245, np.uint8), 300).any()


def test_sauvola_agrees_with_otsu_on_a_crisp_page():
    page = text_page(noisy=True)
    assert (kernels.sauvola(page, 300) != (page < kernels.otsu(page))).mean() < 0.01


def test_sauvola_equals_brute_force():
    rng = noise()
    page = np.array([150 + next(rng) % 100 for _ in range(90 * 300)], np.uint8).reshape(300, 90)
    ink, r = kernels.sauvola(page, 150), 12
    for y in range(0, 300, 7):
        for x in range(0, 90, 5):
            box = page[max(0, y - r) : y + r + 1, max(0, x - r) : x + r + 1].astype(float)
            mean, deviation = box.mean(), np.sqrt(max(0.0, (box * box).mean() - box.mean() ** 2))
            assert ink[y, x] == (page[y, x] < mean * (1 + 0.15 * (deviation / 128 - 1)))


def test_damage():
    page = text_page(noisy=True)
    assert kernels.damage(page, kernels.sauvola(page, 300)) < 0.35
    assert kernels.damage(page, np.zeros(page.shape, bool)) > 0.4
    assert kernels.damage(np.full((50, 50), 240, np.uint8), np.zeros((50, 50), bool)) == 0


def test_edge_cleaning():
    page = block_page()
    assert (kernels.clean_edges(page, 75) == page).all()
    banded = page.copy()
    banded[:, :30] = 10
    cleaned = kernels.clean_edges(banded, 100)
    assert cleaned[400, 10] > 200 and cleaned[320, 300] < 50
    ruled = page.copy()
    ruled[500:504] = 30
    cleaned = kernels.clean_edges(ruled, 75)
    assert cleaned[502, 300] < 60 and cleaned[502, 2] < 60


def brute_components(mask, diagonal):
    labels, n = np.zeros(mask.shape, int), 0
    near = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dy or dx) and (diagonal or not (dy and dx))]
    for y, x in zip(*np.nonzero(mask), strict=True):
        if labels[y, x]:
            continue
        n += 1
        work = [(y, x)]
        while work:
            a, b = work.pop()
            if 0 <= a < mask.shape[0] and 0 <= b < mask.shape[1] and mask[a, b] and not labels[a, b]:
                labels[a, b] = n
                work += [(a + dy, b + dx) for dy, dx in near]
    return labels, n


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 14), st.integers(1, 14), st.booleans())
def test_components_equal_brute_force(seed, h, w, diagonal):
    mask = np.random.RandomState(seed).rand(h, w) < 0.5
    labels, n = kernels.components(mask, diagonal)
    expected, m = brute_components(mask, diagonal)
    assert n == m and len(set(zip(labels.ravel(), expected.ravel(), strict=True))) == n + (not mask.all())


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 20), st.integers(1, 70), st.sampled_from([0.0, 0.05, 0.5, 0.95, 1.0]))
def test_g4_round_trip(seed, h, w, share):
    ink = np.random.RandomState(seed).rand(h, w) < share
    assert (codecs.g4_decode(codecs.g4_encode(ink), w, h) == ink).all()


def test_g4_of_very_long_runs():
    ink = np.zeros((3, 7000), bool)
    ink[1, 100:6900] = True
    assert (codecs.g4_decode(codecs.g4_encode(ink), 7000, 3) == ink).all()


def test_tiff_strip():
    ink = kernels.sauvola(text_page(), 300)
    strip, w, h, min_is_black = codecs.tiff_strip(codecs.g4_tiff(ink))
    assert (w, h, min_is_black, strip) == (600, 800, False, codecs.g4_encode(ink))
    for broken in (b"PK", b"II*\0\xff\xff\xff\x7f", codecs.g4_tiff(ink).replace(b"\x03\x01\x03\x00\x01\x00\x00\x00\x04", b"\x03\x01\x03\x00\x01\x00\x00\x00\x01")):
        with pytest.raises(ValueError):
            codecs.tiff_strip(broken)


@pytest.mark.parametrize("w, h", [(300, 40), (301, 40), (1, 1)])
def test_gray4_round_trip(w, h):
    page = photo_page(w, h)
    assert np.abs(codecs.gray4_decode(codecs.gray4_encode(page), w, h).astype(int) - page).max() < 24


def test_jpeg_round_trip():
    page = photo_page(83, 61)
    assert np.abs(codecs.jpeg_decode(codecs.jpeg_encode(page, 0.9)).astype(int) - page).max() < 6


def test_crop_and_snap():
    ink = np.zeros((1169, 827), bool)
    assert kernels.content_crop(ink, 100) is None
    ink[100:900, 80:600] = True
    x0, y0, x1, y1 = kernels.content_crop(ink, 100)
    assert x0 <= 80 and y0 <= 100 and x1 >= 600 and y1 >= 900
    w, h, *_ = kernels.process_document(np.where(ink, 10, 250).astype(np.uint8), 100)
    assert (w, h) == (x1 - x0, y1 - y0)


def jpeg_scan(gray, quality):
    """The scan of a JPEG, symbol by symbol."""
    quant, bits, last = codecs._quant(quality), "", 0
    dc, ac = codecs._huffman(codecs.DC_LENGTHS, codecs.DC_VALUES), codecs._huffman(codecs.AC_LENGTHS, codecs.AC_VALUES)
    number = lambda v: format(v if v > 0 else v + (1 << abs(v).bit_length()) - 1, f"0{abs(v).bit_length()}b") if v else ""
    h, w = gray.shape
    padded = np.pad(gray.astype(float) - 128, ((0, -h % 8), (0, -w % 8)), mode="edge")
    for y in range(0, padded.shape[0], 8):
        for x in range(0, padded.shape[1], 8):
            row = np.rint((codecs._COSINES @ padded[y : y + 8, x : x + 8] @ codecs._COSINES.T).ravel() / quant).astype(int)[codecs.ZIGZAG].tolist()
            bits += dc[abs(row[0] - last).bit_length()] + number(row[0] - last)
            last, zeros = row[0], 0
            for v in row[1 : max((k for k in range(64) if row[k]), default=0) + 1]:
                if v:
                    bits += ac[0xF0] * (zeros // 16) + ac[zeros % 16 << 4 | abs(v).bit_length()] + number(v)
                zeros = 0 if v else zeros + 1
            bits += "" if row[63] else ac[0]
    bits += "1" * (-len(bits) % 8)
    return int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\0")


@pytest.mark.parametrize("quality", [0.01, 0.3, 0.95, 1.0])
def test_jpeg_symbols_and_restarts(quality, monkeypatch):
    """Codes worked out together are those of one symbol after another; a file with restarts is read like its strips."""
    monkeypatch.setattr(codecs, "TOKENS", 50)
    rng = np.random.RandomState(6)
    sparse = np.full((24, 30), 200)
    sparse[5, 3:9] = sparse[17, 20] = 10
    for gray in (rng.randint(0, 256, (24, 30)), sparse, np.full((9, 1), 7), rng.randint(0, 2, (16, 17)) * 255):
        gray = gray.astype(np.uint8)
        whole = codecs.jpeg_encode(gray, quality)
        head, body = whole[: whole.index(b"\xff\xda")], whole[whole.index(b"\xff\xda") :]
        assert body[10:-2] == jpeg_scan(gray, quality)
        strips = [codecs.jpeg_encode(gray[y : y + 8], quality) for y in range(0, gray.shape[0], 8)]
        scans = [s[s.index(b"\xff\xda") + 10 : -2] for s in strips]
        joined = b"".join(s + bytes([0xFF, 0xD0 + k % 8]) for k, s in enumerate(scans))[:-2]
        restarted = head + b"\xff\xdd\0\4" + (-(-gray.shape[1] // 8)).to_bytes(2, "big") + body[:10] + joined + b"\xff\xd9"
        assert np.array_equal(codecs.jpeg_decode(restarted), np.concatenate([codecs.jpeg_decode(s) for s in strips]))
        assert codecs.jpeg_decode(whole[: len(head) + 10 + (len(body) - 12) // 2]).shape == gray.shape
    with pytest.raises(ValueError, match="broken"):
        codecs.jpeg_decode(head + body[:10] + b"\xff\0" * 99)
