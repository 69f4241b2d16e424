"""Encoders and decoders: CCITT T.6, TIFF strips, 4-bit Flate, baseline gray JPEG."""

from __future__ import annotations

import struct
import zlib
from functools import lru_cache

import numpy as np

# Fixed values of ITU-T T.4/T.6: codes of run lengths 0..63, of 64..1728 in steps of 64, and of 1792..2560.
WHITE = "00110101 000111 0111 1000 1011 1100 1110 1111 10011 10100 00111 01000 001000 000011 110100 110101 101010 101011 0100111 0001100 0001000 0010111 0000011 0000100 0101000 0101011 0010011 0100100 0011000 00000010 00000011 00011010 00011011 00010010 00010011 00010100 00010101 00010110 00010111 00101000 00101001 00101010 00101011 00101100 00101101 00000100 00000101 00001010 00001011 01010010 01010011 01010100 01010101 00100100 00100101 01011000 01011001 01011010 01011011 01001010 01001011 00110010 00110011 00110100".split()
WHITE_64 = "11011 10010 010111 0110111 00110110 00110111 01100100 01100101 01101000 01100111 011001100 011001101 011010010 011010011 011010100 011010101 011010110 011010111 011011000 011011001 011011010 011011011 010011000 010011001 010011010 011000 010011011".split()
BLACK = "0000110111 010 11 10 011 0011 0010 00011 000101 000100 0000100 0000101 0000111 00000100 00000111 000011000 0000010111 0000011000 0000001000 00001100111 00001101000 00001101100 00000110111 00000101000 00000010111 00000011000 000011001010 000011001011 000011001100 000011001101 000001101000 000001101001 000001101010 000001101011 000011010010 000011010011 000011010100 000011010101 000011010110 000011010111 000001101100 000001101101 000011011010 000011011011 000001010100 000001010101 000001010110 000001010111 000001100100 000001100101 000001010010 000001010011 000000100100 000000110111 000000111000 000000100111 000000101000 000001011000 000001011001 000000101011 000000101100 000001011010 000001100110 000001100111".split()
BLACK_64 = "0000001111 000011001000 000011001001 000001011011 000000110011 000000110100 000000110101 0000001101100 0000001101101 0000001001010 0000001001011 0000001001100 0000001001101 0000001110010 0000001110011 0000001110100 0000001110101 0000001110110 0000001110111 0000001010010 0000001010011 0000001010100 0000001010101 0000001011010 0000001011011 0000001100100 0000001100101".split()
LONG_64 = "00000001000 00000001100 00000001101 000000010010 000000010011 000000010100 000000010101 000000010110 000000010111 000000011100 000000011101 000000011110 000000011111".split()
PASS, HORIZONTAL = "0001", "001"
VERTICAL = {0: "1", 1: "011", 2: "000011", 3: "0000011", -1: "010", -2: "000010", -3: "0000010"}


def _run(n: int, black: bool) -> str:
    out = ""
    while n > 2560:
        out, n = out + LONG_64[-1], n - 2560
    if n >= 1792:
        out, n = out + LONG_64[n // 64 - 28], n % 64
    elif n >= 64:
        out, n = out + (BLACK_64 if black else WHITE_64)[n // 64 - 1], n % 64
    return out + (BLACK if black else WHITE)[n]


def _changes(row: np.ndarray) -> list[int]:
    """Places at which the colour changes, from an imagined white start."""
    return np.flatnonzero(np.diff(np.concatenate([[0], row.astype(np.int8)]))).tolist()


def g4_encode(ink: np.ndarray) -> bytes:
    """T.6 data of a bilevel image; ink is black."""
    h, w = ink.shape
    out: list[str] = []
    above: list[int] = []
    for y in range(h):
        here = _changes(ink[y])
        a0, black, i, j = -1, False, 0, 0
        while a0 < w:
            while i < len(here) and here[i] <= a0 and not (a0 < 0 and here[i] == 0):
                i += 1
            # here[i] is the next change; its parity tells the colour it changes to
            while i < len(here) and (i % 2 == 0) == black:
                i += 1
            a1 = here[i] if i < len(here) else w
            j = max(0, j - 2)
            while j < len(above) and (above[j] <= a0 or (j % 2 == 0) == black):
                j += 1
            b1 = above[j] if j < len(above) else w
            b2 = above[j + 1] if j + 1 < len(above) else w
            if b2 < a1:
                out.append(PASS)
                a0 = b2
            elif abs(a1 - b1) <= 3:
                out.append(VERTICAL[a1 - b1])
                a0, black = a1, not black
            else:
                a2 = here[i + 1] if i + 1 < len(here) else w
                out.append(HORIZONTAL + _run(a1 - max(a0, 0), black) + _run(a2 - a1, not black))
                a0 = a2
        above = here
    bits = "".join(out) + "000000000001" * 2
    bits += "0" * (-len(bits) % 8)
    return int(bits, 2).to_bytes(len(bits) // 8, "big")


def _decode_table(black: bool) -> dict[str, int]:
    table = {c: n for n, c in enumerate(BLACK if black else WHITE)}
    table |= {c: 64 * (n + 1) for n, c in enumerate(BLACK_64 if black else WHITE_64)}
    return table | {c: 64 * (n + 28) for n, c in enumerate(LONG_64)}


def g4_decode(data: bytes, w: int, h: int) -> np.ndarray:
    """The bilevel image of T.6 data; True is black."""
    bits = bin(int.from_bytes(b"\1" + data, "big"))[3:]
    tables = _decode_table(False), _decode_table(True)
    modes = {PASS: "p", HORIZONTAL: "h"} | {c: d for d, c in VERTICAL.items()}
    at = 0

    def read(table: dict):
        nonlocal at
        for n in range(1, 14):
            if (code := bits[at : at + n]) in table:
                at += n
                return table[code]
        raise ValueError("not a T.6 code")

    def run(black: bool) -> int:
        total = 0
        while True:
            n = read(tables[black])
            total += n
            if n < 64:
                return total

    out = np.zeros((h, w), bool)
    above: list[int] = []
    for y in range(h):
        here: list[int] = []
        a0, black = -1, False
        while a0 < w:
            j = next((k for k, c in enumerate(above) if c > a0 and (k % 2 == 1) == black), len(above))
            b1 = above[j] if j < len(above) else w
            b2 = above[j + 1] if j + 1 < len(above) else w
            mode = read(modes)
            if mode == "p":
                a0 = b2
            elif mode == "h":
                a1 = max(a0, 0) + run(black)
                a2 = a1 + run(not black)
                here += [a1, a2]
                a0 = a2
            else:
                a0 = b1 + mode
                here.append(a0)
                black = not black
        above = [c for c in here if c < w]
        row = np.zeros(w + 1, np.int8)
        for c in above:
            row[c] ^= 1
        out[y] = np.cumsum(row)[:w] % 2 == 1
    return out


def g4_tiff(ink: np.ndarray) -> bytes:
    """A TIFF file of one strip with T.6 data, 0 as white."""
    data = g4_encode(ink)
    h, w = ink.shape
    tags = [(256, 4, w), (257, 4, h), (258, 3, 1), (259, 3, 4), (262, 3, 0), (273, 4, 8), (277, 3, 1), (278, 4, h), (279, 4, len(data))]
    pad = b"\0" * (len(data) % 2)
    directory = struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", t, k, 1, v) for t, k, v in tags) + struct.pack("<I", 0)
    return b"II*\0" + struct.pack("<I", 8 + len(data) + len(pad)) + data + pad + directory


def tiff_strip(tiff: bytes) -> tuple[bytes, int, int, bool]:
    """The strip, width, height and whether 0 is black of a one-strip T.6 TIFF file of either byte order."""
    if tiff[:4] not in (b"II*\0", b"MM\0*"):
        raise ValueError("not a TIFF file")
    e = "<" if tiff[:1] == b"I" else ">"
    at = struct.unpack_from(e + "I", tiff, 4)[0]
    if at + 2 > len(tiff):
        raise ValueError("TIFF directory out of bounds")
    tags = {}
    for k in range(struct.unpack_from(e + "H", tiff, at)[0]):
        tag, kind, n = struct.unpack_from(e + "HHI", tiff, at + 2 + 12 * k)
        tags[tag] = (struct.unpack_from(e + ("H" if kind == 3 else "I"), tiff, at + 10 + 12 * k)[0], n)
    if tags.get(259, (0, 1))[0] != 4:
        raise ValueError("TIFF isn't T.6 compressed")
    if tags.get(273, (0, 0))[1] != 1 or 279 not in tags:
        raise ValueError("TIFF has more than one strip")
    start, n = tags[273][0], tags[279][0]
    if start + n > len(tiff):
        raise ValueError("TIFF strip out of bounds")
    return tiff[start : start + n], tags[256][0], tags[257][0], tags.get(262, (0, 1))[0] == 1


def gray4_encode(gray: np.ndarray) -> bytes:
    """Sixteen levels, two pixels a byte, each row less the row above (filter 2), zlib."""
    h, w = gray.shape
    levels = np.floor(gray / 17.0 + 0.5).astype(np.uint8)
    if w % 2:
        levels = np.concatenate([levels, np.zeros((h, 1), np.uint8)], axis=1)
    packed = (levels[:, ::2] << 4) | levels[:, 1::2]
    up = packed.copy()
    up[1:] -= packed[:-1]
    return zlib.compress(np.concatenate([np.full((h, 1), 2, np.uint8), up], axis=1).tobytes(), 9)


def gray4_decode(data: bytes, w: int, h: int) -> np.ndarray:
    rows = np.frombuffer(zlib.decompress(data), np.uint8).reshape(h, -1)
    packed = np.cumsum(rows[:, 1:], axis=0, dtype=np.uint64).astype(np.uint8)
    return np.stack([packed >> 4, packed & 15], axis=2).reshape(h, -1)[:, :w] * np.uint8(17)


# Fixed values of ITU-T T.81, annex K: luminance quantisation in natural order, and Huffman tables (codes per length, values).
QUANT = np.array("16 11 10 16 24 40 51 61 12 12 14 19 26 58 60 55 14 13 16 24 40 57 69 56 14 17 22 29 51 87 80 62 18 22 37 56 68 109 103 77 24 35 55 64 81 104 113 92 49 64 78 87 103 121 120 101 72 92 95 98 112 100 103 99".split(), int)
DC_LENGTHS, DC_VALUES = bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]), bytes(range(12))
AC_LENGTHS = bytes([0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125])
AC_VALUES = bytes.fromhex(
    "01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282090a161718191a25262728292a3435363738393a434445464748494a535455565758595a636465666768696a737475767778797a838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae1e2e3e4e5e6e7e8e9eaf1f2f3f4f5f6f7f8f9fa"
)
ZIGZAG = np.array(sorted(range(64), key=lambda k: (k // 8 + k % 8, k // 8 if (k // 8 + k % 8) % 2 else k % 8)))
_COSINES = np.array([[(np.sqrt(1 / 8) if u == 0 else 0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])
#: Tokens whose bits are spread out at once, so that memory doesn't grow by eight bytes a bit.
TOKENS = 1 << 16


def _huffman(lengths: bytes, values: bytes) -> dict[int, str]:
    out, code, k = {}, 0, 0
    for n, count in enumerate(lengths, 1):
        for _ in range(count):
            out[values[k]] = format(code, f"0{n}b")
            code, k = code + 1, k + 1
        code <<= 1
    return out


def _quant(quality: float) -> np.ndarray:
    q = max(1, min(100, round(quality * 100)))
    scale = 5000 // q if q < 50 else 200 - 2 * q
    return np.clip((QUANT * scale + 50) // 100, 1, 255)


@lru_cache(1)
def _codes() -> tuple[np.ndarray, ...]:
    """Codes and their lengths by symbol: DC, then AC."""
    out = []
    for lengths, values in ((DC_LENGTHS, DC_VALUES), (AC_LENGTHS, AC_VALUES)):
        codes, sizes = np.zeros(256, np.uint64), np.zeros(256, np.int64)
        for symbol, code in _huffman(lengths, values).items():
            codes[symbol], sizes[symbol] = int(code, 2), len(code)
        out += [codes, sizes]
    return tuple(out)


def _joined_bits(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The lowest `lengths` bits of each value, highest first, one after another (a byte a bit)."""
    out = []
    for k in range(0, len(values), TOKENS):
        n = lengths[k : k + TOKENS]
        left = np.repeat(np.cumsum(n), n) - np.arange(1, int(n.sum()) + 1)
        out.append((np.repeat(values[k : k + TOKENS], n) >> left.astype(np.uint64) & np.uint64(1)).astype(np.uint8))
    return np.concatenate(out) if out else np.zeros(0, np.uint8)


def _entropy_coded(coefficients: np.ndarray) -> bytes:
    """Huffman codes of blocks of coefficients (in zigzag order), filled up with ones. A token is a code with the zero runs before it and its bits: 59 bits at most."""
    dc, dc_n, ac, ac_n = _codes()

    def magnitude(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = np.searchsorted(1 << np.arange(16), np.abs(v), "right")
        return n, np.where(v > 0, v, v + (1 << n) - 1).astype(np.uint64)

    n, bits = magnitude(np.diff(coefficients[:, 0], prepend=0))
    block, k = np.nonzero(coefficients[:, 1:])
    first = np.concatenate([[True], block[1:] != block[:-1]])[: len(block)]
    zeros = k - np.where(first, 0, np.concatenate([[0], k[:-1] + 1])[: len(k)])
    m, ac_bits = magnitude(coefficients[block, k + 1])
    symbol = (zeros % 16) << 4 | m
    run, run_n = np.zeros(4, np.uint64), np.arange(4) * ac_n[0xF0]
    for z in range(1, 4):
        run[z] = run[z - 1] << np.uint64(ac_n[0xF0]) | ac[0xF0]
    used = np.bincount(block, minlength=len(coefficients))
    ends = coefficients[:, 63] == 0
    start = np.cumsum(1 + used + ends) - (1 + used + ends)
    values, lengths = np.zeros(int((1 + used + ends).sum()), np.uint64), np.zeros(int((1 + used + ends).sum()), np.int64)
    values[start], lengths[start] = dc[n] << n.astype(np.uint64) | bits, dc_n[n] + n
    at = start[block] + 1 + np.arange(len(block)) - (np.cumsum(used) - used)[block]
    values[at] = (run[zeros // 16] << ac_n[symbol].astype(np.uint64) | ac[symbol]) << m.astype(np.uint64) | ac_bits
    lengths[at] = run_n[zeros // 16] + ac_n[symbol] + m
    last = (start + 1 + used)[ends]
    values[last], lengths[last] = ac[0], ac_n[0]
    out = _joined_bits(values, lengths)
    return np.packbits(np.concatenate([out, np.ones(-len(out) % 8, np.uint8)])).tobytes()


def jpeg_encode(gray: np.ndarray, quality: float, dpi: int = 72) -> bytes:
    """Baseline gray JPEG."""
    h, w = gray.shape
    quant = _quant(quality)
    padded = np.pad(gray.astype(np.float64) - 128, ((0, -h % 8), (0, -w % 8)), mode="edge")
    blocks = padded.reshape(padded.shape[0] // 8, 8, -1, 8).transpose(0, 2, 1, 3).reshape(-1, 8, 8)
    coefficients = np.rint((_COSINES @ blocks @ _COSINES.T).reshape(-1, 64) / quant).astype(int)[:, ZIGZAG]
    scan = _entropy_coded(coefficients).replace(b"\xff", b"\xff\0")
    segment = lambda m, d: bytes([0xFF, m]) + struct.pack(">H", len(d) + 2) + d
    return b"".join([
        b"\xff\xd8", segment(0xE0, b"JFIF\0\1\1\1" + struct.pack(">HH", dpi, dpi) + b"\0\0"), segment(0xDB, b"\0" + bytes(quant[ZIGZAG].tolist())), segment(0xC0, struct.pack(">BHHB", 8, h, w, 1) + b"\1\x11\0"),
        segment(0xC4, b"\0" + DC_LENGTHS + DC_VALUES), segment(0xC4, b"\x10" + AC_LENGTHS + AC_VALUES), segment(0xDA, b"\1\1\0\0\x3f\0"), scan, b"\xff\xd9",
    ])


@lru_cache(16)
def _steps(lengths: bytes, values: bytes, dc: bool) -> list[int]:
    """By the next 16 bits: how many coefficients a code goes on (<< 9), bits of the code and its number (<< 4), and bits of the number; 0 where no code begins."""
    out = np.zeros(1 << 16, int)
    code = k = 0
    for n, count in enumerate(lengths, 1):
        for symbol in values[k : k + count]:
            if not code >> n and not (dc and symbol > 15):
                on = 1 if dc else 64 if symbol == 0 else (symbol >> 4) + 1
                out[code << 16 - n : (code + 1) << 16 - n] = on << 9 | n + (symbol & 15) << 4 | symbol & 15
            code += 1
        k += count
        code <<= 1
    return out.tolist()


def _decode_blocks(data: bytes, at: int, markers: np.ndarray, dc: list[int], ac: list[int], out: np.ndarray) -> int:
    """Fill out with the coefficients of its blocks from a place in the data, up to the next marker and zeros from there; the place behind them.

    Only the codes' lengths are followed one by one; places and numbers are
    worked out for all codes together.
    """
    m = int(np.searchsorted(markers, at))
    end = int(markers[m]) if m < len(markers) else max(at, len(data))
    raw = data[at:end].replace(b"\xff\0", b"\xff")
    size = len(raw)
    b = np.frombuffer(raw + bytes(512), np.uint8).astype(np.uint32)
    windows = b[:-2] << 16 | b[1:-1] << 8 | b[2:]
    window, found, starts, pos = memoryview(windows), [], [], 0
    for _ in range(len(out)):
        if pos >> 3 > size:
            pos = size * 8  # zeros from here on, wherever they are read
        starts.append(len(found))
        k, table = 0, dc
        while k < 64:
            x = table[window[pos >> 3] >> 8 - (pos & 7) & 0xFFFF]
            if not x:
                raise ValueError("broken JPEG data")
            found.append(x)
            k += x >> 9
            pos += x >> 4 & 31
            table = ac
    x, starts = np.array(found), np.array(starts)
    n, behind, k = x & 15, np.cumsum(x >> 4 & 31), np.cumsum(x >> 9)
    counts = np.diff(starts, append=len(x))
    k -= np.repeat(np.concatenate([[0], k])[starts], counts) + 1
    block, has = np.repeat(np.arange(len(out)), counts), n > 0
    n, behind, k, block = n[has], behind[has], k[has], block[has]
    if (k > 63).any():
        raise ValueError("broken JPEG data")
    low = behind - n
    v = windows[np.minimum(low >> 3, len(windows) - 1)].astype(int) >> 24 - (low & 7) - n & (1 << n) - 1
    out[block, ZIGZAG[k]] = np.where(v >> n - 1 == 1, v, v - (1 << n) + 1)
    out[:, 0] = np.cumsum(out[:, 0])
    read = -(-int(pos) // 8)
    if read >= size:
        return end
    kept = np.frombuffer(data, np.uint8, end - at, at)
    kept = np.flatnonzero(np.concatenate([[True], (kept[1:] != 0) | (kept[:-1] != 0xFF)]))
    return at + int(kept[read])


def jpeg_decode(data: bytes) -> np.ndarray:
    """The gray image of a baseline JPEG of one component."""
    at, quant, tables, size, restart = 2, {}, {}, None, 0
    while True:
        marker, n = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + n]
        at += 2 + n
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(int)
                body = body[65 + 64 * wide :]
        elif marker in (0xC0, 0xC1):
            h, w, parts = struct.unpack_from(">HHB", body, 1)
            if body[0] != 8 or parts != 1:
                raise ValueError("only gray JPEG of 8 bits can be read")
            size = h, w, body[8]
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("only baseline JPEG can be read")
        elif marker == 0xC4:
            while body:
                total = sum(body[1:17])
                tables[body[0]] = _steps(bytes(body[1:17]), bytes(body[17 : 17 + total]), body[0] >> 4 == 0)
                body = body[17 + total :]
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            break
    h, w, q = size
    dc, ac = tables[body[2] >> 4], tables[0x10 | body[2] & 15]
    bh, bw = -(-h // 8), -(-w // 8)
    out = np.zeros((bh * bw, 64), int)
    array = np.frombuffer(data, np.uint8)
    markers = np.flatnonzero((array[:-1] == 0xFF) & (array[1:] != 0))
    step = restart or max(1, bh * bw)
    for first in range(0, bh * bw, step):
        if first:
            at = data.index(b"\xff", at) + 2
        at = _decode_blocks(data, at, markers, dc, ac, out[first : first + step])
    natural = np.zeros(64, int)
    natural[ZIGZAG] = quant[q]
    blocks = _COSINES.T @ (out * natural).reshape(-1, 8, 8) @ _COSINES
    image = blocks.reshape(bh, bw, 8, 8).transpose(0, 2, 1, 3).reshape(bh * 8, bw * 8)[:h, :w]
    return np.clip(np.rint(image + 128), 0, 255).astype(np.uint8)
