"""A writer of scanned-page PDF files, and a reader of the objects that inspection needs."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import numpy as np

from quireflow.functions import codecs, kernels
from quireflow.settings import PRODUCER


@dataclass
class PageContent:
    """One page for the writer: kind g4, gray4 or jpeg, its data, size in pixels and resolution."""

    kind: str
    data: bytes
    width: int
    height: int
    dpi: int
    words: list[tuple[str, float, float, float, float]] = field(default_factory=list)
    page_size: tuple[float, float] | None = None
    bed_origin: tuple[float, float] = (0.0, 0.0)
    black_is_1: bool = False


def escape(text: str) -> str:
    out = []
    for c in text:
        out.append("\\" + c if c in "()\\" else c if 32 <= ord(c) < 128 else " ")
    return "".join(out)


def _stream(head: str, data: bytes) -> bytes:
    return f"<<{head}/Length {len(data)}>>\nstream\n".encode() + data + b"\nendstream"


def _image(p: PageContent) -> bytes:
    head = f"/Type/XObject/Subtype/Image/Width {p.width}/Height {p.height}/ColorSpace/DeviceGray"
    if p.kind == "g4":
        head += f"/BitsPerComponent 1/Filter/CCITTFaxDecode/DecodeParms<</K -1/Columns {p.width}/Rows {p.height}/BlackIs1 {'true' if p.black_is_1 else 'false'}>>"
    elif p.kind == "gray4":
        head += f"/BitsPerComponent 4/Filter/FlateDecode/DecodeParms<</Predictor 15/Colors 1/BitsPerComponent 4/Columns {p.width}>>"
    else:
        head += "/BitsPerComponent 8/Filter/DCTDecode"
    return _stream(head, p.data)


def build(pages: list[PageContent], producer: str = PRODUCER) -> bytes:
    """A PDF file: catalog, page tree, font, then image, content and page of each page, and Info last."""
    objects: list[bytes] = [b"", b"", b"<</Type/Font/Subtype/Type1/BaseFont/Helvetica>>"]
    kids = []
    for p in pages:
        pt_w, pt_h = p.width / p.dpi * 72, p.height / p.dpi * 72
        box_w, box_h = (max(a, b) for a, b in zip(p.page_size or (pt_w, pt_h), (pt_w, pt_h), strict=True))
        ox, oy = min(p.bed_origin[0], box_w - pt_w), box_h - pt_h - min(p.bed_origin[1], box_h - pt_h)
        objects.append(_image(p))
        image = len(objects)
        lines = [f"q {pt_w:.2f} 0 0 {pt_h:.2f} {ox:.2f} {oy:.2f} cm /Im0 Do Q"]
        if p.words:
            lines.append("BT 3 Tr")
            for text, x, y, w, h in p.words:
                if not (shown := escape(text)):
                    continue
                size = max(4.0, h * pt_h)
                nominal = len(shown) * size * 0.5
                tz = min(500.0, max(20.0, w * pt_w / nominal * 100 if nominal > 0 else 100.0))
                lines.append(f"/F1 {size:.2f} Tf {tz:.2f} Tz 1 0 0 1 {ox + x * pt_w:.2f} {oy + y * pt_h:.2f} Tm ({shown}) Tj")
            lines.append("ET")
        objects.append(_stream("", "\n".join(lines).encode("latin-1")))
        font = "/Font<</F1 3 0 R>>" if p.words else ""
        objects.append(f"<</Type/Page/Parent 2 0 R/MediaBox[0 0 {box_w:.2f} {box_h:.2f}]/Resources<</XObject<</Im0 {image} 0 R>>{font}>>/Contents {image + 1} 0 R>>".encode())
        kids.append(len(objects))
    objects[0] = b"<</Type/Catalog/Pages 2 0 R>>"
    objects[1] = f"<</Type/Pages/Kids[{' '.join(f'{k} 0 R' for k in kids)}]/Count {len(kids)}>>".encode()
    objects.append(f"<</Producer ({escape(producer)})>>".encode())
    out, offsets = bytearray(b"%PDF-1.4\n%\xe2\xe3\xcf\xd3\n"), []
    for n, body in enumerate(objects, 1):
        offsets.append(len(out))
        out += f"{n} 0 obj\n".encode() + body + b"\nendobj\n"
    start = len(out)
    out += f"xref\n0 {len(objects) + 1}\n0000000000 65535 f \n".encode() + b"".join(b"%010d 00000 n \n" % o for o in offsets)
    out += f"trailer\n<</Size {len(objects) + 1}/Root 1 0 R/Info {len(objects)} 0 R>>\nstartxref\n{start}\n%%EOF".encode()
    return bytes(out)


class Name(str):
    """A PDF name, without its slash."""


class Ref(int):
    """A reference to an object."""


_SPACE, _DELIMITERS = b"\0\t\n\x0c\r ", b"()<>[]{}/%"


class PdfError(ValueError):
    """A file that can't be read."""


class Pdf:
    """Objects of a PDF file, found by scanning for their headers (so that broken cross-reference tables don't matter), and in object streams."""

    def __init__(self, data: bytes):
        if b"%PDF-" not in data[:1024]:
            raise PdfError("Cannot open PDF")
        self.data = data
        self.at = {int(m[1]): m.end() for m in re.finditer(rb"(?<![0-9])(\d+)\s+\d+\s+obj\b", data)}
        self.known: dict[int, object] = {}
        self.trailer: dict = {}
        for m in re.finditer(rb"trailer\s*(?=<<)", data):
            self.trailer |= self._value(m.end())[0]
        for n in list(self.at):
            value = self.get(Ref(n))
            if isinstance(value, tuple) and value[0].get("Type") == "XRef":
                self.trailer = {**value[0], **self.trailer}
            elif isinstance(value, tuple) and value[0].get("Type") == "ObjStm":
                self._unpack(*value)
        self.locked = "Encrypt" in self.trailer

    def _unpack(self, head: dict, raw: bytes) -> None:
        body = self.decoded(head, raw)
        numbers = [int(x) for x in body[: self.get(head["First"])].split()]
        for n, offset in zip(numbers[::2], numbers[1::2], strict=True):
            if n not in self.at:
                self.known[n] = _Parser(body, self).value(self.get(head["First"]) + offset)[0]

    def _value(self, at: int):
        return _Parser(self.data, self).value(at)

    def get(self, value):
        """The value that a reference stands for; streams are (dictionary, raw bytes)."""
        for _ in range(32):
            if not isinstance(value, Ref):
                return value
            n = int(value)
            if n not in self.known:
                if n not in self.at:
                    return None
                self.known[n] = None
                found, end = self._value(self.at[n])
                m = re.compile(rb"\s*stream\r?\n?").match(self.data, end)
                if isinstance(found, dict) and m:
                    length = self.get(found.get("Length"))
                    stop = m.end() + length if isinstance(length, int) and self.data[m.end() + length :].lstrip()[:9] == b"endstream" else self.data.find(b"endstream", m.end())
                    found = (found, self.data[m.end() : stop])
                self.known[n] = found
            value = self.known[n]
        return None

    def dictionary(self, value) -> dict:
        found = self.get(value)
        return found[0] if isinstance(found, tuple) else found if isinstance(found, dict) else {}

    def filters(self, head: dict) -> list[str]:
        """Names of a stream's filters: one, several or none."""
        found = self.get(head.get("Filter"))
        if isinstance(found, Name):
            return [str(found)]
        return [str(x) for x in map(self.get, found) if isinstance(x, Name)] if isinstance(found, list) else []

    def pages(self) -> list[dict]:
        """Page dictionaries in order, with inherited entries; a page that can't be read has only those."""
        out: list[dict] = []
        root = self.dictionary(self.trailer.get("Root"))
        work, seen = [(root.get("Pages"), {})], set()
        while work:
            node, inherited = work.pop()
            if isinstance(node, Ref):
                if int(node) in seen:
                    continue
                seen.add(int(node))
            here = self.dictionary(node)
            passed = {**inherited, **{k: here[k] for k in ("Resources", "MediaBox", "Rotate") if k in here}}
            kids = self.get(here.get("Kids"))
            if isinstance(kids, list):
                work += [(k, passed) for k in reversed(kids)]
            elif here or node is not root.get("Pages"):
                out.append({**passed, **here})
        return out

    def producer(self) -> str | None:
        found = self.get(self.dictionary(self.trailer.get("Info")).get("Producer"))
        if not isinstance(found, bytes):
            return None
        return found[2:].decode("utf-16-be", "replace") if found[:2] == b"\xfe\xff" else found.decode("latin-1")

    def images(self, page: dict) -> list[dict]:
        """w, h, bpc, filters and the stream of a page's images; in forms to a depth of two."""
        out: list[dict] = []

        def visit(resources, depth: int) -> None:
            for value in self.dictionary(self.dictionary(resources).get("XObject")).values():
                stream = self.get(value)
                if not isinstance(stream, tuple):
                    continue
                head = stream[0]
                kind = self.get(head.get("Subtype"))
                number = lambda k: n if isinstance(n := self.get(head.get(k)), int) else 0  # noqa: B023, E731
                if kind == "Image":
                    out.append({"w": number("Width"), "h": number("Height"), "bpc": number("BitsPerComponent"), "filters": self.filters(head), "stream": stream})
                elif kind == "Form" and depth < 2 and "Resources" in head:
                    visit(head["Resources"], depth + 1)

        visit(page.get("Resources"), 0)
        return out

    def media_box(self, page: dict) -> tuple[float, float, int]:
        """Width, height and rotation; A4 where the box can't be read."""
        box = self.get(page.get("MediaBox"))
        numbers = [float(x) for x in map(self.get, box)] if isinstance(box, list) and len(box) == 4 else [0.0, 0.0, 595.0, 842.0]
        rotation = self.get(page.get("Rotate"))
        return abs(numbers[2] - numbers[0]), abs(numbers[3] - numbers[1]), rotation if isinstance(rotation, int) else 0


class _Parser:
    """Values of PDF syntax at a place in a buffer."""

    def __init__(self, data: bytes, pdf: Pdf):
        self.d, self.pdf = data, pdf

    def skip(self, at: int) -> int:
        while at < len(self.d):
            if self.d[at] in _SPACE:
                at += 1
            elif self.d[at] == 0x25:
                while at < len(self.d) and self.d[at] not in b"\r\n":
                    at += 1
            else:
                return at
        return at

    def value(self, at: int):
        at = self.skip(at)
        d = self.d
        if d[at : at + 2] == b"<<":
            out, at = {}, self.skip(at + 2)
            while at < len(d) and d[at : at + 2] != b">>":
                key, at = self.value(at)
                found, at = self.value(at)
                if isinstance(key, Name):
                    out[str(key)] = found
                at = self.skip(at)
            return out, at + 2
        c = d[at : at + 1]
        if c == b"[":
            items, at = [], self.skip(at + 1)
            while at < len(d) and d[at : at + 1] != b"]":
                found, at = self.value(at)
                items.append(found)
                at = self.skip(at)
            return items, at + 1
        if c == b"/":
            end = at + 1
            while end < len(d) and d[end] not in _SPACE and d[end] not in _DELIMITERS:
                end += 1
            return Name(re.sub(r"#([0-9A-Fa-f]{2})", lambda m: chr(int(m[1], 16)), d[at + 1 : end].decode("latin-1"))), end
        if c == b"(":
            return self.string(at + 1)
        if c == b"<":
            end = d.index(b">", at)
            text = re.sub(rb"\s", b"", d[at + 1 : end])
            return bytes.fromhex((text + b"0" * (len(text) % 2)).decode("latin-1")), end + 1
        if m := re.compile(rb"(\d+)\s+(\d+)\s+R(?![A-Za-z])").match(d, at):
            return Ref(int(m[1])), m.end()
        if m := re.compile(rb"[+-]?(?:\d+\.?\d*|\.\d+)").match(d, at):
            return (float(m[0]) if b"." in m[0] else int(m[0])), m.end()
        if m := re.compile(rb"true|false|null").match(d, at):
            return {b"true": True, b"false": False, b"null": None}[m[0]], m.end()
        return None, at + 1

    def string(self, at: int) -> tuple[bytes, int]:
        out, depth = bytearray(), 1
        while at < len(self.d):
            c = self.d[at]
            if c == 0x5C:
                following = self.d[at + 1 : at + 2]
                if m := re.compile(rb"[0-7]{1,3}").match(self.d, at + 1):
                    out.append(int(m[0], 8) & 255)
                    at = m.end()
                    continue
                out += {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"\n": b""}.get(following, following)
                at += 2
                continue
            depth += (c == 0x28) - (c == 0x29)
            if not depth:
                return bytes(out), at + 1
            out.append(c)
            at += 1
        return bytes(out), at


def _unpredict(raw: bytes, row_bits: int, pixel_bytes: int = 1) -> bytes:
    """Undo PNG row filters: none, sub, up, average, Paeth."""
    n = -(-row_bits // 8)
    rows = np.frombuffer(raw[: len(raw) // (n + 1) * (n + 1)], np.uint8).reshape(-1, n + 1)
    out = np.zeros((len(rows), n), np.uint8)
    above = np.zeros(n, np.uint8)
    for y, row in enumerate(rows):
        kind, given = int(row[0]), row[1:]
        if kind == 0:
            above = given.copy()
        elif kind == 1:
            padded = np.concatenate([given, np.zeros(-n % pixel_bytes, np.uint8)]).reshape(-1, pixel_bytes)
            above = np.cumsum(padded, axis=0, dtype=np.uint64).astype(np.uint8).ravel()[:n]
        elif kind == 2:
            above = given + above
        elif kind in (3, 4):
            above = np.array(_along(given.tolist(), above.tolist(), pixel_bytes, kind), np.uint8)
        else:
            raise PdfError(f"row filter {kind} can't be read")
        out[y] = above
    return out.tobytes()


def _along(given: list[int], above: list[int], pixel_bytes: int, kind: int) -> list[int]:
    """A row of filter 3 (average) or 4 (Paeth), each byte of which needs the one before."""
    out: list[int] = []
    for k, x in enumerate(given):
        left, up, corner = (out[k - pixel_bytes], above[k], above[k - pixel_bytes]) if k >= pixel_bytes else (0, above[k], 0)
        if kind == 3:
            guess = (left + up) // 2
        else:
            _, _, guess = min((abs(up - corner), 0, left), (abs(left - corner), 1, up), (abs(left + up - 2 * corner), 2, corner))
        out.append((x + guess) & 255)
    return out


def page_image(pdf: Pdf, page: dict) -> dict | None:
    """A page's largest image, apart from its file: w, h, bpc, filters, parms, decode and the raw stream; None without one."""
    images = [i for i in pdf.images(page) if i["w"] * i["h"] > 0]
    if not images:
        return None
    best = max(images, key=lambda i: i["w"] * i["h"])
    head, raw = best["stream"]
    parms = pdf.get(head.get("DecodeParms"))
    parms = parms if isinstance(parms, list) else [parms]
    plain = [{k: v for k, x in pdf.dictionary(p).items() if isinstance(v := pdf.get(x), int | float)} for p in parms]
    decode = pdf.get(head.get("Decode"))
    decode = [x for x in map(pdf.get, decode) if isinstance(x, int | float)] if isinstance(decode, list) else []
    return {k: best[k] for k in ("w", "h", "bpc", "filters")} | {"parms": plain, "decode": decode, "raw": raw}


def decode_image(image: dict) -> np.ndarray:
    """The gray pixels of an image of one component, or of three of 8 bits."""
    raw, w, h, bits, filters = image["raw"], image["w"], image["h"], image["bpc"] or 8, list(image["filters"])
    parms = image["parms"] + [{}] * (len(filters) + 1)
    while filters and filters[0] in ("FlateDecode", "Fl"):
        raw, own, parms = zlib.decompressobj().decompress(raw), parms[0], parms[1:]
        colors, depth = own.get("Colors") or 1, own.get("BitsPerComponent") or 8
        if (own.get("Predictor") or 1) >= 10:
            raw = _unpredict(raw, (own.get("Columns") or 1) * colors * depth, max(1, colors * depth // 8))
        filters = filters[1:]
    if filters and filters[0] in ("DCTDecode", "DCT"):
        gray = codecs.jpeg_decode(raw)
    elif filters and filters[0] in ("CCITTFaxDecode", "CCF"):
        if (parms[0].get("K") or 0) >= 0:
            raise PdfError("images of CCITT Group 3 can't be read")
        ink = codecs.g4_decode(raw, w, h)
        gray = np.where(ink == bool(parms[0].get("BlackIs1")), 255, 0).astype(np.uint8)
    elif filters:
        raise PdfError(f"images with {image['filters']} can't be read")
    else:
        data = np.frombuffer(raw, np.uint8)
        if bits == 8:
            channels = max(1, len(data) // (w * h))
            gray = data[: w * h * channels].reshape(h, w, channels).mean(axis=2).round().astype(np.uint8)
        elif bits == 4:
            rows = data.reshape(h, -1)
            gray = np.stack([rows >> 4, rows & 15], axis=2).reshape(h, -1)[:, :w] * np.uint8(17)
        elif bits == 1:
            gray = np.unpackbits(data.reshape(h, -1), axis=1)[:, :w] * np.uint8(255)
        else:
            raise PdfError(f"images of {bits} bits can't be read")
    return 255 - gray if image["decode"][:2] == [1, 0] else gray


def page_pixels(image: dict | None) -> np.ndarray:
    """The gray pixels of the one image that covers a page. Other pages can't be drawn."""
    if image is None:
        raise PdfError("page has no image to draw")
    return decode_image(image)


def render_pixels(gray: np.ndarray, box: tuple[float, float, int], dpi: int) -> np.ndarray:
    """Pixels that cover a page (width, height, rotation), at a resolution."""
    width, height, rotation = box
    gray = np.rot90(gray, -(rotation // 90) % 4)
    if rotation % 180:
        width, height = height, width
    return kernels.resample(gray, max(1, int(height * dpi / 72 + 0.5)), max(1, int(width * dpi / 72 + 0.5)))


def render_image(image: dict | None, box: tuple[float, float, int], dpi: int) -> np.ndarray:
    """A page (width, height, rotation) that one image covers, as gray pixels at a resolution."""
    return render_pixels(page_pixels(image), box, dpi)
