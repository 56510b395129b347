"""Walks over container bytes: JPEG, PNG, WebP, GIF and HEIC files as lists of parts.

Plain functions of bytes, without Spark. Each returns a `Parsed`; malformed files raise `Malformed`, which
the callers turn into a column, so that one bad file never fails a job.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass, field
from typing import Any

from ..dims import GIF_EXTENSIONS, JPEG_MARKERS, UNKNOWN_MARKER

PNG_SIGNATURE = b"\x89PNG\r\n\x1a\n"
XMP_HEADER = b"http://ns.adobe.com/xap/1.0/\0"
EXIF_HEADER = b"Exif\0\0"
HEIC_BRANDS = (b"heic", b"heix", b"hevc", b"mif1", b"msf1")
MAX_DEPTH = 32


class Malformed(ValueError):
    """A file that breaks its format: an error code and what is wrong."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code, self.message = code, message


def truncated(container: str, offset: int, length: int) -> Malformed:
    return Malformed("TruncatedStructure", f"Truncated {container} structure: offset {offset} exceeds available slice length {length}")


def corrupted(container: str, part: str, detail: str) -> Malformed:
    return Malformed("CorruptedChunk", f"Corrupted {container} chunk '{part}': {detail}")


def bad_signature(expected: str) -> Malformed:
    return Malformed("InvalidSignature", f"Invalid container signature: expected {expected}")


@dataclass
class Part:
    """A segment, chunk, block or box; offset and length cover its header."""

    name: str
    offset: int
    length: int
    marker: int | None = None
    crc: int | None = None
    crc_valid: bool | None = None


@dataclass
class Parsed:
    container: str
    end: int  # where the format ends; bytes beyond are an overlay
    parts: list[Part] = field(default_factory=list)
    width: int | None = None
    height: int | None = None
    bit_depth: int | None = None
    channels: int | None = None
    comment: str | None = None
    text: list[tuple[str, str]] = field(default_factory=list)
    xmp: str | None = None
    exif: bytes | None = None
    extra: dict[str, Any] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)


def _strict(data: bytes) -> str | None:
    try:
        return data.decode()
    except UnicodeDecodeError:
        return None


def _lossy(data: bytes) -> str:
    return data.decode("utf-8", "replace")


def jpeg_markers(data: bytes, at: int = 2):
    """(marker, position of its last FF, position after it) of the markers of a JPEG stream, as long as one
    follows the other; the receiver sends where to go on."""
    n = len(data)
    while at < n and data[at] == 0xFF:
        while at < n and data[at] == 0xFF:
            at += 1
        if at == n:
            return
        at = (yield data[at], at - 1, at + 1) or at + 1


def parse_jpeg(data: bytes) -> Parsed:
    if data[:2] != b"\xff\xd8":
        raise bad_signature("JPEG SOI (FF D8)")
    out, exif = Parsed("jpeg", len(data)), None
    walk, goto = jpeg_markers(data), None
    while True:
        try:
            marker, start, at = walk.send(goto)
        except StopIteration:
            break
        goto = at
        if 0xD0 <= marker <= 0xD9:
            out.parts.append(Part(JPEG_MARKERS[marker], start, 2, marker))
            if marker == 0xD9:
                break
            continue
        if at + 2 > len(data):
            break
        size = int.from_bytes(data[at : at + 2])
        if size < 2:
            raise corrupted("JPEG", f"0xFF{marker:02X}", f"Segment length {size} is less than minimum 2 bytes")
        goto = at + size
        if goto > len(data):
            raise truncated("JPEG", goto, len(data))
        out.parts.append(Part(JPEG_MARKERS.get(marker, UNKNOWN_MARKER), start, size + 2, marker))
        body = data[at + 2 : goto]
        if 0xC0 <= marker <= 0xC3 and len(body) >= 6:
            out.bit_depth, out.height, out.width, out.channels = struct.unpack_from(">BHHB", body)
        elif marker == 0xFE:
            out.comment = _lossy(body).strip()
        elif marker == 0xE1 and body.startswith(EXIF_HEADER):
            exif = body[6:]
        elif marker == 0xE1 and body.startswith(XMP_HEADER):
            out.xmp = _lossy(body[len(XMP_HEADER) :]).strip()
        elif marker == 0xDA:
            # the scan reaches to the first end-of-image
            if (eoi := data.find(b"\xff\xd9", goto)) >= 0:
                out.parts.append(Part(JPEG_MARKERS[0xD9], eoi, 2, 0xD9))
            break
    out.exif = exif
    out.end = max((p.offset + p.length for p in out.parts), default=len(data))
    return out


def _png_text(kind: bytes, body: bytes) -> tuple[str, str] | None:
    """Keyword and text of tEXt and of uncompressed iTXt."""
    keyword, nul, rest = body.partition(b"\0")
    if not nul:
        return None
    if kind == b"tEXt":
        return _lossy(keyword), _lossy(rest)
    if len(rest) < 2 or rest[0] != 0:
        return None
    fields = rest[2:].split(b"\0", 2)  # language, translated keyword, text
    return (_lossy(keyword), _lossy(fields[2])) if len(fields) == 3 else None


def _png_background(body: bytes) -> dict[str, int] | None:
    if len(body) == 1:
        return {"palette": body[0]}
    if len(body) == 2:
        return {"gray": int.from_bytes(body)}
    if len(body) >= 6:
        return dict(zip(("red", "green", "blue"), struct.unpack_from(">HHH", body), strict=True))
    return None


def parse_png(data: bytes) -> Parsed:
    if data[:8] != PNG_SIGNATURE:
        raise bad_signature("PNG signature (89 50 4E 47 0D 0A 1A 0A)")
    out, at, view = Parsed("png", len(data)), 8, memoryview(data)
    while at + 8 <= len(data):
        start, size, kind = at, int.from_bytes(data[at : at + 4]), data[at + 4 : at + 8]
        at += 12 + size
        if at > len(data):
            raise truncated("PNG", at, len(data))
        body = data[start + 8 : at - 4]
        crc = int.from_bytes(data[at - 4 : at])
        out.parts.append(Part(_lossy(kind), start, 12 + size, None, crc, zlib.crc32(view[start + 4 : at - 4]) == crc))
        if kind == b"IHDR" and size >= 13:
            out.width, out.height, out.bit_depth, out.extra["color_type"], out.extra["compression"], out.extra["filter"], out.extra["interlace"] = struct.unpack_from(">IIBBBBB", body)
        elif kind == b"PLTE":
            out.extra["palette_entries"] = size // 3
        elif kind in (b"tEXt", b"iTXt"):
            if pair := _png_text(kind, body):
                out.text.append(pair)
        elif kind == b"pHYs" and size >= 9:
            out.extra["ppu_x"], out.extra["ppu_y"], out.extra["ppu_unit"] = struct.unpack_from(">IIB", body)
        elif kind == b"sBIT":
            out.extra["significant_bits"] = list(body)
        elif kind == b"bKGD":
            out.extra["background"] = _png_background(body)
        elif kind == b"oFFs" and size >= 9:
            out.extra["offset_x"], out.extra["offset_y"], out.extra["offset_unit"] = struct.unpack_from(">iiB", body)
        elif kind == b"sCAL" and size >= 1:
            numbers = body[1:].split(b"\0")
            out.extra["scale_unit"], out.extra["scale"] = body[0], [_lossy(x) for x in numbers[:2]]
        elif kind == b"tIME" and size >= 7:
            out.extra["modified"] = "{:04}-{:02}-{:02} {:02}:{:02}:{:02}".format(*struct.unpack_from(">HBBBBB", body))
        elif kind == b"iCCP":
            out.extra["icc_profile"] = _lossy(body.partition(b"\0")[0]) if b"\0" in body else None
        elif kind == b"eXIf":
            out.exif = body
        elif kind == b"IEND":
            break
    out.end = max((p.offset + p.length for p in out.parts), default=len(data))
    return out


def _webp_size(kind: bytes, body: bytes) -> tuple[int, int] | None:
    if kind == b"VP8X" and len(body) >= 10:
        return int.from_bytes(body[4:7], "little") + 1, int.from_bytes(body[7:10], "little") + 1
    if kind == b"VP8 " and len(body) >= 10 and body[3:6] == b"\x9d\x01\x2a":
        return int.from_bytes(body[6:8], "little") & 0x3FFF, int.from_bytes(body[8:10], "little") & 0x3FFF
    if kind == b"VP8L" and len(body) >= 5 and body[0] == 0x2F:
        bits = int.from_bytes(body[1:5], "little")
        return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
    return None


def parse_webp(data: bytes) -> Parsed:
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise bad_signature("RIFF....WEBP")
    riff = int.from_bytes(data[4:8], "little")
    out, at, limit = Parsed("webp", riff + 8), 12, min(len(data), riff + 8)
    while at + 8 <= limit:
        kind, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        body = data[at + 8 : at + 8 + size]
        if at + 8 + size > limit:
            break
        out.parts.append(Part(_lossy(kind), at, size + 8))
        if dims := _webp_size(kind, body):
            out.width, out.height = dims
        elif kind == b"EXIF":
            out.exif = body.removeprefix(EXIF_HEADER)
        elif kind == b"XMP ":
            out.xmp = x.strip() if (x := _strict(body)) is not None else out.xmp
        at += 8 + size + (size & 1)
    if out.end > len(data):
        out.warnings.append("the RIFF size exceeds the file")
    return out


def _sub_blocks(data: bytes, at: int) -> tuple[bytes, int]:
    """Payload of a chain of GIF sub-blocks (those within the file), and the place after it."""
    payload = bytearray()
    while at < len(data):
        size = data[at]
        at += 1
        if not size:
            break
        if at + size <= len(data):
            payload += data[at : at + size]
        at += size
    return bytes(payload), at


def _colour_table(packed: int) -> int:
    return 3 << (packed & 7) + 1 if packed & 0x80 else 0


def parse_gif(data: bytes) -> Parsed:
    if len(data) < 13 or data[:6] not in (b"GIF87a", b"GIF89a"):
        raise bad_signature("GIF87a or GIF89a")
    out, comments = Parsed("gif", len(data)), []
    out.width, out.height, packed = struct.unpack_from("<HHB", data, 6)
    out.extra["version"] = data[3:6].decode()
    at = 13 + _colour_table(packed)
    while at < len(data):
        start, sentinel = at, data[at]
        if sentinel == 0x3B:
            out.parts.append(Part("Trailer", start, 1))
            break
        if sentinel == 0x2C and start + 10 <= len(data):
            _, at = _sub_blocks(data, start + 10 + _colour_table(data[start + 9]) + 1)
            name = "Image Descriptor"
        elif sentinel == 0x21 and start + 2 <= len(data):
            payload, at = _sub_blocks(data, start + 2)
            label = data[start + 1]
            name = GIF_EXTENSIONS.get(label, "Extension")
            if label == 0xFE and (c := _strict(payload)) is not None:
                comments.append(c)
            elif label == 0xFF and payload.startswith(b"XMP DataXMP") and (x := _strict(payload[11:])) is not None:
                out.xmp = x.strip()
        else:
            break
        at = max(at, start + 1)
        out.parts.append(Part(name, start, at - start))
    if comments:
        out.comment = "; ".join(comments)
    out.end = max((p.offset + p.length for p in out.parts), default=len(data))
    return out


class _Boxes:
    """State of a walk over ISOBMFF boxes; the tree is listed flat, parents before children."""

    def __init__(self, data: bytes):
        self.data, self.out = data, Parsed("heic", len(data))
        self.exif_item: int | None = None
        self.extents: list[tuple[int, int]] = []

    def walk(self, at: int, end: int, depth: int) -> None:
        if depth > MAX_DEPTH:
            self.out.warnings.append(f"CyclicalBoxHierarchy: depth {depth} exceeds limit {MAX_DEPTH}")
            return
        data = self.data
        while at + 8 <= end:
            size, kind = int.from_bytes(data[at : at + 4]), data[at + 4 : at + 8]
            if size == 0:
                self.out.parts.append(Part(_lossy(kind), at, end - at))
                return
            if size == 1:
                size = int.from_bytes(data[at + 8 : at + 16]) if at + 16 <= end else 0
                if size < 16:
                    return
                self.out.parts.append(Part(_lossy(kind), at, min(size, 2**63 - 1)))
                at += size
                continue
            if size < 8 or at + size > end:
                return
            self.out.parts.append(Part(_lossy(kind), at, size))
            self.enter(kind, at + 8, at + size, depth)
            at += size

    def enter(self, kind: bytes, at: int, end: int, depth: int) -> None:
        data = self.data
        if kind == b"meta" and at + 4 <= end:
            self.walk(at + 4, end, depth + 1)
        elif kind in (b"iprp", b"ipco"):
            self.walk(at, end, depth + 1)
        elif kind == b"ispe" and at + 12 <= end and self.out.width is None:
            self.out.width, self.out.height = struct.unpack_from(">II", data, at + 4)
        elif kind == b"iinf" and at + 6 <= end:
            self.items(at + (6 if data[at] == 0 else 8), end)
        elif kind == b"iloc" and at + 8 <= end:
            self.locations(at, end)

    def items(self, at: int, end: int) -> None:
        """Finds the item of type Exif among the entries of iinf."""
        data = self.data
        while at + 8 <= end:
            size = int.from_bytes(data[at : at + 4])
            if size < 8 or at + size > end:
                return
            if data[at + 4 : at + 8] == b"infe" and size >= 20 and data[at + 16 : at + 20] == b"Exif":
                self.exif_item = int.from_bytes(data[at + 12 : at + 14])
            at += size

    def locations(self, at: int, end: int) -> None:
        """Extents of the Exif item, if iinf came before; the layout of version 0."""
        data = self.data
        offset_size, length_size, base_size = data[at + 4] >> 4, data[at + 4] & 15, data[at + 5] >> 4
        count, at = int.from_bytes(data[at + 6 : at + 8]), at + 8
        for _ in range(count):
            if at + 6 + base_size > end:
                return
            item = int.from_bytes(data[at : at + 2])
            base = int.from_bytes(data[at + 4 : at + 4 + base_size])
            extents, at = int.from_bytes(data[at + 4 + base_size : at + 6 + base_size]), at + 6 + base_size
            for _ in range(extents):
                if at + offset_size + length_size > end:
                    return
                place = base + int.from_bytes(data[at : at + offset_size])
                length = int.from_bytes(data[at + offset_size : at + offset_size + length_size])
                at += offset_size + length_size
                if item == self.exif_item:
                    self.extents.append((place, length))

    def exif(self) -> bytes | None:
        if not self.extents:
            return None
        place, length = self.extents[0]
        body = self.data[place : place + length]
        if len(body) < length or length < 4:
            return None
        skip = 4 + int.from_bytes(body[:4])
        return body[skip:] if skip < len(body) else None


def parse_heic(data: bytes) -> Parsed:
    if len(data) < 8 or data[4:8] != b"ftyp":
        raise bad_signature("ISOBMFF ftyp box")
    boxes = _Boxes(data)
    boxes.walk(0, len(data), 0)
    boxes.out.exif = boxes.exif()
    boxes.out.end = min(2**63 - 1, max((p.offset + p.length for p in boxes.out.parts), default=len(data)))
    return boxes.out


PARSERS = {"jpeg": parse_jpeg, "png": parse_png, "webp": parse_webp, "gif": parse_gif, "heic": parse_heic}


def sniff(data: bytes) -> str | None:
    """Container by its first bytes."""
    if data[:8] == PNG_SIGNATURE:
        return "png"
    if data[:2] == b"\xff\xd8":
        return "jpeg"
    if len(data) >= 12 and data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        return "webp"
    if data[:6] in (b"GIF87a", b"GIF89a"):
        return "gif"
    if len(data) >= 12 and data[4:8] == b"ftyp" and data[8:12] in HEIC_BRANDS:
        return "heic"
    return None


def parse(data: bytes, container: str | None = None) -> Parsed:
    container = container or sniff(data)
    if container not in PARSERS:
        raise bad_signature("a supported image container")
    return PARSERS[container](data)


def jpeg_comments(data: bytes) -> list[str]:
    """All comments before the scan; what is malformed ends the list."""
    out: list[str] = []
    if data[:2] != b"\xff\xd8":
        raise bad_signature("JPEG SOI (FF D8)")
    walk, goto = jpeg_markers(data), None
    while True:
        try:
            marker, _, at = walk.send(goto)
        except StopIteration:
            return out
        goto = at
        if marker in (0xD9, 0xDA):
            return out
        if 0xD0 <= marker <= 0xD8:
            continue
        size = int.from_bytes(data[at : at + 2])
        if at + 2 > len(data) or size < 2 or at + size > len(data):
            return out
        goto = at + size
        if marker == 0xFE:
            out.append(_lossy(data[at + 2 : goto]))


def png_texts(data: bytes) -> list[tuple[str, str]]:
    """tEXt pairs in order; a chunk that overruns ends the list."""
    if data[:8] != PNG_SIGNATURE:
        raise bad_signature("PNG signature")
    out, at = [], 8
    while at + 12 <= len(data):
        size, kind = int.from_bytes(data[at : at + 4]), data[at + 4 : at + 8]
        if at + 12 + size > len(data):
            break
        if kind == b"tEXt" and (pair := _png_text(kind, data[at + 8 : at + 8 + size])):
            out.append(pair)
        if kind == b"IEND":
            break
        at += 12 + size
    return out


def scan_stream(data: bytes) -> bytes:
    """Entropy-coded bytes after the first start-of-scan: stuffed FF00 as FF, restart markers left out, up
    to the next marker; a lone FF at the end stays."""
    sos = data.find(b"\xff\xda")
    if sos < 0 or sos + 4 > len(data):
        return b""
    at, out = sos + 2 + int.from_bytes(data[sos + 2 : sos + 4]), []
    while at < len(data):
        ff = data.find(b"\xff", at)
        if ff < 0:
            out.append(data[at:])
            break
        out.append(data[at:ff])
        follower = data[ff + 1 : ff + 2]
        if not follower or follower == b"\0":
            out.append(b"\xff")
        elif not b"\xd0" <= follower <= b"\xd7":
            break
        at = ff + 2
    return b"".join(out)


def marker_payloads(data: bytes) -> list[tuple[int, int, int]]:
    """(marker, start, stop) of what reads as a comment or application segment at any byte from 2 on, also
    inside other data."""
    out, at = [], data.find(b"\xff", 2)
    while 0 <= at <= len(data) - 4:
        marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4])
        if (marker == 0xFE or 0xE0 <= marker <= 0xEF) and size >= 2 and at + 2 + size <= len(data):
            out.append((marker, at + 4, at + 2 + size))
        at = data.find(b"\xff", at + 1)
    return out
