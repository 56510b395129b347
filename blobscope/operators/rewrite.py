"""Lossless rewrites of container bytes: overlays cut, metadata scrubbed, comments edited."""

from __future__ import annotations

import zlib

from .walkers import PNG_SIGNATURE, Malformed, bad_signature, corrupted, jpeg_markers, sniff, truncated

#: Segments that a scrub removes: EXIF and XMP, ICC profile, IPTC, comment.
SCRUBBED_MARKERS = frozenset((0xE1, 0xE2, 0xED, 0xFE))
STRICT_MARKERS = frozenset((*range(0xE1, 0xF0), 0xFE))
SCRUBBED_CHUNKS = frozenset((b"tEXt", b"zTXt", b"iTXt", b"eXIf", b"tIME"))
MAX_COMMENT, MAX_KEYWORD = 65533, 79


def png_chunks(data: bytes):
    """(kind, start, stop) of the chunks of a PNG, up to one that doesn't fit."""
    at = 8
    while at + 12 <= len(data):
        stop = at + 12 + int.from_bytes(data[at : at + 4])
        yield data[at + 4 : at + 8], at, stop
        if stop > len(data):
            return
        at = stop


def cut_overlay(data: bytes) -> bytes:
    """A JPEG up to its last end-of-image, a PNG up to its IEND; other bytes as they are."""
    kind = sniff(data)
    if kind == "jpeg":
        last = data.rfind(b"\xff\xd9")
        return data[: last + 2] if last >= 0 else data
    if kind == "png":
        for name, _, stop in png_chunks(data):
            if name == b"IEND":
                return data[: min(stop, len(data))]
            if stop > len(data):
                break
    return data


def scrub(data: bytes, strict: bool = False) -> bytes:
    """Without overlay and metadata (JPEG, PNG); other containers as they are. `strict` removes all
    application segments but APP0."""
    kind = sniff(data)
    if kind not in ("jpeg", "png"):
        return data
    data = cut_overlay(data)
    if kind == "png":
        out = [PNG_SIGNATURE]
        for name, start, stop in png_chunks(data):
            if stop > len(data):
                raise truncated("PNG", stop, len(data))
            if name not in SCRUBBED_CHUNKS:
                out.append(data[start:stop])
            if name == b"IEND":
                break
        return b"".join(out)
    drop, out, walk, goto = STRICT_MARKERS if strict else SCRUBBED_MARKERS, [b"\xff\xd8"], jpeg_markers(data), None
    while True:
        try:
            marker, start, at = walk.send(goto)
        except StopIteration:
            if goto is not None and goto < len(data):
                out.append(data[goto:])
            return b"".join(out)
        goto = at
        if 0xD0 <= marker <= 0xD9:
            out.append(data[start:at])
            if marker == 0xD9:
                return b"".join(out)
            continue
        size = int.from_bytes(data[at : at + 2])
        if at + 2 > len(data) or size < 2 or at + size > len(data):
            raise corrupted("JPEG", f"0xFF{marker:02X}", f"Invalid segment length {size}")
        goto = at + size
        if marker == 0xDA:
            out.append(data[start:])
            return b"".join(out)
        if marker not in drop:
            out.append(data[start:goto])


def set_jpeg_comment(data: bytes, comment: str) -> bytes:
    """Replace all comments before the scan by one, or by none if `comment` is empty. It stands after APP0
    where the file begins with one, else before the scan or the end; an overlay stays."""
    if len(data) < 4 or data[:2] != b"\xff\xd8":
        raise bad_signature("0xFFD8 (JPEG SOI)")
    text = comment.encode()
    if len(text) > MAX_COMMENT:
        raise Malformed("SegmentOverflow", f"Segment overflow: payload size {len(text)} bytes exceeds maximum 16-bit segment capacity of 65,533 bytes")
    pending = [b"\xff\xfe" + (len(text) + 2).to_bytes(2) + text] if text else []
    after_app0 = data[2:4] == b"\xff\xe0"
    out, walk, goto = [b"\xff\xd8"], jpeg_markers(data), None
    while True:
        try:
            marker, start, at = walk.send(goto)
        except StopIteration:
            rest = data[goto if goto is not None else 2 :]
            body = b"".join(out) + rest
            if pending and body.endswith(b"\xff\xd9"):
                body = body[:-2] + pending.pop() + b"\xff\xd9"
            return body
        goto = at
        if marker == 0xD8:
            continue
        if 0xD0 <= marker <= 0xD7:
            out.append(data[start:at])
            continue
        if marker == 0xD9:
            return b"".join([*out, *pending, data[start:]])
        if at + 2 > len(data):
            raise truncated("JPEG", at, len(data))
        size = int.from_bytes(data[at : at + 2])
        if size < 2 or at + size > len(data):
            raise corrupted("JPEG", f"0xFF{marker:02X}", f"Invalid segment length {size}")
        goto = at + size
        if marker == 0xFE:
            continue
        if marker == 0xDA and pending:
            out.append(pending.pop())
        out.append(data[start:goto])
        if marker == 0xE0 and after_app0 and pending:
            out.append(pending.pop())


def text_chunk(keyword: bytes, text: bytes) -> bytes:
    body = b"tEXt" + keyword + b"\0" + text
    return (len(body) - 4).to_bytes(4) + body + zlib.crc32(body).to_bytes(4)


def set_png_text(data: bytes, keyword: str, text: str) -> bytes:
    """Replace the tEXt chunks of a keyword by one before IEND, or by none if `text` is empty."""
    if data[:8] != PNG_SIGNATURE:
        raise bad_signature("PNG Header (89 50 4E 47 ...)")
    key = keyword.encode()
    if not 1 <= len(key) <= MAX_KEYWORD:
        raise corrupted("PNG", "tEXt", "Keyword must be between 1 and 79 characters")
    new = [text_chunk(key, text.encode())] if text else []
    out = [PNG_SIGNATURE]
    for name, start, stop in png_chunks(data):
        if stop > len(data):
            raise truncated("PNG", start, len(data))
        if name == b"tEXt" and data[start + 8 : stop - 4].partition(b"\0")[::2][0] == key and b"\0" in data[start + 8 : stop - 4]:
            continue
        if name == b"IEND":
            return b"".join([*out, *new, data[start:]])
        out.append(data[start:stop])
    return b"".join([*out, *new])
