"""Container bytes made from column values, as Catalyst expressions: what a table of files would hold."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.walkers import PNG_SIGNATURE


def raw(data: bytes) -> Column:
    return F.lit(bytearray(data))


def utf8(text: Column) -> Column:
    return F.encode(text, "UTF-8")


def be(value: Column, width: int) -> Column:
    """An unsigned number of so many bytes, big end first."""
    return F.unhex(F.lpad(F.hex(value.cast("long")), 2 * width, "0"))


def le(value: Column, width: int) -> Column:
    b = be(value, width)
    return F.concat(*(F.substring(b, i, 1) for i in range(width, 0, -1)))


def jpeg_segment(marker: int, body: Column) -> Column:
    return F.concat(raw(bytes([0xFF, marker])), be(F.octet_length(body) + 2, 2), body)


def jpeg_comment(text: Column) -> Column:
    """One comment segment, or as many as it takes where 65,533 bytes don't hold the text; none cuts a character."""
    step = F.when(F.octet_length(text) <= 65533, 65533).otherwise(16383)
    at = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), step)
    return F.aggregate(at, raw(b""), lambda made, i: F.concat(made, jpeg_segment(0xFE, utf8(F.substring(text, i + 1, step)))))


def jpeg(*segments: Column, scan: Column | None = None, overlay: Column | None = None) -> Column:
    """SOI, segments, a scan and EOI, and what follows."""
    parts = [raw(b"\xff\xd8"), *segments, raw(b"\xff\xda\x00\x04\x01\x00") if scan is not None else raw(b""), scan if scan is not None else raw(b""), raw(b"\xff\xd9")]
    return F.concat(*parts, *([] if overlay is None else [overlay]))


def app0() -> Column:
    return raw(b"\xff\xe0\x00\x10JFIF\0\x01\x01\0\0\x01\0\x01\0\0")


def sof0(width: Column, height: Column) -> Column:
    return jpeg_segment(0xC0, F.concat(raw(b"\x08"), be(height, 2), be(width, 2), raw(b"\x03"), raw(b"\0" * 9)))


def png_chunk(kind: bytes, body: Column, broken: Column | None = None) -> Column:
    """A chunk with its checksum, off by one where `broken` is true."""
    named = F.concat(raw(kind), body)
    crc = F.crc32(named)
    if broken is not None:
        crc = F.when(broken, crc.bitwiseXOR(F.lit(1))).otherwise(crc)
    return F.concat(be(F.octet_length(body), 4), named, be(crc, 4))


def ihdr(width: Column, height: Column) -> Column:
    return F.concat(be(width, 4), be(height, 4), raw(b"\x08\x02\0\0\0"))


def png(*chunks: Column) -> Column:
    return F.concat(raw(PNG_SIGNATURE), *chunks, png_chunk(b"IEND", raw(b"")))


def gif(width: Column, height: Column, *blocks: Column) -> Column:
    return F.concat(raw(b"GIF89a"), le(width, 2), le(height, 2), raw(b"\0\0\0"), *blocks, raw(b";"))


def gif_comment(body: Column) -> Column:
    return gif_extension(0xFE, body)


def gif_extension(label: int, body: Column) -> Column:
    """An extension in as many sub-blocks of at most 255 bytes as it takes."""
    n, digits = F.octet_length(body), F.hex(body)
    full = F.floor(n / 255).cast("int") * 255
    rest = F.when(n > full, F.concat(be(n - full, 1), F.unhex(F.substring(digits, 2 * full + 1, F.lit(510))))).otherwise(raw(b""))
    blocks = F.unhex(F.regexp_replace(F.substring(digits, F.lit(1), 2 * full), "(.{510})", "FF$1"))
    return F.concat(raw(bytes([0x21, label])), blocks, rest, raw(b"\0"))


def webp(*chunks: Column) -> Column:
    body = F.concat(raw(b"WEBP"), *chunks)
    return F.concat(raw(b"RIFF"), le(F.octet_length(body), 4), body)


def webp_chunk(kind: bytes, body: Column) -> Column:
    """A RIFF chunk, padded to an even length."""
    n = F.octet_length(body)
    return F.concat(raw(kind), le(n, 4), body, F.when(n % 2 == 1, raw(b"\0")).otherwise(raw(b"")))


def box(kind: bytes, *bodies: Column) -> Column:
    body = F.concat(*bodies) if bodies else raw(b"")
    return F.concat(be(F.octet_length(body) + 8, 4), raw(kind), body)


def heic(width: Column, height: Column) -> Column:
    ispe = box(b"ispe", raw(b"\0\0\0\0"), be(width, 4), be(height, 4))
    return F.concat(box(b"ftyp", raw(b"heic\0\0\0\0mif1heic")), box(b"meta", raw(b"\0\0\0\0"), box(b"iprp", box(b"ipco", ispe))))


def tiff_entry(tag: int, kind: int, count: Column | int, value: Column) -> Column:
    """A directory entry; value: four bytes."""
    return F.concat(le(F.lit(tag), 2), le(F.lit(kind), 2), le(F.lit(count) if isinstance(count, int) else count, 4), value)
