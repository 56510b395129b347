"""Type detection on a BINARY column and on paths, as Catalyst expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..dims import FORMATS
from ..operators.walkers import HEIC_BRANDS, PNG_SIGNATURE

#: Extensions of audio and video files (with the last three, more than can be written).
AV_EXTENSIONS = ("wav", "mp3", "flac", "ogg", "oga", "opus", "aac", "m4a", "mp4", "mkv", "webm", "mov", "aiff", "aif", "caf")


def bytes_at(content: Column, at: int, magic: bytes) -> Column:
    """Whether the bytes from 0-based `at` on are `magic`."""
    return F.substring(content, at + 1, len(magic)) == F.lit(bytearray(magic))


def _first(cases: list[tuple[Column, Column | str]]) -> Column:
    pair = lambda c: c[1] if isinstance(c[1], Column) else F.lit(c[1])
    head, *rest = cases
    return reduce(lambda acc, c: acc.when(c[0], pair(c)), rest, F.when(head[0], pair(head)))


def container(content: Column) -> Column:
    """jpeg, png, webp, gif, heic, or null."""
    brand = F.substring(content, 9, 4)
    return _first([
        (bytes_at(content, 0, PNG_SIGNATURE), "png"),
        (bytes_at(content, 0, b"\xff\xd8"), "jpeg"),
        (bytes_at(content, 0, b"RIFF") & bytes_at(content, 8, b"WEBP"), "webp"),
        (bytes_at(content, 0, b"GIF87a") | bytes_at(content, 0, b"GIF89a"), "gif"),
        (bytes_at(content, 4, b"ftyp") & brand.isin([bytearray(b) for b in HEIC_BRANDS]), "heic"),
    ])


def extension(path: Column) -> Column:
    """Lower-case extension of the last part of a path; null without one (a leading dot begins a name)."""
    return F.nullif(F.lower(F.regexp_extract(path, r"(?:^|/)[^/]+\.([^./]+)$", 1)), F.lit(""))


def container_or_extension(content: Column, path: Column) -> Column:
    """By bytes, else by extension; null stands for an invalid signature."""
    ext = extension(path)
    by_name = _first([(ext == "png", "png"), (ext.isin("jpg", "jpeg"), "jpeg"), (ext == "webp", "webp"), (ext == "gif", "gif"), (ext.isin("heic", "heif"), "heic")])
    return F.coalesce(container(content), by_name)


def media_format(content: Column) -> Column:
    """One of the formats that can be converted, by the first bytes; null if none."""
    riff = bytes_at(content, 0, b"RIFF")
    mpeg = bytes_at(content, 0, b"\xff") & (F.substring(content, 2, 1) >= F.lit(bytearray(b"\xe0")))
    webm = F.instr(F.decode(F.substring(content, 1, 512), "ISO-8859-1"), "webm") > 0
    ebml = bytes_at(content, 0, b"\x1a\x45\xdf\xa3")
    return _first([
        (bytes_at(content, 0, b"\xff\xd8\xff"), "jpeg"),
        (bytes_at(content, 0, PNG_SIGNATURE), "png"),
        (bytes_at(content, 0, b"GIF87a") | bytes_at(content, 0, b"GIF89a"), "gif"),
        (bytes_at(content, 0, b"BM"), "bmp"),
        (bytes_at(content, 0, b"II*\0") | bytes_at(content, 0, b"MM\0*"), "tiff"),
        (riff & bytes_at(content, 8, b"WEBP"), "webp"),
        (riff & bytes_at(content, 8, b"WAVE"), "wav"),
        (riff & bytes_at(content, 8, b"AVI "), "avi"),
        (bytes_at(content, 0, b"fLaC"), "flac"),
        (bytes_at(content, 0, b"OggS"), "ogg"),
        (bytes_at(content, 0, b"ID3") | mpeg, "mp3"),
        (bytes_at(content, 4, b"ftyp") & bytes_at(content, 8, b"M4A "), "aac"),
        (bytes_at(content, 4, b"ftyp"), "mp4"),
        (F.substring(content, 5, 4).isin([bytearray(b) for b in (b"moov", b"mdat", b"wide")]), "mov"),
        (ebml & webm, "webm"),
        (ebml, "mkv"),
    ])


def format_of_extension(ext: Column) -> Column:
    return _first([(F.lower(ext) == e, f) for e, f, _, _ in FORMATS])


def media_format_or_extension(content: Column, path: Column) -> Column:
    return F.coalesce(media_format(content), format_of_extension(extension(path)))


def media_kind(media: Column) -> Column:
    kinds = {k: sorted({f for _, f, x, _ in FORMATS if x == k}) for k in ("image", "audio", "video")}
    return _first([(media.isin(f), k) for k, f in kinds.items()])


def own_extension(media: Column) -> Column:
    return _first([(media == f, e) for f, e in sorted({(f, e) for _, f, _, e in FORMATS})])


def av_container(content: Column) -> Column:
    """Audio or video container by the first bytes, as probing names it."""
    mpeg = bytes_at(content, 0, b"\xff") & (F.substring(content, 2, 1) >= F.lit(bytearray(b"\xe0")))
    return _first([
        (bytes_at(content, 0, b"RIFF") & bytes_at(content, 8, b"WAVE"), "wav"),
        (bytes_at(content, 0, b"fLaC"), "flac"),
        (bytes_at(content, 0, b"OggS"), "ogg"),
        (bytes_at(content, 0, b"ID3") | mpeg, "mp3"),
        (bytes_at(content, 4, b"ftyp"), "mp4"),
        (bytes_at(content, 0, b"\x1a\x45\xdf\xa3"), "mkv"),
        (bytes_at(content, 0, b"FORM") & bytes_at(content, 8, b"AIFF"), "aiff"),
        (bytes_at(content, 0, b"caff"), "caf"),
    ])


def is_av_extension(ext: Column) -> Column:
    return F.lower(ext).isin(*AV_EXTENSIONS)


def jpeg_marker_status(content: Column) -> Column:
    """1 if the bytes start with SOI, plus 2 if they end with EOI."""
    starts = F.coalesce(bytes_at(content, 0, b"\xff\xd8"), F.lit(False)).cast("int")
    ends = F.coalesce(F.substring(content, -2, 2) == F.lit(bytearray(b"\xff\xd9")), F.lit(False)).cast("int")
    return starts + 2 * ends
