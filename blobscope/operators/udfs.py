"""Arrow functions over BINARY columns. Each reads the bytes once and returns a struct with an `error`
(code and message) instead of failing."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import cache
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..dims import OVERLAY_CATEGORY, OVERLAY_NAME, PE_NAME, SIGNATURES
from . import codecs, exif, rewrite, tools, walkers

ERROR = "error struct<code: string, message: string>"
_GPS = "latitude: double, longitude: double, altitude: float, speed: double, speed_ref: string, track: double, track_ref: string, img_direction: double, img_direction_ref: string, date_stamp: string, time_stamp: string"
_EXIF = f"camera_make: string, camera_model: string, software: string, lens_make: string, lens_model: string, body_serial_number: string, lens_serial_number: string, date_time_original: string, user_comment: string, f_number: float, iso: int, exposure_time: string, focal_length_mm: float, focal_length_35mm: int, orientation: int, width: bigint, height: bigint, flash: int, exposure_program: int, metering_mode: int, white_balance: int, light_source: int, gps: struct<{_GPS}>"
PART = "name: string, offset: bigint, length: bigint, marker: int, crc: bigint, crc_valid: boolean"
PARSED = f"struct<container: string, end: bigint, parts: array<struct<{PART}>>, width: bigint, height: bigint, bit_depth: int, channels: int, comment: string, text: array<struct<key: string, value: string>>, xmp: string, exif: struct<{_EXIF}>, extra: string, warnings: array<string>, error: struct<code: string, message: string>>"
TAG = "array<struct<ifd: string, tag: int, type: int, count: int, nums: array<double>, text: string>>"
PAYLOAD = "name: string, offset: bigint, length: bigint, category: string, preview: string"
AUDIT = f"struct<hist: array<bigint>, scan_hist: array<bigint>, payloads: array<struct<{PAYLOAD}>>, segments: array<struct<marker: int, size: bigint, non_printable: double>>>"
BYTES = "struct<content: binary, error: struct<code: string, message: string>>"
AUDIO = "struct<samples: array<float>, sample_rate: int, channels: int, bits: int, error: struct<code: string, message: string>>"
PROBE = "struct<media_type: string, format: string, width: bigint, height: bigint, sample_rate: int, channels: int, bits_per_sample: int, codec: string, duration_secs: double, audio_tracks: int, video_tracks: int, error: struct<code: string, message: string>>"


@cache
def _arrow(ddl: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_type(_parse_datatype_string(ddl))


def struct_udf(ddl: str, f: Callable[..., dict[str, Any]], columns: int = 1) -> Callable[..., Column]:
    """An Arrow function of one row at a time; a null first argument gives null."""
    # the type is made on the driver: executors need no session for it
    box: dict[str, pa.DataType] = {}

    def rows(*arrays: pa.Array) -> pa.Array:
        out = []
        for values in zip(*arrays, strict=True):
            args = [v.as_py() for v in values]
            if args[0] is None:
                out.append(None)
                continue
            try:
                out.append(f(*args))
            except walkers.Malformed as e:
                out.append({"error": {"code": e.code, "message": e.message}})
            except (ArithmeticError, LookupError, ValueError, TypeError, MemoryError) as e:
                out.append({"error": {"code": "ConversionError", "message": f"Conversion error: {type(e).__name__}"}})
        return pa.array(out, box["type"])

    one = lambda a: rows(a)
    two = lambda a, b: rows(a, b)
    three = lambda a, b, c: rows(a, b, c)
    run = (one, two, three)[columns - 1]
    run.__annotations__ = {x: pa.Array for x in (*"abc"[:columns], "return")}

    def call(*args: Column) -> Column:
        if "type" not in box:
            box["type"] = _arrow(ddl)
        return F.arrow_udf(run, ddl)(*args)

    return call


def _parse(content: bytes, container: str | None) -> dict[str, Any]:
    p = walkers.parse(content, container)
    record = exif.wide(tags) if (tags := exif.read(p.exif)) else None
    parts = [{"name": x.name, "offset": x.offset, "length": x.length, "marker": x.marker, "crc": x.crc, "crc_valid": x.crc_valid} for x in p.parts]
    return {"container": p.container, "end": p.end, "parts": parts, "width": p.width, "height": p.height, "bit_depth": p.bit_depth, "channels": p.channels, "comment": p.comment, "text": [{"key": k, "value": v} for k, v in p.text], "xmp": p.xmp, "exif": record, "extra": json.dumps(p.extra), "warnings": p.warnings}


#: parse(content, container): the walk of a container, null to sniff it.
parse = struct_udf(PARSED, _parse, 2)


def signature_hits(content: bytes, end: int) -> list[dict[str, Any]]:
    """Overlay first, then hits of each signature from byte 12 on, also overlapping ones."""
    hits = []

    def add(name: str, category: str, at: int, length: int) -> None:
        head = content[at : at + 16]
        shown = "".join(chr(b) if 32 <= b <= 126 else "." for b in head)
        hits.append({"name": name, "offset": at, "length": length, "category": category, "preview": f"{head.hex(' ').upper()} | {shown}" if head else ""})

    if len(content) > end:
        add(OVERLAY_NAME, OVERLAY_CATEGORY, end, len(content) - end)
    for magic, name, category in SIGNATURES:
        at = content.find(magic, 12)
        while at >= 0:
            if name != PE_NAME or _is_pe(content, at):
                add(name, category, at, 0)
            at = content.find(magic, at + 1)
    return hits


def _is_pe(content: bytes, at: int) -> bool:
    """The pointer at 0x3C of an executable leads to its PE header."""
    pointer = content[at + 0x3C : at + 0x40]
    place = at + int.from_bytes(pointer, "little")
    return len(pointer) == 4 and content[place : place + 4] == b"PE\0\0"


def _audit(content: bytes, end: int | None, container: str | None) -> dict[str, Any]:
    data = np.frombuffer(content, np.uint8)
    scan, segments = None, []
    if container == "jpeg":
        scan = np.bincount(np.frombuffer(walkers.scan_stream(content), np.uint8), minlength=256)
        good = np.zeros(256, bool)
        good[32:127] = good[9:14] = True
        bad = np.r_[0, np.cumsum(~good[data])]
        segments = [{"marker": m, "size": t - s, "non_printable": float(bad[t] - bad[s]) / max(1, t - s)} for m, s, t in walkers.marker_payloads(content)]
    return {"hist": np.bincount(data, minlength=256), "scan_hist": scan, "payloads": signature_hits(content, len(content) if end is None else end), "segments": segments}


#: audit(content, end, container): counts of bytes and of scan data, hits and segments, in one pass.
audit = struct_udf(AUDIT, _audit, 3)
scan_stream = struct_udf("struct<content: binary>", lambda b: {"content": walkers.scan_stream(b)})
payloads = struct_udf(f"struct<hits: array<struct<{PAYLOAD}>>>", lambda b, end: {"hits": signature_hits(b, len(b) if end is None else end)}, 2)
exif_tags = struct_udf(f"struct<tags: {TAG}>", lambda b: {"tags": [{"ifd": t.ifd, "tag": t.tag, "type": t.type, "count": t.count, "nums": t.nums, "text": t.text} for t in exif.read(b)]})
exif_record = struct_udf(f"struct<{_EXIF}>", lambda b: exif.wide(exif.read(b)))
jpeg_comments = struct_udf("struct<comments: array<string>, error: struct<code: string, message: string>>", lambda b: {"comments": walkers.jpeg_comments(b)})
png_texts = struct_udf("struct<texts: array<struct<key: string, value: string>>, error: struct<code: string, message: string>>", lambda b: {"texts": [{"key": k, "value": v} for k, v in walkers.png_texts(b)]})
cut_overlay = struct_udf(BYTES, lambda b: {"content": rewrite.cut_overlay(b)})
scrub = struct_udf(BYTES, lambda b: {"content": rewrite.scrub(b)})
scrub_strict = struct_udf(BYTES, lambda b: {"content": rewrite.scrub(b, strict=True)})
set_jpeg_comment = struct_udf(BYTES, lambda b, text: {"content": rewrite.set_jpeg_comment(b, text or "")}, 2)
set_png_text = struct_udf(BYTES, lambda b, key, text: {"content": rewrite.set_png_text(b, key or "", text or "")}, 3)


def _decode(content: bytes) -> dict[str, Any]:
    a = codecs.decode_wav(content)
    return {"samples": a.samples, "sample_rate": a.rate, "channels": a.channels, "bits": a.bits}


decode_audio = struct_udf(AUDIO, _decode)
probe = struct_udf(PROBE, codecs.probe)


def wav_encoder(rate: int, channels: int, bits: int = 16) -> Callable[..., Column]:
    return struct_udf(BYTES, lambda x: {"content": codecs.encode_wav(np.array(x, np.float32), rate, channels, bits)})


def audio_converter(**options: Any) -> Callable[..., Column]:
    return struct_udf(BYTES, lambda b: {"content": codecs.convert_audio(b, **options)})


def image_converter(**options: Any) -> Callable[..., Column]:
    """(content, source format, target format) -> bytes."""
    return struct_udf(BYTES, lambda b, s, t: {"content": codecs.transcode_image(b, s, t, **options)}, 3)


def av_converter(options: tools.Options = tools.Options(), seconds: int = 600) -> Callable[..., Column]:
    """(content, source format, target format) -> bytes, by the encoder of the machine that runs the task."""
    from ..dims import FORMATS

    kinds = {f: k for _, f, k, _ in FORMATS}

    def run(content: bytes, source: str, target: str) -> dict[str, Any]:
        return {"content": tools.convert(content, source, kinds.get(source, "unknown"), target, kinds.get(target, "unknown"), options, seconds)}

    return struct_udf(BYTES, run, 3)
