"""Reports of one blob as Python dicts, for functions that SQL and other holders of bytes call. The reports over
tables (plans/reports.py) state the same as Catalyst expressions; a test holds the two together."""

from __future__ import annotations

import math
from decimal import ROUND_HALF_EVEN, Decimal
from typing import Any

import numpy as np

from ..dims import CONTAINERS
from . import exif, walkers
from .udfs import _audit

BY_EXTENSION = {"png": "png", "jpg": "jpeg", "jpeg": "jpeg", "webp": "webp", "gif": "gif", "heic": "heic", "heif": "heic"}


def container_of(content: bytes, path: str | None) -> str | None:
    """By bytes, else by the extension of the path."""
    name = (path or "").rpartition("/")[2]
    stem, dot, ext = name.rpartition(".")
    return walkers.sniff(content) or (BY_EXTENSION.get(ext.lower()) if dot and stem else None)


def scan(content: bytes, path: str | None) -> dict[str, Any]:
    """{container, file_size, metadata}, or {error}."""
    kind = container_of(content, path)
    try:
        p = walkers.parse(content, kind)
    except walkers.Malformed as e:
        return {"error": e.message}
    tags = exif.read(p.exif)
    return {"container": kind, "file_size": len(content), "metadata": _entries(p, kind, len(content), exif.wide(tags) if tags else {})}


def _entries(p: walkers.Parsed, kind: str | None, size: int, e: dict[str, Any]) -> list[dict[str, Any]]:
    gps, out = e.get("gps") or {}, []

    def add(category: str, tag: int | None, key: str, name: str, value: Any, form: str = "{}") -> None:
        if value is not None:
            out.append({"category": category, "tag_id": tag, "key": key, "name": name, "value": form.format(value)})

    kilobytes = (Decimal(size) / 1024).quantize(Decimal("0.01"), ROUND_HALF_EVEN)
    both = p.width is not None and p.height is not None
    add("Forensics", None, "Container", "Container Format", CONTAINERS[kind or "unknown"])
    add("Forensics", None, "FileSize", "File Size", f"{size} bytes ({kilobytes} KB)")
    add("Tiff", 0x0100, "ImageWidth", "Image Width", p.width if both else None, "{} px")
    add("Tiff", 0x0101, "ImageHeight", "Image Height", p.height if both else None, "{} px")
    add("Tiff", None, "BitDepth", "Bit Depth", p.bit_depth if kind == "png" else None, "{} bits")
    if kind in ("jpeg", "gif"):
        title = "GIF" if kind == "gif" else "JPEG"
        add("Text", None, f"{title}Comment", f"{title} Comment", p.comment)
    for key, value in p.text:
        add("Text", None, f"PNG:{key}", f"PNG Text ({key})", value)
    for tag, key, name, field, form in (
        (0x010F, "Make", "Camera Make", "camera_make", "{}"),
        (0x0110, "Model", "Camera Model", "camera_model", "{}"),
        (0x0131, "Software", "Software", "software", "{}"),
        (0x9003, "DateTimeOriginal", "Date/Time Original", "date_time_original", "{}"),
        (0x8827, "ISOSpeedRatings", "ISO Speed", "iso", "{}"),
        (0x829D, "FNumber", "F-Number", "f_number", "f/{:.1f}"),
        (0x829A, "ExposureTime", "Exposure Time", "exposure_time", "{} s"),
        (0x920A, "FocalLength", "Focal Length", "focal_length_mm", "{:.1f} mm"),
        (0xA433, "LensMake", "Lens Make", "lens_make", "{}"),
        (0xA434, "LensModel", "Lens Model", "lens_model", "{}"),
        (0xA431, "BodySerialNumber", "Camera Serial", "body_serial_number", "{}"),
        (0xA435, "LensSerialNumber", "Lens Serial", "lens_serial_number", "{}"),
    ):
        add("Tiff" if tag < 0x8000 else "Exif", tag, key, name, e.get(field), form)
    for tag, key, name, field, form in (
        (0x0002, "GPSLatitude", "GPS Latitude", "latitude", "{:.6f}°"),
        (0x0004, "GPSLongitude", "GPS Longitude", "longitude", "{:.6f}°"),
        (0x0006, "GPSAltitude", "GPS Altitude", "altitude", "{:.2f} m"),
        (0x000D, "GPSSpeed", "GPS Speed", "speed", "{:.2f}"),
        (0x000F, "GPSTrack", "GPS Track", "track", "{:.2f}°"),
    ):
        add("Gps", tag, key, name, gps.get(field), form)
    return out


def entropy(counts: np.ndarray) -> float:
    n, some = int(counts.sum()), counts[counts > 0].astype(float)
    return max(0.0, math.log2(n) - float((some * np.log2(some)).sum()) / n) if n else 0.0


def audit(content: bytes, path: str | None) -> dict[str, Any]:
    """{container, entropy, overlay, payloads, steganalysis}: the last with the bytes and ASCII share of a scan."""
    kind = container_of(content, path) or "unknown"
    try:
        end = walkers.parse(content, kind).end if kind != "unknown" else len(content)
    except walkers.Malformed:
        end = len(content)
    a = _audit(content, end, kind)
    over = max(0, len(content) - end)
    scan_hist = a["scan_hist"]
    stego = None
    if scan_hist is not None:
        n = int(scan_hist.sum())
        good = int(scan_hist[32:127].sum() + scan_hist[[9, 10, 13]].sum())
        stego = {"scan_data_bytes": n, "ascii_ratio": good / n if n else 0.0}
    return {
        "container": kind, "entropy": entropy(a["hist"]), "overlay": {"has_overlay": over > 0, "logical_size": end, "physical_size": len(content), "overlay_size": over},
        "payloads": a["payloads"], "steganalysis": stego,
    }
