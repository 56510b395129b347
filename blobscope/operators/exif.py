"""TIFF/EXIF blocks: directories as long rows, and the wide record that reports read."""

from __future__ import annotations

import math
import struct
from dataclasses import dataclass

import numpy as np

#: Bytes and struct code of each TIFF type: BYTE, ASCII, SHORT, LONG, RATIONAL, SBYTE, UNDEFINED, SSHORT,
#: SLONG, SRATIONAL, FLOAT, DOUBLE.
TYPES = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 6: (1, "b"), 7: (1, "s"), 8: (2, "h"), 9: (4, "i"), 10: (8, "ii"), 11: (4, "f"), 12: (8, "d")}
EXIF_POINTER, GPS_POINTER = 0x8769, 0x8825


@dataclass
class Tag:
    ifd: str
    tag: int
    type: int
    count: int
    nums: list[float]
    rationals: list[tuple[int, int]]
    text: str | None


def read(data: bytes | None) -> list[Tag]:
    """Tags of the primary image's directory and of its EXIF and GPS directories. Anything that can't be
    read leaves its tag out; a block that isn't TIFF has none."""
    if not data or len(data) < 8 or data[:4] not in (b"II*\0", b"MM\0*"):
        return []
    e = "<" if data[:2] == b"II" else ">"
    out: list[Tag] = []
    (first,) = struct.unpack_from(f"{e}I", data, 4)
    todo, seen = [("tiff", first)], set()
    while todo:
        ifd, at = todo.pop(0)
        if at in seen or at + 2 > len(data):
            continue
        seen.add(at)
        (n,) = struct.unpack_from(f"{e}H", data, at)
        for k in range(n):
            p = at + 2 + 12 * k
            if p + 12 > len(data):
                break
            tag, kind, count = struct.unpack_from(f"{e}HHI", data, p)
            if kind not in TYPES:
                continue
            size, code = TYPES[kind]
            place = p + 8 if size * count <= 4 else struct.unpack_from(f"{e}I", data, p + 8)[0]
            raw = data[place : place + size * count]
            if len(raw) < size * count:
                continue
            if tag in (EXIF_POINTER, GPS_POINTER) and kind == 4 and count == 1:
                todo.append(("exif" if tag == EXIF_POINTER else "gps", struct.unpack(f"{e}I", raw)[0]))
                continue
            nums, rationals, text = [], [], None
            if code == "s":
                text = raw.split(b"\0")[0].decode("utf-8", "replace") if kind == 2 else raw.rstrip(b"\0").decode("utf-8", "replace")
                nums = [float(b) for b in raw] if kind == 7 else []
            elif len(code) == 2:
                flat = struct.unpack(f"{e}{code * count}", raw)
                rationals = list(zip(flat[::2], flat[1::2], strict=True))
                nums = [a / b if b else math.nan if a == 0 else math.copysign(math.inf, a) for a, b in rationals]
            else:
                nums = [float(x) for x in struct.unpack(f"{e}{count}{code}", raw)]
            out.append(Tag(ifd, tag, kind, count, nums, rationals, text))
    return out


def dms_to_decimal(d: float, m: float, s: float, negative: bool) -> float:
    """Degrees, minutes and seconds as a signed number; 0 if any isn't a number."""
    if math.isnan(d) or math.isnan(m) or math.isnan(s):
        return 0.0
    x = abs(d) + abs(m) / 60 + abs(s) / 3600
    return -x if negative else x


def _f32(x: float) -> float:
    return float(np.float32(x))


def _exposure(t: Tag) -> str | None:
    if not t.rationals:
        return None
    a, b = t.rationals[0]
    if not b:
        return f"{a}/{b}"
    if a and b % a == 0:
        return f"1/{b // a}" if b > a else str(a // b)
    return str(a // b) if a % b == 0 else f"{a}/{b}"


def wide(tags: list[Tag]) -> dict:
    """The record of named fields: numbers of single precision where the camera's are, GPS with signs."""
    by = {(("gps" if t.ifd == "gps" else "image"), t.tag): t for t in tags}
    get = lambda tag, ifd="image": by.get((ifd, tag))
    text = lambda tag, ifd="image": t.text.strip('"') if (t := get(tag, ifd)) and t.text is not None else None
    whole = lambda tag: int(t.nums[0]) if (t := get(tag)) and t.type in (1, 3, 4) and t.nums else None
    ratio = lambda tag, ifd="image": t.nums[0] if (t := get(tag, ifd)) and t.type == 5 and t.nums else None
    single = lambda x: None if x is None else _f32(x)
    out = {
        "camera_make": text(0x010F), "camera_model": text(0x0110), "software": text(0x0131), "lens_make": text(0xA433), "lens_model": text(0xA434),
        "body_serial_number": text(0xA431), "lens_serial_number": text(0xA435), "date_time_original": text(0x9003), "user_comment": text(0x9286),
        "f_number": single(ratio(0x829D)), "iso": whole(0x8827), "exposure_time": _exposure(t) if (t := get(0x829A)) else None,
        "focal_length_mm": single(ratio(0x920A)), "focal_length_35mm": whole(0xA405), "orientation": whole(0x0112), "width": whole(0xA002), "height": whole(0xA003),
        "flash": whole(0x9209), "exposure_program": whole(0x8822), "metering_mode": whole(0x9207), "white_balance": whole(0xA403), "light_source": whole(0x9208),
    }

    def degrees(tag: int, ref: int, negative: str) -> float | None:
        t = get(tag, "gps")
        return dms_to_decimal(*t.nums[:3], text(ref, "gps") == negative) if t and t.type == 5 and len(t.nums) >= 3 else None

    altitude, below, clock = single(ratio(6, "gps")), get(5, "gps"), get(7, "gps")
    speed, track, direction = ratio(0x0D, "gps"), ratio(0x0F, "gps"), ratio(0x11, "gps")
    gps = {
        "latitude": degrees(2, 1, "S"), "longitude": degrees(4, 3, "W"),
        "altitude": -altitude if altitude is not None and below and below.nums and below.nums[0] == 1 else altitude,
        "speed": speed, "speed_ref": text(0x0C, "gps") if speed is not None else None,
        "track": track, "track_ref": text(0x0E, "gps") if track is not None else None,
        "img_direction": direction, "img_direction_ref": text(0x10, "gps") if direction is not None else None,
        "date_stamp": text(0x1D, "gps"),
        "time_stamp": f"{int(clock.nums[0]):02}:{int(clock.nums[1]):02}:{clock.nums[2]:05.2f}Z" if clock and clock.type == 5 and len(clock.nums) >= 3 and all(map(math.isfinite, clock.nums[:3])) else None,
    }
    out["gps"] = gps if any(v is not None for v in gps.values()) else None
    return out


def build(tiff: list[tuple], exif: list[tuple] = (), gps: list[tuple] = ()) -> bytes:
    """A little-endian TIFF block from (tag, type, values) entries: ASCII takes a string, rationals pairs."""
    lists = [list(tiff), list(exif), list(gps)]
    sizes = [2 + 12 * (len(x) + (i == 0) * ((len(lists[1]) > 0) + (len(lists[2]) > 0))) + 4 for i, x in enumerate(lists)]
    starts = [8, 8 + sizes[0], 8 + sizes[0] + sizes[1] * (len(lists[1]) > 0)]
    heap_at = starts[2] + sizes[2] * (len(lists[2]) > 0)
    if lists[1]:
        lists[0].append((EXIF_POINTER, 4, [starts[1]]))
    if lists[2]:
        lists[0].append((GPS_POINTER, 4, [starts[2]]))
    out, heap = [b"II*\0" + struct.pack("<I", 8)], b""
    for entries in lists:
        if not entries and entries is not lists[0]:
            continue
        rows = []
        for tag, kind, values in sorted(entries, key=lambda x: x[0]):
            size, code = TYPES[kind]
            raw = values.encode() + b"\0" if kind == 2 else struct.pack("<" + code * len(values), *(x for v in values for x in (v if isinstance(v, tuple) else (v,))))
            place = raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack("<I", heap_at + len(heap))
            if len(raw) > 4:
                heap += raw + b"\0" * (len(raw) & 1)
            rows.append(struct.pack("<HHI", tag, kind, len(raw) // size) + place)
        out.append(struct.pack("<H", len(rows)) + b"".join(rows) + b"\0\0\0\0")
    return b"".join(out) + heap
