"""What the headers of audio and video files and of TIFF images tell, without decoding: FLAC, MP3, Ogg, AIFF,
MP4 and QuickTime, Matroska. Each function gives a dict of the fields it finds."""

from __future__ import annotations

import struct
from typing import Any

from .walkers import Malformed

# Fixed values of MPEG audio: kbit/s by (version 1?, layer), rates by version bits.
MPEG_BITRATES = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
MPEG_RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
SOUND_CODECS = {b"mp4a": "aac", b"alac": "alac", b"Opus": "opus", b"ac-3": "ac3", b"ec-3": "eac3", b"sowt": "pcm", b"twos": "pcm", b"lpcm": "pcm", b".mp3": "mp3", b"fLaC": "flac"}


def broken(what: str) -> Malformed:
    return Malformed("ConversionError", f"Conversion error: {what}")


def flac(data: bytes) -> dict[str, Any]:
    if len(data) < 26 or data[4] & 0x7F:
        raise broken("FLAC without its stream record")
    bits = int.from_bytes(data[18:26])
    rate, channels, depth, samples = bits >> 44, (bits >> 41 & 7) + 1, (bits >> 36 & 31) + 1, bits & (1 << 36) - 1
    if not rate:
        raise broken("FLAC without a rate")
    return {"format": "flac", "codec": "flac", "sample_rate": rate, "channels": channels, "bits_per_sample": depth, "duration_secs": samples / rate if samples else None}


def mp3(data: bytes) -> dict[str, Any]:
    """The first frame after a leading tag; seconds by its bit rate, or by the count of frames where one is given."""
    at = 0
    if data[:3] == b"ID3" and len(data) >= 10:
        at = 10 + sum((b & 0x7F) << s for b, s in zip(data[6:10], (21, 14, 7, 0), strict=True))
    while True:
        at = data.find(b"\xff", at)
        if at < 0 or at + 4 > len(data):
            raise broken("MP3 without a frame")
        b, c = data[at + 1], data[at + 2]
        version, layer, rate_at, speed = b >> 3 & 3, 4 - (b >> 1 & 3), c >> 2 & 3, c >> 4
        if b >= 0xE0 and version != 1 and layer < 4 and rate_at < 3 and 0 < speed < 15:
            break
        at += 1
    rate, kbit = MPEG_RATES[version][rate_at], MPEG_BITRATES[version == 3, layer][speed]
    channels = 1 if data[at + 3] >> 6 == 3 else 2
    side = (32 if channels == 2 else 17) if version == 3 else (17 if channels == 2 else 9)
    head = data[at + 4 + side : at + 4 + side + 12]
    per = 384 if layer == 1 else 576 if layer == 3 and version != 3 else 1152
    if head[:4] in (b"Xing", b"Info") and len(head) == 12 and head[7] & 1:
        seconds = int.from_bytes(head[8:12]) * per / rate
    else:
        seconds = (len(data) - at) / (kbit * 125)
    return {"format": "mp3", "codec": f"mp{layer}", "sample_rate": rate, "channels": channels, "duration_secs": seconds}


def ogg(data: bytes) -> dict[str, Any]:
    """The first Vorbis, Opus or FLAC stream; its length is in the last page of the same stream."""
    at, found, start = 0, None, 0
    while data[at : at + 4] == b"OggS" and at + 27 <= len(data) and found is None:
        n = data[at + 26]
        body = at + 27 + n
        packet = data[body : body + 64]
        if packet[:7] == b"\x01vorbis" and len(packet) >= 16:
            found = {"codec": "vorbis", "channels": packet[11], "sample_rate": int.from_bytes(packet[12:16], "little")}
        elif packet[:8] == b"OpusHead" and len(packet) >= 12:
            found = {"codec": "opus", "channels": packet[9], "sample_rate": 48000}
            start = int.from_bytes(packet[10:12], "little")
        elif packet[:5] == b"\x7fFLAC" and len(packet) >= 35:
            found = {k: v for k, v in flac(packet[9:]).items() if k not in ("format", "duration_secs")}
        serial = data[at + 14 : at + 18]
        at = body + sum(data[at + 27 : body])
    if not found or not found["sample_rate"]:
        raise broken("Ogg without a sound stream")
    last = data.rfind(b"OggS")
    while last >= 0 and data[last + 14 : last + 18] != serial:
        last = data.rfind(b"OggS", 0, last)
    samples = int.from_bytes(data[last + 6 : last + 14], "little", signed=True) - start if last >= 0 else 0
    return {"format": "ogg", **found, "duration_secs": samples / found["sample_rate"] if samples > 0 else None}


def aiff(data: bytes) -> dict[str, Any]:
    at = 12
    while at + 8 <= len(data):
        kind, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8])
        if kind == b"COMM" and size >= 18 and at + 26 <= len(data):
            channels, frames, bits, power, mantissa = struct.unpack_from(">HIHHQ", data, at + 8)
            rate = mantissa * 2.0 ** ((power & 0x7FFF) - 16446)  # a float of 80 bits
            if not rate:
                break
            return {"format": "aiff", "codec": "pcm", "sample_rate": round(rate), "channels": channels, "bits_per_sample": bits, "duration_secs": frames / rate}
        at += 8 + size + (size & 1)
    raise broken("AIFF without its common chunk")


def boxes(data: bytes, at: int, end: int):
    """(kind, start of the body, end) of the boxes of a level, as far as they lie within it."""
    while at + 8 <= end:
        size, kind, head = int.from_bytes(data[at : at + 4]), data[at + 4 : at + 8], 8
        if size == 1:
            size, head = int.from_bytes(data[at + 8 : at + 16]), 16
        elif size == 0:
            size = end - at
        if size < head or at + size > end:
            return
        yield kind, at + head, at + size
        at += size


def _below(data: bytes, at: int, end: int, *path: bytes) -> tuple[int, int] | None:
    """The body of the first box that the path of kinds leads to."""
    for kind in path:
        found = next(((a, e) for k, a, e in boxes(data, at, end) if k == kind), None)
        if found is None:
            return None
        at, end = found
    return at, end


def _clock(data: bytes, at: int, end: int) -> float | None:
    """Seconds of a media header of version 0 or 1."""
    form = ">QI" if data[at] else ">I"
    place = at + (20 if data[at] else 12)
    if place + 12 > end:
        return None
    scale = int.from_bytes(data[place : place + 4])
    length = struct.unpack_from(">Q" if form == ">QI" else ">I", data, place + 4)[0]
    return length / scale if scale else None


def mp4(data: bytes) -> dict[str, Any]:
    """Tracks of the movie box: how many of sound and picture, and the first of sound."""
    movie = _below(data, 0, len(data), b"moov")
    if movie is None:
        raise broken("MP4 without a movie box")
    out: dict[str, Any] = {"format": "mp4", "audio_tracks": 0, "video_tracks": 0}
    for kind, at, end in boxes(data, *movie):
        handler = _below(data, at, end, b"mdia", b"hdlr") if kind == b"trak" else None
        if handler is None:
            continue
        role = data[handler[0] + 8 : handler[0] + 12]
        out["video_tracks"] += role == b"vide"
        sample = _below(data, at, end, b"mdia", b"minf", b"stbl", b"stsd")
        if role != b"soun" or sample is None or sample[0] + 44 > sample[1]:
            continue
        out["audio_tracks"] += 1
        if out["audio_tracks"] == 1:
            entry = sample[0] + 8
            channels, bits = struct.unpack_from(">HH", data, entry + 24)
            head = _below(data, at, end, b"mdia", b"mdhd")
            code = data[entry + 4 : entry + 8]
            out |= {"codec": SOUND_CODECS.get(code, code.decode("latin-1")), "channels": channels, "bits_per_sample": bits, "sample_rate": int.from_bytes(data[entry + 32 : entry + 34]), "duration_secs": _clock(data, *head) if head else None}
    return out


def _number(data: bytes, at: int, keep: bool) -> tuple[int, int]:
    """A Matroska number of variable width and the place after it; `keep` leaves the width's bit in, as ids have it."""
    if at >= len(data) or not data[at]:
        raise broken("Matroska element without a width")
    width = 9 - data[at].bit_length()
    value = int.from_bytes(data[at : at + width])
    return (value if keep else value & (1 << 7 * width) - 1), at + width


def elements(data: bytes, at: int, end: int):
    """(id, start of the body, end) of the elements of a level; one of unknown size reaches to the end."""
    while at < end:
        name, at = _number(data, at, True)
        width = 9 - data[at].bit_length() if at < len(data) and data[at] else 1
        size, at = _number(data, at, False)
        stop = end if size == (1 << 7 * width) - 1 else min(end, at + size)
        yield name, at, stop
        at = stop


def _real(body: bytes) -> float:
    return struct.unpack(">f" if len(body) == 4 else ">d", body)[0] if len(body) in (4, 8) else 0.0


def mkv(data: bytes) -> dict[str, Any]:
    """Segment information and tracks: counts, and the first track of sound."""
    out: dict[str, Any] = {"format": "mkv", "audio_tracks": 0, "video_tracks": 0}
    scale, length = 1_000_000, None
    for name, at, end in elements(data, 0, len(data)):
        if name != 0x18538067:  # segment
            continue
        for part, a, e in elements(data, at, end):
            if part == 0x1549A966:  # information
                for k, x, y in elements(data, a, e):
                    if k == 0x2AD7B1:
                        scale = int.from_bytes(data[x:y])
                    elif k == 0x4489:
                        length = _real(data[x:y])
            elif part == 0x1654AE6B:  # tracks
                for k, x, y in elements(data, a, e):
                    if k == 0xAE:
                        _track(data, x, y, out)
                break
            elif part == 0x1F43B675:  # clusters follow what a header tells
                break
    if not out["audio_tracks"] + out["video_tracks"]:
        raise broken("Matroska without tracks")
    return out | {"duration_secs": None if length is None else length * scale / 1e9}


def _track(data: bytes, at: int, end: int, out: dict[str, Any]) -> None:
    fields = {k: (a, e) for k, a, e in elements(data, at, end)}
    body = lambda k: data[slice(*fields[k])] if k in fields else b""
    kind = int.from_bytes(body(0x83))
    out["video_tracks"] += kind == 1
    if kind != 2:
        return
    out["audio_tracks"] += 1
    if out["audio_tracks"] == 1:
        sound = {k: data[a:e] for k, a, e in elements(data, *fields[0xE1])} if 0xE1 in fields else {}
        out["codec"] = body(0x86).decode("latin-1").removeprefix("A_").lower()
        out["sample_rate"] = round(_real(sound.get(0xB5, b"")) or 8000)
        out["channels"] = int.from_bytes(sound.get(0x9F, b"\x01"))
        out["bits_per_sample"] = int.from_bytes(sound[0x6264]) if 0x6264 in sound else None


def tiff(data: bytes) -> dict[str, Any]:
    """Size and bits a pixel of the first directory."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8:
        raise broken("TIFF without its header")
    number = lambda a, n: int.from_bytes(data[a : a + n], "little" if order == "<" else "big")
    at, out = number(4, 4), {}
    for i in range(number(at, 2)):
        entry = at + 2 + 12 * i
        if entry + 12 > len(data):
            break
        tag, kind, count = number(entry, 2), number(entry + 2, 2), number(entry + 4, 4)
        width = 2 if kind == 3 else 4
        place = entry + 8 if count * width <= 4 else number(entry + 8, 4)
        if tag in (256, 257):
            out["width" if tag == 256 else "height"] = number(place, width)
        elif tag == 258:
            out["bits_per_sample"] = sum(number(place + 2 * k, 2) for k in range(min(count, 16)))
    if "width" not in out or "height" not in out:
        raise broken("TIFF without a size")
    return {"media_type": "Image", "format": "tiff", "bits_per_sample": 1, **out}


def probe(data: bytes) -> dict[str, Any] | None:
    """Fields of the format that the first bytes name; None for another."""
    if data[:4] in (b"II*\0", b"MM\0*"):
        return tiff(data)
    if data[:4] == b"fLaC":
        out = flac(data)
    elif data[:4] == b"OggS":
        out = ogg(data)
    elif data[:4] == b"FORM" and data[8:12] in (b"AIFF", b"AIFC"):
        out = aiff(data)
    elif data[4:8] in (b"ftyp", b"moov"):
        out = mp4(data)
    elif data[:4] == b"\x1a\x45\xdf\xa3":
        out = mkv(data)
    elif data[:3] == b"ID3" or (len(data) > 1 and data[0] == 0xFF and data[1] >= 0xE0):
        out = mp3(data)
    else:
        return None
    out = {"audio_tracks": 1, "video_tracks": 0} | out
    return out | {"media_type": "Video Container" if out["video_tracks"] else "Audio"}
