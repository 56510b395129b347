"""Image and audio codecs in numpy and the standard library: WAV, PNG, BMP, TIFF, GIF and JPEG writing; WAV,
PNG and BMP reading (readers.py has GIF, TIFF and JPEG); exact resizing."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np

from . import headers, readers
from .walkers import PNG_SIGNATURE, Malformed

MAX_SIDE, MAX_PIXELS = 16384, 268_435_456
MAX_SAMPLES = 192_000 * 8 * 3600


def conversion_error(detail: str) -> Malformed:
    return Malformed("ConversionError", f"Conversion error: {detail}")


def unsupported(name: str) -> Malformed:
    return Malformed("UnsupportedFormat", f"Unsupported media format: {name}")


def check_size(width: int, height: int, max_side: int = MAX_SIDE) -> None:
    if width > max_side or height > max_side or width * height > MAX_PIXELS or not (width and height):
        raise Malformed("DimensionAllocationBomb", f"Allocation bomb detected: dimensions {width}x{height} exceed safety limits")


@dataclass
class Audio:
    samples: np.ndarray  # float32, interleaved
    rate: int
    channels: int
    bits: int = 16


def half_away(x: np.ndarray) -> np.ndarray:
    return np.trunc(x + np.copysign(0.5, x))


def encode_wav(samples: np.ndarray, rate: int, channels: int, bits: int = 16) -> bytes:
    """PCM of 16 bits, or floats for 32."""
    x = np.asarray(samples, np.float32)
    body = x.astype("<f4").tobytes() if bits == 32 else half_away(np.clip(x, -1, 1).astype(np.float64) * 32767).astype("<i2").tobytes()
    width, tag = (4, 3) if bits == 32 else (2, 1)
    form = struct.pack("<HHIIHH", tag, channels, rate, rate * channels * width, channels * width, 8 * width)
    return b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<I", 16) + form + b"data" + struct.pack("<I", len(body)) + body


def decode_wav(data: bytes) -> Audio:
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise unsupported("audio without a WAVE header")
    at, form = 12, None
    while at + 8 <= len(data):
        kind, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        body = data[at + 8 : at + 8 + size]
        if kind == b"fmt " and len(body) >= 16:
            form = struct.unpack_from("<HHIIHH", body)
            if form[0] == 0xFFFE and len(body) >= 26:
                form = (int.from_bytes(body[24:26], "little"), *form[1:])
        elif kind == b"data":
            if not form or not form[1] or not form[2]:
                raise conversion_error("WAV data without a format")
            tag, channels, rate, _, _, bits = form
            width = bits // 8
            body = body[: len(body) // max(1, width) * width]
            if tag == 3 and bits in (32, 64):
                x = np.frombuffer(body, f"<f{width}").astype(np.float32)
            elif tag == 1 and bits in (8, 16, 24, 32):
                if bits == 8:
                    x = (np.frombuffer(body, np.uint8).astype(np.float32) - 128) / 128
                elif bits == 24:
                    wide = np.zeros((len(body) // 3, 4), np.uint8)
                    wide[:, 1:] = np.frombuffer(body, np.uint8).reshape(-1, 3)
                    x = (wide.view("<i4").ravel() >> 8).astype(np.float32) / (1 << 23)
                else:
                    x = np.frombuffer(body, f"<i{width}").astype(np.float32) / (1 << bits - 1)
            else:
                raise unsupported(f"WAV of kind {tag} with {bits} bits")
            if not len(x) or len(x) > MAX_SAMPLES:
                raise conversion_error("no audio samples" if not len(x) else "too many audio samples")
            return Audio(x, rate, channels, bits)
        at += 8 + size + (size & 1)
    raise conversion_error("WAV without data")


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(pixels: np.ndarray) -> bytes:
    h, w, c = pixels.shape
    rows = np.concatenate([np.zeros((h, 1), np.uint8), pixels.reshape(h, w * c)], axis=1)
    head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 2: 4, 3: 2, 4: 6}[c], 0, 0, 0)
    return PNG_SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes())) + _chunk(b"IEND", b"")


def _unfilter(raw: np.ndarray, step: int) -> np.ndarray:
    kinds, rows = raw[:, 0], raw[:, 1:].astype(np.int32)
    out = np.zeros_like(rows)
    for y in range(len(rows)):
        up = out[y - 1] if y else np.zeros(rows.shape[1], np.int32)
        kind, line = kinds[y], rows[y]
        if kind == 0:
            out[y] = line
        elif kind == 2:
            out[y] = line + up & 255
        elif kind == 1:
            out[y] = np.cumsum(line.reshape(-1, step), axis=0).reshape(-1) & 255
        elif kind in (3, 4):
            done = out[y]
            for x in range(len(line)):
                left, corner = (done[x - step], up[x - step]) if x >= step else (0, 0)
                if kind == 3:
                    guess = (left + up[x]) // 2
                else:
                    p = left + up[x] - corner
                    guess = min((left, up[x], corner), key=lambda v, p=p: abs(p - v))
                done[x] = line[x] + guess & 255
        else:
            raise conversion_error(f"PNG filter {kind}")
    return out.astype(np.uint8)


def decode_png(data: bytes) -> np.ndarray:
    from .walkers import parse_png

    info = parse_png(data)
    if info.width is None:
        raise conversion_error("PNG without a header")
    check_size(info.width, info.height)
    kind, depth = info.extra["color_type"], info.bit_depth
    if info.extra["interlace"] or kind not in (0, 2, 3, 4, 6):
        raise unsupported("interlaced PNG" if info.extra["interlace"] else f"PNG of color type {kind}")
    body = lambda p: data[p.offset + 8 : p.offset + p.length - 4]
    samples = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[kind]
    width = -(-info.width * samples * depth // 8)
    try:
        raw = zlib.decompress(b"".join(body(p) for p in info.parts if p.name == "IDAT"))
    except zlib.error as e:
        raise conversion_error(f"PNG data: {e}") from None
    if len(raw) < info.height * (width + 1):
        raise conversion_error("PNG data ends early")
    rows = _unfilter(np.frombuffer(raw, np.uint8, info.height * (width + 1)).reshape(info.height, width + 1), max(1, samples * depth // 8))
    if depth == 16:
        rows = rows[:, ::2]
    elif depth < 8:
        bits = np.unpackbits(rows, axis=1).reshape(info.height, -1, depth)
        rows = np.packbits(bits, axis=2)[:, : info.width * samples, 0] >> (8 - depth)
        if kind == 0:
            rows = (rows.astype(np.int32) * 255 // ((1 << depth) - 1)).astype(np.uint8)
    pixels = rows.reshape(info.height, info.width, samples)
    if kind == 3:
        palette = next((np.frombuffer(body(p), np.uint8).reshape(-1, 3) for p in info.parts if p.name == "PLTE"), None)
        if palette is None or pixels.max(initial=0) >= len(palette):
            raise conversion_error("PNG palette")
        pixels = palette[pixels[:, :, 0]]
    return pixels


def rgb(pixels: np.ndarray) -> np.ndarray:
    return pixels[:, :, :3] if pixels.shape[2] >= 3 else np.repeat(pixels[:, :, :1], 3, axis=2)


def encode_bmp(pixels: np.ndarray) -> bytes:
    x = rgb(pixels)[::-1, :, ::-1]
    h, w, _ = x.shape
    rows = np.zeros((h, -(-w * 3 // 4) * 4), np.uint8)
    rows[:, : w * 3] = x.reshape(h, w * 3)
    return b"BM" + struct.pack("<IHHI", 54 + rows.size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, rows.size, 2835, 2835, 0, 0) + rows.tobytes()


def decode_bmp(data: bytes) -> np.ndarray:
    if len(data) < 54 or data[:2] != b"BM":
        raise conversion_error("not a BMP file")
    start, (w, h, _, bits, packing) = int.from_bytes(data[10:14], "little"), struct.unpack_from("<iiHHI", data, 18)
    if bits not in (24, 32) or packing not in (0, 3) or w <= 0:
        raise unsupported(f"BMP of {bits} bits")
    check_size(w, abs(h))
    step, width = bits // 8, -(-w * bits // 32) * 4
    if start + width * abs(h) > len(data):
        raise conversion_error("BMP data ends early")
    rows = np.frombuffer(data, np.uint8, width * abs(h), start).reshape(abs(h), width)[:, : w * step].reshape(abs(h), w, step)
    return np.ascontiguousarray((rows[::-1] if h > 0 else rows)[:, :, 2::-1])


def encode_tiff(pixels: np.ndarray) -> bytes:
    x = rgb(pixels)
    h, w, _ = x.shape
    tags = [(256, 4, 1, w), (257, 4, 1, h), (258, 3, 3, 8 + 2 + 12 * 9 + 4), (259, 3, 1, 1), (262, 3, 1, 2), (273, 4, 1, 8 + 2 + 12 * 9 + 4 + 6), (277, 3, 1, 3), (278, 4, 1, h), (279, 4, 1, x.size)]
    return b"II*\0" + struct.pack("<IH", 8, len(tags)) + b"".join(struct.pack("<HHII", *t) for t in tags) + b"\0\0\0\0" + struct.pack("<HHH", 8, 8, 8) + x.tobytes()


def encode_gif(pixels: np.ndarray) -> bytes:
    """One frame over a fixed palette of 6 x 7 x 6 colours."""
    x = rgb(pixels).astype(np.int32)
    h, w, _ = x.shape
    levels = (6, 7, 6)
    parts = [(x[:, :, i] * (n - 1) + 127) // 255 for i, n in enumerate(levels)]
    index = ((parts[0] * 7 + parts[1]) * 6 + parts[2]).ravel().tolist()
    table = bytearray(768)
    for i in range(6 * 7 * 6):
        r, g, b = i // 42, i // 6 % 7, i % 6
        table[3 * i : 3 * i + 3] = bytes((r * 255 // 5, g * 255 // 6, b * 255 // 5))
    codes, out, bits, held = {(i,): i for i in range(256)}, bytearray(), 0, 0
    size, current = 9, ()

    def put(code: int) -> None:
        nonlocal bits, held
        held |= code << bits
        bits += size
        while bits >= 8:
            out.append(held & 255)
            held >>= 8
            bits -= 8

    put(256)
    table_next = 258
    for i in index:
        longer = (*current, i)
        if longer in codes:
            current = longer
            continue
        put(codes[current])
        if table_next < 4096:
            codes[longer] = table_next
            if table_next == 1 << size and size < 12:
                size += 1
            table_next += 1
        else:
            put(256)
            codes, table_next, size = {(k,): k for k in range(256)}, 258, 9
        current = (i,)
    if current:
        put(codes[current])
    put(257)
    if bits:
        out.append(held & 255)
    blocks = b"".join(bytes([len(b)]) + b for b in (bytes(out[i : i + 255]) for i in range(0, len(out), 255)))
    return b"GIF89a" + struct.pack("<HHBBB", w, h, 0xF7, 0, 0) + bytes(table) + b"," + struct.pack("<HHHHB", 0, 0, w, h, 0) + b"\x08" + blocks + b"\0;"


# Tables K.1 and K.2 (quantization) and K.3 to K.6 (Huffman) of the JPEG standard.
_LUMA = np.array([16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62, 18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99])
_CHROMA = np.array([17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, *[99] * 36])
_DC_BITS = (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0)
_ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))


def _huffman(bits: tuple[int, ...], values: list[int]) -> dict[int, tuple[int, int]]:
    code, out, k = 0, {}, 0
    for length, n in enumerate(bits, 1):
        for _ in range(n):
            out[values[k]] = (code, length)
            code, k = code + 1, k + 1
        code <<= 1
    return out


def encode_jpeg(pixels: np.ndarray, quality: int = 85) -> bytes:
    """Baseline JPEG without subsampling. AC symbols have a table of one length (8 bits) for all."""
    q = min(100, max(1, quality))
    scale = 5000 // q if q < 50 else 200 - 2 * q
    tables = [np.clip((t * scale + 50) // 100, 1, 255) for t in (_LUMA, _CHROMA)]
    x = rgb(pixels).astype(np.float64)
    h, w, _ = x.shape
    r, g, b = (x[:, :, i] for i in range(3))
    planes = [0.299 * r + 0.587 * g + 0.114 * b - 128, -0.168736 * r - 0.331264 * g + 0.5 * b, 0.5 * r - 0.418688 * g - 0.081312 * b]
    k = np.arange(8)
    dct = np.sqrt(np.where(k[:, None] == 0, 1, 2) / 8) * np.cos((2 * k + 1) * k[:, None] * np.pi / 16)
    coded = []
    for i, p in enumerate(planes):
        p = np.pad(p, ((0, -h % 8), (0, -w % 8)), mode="edge")
        blocks = p.reshape(p.shape[0] // 8, 8, p.shape[1] // 8, 8).swapaxes(1, 2).reshape(-1, 8, 8)
        freq = (dct @ blocks @ dct.T).reshape(-1, 64)
        coded.append(np.rint(freq / tables[i > 0]).astype(int)[:, _ZIGZAG])
    ac_values = [run << 4 | size for run in range(16) for size in range(1, 11)] + [0, 0xF0]
    ac_bits = (0, 0, 0, 0, 0, 0, 0, len(ac_values), *[0] * 8)
    dc, ac = _huffman(_DC_BITS, list(range(12))), _huffman(ac_bits, ac_values)
    stream: list[str] = []
    put = lambda code, n: stream.append(format(code, f"0{n}b"))
    last = [0, 0, 0]
    for block in zip(*(c.tolist() for c in coded), strict=True):
        for i, z in enumerate(block):
            diff, last[i] = z[0] - last[i], z[0]
            size = abs(diff).bit_length()
            put(*dc[size])
            if size:
                put(diff if diff > 0 else diff + (1 << size) - 1, size)
            run = 0
            for v in z[1 : max((j for j in range(64) if z[j]), default=0) + 1]:
                if not v:
                    run += 1
                    continue
                while run > 15:
                    put(*ac[0xF0])
                    run -= 16
                size = abs(v).bit_length()
                put(*ac[run << 4 | size])
                put(v if v > 0 else v + (1 << size) - 1, size)
                run = 0
            if not any(z[63:]):
                put(*ac[0])
    bits = "".join(stream)
    bits += "1" * (-len(bits) % 8)
    scan = int(bits, 2).to_bytes(len(bits) // 8) if bits else b""
    seg = lambda m, body: bytes([0xFF, m]) + struct.pack(">H", len(body) + 2) + body
    quant = b"".join(bytes([i]) + bytes(t[_ZIGZAG].astype(np.uint8)) for i, t in enumerate(tables))
    huff = b"\x00" + bytes(_DC_BITS) + bytes(range(12)) + b"\x10" + bytes(ac_bits) + bytes(ac_values)
    sof = struct.pack(">BHHB", 8, h, w, 3) + b"".join(bytes([i + 1, 0x11, i > 0]) for i in range(3))
    sos = b"\x03" + b"".join(bytes([i + 1, 0]) for i in range(3)) + b"\x00\x3f\x00"
    return b"\xff\xd8" + seg(0xE0, b"JFIF\0\x01\x01\x00\x00\x01\x00\x01\x00\x00") + seg(0xDB, quant) + seg(0xC0, sof) + seg(0xC4, huff) + seg(0xDA, sos) + scan.replace(b"\xff", b"\xff\0") + b"\xff\xd9"


ENCODERS = {"png": encode_png, "bmp": encode_bmp, "tiff": encode_tiff, "gif": encode_gif}
DECODERS = {"png": decode_png, "bmp": decode_bmp, "gif": readers.decode_gif, "tiff": readers.decode_tiff, "jpeg": readers.decode_jpeg}


def _lanczos(n: int, m: int) -> np.ndarray:
    """Weights (m, n) of a Lanczos-3 resampling from n to m."""
    ratio = max(1.0, n / m)
    centre = (np.arange(m) + 0.5) * n / m - 0.5
    d = (np.arange(n) - centre[:, None]) / ratio
    w = np.where(np.abs(d) < 3, np.sinc(d) * np.sinc(d / 3), 0)
    return w / w.sum(axis=1, keepdims=True)


def resize(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    check_size(width, height)
    h, w, _ = pixels.shape
    out = np.einsum("yh,hwc->ywc", _lanczos(h, height), pixels.astype(np.float64))
    out = np.einsum("xw,ywc->yxc", _lanczos(w, width), out)
    return np.clip(half_away(out), 0, 255).astype(np.uint8)


def transcode_image(data: bytes, source: str, target: str, quality: int = 85, size: tuple[int, int] | None = None, max_side: int = MAX_SIDE) -> bytes:
    if not data:
        raise Malformed("EmptyFile", "File is empty")
    if source not in DECODERS:
        raise unsupported(source)
    if target != "jpeg" and target not in ENCODERS:
        raise unsupported(target)
    if size:
        check_size(*size, max_side)
    pixels = DECODERS[source](data)
    check_size(pixels.shape[1], pixels.shape[0], max_side)
    if size:
        pixels = resize(pixels, *size)
    return encode_jpeg(pixels, quality) if target == "jpeg" else ENCODERS[target](pixels)


def convert_audio(data: bytes, rate: int | None = None, channels: int | None = None, gain: float | None = None, normalize: bool = False, bits: int = 16) -> bytes:
    """WAV to WAV: channels, then rate, gain and peak (0.98)."""
    a = decode_wav(data)
    if channels is not None and not 1 <= channels <= 8:
        raise conversion_error(f"{channels} channels; 1 to 8 can be written")
    x = a.samples[: len(a.samples) // a.channels * a.channels].reshape(-1, a.channels)
    if channels and channels != a.channels:
        x = x.mean(axis=1, keepdims=True, dtype=np.float32) if channels == 1 else np.stack([x[:, c if c < a.channels else 0] for c in range(channels)], axis=1)
    if rate and rate != a.rate and len(x):
        n = int(len(x) * rate / a.rate + 0.5)
        at = np.arange(n) * (a.rate / rate)
        low = np.minimum(at.astype(int), len(x) - 1)
        part = (at - np.floor(at)).astype(np.float32)[:, None]
        x = x[low] + (x[np.minimum(low + 1, len(x) - 1)] - x[low]) * part
    if gain is not None and abs(gain - 1) >= 1e-6:
        x = np.clip(x * np.float32(gain), -1, 1)
    if normalize and (peak := float(np.abs(x).max(initial=0))) > 1e-6:
        x = np.clip(x * np.float32(0.98 / peak), -1, 1)
    return encode_wav(x.ravel(), rate or a.rate, channels or a.channels, bits)


def probe(data: bytes) -> dict:
    """What a blob is: kind, format, dimensions and bits a pixel, or rate, channels and seconds."""
    from .walkers import sniff

    out = dict.fromkeys(("media_type", "format", "width", "height", "sample_rate", "channels", "bits_per_sample", "codec", "duration_secs", "audio_tracks", "video_tracks"))
    if (kind := sniff(data)) in ("png", "jpeg", "gif", "webp", "heic"):
        from .walkers import parse

        p = parse(data, kind)
        per = {"png": {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(p.extra.get("color_type"), 1), "jpeg": p.channels or 3}.get(kind, 3)
        return out | {"media_type": "Image", "format": kind, "width": p.width, "height": p.height, "bits_per_sample": (p.bit_depth or 8) * per}
    if data[:4] == b"RIFF" and data[8:12] == b"WAVE":
        a = decode_wav(data)
        return out | {"media_type": "Audio", "format": "wav", "sample_rate": a.rate, "channels": a.channels, "bits_per_sample": a.bits, "codec": "pcm", "duration_secs": len(a.samples) // a.channels / a.rate, "audio_tracks": 1, "video_tracks": 0}
    if data[:2] == b"BM":
        p = decode_bmp(data)
        return out | {"media_type": "Image", "format": "bmp", "width": p.shape[1], "height": p.shape[0], "bits_per_sample": 8 * p.shape[2]}
    if (found := headers.probe(data)) is None:
        raise unsupported("unknown bytes")
    return out | found
