"""Decoders of GIF, TIFF and baseline JPEG images into arrays (height, width, channels)."""

from __future__ import annotations

import zlib

import numpy as np

from .walkers import Malformed, jpeg_markers

MAX_PIXELS = 268_435_456


def broken(what: str) -> Malformed:
    return Malformed("ConversionError", f"Conversion error: {what}")


def checked(width: int, height: int) -> None:
    if not width or not height or width * height > MAX_PIXELS:
        raise Malformed("DimensionAllocationBomb", f"Allocation bomb detected: dimensions {width}x{height} exceed safety limits")


# GIF


def _lzw(data: bytes, least: int, wanted: int) -> bytes:
    """Codes of growing width, lowest bits first, into at most `wanted` bytes."""
    clear, stop = 1 << least, (1 << least) + 1
    fresh = [bytes([i]) for i in range(clear)] + [b"", b""]
    table, width, last, out = fresh[:], least + 1, None, bytearray()
    held, have = 0, 0
    for byte in data:
        held |= byte << have
        have += 8
        while have >= width:
            code, held, have = held & (1 << width) - 1, held >> width, have - width
            if code == clear:
                table, width, last = fresh[:], least + 1, None
                continue
            if code == stop or len(out) >= wanted:
                return bytes(out[:wanted])
            if last is None:
                word = table[code] if code < len(table) else b""
            elif code < len(table):
                word = table[code]
                if len(table) < 4096:
                    table.append(last + word[:1])
            elif code == len(table) and len(table) < 4096:
                word = last + last[:1]
                table.append(word)
            else:
                raise broken("GIF code outside its table")
            out += word
            last = word
            if len(table) == 1 << width and width < 12:
                width += 1
    return bytes(out[:wanted])


def decode_gif(data: bytes) -> np.ndarray:
    """The first image on its canvas; what it leaves free is black."""
    from .walkers import _colour_table, _sub_blocks, parse_gif

    info = parse_gif(data)
    checked(info.width, info.height)
    shared = data[13 : 13 + _colour_table(data[10])]
    part = next((p for p in info.parts if p.name == "Image Descriptor"), None)
    if part is None:
        raise broken("GIF without an image")
    at = part.offset
    left, top, w, h = (int.from_bytes(data[at + i : at + i + 2], "little") for i in (1, 3, 5, 7))
    checked(w, h)
    packed = data[at + 9]
    own = _colour_table(packed)
    colours = np.zeros((256, 3), np.uint8)
    table = data[at + 10 : at + 10 + own] if own else shared
    colours[: len(table) // 3] = np.frombuffer(table[: len(table) // 3 * 3], np.uint8).reshape(-1, 3)
    least = data[at + 10 + own]
    if not 1 <= least <= 11:
        raise broken(f"GIF code width {least}")
    coded, _ = _sub_blocks(data, at + 11 + own)
    rows = np.frombuffer(_lzw(coded, least, w * h).ljust(w * h, b"\0"), np.uint8).reshape(h, w)
    if packed & 0x40:  # interlaced
        order = np.concatenate([np.arange(a, h, s) for a, s in ((0, 8), (4, 8), (2, 4), (1, 2))])
        straight = np.empty_like(rows)
        straight[order] = rows
        rows = straight
    canvas = np.zeros((info.height, info.width, 3), np.uint8)
    seen = canvas[top : top + h, left : left + w]
    seen[:] = colours[rows[: seen.shape[0], : seen.shape[1]]]
    return canvas


# TIFF


def _unpack_bits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        else:
            if n > 128:
                out += data[at + 1 : at + 2] * (257 - n)
            at += 2
    return bytes(out)


def decode_tiff(data: bytes) -> np.ndarray:
    """Strips of 8 bits a sample, interleaved, without compression or by PackBits or Deflate; grey, RGB, palette."""
    order = {b"II": "little", b"MM": "big"}.get(data[:2])
    if order is None or len(data) < 8:
        raise broken("TIFF without its header")
    number = lambda a, n: int.from_bytes(data[a : a + n], order)
    at, tags = number(4, 4), {}
    for i in range(number(at, 2)):
        entry = at + 2 + 12 * i
        if entry + 12 > len(data):
            raise broken("TIFF directory beyond its file")
        tag, kind, count = number(entry, 2), number(entry + 2, 2), number(entry + 4, 4)
        width = {1: 1, 3: 2, 4: 4}.get(kind)
        if width is None:
            continue
        place = entry + 8 if count * width <= 4 else number(entry + 8, 4)
        if place + count * width > len(data):
            raise broken("TIFF values beyond their file")
        tags[tag] = [number(place + width * k, width) for k in range(count)]
    one = lambda tag, default=0: tags.get(tag, [default])[0]
    w, h, c, packing, meaning = one(256), one(257), one(277, 1), one(259, 1), one(262, 1)
    checked(w, h)
    if set(tags.get(258, [1])) != {8} or one(284, 1) != 1 or one(317, 1) not in (1, 2) or 273 not in tags or 279 not in tags:
        raise Malformed("UnsupportedFormat", "Unsupported media format: tiff other than strips of 8 bits a sample")
    unpack = {1: bytes, 32773: _unpack_bits, 8: zlib.decompress, 32946: zlib.decompress}.get(packing)
    if unpack is None:
        raise Malformed("UnsupportedFormat", f"Unsupported media format: tiff of compression {packing}")
    try:
        body = b"".join(unpack(data[a : a + n]) for a, n in zip(tags[273], tags[279], strict=False))
    except zlib.error as e:
        raise broken(f"TIFF strip: {e}") from None
    if len(body) < w * h * c:
        raise broken("TIFF strips shorter than the image")
    pixels = np.frombuffer(body[: w * h * c], np.uint8).reshape(h, w, c)
    if one(317, 1) == 2:
        pixels = np.cumsum(pixels, axis=1, dtype=np.uint8)
    if meaning == 0:
        return 255 - pixels
    if meaning == 3 and len(tags.get(320, ())) >= 768:
        colours = (np.array(tags[320][:768]).reshape(3, 256).T >> 8).astype(np.uint8)
        return colours[pixels[:, :, 0]]
    return pixels


# JPEG

_AXIS = np.arange(8)
#: Rows: frequencies; columns: places.
_WAVES = np.cos((2 * _AXIS[None, :] + 1) * _AXIS[:, None] * np.pi / 16) * np.where(_AXIS[:, None] == 0, np.sqrt(1 / 8), 0.5)
#: Place in a block, row by row, of each coefficient along the diagonals.
_DIAGONALS = np.array([y * 8 + x for y, x in sorted(((y, x) for y in range(8) for x in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))])


def _codes(body: bytes) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By class and number of a table: value and width of the code that any 16 bits begin with."""
    out, at = {}, 0
    while at + 17 <= len(body):
        counts = body[at + 1 : at + 17]
        values = body[at + 17 : at + 17 + sum(counts)]
        value, width, code, k = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.uint8), 0, 0
        for n, count in enumerate(counts, 1):
            for _ in range(count):
                first = code << 16 - n
                if first >= 1 << 16 or k >= len(values):
                    raise broken("JPEG code table too full")
                value[first : first + (1 << 16 - n)], width[first : first + (1 << 16 - n)] = values[k], n
                code, k = code + 1, k + 1
            code <<= 1
        out[body[at]] = value.tolist(), width.tolist()
        at += 17 + sum(counts)
    return out


class _Bits:
    """Bits of a scan without stuffing."""

    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.have = data, 0, 0, 0

    def fill(self) -> None:
        """Zeros follow the data."""
        more = self.data[self.at : self.at + 6].ljust(6, b"\0")
        self.at += 6
        self.held = (self.held & (1 << self.have) - 1) << 48 | int.from_bytes(more)
        self.have += 48
        if self.at > len(self.data) + 64:
            raise broken("JPEG scan ends early")

    def symbol(self, table: tuple[list[int], list[int]]) -> int:
        if self.have < 16:
            self.fill()
        ahead = self.held >> self.have - 16 & 0xFFFF
        n = table[1][ahead]
        if not n:
            raise broken("JPEG code outside its table")
        self.have -= n
        return table[0][ahead]

    def signed(self, n: int) -> int:
        if not n:
            return 0
        if self.have < n:
            self.fill()
        self.have -= n
        v = self.held >> self.have & (1 << n) - 1
        return v if v >> n - 1 else v - (1 << n) + 1


def decode_jpeg(data: bytes) -> np.ndarray:
    """Baseline and extended sequential Huffman images of one or three components; progressive ones aren't read."""
    quant, codes, frame, restart, adobe = {}, {}, None, 0, None
    walk, goto = jpeg_markers(data), None
    if data[:2] != b"\xff\xd8":
        raise broken("JPEG without its start")
    while True:
        try:
            marker, _, at = walk.send(goto)
        except StopIteration:
            raise broken("JPEG without a scan") from None
        goto = at
        if 0xD0 <= marker <= 0xD9:
            continue
        goto = at + int.from_bytes(data[at : at + 2])
        body = data[at + 2 : goto]
        if goto > len(data) or goto < at + 2:
            raise broken("JPEG segment beyond its file")
        if marker == 0xDB:
            k = 0
            while k < len(body):
                wide = body[k] >> 4
                raw = body[k + 1 : k + 1 + 64 * (1 + (wide > 0))]
                if len(raw) < 64 * (1 + (wide > 0)):
                    raise broken("JPEG quantisation table too short")
                quant[body[k] & 15] = np.frombuffer(raw, ">u2" if wide else np.uint8).astype(np.float64)
                k += 1 + len(raw)
        elif marker == 0xC4:
            codes |= _codes(body)
        elif marker in (0xC0, 0xC1):
            frame = body
        elif 0xC2 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
            raise Malformed("UnsupportedFormat", "Unsupported media format: jpeg other than sequential Huffman coding")
        elif marker == 0xDD:
            restart = int.from_bytes(body[:2])
        elif marker == 0xEE and body[:5] == b"Adobe" and len(body) >= 12:
            adobe = body[11]
        elif marker == 0xDA:
            break
    if frame is None or len(frame) < 6 or frame[0] != 8:
        raise broken("JPEG without a frame of 8 bits")
    h, w, count = int.from_bytes(frame[1:3]), int.from_bytes(frame[3:5]), frame[5]
    checked(w, h)
    if count not in (1, 3) or len(frame) < 6 + 3 * count or len(body) < 1 + 2 * count or body[0] != count:
        raise Malformed("UnsupportedFormat", f"Unsupported media format: jpeg of {count} components or several scans")
    parts = [(frame[6 + 3 * i], frame[7 + 3 * i] >> 4, frame[7 + 3 * i] & 15, frame[8 + 3 * i]) for i in range(count)]
    chosen = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(count)}
    if count == 1:
        parts = [(parts[0][0], 1, 1, parts[0][3])]
    try:
        tables = [(codes[chosen[i] >> 4], codes[0x10 | chosen[i] & 15], quant[q]) for i, _, _, q in parts]
    except KeyError:
        raise broken("JPEG scan without its tables") from None
    most_x, most_y = max(p[1] for p in parts), max(p[2] for p in parts)
    if not all(p[1] and p[2] and most_x % p[1] == 0 and most_y % p[2] == 0 for p in parts):
        raise Malformed("UnsupportedFormat", "Unsupported media format: jpeg of uneven sampling")
    across, down = -(-w // (8 * most_x)), -(-h // (8 * most_y))
    planes = [np.zeros((down * v, across * u, 64)) for _, u, v, _ in parts]
    pieces = _intervals(data[goto:])
    piece, bits, before = 0, _Bits(pieces[0]), [0] * count
    for m in range(across * down):
        if restart and m and m % restart == 0:
            piece += 1
            if piece >= len(pieces):
                raise broken("JPEG scan ends early")
            bits, before = _Bits(pieces[piece]), [0] * count
        my, mx = divmod(m, across)
        for i, (_, u, v, _) in enumerate(parts):
            dc, ac, _ = tables[i]
            for y in range(v):
                for x in range(u):
                    block = planes[i][my * v + y, mx * u + x]
                    before[i] += bits.signed(bits.symbol(dc) & 15)
                    block[0] = before[i]
                    k = 1
                    while k < 64:
                        s = bits.symbol(ac)
                        if not s & 15:
                            if s != 0xF0:
                                break
                            k += 16
                            continue
                        k += s >> 4
                        if k > 63:
                            raise broken("JPEG block too long")
                        block[k] = bits.signed(s & 15)
                        k += 1
    out = []
    for plane, (_, u, v, _), (_, _, q) in zip(planes, parts, tables, strict=True):
        grid = np.zeros_like(plane)
        grid[:, :, _DIAGONALS] = plane * q
        grid = grid.reshape(*plane.shape[:2], 8, 8)
        pixels = np.einsum("ky,abkl,lx->aybx", _WAVES, grid, _WAVES, optimize=True) + 128
        flat = pixels.reshape(plane.shape[0] * 8, plane.shape[1] * 8)
        out.append(np.repeat(np.repeat(flat, most_y // v, axis=0), most_x // u, axis=1)[:h, :w])
    if count == 1:
        found = out[0][:, :, None]
    elif adobe == 0:
        found = np.stack(out, axis=2)
    else:
        y, cb, cr = out[0], out[1] - 128, out[2] - 128
        found = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], axis=2)
    return np.clip(np.rint(found), 0, 255).astype(np.uint8)


def _intervals(scan: bytes) -> list[bytes]:
    """Data between restart markers, without stuffing, up to the next other marker."""
    out, at, start = [], 0, 0
    while True:
        at = scan.find(b"\xff", at)
        code = scan[at + 1] if 0 <= at < len(scan) - 1 else 0xD9
        if code == 0 or code == 0xFF:
            at += 2 if code == 0 else 1
            continue
        out.append(scan[start : len(scan) if at < 0 else at].replace(b"\xff\0", b"\xff"))
        if not 0xD0 <= code <= 0xD7:
            return out
        at = start = at + 2
