"""Container walks and rewrites on hand-made bytes."""

import zlib

import pytest

from blobscope.operators import exif, rewrite
from blobscope.operators import walkers as w

JPEG = b"\xff\xd8\xff\xe0\x00\x10JFIF\0\x01\x01\0\0\x01\0\x01\0\0\xff\xda\x00\x08\x01\x01\0\0\x3f\0" + b"123456" + b"\xff\xd9"


def chunk(kind, body):
    return len(body).to_bytes(4) + kind + body + zlib.crc32(kind + body).to_bytes(4)


PNG = w.PNG_SIGNATURE + chunk(b"IHDR", b"\0\0\0\x01\0\0\0\x01\x08\x02\0\0\0") + chunk(b"IEND", b"")


def test_jpeg_segments():
    p = w.parse_jpeg(b"\xff\xd8\xff\xe0\x00\x07JFIF\0\xff\xd9")
    assert [(x.marker, x.offset, x.length) for x in p.parts] == [(0xE0, 2, 9), (0xD9, 11, 2)] and p.end == 13


def test_jpeg_last_dimensions_padding_comment():
    sof = lambda h, v: b"\xff\xc0\x00\x0b\x08" + h.to_bytes(2) + v.to_bytes(2) + b"\x01\0\0\0"
    p = w.parse_jpeg(b"\xff\xd8\xff\xff\xfe\x00\x06 hi " + sof(5, 6) + sof(7, 8) + b"\xff\xd9")
    assert (p.height, p.width, p.comment) == (7, 8, "hi") and p.parts[0].offset == 3


def test_jpeg_without_end_counts_scan_as_overlay():
    p = w.parse_jpeg(JPEG[:-2])
    assert p.end == len(JPEG) - 2 - 6


def test_jpeg_errors():
    for data, code in ((b"\xff\xd8\xff\xe1\xfd\xe8abcdefgh", "TruncatedStructure"), (b"\xff\xd8\xff\xe1\0\x01", "CorruptedChunk"), (b"GIF", "InvalidSignature")):
        with pytest.raises(w.Malformed) as e:
            w.parse_jpeg(data)
        assert e.value.code == code


def test_png_text_time_crc():
    data = PNG[:33] + chunk(b"tEXt", b"k\0v") + chunk(b"iTXt", b"k\0\0\0en\0t\0u") + chunk(b"iTXt", b"z\0\1\0\0\0x") + chunk(b"tIME", b"\x07\xe6\x02\x03\x04\x05\x06") + PNG[33:] + b"tail"
    p = w.parse_png(data)
    assert p.text == [("k", "v"), ("k", "u")] and p.extra["modified"] == "2022-02-03 04:05:06" and p.end == len(data) - 4 and all(x.crc_valid for x in p.parts)
    broken = bytearray(PNG)
    broken[-1] ^= 1
    assert [x.crc_valid for x in w.parse_png(bytes(broken)).parts] == [True, False]


def test_png_overrun():
    with pytest.raises(w.Malformed) as e:
        w.parse_png(w.PNG_SIGNATURE + b"\xee\0\0\0iCCPshort")
    assert e.value.code == "TruncatedStructure"


def test_webp():
    body = b"WEBP" + b"VP8X" + (10).to_bytes(4, "little") + b"\0\0\0\0\x8f\x01\0\x2b\x01\0" + b"XMP " + (3).to_bytes(4, "little") + b"abc\0"
    p = w.parse_webp(b"RIFF" + len(body).to_bytes(4, "little") + body)
    assert (len(p.parts), p.width, p.height, p.xmp) == (2, 400, 300, "abc")
    assert w.parse_webp(b"RIFF\xff\xff\xff\xffWEBPVP8 \0\0\0\0").end == 2**32 + 7


def test_gif():
    p = w.parse_gif(b"GIF89a\x64\0\xc8\0\0\0\0!\xfe\x05hello\0;")
    assert [(x.name, x.offset, x.length) for x in p.parts] == [("Comment Extension", 13, 9), ("Trailer", 22, 1)] and (p.width, p.height, p.comment) == (100, 200, "hello")


def box(kind, body):
    return (8 + len(body)).to_bytes(4) + kind + body


def test_heic():
    ftyp = box(b"ftyp", b"heic\0\0\0\0mif1heic")
    p = w.parse_heic(ftyp + box(b"meta", b"\0\0\0\0" + box(b"iprp", box(b"ipco", box(b"ispe", b"\0\0\0\0\0\0\0\x05\0\0\0\x06") + box(b"ispe", b"\0\0\0\0\0\0\0\x07\0\0\0\x08")))))
    assert [x.name for x in p.parts] == ["ftyp", "meta", "iprp", "ipco", "ispe", "ispe"] and (p.width, p.height) == (5, 6)
    assert len(w.parse_heic(ftyp + b"\0\0\0\x01wide" + b"\0" * 8).parts) == 1  # a 64-bit box of no length ends the walk
    deep = b""
    for _ in range(100):
        deep = box(b"meta", b"\0\0\0\0" + deep)
    assert w.parse_heic(ftyp + deep).warnings


def test_heic_exif_item():
    tiff = exif.build([(0x010F, 2, "Maker")])
    infe = box(b"infe", b"\2\0\0\0\0\x07\0\0Exif\0")
    iinf = box(b"iinf", b"\0\0\0\0\0\1" + infe)
    item = b"\0\0\0\0" + tiff
    ftyp = box(b"ftyp", b"heic\0\0\0\0mif1heic")
    place = len(ftyp) + 12 + len(iinf) + 8 + 8 + 14
    iloc = box(b"iloc", b"\0\0\0\0\x44\0\0\1\0\x07\0\0\0\1" + place.to_bytes(4) + len(item).to_bytes(4))
    p = w.parse_heic(ftyp + box(b"meta", b"\0\0\0\0" + iinf + iloc) + item)
    assert exif.wide(exif.read(p.exif))["camera_make"] == "Maker"


def test_scan_stream():
    assert w.scan_stream(b"\xff\xda\0\4aaHE\xff\0L\xff\xd0P\xff\xd9x") == b"HE\xffLP"
    assert w.scan_stream(b"\xff\xd8\xff\xda") == b"" == w.scan_stream(b"\xff\xda\xff\xffab") and w.scan_stream(b"\xff\xda\0\2" + b"\xff" * 5000) == b""


def test_comments_set_replace_delete_overlay():
    one = rewrite.set_jpeg_comment(JPEG + b"x" * 32, "one")
    two = rewrite.set_jpeg_comment(one, "two")
    assert w.jpeg_comments(one) == ["one"] and w.jpeg_comments(two) == ["two"] and rewrite.set_jpeg_comment(two, "") == JPEG + b"x" * 32
    assert rewrite.cut_overlay(two) == two[:-32] and rewrite.scrub(two) == JPEG
    with pytest.raises(w.Malformed) as e:
        rewrite.set_jpeg_comment(JPEG, "a" * 70000)
    assert e.value.code == "SegmentOverflow"
    with pytest.raises(w.Malformed):
        rewrite.set_jpeg_comment(b"\xff\xd8\xff\xfe\0\x50", "a")


def test_scrub_keeps_other_segments_unless_strict():
    data = JPEG[:20] + b"\xff\xe5\0\4ab" + b"\xff\xe1\0\4cd" + JPEG[20:]
    assert rewrite.scrub(data) == JPEG[:20] + b"\xff\xe5\0\4ab" + JPEG[20:] and rewrite.scrub(data, strict=True) == JPEG


def test_png_text_set_replace_delete():
    one = rewrite.set_png_text(PNG + b"over", "Key", "a")
    two = rewrite.set_png_text(one, "Key", "b")
    assert w.png_texts(one) == [("Key", "a")] and w.png_texts(two) == [("Key", "b")] and rewrite.set_png_text(two, "Key", "") == PNG + b"over"
    assert rewrite.cut_overlay(PNG + b"over") == PNG and rewrite.scrub(two) == PNG
    for key in ("", "k" * 80):
        with pytest.raises(w.Malformed):
            rewrite.set_png_text(PNG, key, "x")


def test_exif_record():
    block = exif.build([(0x010F, 2, '"NIKON"'), (0x0112, 3, [6])], [(0x829D, 5, [(59, 10)]), (0x8827, 3, [103]), (0x829A, 5, [(1, 40)])], [(1, 2, "N"), (2, 5, [(43, 1), (28, 1), (281400000, 100000000)]), (3, 2, "W"), (4, 5, [(11, 1), (52, 1), (4536, 100)]), (5, 1, [1]), (6, 5, [(6395879, 10000)]), (7, 5, [(14, 1), (27, 1), (724, 100)])])
    e = exif.wide(exif.read(block))
    assert (e["camera_make"], e["orientation"], e["iso"], e["exposure_time"]) == ("NIKON", 6, 103, "1/40") and round(e["f_number"], 3) == 5.9
    g = e["gps"]
    assert round(g["latitude"], 6) == 43.467448 and round(g["longitude"], 4) == -11.8793 and round(g["altitude"], 3) == -639.588 and g["time_stamp"] == "14:27:07.24Z"
    assert exif.read(b"junk") == [] and exif.wide([])["gps"] is None
    assert exif.dms_to_decimal(float("nan"), 1, 1, False) == 0.0


def test_exif_many_entries_and_long_values():
    rows = b"".join((0x9000 + k % 99).to_bytes(2, "little") + b"\x03\0\x01\0\0\0\x07\0\0\0" for k in range(5000))
    assert len(exif.read(b"II*\0\x08\0\0\0" + (5000).to_bytes(2, "little") + rows)) == 5000
    n = (1 << 20) + 1
    note = b"II*\0\x08\0\0\0\x01\0" + b"\x7c\x92\x07\0" + n.to_bytes(4, "little") + (26).to_bytes(4, "little") + b"\0\0\0\0" + b"m" * n
    assert [(t.tag, t.count) for t in exif.read(note)] == [(0x927C, n)] and exif.read(note[:-1]) == []
