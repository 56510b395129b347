"""Decoders, headers, encoder arguments, reports of single blobs and conversions of pipes and folders."""

from __future__ import annotations

import json
import stat
import struct
import zlib

import numpy as np
import pytest

from blobscope.operators import codecs, describe, headers, readers, tools
from blobscope.operators.walkers import Malformed
from blobscope.plans import convert, reports, sqlapi
from blobscope.sources import files as sources

Y, X = np.mgrid[0:61, 0:83]
SMOOTH = np.stack([X * 3, Y * 4, X + Y], 2).clip(0, 255).astype(np.uint8)
CHESS = np.where((X + Y)[..., None] % 2, np.uint8(255), np.uint8(0)).repeat(3, 2)


@pytest.mark.parametrize("kind", ["png", "bmp", "tiff"])
def test_lossless(kind):
    assert (codecs.DECODERS[kind](codecs.ENCODERS[kind](SMOOTH)) == SMOOTH).all()


def test_lossy():
    back = codecs.transcode_image(codecs.encode_jpeg(SMOOTH, 95), "jpeg", "png")
    assert np.abs(codecs.decode_png(back).astype(int) - SMOOTH).max() <= 3
    assert (readers.decode_gif(codecs.encode_gif(CHESS)) == CHESS).all()
    noise = np.random.default_rng(1).integers(0, 256, (200, 120, 3)).astype(np.uint8)  # fills the code table many times
    assert np.abs(readers.decode_gif(codecs.encode_gif(noise)).astype(int) - noise).max() <= 26


def test_against_another_library(spark):
    """Files that Java's image library writes (JPEG with sampled colours, interlaced GIF) read as it reads them."""
    jvm = spark.sparkContext._jvm
    image = jvm.java.awt.image.BufferedImage(83, 61, 1)
    for y in range(61):
        for x in range(83):
            r, g, b = map(int, SMOOTH[y, x])
            image.setRGB(x, y, r << 16 | g << 8 | b)
    for name, kind, off in (("jpg", "jpeg", 6), ("gif", "gif", 0), ("tiff", "tiff", 0)):
        out = jvm.java.io.ByteArrayOutputStream()
        jvm.javax.imageio.ImageIO.write(image, name, out)
        read = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(out.toByteArray()))
        want = np.array([[[read.getRGB(x, y) >> s & 255 for s in (16, 8, 0)] for x in range(0, 83, 7)] for y in range(0, 61, 7)])
        got = codecs.DECODERS[kind](bytes(out.toByteArray()))[::7, ::7].astype(int)
        assert np.abs(got - want).max() <= off, kind


def tiff(strip: bytes, packing: int, predictor: int = 1, meaning: int = 2) -> bytes:
    rows = [(256, 4), (257, 2), (258, 8), (259, packing), (262, meaning), (273, 8), (277, 3), (279, len(strip)), (317, predictor)]
    return struct.pack(">2sHI", b"MM", 42, 8 + len(strip)) + strip + struct.pack(">H", len(rows)) + b"".join(struct.pack(">HHII", t, 4, 1, v) for t, v in rows) + b"\0\0\0\0"


def test_tiff_forms():
    pixels = np.arange(24, dtype=np.uint8).reshape(2, 4, 3)
    raw = pixels.tobytes()
    assert (readers.decode_tiff(tiff(raw, 1)) == pixels).all() and (readers.decode_tiff(tiff(zlib.compress(raw), 8)) == pixels).all()
    assert (readers.decode_tiff(tiff(b"\x17" + raw, 32773)) == pixels).all() and (readers.decode_tiff(tiff(b"\xe9\x07\x80", 32773)) == 7).all()
    steps = np.diff(pixels, axis=1, prepend=0).astype(np.uint8).tobytes()
    assert (readers.decode_tiff(tiff(steps, 1, predictor=2)) == pixels).all()
    for bad in (tiff(raw, 5), tiff(raw[:9], 1), tiff(b"junk", 8), b"II*\0", b""):
        with pytest.raises(Malformed):
            readers.decode_tiff(bad)


@pytest.mark.parametrize("kind", ["jpeg", "gif", "tiff"])
def test_damage_is_typed(kind):
    """Cut and altered files give pixels or a typed error."""
    good = codecs.encode_jpeg(SMOOTH, 80) if kind == "jpeg" else codecs.ENCODERS[kind](SMOOTH)
    rng = np.random.default_rng(2)
    for i in range(60):
        bad = bytearray(good[: rng.integers(1, len(good))] if i % 2 else good)
        for at in rng.integers(0, min(len(bad), 700), 3):
            bad[at] = rng.integers(0, 256)
        try:
            codecs.DECODERS[kind](bytes(bad))
        except (Malformed, ArithmeticError, LookupError, ValueError, TypeError):  # those that udfs.struct_udf turns into rows
            pass


def test_headers():
    for empty in (b"fLaC", b"OggS", b"FORM\0\0\0\0AIFF", b"\0\0\0\x08ftyp", b"\x1a\x45\xdf\xa3", b"ID3", b"II*\0"):
        with pytest.raises(Malformed):
            headers.probe(empty)
    assert headers.probe(b"plain") is None
    frame = b"\xff\xfb\x90\xc0" + b"\0" * 413
    assert headers.probe(frame * 100) | {} == {"audio_tracks": 1, "video_tracks": 0, "format": "mp3", "codec": "mp3", "sample_rate": 44100, "channels": 1, "duration_secs": 41700 / 16000, "media_type": "Audio"}


def test_encoder_arguments(tmp_path, monkeypatch):
    a = tools.arguments
    o = tools.Options(rate=22050, channels=1, gain=0.5, normalize=True)
    assert a("video", "ogg", "audio", o) == "-vn -c:a libvorbis -q:a 5 -ar 22050 -ac 1 -filter:a volume=0.50,loudnorm=I=-16:TP=-1.5:LRA=11".split()
    assert a("video", "mp4", "video", tools.Options(crf=18, fps=25)) == "-c:v libx264 -preset fast -crf 18 -c:a aac -b:a 160k -movflags +faststart -r 25".split()
    assert a("video", "mkv", "video", tools.Options(copy=True)) == ["-c", "copy"]
    assert a("video", "gif", "image", tools.Options(size=(3, 2)))[1].startswith("fps=10,scale=3:2:flags=lanczos,split")
    for pair in (("image", "mp4", "video"), ("audio", "png", "image"), ("audio", "xyz", "audio")):
        with pytest.raises(Malformed):
            a(*pair, o)
    with pytest.raises(Malformed, match="has not"):
        tools.convert(b"x", "mp3", "audio", "flac", "audio", tool="no-such-encoder")
    # a stand-in that turns its input round, one that fails and one that doesn't end
    for name, body in (("turn", 'for last; do :; done; rev "$4" > "$last"'), ("fail", "echo no codec >&2; exit 3"), ("hang", "exec sleep 60")):
        (tmp_path / name).write_text(f"#!/bin/sh\n{body}\n")
        (tmp_path / name).chmod(stat.S_IRWXU)
    monkeypatch.setenv("PATH", f"{tmp_path}:/usr/bin:/bin")
    assert tools.convert(b"abc", "mp3", "audio", "flac", "audio", tool="turn").strip() == b"cba"
    with pytest.raises(Malformed, match="no codec"):
        tools.convert(b"abc", "mp3", "audio", "flac", "audio", tool="fail")
    with pytest.raises(Malformed, match="longer than"):
        tools.convert(b"abc", "mp3", "audio", "flac", "audio", seconds=1, tool="hang")


def test_pairs_and_streams():
    p = convert.plan_pairs
    assert p(["a.png", "b.jpg"]) == [("a.png", "b.jpg")] and p(["a.png"], "o/b.gif") == [("a.png", "o/b.gif")] and p(["x/a.tar.png"], target="bmp") == [("x/a.tar.png", "x/a.tar.bmp")]
    assert p(["x/a.png", "y/b.png"], target="gif") == [("x/a.png", "./a.gif"), ("y/b.png", "./b.gif")] and p(["x/a.png"], "out", "gif", output_is_folder=True) == [("x/a.png", "out/a.gif")]
    with pytest.raises(Malformed):
        p(["a", "b", "c"])
    out, report = convert.convert_stream(codecs.encode_bmp(SMOOTH), ".PNG")
    assert (codecs.decode_png(out) == SMOOTH).all() and report["output_bytes"] == len(out) and report["input_path"] == "<stdin>"
    sound, _ = convert.convert_stream(codecs.encode_wav([0.1, 0.3, 0.2, 0.4], 8000, 2), "mp4", channels=1)
    assert codecs.decode_wav(sound).channels == 1
    for bad, goal in ((b"", "png"), (b"junk", "png"), (b"junk", "wav")):
        with pytest.raises(Malformed):
            convert.convert_stream(bad, goal)
    assert json.loads(convert.convert_report(report, as_json=True)) == report and "\x1b" not in convert.convert_report({"a": "\x1b[2J"})


def test_single_blobs_agree(spark):
    """The reports that SQL calls on single blobs state what the reports over tables state."""
    from blobscope.operators.exif import build
    from tests.test_walkers import JPEG, PNG

    block = build([(0x010F, 2, "Maker"), (0x0131, 2, "Soft")], [(0x829D, 5, [(28, 10)]), (0x8827, 3, [200]), (0x920A, 5, [(50, 1)])], [(1, 2, "S"), (2, 5, [(10, 1), (30, 1), (0, 1)]), (3, 2, "E"), (4, 5, [(20, 1), (0, 1), (0, 1)]), (6, 5, [(25, 10)])])
    head = b"\xff\xd8\xff\xe1" + struct.pack(">H", len(block) + 8) + b"Exif\0\0" + block
    rows = [("a.jpg", JPEG), ("b.png", PNG), ("c.jpg", head + JPEG[2:] + b"PK\x03\x04tail"), ("d.gif", codecs.encode_gif(SMOOTH)), ("e.png", b"junk"), ("f.txt", b"junk")]
    files = spark.createDataFrame([(p, bytearray(b)) for p, b in rows], "path string, content binary")
    scans, audits = ({r["path"]: json.loads(r["json"]) for r in f(files).collect()} for f in (sqlapi.scan_json, sqlapi.audit_json))
    for path, content in rows:
        assert describe.scan(content, path) == scans[path], path
        one, many = describe.audit(content, path), audits[path]
        assert one["entropy"] == pytest.approx(many["entropy"]) and all(one[k] == many[k] for k in ("container", "overlay", "payloads")), path
        if one["steganalysis"]:
            assert all(many["steganalysis"][k] == pytest.approx(v) for k, v in one["steganalysis"].items())
    assert len(scans["c.jpg"]["metadata"]) > 9 and audits["c.jpg"]["payloads"]


def test_batch_written(spark, tmp_path):
    wav = codecs.encode_wav([0.1, 0.2], 8000, 1)
    files = spark.createDataFrame([("/in/x/a.wav", bytearray(wav)), ("/in/b.png", bytearray(codecs.encode_png(SMOOTH))), ("/in/c.png", bytearray(b"junk"))], "path string, content binary")
    b = reports.Batch("/in", "/out", "", external=False)
    done = convert.write_batch(files, b, str(tmp_path / "root"), str(tmp_path / "staging"))
    assert {r["path"]: r["status"] for r in done.collect()} == {"/in/x/a.wav": "converted", "/in/b.png": "converted", "/in/c.png": "failed"}
    assert sorted(r["path"].rpartition("/root")[2] for r in sources.list_files(spark, str(tmp_path / "root")).collect()) == ["/out/b.png", "/out/x/a.wav"]
    assert json.loads(convert.batch_report(done, as_json=True))["failed"] == 1
    assert convert.text_table(spark.range(1500).toDF("n"), ["n"]).count("\n") == 1501
