"""Column functions against known values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from blobscope import dims
from blobscope.functions import detect, dsp, geo, patterns, safety, stats
from blobscope.operators import codecs, udfs


def one(spark, value, kind, f):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


def hist(spark, data):
    return spark.createDataFrame([(bytearray(data),)], "b binary").select(stats.byte_histogram("b").alias("h"))


@pytest.mark.parametrize(("data", "expected"), [(b"", 0.0), (b"\0" * 100, 0.0), (bytes(range(256)), 8.0)])
def test_entropy(spark, data, expected):
    assert math.isclose(hist(spark, data).select(stats.entropy(F.col("h"))).first()[0], expected, abs_tol=1e-9)


def test_chi_square_and_pairs(spark):
    x = lambda d: hist(spark, d).select(stats.chi_square(F.col("h")).alias("c"), stats.chi_square_p(stats.chi_square(F.col("h")), 255).alias("p"), stats.pairs_of_values(F.col("h")).alias("v"), stats.ascii_ratio(F.col("h")).alias("a")).first()
    flat, same = x(bytes(range(256)) * 100), x(b"A" * 1000)
    assert flat["c"] < 1e-6 and flat["p"] > 0.99 and flat["v"]["stat"] < 1e-6 and flat["v"]["df"] == 127
    assert same["c"] == 255000 and same["p"] < 0.001 and same["a"] == 1.0
    assert x(b"")["v"]["df"] == 0


def test_findings(spark):
    f = lambda n, p: spark.createDataFrame([(n, p)], "n long, p double").select(stats.comment_findings(F.col("n"), F.col("p"))).first()[0]
    assert f(10, 0.0) == [] and [x["severity"] for x in f(300, 0.4)] == ["Low", "Medium"]


def test_detect(spark):
    for data, kind in ((b"\xff\xd8\xff", "jpeg"), (b"\x89PNG\r\n\x1a\n", "png"), (b"RIFF0000WEBP", "webp"), (b"GIF87a", "gif"), (b"0000ftypmif1", "heic"), (b"0000ftypqt  ", None), (b"", None)):
        assert one(spark, bytearray(data), "binary", detect.container) == kind
    assert [one(spark, p, "string", detect.extension) for p in ("/a.b/c", "/a/b.TXT", ".png", "x.tar.gz")] == [None, "txt", None, "gz"]


def test_safety(spark):
    for text in ("=1", "+1", "-1", "@x", " =1", "\t=1"):
        assert one(spark, text, "string", safety.escape_formula) == "'" + text
    assert one(spark, "fine", "string", safety.escape_formula) == "fine"
    s = lambda x: one(spark, x, "string", safety.scrub_terminal)
    assert s("\x1b[2JNormal Image\x1b[31mSYSTEM COMPROMISED\x1b[0m Photo") == "Normal ImageSYSTEM COMPROMISED Photo"
    assert s("Click here: \x1b]8;;http://e.x\x07Phishing Link\x1b]8;;\x07") == "Click here: Phishing Link" and s("a\tb\n\x1bc\x01\x1b]open") == "a\tb\nc"


def test_patterns(spark):
    for name, good, bad in (("email", "a.b@c.de", "a@b"), ("ipv4", "255.1.2.3", "256.1.1.1"), ("mac", "00:1A:2b:3c:4d:5e", "00:1A"), ("uuid", "123e4567-e89b-12d3-a456-426614174000", "123"), ("semver", "1.2.3-a+b", "01.2.3"), ("url", "https://a.bc/d?e=f", "ftp://a"), ("domain", "a-b.example.com", "nodot"), ("base64", "QUJD", "QUJ"), ("date_iso", "2024-02-30", "2024-13-01")):
        assert one(spark, good, "string", lambda c, n=name: patterns.matches(c, n)) and not one(spark, bad, "string", lambda c, n=name: patterns.matches(c, n))
    assert [one(spark, x, "string", patterns.luhn_valid) for x in ("4532 0151 1283 0366", "4532015112830367", "7", None)] == [True, False, False, None]
    assert len(patterns.PATTERNS) == 37


def test_geo(spark):
    d = lambda a, b, c, ref: spark.createDataFrame([(a, b, c, ref)], "a double, b double, c double, r string").select(geo.dms_with_ref(*(F.col(x) for x in "abcr"))).first()[0]
    assert round(d(37.0, 48.0, 36.12, "N"), 6) == 37.810033 and round(d(122.0, 24.0, 15.0, " w "), 6) == -122.404167 and d(float("nan"), 1.0, 1.0, "N") == 0.0 and d(10.0, 0.0, 0.0, "?") == 10
    assert one(spark, 2835.0, "double", geo.ppu_to_dpi) == 72.0


def test_dsp(spark):
    a = lambda x, f: one(spark, x, "array<float>", f)
    assert a([1.0, -1.0, 0.5, 0.5, 9.0], lambda c: dsp.downmix(c, 2)) == [0.0, 0.5] and a([0.5, -0.5], dsp.upmix) == [0.5, 0.5, -0.5, -0.5]
    assert np.allclose(a([0.0, 0.2, 0.4, 0.6, 0.8, 1.0], lambda c: dsp.resample(c, 1, 48000, 24000)), [0, 0.4, 0.8])
    assert np.allclose(a([0.5, -0.25, 0.1], lambda c: dsp.normalize(c, 1.0)), [1, -0.5, 0.2]) and a([0.0], dsp.normalize) == [0.0]
    assert a([0.5, -0.9], lambda c: dsp.gain(c, 2.0)) == [1.0, -1.0] and a([], lambda c: dsp.downmix(c, 2)) == [] and a([], lambda c: dsp.resample(c, 2, 8, 4)) == []


def test_signatures():
    hit = lambda d: [(x["name"], x["offset"]) for x in udfs.signature_hits(d, len(d))]
    assert hit(b"\0" * 32 + b"PK\x03\x04name") == [("ZIP Archive", 32)] and hit(b"plain text with MZ inside of it, no header") == []
    assert {n for n, _ in hit(b"\xff\xd8\xff\xe0\x00\x10JFIF\0\1\1<?php system('x');")} == {"PHP Script Block", "Suspicious System Execution Call"}
    assert udfs.signature_hits(b"abc", 1)[0]["length"] == 2


def test_codecs():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 256, (13, 17, 3), np.uint8)
    assert (codecs.decode_png(codecs.encode_png(x)) == x).all() and (codecs.decode_bmp(codecs.encode_bmp(x)) == x).all()
    assert codecs.resize(np.full((8, 8, 3), 77, np.uint8), 5, 3).tolist() == np.full((3, 5, 3), 77).tolist()
    for name, magic in (("jpeg", b"\xff\xd8\xff"), ("gif", b"GIF89a"), ("tiff", b"II*\0"), ("bmp", b"BM")):
        assert codecs.transcode_image(codecs.encode_png(x), "png", name).startswith(magic)
    s = np.sin(np.arange(960) * 0.1).astype(np.float32)
    back = codecs.decode_wav(codecs.encode_wav(s, 48000, 2))
    assert back.rate == 48000 and back.channels == 2 and np.abs(back.samples - s).max() < 1e-4
    half = codecs.decode_wav(codecs.convert_audio(codecs.encode_wav(s, 44100, 2), rate=22050, channels=1))
    assert half.rate == 22050 and half.channels == 1 and len(half.samples) == 240
    from blobscope.operators.walkers import Malformed

    for bad in (lambda: codecs.convert_audio(codecs.encode_wav(s, 8000, 1), channels=0), lambda: codecs.convert_audio(codecs.encode_wav(s, 8000, 1), channels=99), lambda: codecs.transcode_image(codecs.encode_png(x)[:60], "png", "bmp"), lambda: codecs.transcode_image(b"", "png", "bmp"), lambda: codecs.transcode_image(codecs.encode_png(x), "png", "bmp", size=(100000, 100000)), lambda: codecs.transcode_image(codecs.encode_png(x), "png", "webp")):
        with pytest.raises(Malformed):
            bad()


def test_written_images_are_read_by_the_image_source(spark, tmp_path):
    y, x = np.mgrid[0:32, 0:40]
    img = np.stack([x * 6, y * 7, (x + y) * 3], axis=2).astype(np.uint8)
    for name in ("jpeg", "gif", "png", "bmp"):
        (tmp_path / f"a.{name}").write_bytes(codecs.transcode_image(codecs.encode_png(img), "png", name, quality=95))
    rows = spark.read.format("image").load(str(tmp_path)).select("image.*").collect()
    assert len(rows) == 4
    for r in rows:
        got = np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], r["nChannels"])[:, :, 2::-1].astype(int)
        limit = {"jpeg": 12, "gif": 30}.get(r["origin"].rpartition(".")[2], 0)
        assert np.abs(got - img).max() <= limit, r["origin"]


def test_dims(spark):
    assert sum(map(len, dims.TAGS.values())) == dims.tags(spark).count() and dims.TAGS["gps"][2] == "GPS Latitude"
