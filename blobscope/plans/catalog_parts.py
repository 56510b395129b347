"""More queries of the catalog: metadata segments and chunks of each container, movement records, verdicts,
validators, headers of sound and video, pixels through each codec, and files written and listed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import detect, geo, patterns, stats
from ..operators import tools, udfs
from ..sources import carriers as c
from ..sources import files as sources
from ..sources import sink
from . import catalog, convert, export, reports, sqlapi
from .catalog import _DOC_BYTES, _E, _JPEG, _pcm_sql, _scratch, col, jpeg_files, png_files, query, r, table

_XMP = b"http://ns.adobe.com/xap/1.0/\0"


def parsed_as(d: DataFrame, name: str, content: Column, *keys: str) -> DataFrame:
    return reports.parsed(d.select(*keys, F.lit(name).alias("path"), content.alias("content")))


# Metadata in containers.


def orientation_block(k: Column) -> Column:
    """A TIFF block that holds an orientation alone."""
    return F.concat(c.raw(b"II*\0\x08\0\0\0\x01\0"), c.tiff_entry(0x0112, 3, 1, F.concat(c.le(k, 2), c.raw(b"\0\0"))), c.raw(b"\0\0\0\0"))


@query("SELECT c_custkey, CAST(c_custkey % 8 + 1 AS INT) AS orientation, '<x>' || c_name || '</x>' AS xmp, 'note ' || c_mktsegment AS comment FROM customer")
def jpeg_app1(spark, sf):
    """EXIF and XMP in application segments of one marker; XMP and comments are trimmed."""
    exif = c.jpeg_segment(0xE1, F.concat(c.raw(b"Exif\0\0"), orientation_block(col("c_custkey") % 8 + 1)))
    xmp = c.jpeg_segment(0xE1, F.concat(c.raw(_XMP), c.utf8(F.concat(F.lit("\n <x>"), col("c_name"), F.lit("</x> \n")))))
    note = c.jpeg_segment(0xFE, c.utf8(F.concat(F.lit(" note "), col("c_mktsegment"), F.lit(" "))))
    p = parsed_as(table(spark, sf, "customer"), "a.jpg", c.jpeg(c.app0(), exif, xmp, c.jpeg_segment(0xE1, c.raw(b"other")), note, scan=c.raw(b"0")), "c_custkey")
    return p.select("c_custkey", "p.exif.orientation", "p.xmp", "p.comment")


@query("""SELECT p_partkey, CAST(p_size AS INT) AS palette, p_name AS title, 'ICC ' || p_brand AS profile, [8, p_size % 8, 1] AS bits, CAST(CASE p_partkey % 3 WHEN 0 THEN p_size % 256 END AS BIGINT) AS back_palette, CASE p_partkey % 3 WHEN 1 THEN p_partkey % 65536 END AS back_gray, CAST(CASE p_partkey % 3 WHEN 2 THEN p_size * 3 END AS BIGINT) AS back_green,
CAST(-p_partkey AS BIGINT) AS offset_x, CAST(p_size AS BIGINT) AS offset_y, CAST(1 AS INT) AS scale_unit, ['1.' || p_size, '2.5'] AS scale, CAST(1 AS INT) AS texts FROM part""")
def png_ancillary(spark, sf):
    """Palette, international text (the compressed one is left out), profile, bits, the three forms of a background,
    offset and scale."""
    k, size = col("p_partkey"), col("p_size")
    text = F.concat(c.raw(b"Title\0\0\0en\0Titel\0"), c.utf8(col("p_name")))
    back = F.when(k % 3 == 0, c.be(size % 256, 1)).when(k % 3 == 1, c.be(k % 65536, 2)).otherwise(F.concat(c.be(size, 2), c.be(size * 3, 2), c.be(size, 2)))
    made = c.png(
        c.png_chunk(b"IHDR", c.ihdr(F.lit(1), F.lit(1))), c.png_chunk(b"PLTE", F.expr("unhex(repeat('010203', cast(p_size as int)))")), c.png_chunk(b"iTXt", text), c.png_chunk(b"iTXt", c.raw(b"Packed\0\x01\0\0\0xyz")),
        c.png_chunk(b"iCCP", F.concat(c.utf8(F.concat(F.lit("ICC "), col("p_brand"))), c.raw(b"\0\0zip"))), c.png_chunk(b"sBIT", F.concat(c.raw(b"\x08"), c.be(size % 8, 1), c.raw(b"\x01"))), c.png_chunk(b"bKGD", back),
        c.png_chunk(b"oFFs", F.concat(c.be((F.lit(1 << 32) - k) % F.lit(1 << 32), 4), c.be(size, 4), c.raw(b"\0"))), c.png_chunk(b"sCAL", F.concat(c.raw(b"\x01"), c.utf8(F.concat(F.lit("1."), size.cast("string"))), c.raw(b"\x002.5"))),
    )
    extra = "palette_entries int, icc_profile string, significant_bits array<int>, background struct<palette: bigint, gray: bigint, green: bigint>, offset_x bigint, offset_y bigint, scale_unit int, scale array<string>"
    p = parsed_as(table(spark, sf, "part"), "a.png", made, "p_partkey").select("p_partkey", "p.text", F.from_json("p.extra", extra).alias("x"))
    return p.select("p_partkey", col("x.palette_entries").alias("palette"), col("text")[0]["value"].alias("title"), col("x.icc_profile").alias("profile"), col("x.significant_bits").alias("bits"), col("x.background.palette").alias("back_palette"), col("x.background.gray").alias("back_gray"), col("x.background.green").alias("back_green"), "x.offset_x", "x.offset_y", "x.scale_unit", "x.scale", F.size("text").alias("texts"))


@query("SELECT item_id, trim(text, ' \n\t\r') AS xmp, CAST(NULL AS VARCHAR) AS comment FROM benchmark")
def gif_xmp(spark, sf):
    """The whole text as XMP of an application extension, over as many sub-blocks as it takes."""
    body = c.gif_extension(0xFF, F.concat(c.raw(b"XMP DataXMP"), c.utf8(F.concat(F.lit(" "), col("text")))))
    return parsed_as(table(spark, sf, "benchmark"), "a.gif", c.gif(F.lit(1), F.lit(1), body), "item_id").select("item_id", "p.xmp", "p.comment")


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE CAST(c_custkey % 8 + 1 AS INT) END AS orientation, CASE WHEN c_custkey % 5 = 0 THEN 3 ELSE 4 END AS boxes FROM customer")
def heic_exif(spark, sf):
    """The Exif item: its id from iinf, its place from iloc, its block behind a header offset; none without iinf."""
    k = col("c_custkey")
    item = (k % 60000 + 1).cast("long")
    block = orientation_block(k % 8 + 1)
    infe = c.box(b"infe", c.raw(b"\x02\0\0\0"), c.be(item, 2), c.raw(b"\0\0"), c.raw(b"Exif\0"))
    iinf = c.box(b"iinf", c.raw(b"\0\0\0\0\0\x01"), infe)
    payload = F.concat(c.raw(b"\0\0\0\x06Exif\0\0"), block)
    with_items = k % 5 != 0
    items = F.when(with_items, iinf).otherwise(c.raw(b""))
    # ftyp 24, meta 12, iinf, iloc 30, then the payload in mdat
    place = F.lit(24 + 12 + 30 + 8) + F.octet_length(items)
    iloc = c.box(b"iloc", c.raw(b"\0\0\0\0\x44\0\0\x01"), c.be(item, 2), c.raw(b"\0\0\0\x01"), c.be(place, 4), c.be(F.octet_length(payload), 4))
    made = F.concat(c.box(b"ftyp", c.raw(b"heic\0\0\0\0mif1heic")), c.box(b"meta", c.raw(b"\0\0\0\0"), items, iloc), c.box(b"mdat", payload))
    p = parsed_as(table(spark, sf, "customer"), "a.heic", made, "c_custkey")
    # ftyp, meta, iinf or not, iloc; mdat isn't counted
    return p.select("c_custkey", "p.exif.orientation", F.size(F.filter("p.parts", lambda x: x["name"] != "mdat")).alias("boxes"))


@query("""SELECT vec_id, form, CAST(CASE form WHEN 'VP8X' THEN vec_id % 16000 + 1 WHEN 'VP8 ' THEN vec_id % 16384 ELSE vec_id % 16384 + 1 END AS BIGINT) AS width, CAST(CASE form WHEN 'VP8X' THEN 501 WHEN 'VP8 ' THEN 500 ELSE 501 END AS BIGINT) AS height, CAST(vec_id % 8 + 1 AS INT) AS orientation
FROM (SELECT vec_id, list_element(['VP8X', 'VP8 ', 'VP8L'], CAST(vec_id % 3 + 1 AS INT)) AS form FROM embeddings)""")
def webp_sizes(spark, sf):
    """The three forms of a size, and EXIF with a leading Exif header."""
    k = col("vec_id")
    form = F.element_at(F.array(*(F.lit(x) for x in ("VP8X", "VP8 ", "VP8L"))), (k % 3 + 1).cast("int"))
    lossless = F.concat(c.raw(b"\x2f"), c.le((k % 16384) + F.lit(500 << 14), 4))
    made = (
        F.when(k % 3 == 0, c.webp_chunk(b"VP8X", F.concat(c.raw(b"\x08\0\0\0"), c.le(k % 16000, 3), c.le(F.lit(500), 3))))
        .when(k % 3 == 1, c.webp_chunk(b"VP8 ", F.concat(c.raw(b"\0\0\0\x9d\x01\x2a"), c.le(k % 16384, 2), c.le(F.lit(500), 2))))
        .otherwise(c.webp_chunk(b"VP8L", lossless))
    )
    exif = c.webp_chunk(b"EXIF", F.concat(c.raw(b"Exif\0\0"), orientation_block(k % 8 + 1)))
    p = parsed_as(table(spark, sf, "embeddings").withColumn("form", form), "a.webp", c.webp(made, exif), "vec_id", "form")
    return p.select("vec_id", "form", "p.width", "p.height", "p.exif.orientation")


_MOTION = "s_suppkey % 4 = 0"


@query(f"""SELECT s_suppkey, CASE WHEN {_MOTION} THEN NULL ELSE s_suppkey % 300 / 10 END AS speed, CASE WHEN {_MOTION} THEN NULL ELSE 'K' END AS speed_ref, CASE WHEN {_MOTION} THEN NULL ELSE s_suppkey % 3600 / 10 END AS track, CASE WHEN {_MOTION} THEN NULL ELSE '2026:01:02' END AS date_stamp,
CASE WHEN {_MOTION} THEN NULL ELSE printf('%02d:%02d:%05.2fZ', s_suppkey % 24, s_suppkey % 60, (s_suppkey % 599) / 10) END AS time_stamp, CASE WHEN {_MOTION} THEN NULL ELSE s_suppkey % 24 || 'h' END AS clock, {_MOTION} AS empty FROM supplier""")
def gps_motion(spark, sf):
    """Speed, track, date and time of a GPS directory; a directory without any of what is known gives no record."""
    k, none = col("s_suppkey"), col("s_suppkey") % 4 == 0
    heap = 26 + 2 + 12 * 6 + 4
    at = lambda i: c.le(F.lit(heap + i), 4)
    ratio = lambda a, b=1: F.concat(c.le(a, 4), c.le(F.lit(b), 4))
    rows = F.concat(
        c.tiff_entry(7, 5, 3, at(0)), c.tiff_entry(0x0C, 2, 2, c.raw(b"K\0\0\0")), c.tiff_entry(0x0D, 5, 1, at(24)), c.tiff_entry(0x0E, 2, 2, c.raw(b"T\0\0\0")), c.tiff_entry(0x0F, 5, 1, at(32)), c.tiff_entry(0x1D, 2, 11, at(40)),
    )
    data = F.concat(ratio(k % 24), ratio(k % 60), ratio(k % 599, 10), ratio(k % 300, 10), ratio(k % 3600, 10), c.raw(b"2026:01:02\0"))
    head = F.concat(c.raw(b"II*\0\x08\0\0\0\x01\0"), c.tiff_entry(0x8825, 4, 1, c.le(F.lit(26), 4)), c.raw(b"\0\0\0\0"))
    full = F.concat(head, c.raw(b"\x06\0"), rows, c.raw(b"\0\0\0\0"), data)
    bare = F.concat(head, c.raw(b"\x01\0"), c.tiff_entry(0x12, 2, 4, c.raw(b"WGS\0")), c.raw(b"\0\0\0\0"))
    g = table(spark, sf, "supplier").select("s_suppkey", udfs.exif_record(F.when(none, bare).otherwise(full))["gps"].alias("g"))
    clock = F.concat(F.regexp_extract("g.time_stamp", r"^0?(\d+):", 1), F.lit("h"))
    return g.select("s_suppkey", r(col("g.speed"), 4).alias("speed"), "g.speed_ref", r(col("g.track"), 4).alias("track"), "g.date_stamp", "g.time_stamp", clock.alias("clock"), col("g").isNull().alias("empty"))


# Verdicts.


@query(f"{_DOC_BYTES}, a AS (SELECT doc_id, max(n) AS n, coalesce(sum(k) FILTER (byte BETWEEN 32 AND 126 OR byte IN (9, 10, 13)), 0) / max(n) AS ratio FROM c GROUP BY doc_id) SELECT doc_id, printf('ASCII content: %.2f%% across %d bytes', ratio * 100, CAST(n AS BIGINT)) AS message FROM a")
def ascii_message(spark, sf):
    d = catalog.doc_hist(spark, sf)
    return d.select("doc_id", sqlapi.scan_ascii_message(col("hist"), stats.total(col("hist"))).alias("message"))


@query("""SELECT doc_id, kind, CASE kind WHEN 0 THEN 'CLEAN (Chi-Square Verified)' WHEN 1 THEN 'CLEAN (Chi-Square Verified)' WHEN 2 THEN 'ALERT (1 Anomalies)' ELSE NULL END AS verdict, kind = 2 AS suspicious
FROM (SELECT doc_id, CAST(doc_id % 4 AS INT) AS kind FROM documents)""")
def stego_verdict(spark, sf):
    """Steganalysis of JPEG files: a scan too short to test, one with a large comment (low severity: no alert),
    one with a comment that isn't printable, and a file that is no JPEG."""
    kind = (col("doc_id") % 4).cast("int")
    note = F.when(kind == 0, c.raw(b"a note")).when(kind == 1, c.raw(b"a" * 300)).otherwise(c.raw(b"\x01\x02\x03\x04" * 10))
    made = F.when(kind < 3, c.jpeg(c.app0(), c.jpeg_segment(0xFE, note), scan=c.raw(b"0123456789"))).otherwise(c.png(c.png_chunk(b"IHDR", c.ihdr(F.lit(1), F.lit(1)))))
    files = table(spark, sf, "documents").select(F.concat(col("doc_id").cast("string"), F.when(kind < 3, ".jpg").otherwise(".png")).alias("path"), made.alias("content"))
    a = reports.audit(files).select(F.regexp_extract("path", r"^(\d+)", 1).cast("long").alias("doc_id"), "stego_verdict", "suspicious")
    return a.select("doc_id", (col("doc_id") % 4).cast("int").alias("kind"), col("stego_verdict").alias("verdict"), "suspicious")


@query("""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'SUSPICIOUS (Possible Encryption/Stego)' ELSE 'NORMAL' END AS entropy_verdict, CASE WHEN doc_id % 3 = 0 THEN 'DETECTED (+' || (CASE WHEN doc_id % 6 = 0 THEN 20 ELSE 2 END) || ' bytes)' ELSE 'CLEAN (0 bytes)' END AS overlay_verdict,
CASE WHEN doc_id % 3 <> 0 THEN 'CLEAN (None Detected)' WHEN doc_id % 6 = 0 THEN 'ALERT: 2 Found' ELSE 'ALERT: 1 Found' END AS payload_verdict FROM documents""")
def audit_verdicts(spark, sf):
    """Each verdict both ways: noise or zeros in a PNG, and nothing, two bytes or an archive behind it."""
    k = col("doc_id")
    noise = F.when(k % 2 == 0, c.raw(bytes(i * 167 % 256 for i in range(4096)))).otherwise(c.raw(b"\0" * 4096))
    tail = F.when(k % 6 == 0, c.raw(b"PK\x03\x04" + b"\0" * 16)).when(k % 3 == 0, c.raw(b"hi")).otherwise(c.raw(b""))
    made = F.concat(c.png(c.png_chunk(b"IHDR", c.ihdr(F.lit(1), F.lit(1))), c.png_chunk(b"IDAT", noise)), tail)
    files = table(spark, sf, "documents").select(F.concat(k.cast("string"), F.lit(".png")).alias("path"), made.alias("content"))
    return reports.audit(files).select(F.regexp_extract("path", r"^(\d+)", 1).cast("long").alias("doc_id"), "entropy_verdict", "overlay_verdict", "payload_verdict")


# Rewrites.


@query("SELECT o_orderkey, ['IHDR', 'pHYs', 'IEND'] AS kept, CAST(8 + 25 + 21 + 12 AS BIGINT) AS bytes FROM orders")
def png_scrub(spark, sf):
    """Text and time chunks go; what the picture needs stays, with its checksums."""
    d = png_files(spark, sf).select("o_orderkey", "path", udfs.scrub(col("content"))["content"].alias("content"))
    return reports.parsed(d).select("o_orderkey", F.col("p.parts.name").alias("kept"), col("size").alias("bytes"))


@query("SELECT o_orderkey, o_orderkey % 2 = 0 AS jpeg, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN '' ELSE 'Description' END AS key, CASE WHEN o_orderkey % 3 <> 0 THEN 'shared note' END AS value FROM orders")
def comment_command(spark, sf):
    """One command for comments of JPEG and texts of PNG files: set, then, in every third file, removed."""
    k = col("o_orderkey")
    made = F.when(k % 2 == 0, c.jpeg(c.app0(), c.jpeg_comment(col("o_orderpriority")), scan=c.raw(b"0"))).otherwise(c.png(c.png_chunk(b"IHDR", c.ihdr(F.lit(1), F.lit(1)))))
    files = table(spark, sf, "orders").select(k.cast("string").alias("path"), made.alias("content"))
    noted = convert.set_comment(files, "shared note").select("path", "content")
    gone = convert.set_comment(noted.where("cast(path as long) % 3 = 0"), None).select("path", "content")
    done = noted.where("cast(path as long) % 3 <> 0").unionByName(gone)
    j, p = udfs.jpeg_comments(F.when(detect.container(col("content")) == "jpeg", col("content")))["comments"], udfs.png_texts(F.when(detect.container(col("content")) == "png", col("content")))["texts"]
    d = done.select(col("path").cast("long").alias("o_orderkey"), j.alias("j"), p.alias("p"))
    key = F.when(F.size("j") > 0, F.lit("")).when(F.size("p") > 0, F.get("p", F.lit(0))["key"])
    return d.select("o_orderkey", (col("o_orderkey") % 2 == 0).alias("jpeg"), key.alias("key"), F.coalesce(F.get("j", F.lit(0)), F.get("p", F.lit(0))["value"]).alias("value"))


# Validators.

_FORMS = {
    "email": ("u{}@mail.example.org", "u{}@mail"),
    "ipv4": ("10.0.{0}.{0}", "10.0.{0}.300"),
    "mac": ("00:1a:2b:3c:4d:5e", "00:1a:2b:3c:4d"),
    "uuid": ("123e4567-e89b-42d3-a456-426614174000", "123e4567e89b42d3a456426614174000"),
    "sha256": ("ab" * 32, "ab" * 31),
    "real": ("-{}.5", "{}.5.1"),
    "int": ("-{}", "{}x"),
    "semver": ("1.{}.0-rc.1", "1.{}"),
}
_CHECKS = {"email": patterns.is_email, "ipv4": patterns.is_ipv4, "mac": patterns.is_mac, "uuid": patterns.is_uuid, "sha256": patterns.is_sha256, "real": patterns.is_real, "int": patterns.is_int, "semver": patterns.is_semver}


@query(f"SELECT event_id, name, event_id % 2 = 0 AS valid FROM events, (SELECT unnest({list(_FORMS)}) AS name)")
def validators(spark, sf):
    """Each validator on a string of its form for even ids, on one that misses it for odd ids."""
    n = (col("event_id") % 200).cast("string")

    def made(name: str) -> Column:
        good, bad = (F.replace(F.lit(x.replace("{0}", "{}")), F.lit("{}"), n) for x in _FORMS[name])
        return _CHECKS[name](F.when(col("event_id") % 2 == 0, good).otherwise(bad))

    checks = F.array(*(F.struct(F.lit(k).alias("name"), made(k).alias("valid")) for k in _FORMS))
    return table(spark, sf, "events").select("event_id", F.explode(checks).alias("x")).select("event_id", "x.*")


# Headers of sound, video and pictures.


def _header_files(d: DataFrame) -> DataFrame:
    """FLAC, AIFF, Ogg, MP4, Matroska, MP3, TIFF by the key modulo 7; sizes and times follow from the key."""
    k = col("event_id")
    n = k % 5000 + 1
    flac = F.concat(c.raw(b"fLaC\x80\0\0\x22\x10\0\x10\0\0\0\0\0\0\0"), c.be(F.lit(44100 << 44 | 1 << 41 | 15 << 36) + n * 44100, 8), c.raw(b"\0" * 16))
    aiff = F.concat(c.raw(b"FORM\0\0\0\x40AIFFCOMM\0\0\0\x12\0\x02"), c.be(n * 44100, 4), c.raw(b"\0\x10\x40\x0e\xac\x44\0\0\0\0\0\0"))
    page = lambda flag, granule, body: F.concat(c.raw(b"OggS\0" + bytes([flag])), c.le(granule, 8), c.raw(b"\x01\0\0\0" + b"\0" * 8 + b"\x01"), c.be(F.octet_length(body), 1), body)
    vorbis = c.raw(b"\x01vorbis\0\0\0\0\x02\x80\xbb\0\0" + b"\0" * 14)
    ogg = F.concat(page(2, F.lit(0), vorbis), page(4, n * 48000, c.raw(b"end")))
    handler = lambda kind: c.box(b"hdlr", c.raw(b"\0" * 8 + kind + b"\0" * 12))
    sample = c.box(b"mp4a", c.raw(b"\0" * 6 + b"\0\x01" + b"\0" * 8 + b"\0\x02\0\x10\0\0\0\0\xbb\x80\0\0"))
    table_ = c.box(b"minf", c.box(b"stbl", c.box(b"stsd", c.raw(b"\0\0\0\0\0\0\0\x01"), sample)))
    clock = c.box(b"mdhd", c.raw(b"\0" * 12), c.be(F.lit(48000), 4), c.be(n * 48000, 4), c.raw(b"\0\0\0\0"))
    mp4 = F.concat(c.box(b"ftyp", c.raw(b"isom\0\0\0\0")), c.box(b"moov", c.box(b"trak", c.box(b"mdia", handler(b"vide"))), c.box(b"trak", c.box(b"mdia", clock, handler(b"soun"), table_))))
    element = lambda name, *bodies: (lambda b: F.concat(c.raw(name), c.be(F.octet_length(b) + F.lit(1 << 28), 4), b))(F.concat(*bodies))
    sound = element(b"\xae", element(b"\x83", c.raw(b"\x02")), element(b"\x86", c.raw(b"A_VORBIS")), element(b"\xe1", element(b"\xb5", c.raw(b"\x47\x3b\x80\0")), element(b"\x9f", c.raw(b"\x02"))))
    picture = element(b"\xae", element(b"\x83", c.raw(b"\x01")))
    info = element(b"\x15\x49\xa9\x66", element(b"\x2a\xd7\xb1", c.be(n * 1_000_000, 5)), element(b"\x44\x89", c.raw(b"\x44\x7a\0\0")))
    mkv = F.concat(element(b"\x1a\x45\xdf\xa3", c.raw(b"\x42\x86\x81\x01")), element(b"\x18\x53\x80\x67", info, element(b"\x16\x54\xae\x6b", picture, sound)))
    mp3 = F.concat(c.raw(b"ID3\x04\0\0\0\0\0\x05tag..\xff\xfb\x90\x00" + b"\0" * 32 + b"Xing\0\0\0\x01"), c.be(n * 1225, 4), c.raw(b"\0" * 100))
    row = lambda tag, kind, value: c.tiff_entry(tag, kind, 1, value)
    tiff = F.concat(c.raw(b"II*\0\x08\0\0\0\x03\0"), row(256, 4, c.le(n, 4)), row(257, 3, c.raw(b"\x20\x03\0\0")), row(258, 3, c.raw(b"\x08\0\0\0")), c.raw(b"\0\0\0\0"))
    made = F.when(k % 7 == 0, flac).when(k % 7 == 1, aiff).when(k % 7 == 2, ogg).when(k % 7 == 3, mp4).when(k % 7 == 4, mkv).when(k % 7 == 5, mp3).otherwise(tiff)
    return d.select(k.cast("string").alias("path"), made.alias("content"))


@query("""WITH f(i, media_type, format, codec, sample_rate, channels, bits, audio, video, per) AS (VALUES (0, 'Audio', 'flac', 'flac', 44100, 2, 16, 1, 0, 1.0), (1, 'Audio', 'aiff', 'pcm', 44100, 2, 16, 1, 0, 1.0), (2, 'Audio', 'ogg', 'vorbis', 48000, 2, NULL, 1, 0, 1.0), (3, 'Video Container', 'mp4', 'aac', 48000, 2, 16, 1, 1, 1.0),
(4, 'Video Container', 'mkv', 'vorbis', 48000, 2, NULL, 1, 1, 1.0), (5, 'Audio', 'mp3', 'mp3', 44100, 2, NULL, 1, 0, 32.0), (6, 'Image', 'tiff', NULL, NULL, NULL, 8, NULL, NULL, NULL))
SELECT event_id, media_type, format, codec, CAST(sample_rate AS INT) AS sample_rate, CAST(channels AS INT) AS channels, CAST(bits AS INT) AS bits, CAST(audio AS INT) AS audio_tracks, CAST(video AS INT) AS video_tracks, round(CAST((event_id % 5000 + 1) * per AS DOUBLE), 3) AS seconds, CASE WHEN i = 6 THEN event_id % 5000 + 1 END AS width FROM events JOIN f ON event_id % 7 = i""")
def probe_headers(spark, sf):
    p = reports.probe(_header_files(table(spark, sf, "events")))
    return p.select(col("path").cast("long").alias("event_id"), "media_type", "format", "codec", "sample_rate", "channels", col("bits_per_sample").alias("bits"), "audio_tracks", "video_tracks", r(col("duration_secs"), 3).alias("seconds"), "width")


# Pixels.

_ROW = "102030405060708090A0B0C0D0E0F00F1F2F3F4F5F6F7F8F"


@query(f"SELECT item_id, through, repeat('{_ROW}', CAST(4 + item_id % 5 AS INT)) AS pixels FROM benchmark, (VALUES ('png'), ('tiff'), ('bmp')) AS t(through)")
def image_pixels(spark, sf):
    """A picture through a lossless format and back to BMP: the same pixels."""
    d = catalog.image_files(spark, sf).select("item_id", "content", F.explode(F.array(*(F.lit(x) for x in ("png", "tiff", "bmp")))).alias("through"))
    there = d.select("item_id", "through", udfs.image_converter()(col("content"), F.lit("bmp"), col("through"))["content"].alias("b"))
    back = there.select("item_id", "through", udfs.image_converter()(col("b"), col("through"), F.lit("bmp"))["content"].alias("b"))
    return back.select("item_id", "through", F.hex(F.expr("substring(b, 55, octet_length(b) - 54)")).alias("pixels"))


@query("SELECT item_id, through, CAST(4 + item_id % 5 AS BIGINT) AS height, true AS near FROM benchmark, (VALUES ('jpeg'), ('gif')) AS t(through)")
def image_lossy(spark, sf):
    """A picture of one colour through JPEG and GIF: its colour within 26 of 256 (the step of GIF's colours is 51)."""
    rows = (4 + col("item_id") % 5).cast("int")
    flat = F.concat(c.raw(b"BM"), c.le(54 + rows * 24, 4), c.raw(b"\0\0\0\0\x36\0\0\0\x28\0\0\0\x08\0\0\0"), c.le(rows, 4), c.raw(b"\x01\0\x18\0" + b"\0" * 24), F.expr("unhex(repeat('4080C0', cast(8 * (4 + item_id % 5) as int)))"))
    d = table(spark, sf, "benchmark").select("item_id", flat.alias("content"), F.explode(F.array(F.lit("jpeg"), F.lit("gif"))).alias("through"))
    there = d.select("item_id", "through", udfs.image_converter(quality=95)(col("content"), F.lit("bmp"), col("through"))["content"].alias("b"))
    back = there.select("item_id", "through", udfs.image_converter()(col("b"), col("through"), F.lit("bmp"))["content"].alias("b"))
    seen = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.conv(F.hex(F.substring(col("b"), i + 55, F.lit(1))), 16, 10).cast("int"))
    close = F.forall(F.zip_with(seen, F.array(F.lit(0x40), F.lit(0x80), F.lit(0xC0)), lambda a, x: F.abs(a - x) <= 26), lambda x: x)
    height = F.conv(F.hex(F.substring(col("b"), 23, 1)), 16, 10).cast("long")
    return back.select("item_id", "through", height.alias("height"), close.alias("near"))


@query(_pcm_sql("32", f"({_E.format('2 * i + 1')} + {_E.format('2 * i + 2')}) / 2").replace("SELECT vec_id,", "SELECT vec_id, CAST(8000 AS INT) AS sample_rate, CAST(1 AS INT) AS channels,", 1))
def audio_pipeline(spark, sf):
    """Floats to WAV of 32 bits, mixed down by the pipeline and read again: the means of both channels."""
    made = catalog.pcm(spark, sf).select("vec_id", udfs.wav_encoder(8000, 2, 32)(col("x"))["content"].alias("content"))
    done = made.transform(convert.AudioPipeline().channels(1).bits(32)).select("vec_id", udfs.decode_audio(col("content")).alias("a"))
    return done.select("vec_id", "a.sample_rate", "a.channels", F.posexplode("a.samples").alias("i", "s")).select("vec_id", "sample_rate", "channels", "i", r(col("s"), 4).alias("sample"))


# Encoder arguments, files and functions for SQL.


@query("""SELECT k.source, t.target, CASE WHEN t.kind = 'image' THEN '-ss 00:00:01.000 -vframes 1 -vf scale=320:240' WHEN t.target = 'mp3' THEN '-vn -c:a libmp3lame -b:a 192k -ar 48000' WHEN t.target = 'flac' THEN '-vn -c:a flac -ar 48000' ELSE '-c:v libvpx-vp9 -crf 30 -b:v 0 -c:a libopus -b:a 128k -vf scale=320:240' END AS arguments
FROM (VALUES ('video'), ('audio')) AS k(source), (VALUES ('png', 'image'), ('mp3', 'audio'), ('flac', 'audio'), ('webm', 'video')) AS t(target, kind) WHERE k.source = 'video' OR t.kind = 'audio'""")
def encoder_arguments(spark, sf):
    o = tools.Options(rate=48000, size=(320, 240))
    kinds = {"png": "image", "mp3": "audio", "flac": "audio", "webm": "video"}
    rows = [(s, t, " ".join(tools.arguments(s, t, k, o))) for s in ("video", "audio") for t, k in kinds.items() if s == "video" or k == "audio"]
    return spark.createDataFrame(rows, "source string, target string, arguments string")


@query("SELECT '/out/' || vec_id || '.wav' AS path, CAST(44 + 64 AS BIGINT) AS bytes FROM embeddings WHERE vec_id % 2 = 0")
def batch_files(spark, sf):
    """A batch of WAV files and broken ones, converted, written and read back."""
    made = udfs.wav_encoder(8000, 2)(col("x"))["content"]
    files = catalog.pcm(spark, sf).select(F.concat(F.lit("/in/"), col("vec_id").cast("string"), F.lit(".wav")).alias("path"), F.when(col("vec_id") % 2 == 0, made).otherwise(c.raw(b"RIFF....WAVE")).alias("content"))
    root = _scratch(spark, "batch")
    convert.write_batch(files, reports.Batch("/in", "/out", "wav", audio={"channels": 1}, external=False), root, _scratch(spark, "staging"))
    found = sources.read_files(spark, root, ["WAV"])
    return found.select(F.regexp_extract("path", r"(/out/[^/]+)$", 1).alias("path"), col("length").alias("bytes"))


@query("SELECT '/f/' || item_id || '.' || CASE WHEN item_id % 2 = 0 THEN 'TXT' ELSE 'bin' END AS path, CAST(octet_length(encode(text)) AS BIGINT) AS length, text AS found, CASE WHEN text = '' THEN 'EmptyFile' END AS code FROM benchmark WHERE item_id % 2 = 0")
def read_guarded(spark, sf):
    """Files written, then read by extension, whatever its case, with the guard's verdict."""
    end = F.when(col("item_id") % 2 == 0, "TXT").otherwise("bin")
    files = table(spark, sf, "benchmark").select(F.concat(F.lit("/f/"), col("item_id").cast("string"), F.lit("."), end).alias("path"), c.utf8(col("text")).alias("content"))
    root = _scratch(spark, "listed")
    sink.write_files(files, root)
    d = sources.read_files(spark, root, sources.parse_extensions(" txt, .md,"))
    return d.select(F.regexp_extract("path", r"(/f/[^/]+)$", 1).alias("path"), "length", F.decode("content", "UTF-8").alias("found"), col("error.code").alias("code"))


@query(f"SELECT doc_id, v.v AS format FROM documents JOIN {catalog._values(2)}")
def header_sniff(spark, sf):
    """Formats by the first 1024 bytes alone."""
    return catalog._prefixed(spark, sf).select("doc_id", detect.media_format(sources.header(col("content"))).alias("format"))


@query(f"{_JPEG} SELECT doc_id, '{sqlapi.VERSION}' AS version, CAST(57 AS BIGINT) AS scrubbed, 'JPEG Image Container' AS container, CAST(57 + n + 4 * k AS BIGINT) AS file_size, CAST(5 AS INT) AS entries, round(CAST(0 AS DOUBLE), 1) AS overlay, CAST(NULL AS VARCHAR) AS error FROM k")
def sql_functions(spark, sf):
    """media_scan_json, media_audit_json, media_scrub and media_version from SQL."""
    sqlapi.register(spark)
    name = f"sql_functions_{abs(hash(sf))}"
    jpeg_files(spark, sf).createOrReplaceTempView(name)
    d = spark.sql(f"SELECT doc_id, media_version() AS version, octet_length(media_scrub(content)) AS scrubbed, media_scan_json(content, path) AS s, media_audit_json(content, path) AS a FROM {name}")
    s = F.from_json("s", "container string, file_size bigint, metadata array<struct<key: string>>, error string")
    a = F.from_json("a", "container string, overlay struct<overlay_size: double>")
    x = d.select("doc_id", "version", col("scrubbed").cast("long").alias("scrubbed"), s.alias("s"), a.alias("a"))
    return x.select("doc_id", "version", "scrubbed", F.when(col("s.container") == "jpeg", "JPEG Image Container").alias("container"), "s.file_size", F.size("s.metadata").alias("entries"), col("a.overlay.overlay_size").alias("overlay"), "s.error")


_PRETTY = ['{', '  "file" : "X",', '  "count" : 1,', '  "entries" : [ {', '    "category" : "text",', '    "tag_id" : null,', '    "key" : "a",', '    "name" : "A",', '    "value" : "X"', "  } ]", "}"]


@query(f"SELECT item_id, replace(array_to_string({_PRETTY}, chr(10)), 'X', CAST(item_id AS VARCHAR)) AS json FROM benchmark")
def export_pretty(spark, sf):
    """Pretty JSON of one entry."""
    rows = table(spark, sf, "benchmark").select(col("item_id").cast("string").alias("path"), F.lit(0).alias("pos"), F.lit("Text").alias("category"), F.lit(None).cast("int").alias("tag_id"), F.lit("a").alias("key"), F.lit("A").alias("name"), col("item_id").cast("string").alias("value"))
    return export.documents(rows, pretty=True).select(col("path").cast("long").alias("item_id"), "json")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 43.5 ELSE -43.5 END AS one, CASE WHEN s_suppkey % 2 = 0 THEN 0.0 ELSE 12.5 END AS two FROM supplier")
def dms_odd_input(spark, sf):
    """References in any case and with spaces; a number that is none counts as nothing."""
    even = col("s_suppkey") % 2 == 0
    ref = F.when(even, F.lit("garbage")).otherwise(F.lit(" w "))
    nothing = F.when(even, F.lit(float("nan"))).otherwise(F.lit(12.0))
    return table(spark, sf, "supplier").select("s_suppkey", r(geo.dms_with_ref(F.lit(43.0), F.lit(30.0), F.lit(0.0), ref)).alias("one"), r(geo.dms_with_ref(nothing, F.lit(30.0), F.lit(0.0), F.lit("N"))).alias("two"))
