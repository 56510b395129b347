"""Reports over many files: scan, audit, dump, probe and batch conversion, as DataFrames.

Input: path, content and, where known, length and error. No report shuffles content; each reads it once in
one Arrow function and drops it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dims import CONTAINERS, CONVERSIONS, FORMATS
from ..functions import detect, stats
from ..operators import tools, udfs


def _named(c: Column) -> Column:
    return F.coalesce(*(F.when(c == k, v) for k, v in CONTAINERS.items() if k != "unknown"), F.lit(CONTAINERS["unknown"]))


def parsed(files: DataFrame) -> DataFrame:
    """Adds container, size and the parsed struct, and drops the content."""
    kinds = files.withColumn("container", detect.container_or_extension(F.col("content"), F.col("path")))
    return kinds.withColumn("size", F.octet_length("content").cast("long")).withColumn("p", udfs.parse(F.col("content"), F.col("container"))).drop("content")


def _entry(category: str, tag: int | None, key: Column | str, name: Column | str, value: Column) -> Column:
    text = lambda x: x if isinstance(x, Column) else F.lit(x)
    entry = F.struct(F.lit(category).alias("category"), F.lit(tag).cast("int").alias("tag_id"), text(key).alias("key"), text(name).alias("name"), value.alias("value"))
    return F.when(value.isNotNull(), entry)


def entries(comment: Column | None = None) -> Column:
    """The long rows of a file, in a fixed order, from container, size and p. comment: instead of the walk's."""
    p, e = F.col("p"), F.col("p.exif")
    fmt = F.format_string
    both = p["width"].isNotNull() & p["height"].isNotNull()
    number = lambda f, x: F.when(x.isNotNull(), fmt(f, x))
    text_rows = F.transform(F.coalesce(p["text"], F.array().cast("array<struct<key:string,value:string>>")), lambda t: _entry("Text", None, F.concat(F.lit("PNG:"), t["key"]), F.concat(F.lit("PNG Text ("), t["key"], F.lit(")")), t["value"]))
    comment = F.when(F.col("container").isin("jpeg", "gif"), p["comment"] if comment is None else comment)
    head = F.array(
        _entry("Forensics", None, "Container", "Container Format", _named(F.col("container"))),
        _entry("Forensics", None, "FileSize", "File Size", fmt("%d bytes (%.2f KB)", F.col("size"), F.bround(F.col("size") / 1024.0, 2))),
        _entry("Tiff", 0x0100, "ImageWidth", "Image Width", F.when(both, fmt("%d px", p["width"]))),
        _entry("Tiff", 0x0101, "ImageHeight", "Image Height", F.when(both, fmt("%d px", p["height"]))),
        _entry("Tiff", None, "BitDepth", "Bit Depth", F.when(F.col("container") == "png", number("%d bits", p["bit_depth"]))),
        _entry("Text", None, F.when(F.col("container") == "gif", "GIFComment").otherwise("JPEGComment"), F.when(F.col("container") == "gif", "GIF Comment").otherwise("JPEG Comment"), comment),
    )
    tail = F.array(
        _entry("Tiff", 0x010F, "Make", "Camera Make", e["camera_make"]),
        _entry("Tiff", 0x0110, "Model", "Camera Model", e["camera_model"]),
        _entry("Tiff", 0x0131, "Software", "Software", e["software"]),
        _entry("Exif", 0x9003, "DateTimeOriginal", "Date/Time Original", e["date_time_original"]),
        _entry("Exif", 0x8827, "ISOSpeedRatings", "ISO Speed", e["iso"].cast("string")),
        _entry("Exif", 0x829D, "FNumber", "F-Number", number("f/%.1f", e["f_number"])),
        _entry("Exif", 0x829A, "ExposureTime", "Exposure Time", number("%s s", e["exposure_time"])),
        _entry("Exif", 0x920A, "FocalLength", "Focal Length", number("%.1f mm", e["focal_length_mm"])),
        _entry("Exif", 0xA433, "LensMake", "Lens Make", e["lens_make"]),
        _entry("Exif", 0xA434, "LensModel", "Lens Model", e["lens_model"]),
        _entry("Exif", 0xA431, "BodySerialNumber", "Camera Serial", e["body_serial_number"]),
        _entry("Exif", 0xA435, "LensSerialNumber", "Lens Serial", e["lens_serial_number"]),
        _entry("Gps", 0x0002, "GPSLatitude", "GPS Latitude", number("%.6f°", e["gps"]["latitude"])),
        _entry("Gps", 0x0004, "GPSLongitude", "GPS Longitude", number("%.6f°", e["gps"]["longitude"])),
        _entry("Gps", 0x0006, "GPSAltitude", "GPS Altitude", number("%.2f m", e["gps"]["altitude"])),
        _entry("Gps", 0x000D, "GPSSpeed", "GPS Speed", number("%.2f", e["gps"]["speed"])),
        _entry("Gps", 0x000F, "GPSTrack", "GPS Track", number("%.2f°", e["gps"]["track"])),
    )
    return F.filter(F.concat(head, text_rows, tail), lambda x: x.isNotNull())


def scan(files: DataFrame, exif_only: bool = False, gps_only: bool = False, comment: Column | None = None) -> DataFrame:
    """path, pos, category, tag_id, key, name, value. A file that can't be parsed has one row of category
    Error with its code and message. The walk trims a comment; `comment` (of the content) is shown as it is."""
    p = parsed(files if comment is None else files.withColumn("comment", comment))
    error = F.array(F.struct(F.lit("Error").alias("category"), F.lit(None).cast("int").alias("tag_id"), F.col("p.error.code").alias("key"), F.col("p.error.code").alias("name"), F.col("p.error.message").alias("value")))
    rows = p.select("path", F.posexplode(F.when(F.col("p.error").isNotNull(), error).otherwise(entries(None if comment is None else F.col("comment")))).alias("pos", "e")).select("path", "pos", "e.*")
    if exif_only:
        return rows.where(F.col("category") == "Exif")
    return rows.where(F.col("category") == "Gps") if gps_only else rows


def dump(files: DataFrame) -> DataFrame:
    """path, pos and a line for each part: offset, name, length and, in a PNG, the checksum."""
    rows = parsed(files).select("path", "container", F.posexplode("p.parts").alias("pos", "x"))
    at = F.format_string("[0x%08X]", F.col("x.offset"))
    line = (
        F.when(F.col("container") == "jpeg", F.format_string("%s 0xFF%02X %-24s (length: %d bytes)", at, F.col("x.marker"), F.col("x.name"), F.col("x.length")))
        .when(F.col("container") == "png", F.format_string("%s %-6s length: %-8d CRC: 0x%08X (%s)", at, F.col("x.name"), F.col("x.length"), F.col("x.crc"), F.when(F.col("x.crc_valid"), "CRC OK").otherwise("CRC INVALID")))
        .when(F.col("container") == "webp", F.format_string("%s %-6s length: %d bytes", at, F.col("x.name"), F.col("x.length")))
        .when(F.col("container") == "gif", F.format_string("%s %-24s length: %d bytes", at, F.col("x.name"), F.col("x.length")))
        .otherwise(F.format_string("%s %-8s length: %d bytes", at, F.col("x.name"), F.col("x.length")))
    )
    return rows.select("path", "pos", "x.offset", "x.name", "x.length", line.alias("line"))


def audit(files: DataFrame, threshold: float = stats.DEFAULT_ENTROPY) -> DataFrame:
    """One row a file: entropy, overlay, payloads, steganalysis of JPEG files, and verdicts. Where a file
    can't be parsed its end is its size and the error tells why."""
    kinds = files.withColumn("container", F.coalesce(detect.container_or_extension(F.col("content"), F.col("path")), F.lit("unknown")))
    sized = kinds.withColumn("size", F.octet_length("content").cast("long")).withColumn("p", udfs.parse(F.col("content"), F.when(F.col("container") != "unknown", F.col("container"))))
    ended = sized.withColumn("end", F.coalesce("p.end", "size"))
    one = ended.withColumn("a", udfs.audit(F.col("content"), F.col("end"), F.col("container"))).drop("content")
    report = stats.scan_report(F.col("a.scan_hist"))
    segments = F.flatten(F.transform("a.segments", lambda s: F.when(s["marker"] == 0xFE, stats.comment_findings(s["size"], s["non_printable"])).otherwise(stats.app_findings(s["size"], s["marker"]))))
    one = one.withColumn("entropy", stats.entropy(F.col("a.hist"))).withColumn("overlay", stats.overlay(F.col("end"), F.col("size"))).withColumn("scan", F.when(F.col("a.scan_hist").isNotNull(), report))
    one = one.withColumn("findings", F.when(F.col("scan").isNotNull(), F.concat("scan.findings", segments)))
    suspicious = F.col("entropy") >= threshold
    stego = F.coalesce(stats.is_suspicious(F.col("findings")), F.lit(False))
    return one.select(
        "path", "container", "size", "entropy", suspicious.alias("suspicious_entropy"), "overlay", F.col("a.payloads").alias("payloads"), "scan", "findings", stego.alias("suspicious"),
        F.when(suspicious, "SUSPICIOUS (Possible Encryption/Stego)").otherwise("NORMAL").alias("entropy_verdict"),
        F.when(F.col("overlay.has_overlay"), F.format_string("DETECTED (+%d bytes)", F.col("overlay.overlay_size"))).otherwise("CLEAN (0 bytes)").alias("overlay_verdict"),
        F.when(F.size("a.payloads") > 0, F.format_string("ALERT: %d Found", F.size("a.payloads"))).otherwise("CLEAN (None Detected)").alias("payload_verdict"),
        F.when(F.col("scan").isNull(), None).when(stego, F.format_string("ALERT (%d Anomalies)", F.size("findings"))).otherwise("CLEAN (Chi-Square Verified)").alias("stego_verdict"),
        F.col("p.error").alias("error"),
    )


def probe(files: DataFrame) -> DataFrame:
    """path and what udfs.probe tells, with a word for the number of channels."""
    rows = files.select("path", F.octet_length("content").cast("long").alias("size"), udfs.probe(F.col("content")).alias("x")).select("path", "size", "x.*")
    word = F.when(F.col("channels") == 1, "Mono").when(F.col("channels") == 2, "Stereo").when(F.col("channels") > 2, "Multi-Channel")
    return rows.withColumn("channel_layout", word)


@dataclass(frozen=True)
class Batch:
    """Options of a batch: target format (empty: WAV for audio and video, PNG for images), folders, whether
    the tree is flattened, and those of the conversion."""

    input_dir: str
    output_dir: str
    target: str = ""
    extensions: tuple[str, ...] = ()
    flatten: bool = False
    size: tuple[int, int] | None = None
    quality: int = 85
    audio: dict = field(default_factory=dict)
    external: bool = True  # what Python can't convert goes to the encoder of the task's machine


def output_path(path: Column, b: Batch) -> Column:
    """Where a file goes: below the output folder as below the input folder, or flat; with the target's
    extension instead of the last one (a flattened name loses two)."""
    ext = F.coalesce(detect.extension(path), F.lit(""))
    target = F.lit(b.target) if b.target else F.when(detect.is_av_extension(ext), "wav").otherwise("png")
    prefix = b.input_dir.rstrip("/") + "/"
    below = F.when(path.startswith(prefix), F.substring(path, len(prefix) + 1, 1 << 30)).otherwise(path)
    name = F.regexp_extract(below, r"([^/]+)$", 1)
    cut = lambda x: F.regexp_replace(x, r"(?<=[^/])\.[^./]*$", "")
    stem = cut(cut(name)) if b.flatten else cut(below)
    return F.concat(F.lit(b.output_dir.rstrip("/") + "/"), stem, F.lit("."), target)


def batch_plan(files: DataFrame, b: Batch) -> DataFrame:
    """path, output, length, collision (another file has the same output): reads no content."""
    ext = detect.extension(F.col("path"))
    known = list(b.extensions) or [*detect.AV_EXTENSIONS, *(e for e, *_ in FORMATS)]
    rows = files.where(ext.isin(*(e.lstrip(".").lower() for e in known))).select("path", output_path(F.col("path"), b).alias("output"), F.col("length").cast("long").alias("length"))
    same = rows.groupBy("output").agg(F.count("*").alias("n"))
    return rows.join(same, "output").select("path", "output", "length", (F.col("n") > 1).alias("collision"))


def batch_convert(files: DataFrame, b: Batch) -> DataFrame:
    """path, output, status, input_bytes, output_bytes, content and error of each file: a failure is a row."""
    media = detect.media_format_or_extension(F.col("content"), F.col("path"))
    rows = files.withColumn("media", media).withColumn("output", output_path(F.col("path"), b)).withColumn("goal", detect.format_of_extension(detect.extension(F.col("output"))))
    images, audio = udfs.image_converter(size=b.size, quality=b.quality), udfs.audio_converter(**b.audio)
    kind = detect.media_kind(F.col("media"))
    refused = F.struct(F.lit(None).cast("binary").alias("content"), F.struct(F.lit("UnsupportedFormat").alias("code"), F.concat(F.lit("Unsupported media format: "), F.coalesce("media", F.lit("unknown")), F.lit(" to "), F.coalesce("goal", F.lit("unknown"))).alias("message")).alias("error"))
    if b.external:
        o = tools.Options(size=b.size, **{k: v for k, v in b.audio.items() if k in ("rate", "channels", "gain", "normalize")})
        other = kind.isNotNull() & F.col("goal").isNotNull() & (kind != "image")
        refused = F.when(other, udfs.av_converter(o)(F.when(other, F.col("content")), F.col("media"), F.col("goal"))).otherwise(refused)
    done = F.when((kind == "image") & (detect.media_kind(F.col("goal")) == "image"), images(F.when(kind == "image", F.col("content")), F.col("media"), F.col("goal"))).when((F.col("media") == "wav") & (F.col("goal") == "wav"), audio(F.when(F.col("media") == "wav", F.col("content")))).otherwise(refused)
    out = rows.withColumn("r", done)
    return out.select("path", "output", F.when(F.col("r.error").isNull(), "converted").otherwise("failed").alias("status"), F.octet_length("content").cast("long").alias("input_bytes"), F.coalesce(F.octet_length("r.content"), F.lit(0)).cast("long").alias("output_bytes"), "r.content", "r.error")


def batch_summary(items: DataFrame) -> DataFrame:
    """Counts by status and bytes of a batch, in one row."""
    return items.agg(
        F.count("*").alias("total"), F.count_if(F.col("status") == "converted").alias("converted"), F.count_if(F.col("status") == "skipped").alias("skipped"), F.count_if(F.col("status") == "failed").alias("failed"),
        F.coalesce(F.sum("input_bytes"), F.lit(0)).alias("input_bytes"), F.coalesce(F.sum("output_bytes"), F.lit(0)).alias("output_bytes"),
    )


def capability(source: Column, target: Column) -> Column:
    """Whether media of one kind can become another."""
    pairs = [(source == a) & (target == b) for a, b in sorted(CONVERSIONS)]
    out = pairs[0]
    for x in pairs[1:]:
        out = out | x
    return out
