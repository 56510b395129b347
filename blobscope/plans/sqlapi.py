"""Functions for SQL and for code that holds bytes: the surface that other languages would bind."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dims import CONTAINERS
from ..operators import codecs, describe, rewrite, walkers
from . import reports

VERSION = "0.1.0"


def scan_json(files: DataFrame) -> DataFrame:
    """path and {container, file_size, metadata}, or {error}."""
    p = reports.parsed(files)
    body = F.to_json(F.struct("container", F.col("size").alias("file_size"), reports.entries().alias("metadata")), {"ignoreNullFields": "false"})
    return p.select("path", F.when(F.col("p.error").isNotNull(), F.to_json(F.struct(F.col("p.error.message").alias("error")))).otherwise(body).alias("json"))


def audit_json(files: DataFrame) -> DataFrame:
    """path and {container, entropy, overlay, payloads, steganalysis}."""
    a = reports.audit(files)
    body = F.struct("container", "entropy", "overlay", "payloads", F.when(F.col("scan").isNotNull(), F.struct("scan.*", F.col("findings").alias("all_findings"), F.col("suspicious").alias("is_suspicious"))).alias("steganalysis"))
    return a.select("path", F.to_json(body, {"ignoreNullFields": "false"}).alias("json"))


def exif_text(files: DataFrame) -> DataFrame:
    """path and the lines Make, Model, Date and GPS that a file has, or that it has none."""
    e = F.col("p.exif")
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value))
    gps = F.when(e["gps"]["latitude"].isNotNull() & e["gps"]["longitude"].isNotNull(), F.format_string("%.6f, %.6f", e["gps"]["latitude"], e["gps"]["longitude"]))
    text = F.concat_ws("\n", line("Make", e["camera_make"]), line("Model", e["camera_model"]), line("Date", e["date_time_original"]), line("GPS", gps))
    return reports.parsed(files).select("path", F.when(F.length(text) == 0, "No EXIF metadata found").otherwise(text).alias("text"))


def scan_ascii_message(hist: Column, size: Column) -> Column:
    from ..functions.stats import ascii_ratio

    return F.format_string("ASCII content: %.2f%% across %d bytes", ascii_ratio(hist) * 100, size)


def _rows(f):
    def run(a: pa.Array) -> pa.Array:
        out = []
        for x in a.to_pylist():
            try:
                out.append(None if x is None else f(x))
            except walkers.Malformed:
                out.append(None)
        return pa.array(out, pa.binary())

    return run


def _convert(content: bytes, target: str) -> bytes:
    kind = walkers.sniff(content) or ("bmp" if content[:2] == b"BM" else "wav" if content[8:12] == b"WAVE" else "")
    return codecs.convert_audio(content) if target == "wav" else codecs.transcode_image(content, kind, {"jpg": "jpeg", "tif": "tiff"}.get(target, target))


def register(spark: SparkSession) -> None:
    """media_scrub(bytes), media_cut_overlay(bytes), media_convert(bytes, format): bytes, or null for what
    can't be read or written; media_parse(bytes): JSON of the container or of the error; media_scan_json(bytes,
    path), media_audit_json(bytes, path): the reports of a file; media_version()."""

    def outline(content: pa.Array) -> pa.Array:
        out = []
        for x in content.to_pylist():
            try:
                p = walkers.parse(x) if x is not None else None
                out.append(None if p is None else json.dumps({"container": p.container, "name": CONTAINERS[p.container], "width": p.width, "height": p.height, "end": p.end, "parts": len(p.parts), "comment": p.comment}))
            except walkers.Malformed as e:
                out.append(json.dumps({"error": e.message, "code": e.code}))
        return pa.array(out, pa.string())

    def convert(content: pa.Array, target: pa.Array) -> pa.Array:
        out = []
        for x, t in zip(content.to_pylist(), target.to_pylist(), strict=True):
            try:
                out.append(None if x is None or t is None else _convert(x, t.lower()))
            except walkers.Malformed:
                out.append(None)
        return pa.array(out, pa.binary())

    def reporter(f):
        def run(content: pa.Array, path: pa.Array) -> pa.Array:
            pairs = zip(content, path, strict=True)
            return pa.array([json.dumps(f(x.as_py(), p.as_py()), ensure_ascii=False) if x.is_valid else None for x, p in pairs], pa.string())

        run.__annotations__ = {"content": pa.Array, "path": pa.Array, "return": pa.Array}
        return F.arrow_udf(run, "string")

    scrub, cut = _rows(rewrite.scrub), _rows(rewrite.cut_overlay)
    for f in (scrub, cut):
        f.__annotations__ = {"a": pa.Array, "return": pa.Array}
    spark.udf.register("media_scrub", F.arrow_udf(scrub, "binary"))
    spark.udf.register("media_cut_overlay", F.arrow_udf(cut, "binary"))
    spark.udf.register("media_convert", F.arrow_udf(convert, "binary"))
    spark.udf.register("media_parse", F.arrow_udf(outline, "string"))
    spark.udf.register("media_scan_json", reporter(describe.scan))
    spark.udf.register("media_audit_json", reporter(describe.audit))
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION media_version() RETURNS STRING RETURN '{VERSION}'")


