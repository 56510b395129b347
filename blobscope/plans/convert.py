"""Conversions, scrubs and comments over many files, and the small rules around them."""

from __future__ import annotations

import json
import posixpath
import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.detect import AV_EXTENSIONS
from ..functions.safety import scrub_terminal
from ..operators import codecs, udfs, walkers
from ..operators.codecs import MAX_SIDE
from ..operators.tools import find_tool  # noqa: F401

def parse_size(text: str) -> tuple[int, int]:
    """`640x480` as width and height."""
    m = re.fullmatch(r"\s*([0-9]+)\s*x\s*([0-9]+)\s*", text)
    if not m:
        raise ValueError(f"a size is WIDTHxHEIGHT, not {text!r}")
    return int(m[1]), int(m[2])


@dataclass(frozen=True)
class ImagePipeline:
    """Steps of an image conversion; each method returns a new pipeline. Use: df.transform(pipeline)."""

    target: str = "png"
    quality_: int = 85
    size_: tuple[int, int] | None = None
    max_side: int = MAX_SIDE

    def to(self, target: str) -> ImagePipeline:
        return replace(self, target=target)

    def quality(self, q: int) -> ImagePipeline:
        return replace(self, quality_=q)

    def resize(self, width: int, height: int) -> ImagePipeline:
        return replace(self, size_=(width, height))

    def max_dimension(self, side: int) -> ImagePipeline:
        return replace(self, max_side=side)

    def __call__(self, files: DataFrame) -> DataFrame:
        """Replaces content by the converted bytes; `error` tells why there are none."""
        from ..functions.detect import media_format

        f = udfs.image_converter(size=self.size_, quality=self.quality_, max_side=self.max_side)
        r = files.withColumn("r", f(F.col("content"), F.coalesce(media_format(F.col("content")), F.lit("unknown bytes")), F.lit(self.target)))
        return r.withColumn("content", F.col("r.content")).withColumn("error", F.col("r.error")).drop("r")


@dataclass(frozen=True)
class AudioPipeline:
    """Channels, then rate, gain and peak; the result is WAV."""

    options: dict = field(default_factory=dict)

    def _with(self, **more) -> AudioPipeline:
        return AudioPipeline(self.options | more)

    def channels(self, n: int) -> AudioPipeline:
        return self._with(channels=n)

    def sample_rate(self, rate: int) -> AudioPipeline:
        return self._with(rate=rate)

    def gain(self, factor: float) -> AudioPipeline:
        return self._with(gain=factor)

    def normalize(self) -> AudioPipeline:
        return self._with(normalize=True)

    def bits(self, n: int) -> AudioPipeline:
        return self._with(bits=n)

    def __call__(self, files: DataFrame) -> DataFrame:
        r = files.withColumn("r", udfs.audio_converter(**self.options)(F.col("content")))
        return r.withColumn("content", F.col("r.content")).withColumn("error", F.col("r.error")).drop("r")


def clean_path(path: Column, out: Column | None = None, in_place: bool = False) -> Column:
    """Where a scrubbed file goes: in place, to the given path, or beside it as name.clean.ext."""
    if in_place:
        return path
    beside = F.when(path.rlike(r"[^/]\.[^./]+$"), F.regexp_replace(path, r"\.([^./]+)$", ".clean.$1")).otherwise(F.concat(path, F.lit(".clean")))
    return beside if out is None else F.coalesce(out, beside)


def sanitize(files: DataFrame, overlay_only: bool = False, strict: bool = False, in_place: bool = False) -> DataFrame:
    """path, output, original_size, sanitized_size, bytes_removed, content, error; `warning` where an overlay
    couldn't be looked for because a chunk overruns the file."""
    f = udfs.cut_overlay if overlay_only else udfs.scrub_strict if strict else udfs.scrub
    r = files.select("path", "content", f(F.col("content")).alias("r"), udfs.parse(F.col("content"), F.lit(None).cast("string"))["error"].alias("broken"))
    old, new = F.octet_length("content").cast("long"), F.octet_length("r.content").cast("long")
    warning = F.when(F.lit(overlay_only) & F.col("broken").isNotNull(), F.col("broken.message"))
    return r.select("path", clean_path(F.col("path"), in_place=in_place).alias("output"), old.alias("original_size"), new.alias("sanitized_size"), F.greatest(old - new, F.lit(0)).alias("bytes_removed"), F.col("r.content").alias("content"), F.col("r.error").alias("error"), warning.alias("warning"))


def comments(files: DataFrame) -> DataFrame:
    """path, pos, key, value: comments of JPEG files (no key) and texts of PNG files."""
    j, p = udfs.jpeg_comments(F.col("content"))["comments"], udfs.png_texts(F.col("content"))["texts"]
    pair = "array<struct<key: string, value: string>>"
    both = files.select("path", j.alias("j"), p.alias("p")).select("path", F.concat(F.coalesce(F.transform("j", lambda x: F.struct(F.lit(None).cast("string").alias("key"), x.alias("value"))), F.array().cast(pair)), F.coalesce("p", F.array().cast(pair))).alias("t"))
    return both.select("path", F.posexplode("t").alias("pos", "x")).select("path", "pos", "x.key", "x.value")


def set_comment(files: DataFrame, text: str | None, key: str = "Description") -> DataFrame:
    """path, content, error: the comment (JPEG) or the text of a key (PNG) set, or removed for null."""
    from ..functions.detect import container

    kind, value = container(F.col("content")), F.lit(text or "")
    j = udfs.set_jpeg_comment(F.when(kind == "jpeg", F.col("content")), value)
    p = udfs.set_png_text(F.when(kind == "png", F.col("content")), F.lit(key), value)
    other = F.struct(F.lit(None).cast("binary").alias("content"), F.struct(F.lit("UnsupportedFormat").alias("code"), F.lit("Unsupported media format: comments are edited in JPEG and PNG").alias("message")).alias("error"))
    return files.select("path", F.coalesce(F.when(kind == "jpeg", j), F.when(kind == "png", p), other).alias("r")).select("path", "r.*")


def plan_pairs(inputs: list[str], output: str | None = None, target: str | None = None, output_is_folder: bool = False) -> list[tuple[str, str]]:
    """(input, output) of a conversion named as: two files; a file and an output; a file and a target format; any
    number of files, a target format and, if given, a folder (else the current one)."""
    if len(inputs) == 2 and output is None and target is None:
        return [(inputs[0], inputs[1])]
    if len(inputs) == 1 and output is not None and not output_is_folder:
        return [(inputs[0], output)]
    if not target:
        raise walkers.Malformed("ConversionError", "Conversion error: give two files, or files and a target format")
    stem = lambda path: posixpath.splitext(path)[0]
    if len(inputs) == 1 and output is None:
        return [(inputs[0], f"{stem(inputs[0])}.{target}")]
    return [(path, posixpath.join(output or ".", f"{stem(posixpath.basename(path))}.{target}")) for path in inputs]


def convert_stream(data: bytes, target: str, quality: int = 85, **audio) -> tuple[bytes, dict]:
    """Bytes of a pipe converted (sound for any audio or video target, as WAV; pictures keep their size), and the
    report of it."""
    if not data:
        raise walkers.Malformed("EmptyFile", "File is empty: <stdin>")
    goal = target.lstrip(".").lower()
    if goal in AV_EXTENSIONS:
        out, kind = codecs.convert_audio(data, **audio), "audio transcode to WAV"
    else:
        source = walkers.sniff(data) or ("bmp" if data[:2] == b"BM" else "tiff" if data[:4] in (b"II*\0", b"MM\0*") else "unknown bytes")
        out, kind = codecs.transcode_image(data, source, {"jpg": "jpeg", "tif": "tiff"}.get(goal, goal), quality), f"image transcode to {goal.upper()}"
    return out, {"input_path": "<stdin>", "output_path": "<stdout>", "input_bytes": len(data), "output_bytes": len(out), "output_format": target, "details": f"{kind} ({len(data)} bytes)"}


def convert_report(report: dict, as_json: bool = False) -> str:
    """What a conversion did, as pretty JSON or as lines of name and value that can't drive a terminal."""
    if as_json:
        return json.dumps(report, indent=2, ensure_ascii=False)
    clean = lambda v: "".join(c for c in str(v) if c.isprintable())
    width = max(map(len, report), default=0)
    return "\n".join(f"{k.ljust(width)} | {clean(v)}" for k, v in report.items())


def batch_report(items: DataFrame, as_json: bool = False) -> str:
    """Counts and bytes of a batch (one row reaches the driver)."""
    from .reports import batch_summary

    return convert_report(batch_summary(items).first().asDict(), as_json)


def write_batch(files: DataFrame, b, root: str, staging: str) -> DataFrame:
    """Converts a batch, writes what came out below `root`, and gives its report without the bytes. Conversions
    run once: their rows are written to `staging`, a new folder that executors share, and read from there."""
    from ..sources import sink
    from .reports import batch_convert

    spark: SparkSession = files.sparkSession
    batch_convert(files, b).write.parquet(staging)
    done = spark.read.parquet(staging)
    sink.write_files(done, root, path_col="output")
    return done.drop("content")


def text_table(rows: DataFrame, columns: list[str], limit: int | None = None) -> str:
    """All rows, or the first ones, as a table for a terminal, without anything that could drive it."""
    shown = rows.select(*(F.coalesce(scrub_terminal(F.col(c).cast("string")), F.lit("")).alias(c) for c in columns))
    got = (shown if limit is None else shown.limit(limit)).collect()
    width = [max([len(c), *(len(r[c]) for r in got)]) for c in columns]
    line = lambda cells: " | ".join(x.replace("\n", " ").ljust(w) for x, w in zip(cells, width, strict=True)).rstrip()
    return "\n".join([line(columns), "-+-".join("-" * w for w in width), *(line([r[c] for c in columns]) for r in got)])
