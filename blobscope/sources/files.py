"""Files as rows: listing, guards and reading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.detect import extension
from ..operators.walkers import Malformed

MAX_BYTES = 256 << 20
#: Rows of file content in one Arrow batch, so that a batch of large files stays small.
CONTENT_ROWS = 16


def configure(spark: SparkSession) -> SparkSession:
    """Settings for work on whole files."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(CONTENT_ROWS))
    return spark


def guard(length: Column, path: Column) -> Column:
    """The error of a file that is missing (null), empty or too large; null if it may be read."""
    error = lambda code, message: F.struct(F.lit(code).alias("code"), message.alias("message"))
    return (
        F.when(length.isNull(), error("FileNotFound", F.concat(F.lit("File not found or unreadable: "), path)))
        .when(length == 0, error("EmptyFile", F.concat(F.lit("File is empty: "), path)))
        .when(length > MAX_BYTES, error("FileTooLarge", F.format_string(f"File size %d bytes exceeds maximum supported allocation limit of {MAX_BYTES} bytes", length)))
    )


def read_files(spark: SparkSession, path: str, extensions: list[str] | None = None) -> DataFrame:
    """path, modificationTime, length, content and error of all files below a folder. Content of a file that
    the guard refuses is null. The filter on extensions is case-insensitive and comes before any content is
    read; selecting only path and length reads none. (Spark's source leaves out empty files; see
    `list_files`.)"""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return _guarded(df, extensions)


def stream_files(spark: SparkSession, path: str, extensions: list[str] | None = None) -> DataFrame:
    """As read_files, for files as they arrive."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    df = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(path)
    return _guarded(df, extensions)


def _guarded(df: DataFrame, extensions: list[str] | None) -> DataFrame:
    if extensions:
        df = df.where(extension(F.col("path")).isin(*(e.strip().lstrip(".").lower() for e in extensions)))
    error = guard(F.col("length"), F.col("path"))
    return df.withColumn("error", error).withColumn("content", F.when(F.col("error").isNull(), F.col("content")))


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """path and length of all files below a folder, empty ones too, in order of path; no rows if it is not a
    folder. The listing is the file system's."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(conf)
    rows = []
    if fs.exists(root) and fs.getFileStatus(root).isDirectory():
        found = fs.listFiles(root, True)
        while found.hasNext():
            f = found.next()
            rows.append((f.getPath().toString(), f.getLen()))
    return spark.createDataFrame(sorted(rows), "path string, length long")


def from_bytes(spark: SparkSession, data: bytes, path: str = "<stdin>") -> DataFrame:
    """One row of bytes, as from a pipe."""
    if not data:
        raise Malformed("EmptyFile", f"File is empty: {path}")
    return spark.createDataFrame([(path, len(data), bytearray(data))], "path string, length long, content binary").withColumn("error", guard(F.col("length"), F.col("path")))


def parse_extensions(text: str) -> list[str]:
    return [x.strip() for x in text.split(",") if x.strip()]


def header(content: Column, n: int = 1024) -> Column:
    return F.substring(content, 1, n)
