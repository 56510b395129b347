"""Shared scratch tables: where an operator cuts lineage or keeps a step that must not run twice."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of the map by which rows are picked before a shuffle (1 MB).
KEY_BITS = 1 << 23


def scratch_root(spark: SparkSession) -> str:
    """The folder every executor shares, as the cluster names it in spark.checkpoint.dir.

    Where that setting is absent on a single machine (tests, a laptop) a local folder is made, set, and removed
    at the end; on a cluster that would be no shared folder, so there it is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    kept = spark.conf.get("spark.blobscope.scratch", None)
    if not kept:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors share; the master is {master}")
        kept = tempfile.mkdtemp(prefix="blobscope-")
        atexit.register(shutil.rmtree, kept, ignore_errors=True)
        spark.conf.set("spark.blobscope.scratch", kept)
        spark.sparkContext.setCheckpointDir(kept)
    return kept


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path of its own for each call, so that runs neither share nor overwrite each other's steps."""
    return f"{scratch_root(spark)}/blobscope/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back: lineage ends here, on files that
    outlive any executor. Spark's commit protocol makes retried tasks harmless."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def append(df: DataFrame, table: DataFrame | None, name: str) -> DataFrame:
    """As `materialize`, but onto the files of `table`, where there is one."""
    if table is None:
        return materialize(df, name)
    df.write.mode("append").option("compression", "zstd").parquet(table.scratch_path)
    out = df.sparkSession.read.schema(df.schema).parquet(table.scratch_path)
    out.scratch_path = table.scratch_path
    return out


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files and broadcasts of finished steps now: it does so when the driver collects
    its garbage, which may be long after (spark.cleaner.periodicGC.interval)."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def discard(*tables: DataFrame) -> None:
    """Delete tables of `materialize` that nothing will read any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def among_keys(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """The rows of `df` whose key (a long) is among `keys` (a column of that name), and a few others: what is
    broadcast is a map of KEY_BITS bits, however many keys there are. Texts are picked by it before a shuffle."""
    bit = F.pmod(key, F.lit(KEY_BITS))
    name, at = F.bitmap_bucket_number(bit), F.bitmap_bit_position(bit)
    bits = F.broadcast(keys.select(name.alias("__name"), at.alias("__at")).groupBy("__name").agg(F.bitmap_construct_agg("__at").alias("__bits")))
    byte = F.conv(F.hex(F.substring("__bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return df.withColumn("__name", name).join(bits, "__name").where(F.getbit(byte, F.pmod(at, F.lit(8)).cast("int")) == 1).select(*df.columns)
