"""Reports over files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans import reports
from ..sources.files import stream_files


def audit_stream(spark: SparkSession, path: str) -> DataFrame:
    """A streaming audit: one row a new file, without state."""
    return reports.audit(stream_files(spark, path).where("error IS NULL"))


def start(df: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append to Parquet exactly once for each file; what is there is worked off, then the query ends."""
    return df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
