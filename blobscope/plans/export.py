"""Reports as JSON, JSON lines and spreadsheet-safe CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.safety import escape_formula


def documents(rows: DataFrame, pretty: bool = False) -> DataFrame:
    """path and one JSON document a file: file, count, entries in order; null fields stay."""
    entry = F.struct("pos", F.lower("category").alias("category"), "tag_id", "key", "name", "value")
    files = rows.groupBy("path").agg(F.sort_array(F.collect_list(entry)).alias("e"))
    kept = F.transform("e", lambda x: F.struct(x["category"].alias("category"), x["tag_id"].alias("tag_id"), x["key"].alias("key"), x["name"].alias("name"), x["value"].alias("value")))
    body = F.struct(F.col("path").alias("file"), F.size("e").alias("count"), kept.alias("entries"))
    return files.select("path", F.to_json(body, {"ignoreNullFields": "false", "pretty": str(pretty).lower()}).alias("json"))


def csv_rows(rows: DataFrame) -> DataFrame:
    """file, category, tag_id (0x0000 or empty), key, name, value; no cell can be read as a formula."""
    tag = F.when(F.col("tag_id").isNull(), "").otherwise(F.format_string("0x%04X", F.col("tag_id")))
    return rows.select(escape_formula(F.col("path")).alias("file"), F.upper("category").alias("category"), tag.alias("tag_id"), *(escape_formula(F.col(c)).alias(c) for c in ("key", "name", "value")))


def write_csv(rows: DataFrame, path: str) -> None:
    csv_rows(rows).write.option("header", "true").option("escape", '"').csv(path)


def write_jsonl(rows: DataFrame, path: str) -> None:
    documents(rows).select("json").write.text(path)


def write_tsv(rows: DataFrame, path: str) -> None:
    """Field and value of each entry, separated by a tab."""
    rows.select(F.col("key").alias("field"), "value").write.option("sep", "\t").option("header", "true").csv(path)
