"""Benchmark decontamination by a prefix-filtered join of item windows with whole documents.

An item's windows (13 consecutive words, or all words of a shorter item) are sets that must be contained
whole in a document, so of each window's words, ordered by rarity in all documents, the rarest one alone is
the necessary prefix. Documents stream once as (position, word); a word meets the windows whose prefix it
is, position and length bounds drop those that would reach over the text's ends, and the rest is compared
word for word in place. Only the hits are shuffled; texts never are.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import materialize

#: What stands between words once A-Z are in lower case.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 13
#: Windows whose prefix is broadcast at once (about 150 bytes each); more windows take more passes.
BLOCK_WINDOWS = 100_000
#: Distinct benchmark words broadcast for counting; more are joined by a shuffle of counts.
BROADCAST_WORDS = 1_000_000


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN), "")


def item_windows(items: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """item, window array<string>: a row for each place of a window in an item."""
    split = items.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")).where((F.size("w") > 0) & F.col("item").isNotNull())
    size = F.least(F.size("w"), F.lit(window))
    return split.select("item", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - size + 1), lambda i: F.slice("w", i, size))).alias("window"))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """`id`, th (hash of the text), n_words, n_hit (words inside an occurring window), n_items, items (ids as
    sorted strings) for every row.

    Null and wordless texts have no words; items that are null, wordless or without an id never match.
    Repeated items share their windows and are all listed; repeated documents each keep their row. With an
    empty benchmark nothing is hit. All work is DataFrame operations."""
    by_item = materialize(item_windows(items, window, item_id, item_text), "item-windows")
    windows = materialize(by_item.select("window").distinct().withColumn("wid", F.monotonically_increasing_id()), "windows")
    vocabulary = materialize(windows.select(F.explode("window").alias("word")).distinct(), "benchmark-words")
    known = F.broadcast(vocabulary) if vocabulary.count() <= BROADCAST_WORDS else vocabulary
    split = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), words(F.col(text_col)).alias("w"))
    counts = materialize(split.select(F.explode("w").alias("word")).join(known, "word", "left_semi").groupBy("word").count(), "benchmark-counts")
    spots = windows.select("wid", "window", F.posexplode("window").alias("offset", "word")).join(counts, "word", "left")
    rarest = spots.groupBy("wid").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("count"), "word", "offset")).alias("p"), F.first("window").alias("window"))
    # a window with a word that no document has can't occur
    prefixes = materialize(rarest.where("p.count > 0").select("wid", F.col("p.word").alias("word"), F.col("p.offset").alias("offset"), F.size("window").alias("len"), "window"), "prefixes")
    # the empty word, which no text has, ends every document and so brings its row and number of words along
    end = docs.sparkSession.createDataFrame([(None, "", 0, 0, None)], prefixes.schema)
    stream = split.select("id", "th", "w", F.posexplode(F.concat("w", F.array(F.lit("")))).alias("at", "word"))
    start = F.col("at") - F.col("offset")
    fits = (F.col("word") == "") | ((start >= 0) & (start + F.col("len") <= F.size("w")) & (F.slice("w", F.greatest(start, F.lit(0)) + 1, F.col("len")) == F.col("window")))
    blocks = max(1, -(-prefixes.count() // BLOCK_WINDOWS))
    hits = None
    for k in range(blocks):
        block = prefixes if blocks == 1 else prefixes.where(F.pmod(F.xxhash64("wid"), F.lit(blocks)) == k)
        if k == 0:
            block = block.unionByName(end)
        found = stream.join(F.broadcast(block), "word").where(fits).select("id", "th", start.alias("start"), "len", "wid")
        hits = found if hits is None else hits.unionByName(found)
    hits = materialize(hits, "hits")
    per_doc = Window.partitionBy("id", "th").orderBy("start", "len").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max(F.when(F.col("wid").isNotNull(), F.col("start") + F.col("len"))).over(per_doc), F.lit(0))
    new = F.when(F.col("wid").isNotNull(), F.greatest(F.lit(0), F.col("start") + F.col("len") - F.greatest(reach, F.col("start")))).otherwise(0)
    covered = hits.withColumn("new", new).groupBy("id", "th").agg(F.max(F.when(F.col("wid").isNull(), F.col("start"))).cast("long").alias("n_words"), F.sum("new").cast("long").alias("n_hit"), F.count(F.when(F.col("wid").isNull(), 1)).alias("copies"))
    occurring = hits.where(F.col("wid").isNotNull()).select("id", "th", "wid").distinct()
    named = occurring.join(by_item.join(windows, "window").select("wid", "item").distinct(), "wid").groupBy("id", "th").agg(F.sort_array(F.collect_set("item")).alias("items"))
    named = named.select(F.col("id").alias("i"), F.col("th").alias("t"), "items")
    out = covered.join(named, F.col("id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("t")), "left")
    items_ = F.coalesce("items", F.array().cast("array<string>"))
    # repeated rows were counted together and come apart again
    return out.select(F.col("id").alias(id_col), "th", F.explode(F.array_repeat(F.struct("n_words", "n_hit", F.size(items_).cast("long").alias("n_items"), items_.alias("items")), F.col("copies").cast("int"))).alias("r")).select(id_col, "th", "r.*")


def is_contaminated() -> Column:
    """At least one word in twenty is inside a benchmark window."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    out = decontaminate(docs, items)
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), is_contaminated().alias("contaminated"))


ORACLE = r"""
WITH lowered AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, len, array_to_string(w[i:i + len - 1], ' ') AS s
  FROM (SELECT item_id, w, least(13, len(w)) AS len, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)),
spots AS (
  SELECT doc_id, i, l.len, array_to_string(w[i:i + l.len - 1], ' ') AS s
  FROM (SELECT doc_id, w, l.len, unnest(range(1, len(w) - l.len + 2)) AS i FROM lowered, (SELECT DISTINCT len FROM windows) l WHERE len(w) >= l.len) l),
hits AS (SELECT doc_id, i, spots.len, item_id FROM spots JOIN windows USING (s)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + len)) AS p FROM (SELECT DISTINCT doc_id, i, len FROM hits)) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM lowered LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""
