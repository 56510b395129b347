"""Sharding by sampled splitters: shards of near equal bytes in the order of a key.

The key of a record is the hash of its text and then its id, so equal texts stand together. Size-weighted
samples of keys give quantile splitters of many fine ranges; exact sums show which ranges are overfull, and
those are sampled again and subdivided.

Groups of equal texts of a hundredth of a shard and more (of which there are at most a hundred a shard) are
placed first, the largest first, each whole into the shard with most room; only one that has no room anywhere
is cut. The other groups fill the room that is left in the order of keys, each whole, by exact offsets of the
ranges and running sums inside them: the shard is the one in which the middle of the group falls.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import materialize

OVERHEAD = 16
#: Fine ranges: so many a shard, or one for so many rows, up to the most; samples for each.
RANGES_A_SHARD, ROWS_A_RANGE, MOST_RANGES, SAMPLES_A_RANGE = 8, 1_000_000, 20_000, 16
#: A range is overfull above so many times its share of bytes or rows; rounds of subdivision.
OVERFULL, ROUNDS = 3, 4
#: Groups of equal texts from this part of a shard on are placed one by one.
LARGE = 100
_LOWEST = -(2**63)


def _splitters(keys: list[tuple[int, int]], n: int, large: set[int]) -> list[tuple[int, int]]:
    """Up to n - 1 quantiles of the sorted keys. A text that holds one quantile alone starts a range with
    all its rows; a large group that holds several is cut at the ids drawn."""
    keys = sorted(keys)
    cuts = [keys[len(keys) * i // n] for i in range(1, n)] if keys else []
    often = {a for (a, _), (b, _) in zip(cuts, cuts[1:], strict=False) if a == b and a in large}
    return sorted({(h, d if h in often else _LOWEST) for h, d in cuts} | {(h, _LOWEST) for h in often})


def _lookup(spark: SparkSession, splitters: list[tuple[int, int]]) -> DataFrame:
    """coarse, base, cuts: the splitters by the key's top 12 bits, so that a row compares with few of them."""
    rows, at = [], 0
    for c in range(-2048, 2048):
        own = []
        base = at
        while at < len(splitters) and splitters[at][0] >> 52 == c:
            own.append(splitters[at])
            at += 1
        rows.append((c, base, own))
    return spark.createDataFrame(rows, "coarse long, base int, cuts array<struct<h: long, d: long>>")


def _ranged(keyed: DataFrame, splitters: list[tuple[int, int]]) -> DataFrame:
    found = keyed.withColumn("coarse", F.shiftright("h", 52)).join(F.broadcast(_lookup(keyed.sparkSession, splitters)), "coarse")
    below = F.filter("cuts", lambda s: (s["h"] < F.col("h")) | ((s["h"] == F.col("h")) & (s["d"] <= F.col("d"))))
    return found.withColumn("range", F.col("base") + F.size(below)).drop("coarse", "base", "cuts")


def _pack(groups: list[tuple[int, int]], total: int, shards: int) -> tuple[dict[int, list[tuple[int, int]]], list[int]]:
    """Of each large group (hash, bytes) its pieces (bytes up to which, shard), and the room left in each shard."""
    room = [total * (s + 1) // shards - total * s // shards for s in range(shards)]
    heap = [(-r, s) for s, r in enumerate(room)]
    heapq.heapify(heap)
    pieces: dict[int, list[tuple[int, int]]] = {}
    for h, size in sorted(groups, key=lambda g: (-g[1], g[0])):
        done, pieces[h] = 0, []
        while done < size or not pieces[h]:
            free, s = heapq.heappop(heap)
            take = size - done if -free >= size - done else max(-free, 0)
            done += take
            pieces[h].append((done, s))
            room[s] -= take
            heapq.heappush(heap, (free + take, s))
    return pieces, room


def shard_by_bytes(df: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id`, size (UTF-8 bytes and 16), text_crc32, shard, slot (from 0 without gaps in a shard).

    Each shard gets its share of bytes to within one small group of equal texts (below a hundredth of the
    share), or one record where a large group is cut; every group stays whole that finds room in a shard. Null
    texts have size 16 and the crc of no bytes. Ids that are no integers stand in the order of their hashes,
    null ids come first among equal texts; repeated rows are placed one after another. An empty table has no
    rows, other columns don't matter, a very long text is a large group. Samples only decide how the work is
    divided; the places follow from exact sums. All work is DataFrame operations: the driver sees the samples,
    the sums of ranges and the large groups, of which there are a bounded number."""
    spark, text = df.sparkSession, F.col(text_col)
    whole = df.schema[id_col].dataType.typeName() in ("byte", "short", "integer", "long")
    order = F.coalesce(F.col("id").cast("long") if whole else F.when(F.col("id").isNotNull(), F.xxhash64("id")), F.lit(_LOWEST))
    keyed = materialize(df.select(F.col(id_col).alias("id"), (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long").alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h")).withColumn("d", order), "keyed")
    total, n = keyed.agg(F.sum("size"), F.count("*")).first()
    total = total or 1
    large = keyed.groupBy("h").agg(F.sum("size").alias("bytes")).where(F.col("bytes") * (shards * LARGE) >= total).collect()
    pieces, room = _pack([(r["h"], r["bytes"]) for r in large], total, shards)
    ranges = min(MOST_RANGES, max(RANGES_A_SHARD * shards, n // ROWS_A_RANGE))
    draw = F.pmod(F.xxhash64(F.lit(11), "h", "d"), F.lit(2**53)) / float(2**53)
    samples = keyed.where(draw * total < F.col("size") * (ranges * SAMPLES_A_RANGE)).select("h", "d").collect()
    splitters = _splitters([(r["h"], r["d"]) for r in samples], ranges, pieces.keys())
    for _ in range(ROUNDS):
        sums = {r["range"]: (r["bytes"], r["rows"]) for r in _ranged(keyed, splitters).groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()}
        want = {k: max(b * ranges // total, r * ranges // n) for k, (b, r) in sums.items() if b * ranges > OVERFULL * total or r * ranges > OVERFULL * n}
        if not want:
            break
        # rows of one overfull range have the same chance, so that many small records are divided as well
        rates = spark.createDataFrame([(k, (w + 1) * SAMPLES_A_RANGE / sums[k][1]) for k, w in want.items()], "range int, rate double")
        again = F.pmod(F.xxhash64(F.lit(13), "h", "d"), F.lit(2**53)) / float(2**53)
        more: dict[int, list[tuple[int, int]]] = {k: [] for k in want}
        for r in _ranged(keyed, splitters).join(F.broadcast(rates), "range").where(again < F.col("rate")).select("range", "h", "d").collect():
            more[r["range"]].append((r["h"], r["d"]))
        grown = sorted({*splitters, *(s for k, keys in more.items() for s in _splitters(keys, want[k] + 1, pieces.keys()))})
        if len(grown) == len(splitters):
            break  # single keys can't be divided
        splitters = grown
    cut = spark.createDataFrame([(h, p) for h, p in pieces.items()], "h long, pieces array<struct<upto: long, shard: int>>")
    placed = materialize(_ranged(keyed, splitters).join(F.broadcast(cut), "h", "left").withColumn("small", F.when(F.col("pieces").isNull(), F.col("size")).otherwise(0)), "ranged")

    # bytes before each range: of small groups, and of each large group itself
    bounds = [0]
    for r in room:
        bounds.append(bounds[-1] + max(r, 0))
    before, rows, inside = 0, [], {}
    for r in sorted(placed.groupBy("range").agg(F.sum("small").alias("small")).collect()):
        first = max(0, bisect_right(bounds, before) - 1)
        last = max(first, bisect_right(bounds, before + r["small"]))
        rows.append((r["range"], before, first, bounds[first + 1 : last + 1]))
        before += r["small"]
    offsets = F.broadcast(spark.createDataFrame(rows, "range int, small_before long, first_shard int, bounds array<long>"))
    own = []
    for r in sorted(placed.where(F.col("pieces").isNotNull()).groupBy("h", "range").agg(F.sum("size").alias("bytes")).collect()):
        own.append((r["h"], r["range"], inside.get(r["h"], 0)))
        inside[r["h"]] = own[-1][2] + r["bytes"]
    own = F.broadcast(spark.createDataFrame(own, "h long, range int, large_before long"))

    running, group = Window.partitionBy("range").orderBy("h", "d").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("range", "h")
    summed = placed.withColumn("small_own", F.sum("small").over(running) - F.col("small")).withColumn("all_own", F.sum("size").over(running) - F.col("size"))
    summed = summed.withColumn("start", F.min("small_own").over(group)).withColumn("all_start", F.min("all_own").over(group)).withColumn("group_bytes", F.sum("small").over(group))
    middle = F.expr("small_before + start + group_bytes div 2")
    among = F.least(F.lit(shards - 1), F.col("first_shard") + F.size(F.filter("bounds", lambda b: b <= middle)))
    place = F.expr("large_before + all_own - all_start + size div 2")
    piece = F.element_at(F.filter("pieces", lambda p: p["upto"] > place), 1)["shard"]
    last_piece = F.element_at("pieces", -1)["shard"]
    sharded = summed.join(offsets, "range").join(own, ["h", "range"], "left").withColumn("shard", F.when(F.col("pieces").isNull(), among).otherwise(F.coalesce(piece, last_piece)))
    sharded = materialize(sharded.select("id", "size", "text_crc32", "h", "d", "range", F.col("shard").cast("int")), "sharded")

    # a range reaches into few shards: rows before it in each
    starts, rows = {}, []
    for r in sorted(sharded.groupBy("shard", "range").agg(F.count("*").alias("n")).collect()):
        rows.append((r["shard"], r["range"], starts.get(r["shard"], 0)))
        starts[r["shard"]] = rows[-1][2] + r["n"]
    starts = F.broadcast(spark.createDataFrame(rows, "shard int, range int, rows_before long"))
    nth = F.row_number().over(Window.partitionBy("shard", "range").orderBy("h", "d")) - 1
    return sharded.withColumn("nth", nth).join(starts, ["shard", "range"]).select(F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("rows_before") + F.col("nth")).alias("slot"))
