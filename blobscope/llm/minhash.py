"""Near-duplicate documents by min-max hashing, banding and exact confirmation.

Under each permutation both the minimum and the maximum of a document's shingle hashes are kept, so half
the hash evaluations give a signature of full length; each value agrees for two documents with probability
equal to their similarity. Bands of equal values make candidates, and every candidate link is confirmed on
the full shingle sets.

Documents with equal sets form one class, which is a single node from then on. Candidate pairs come in two
steps. First each bucket links the class with the fewest shingles of its own with its other classes: as many
pairs as members. Then only buckets whose classes are still in different components compare the classes
across components. In both steps only pairs go on whose sets may share enough, by exact bounds: shingles that
no other class has, and bits that only one of two sets has. So a large group of near copies never meets
itself pairwise, and no link that could join components is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import slices
from .components import components
from .scratch import materialize
from .words import WORDS, distinct, mix, run_hashes, split
from .workers import bounded, task

#: Candidate texts are picked by a broadcast list of 64-bit keys up to this many (8 bytes each), and by a
#: shuffled join beyond.
BROADCAST_KEYS = 500_000
#: Bits of the map that bounds what two sets share: 64 times this power of two.
BITMAP_WORDS = 16


@dataclass(frozen=True)
class MinMax:
    """Shingle length, similarity (as a fraction) and banding. 65 permutations give 130 values in 26 bands
    of 5: a link at similarity 0.85 is missed with probability 2.4e-7, at 0.8 with 3.3e-5."""

    shingle: int = 5
    numerator: int = 80
    denominator: int = 100
    permutations: int = 65
    rows: int = 5
    seed: int = 20240531

    def coefficients(self) -> tuple[np.ndarray, np.ndarray]:
        r = np.random.default_rng(self.seed)
        return r.integers(0, 2**64, self.permutations, np.uint64) | np.uint64(1), r.integers(0, 2**64, self.permutations, np.uint64)


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles of a text with A-Z in lower case; of fewer words the
    whole sequence is one; none without words."""
    words = split(text, lower=True)
    if not words:
        return np.zeros(0, np.uint64)
    return distinct(run_hashes(WORDS.of(words), min(k, len(words))))


def band_keys(sets: list[np.ndarray], p: MinMax) -> np.ndarray:
    """Bucket keys, a row for each (non-empty) set and a column for each band."""
    flat, starts = np.concatenate(sets), np.cumsum([0] + [len(s) for s in sets[:-1]])
    a, b = p.coefficients()
    values = np.empty((2 * p.permutations, len(sets)), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(p.permutations):
            y = ((flat * a[i] + b[i]) >> np.uint64(32)).astype(np.uint32)
            values[i] = np.minimum.reduceat(y, starts)
            values[p.permutations + i] = np.maximum.reduceat(y, starts)
        n = len(values) // p.rows
        keys = np.zeros((n, len(sets)), np.uint64) + np.arange(1, n + 1, dtype=np.uint64)[:, None]
        for j in range(p.rows):
            keys = mix(keys ^ values[j : n * p.rows : p.rows])
    return keys.T


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def sign(df: DataFrame, p: MinMax, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, th (hash of the text), n_shingles, digest (128 bits of the shingle set; null if empty), bands."""
    source = bounded(df).select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    id_type = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2).to_pylist()
            for s, t in slices([x or "" for x in texts]):
                sets = [shingle_set(x, p.shingle) for x in texts[s:t]]
                full = [i for i, x in enumerate(sets) if len(x)]
                keys = band_keys([sets[i] for i in full], p).astype(np.int64) if full else np.zeros((0, 1), np.int64)
                place = dict(zip(full, range(len(full)), strict=True))
                ends = np.cumsum([0] + [keys.shape[1] * (i in place) for i in range(len(sets))]).astype(np.int32)
                digests = [_digest(x) if len(x) else None for x in sets]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(s, t - s), b.column(1).slice(s, t - s), pa.array([len(x) for x in sets], pa.int64()), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel()))], ["id", "th", "n_shingles", "digest", "bands"])

    return source.mapInArrow(task(run, "words"), f"id {id_type}, th long, n_shingles long, digest binary, bands array<long>")


def full_sets(df: DataFrame, classes: DataFrame, wanted: DataFrame, p: MinMax, text_col: str = "text") -> DataFrame:
    """node, shingles array<long> and bits of the wanted nodes, from one text of each class."""
    picked = materialize(classes.join(wanted, "node", "left_semi").select("node", "th", "digest"), "picked")
    if picked.count() <= BROADCAST_KEYS:
        picked = F.broadcast(picked)
    source = bounded(df).select(F.col(text_col).alias("text")).withColumn("th", F.xxhash64("text")).join(picked, "th").select("node", "digest", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()  # copies in this task; others go below
        for b in batches:
            nodes, sets = [], []
            for node, digest, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if node not in done:
                    s = shingle_set(text.as_py(), p.shingle)
                    # another text with this hash isn't of the class
                    if _digest(s) == digest:
                        done.add(node)
                        nodes.append(node)
                        sets.append(s)
            ends = np.cumsum([0] + [len(s) for s in sets]).astype(np.int32)
            flat = np.concatenate(sets).astype(np.int64) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array([bitmap(s).tolist() for s in sets], pa.list_(pa.int64()))], ["node", "shingles", "bits"])

    return materialize(source.mapInArrow(task(run, "words"), "node long, shingles array<long>, bits array<long>").groupBy("node").agg(F.first("shingles").alias("shingles"), F.first("bits").alias("bits")), "sets")


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """BITMAP_WORDS * 64 bits, those set at which a shingle falls."""
    bits = np.zeros(BITMAP_WORDS * 64, np.uint8)
    bits[(shingles >> np.uint64(64 - (BITMAP_WORDS * 64).bit_length() + 1)).astype(np.int64)] = 1
    return np.packbits(bits).view(np.int64)


def _may_link(p: MinMax) -> Column:
    """Whether two classes (columns n, rest and bits of a and b) can reach the similarity: a bit that only
    one of them sets stands for a shingle that the other hasn't."""
    only = lambda x, y: sum((F.bit_count(F.get(f"bits_{x}", F.lit(i)).bitwiseAND(F.bitwise_not(F.get(f"bits_{y}", F.lit(i))))) for i in range(1, BITMAP_WORDS)), F.bit_count(F.get(f"bits_{x}", F.lit(0)).bitwiseAND(F.bitwise_not(F.get(f"bits_{y}", F.lit(0))))))
    share = F.least("rest_a", "rest_b", F.col("n_a") - only("a", "b"), F.col("n_b") - only("b", "a"))
    return share * p.denominator >= (F.col("n_a") + F.col("n_b") - share) * p.numerator


def confirm(pairs: DataFrame, sets: DataFrame, p: MinMax) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    counted = both.select("a", "b", F.size(F.array_intersect("x", "y")).cast("long").alias("i"), (F.size("x") + F.size("y")).cast("long").alias("n"))
    return counted.where(F.col("i") * p.denominator >= (F.col("n") - F.col("i")) * p.numerator).select("a", "b")


def labels(df: DataFrame, p: MinMax, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As near_duplicates, with the hash of the text (th)."""
    signed = materialize(sign(df, p, id_col, text_col), "signed")
    classes = materialize(signed.where(F.col("digest").isNotNull()).groupBy("digest").agg(F.min("id").alias("first_id"), F.min("th").alias("th"), F.first("bands").alias("bands"), F.first("n_shingles").alias("n")).withColumn("node", F.monotonically_increasing_id()), "classes")
    members = classes.select("node", "n", F.explode("bands").alias("bucket"))
    # keys that groups share are tables of their own, so that a join with a hot bucket can be split
    shared = materialize(members.groupBy("bucket").agg(F.count("*").alias("k")).where("k > 1"), "shared-buckets")
    grouped = materialize(members.join(shared, "bucket").select("bucket", "node", "n"), "buckets")
    sets = full_sets(df, classes, grouped.select("node").distinct(), p, text_col)
    # shingles that no other class has can't be shared: a class with too many of them has no partner, and
    # two classes share at most the rest of either
    alone = sets.select("node", F.explode("shingles").alias("s")).groupBy("s").agg(F.count("*").alias("k"), F.min("node").alias("node")).where("k = 1").groupBy("node").agg(F.count("*").alias("alone"))
    facts = sets.select("node", F.size("shingles").cast("long").alias("n"), "bits").join(alone, "node", "left").select("node", "n", "bits", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("rest"))
    facts = materialize(facts.where(F.col("rest") * p.denominator >= F.col("n") * p.numerator), "facts")
    # the class with the fewest shingles of its own is the likeliest to link with the others of its bucket
    able = grouped.select("bucket", "node").join(facts.select("node", (F.col("rest") / F.col("n")).alias("common")), "node")
    pivots = materialize(able.groupBy("bucket").agg(F.count("*").alias("size"), F.max(F.struct("common", "node")).alias("p")).where("size > 1").select("bucket", "size", F.col("p.node").alias("pivot")), "pivots")
    able = materialize(able.select("bucket", "node").join(pivots, "bucket"), "able")
    first = able.where("node != pivot").select(F.least("pivot", "node").alias("a"), F.greatest("pivot", "node").alias("b")).distinct()
    side = lambda x: facts.select(*(F.col(c).alias(x if c == "node" else f"{c}_{x}") for c in ("node", "n", "rest", "bits")))
    first = materialize(first.join(side("a"), "a").join(side("b"), "b").where(_may_link(p)).select("a", "b"), "first-pairs")
    links = materialize(confirm(first, sets, p), "confirmed")
    roots = components(links)
    # buckets of two are settled; of the others those that still hold several components
    open_ = able.where("size > 2").select("bucket", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = open_.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("bucket")
    mixed = materialize(mixed, "mixed-buckets")
    open_ = materialize(open_.join(mixed, "bucket").join(facts, "node"), "open")
    left, right = (open_.select("bucket", *(F.col(c).alias(f"{c}_{x}") for c in ("node", "root", "n", "rest", "bits"))) for x in "ab")
    across = left.join(right, "bucket").where((F.col("node_a") < F.col("node_b")) & (F.col("root_a") != F.col("root_b")) & _may_link(p))
    second = across.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()
    more = materialize(confirm(second, sets, p), "confirmed")
    if not more.isEmpty():
        roots = components(links.unionByName(more))
    labelled = classes.select("digest", "node", "first_id").join(materialize(roots, "roots"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = labelled.groupBy("root").agg(F.min("first_id").alias("component_id"))
    components_ = materialize(labelled.join(lowest, "root").select("digest", "component_id"), "component-ids")
    out = signed.select("id", "th", "n_shingles", "digest").join(components_, "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), "th", "n_shingles", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def near_duplicates(df: DataFrame, p: MinMax, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id`, n_shingles (size of the set), component_id (smallest id that links reach), kept (it is that one).

    Null and wordless texts have an empty set and are linked with nothing. Equal ids or repeated rows: each
    row is returned; equal sets (by 128 bits) are linked. A null id is larger than all others. Ties of a pivot go to
    the larger node and change no result. An empty table gives none, other columns don't matter. A task holds a
    slice of texts and its sets; of a longer text its words and set."""
    return labels(df, p, id_col, text_col).drop("th")


def drop_near_duplicates(df: DataFrame, p: MinMax, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `df` without those that near_duplicates doesn't keep; of repeated rows one stays."""
    found = labels(df, p, id_col, text_col)
    rows = found.groupBy(id_col, "th").agg(F.count("*").alias("n"), F.max("kept").alias("kept"))
    out = without(df, rows.where(~F.col("kept")), id_col, text_col)
    if rows.where((F.col("n") > 1) & F.col("kept")).isEmpty():
        return out
    # repeated rows come next to each other; a wordless text may repeat as well
    return out.withColumn("__th", F.xxhash64(text_col)).dropDuplicates([id_col, "__th"]).drop("__th")


def without(df: DataFrame, bad: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `df` whose id and text hash (th) aren't in `bad`. A list of at most BROADCAST_KEYS keys
    is broadcast, a longer one is joined by a shuffle."""
    bad = materialize(bad.select(F.col(id_col).alias("__id"), F.col("th").alias("__th")).distinct(), "dropped")
    keys = F.broadcast(bad) if bad.count() <= BROADCAST_KEYS else bad
    return df.join(keys, df[id_col].eqNullSafe(F.col("__id")) & (F.xxhash64(df[text_col]) == F.col("__th")), "left_anti")
