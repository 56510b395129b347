"""Token counts through a digest cache, and token ids in bit-packed files.

Both take whole texts (null: empty) and count or encode them exactly as the tokenizer's own library does,
without added special tokens."""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import _PLAIN, slices
from .scratch import among_keys, materialize, scratch_path
from .workers import bounded, memo, task


class LibraryEncoder:
    """Ids of texts as tokenizers (.json) or sentencepiece (.model) gives them, as 32-bit bytes.

    A plain byte-level BPE file whose ids are its merge ranks is also loaded into tiktoken's engine, which
    gives the same ids several times as fast; texts beyond the letters on which all Unicode versions agree,
    and those it can't take, go through tokenizers itself."""

    def __init__(self, path: str):
        self.fast = self.pieces = self.library = None
        if path.endswith(".model"):
            import sentencepiece

            self.pieces = sentencepiece.SentencePieceProcessor(model_file=path)
            return
        import tokenizers

        self.library = tokenizers.Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.fast = self._ranks(path, spec)

    @staticmethod
    def _ranks(path: str, spec: dict):
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        if spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
            return None
        from .bpe import _PIECES, Vocabulary

        v = Vocabulary(path)
        if sorted(v.first) != list(range(256)) or v.merged != list(range(256, 256 + len(v.merged))):
            return None
        import tiktoken

        special = set(v.special.values())
        return tiktoken.Encoding(path, pat_str=_PIECES.pattern, mergeable_ranks={b: i for i, b in enumerate(v.bytes) if b and i not in special}, special_tokens=v.special)

    def ids(self, texts: list[str]) -> list[bytes]:
        if self.pieces:
            return [np.array(x, "<u4").tobytes() for x in self.pieces.encode(texts, num_threads=1)]
        out: list[bytes | None] = [None] * len(texts)
        rest = []
        for i, t in enumerate(texts):
            if self.fast and (t.isascii() or max(t) <= _PLAIN):
                try:
                    out[i] = self.fast.encode_to_numpy(t, allowed_special="all").astype("<u4", copy=False).tobytes()
                    continue
                except BaseException as e:  # the engine's own panic isn't an Exception
                    if isinstance(e, KeyboardInterrupt | SystemExit | MemoryError):
                        raise
            rest.append(i)
        if rest:
            for i, x in zip(rest, self.library.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False), strict=True):
                out[i] = np.array(x.ids, "<u4").tobytes()
        return out


_LIBRARY: dict[str, LibraryEncoder] = {}
memo("library", _LIBRARY.clear)


def library_encoder(path: str) -> LibraryEncoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    if path not in _LIBRARY:
        _LIBRARY[path] = LibraryEncoder(path)
    return _LIBRARY[path]


def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer's file and kind: counts of another version are never taken."""
    with open(path, "rb") as f:
        return hashlib.sha256(path.rpartition(".")[2].encode() + b"\0" + f.read()).hexdigest()


CACHE_SCHEMA = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("version", T.StringType()), T.StructField("n_tokens", T.LongType())])


def _cached(spark, path: str, version: str) -> DataFrame:
    """Stored counts of one version. Writers that ran at once may have stored a digest twice."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    stored = spark.read.schema(CACHE_SCHEMA).parquet(path) if there else spark.createDataFrame([], CACHE_SCHEMA)
    return stored.where(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(df: DataFrame, tokenizer_path: str, cache_path: str, id_col: str = "doc_id", text_col: str = "text", normalise: Callable[[Column], Column] | None = None) -> DataFrame:
    """`id`, n_bytes (UTF-8, of the text), n_tokens: counts come from the cache; distinct missing contents
    are encoded once and appended to it.

    Content is the text after `normalise` (default: as it is, as any change would change counts), null is
    empty; its key is its sha256 with the tokenizer's version. Repeated rows and copies share one entry and
    each keeps its own row; an empty table has no rows. Digests alone meet the cache; texts move only where their
    digest is missing (up to a few that a map of bits can't tell), and copies are merged before that, so a hot text
    is one row a task. A task holds a batch bounded by bytes; of a longer text that text and its ids. The
    counting job commits before the result reads it; a lost executor repeats only its tasks."""
    spark = df.sparkSession
    version = tokenizer_version(tokenizer_path)
    text = F.coalesce(F.col(text_col), F.lit(""))
    content = normalise(text) if normalise else text
    digest = F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest")
    contents = bounded(df).select(content.alias("text")).select(digest, "text").withColumn("key", F.xxhash64("digest"))
    rows = df.select(F.col(id_col), F.octet_length(text).cast("long").alias("n_bytes"), F.unhex(F.sha2(content.cast("binary"), 256)).alias("digest"))
    # digests meet the cache first, and only texts of missing ones are moved
    missing = materialize(contents.select("digest", "key").distinct().join(_cached(spark, cache_path, version), "digest", "left_anti"), "missing-digests")
    wanted = among_keys(contents, "key", missing).groupBy("digest").agg(F.first("text").alias("text"))
    misses = wanted.join(missing.select("digest"), "digest", "left_semi")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = library_encoder(tokenizer_path)
        for b in batches:
            texts = b.column(1).to_pylist()
            n = [len(x) // 4 for s, t in slices(texts) for x in e.ids(texts[s:t])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([version] * len(n), pa.string()), pa.array(n, pa.int64())], ["digest", "version", "n_tokens"])

    misses.mapInArrow(task(count, "library"), CACHE_SCHEMA).write.mode("append").parquet(cache_path)
    # a table of its own, so that a join with a hot digest can be split
    counts = materialize(_cached(spark, cache_path, version), "token-counts")
    return rows.join(counts, "digest").select(id_col, "n_bytes", "n_tokens")


# Bit-packed ids. A segment is self-contained:
#   magic, bits, ids a block, ids, documents, blocks (HEADER); byte offset of each block and of the end (u64);
#   first id of each document and the end (u64); document ids (i64); their validity (u8); the blocks.
# Within a block, each id takes `bits` bits, most significant first.
MAGIC = b"BSID"
HEADER = struct.Struct("<4sHHIQII")
BLOCK_IDS = 8192
SEGMENT_IDS = 1 << 20


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Fixed-width packing of ids below 2**bits (1 to 32 bits), without Python loops."""
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id does not fit {bits} bits")
    if bits in (8, 16, 32):
        return ids.astype(f">u{bits // 8}").tobytes()
    planes = np.unpackbits(ids.astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)[:, 32 - bits :]
    return np.packbits(planes).tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f">u{bits // 8}", n).astype(np.uint32)
    planes = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits).reshape(n, bits)
    wide = np.zeros((n, 32), np.uint8)
    wide[:, 32 - bits :] = planes
    return np.packbits(wide, axis=1).view(">u4").ravel().astype(np.uint32)


def write_segment(doc_ids: list[int | None], parts: list[np.ndarray], bits: int, block_ids: int = BLOCK_IDS) -> bytes:
    ids = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
    blocks = [pack(ids[i : i + block_ids], bits) for i in range(0, len(ids), block_ids)]
    starts = np.cumsum([0] + [len(p) for p in parts]).astype("<u8")
    head = HEADER.size + 8 * (len(blocks) + 1) + 8 * len(starts) + 9 * len(parts)
    offsets = (head + np.cumsum([0] + [len(b) for b in blocks])).astype("<u8")
    known = np.array([x is not None for x in doc_ids], np.uint8)
    return b"".join([HEADER.pack(MAGIC, 1, bits, block_ids, len(ids), len(parts), len(blocks)), offsets.tobytes(), starts.tobytes(), np.array([x or 0 for x in doc_ids], "<i8").tobytes(), known.tobytes(), *blocks])


@dataclass
class Segment:
    """Random access to a packed segment (bytes, or a memory-mapped file)."""

    data: bytes

    def __post_init__(self):
        magic, _, self.bits, self.block_ids, self.n_ids, self.n_docs, self.n_blocks = HEADER.unpack_from(self.data)
        if magic != MAGIC:
            raise ValueError("not a segment of packed ids")
        at = HEADER.size
        self.offsets = np.frombuffer(self.data, "<u8", self.n_blocks + 1, at)
        at += 8 * (self.n_blocks + 1)
        self.starts = np.frombuffer(self.data, "<u8", self.n_docs + 1, at)
        at += 8 * (self.n_docs + 1)
        ids, known = np.frombuffer(self.data, "<i8", self.n_docs, at), np.frombuffer(self.data, np.uint8, self.n_docs, at + 8 * self.n_docs)
        self.doc_ids = [int(x) if k else None for x, k in zip(ids, known, strict=True)]

    def ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids from start to stop of the segment; only their blocks are read."""
        stop = self.n_ids if stop is None else min(stop, self.n_ids)
        if start >= stop:
            return np.zeros(0, np.uint32)
        first, last = start // self.block_ids, (stop - 1) // self.block_ids
        parts = [unpack(self.data[int(self.offsets[k]) : int(self.offsets[k + 1])], min(self.block_ids, self.n_ids - k * self.block_ids), self.bits) for k in range(first, last + 1)]
        return np.concatenate(parts)[start - first * self.block_ids : stop - first * self.block_ids]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))


SEGMENTS = "part int, part_start long, n_ids long, n_docs int, first_doc long, payload binary"


def write_ids(df: DataFrame, tokenizer_path: str, out: str, vocabulary: int, end_id: int | None = 0, id_col: str = "doc_id", text_col: str = "text", segment_ids: int = SEGMENT_IDS) -> None:
    """Encode every text, append `end_id`, and write packed segments to `out` in ascending order of id
    (nulls first; rows of one id by their text's hash).

    Texts are range-partitioned by id and sorted within a partition; a task writes its segments one after
    another, each of whole documents and about `segment_ids` ids. The segments travel in Parquet rows, so
    any store that Spark writes will do and retried tasks leave nothing; `payload` is the packed file."""
    bits = bits_for(vocabulary)
    source = bounded(df).select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    ordered = source.repartitionByRange("id", "h").sortWithinPartitions("id", "h").select("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, part = library_encoder(tokenizer_path), TaskContext.get().partitionId()
        tail = b"" if end_id is None else end_id.to_bytes(4, "little")
        docs, coded, n, before = [], [], 0, 0

        def row() -> pa.RecordBatch:
            payload = write_segment(docs, coded, bits)
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "part_start": pa.array([before], pa.int64()), "n_ids": pa.array([n], pa.int64()), "n_docs": pa.array([len(docs)], pa.int32()), "first_doc": pa.array([docs[0]], pa.int64()), "payload": pa.array([payload], pa.binary())})

        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for s, t in slices(texts):
                for i, x in zip(ids[s:t], e.ids(texts[s:t]), strict=True):
                    docs.append(i)
                    coded.append(np.frombuffer(x + tail, "<u4"))
                    n += len(coded[-1])
                    if n >= segment_ids:
                        yield row()
                        docs, coded, n, before = [], [], 0, before + n
        if docs:
            yield row()

    ordered.mapInArrow(task(run, "library"), SEGMENTS).write.option("compression", "none").parquet(out)


def segment_offsets(segments: DataFrame) -> DataFrame:
    """part, offset: ids before each part. One row a written partition: their number follows from the size
    of partitions, not from rows, and the window goes over these few sums alone."""
    sums = segments.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()
    total, rows = 0, []
    for r in sorted(sums):
        rows.append((r["part"], total))
        total += r["n"]
    return segments.sparkSession.createDataFrame(rows, "part int, offset long")


def read_ids(spark, out: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32 (of the ids as little-endian
    unsigned 32-bit integers), from the files alone."""
    segments = spark.read.schema(SEGMENTS).parquet(out)
    placed = segments.join(F.broadcast(segment_offsets(segments)), "part").select((F.col("offset") + F.col("part_start")).alias("start"), "payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for base, payload in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                s = Segment(payload.as_py())
                ids, starts = s.ids().astype("<u4"), s.starts.astype(np.int64)
                crc = [zlib.crc32(ids[x:y].tobytes()) for x, y in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(s.doc_ids, pa.int64()), pa.array(base + starts[:-1]), pa.array(np.diff(starts)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.mapInArrow(task(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def packed_round_trip(df: DataFrame, tokenizer_path: str, vocabulary: int) -> DataFrame:
    out = scratch_path(df.sparkSession, "packed")
    write_ids(df, tokenizer_path, out, vocabulary)
    return read_ids(df.sparkSession, out)


