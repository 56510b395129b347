"""Removal of passages that repeat anywhere in a corpus, word for word.

A window is `window` consecutive words of one document; it recurs if its words also start anywhere else.

Confirm: every window is represented by the smallest hash among its `anchor`-word runs, so equal windows
fall under one anchor wherever they are, and meet there in one shuffle of hashes. What comes out are the
recurring passages, each once: the place of one copy (the smallest row), and the buckets of documents in
which its windows occur; nothing tells where. Anchors that a sample shows to be hot are dealt out window by
window instead; the sample only decides the split.

Compile: the passages are cut out of their one copy and sent to their buckets. Each bucket is a shard: it
compiles its passages into an Aho-Corasick automaton (a pattern of `anchor` words every window - anchor words,
so each window of a passage holds one), as no other passage can occur in its documents.

Locate: all documents stream through the automata of their bucket. Every hit is compared word for word with
the passages around it, and the windows that agree are removed. Without the automata nothing is located.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import among_keys, materialize
from .words import BASE, WORDS, among, mix, run_hashes, split
from .workers import bounded, task

#: Text that a task looks at together when it settles windows.
SLICE_BYTES = 8 << 20
#: Text of a bucket, about; patterns of one automaton (some 700 bytes each).
BUCKET_BYTES, SHARD_PATTERNS = 8 << 20, 60_000
#: One document in so many is looked at for hot anchors; an anchor is hot from so many sightings on, or from
#: this share of all sightings if that is more, so that the list stays below 1 / HOT_SHARE entries.
HOT_SAMPLE, HOT_SEEN, HOT_SHARE = 64, 32, 1e-5
#: Partitions of the last shuffle at most; beyond them a partition takes several buckets, one after another.
MOST_PARTITIONS = 20_000
#: Bytes of a window's hash that travel under its 64-bit anchor, and of a word in patterns and streams.
HASH_BYTES, WORD_BYTES = 6, 2
#: Buckets whose places in a row travel together.
TOGETHER = 4096


def _windows(texts: list[str | None], window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Of all windows of the texts: text index, start word, anchor, 64-bit hash, and the word's place in the
    hashes of all words, which come last."""
    hashes = [WORDS.of(split(t)) for t in texts]
    sizes = np.array([len(h) for h in hashes], np.int64)
    count = np.maximum(sizes - window + 1, 0)
    total = int(count.sum())
    none = np.zeros(0, np.uint64)
    if not total:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), none, none, np.zeros(0, np.int64), none
    flat = np.concatenate(hashes)
    text = np.repeat(np.arange(len(texts)), count)
    start = np.arange(total) - np.repeat(np.cumsum(count) - count, count)
    at = start + np.repeat(np.cumsum(sizes) - sizes, count)
    low, span, width = run_hashes(flat, anchor), 1, window - anchor + 1
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if width > span:
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    return text, start, low[at], run_hashes(flat, window)[at], at, flat


def _runs(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs, from flags that mark where one begins."""
    starts = np.flatnonzero(new)
    return starts, np.append(starts[1:], len(new))


def _new(*columns: np.ndarray) -> np.ndarray:
    """Flags of the rows that differ from the one before in any column."""
    out = np.ones(len(columns[0]), bool)
    out[1:] = False
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


ROUTED = "key long, row long, tag int, start int, stop int, known boolean, hashes binary"


def _route(window: int, anchor: int, hot: np.ndarray, buckets: int, slice_bytes: int):
    """(row, tag, text) -> ROUTED: each window once for each bucket of a slice; known: it recurs in the slice."""

    def settle(rows: np.ndarray, tags: np.ndarray, texts: list[str]) -> pa.RecordBatch:
        by_row = np.argsort(rows, kind="stable")
        rows, tags, texts = rows[by_row], tags[by_row], [texts[i] for i in by_row]
        text, start, low, full, at, flat = _windows(texts, window, anchor)
        n = len(full)
        order = np.argsort(full, kind="stable")
        s, e = _runs(_new(full[order])) if n else (np.zeros(0, np.int64),) * 2
        known, pick = np.zeros(n, bool), np.zeros(n, bool)
        pick[order[s[e - s == 1]]] = True
        several = np.flatnonzero(np.repeat(e - s > 1, e - s))
        if len(several):
            which = order[several]
            known[which] = True
            bucket = rows[text[which]] % buckets
            again = np.lexsort((bucket, full[which]))  # stable: the smallest row comes first
            pick[which[again[_new(full[which][again], bucket[again])]]] = True
        one = np.flatnonzero(pick)
        if len(one):
            single = among(low[one], hot)
            new = _new(text[one], low[one], known[one]) | single
            new[1:] |= (one[1:] != one[:-1] + 1) | single[:-1]
            s, e = _runs(new)
            a = one[s]
            key = np.where(single[s], full[a], low[a]).astype(np.int64)
            ids = full[one]
            if single.any():  # the key is the hash itself; another one goes with it
                ids[single] = run_hashes(mix(flat ^ BASE), window)[at[one[single]]]
        else:
            s = e = a = np.zeros(0, np.int64)
            key, ids = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        ends = (np.append(s, len(one)) * HASH_BYTES).astype(np.int32)
        hashes = pa.Array.from_buffers(pa.binary(), len(s), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(ids.view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES].tobytes())])
        columns = [pa.array(key), pa.array(rows[text[a]]), pa.array(tags[text[a]]), pa.array(start[a].astype(np.int32)), pa.array((start[a] + (e - s)).astype(np.int32)), pa.array(known[a]), hashes]
        return pa.RecordBatch.from_arrays(columns, ["key", "row", "tag", "start", "stop", "known", "hashes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, tags, texts, size = [], [], [], 0
        for b in batches:
            for row, tag, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                rows.append(row)
                tags.append(tag)
                texts.append(text.as_py())
                size += len(texts[-1])
                if size > slice_bytes:
                    yield settle(np.array(rows, np.int64), np.array(tags, np.int32), texts)
                    rows, tags, texts, size = [], [], [], 0
        if rows:
            yield settle(np.array(rows, np.int64), np.array(tags, np.int32), texts)

    return run


PLACES = "bucket long, row long, tag int, start int, stop int"


def _confirm(buckets: int):
    """Routed rows in order of key -> PLACES: ranges of windows of one copy that recur and occur in the bucket."""

    def places(t: pa.Table) -> pa.RecordBatch:
        row, tag, start, stop = (t.column(c).to_numpy() for c in ("row", "tag", "start", "stop"))
        known = t.column("known").to_numpy()
        count = (stop - start).astype(np.int64)
        raw = np.frombuffer(b"".join(t.column("hashes").to_pylist()), np.uint8).reshape(-1, HASH_BYTES)
        full = np.zeros((len(raw), 8), np.uint8)
        full[:, :HASH_BYTES] = raw
        owner = np.repeat(np.arange(len(row)), count)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + start[owner]
        with np.errstate(over="ignore"):
            same = mix(full.view(np.uint64).ravel() ^ mix(t.column("key").to_numpy().astype(np.uint64)[owner] * BASE))
        order = np.argsort(same, kind="stable")
        s, e = _runs(_new(same[order]))
        recurs = (e - s > 1) | np.logical_or.reduceat(known[owner[order]], s)
        hit = order[np.repeat(recurs, e - s)]
        same, row, tag, at = same[hit], row[owner[hit]], tag[owner[hit]], at[hit]
        order = np.lexsort((at, tag, row, same))
        same, row, tag, at = (x[order] for x in (same, row, tag, at))
        bucket = row % buckets
        first = _new(same)
        of = np.cumsum(first) - 1  # of each window: the place of its one copy
        row, tag, at = row[first], tag[first], at[first]
        order = np.lexsort((at[of], tag[of], row[of], bucket))
        of, bucket = of[order], bucket[order]
        row, tag, at = row[of], tag[of], at[of]
        new = _new(bucket, of)
        bucket, row, tag, at = (x[new] for x in (bucket, row, tag, at))
        new = _new(bucket, row, tag)
        new[1:] |= at[1:] != at[:-1] + 1
        s, e = _runs(new) if len(new) else (np.zeros(0, np.int64),) * 2
        return pa.RecordBatch.from_arrays([pa.array(bucket[s]), pa.array(row[s]), pa.array(tag[s]), pa.array(at[s].astype(np.int32)), pa.array((at[s] + (e - s)).astype(np.int32))], ["bucket", "row", "tag", "start", "stop"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = pa.concat_tables([rest, t]) if rest is not None and rest.num_rows else t
            if not t.num_rows:
                continue
            key = t.column("key").to_numpy()
            cut = int(np.searchsorted(key, key[-1]))  # the last key may go on
            if cut:
                yield places(t.slice(0, cut))
            rest = t.slice(cut)
        if rest is not None and rest.num_rows:
            yield places(rest)

    return run


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, row, tag, text) -> the same and n: of a task's equal rows the first with its text, and at the end
    the number of the others without it."""
    seen: dict[tuple[int, int], int] = {}
    again: dict[tuple[int, int], object] = {}
    schema = None
    for b in batches:
        schema = b.schema
        first = np.ones(b.num_rows, bool)
        for i, k in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
            if k in seen:
                seen[k] += 1
                again.setdefault(k, b.column(0)[i])
                first[i] = False
            else:
                seen[k] = 0
        part = b.filter(pa.array(first))
        yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.ones(part.num_rows, np.int64))], [*schema.names, "n"])
    if again:
        columns = [pa.array([x.as_py() for x in again.values()], schema.types[0]), pa.array([k[0] for k in again], pa.int64()), pa.array([k[1] for k in again], pa.int32()), pa.nulls(len(again), pa.string()), pa.array([seen[k] for k in again], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, [*schema.names, "n"])


def _cut(window: int):
    """(text, places: list of bucket, start, stop) -> bucket, passage: the words under each range of windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buckets, passages = [], []
            for text, places in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                words = split(text.as_py())
                ranges: list[list[int]] = []
                for p in sorted((p["bucket"], p["start"], p["stop"]) for p in places):
                    if ranges and ranges[-1][0] == p[0] and p[1] <= ranges[-1][2]:
                        ranges[-1][2] = max(ranges[-1][2], p[2])
                    else:
                        ranges.append(list(p))
                buckets += [x[0] for x in ranges]
                passages += [b" ".join(words[x[1] : x[2] - 1 + window]).decode() for x in ranges]
            yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int64()), pa.array(passages, pa.string())], ["bucket", "text"])

    return run


def _stream(words: np.ndarray) -> str:
    """What the automata read of words: WORD_BYTES characters each."""
    return words.view(np.uint8).reshape(-1, 8)[:, :WORD_BYTES].tobytes().decode("latin-1")


class Shard:
    """The passages of a bucket, compiled into automata."""

    def __init__(self, passages: list[str], window: int, anchor: int, patterns_each: int = SHARD_PATTERNS):
        self.window, self.anchor = window, anchor
        step = window - anchor + 1
        split_ = [split(p) for p in dict.fromkeys(passages)]
        self.words = [w for p in split_ for w in p]
        hashes = [WORDS.of(p) for p in split_]
        starts = np.cumsum([0] + [len(h) for h in hashes])
        patterns: dict[str, None] = {}
        for h in hashes:
            text = _stream(h)
            for o in range(0, len(h) - anchor + 1, step):
                patterns[text[o * WORD_BYTES : (o + anchor) * WORD_BYTES]] = None
        self.automata = []
        names = list(patterns)
        for k in range(0, len(names), patterns_each):
            automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
            for name in names[k : k + patterns_each]:
                automaton.add_word(name)
            automaton.make_automaton()
            self.automata.append(automaton)
        # the windows of all passages in order of hash, and the words where each stands
        full = np.concatenate([run_hashes(h, window) for h in hashes]) if hashes else np.zeros(0, np.uint64)
        at = np.concatenate([np.arange(a, a + max(0, len(h) - window + 1)) for a, h in zip(starts, hashes, strict=False)]) if hashes else np.zeros(0, np.int64)
        order = np.argsort(full, kind="stable")
        order = order[_new(full[order])] if len(order) else order
        self.known, self.at = full[order], at[order]

    def locate(self, words: list[bytes]) -> np.ndarray | None:
        """Which words lie in a window that equals one of a passage; None: none does."""
        if len(words) < self.window or not self.automata:
            return None
        hashes = WORDS.of(words)
        text = _stream(hashes)
        ends = [end for automaton in self.automata for end, _ in automaton.iter(text)]
        if not ends:
            return None
        first = np.array(ends, np.int64) + 1 - self.anchor * WORD_BYTES
        first = first[first % WORD_BYTES == 0] // WORD_BYTES
        # a hit makes the windows around it candidates
        near = np.zeros(len(words) + 1, np.int64)
        np.add.at(near, np.maximum(0, first + self.anchor - self.window), 1)
        np.add.at(near, first + 1, -1)
        at = np.flatnonzero(np.cumsum(near)[: len(words) - self.window + 1] > 0)
        if not len(at):
            return None
        full = run_hashes(hashes, self.window)[at]
        place = np.minimum(np.searchsorted(self.known, full), len(self.known) - 1)
        agree = self.known[place] == full
        at, place = at[agree], self.at[place[agree]]
        if not len(at):
            return None
        # and those that stand in a passage are compared with it word for word, run by run
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (place[1:] != place[:-1] + 1)
        marked = np.zeros(len(words), bool)
        for s, e in zip(*(x.tolist() for x in _runs(new)), strict=True):
            a, o, n = int(at[s]), int(place[s]), e - s - 1 + self.window
            if words[a : a + n] == self.words[o : o + n]:
                marked[a : a + n] = True
            else:  # hashes that collide
                for k in range(s, e):
                    a, o = int(at[k]), int(place[k])
                    if words[a : a + self.window] == self.words[o : o + self.window]:
                        marked[a : a + self.window] = True
        return marked


def _locate(window: int, anchor: int, patterns: int):
    """(bucket, kind, id, row, tag, n, text) in order: of each bucket its passages (kind 0), then its documents,
    equal rows together -> id, n, n_words, n_removed, kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, passages, shard = None, [], None
        last, result = None, (0, 0, "")
        for b in batches:
            keys = [b.column(i).to_pylist() for i in (0, 1, 3, 4, 5)]
            ids, out = [], []
            for i, (home, kind, row, tag, n) in enumerate(zip(*keys, strict=True)):
                if home != bucket:
                    bucket, passages, shard, last = home, [], None, None
                if kind == 0:
                    passages.append(b.column(6)[i].as_py())
                    continue
                if shard is None:
                    shard, passages = Shard(passages, window, anchor, patterns), []
                if last != (row, tag):
                    words = split(b.column(6)[i].as_py())
                    marked = shard.locate(words)
                    kept = words if marked is None else [w for w, x in zip(words, marked.tolist(), strict=True) if not x]
                    last, result = (row, tag), (len(words), len(words) - len(kept), b" ".join(kept).decode())
                ids.append(i)
                out.append((n, *result))
            columns = zip(*out, strict=True) if out else ((),) * 4
            yield pa.RecordBatch.from_arrays([b.column(2).take(pa.array(ids, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True))], ["id", "n", "n_words", "n_removed", "kept"])

    return run


def remove_repeats(df: DataFrame, window: int = 50, anchor: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id`, n_words, n_removed, kept (the words left, joined by one space) of every row.

    Words stand between ASCII white space, unchanged. Null, empty and shorter texts lose nothing. Rows are
    documents of their own even if id and text repeat: then all of their windows recur. Windows are judged
    on the input. An empty table gives none, other columns don't matter. A row is known by 96 bits of its id and
    text, a window by 112 bits until its words are compared. A task holds a slice, or a bucket's passages, and
    of a longer text that text."""
    if not 1 <= anchor < window:
        raise ValueError("an anchor is shorter than a window")
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = bounded(df).select(F.col(id_col).alias("id"), text.alias("text")).select("id", F.xxhash64("id", "text").alias("row"), F.hash("text", "id").alias("tag"), "text")
    id_type = docs.schema["id"].dataType.simpleString()
    size = df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    buckets = max(1, -(-size // BUCKET_BYTES))
    home = F.pmod("row", F.lit(buckets)).alias("bucket")

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            low, text = (_windows(b.column(0).to_pylist(), window, anchor)[i] for i in (2, 0))
            yield pa.RecordBatch.from_arrays([pa.array(low[_new(low, text)].astype(np.int64)) if len(low) else pa.array([], pa.int64())], ["anchor"])

    seen = docs.where(F.rand(7) < 1 / HOT_SAMPLE).select("text").mapInArrow(task(anchors, "words"), "anchor long").groupBy("anchor").count().where(F.col("count") >= HOT_SEEN)
    hot = seen.orderBy(F.desc("count")).limit(int(1 / HOT_SHARE)).toPandas()["anchor"].to_numpy().astype(np.uint64)
    hot.sort()
    routed = docs.select("row", "tag", "text").mapInArrow(task(_route(window, anchor, hot, buckets, SLICE_BYTES), "words"), ROUTED)
    places = materialize(routed.repartition("key").sortWithinPartitions("key").mapInArrow(task(_confirm(buckets)), PLACES), "repeat-places")

    wanted = places.groupBy("row", "tag", F.floor(F.col("bucket") / TOGETHER).alias("together")).agg(F.collect_list(F.struct("bucket", "start", "stop")).alias("places")).select("row", "tag", "places")
    once = f"id {id_type}, row long, tag int, text string, n long"
    copies = among_keys(docs, "row", places).mapInArrow(_once, once).where(F.col("text").isNotNull()).select("row", "tag", "text")
    passages = copies.join(wanted, ["row", "tag"]).select("text", "places").mapInArrow(task(_cut(window)), "bucket long, text string").distinct()

    streamed = docs.mapInArrow(_once, once).select(home, F.lit(1).alias("kind"), "id", "row", "tag", "n", "text")
    shards = passages.select("bucket", F.lit(0).alias("kind"), F.lit(None).cast(id_type).alias("id"), F.lit(0).cast("long").alias("row"), F.lit(0).alias("tag"), F.lit(0).cast("long").alias("n"), "text")
    parts = int(min(buckets, MOST_PARTITIONS))  # given, so that small buckets aren't put into a few tasks
    met = streamed.unionByName(shards).repartition(parts, "bucket").sortWithinPartitions("bucket", "kind", "row", "tag", F.col("text").isNull())
    out = met.mapInArrow(task(_locate(window, anchor, SHARD_PATTERNS), "words"), f"id {id_type}, n long, n_words long, n_removed long, kept string")
    # rows that stand several times come apart again
    return out.select(F.col("id").alias(id_col), "n_words", "n_removed", "kept", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("k")).drop("k")
