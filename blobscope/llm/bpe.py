"""Byte-pair encoding and decoding with a pair-occurrence index.

A text falls into chunks at spaces (see `chunks`); a worker remembers the ids of chunks and encodes only the
others. Their distinct pieces are encoded together, up to INDEX_BYTES at a time (an index of all pieces of a
partition would hold the whole partition in memory): every adjacent symbol pair that has a merge rule is
indexed by rank to the positions of all its occurrences; the active ranks are applied in ascending order, and
each merge updates only the lists of the two neighbouring pairs. How pieces are grouped never changes ids.

Nulls are empty texts. Strings of special tokens inside texts become the special id, as the tokenizers
library does by default.
"""

from __future__ import annotations

import heapq
import json
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workers import bounded, memo, task

#: A space before white space or the end: only there a chunk may not begin at the space.
_LOOSE = re.compile(r" (?=\s|\Z)")
_CUT = re.compile(r" (?=\S)")
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Up to here all Unicode versions agree on letters and digits; texts beyond go to the library's splitter.
_PLAIN = "ɏ"
#: Bytes, about, of the chunks kept by one Python worker; beyond them the memo starts anew (results don't
#: depend on it), and what an entry takes beside its characters and ids.
MEMO_BYTES, ENTRY_BYTES = 64 << 20, 190
#: Bytes of new pieces in one index (one piece at least); an index takes about 60 times that.
INDEX_BYTES = 256 << 10
#: Characters of a block of a long text.
BLOCK_CHARS = 1 << 20
#: Documents encoded together, and their characters (one document at least).
SLICE_DOCS = 512
SLICE_BYTES = 2 << 20


def chunks(text: str) -> list[str]:
    """Cut a text before spaces so that no pre-token crosses a cut: the first chunk as it is, the others
    without their leading space. A space followed by white space stays with the chunk before it."""
    parts = text.split(" ")
    if not _LOOSE.search(text):
        return parts
    out = parts[:1]
    for p in parts[1:]:
        if p and not p[0].isspace():
            out.append(p)
        else:
            out[-1] = f"{out[-1]} {p}"
    return out


def blocks(text: str) -> Iterator[list[str]]:
    """`chunks` of a text in blocks of about BLOCK_CHARS characters; from the second block on all chunks lack
    their leading space."""
    start = 0
    while len(text) - start > 2 * BLOCK_CHARS and (cut := _CUT.search(text, start + BLOCK_CHARS)):
        yield chunks(text[start : cut.start()])
        start = cut.end()
    yield chunks(text[start:] if start else text)


class Vocabulary:
    """Merge ranks and token bytes of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["normalizer"]:
            raise ValueError(f"{path} is not a plain byte-level BPE vocabulary")
        # Printable bytes stand for themselves, the others for the code points from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        to_char = {b: chr(b) for b in plain}
        to_char |= {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in to_char)}
        self.byte_of = {c: b for b, c in to_char.items()}
        vocab = model["vocab"]
        self.first = [vocab[to_char[b]] for b in range(256)]
        self.first_table = np.array(self.first, np.int32)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        self.width = 1 << max(1, (self.size - 1).bit_length())
        self.rank, self.left, self.right, self.merged = {}, [], [], []
        for r, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            x, y = vocab[a], vocab[b]
            self.rank[x * self.width + y] = r
            self.left.append(x)
            self.right.append(y)
            self.merged.append(vocab[a + b])
        self.bytes = [b""] * self.size
        for token, i in vocab.items():
            self.bytes[i] = bytes(self.byte_of[c] for c in token)
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.path = path
        self._splitter = None

    def pieces(self, text: str) -> list[bytes]:
        """Pre-tokens of a text."""
        if text.isascii() or max(text) <= _PLAIN:
            return [p.encode() for p in _PIECES.findall(text)]
        if self._splitter is None:
            from tokenizers import pre_tokenizers

            self._splitter = pre_tokenizers.ByteLevel(add_prefix_space=False)
        return [bytes(self.byte_of[c] for c in p) for p, _ in self._splitter.pre_tokenize_str(text)]

    def encode_pieces(self, pieces: list[bytes]) -> Iterator[bytes]:
        """Token ids of each piece as 32-bit bytes, by pair-occurrence indexes over up to INDEX_BYTES of them."""
        start = size = 0
        for i, p in enumerate(pieces):
            if size and size + len(p) > INDEX_BYTES:
                yield from self._index(pieces[start:i])
                start, size = i, 0
            size += len(p) + 1
        if size:
            yield from self._index(pieces[start:])

    def _index(self, pieces: list[bytes]) -> list[bytes]:
        rank, width = self.rank, self.width
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(sizes + 1)  # a separator follows each piece; no pair crosses it
        n = int(ends[-1])
        flat = np.full(n, -1, np.int32)
        inside = np.ones(n, bool)
        inside[ends - 1] = False
        flat[inside] = self.first_table[np.frombuffer(b"".join(pieces), np.uint8)]
        symbols = array("i", flat.tobytes())
        keys = np.where((flat[:-1] >= 0) & (flat[1:] >= 0), flat[:-1].astype(np.int64) * width + flat[1:], -1)
        del flat, inside
        places: dict[int, array | list[int]] = {}
        if len(keys):
            order = np.argsort(keys, kind="stable").astype(np.int32)
            ordered = keys[order]
            starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
            found = ordered[starts].tolist()
            for key, s, e in zip(found, starts.tolist(), [*starts[1:].tolist(), len(ordered)], strict=True):
                r = rank.get(key)
                if r is not None:
                    places[r] = array("i", order[s:e].tobytes())
            del order, ordered
        del keys
        after = array("i", np.arange(1, n + 1, dtype=np.int32).tobytes())
        before = array("i", np.arange(-1, n - 1, dtype=np.int32).tobytes())
        active = list(places)
        heapq.heapify(active)
        get = rank.get
        while active:
            r = heapq.heappop(active)
            a, b, c = self.left[r], self.right[r], self.merged[r]
            for i in sorted(places.pop(r)):
                if symbols[i] != a:
                    continue
                j = after[i]
                if symbols[j] != b:
                    continue
                symbols[i] = c
                symbols[j] = -2  # gone
                k = after[j]
                after[i] = k
                before[k] = i
                y = symbols[k]
                if y >= 0 and (q := get(c * width + y)) is not None:
                    if q in places:
                        places[q].append(i)
                    else:
                        places[q] = [i]
                        heapq.heappush(active, q)
                h = before[i]
                if h >= 0 and (x := symbols[h]) >= 0 and (q := get(x * width + c)) is not None:
                    if q in places:
                        places[q].append(h)
                    else:
                        places[q] = [h]
                        heapq.heappush(active, q)
        left_over = np.frombuffer(symbols, np.int32)
        kept = left_over >= 0
        coded = left_over[kept].astype("<u4").tobytes()
        stops = (4 * np.cumsum(kept)[ends - 1]).tolist()
        return [coded[s:e] for s, e in zip([0, *stops[:-1]], stops, strict=True)]

    def decode(self, ids: Iterable[int]) -> str:
        table = self.bytes
        return b"".join([table[i] for i in ids]).decode("utf-8", "replace")


class Encoder:
    """Encodes whole texts, remembering chunks. `ids(texts)` gives little-endian 32-bit ids as bytes."""

    def __init__(self, vocabulary: Vocabulary, memo_bytes: int = MEMO_BYTES):
        self.vocabulary, self.limit, self.held = vocabulary, memo_bytes, 0
        self.memo: dict[str, bytes] = {}  # chunk with its leading space, kept without it
        self.special = re.compile("|".join(map(re.escape, sorted(vocabulary.special, key=len, reverse=True)))) if vocabulary.special else None

    def _learn(self, keys: set[str], lead: str, memo: dict[str, bytes]) -> None:
        # the pieces of all chunks go through one index; equal pieces only once
        v = self.vocabulary
        split = {k: v.pieces(lead + k) for k in keys}
        distinct = list({p for ps in split.values() for p in ps})
        ids = dict(zip(distinct, v.encode_pieces(distinct), strict=True))
        for k, ps in split.items():
            memo[k] = ids[ps[0]] if len(ps) == 1 else b"".join([ids[p] for p in ps])

    def _segments(self, texts: list[str]) -> Iterator[tuple[int, str, list[str], bytes]]:
        """Of each text in turn: its index, a first chunk, the chunks behind spaces, and the id that follows."""
        for i, t in enumerate(texts):
            at = 0
            ends = list(self.special.finditer(t)) if self.special and self.special.search(t) else []
            for m in [*ends, None]:
                segment = (t[at : m.start()] if m else t[at:]) if ends else t
                head = None
                for parts in blocks(segment):
                    if head is not None:
                        yield i, "", parts, b""  # a later block: all of it stands behind spaces
                    else:
                        head = parts[0]
                        yield i, head, parts[1:], b""
                if m:
                    yield i, "", [], self.vocabulary.special[m[0]].to_bytes(4, "little")
                    at = m.end()

    def ids(self, texts: list[str]) -> list[bytes]:
        """Ids of each text. Segments go through in groups of bounded size, so that beside the result only a
        group's chunks and the memo are held."""
        out: list[list[bytes]] = [[] for _ in texts]
        group: list[tuple[int, str, list[str], bytes]] = []
        size = 0
        for s in self._segments(texts):
            group.append(s)
            size += len(s[1]) + sum(map(len, s[2])) + len(s[2])
            if size >= BLOCK_CHARS:
                self._encode(group, out)
                group, size = [], 0
        self._encode(group, out)
        return [b"".join(x) for x in out]

    def _encode(self, group: list[tuple[int, str, list[str], bytes]], out: list[list[bytes]]) -> None:
        if self.held > self.limit:
            self.memo.clear()
            self.held = 0
        need: set[str] = set()
        for _, _, s, _ in group:
            need.update(s)
        need -= self.memo.keys()
        if need:
            self._learn(need, " ", self.memo)
            self.held += sum(ENTRY_BYTES + len(k) + len(self.memo[k]) for k in need)
        heads: dict[str, bytes] = {"": b""}
        self._learn({h for _, h, _, _ in group} - {""}, "", heads)
        get = self.memo.__getitem__
        for i, head, s, end in group:
            out[i].append(b"".join([heads[head], *map(get, s), end]))


_ENCODERS: dict[str, Encoder] = {}


memo("bpe", _ENCODERS.clear)


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file; its memo lives until another kind of task claims the worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(Vocabulary(path))
    return _ENCODERS[path]


def slices(texts: list[str | None] | pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of texts of bounded number and size (one text at least)."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist() if isinstance(texts, pa.Array) else [len(t or "") for t in texts]
    start = size = 0
    for i, n in enumerate(sizes):
        if i > start and (i - start >= SLICE_DOCS or size + n > SLICE_BYTES):
            yield start, i
            start, size = i, 0
        size += n
    if start < len(sizes):
        yield start, len(sizes)


def encode(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = False) -> DataFrame:
    """Token ids of every text: `id`, `ids array<int>`, and `decoded string` where `decode` is set.

    Rows in, rows out, without a shuffle: repeated rows stay, null and empty texts have no ids, an empty
    table has no rows, other columns don't matter. A task holds an Arrow batch (bounded by bytes), the ids of
    a slice of it, one index and the worker's memo; of a text longer than these it holds that text, its words
    and its ids."""
    source = bounded(df).select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    id_type = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(tokenizer_path)
        table = e.vocabulary.bytes
        for b in batches:
            ids, texts = b.column(0), b.column(1)
            for s, t in slices(texts):
                coded = e.ids(texts.slice(s, t - s).to_pylist())
                ends = np.cumsum([0] + [len(x) // 4 for x in coded]).astype(np.int32)
                columns = [ids.slice(s, t - s), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(coded), np.int32)))]
                if decode:
                    columns.append(pa.array([b"".join([table[i] for i in np.frombuffer(x, "<u4")]).decode("utf-8", "replace") for x in coded], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, ["id", "ids", "decoded"][: len(columns)])

    return source.mapInArrow(task(run, "bpe"), f"id {id_type}, ids array<int>" + (", decoded string" if decode else "")).withColumnRenamed("id", id_col)


def round_trip_digests(df: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256 (UTF-8)."""
    coded = encode(df, tokenizer_path, decode=True)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
