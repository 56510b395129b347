"""Bounds that hold at any size: memory of a worker, folds, long texts, ids of other kinds, shared folders."""

import random
import subprocess
import sys

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from blobscope.llm import bpe, minhash, scratch, shards, substrings, toxicity

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_encoder_memory():
    """8 MB of unseen words take a worker less than 250 MB."""
    code = f"""
import random, resource
from blobscope.llm import bpe
r = random.Random(0)
text = " ".join("".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=9)) for _ in range(800_000))
bpe.encoder({PATH!r}).ids([text])
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=bpe.__file__.partition("/blobscope/")[0])
    assert float(out.stdout) < 250


def test_blocks_of_long_texts(monkeypatch):
    """Cutting a long text into blocks and pieces into indexes doesn't change its ids."""
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 40)
    monkeypatch.setattr(bpe, "INDEX_BYTES", 30)
    library, e = Tokenizer.from_file(PATH), bpe.Encoder(bpe.Vocabulary(PATH), memo_bytes=2000)
    r = random.Random(1)
    texts = ["".join(r.choice(["word", " ", "  ", "\n", " x1", "é", "<|endoftext|>", "don't", "\t", " 数"]) for _ in range(n)) for n in (0, 3, 200, 900)] + [" " * 300, "a" * 500, " a" * 200 + " "]
    assert [np.frombuffer(x, "<u4").tolist() for x in e.ids(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_folds_do_not_see_their_rows(monkeypatch):
    """Out-of-fold log-odds of a row don't change with its own label or words."""
    r = np.random.default_rng(2)
    x, y, fold = r.integers(0, 2, (60, 8)).astype(np.float32), r.integers(0, 2, 60).astype(float), np.arange(60) % toxicity.FOLDS
    before = np.zeros((60, 0))
    first = toxicity.out_of_fold(x, before, y, fold)
    for i in (0, 7, 33):
        other = y.copy()
        other[fold == fold[i]] = 1 - other[fold == fold[i]]
        again = toxicity.out_of_fold(x, before, other, fold)
        assert np.array_equal(first[fold == fold[i]], again[fold == fold[i]]) and not np.array_equal(first, again)
    seen = []
    fit = toxicity._fit
    monkeypatch.setattr(toxicity, "_fit", lambda x, before, y: seen.append(before) or fit(x, before, y))
    sets = [np.flatnonzero(row).astype(np.uint64) for row in x]
    toxicity.fit(sets, np.column_stack([y, 1 - y]), ("a", "b"))
    # the second category is fitted on probabilities of the first
    assert all(((b >= 0) & (b <= 1)).all() for b in seen) and {b.shape[1] for b in seen} == {0, 1}


def test_string_ids_and_long_texts(spark):
    """Ids may be strings; a text of 3 MB is a document like any other."""
    words = " ".join(str(i % 50_000) for i in range(500_000))
    df = spark.createDataFrame([("a", words), ("b", "x y z"), (None, None), ("c", words + " end"), ("b", "x y z")], "doc_id string, text string")
    got = shards.shard_by_bytes(df, 3).collect()
    assert sorted((r["doc_id"] or "", r["size"]) for r in got) == sorted([("a", len(words) + 16), ("b", 21), ("", 16), ("c", len(words) + 20), ("b", 21)])
    assert len({r["shard"] for r in got if r["doc_id"] == "b"}) == 1
    kept = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in substrings.remove_repeats(df.where("doc_id in ('a', 'c')"), 35, 8).collect()}
    assert kept == {"a": (500_000, 500_000), "c": (500_001, 500_000)}
    found = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df.where("doc_id in ('a', 'c')"), minhash.MinMax()).collect()}
    assert found == {"a": "a", "c": "a"}


def test_scratch_folder_is_shared(monkeypatch):
    """Without spark.checkpoint.dir a folder is made on a single machine only."""

    class Conf:
        def get(self, *a):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.scratch_root(Session())
