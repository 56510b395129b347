"""Near-duplicates, repeated passages and near vectors against brute force."""

import random
from collections import Counter

import numpy as np
import pytest

from blobscope.llm import components, covertree, minhash, substrings


def groups(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(500 + i, 501 + i) for i in range(60)] + [(900, 1000 + i) for i in range(200)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = groups({x for p in links for x in p}, links)
    assert all(got.get(n, n) == w for n, w in want.items())
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def texts(seed=3, n=120):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + rng.choice("aeiou") + rng.choice("klmnrst") + str(rng.randrange(30))
    base = [" ".join(word() for _ in range(rng.choice([1, 2, 3, 40, 90]))) for _ in range(n)]
    hub = [word() for _ in range(100)]
    out = list(base)
    for t in base[:40]:
        w = t.split(" ")
        for k in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = word()
        out.append(" ".join(w).upper() if rng.random() < 0.3 else "\t".join(w))
    for _ in range(60):  # a group of near copies around the threshold
        w = list(hub)
        for _ in range(rng.randrange(7)):
            w[rng.randrange(len(w))] = word()
        out.append(" ".join(w))
    return [*out, None, "", " \n ", base[0], base[0]]


@pytest.mark.parametrize(("k", "num"), [(3, 85), (5, 80)])
def test_near_duplicates(spark, k, num):
    docs = list(enumerate(texts()))
    sets = []
    for _, t in docs:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    links = [(i, j) for i in range(len(docs)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])]
    want = groups(range(len(docs)), links)
    df = spark.createDataFrame([(i, t, "b", 1) for i, t in docs], "doc_id long, text string, bands string, node int")
    p = minhash.MinMax(shingle=k, numerator=num)
    got = {r["doc_id"]: r for r in minhash.near_duplicates(df, p).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == want and all(r["n_shingles"] == len(sets[i]) and r["kept"] == (i == want[i]) for i, r in got.items())
    assert len(set(want.values())) < len(docs) - 30
    kept = minhash.drop_near_duplicates(df.union(df.where("doc_id in (1, 2)")), p)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i in want if want[i] == i)
    assert minhash.near_duplicates(df.limit(0), p).count() == 0


def test_band_probability():
    rng, p = np.random.default_rng(0), minhash.MinMax(shingle=3, numerator=85)
    missed = 0
    for _ in range(300):
        shared, rest = rng.integers(0, 2**64, 170, np.uint64), rng.integers(0, 2**64, 30, np.uint64)
        a, b = (minhash.band_keys([np.concatenate([shared, x])], p)[0] for x in (rest[:15], rest[15:]))
        missed += not (a == b).any()
    assert missed == 0


def brute_repeats(docs, n):
    seen = Counter(tuple(w[i : i + n]) for w in docs for i in range(len(w) - n + 1))
    out = []
    for w in docs:
        cut = set()
        for i in range(len(w) - n + 1):
            if seen[tuple(w[i : i + n])] > 1:
                cut.update(range(i, i + n))
        out.append((len(w), len(cut), " ".join(x for j, x in enumerate(w) if j not in cut)))
    return out


@pytest.mark.parametrize(("window", "anchor"), [(6, 3), (12, 8), (5, 1)])
def test_repeats(spark, window, anchor, monkeypatch):
    rng = random.Random(5)
    passage = [[rng.choice("abcdefghijklmnopqrstuvwxyz") * 2 for _ in range(rng.randrange(4, 40))] for _ in range(6)]
    docs = []
    for _ in range(150):
        w = []
        for _ in range(rng.randrange(6)):
            w += [str(rng.randrange(10**6)) for _ in range(rng.randrange(8))]
            p = rng.choice(passage)
            a = rng.randrange(len(p))
            w += p[a : a + rng.randrange(1, 30)]
        docs.append(w)
    docs += [["x"] * 40, ["ab", "ba"] * 20, [], docs[3], docs[3]]
    sep = [" ", "\n", "  ", "\t "]
    rows = [(i, None if not w and i % 2 else rng.choice(sep).join(w), "k") for i, w in enumerate(docs)]
    monkeypatch.setattr(substrings, "SLICE_BYTES", 900)
    monkeypatch.setattr(substrings, "BUCKET_BYTES", 2000)
    monkeypatch.setattr(substrings, "SHARD_PATTERNS", 5)
    monkeypatch.setattr(substrings, "HOT_SAMPLE", 2)
    monkeypatch.setattr(substrings, "HOT_SEEN", 3)
    df = spark.createDataFrame(rows, "doc_id long, text string, row string")
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in substrings.remove_repeats(df, window, anchor).collect()}
    want = dict(enumerate(brute_repeats(docs, window)))
    assert got == want and sum(x[1] for x in want.values()) > 100
    assert substrings.remove_repeats(df.limit(0), window, anchor).count() == 0
    # a row that stands twice: all of its windows recur
    twice = spark.createDataFrame([(1, "a b c d e f g h i j k l m", "")] * 2, df.schema)
    assert [r["n_removed"] for r in substrings.remove_repeats(twice, window, anchor).collect()] == [13, 13]


def test_automata_locate():
    """What the automata don't hit isn't found, and what they hit is compared word for word."""
    words = [str(i).encode() for i in range(60)]
    shard = substrings.Shard([b" ".join(words[10:25]).decode()], 6, 3)
    marked = shard.locate(words)
    assert marked.nonzero()[0].tolist() == list(range(10, 25))
    assert shard.locate(words[:14] + words[20:]) is None  # five words of the passage are no window
    assert shard.locate([]) is None and shard.locate(words[:9]) is None
    shard.words[3] = b"other"  # as if the hashes of two words were equal: windows that hold it don't agree
    assert shard.locate(words).nonzero()[0].tolist() == list(range(14, 25))
    shard.automata.clear()
    assert shard.locate(words) is None


@pytest.mark.parametrize("sizes", [(2048, 3072, 48), (40, 25, 3)])
def test_near_vectors(spark, sizes, monkeypatch):
    for name, v in zip(("SAMPLE", "BLOCK", "LEAF"), sizes, strict=True):
        monkeypatch.setattr(covertree, name, v)
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((12, 8))
    x = [(centres[rng.integers(12)] + rng.standard_normal(8) * s).astype(np.float32).tolist() for s in rng.choice([0.01, 0.2, 0.6], 260)]
    x += [x[0]] * 30 + [[2 * v for v in x[1]], [0.0] * 8, None, [], [1.0, None] + [0.0] * 6, [float("nan")] * 8, [float("inf")] + [0.0] * 7, [1.0, 0.0], [1.0, 0.1], [1e30] * 8]
    ok = [i for i, v in enumerate(x) if v and all(a is not None and np.isfinite(a) for a in v) and any(v)]
    links = []
    for i in ok:
        for j in ok:
            if j < i and len(x[i]) == len(x[j]):
                a, b = np.array(x[i], float), np.array(x[j], float)
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.9:
                    links.append((i, j))
    n, want = Counter(k for p in links for k in p), groups(range(len(x)), links)
    df = spark.createDataFrame([(i, v, "n") for i, v in enumerate(x)], "vec_id long, embedding array<float>, node string")
    got = {r["vec_id"]: r for r in covertree.near_vectors(df).collect()}
    assert {i: r["n_links"] for i, r in got.items()} == {i: n[i] for i in range(len(x))}
    assert {i: r["component_id"] for i, r in got.items()} == want and all(r["kept"] == (i == want[i]) for i, r in got.items())
    assert covertree.near_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize("shuffled", [0, 1e9])
def test_vectors_without_structure(spark, shuffled, monkeypatch):
    """All blocks meet: in rounds, what is shuffled doesn't grow with their pairs; results are those of the other way."""
    for name, v in (("BLOCK", 64), ("SAMPLE", 64), ("SHUFFLED", shuffled), ("ROUND_BYTES", 1 << 18)):
        monkeypatch.setattr(covertree, name, v)
    rng = np.random.default_rng(5)
    x = rng.standard_normal((2000, 32)).astype(np.float32)
    x[::50] = x[1::50] + np.float32(0.1) * x[2::50]
    x[7::100] = x[7]
    u = covertree.units(x)
    i, j = np.nonzero(np.triu(u @ u.T >= 0.9, 1))
    n, want = np.bincount(np.concatenate([i, j]), minlength=len(x)), groups(range(len(x)), zip(i.tolist(), j.tolist(), strict=True))
    df = spark.createDataFrame([(k, v) for k, v in enumerate(x.tolist())], "vec_id long, embedding array<float>")
    sc = spark.sparkContext._jsc.sc()

    def written() -> int:
        sc.listenerBus().waitUntilEmpty()
        each = sc.statusStore().executorList(True)
        return sum(each.apply(k).totalShuffleWrite() for k in range(each.size()))

    before = written()
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in covertree.near_vectors(df).collect()}
    assert got == {k: (n[k], want[k]) for k in range(len(x))} and len(i) > 200
    assert (written() - before < 16 * x.nbytes) == (shuffled == 0)
