"""Decontamination, shards, personal data, toxicity and the pipeline."""

import random
import re
import time
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from blobscope.llm import decontaminate, pii, queries, shards, toxicity

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute_hits(docs, items, n):
    wins = {}
    for i, t in items:
        w = words(t)
        if w and i is not None:
            k = min(n, len(w))
            for a in range(len(w) - k + 1):
                wins.setdefault(tuple(w[a : a + k]), set()).add(str(i))
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for k in {len(x) for x in wins}:
            for a in range(len(w) - k + 1):
                if s := wins.get(tuple(w[a : a + k])):
                    hit.update(range(a, a + k))
                    found |= s
        out.append((i, len(w), len(hit), len(found), sorted(found)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [100_000, 7])
def test_decontamination(spark, block, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_WINDOWS", block)
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(30)] + ["É", "straße", "日本"]
    item = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, item(rng.choice([1, 2, 6, 9, 20]))) for i in range(25)]
    items += [(90, items[0][1]), (91, None), (92, "... !"), (None, "w1 w2"), (93, items[1][1].upper())]
    docs = []
    for i in range(60):
        parts = [item(rng.randrange(12))]
        for _ in range(rng.randrange(3)):
            w = items[rng.randrange(25)][1].split(" ")
            a = rng.randrange(len(w))
            parts += [", ".join(w[a : a + rng.randrange(1, 12)]).title(), item(rng.randrange(5))]
        docs.append((i, "\n".join(parts)))
    docs += [(100, None), (101, ""), (102, "?!"), (None, docs[0][1]), docs[1], docs[1], (1, docs[2][1])]
    d = spark.createDataFrame([(*x, "c") for x in docs], "doc_id long, text string, wid string")
    b = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc_id int")
    got = sorted((tuple(r) for r in decontaminate.decontaminate(d, b, window=6).drop("th").collect()), key=repr)
    assert got == brute_hits(docs, items, 6) and sum(x[2] for x in got) > 50
    assert {r["n_hit"] for r in decontaminate.decontaminate(d, b.limit(0)).collect()} == {0} and decontaminate.decontaminate(d.limit(0), b).count() == 0


def test_decontamination_matches_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = queries.QUERIES["op4_decontamination"](spark, DATA)
    want = con.execute(queries.ORACLES["op4_decontamination"]).fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want)


def test_shards(spark, monkeypatch):
    rng = random.Random(7)
    hot = "hot text " * 20
    rows = [(i, hot if i % 3 == 0 else None if i % 50 == 1 else "é" * rng.randrange(300), i) for i in range(3000)] + [(5, "twice", 0)] * 3 + [(None, "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, size int")
    for sample in (16, 1):  # few samples leave ranges overfull
        monkeypatch.setattr(shards, "SAMPLES_A_RANGE", sample)
        got = shards.shard_by_bytes(df, 40).collect()
        assert sorted((r["doc_id"] or -1, r["size"], r["text_crc32"]) for r in got) == sorted((i or -1, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _ in rows)
        load = np.bincount([r["shard"] for r in got], weights=[r["size"] for r in got], minlength=40)
        share = load.sum() / 40
        assert len(load) == 40 and np.abs(load - share).max() <= 616 + 0.02 * share
        for s in range(40):
            assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert shards.shard_by_bytes(df.limit(0), 40).count() == 0


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base(t):
    out = []
    for k in pii.KINDS:
        for m in re.finditer(BASE[k], t):
            d = re.sub("[^0-9]", "", m[0])
            if not (k == "ip" and any(int(x) > 255 for x in m[0].split(".")) or k == "card" and not (13 <= len(d) <= 19 and pii.luhn(d)) or k == "phone" and not 9 <= len(d) <= 15):
                out.append((k, m.start(), m.end()))
    return out


def test_base_spans():
    rng = random.Random(8)
    for _ in range(20000):
        t = "".join(rng.choices("a1.@+ -()9b_0%", k=rng.randrange(40)))
        assert pii.detect(t) == base(t), t
    assert pii.detect("a" * 200_000) == pii.detect("1" * 200_000) == [] and pii.detect("a@" * 50_000) == []


DISGUISED = [
    ("write john.doe [at] example [dot] com now", "email", "john.doe [at] example [dot] com"), ("john at example dot com", "email", "john at example dot com"), ("joe AT mail DOT example DOT org.", "email", "joe AT mail DOT example DOT org"),
    ("jane(at)example(dot)org", "email", "jane(at)example(dot)org"), ("user@example[.]com", "email", "user@example[.]com"), ("jоhn@exаmple.com", "email", "jоhn@exаmple.com"), ("ｊohn＠example．com", "email", "ｊohn＠example．com"),
    ("call plus one five five five one two three four five six seven now", "phone", "plus one five five five one two three four five six seven"), ("+1 five five five one two three four five six seven", "phone", "+1 five five five one two three four five six seven"),
    ("card four" + " one" * 15, "card", "four" + " one" * 15), ("４１１１ １１１１ １１１１ １１１１", "card", "４１１１ １１１１ １１１１ １１１１"), ("4111 1111 1111 1l11", "card", "4111 1111 1111 1l11"), ("4111–1111–1111–1111", "card", "4111–1111–1111–1111"),
    ("john_doe at my-host dot example dot com", "email", "john_doe at my-host dot example dot com"), ("john dot doe at example dot org", "email", "john dot doe at example dot org"), ("jane_at_example_dot_org", "email", "jane_at_example_dot_org"), ("a.b%40example.com", "email", "a.b%40example.com"),
    ("192 dot 168 dot 1 dot 10", "ip", "192 dot 168 dot 1 dot 10"), ("192[.]168[.]1[.]10", "ip", "192[.]168[.]1[.]10"), ("eins neun zwei punkt eins sechs acht punkt eins punkt null", "ip", "eins neun zwei punkt eins sechs acht punkt eins punkt null"),
]


@pytest.mark.parametrize(("text", "kind", "span"), DISGUISED)
def test_disguises(text, kind, span):
    found = pii.find(f"Über {text}")[1]
    assert (kind, text.index(span) + 5, text.index(span) + 5 + len(span)) in found


#: ASCII texts (but for ä) without any other sign of a disguise.
NO_SIGNS = [
    *[f"{name}{gap}at{gap}gmail.com" for name, gaps in (("max.muster", ("_", "-", " ", "  ", "\t", "   ")), ("max2", ("_", " \t"))) for gap in gaps],
    *[f"john{a}{at}{b}example.com" for at in ("at", "arroba", "chez", "ät", "@") for a, b in (("(", ")"), ("[ ", " ]"), ("{  ", "  }"), ("<\t", "\t>"), ("  [   ", "   ] "))],
    *[f"john@example{a}{dot}{b}com" for dot in ("dot", "dt", "punkt", "punto", "point", ".") for a, b in (("(", ")"), ("[  ", "  ]"), (" {\t", "} "))],
    "a.b&commat;example.com", "a.b&#64;example.com", "a.b%40example.com", "john@example&period;com",
]


@pytest.mark.parametrize("text", NO_SIGNS)
def test_disguises_without_other_signs(text):
    assert pii.find(f"Write {text}, please")[1] == [("email", 6, 6 + len(text))]


@pytest.mark.parametrize(("text", "kind"), [("+1 415 555 26 seven one", "phone"), ("4OOO OOOO OOOO OOO2", "card"), ("+1 OOOOO 2345", "phone"), ("4111 1111 1111 111one", "card"), ("four111 1111 one111 1111", "card"), ("4lll IIII 1111 lIIl", "card")])
def test_few_names_and_long_groups(text, kind):
    assert (kind, 6, 6 + len(text)) in pii.find(f"Call: {text}, please")[1]


def test_words_beside_numbers():
    for t in ("+1 415 555 1234 one of them", "+1 415 555 1234 I called", "+1 415 555 1234, one of them"):
        assert pii.find(t)[1] == [("phone", 0, 15)], t
    assert pii.find("４１１１ １１１１ １１１１ １１１１ one")[1] == [("card", 0, 19)] and pii.find("5 one@example.com")[1] == [("email", 2, 17)]


def test_long_texts_stay_linear():
    for unit in ("1", "1 ", "1, ", "one ", "1 one ", "a.", "a-", "a at ", "a dot ", "1O", "double ", "@", "O ", "| ", "+123456789 one "):
        begun = time.process_time()
        pii.find(unit * (200_000 // len(unit)))
        assert time.process_time() - begun < 20, unit


def test_prose_stays_clean():
    for t in ("look at example.com", "meet me at the dot. com on", "one two three", "bob at thnd. of the", "section 1.2.3 at 5", "un deux trois", "plus one"):
        assert pii.find(t) == ([], []), t
    assert pii.mask("a@b.cd, 1.2.3.4 and j at b dot cd") == "<EMAIL>, <IP> and <EMAIL>" and pii.mask(None) is None


def test_pii_report(spark):
    rows = [(1, "a@b.cd"), (2, None), (3, ""), (1, "a@b.cd"), (None, "x at y dot org " * 3000)]
    got = {(r["doc_id"], r["n_email"], r["base_sha256"] == pii.base_digest([]), r["spans"][:12]) for r in pii.report(spark.createDataFrame([(*x, 0) for x in rows], "doc_id long, text string, spans int")).collect()}
    assert got == {(1, 1, False, "email:0:6"), (2, 0, True, ""), (3, 0, True, ""), (None, 3000, True, "email:0:14,e")}
    masked = pii.mask_texts(spark.createDataFrame([("x", "a@b.cd", 6), ("y", None, None)], "n string, text string, n_chars long")).collect()
    assert [tuple(r) for r in masked] == [("x", "<EMAIL>", 7), ("y", None, None)]


def labelled(n=900, seed=9):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        w = [rng.choice(["the", "of", "and"]) + str(rng.randrange(200)) for _ in range(rng.randrange(5, 60))]
        bad, toxic = rng.random() < 0.25, rng.random() < 0.15
        if bad:
            w[::3] = [x + "###" for x in w[::3]]
            w.append(rng.choice(["spam", "junk"]))
        if toxic:
            w.insert(rng.randrange(len(w)), rng.choice(["vileword", "nastyword", "Horridword!"]))
        out.append((i, " ".join(w), int(not bad), int(toxic)))
    return out


def test_chain_held_out(spark):
    rows = labelled()
    chain = toxicity.fit([np.unique(toxicity.words(t)) for _, t, *_ in rows[:600]], np.array([[1 - q, x] for _, _, q, x in rows[:600]]), ("low_quality", "toxic"))
    held = rows[600:]
    p = 1 / (1 + np.exp(-chain.logits(toxicity.matrix([toxicity.words(t) for _, t, *_ in held], chain.features))))
    for k, y in enumerate(([1 - r[2] for r in held], [r[3] for r in held])):
        assert ((p[:, k] >= chain.thresholds[k]) == np.array(y)).mean() > 0.97
    assert len(chain.models[1].weights) == len(chain.features) + 1  # the second model sees the first's answer


def test_classify(spark):
    rows = labelled()
    docs = spark.createDataFrame([(i, t, "o") for i, t, *_ in rows] + [(5000, None, ""), (5001, "", ""), (None, "vileword", "")], "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(i, q, x) for i, _, q, x in rows[:700]] + [(None, 1, 1), (99999, 0, 1), (701, None, None)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.classify(docs, labels).collect()}
    assert len(got) == 903 and np.mean([got[i]["toxic"] == bool(x) for i, _, _, x in rows]) > 0.98 and not got[5000]["toxic"] and not got[5001]["toxic"]
    again = {r["doc_id"]: r["p_toxic"] for r in toxicity.classify(docs.repartition(7), labels.repartition(3)).collect()}
    assert all(abs(again[i] - r["p_toxic"]) < 1e-9 for i, r in got.items())
    kept = toxicity.reject(docs, toxicity.train(docs, labels))
    assert kept.columns == docs.columns and 5000 in {r["doc_id"] for r in kept.select("doc_id").collect()}
    assert not any(r["toxic"] for r in toxicity.classify(docs, labels.limit(0)).collect()) and toxicity.classify(docs.limit(0), labels).count() == 0


def test_pipeline(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    left = docs
    for name, stage in pipeline.STAGES[:-1]:
        nxt = stage(spark, left, DATA)
        assert nxt.columns == docs.columns, name
        left = nxt
    out = pipeline.run(spark, DATA)
    assert 100 < out.count() < docs.count() and out.columns[:2] == ["doc_id", "n_tokens"]
    assert out.select("doc_id").distinct().count() == out.count() and out.where(F.size("ids") != F.col("n_tokens")).isEmpty()
