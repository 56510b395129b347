"""BPE, token counts and packed ids against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from blobscope.llm import bpe, tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIB = tokenizers.Tokenizer.from_file(PATH)
HARD = ["", " ", "  ", "a  b", " a", "a ", "\n", "a\n b", "a \nb", "a\n \nb", "   x", "x   ", "<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>", "I'll don't 'S", "aaaaaaa aaaa", "日本語 テスト", "٣٤٥ abc²½", "\x1c a\x1d b\x85 c", "é É́", "😀 😀", "a​b 　x", "ab\r\n\r\ncd \t ef", "x" * 5000, "z " * 3000]


def ids(text):
    return LIB.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def encoders():
    return bpe.Encoder(bpe.Vocabulary(PATH), memo_bytes=10_000), tokens.LibraryEncoder(PATH)


def test_hard_texts(encoders):
    rng = random.Random(1)
    alphabet = [*"ab \n\t'st1²é日 　 \x1f.,", "<|endoftext|>", "'ll"]
    texts = HARD + ["".join(rng.choices(alphabet, k=rng.randint(0, 12))) for _ in range(3000)] + [f"a{chr(c)}b {chr(c)} {chr(c)}{chr(c)}1" for c in range(1, 0x11000, 11) if not 0xD800 <= c < 0xE000]
    want = [ids(t) for t in texts]
    for e in encoders:
        assert [np.frombuffer(x, "<u4").tolist() for x in e.ids(texts)] == want
    v = encoders[0].vocabulary
    assert [v.decode(x) for x in want] == [LIB.decode(x, skip_special_tokens=False) for x in want]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    for e in (bpe.encoder(PATH), tokens.library_encoder(PATH)):
        assert np.frombuffer(e.ids([text])[0], "<u4").tolist() == ids(text)


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 32), st.data())
def test_packing_round_trip(bits, data):
    x = np.array(data.draw(st.lists(st.integers(0, 2**bits - 1), max_size=300)), np.uint32)
    assert (tokens.unpack(tokens.pack(x, bits), len(x), bits) == x).all()


def test_segment_random_access():
    rng = np.random.default_rng(0)
    parts = [rng.integers(0, 2**17, n).astype(np.uint32) for n in (0, 5, 40, 1, 300)]
    s = tokens.Segment(tokens.write_segment([3, None, 5, 6, 7], parts, 17, block_ids=16))
    flat = np.concatenate(parts)
    assert s.doc_ids == [3, None, 5, 6, 7] and all((s.ids(a, b) == flat[a:b]).all() for a in range(0, 346, 13) for b in range(a, 360, 7))
    assert all((s.document(k) == p).all() for k, p in enumerate(parts))
    with pytest.raises(ValueError):
        tokens.pack(np.array([4], np.uint32), 2)


ROWS = [(3, "b <|endoftext|> c", "x"), (1, None, "y"), (2, "", "z"), (1, "same", "q"), (1, "same", "q"), (None, "no id", "r"), (9, "long " * 30000, "s")]


def frame(spark, rows=ROWS):
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")


def test_round_trip_digests(spark):
    got = sorted(map(tuple, bpe.round_trip_digests(frame(spark), PATH).collect()), key=repr)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert got == sorted(((i, len(ids(t or "")), sha(",".join(map(str, ids(t or "")))), sha(LIB.decode(ids(t or ""), skip_special_tokens=False))) for i, t, _ in ROWS), key=repr)
    assert bpe.round_trip_digests(frame(spark, []), PATH).count() == 0


def test_counts_and_cache(spark, tmp_path):
    path = str(tmp_path / "cache")
    run = lambda rows, n=None: sorted(map(tuple, tokens.count_tokens(frame(spark, rows), PATH, path, normalise=n).collect()), key=repr)
    want = sorted(((i, len((t or "").encode()), len(ids(t or ""))) for i, t, _ in ROWS), key=repr)
    assert run([]) == [] and run(ROWS) == want
    stored = spark.read.parquet(path).count()
    assert run(ROWS) == want and spark.read.parquet(path).count() == stored == 5  # the second time all are hits
    run([*ROWS, (10, "new", "")])
    assert spark.read.parquet(path).count() == 6
    other = public_tokenizers.path("piece_bpe_32k.model")
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=other)
    got = {tuple(r) for r in tokens.count_tokens(frame(spark), other, path).collect()}
    assert got == {(i, len((t or "").encode()), len(sp.encode(t or ""))) for i, t, _ in ROWS}


def test_packed_files(spark, tmp_path):
    for rows in (ROWS, []):
        out = str(tmp_path / f"packed{len(rows)}")
        tokens.write_ids(frame(spark, rows), PATH, out, 50257, segment_ids=50)
        got = sorted(map(tuple, tokens.read_ids(spark, out).collect()), key=lambda r: r[1])
        start, want = 0, []
        for i, _, n, _ in got:
            want.append(start)
            start += n
        assert [r[1] for r in got] == want and [r[0] for r in got] == sorted((r[0] for r in rows), key=lambda x: (x is not None, x))
        crc = lambda t: zlib.crc32(np.array([*ids(t or ""), 0], "<u4").tobytes())
        assert sorted((r[0] or -1, r[3]) for r in got) == sorted((i or -1, crc(t)) for i, t, _ in rows)
