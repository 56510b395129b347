"""Reports over files, exports, streaming and the query catalog."""

import json
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from blobscope import dims
from blobscope.functions import patterns
from blobscope.operators import codecs, walkers
from blobscope.plans import catalog, export, reports
from blobscope.sources import files
from blobscope.streaming import files as streaming

from .test_walkers import JPEG, PNG

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("files")
    (d / "sub").mkdir()
    (d / "a.jpg").write_bytes(JPEG + b"PK\x03\x04" + b"x" * 20)
    (d / "sub/b.PNG").write_bytes(PNG)
    (d / "bad.jpg").write_bytes(b"\xff\xd8\xff\xe1\xff\xff")
    (d / "c.txt").write_bytes(b"text")
    (d / "empty.jpg").write_bytes(b"")
    return str(d)


def test_reading_and_listing(spark, folder):
    assert files.read_files(spark, folder, ["jpg", ".png"]).count() == 3
    listed = {r["path"].rpartition("/")[2]: r["length"] for r in files.list_files(spark, folder).collect()}
    assert listed["empty.jpg"] == 0 and len(listed) == 5 and files.list_files(spark, folder + "/c.txt").isEmpty()
    g = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2**40), ("d", None)], "p string, n long").select(files.guard(F.col("n"), F.col("p"))["code"]).collect()
    assert [x[0] for x in g] == ["EmptyFile", None, "FileTooLarge", "FileNotFound"]
    with pytest.raises(walkers.Malformed):
        files.from_bytes(spark, b"")
    assert files.parse_extensions(" a, ,b") == ["a", "b"]


def test_audit_and_scan_never_fail(spark, folder):
    rows = {r["path"].rpartition("/")[2]: r for r in reports.audit(files.read_files(spark, folder)).collect()}
    a, bad = rows["a.jpg"], rows["bad.jpg"]
    assert a["overlay_verdict"] == "DETECTED (+24 bytes)" and a["payload_verdict"] == "ALERT: 2 Found" and bad["error"]["code"] == "TruncatedStructure" and rows["c.txt"]["container"] == "unknown"
    scan = reports.scan(files.read_files(spark, folder, ["jpg", "png"]))
    assert {r["category"] for r in scan.where("path like '%bad.jpg'").collect()} == {"Error"}
    docs = [json.loads(r["json"]) for r in export.documents(scan.where("path like '%b.PNG'")).collect()]
    assert docs[0]["count"] == 5 and docs[0]["entries"][0]["tag_id"] is None and docs[0]["entries"][2]["tag_id"] == 256
    assert reports.dump(files.read_files(spark, folder, ["png"])).first()["line"].startswith("[0x00000008] IHDR   length: 25       CRC: 0x")


def test_batch(spark, tmp_path):
    for name, data in (("x.png", PNG_PIXEL), ("n/y.png", PNG_PIXEL), ("z.wav", codecs.encode_wav([0.1, 0.2], 8000, 1)), ("bad.png", PNG)):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    src = files.read_files(spark, str(tmp_path))
    b = reports.Batch(f"file:{tmp_path}", "/out", "bmp", ("png",))
    plan = {r["output"] for r in reports.batch_plan(src, b).collect()}
    assert plan == {"/out/x.bmp", "/out/n/y.bmp", "/out/bad.bmp"}
    done = reports.batch_convert(src.where("path like '%.png'"), b)
    s = reports.batch_summary(done).first()
    assert (s["total"], s["converted"], s["failed"], s["skipped"]) == (3, 2, 1, 0)
    assert reports.batch_summary(done.where("false")).first()["total"] == 0


PNG_PIXEL = codecs.encode_png(__import__("numpy").zeros((2, 2, 3), "uint8"))


def test_stream(spark, folder, tmp_path):
    q = streaming.start(streaming.audit_stream(spark, folder).select("path", "container", "size"), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4


def test_csv_is_safe(spark, tmp_path):
    rows = spark.createDataFrame([("=f", "Text", 270, "=k", "+n", "@v"), ("g", "Text", None, "k", "n", "v")], "path string, category string, tag_id int, key string, name string, value string")
    export.write_csv(rows, str(tmp_path / "c"))
    back = spark.read.option("header", "true").csv(str(tmp_path / "c")).orderBy("file").collect()
    assert tuple(back[0]) == ("'=f", "TEXT", "0x010E", "'=k", "'+n", "'@v")


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    q = con.execute(catalog.ORACLES[name])
    names = [d[0] for d in q.description]
    assert sorted(names) == cols
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
    assert got == sorted((tuple(r[names.index(c)] for c in cols) for r in q.fetchall()), key=repr) and got


def test_sql_functions(spark, folder):
    from blobscope.plans import sqlapi

    sqlapi.register(spark)
    files.read_files(spark, folder).createOrReplaceTempView("media")
    rows = {r["p"].rpartition("/")[2]: r for r in spark.sql("SELECT path AS p, media_parse(content) AS j, length(media_scrub(content)) AS n, media_version() AS v FROM media").collect()}
    assert json.loads(rows["a.jpg"]["j"])["container"] == "jpeg" and rows["a.jpg"]["n"] == len(JPEG) and "code" in json.loads(rows["bad.jpg"]["j"]) and rows["a.jpg"]["v"] == sqlapi.VERSION
    assert "error" in json.loads(sqlapi.scan_json(files.read_files(spark, folder, ["jpg"]).where("path like '%bad%'")).first()["json"])
    assert json.loads(sqlapi.audit_json(files.read_files(spark, folder, ["png"])).first()["json"])["container"] == "png"
    assert sqlapi.exif_text(files.read_files(spark, folder, ["png"])).first()["text"] == "No EXIF metadata found"


def test_convert_sanitize_comment(spark, folder):
    from blobscope.plans import convert

    assert convert.parse_size("640x480") == (640, 480)
    for bad in ("640", "1x2x3", "axb"):
        with pytest.raises(ValueError):
            convert.parse_size(bad)
    png = spark.createDataFrame([("a.png", bytearray(PNG_PIXEL)), ("b.png", bytearray(PNG))], "path string, content binary")
    done = {r["path"]: r for r in png.transform(convert.ImagePipeline().to("bmp").resize(3, 5).quality(90)).collect()}
    assert codecs.decode_bmp(bytes(done["a.png"]["content"])).shape == (5, 3, 3) and done["b.png"]["error"] is not None
    wav = spark.createDataFrame([("a.wav", bytearray(codecs.encode_wav([0.1, 0.3, 0.2, 0.4], 8000, 2)))], "path string, content binary")
    out = codecs.decode_wav(bytes(wav.transform(convert.AudioPipeline().channels(1).gain(2.0).normalize()).first()["content"]))
    assert out.channels == 1 and abs(out.samples.max() - 0.98) < 1e-3
    clean = {r["path"].rpartition("/")[2]: r for r in convert.sanitize(files.read_files(spark, folder)).collect()}
    assert clean["a.jpg"]["output"].endswith("/a.clean.jpg") and clean["a.jpg"]["bytes_removed"] == 24 and clean["bad.jpg"]["error"]["code"] == "CorruptedChunk" and clean["c.txt"]["bytes_removed"] == 0
    kept = convert.set_comment(files.read_files(spark, folder), "hello")
    assert {r["path"].rpartition("/")[2]: r["value"] for r in convert.comments(kept.where("error IS NULL")).collect()} == {"a.jpg": "hello", "b.PNG": "hello"}
    assert kept.where("path like '%c.txt'").first()["error"]["code"] == "UnsupportedFormat"
    assert convert.text_table(spark.createDataFrame([("\x1b[2Jx",)], "v string"), ["v"]).endswith("x") and convert.find_tool("no-such-tool") is None


@pytest.fixture(scope="module")
def long_texts(spark, tmp_path_factory):
    """Documents and passages far longer than any prefix; what tells them apart comes late."""
    d = str(tmp_path_factory.mktemp("long"))
    end = "<script>alert(1)</script>"
    docs = [(1, "a" * 300), (2, "b é " * 200 + "\x01" * 400), (3, "x " * 50_000 + end), (4, "日本" * 15_000), (50, "late " * 30 + end), (51, "c " * 500 + end), (52, " =1 " * 99)]
    spark.createDataFrame([(i, t, len(t)) for i, t in docs], "doc_id long, text string, n_chars long").write.parquet(f"{d}/documents.parquet")
    items = [(0, "short"), (1, "y" * 255), (2, "z é" * 300), (3, "w" * 100_000), (4, "")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, dict(docs), dict(items)


def test_whole_texts(spark, long_texts):
    d, docs, items = long_texts
    run = lambda name, **k: [r.asDict() for r in catalog.QUERIES[name](spark, d).collect()]
    size = {i: len(t.encode()) for i, t in docs.items()}
    for r in run("comment_findings"):
        b = (docs[r["doc_id"]] + "\x01" * (r["doc_id"] % 90)).encode()
        assert (r["size"], r["large"], r["unprintable"]) == (len(b), len(b) > 256, sum(not (32 <= x <= 126 or 9 <= x <= 13) for x in b) / len(b) > 0.15)
    base = (51, 45, 23)
    for r in run("overlay_detect"):
        i = r["doc_id"]
        assert (r["logical_size"], r["overlay_size"], r["has_overlay"]) == (base[i % 3], size[i], True)
    assert {r["doc_id"]: r["kept"] for r in run("overlay_truncate")} == {i: base[i % 3] + (size[i] if i % 3 == 2 else 0) for i in docs}
    audit = {int(r["path"][3:].partition(".")[0]): r for r in run("audit_report")}
    assert all(audit[i]["overlay_verdict"] == f"DETECTED (+{n} bytes)" and audit[i]["size"] == n + base[i % 3] for i, n in size.items())
    assert {i for i, r in audit.items() if r["payload_verdict"] == "ALERT: 2 Found"} == {3, 50, 51}
    comment = {i: " ".join(x for x in t.replace("\n", " ").split(" ") if x) for i, t in docs.items()}
    n = {i: len(t.encode()) for i, t in comment.items()}
    parts = {i: 1 if n[i] <= 65533 else -(-len(t) // 16383) for i, t in comment.items()}
    assert max(parts.values()) > 1
    for name in ("scrub_report", "sanitize_report"):
        for r in run(name):
            i = r["doc_id"] if "doc_id" in r else int(r["path"][3:-4])
            assert {n[i] + 4 * parts[i], n[i] + 57 + 4 * parts[i]} <= set(r.values())
    coms = [r for r in run("jpeg_segments") if r["name"] == "COM (Comment)"]
    assert all(sum(r["length"] for r in coms if r["doc_id"] == i) == n[i] + 4 * parts[i] for i in docs)
    assert {r["doc_id"]: r["comment"] for r in run("jpeg_dims")} == comment
    shown = {int(r["path"][3:-4]): r["value"] for r in run("scan_long") if r["key"] == "JPEGComment"}
    assert all(shown[i] == t for i, t in comment.items() if parts[i] == 1) and len(shown) == len(docs)
    assert {r["doc_id"]: r["escaped"] for r in run("formula_escape")} == {i: ("'" if (t := ("=", " +", "-", "@", "a", "", "\t=")[i % 7] + x).lstrip()[:1] in set("=+-@") else "") + t for i, x in docs.items()}
    assert {len(r["value"]) for r in run("export_csv_rows")} == {len(r["escaped"]) for r in run("formula_escape")}
    assert {r["item_id"]: r["comment"] for r in run("gif_comments")} == {i: f"{t}; second" for i, t in items.items()}
    first = {r["item_id"]: r["length"] for r in run("gif_blocks") if r["pos"] == 0}
    assert first == {i: 3 + len(t.encode()) + -(-len(t.encode()) // 255) for i, t in items.items()}
    assert all(r["comment"] == f"note {r['doc_id']}" and (r["n_set"], r["n_deleted"]) == (1, 0) for r in run("set_comment_roundtrip"))


def test_comments_like_their_sql(spark, tmp_path):
    """A last segment that begins with a space, vertical tabs and other blanks that no SQL trims."""
    docs = [(1, "x" + "ab " * 30_000), (2, "\x0ba \x0b \t b\x0b"), (3, "\u00a0a\u2003"), (4, " \n"), (5, "é" * 33_000 + " x"), (6, "a" * 65_533), (7, "\U0001f600 " * 14_000)]
    spark.createDataFrame([(i, t, len(t)) for i, t in docs], "doc_id long, text string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    for name in ("scan_long", "jpeg_segments", "jpeg_dims", "scrub_report", "sanitize_report"):
        assert sorted(tuple(r) for r in catalog.QUERIES[name](spark, str(tmp_path)).collect()) == sorted(con.execute(catalog.ORACLES[name]).fetchall()), name


def test_all_rows(spark):
    run = lambda name: [r.asDict() for r in catalog.QUERIES[name](spark, DATA).collect()]
    read = lambda name: spark.read.parquet(f"{DATA}/{name}.parquet").collect()
    ids = {r["doc_id"] for r in read("documents")}
    valid = {r["doc_id"]: r["valid"] for r in run("pe_validation")}
    assert valid == {i: i % 11 == 1 and i % 2 == 0 for i in ids} and {i % 11 for i in ids} == set(range(11))
    found = {r["doc_id"]: r["preview"] for r in run("signature_preview")}
    for i in ids:
        pe = b"\0" * 58 + (64 + i % 2).to_bytes(4, "little") + b"PE\0\0" if i % 11 == 1 else b""
        b = (dims.SIGNATURES[i % 11][0] + pe + str(i).encode())[:16]
        assert found[i] == " ".join(f"{x:02X}" for x in b) + " | " + "".join(chr(x) if 32 <= x <= 126 else "." for x in b)
    chunks = {(r["l_orderkey"], r["l_linenumber"], r["pos"]): (r["name"], r["offset"], r["length"], r["width"], r["height"], r["xmp"]) for r in run("webp_chunks")}
    want = {}
    for r in read("lineitem"):
        for pos, part in enumerate((("VP8X", 12, 18), ("XMP ", 30, 9), ("ABCD", 40, 12))):
            want[r["l_orderkey"], r["l_linenumber"], pos] = (*part, r["l_partkey"] % 16000 + 1, r["l_suppkey"] % 9000 + 1, r["l_linestatus"])
    assert chunks == want and {k[1] for k in want} > {1}
    lines = {(r["path"], r["pos"]): (r["head"], r["tail"]) for r in run("structure_dump")}
    want = {}
    for r in read("orders"):
        n = len(r["o_orderpriority"].encode())
        for pos, (name, at, size) in enumerate((("IHDR", 8, 25), ("pHYs", 33, 21), ("tEXt", 54, 19 + n), ("tIME", 73 + n, 19), ("IEND", 92 + n, 12))):
            bad = pos == 2 and r["o_orderkey"] % 10 == 0
            want[f"/o/{r['o_orderkey']}.png", pos] = (f"[0x{at:08X}] {name:<6} length: {size:<8} CRC: ", "(CRC INVALID)" if bad else "(CRC OK)")
    assert lines == want


def test_all_patterns_are_counted(spark, tmp_path):
    words = "https://a.example.com/x?y=1 www.example.org (030)123-456.7 QUJD QUI= a@b.cd 12 none! http://x"
    spark.createDataFrame([(1, words), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = dict(map(tuple, catalog.QUERIES["pattern_counts"](spark, str(tmp_path)).collect()))
    want = {k: n for k, p in patterns.PATTERNS.items() if (n := sum(bool(re.search(p, w)) for w in words.split(" ")))}
    assert got == want and {"url", "domain", "phone_intl", "base64"} <= set(want)


def test_file_sink(spark, tmp_path):
    """Rewritten files are written where their rows say, whole or not at all, and can be read back."""
    from blobscope.sources import sink

    root = tmp_path / "out"
    rows = [(f"a/{i % 3}/f{i}.bin", bytes([i]) * (i + 1)) for i in range(40)] + [("e.bin", b""), ("none.bin", None)]
    sink.write_files(spark.createDataFrame(rows, "output string, content binary").repartition(4), str(root), path_col="output")
    got = {str(p.relative_to(root)): p.read_bytes() for p in root.rglob("*") if p.is_file()}
    assert got == {k: v for k, v in rows if v is not None}
    sink.write_files(spark.createDataFrame([("e.bin", b"new")], "output string, content binary"), str(root), path_col="output")
    assert (root / "e.bin").read_bytes() == b"new"
    for bad in ("../x", "a/../../x"):
        with pytest.raises(Exception, match="outside"):
            sink.write_files(spark.createDataFrame([(bad, b"x")], "output string, content binary"), str(root), path_col="output")
    assert not (tmp_path / "x").exists() and not list(root.rglob("_staging*"))
    sink.write_files(spark.createDataFrame([], "output string, content binary"), str(root), path_col="output")


def test_written_files_query(spark):
    rows = catalog.QUERIES["sanitize_files"](spark, "/root/testdata/sf0.001").collect()
    assert rows and all(r["bytes"] == 57 for r in rows) and len({r["output"] for r in rows}) == len(rows)
