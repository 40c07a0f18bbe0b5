import base64
import gzip
import hashlib
import time
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwright.llm import topk, warc


def test_plain_text():
    page = "<html lang='en'><head><title>T &amp; x</title><style>p{}</style></head><body><!-- no --><h1>One</h1><p>Two <b>bold</b>&nbsp;x<br>three<script>var a='<p>'</script></p><ul><li>a<li>b</ul>1 < 2</body>"
    assert warc.plain_text(page) == "One\nTwo bold x\nthree\na\nb\n1 < 2"
    assert warc.plain_text("") == "" and warc.plain_text("<p") == "<p" and warc.plain_text("<!-- open") == ""


def test_derivatives(spark):
    pages = spark.createDataFrame([(1, "http://a/x", "<html lang=de><title>Hi</title><p>Text <a href='/l'>l</a>"), (2, None, None), (3, "http://b", ""), (3, "http://b", "")], "page_id long, url string, html string").withColumn("block", F.lit("clash"))
    found = warc.responses(pages)
    rows = warc.derive(found).collect()
    ids = {r["page_key"]: r["record_id"] for r in found.collect()}
    assert len(rows) == 8 and all(r["refers_to"] == ids[r["page_key"]] for r in rows)
    by = {(r["page_key"], r["warc_type"]): r for r in rows}
    meta, text = by["1", "metadata"], by["1", "conversion"]
    assert text["block"] == "Text l" and text["block_digest"] == "sha1:" + base64.b32encode(hashlib.sha1(b"Text l").digest()).decode()
    assert "title: Hi\r\n" in meta["block"] and "language: de\r\n" in meta["block"] and "outlink: /l\r\n" in meta["block"] and "source-header-Content-Type: text/html; charset=utf-8\r\n" in meta["block"]
    head = {h["name"]: h["value"] for h in text["headers"]}
    assert head["WARC-Refers-To"] == ids["1"] and head["WARC-Refers-To-Target-URI"] == "http://a/x"
    assert "WARC-Target-URI" not in {h["name"] for h in by["2", "conversion"]["headers"]} and by["2", "conversion"]["block"] == ""
    assert len({r["record_id"] for r in rows}) == 6
    assert warc.derive(found.where("1 = 0")).count() == 0


def test_files_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"<p>page {i}\r\n\r\nWARC/1.1 inside") for i in range(5)], "page_id long, url string, html string")
    records = warc.with_bytes(warc.derive(warc.responses(pages))).orderBy("page_key", "warc_type").collect()
    (tmp_path / "d.warc.gz").write_bytes(b"".join(bytes(r["record"]) for r in records))
    back = list(warc.parse((tmp_path / "d.warc.gz").read_bytes()))
    assert [(h["WARC-Type"], h["WARC-Record-ID"], b.decode()) for h, b in back] == [(r["warc_type"], r["record_id"], r["block"]) for r in records]
    raw = warc.serialise([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:x>"), ("WARC-Target-URI", "http://h"), ("WARC-Date", "d")], b"HTTP/1.1 200 OK\r\nServer: s\r\n\r\n<p>hello")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "r.warc.gz").write_bytes(gzip.compress(raw))
    out = {r["warc_type"]: r["block"] for r in warc.derive(warc.read_warc(spark, str(tmp_path / "in"))).collect()}
    assert out["conversion"] == "hello" and "source-header-Server: s" in out["metadata"]


@pytest.mark.parametrize("unit", ["<a ", "<a<a", "<title>", "<html ", "<script ", '<a href="', "<!-- "])
@pytest.mark.parametrize("end", ["", ">"])
def test_long_pages(unit, end):
    """Five times the page takes about five times as long, not twenty-five (which would be minutes here)."""
    page = unit * (5_000_000 // len(unit)) + end
    started = time.process_time()
    warc._derived("k", "r", "u", "d", [], page)
    assert time.process_time() - started < 20


class Reader(HTMLParser):
    def __init__(self):
        super().__init__()
        self.links, self.title, self.lang = [], None, None

    def handle_starttag(self, tag, attrs):
        got = dict(attrs)
        if tag == "a" and got.get("href"):
            self.links.append(got["href"])
        if tag == "html":
            self.lang = got.get("lang")
        self.inside = tag

    def handle_data(self, data):
        if getattr(self, "inside", "") == "title" and self.title is None:
            self.title = data


def test_query_against_parser(spark, sf):
    """Links, title and language of every page are those that a parser finds."""
    rows = {(r["page_id"], r["warc_type"]): r for r in warc.op6_warc_derivatives(spark, sf).collect()}
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert len(rows) == 2 * len(pages)
    for p in pages:
        read = Reader()
        read.feed(p["html"] or "")
        fields = [x.split(": ", 1) for x in rows[p["page_id"], "metadata"]["block"].split("\r\n") if ": " in x]
        assert [v for n, v in fields if n == "outlink"] == read.links
        assert [v for n, v in fields if n == "title"] == ([" ".join(read.title.split())] if read.title else [])
        assert [v for n, v in fields if n == "language"] == ([read.lang] if read.lang else [])
        raw = (p["html"] or "").encode()
        assert rows[p["page_id"], "conversion"]["payload_digest"] == "sha1:" + base64.b32encode(hashlib.sha1(raw).digest()).decode()


def test_damage_inside_a_file(spark, tmp_path):
    """A flipped byte costs its own member only, also where it inflates without an error; junk between members costs nothing."""
    rng = np.random.default_rng(1)
    texts = [bytes(rng.integers(97, 123, 3000).astype(np.uint8)) for _ in range(4)]
    packed = [gzip.compress(warc.serialise([("WARC-Type", "response"), ("WARC-Record-ID", f"<r{i}>")], b"HTTP/1.1 200 OK\r\n\r\n" + t)) for i, t in enumerate(texts)]
    for at in range(12, len(packed[1]), 97):
        broken = bytearray(packed[1])
        broken[at] ^= 4
        data = packed[0] + bytes(broken) + b"\x1f\x8b\x08 junk" + packed[2] + packed[3]
        assert [h["WARC-Record-ID"] for h, _ in warc.parse(data)] == ["<r0>", "<r2>", "<r3>"], at
    (tmp_path / "a.warc.gz").write_bytes(data)
    assert [r["page_key"] for r in warc.read_warc(spark, str(tmp_path)).collect()] == ["<r0>", "<r2>", "<r3>"]
    told = warc.damaged(spark, str(tmp_path)).collect()
    assert [r["offset"] for r in told] == [len(packed[0])] and told[0]["problem"]


def test_digest_of_the_bytes(spark, tmp_path):
    body = "<p>caf\u00e9</p>".encode("latin-1")
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=ISO-8859-1\r\n\r\n"
    record = warc.serialise([("WARC-Type", "response"), ("WARC-Record-ID", "<r>"), ("WARC-Payload-Digest", "sha1:STATED")], head + body)
    (tmp_path / "a.warc").write_bytes(record)
    out = {r["warc_type"]: r for r in warc.derive(warc.read_warc(spark, str(tmp_path))).collect()}
    assert out["conversion"]["block"] == "caf\u00e9" and out["conversion"]["payload_digest"] == warc.digest(body)
    assert f"source-payload-digest: {warc.digest(body)}" in out["metadata"]["block"] and "source-header-WARC-Payload-Digest: sha1:STATED" in out["metadata"]["block"]
    assert warc.decoded(b'<meta charset="utf-16-le-no"> x', "") == '<meta charset="utf-16-le-no"> x'
    assert warc.decoded('<meta charset="cp1251">\u0430'.encode("cp1251"), "text/html")[-1] == "\u0430"


def test_broken_files():
    good = warc.serialise([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:x>")], b"block")
    bad = b"WARC/1.1\r\nContent-Length: many\r\n\r\nlost\r\n\r\n"
    assert [b for _, b in warc.parse(good + bad + good)] == [b"block", b"block"]
    assert [b for _, b in warc.parse(good + good[:-8])] == [b"block"]
    assert [b for _, b in warc.parse(good + b"WARC/1.1\r\nWARC-Ty")] == [b"block"]
    assert [b for _, b in warc.parse(gzip.compress(good) + gzip.compress(good)[:-12])] == [b"block"]
    assert list(warc.parse(b"")) == [] and list(warc.parse(b"no file")) == []


def brute(ids, x, qids, q, k):
    out = {}
    for i, v in zip(qids, q, strict=True):
        scored = sorted((-int(v @ y), int(j)) for j, y in zip(ids, x, strict=True) if j != i)
        out[i] = [(j, -s) for s, j in scored[:k]]
    return out


@pytest.mark.parametrize("kind", ["random", "clusters", "ties"])
def test_search(kind):
    rng = np.random.default_rng(3)
    n = 700
    x = {"random": rng.integers(-60, 60, (n, 16)), "clusters": np.repeat(rng.integers(-90, 90, (7, 16)), 100, 0) + rng.integers(-2, 3, (n, 16)), "ties": rng.integers(0, 2, (n, 4))}[kind].astype(float)
    ids, qid = np.arange(n), np.arange(0, n, 13)
    low = topk.search(x, ids, x[qid], qid, 5)
    best = topk.search(x, ids, x[qid], qid, 5, low.score[:, -1])
    want = brute(ids, x, qid, x[qid], 5)
    for r, i in enumerate(qid):
        assert [(int(a), int(s)) for a, s in zip(best.id[r], best.score[r], strict=True)] == want[i]


def test_pruning_happens():
    rng = np.random.default_rng(5)
    x = np.repeat(rng.normal(size=(32, 8)) * 100, 32, 0) + rng.normal(size=(1024, 8))
    seen = []
    real = topk._offer_leaf
    try:
        topk._offer_leaf = lambda tree, ids, best, leaf, rows, q, qid: (seen.append(len(rows)), real(tree, ids, best, leaf, rows, q, qid))[1]
        topk.search(x, np.arange(1024), x[:10], np.arange(10), 5, np.full(10, -np.inf))
    finally:
        topk._offer_leaf = real
    assert sum(seen) < 0.6 * 10 * len(topk.BallTree(x).leaves)


def test_awkward_vectors(spark):
    rows = [(0, [1.0, 0.5]), (1, [0.5, 1.0]), (2, None), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, []), (6, [1.0, None]), (7, [1.0, 0.5]), (7, [1.0, 0.5]), (8, [1.0]), (50, [-0.001, 1.0]), (None, [1.0, 1.0]), (100, [3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    out = topk.top_k(df, df.where("vec_id % 50 = 0"), 5, scale=256.0, shard_rows=2, block_rows=1)
    got = {}
    for r in out.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    q0, q50 = np.array([256, 128]), np.array([-1, 256])
    v = {1: np.array([128, 256]), 7: q0, 50: q50, 0: q0}
    # A repeated row is a candidate each time: every row but the query's own counts.
    assert got[0] == [(1, 7, int(q0 @ v[7])), (2, 7, int(q0 @ v[7])), (3, 1, int(q0 @ v[1])), (4, 50, int(q0 @ v[50]))]
    assert got[50] == [(1, 1, int(q50 @ v[1])), (2, 0, int(q50 @ v[0])), (3, 7, int(q50 @ v[7])), (4, 7, int(q50 @ v[7]))]
    assert got[100] == [(1, 8, 768 * 256)]
    assert topk.top_k(df.where("1 = 0"), df.where("1 = 0"), 5).count() == 0
