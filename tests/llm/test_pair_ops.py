"""Search, near duplicates, suffix arrays, WARC and the pipeline against brute force."""

import gzip
import hashlib
import random
import re
import tracemalloc
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidewell.llm import graph, jaccard_join, kdtree, queries, suffix_dedup, suffix_sort, warc
from tidewell.llm.graph import components

from .conftest import ODD
from .test_text_ops import sanitised

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


# ---------------------------------------------------------------- search


def test_search(spark, monkeypatch):
    monkeypatch.setattr(kdtree, "SHARD", 60)
    monkeypatch.setattr(kdtree, "AT_ONCE", 7)
    monkeypatch.setattr(kdtree, "LEAF", 8)
    rng = np.random.default_rng(1)
    rows = [(i, np.round(rng.normal(size=5), 1).tolist(), "x") for i in range(300)]
    rows += [(20, None, "x"), (400, [1.0, None, 0.0, 0.0, 0.0], "x"), (420, [float("nan")] * 5, "x"), (440, [1.0] * 3, "x"), (441, [2.0] * 3, "x"), (7, [3.0] * 5, "x"), (460, [], "x"), (40, [1.0, 0.5, 0.0, 2.0, -1.0], "x"), (480, [0.25] * 5, "x"), (480, [0.25] * 5, "x")]
    got = kdtree.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string"), F.col("vec_id") % 20 == 0, k=6)
    ok = [(i, np.floor(64 * np.array(v, np.float32).astype(float))) for i, v, _ in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for n, (i, q) in enumerate(ok):
        if i % 20 == 0:
            best = sorted((-int(q @ v), j) for m, (j, v) in enumerate(ok) if m != n and len(v) == len(q))[:6]
            want += [(i, r, j, -s) for r, (s, j) in enumerate(best, 1)]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_search_empty(spark):
    assert kdtree.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True)).count() == 0


# ---------------------------------------------------------------- near duplicates


def similar(data, run=5, t=0.8):
    low = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x or "")
    sets = []
    for i, text in data:
        w = WORD.findall(low(text)) if i is not None else []
        sets.append({tuple(w[k : k + run]) for k in range(max(1, len(w) - run + 1))} if w else set())
    return [(a, b) for a in range(len(data)) for b in range(a) if sets[a] and sets[b] and len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]) - 1e-9]


@pytest.fixture
def met(monkeypatch):
    """Rows of links that meet labels in a round, for each time that components are looked for."""
    rows, write = [], graph.stored

    def stored(df, name):
        out = write(df, name)
        if name == "links":
            rows.append(out.count())
        return out

    monkeypatch.setattr(graph, "stored", stored)
    return rows


def near_copies(n):
    rng = random.Random(n)
    base = [f"w{rng.randrange(3000)}" for _ in range(120)]
    return [(k, " ".join([*base[: (p := rng.randrange(120))], f"new{k}", *base[p + 1 :]])) for k in range(n)]


@pytest.mark.parametrize("block", [512, 5])
def test_jaccard_join(docs, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rng = random.Random(6)
    data = list(ODD)
    for g in range(8):
        base = [f"g{g}w{rng.randrange(500)}" for _ in range(80)]
        for k in range(rng.choice([1, 3, 12])):
            w = list(base)
            for _ in range(rng.randrange(0, 3)):
                w[rng.randrange(len(w))] = f"new{rng.random()}"
            data.append((1000 + 100 * g + k, " ".join(w)))
    got = jaccard_join.join(docs(data)).collect()
    links, root = Counter(), {}

    def top(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    for a, b in similar(data):
        links[a] += 1
        links[b] += 1
        x, y = top(data[a][0]), top(data[b][0])
        root[max(x, y)] = min(x, y)
    assert Counter((r.doc_id, r.n_links, r.group_id) for r in got) == Counter((i, links[k], None if i is None else top(i)) for k, (i, _) in enumerate(data))
    assert max(links.values()) >= 5


def test_jaccard_repeated_ids(docs):
    """Rows that repeat a doc_id are documents each, whatever their texts."""
    a, b = (" ".join(f"{x}{k}" for k in range(60)) for x in "ab")
    data = [(5, a), (5, b), (6, a + " z"), (7, b + " z"), (8, b + " y"), (5, b.upper()), (5, b), (9, None), (9, None), (9, "")]
    got = jaccard_join.join(docs(data)).collect()
    links = Counter(x for pair in similar(data) for x in pair)
    assert Counter((r.doc_id, r.n_links) for r in got) == Counter((i, links[k]) for k, (i, _) in enumerate(data))
    assert {(r.doc_id, r.group_id) for r in got} == {(5, 5), (6, 5), (7, 5), (8, 5), (9, 9)} and len({(r.group_id, r.group_tag) for r in got}) == 4


def test_near_duplicates_repeated_ids(spark, docs):
    a, b = (" ".join(f"{x}{k}" for k in range(60)) for x in "ab")
    data = [(3, a), (5, a + " q"), (5, b), (6, b), (7, b.upper()), (5, b), (9, None), (9, None), (None, a)]
    rows = docs(data).select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    got = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, rows, "")
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter([(3, a), (5, b), (9, None), (9, None), (None, a)])


def test_near_duplicates_of_a_large_group(spark, docs, monkeypatch, met):
    """Of a group over many blocks one document stays, and links as rows grow with it, not with its square."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    data = near_copies(160) + [(500, "another text"), (501, None)]
    rows = docs(data).select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    got = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, rows, "")
    assert sorted(r.doc_id for r in got.collect()) == [0, 500, 501]
    assert len(met) == 2 and max(met) <= 6 * 160, met


def test_jaccard_without_broadcast(docs, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BROADCAST_ROWS", 0)
    test_jaccard_repeated_ids(docs)


def test_jaccard_links_grow_with_a_group(docs, monkeypatch, met):
    """A group of near copies over many blocks: every link is counted, and links as rows grow with it, not with its square."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    for n in (80, 160):
        assert {(r.n_links, r.group_id) for r in jaccard_join.join(docs(near_copies(n))).collect()} == {(n - 1, 0)}
    assert len(met) == 4 and all(x <= 6 * n for x, n in zip(met, (80, 80, 160, 160), strict=True)), met


def test_jaccard_empty(none):
    assert jaccard_join.join(none).count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (None, 3)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_components_of_dense_links(spark, met):
    rng = random.Random(4)
    dense = [(a, b) if rng.random() < 0.5 else (b, a) for a in range(1000, 1060) for b in range(1000, a)]
    links = dense + [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(k, k + d) for k in range(300, 330) for d in (1, 2)]
    want = {x: x for link in links for x in link}
    for _ in want:
        for a, b in links:
            want[a] = want[b] = min(want[a], want[b])
    loops = {a for a, b in links if a == b} - {x for a, b in links if a != b for x in (a, b)}
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: c for x, c in want.items() if x not in loops}
    assert len(met) == 1 and met[0] <= 3 * len(want)


# ---------------------------------------------------------------- suffix arrays


@pytest.mark.parametrize("held,solo", [(16, 1), (64, 3), (4096, 2048), (2_000_000, 2048)])
def test_suffixes(tmp_path, monkeypatch, held, solo):
    """Orders with queues on disk or not, and characters swept alone or many at a time."""
    monkeypatch.setattr(suffix_sort, "SOLO", solo)
    rng = np.random.default_rng(3)
    for k in range(60):
        t = rng.integers(1, 2 + k % 7 if k % 2 else 60, rng.integers(1, 150))
        t = np.append(np.repeat(t, 6) if k % 5 == 0 else np.tile(t, 3) if k % 5 == 1 else t, 0)
        assert np.concatenate(list(suffix_sort.suffixes(t, str(tmp_path), held))).tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())
    assert not list(tmp_path.iterdir())


def test_suffixes_larger_than_memory(tmp_path):
    """A text is sorted in less than a tenth of the memory that it and its order take, long copies and a large alphabet
    included."""
    rng = np.random.default_rng(4)
    t = np.concatenate([rng.integers(1, 60_000, 4_500_000), np.tile(rng.integers(1, 200, 300_000), 5), [0]]).astype(np.uint32)
    t.tofile(tmp_path / "text")
    t = np.memmap(tmp_path / "text", np.uint32, "r")
    tracemalloc.start()
    n, last = 0, None
    for rows in suffix_sort.suffixes(t, str(tmp_path), 60_000):
        both = np.append(last, rows) if last is not None else rows
        a, b = both[:-1], both[1:]
        for _ in range(3):  # in order by the first characters
            x, y = t[a], t[b]
            assert (x <= y).all()
            a, b = a[x == y] + 1, b[x == y] + 1
        n, last = n + len(rows), rows[-1:].copy()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == len(t) and peak * 10 <= t.nbytes + 8 * n, peak


def brute_repeats(data, n=50):
    out = Counter()
    for i, t in data:
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        if i is not None:
            others = {(o or "").encode() for j, o in data if j is not None and j < i}
            held = {o[p : p + n] for o in others for p in range(len(o) - n + 1)}
            for p in range(len(raw) - n + 1):
                if raw[p : p + n] in held:
                    gone[p : p + n] = True
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        spans = int(np.sum(np.diff(np.concatenate([[False], gone]).astype(int)) == 1))
        out[i, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


@pytest.mark.parametrize("pieces,held", [(16, 2_000_000), (256, 64)])
def test_remove_repeats(docs, monkeypatch, pieces, held):
    monkeypatch.setattr(suffix_dedup, "PIECE", pieces)
    monkeypatch.setattr(suffix_dedup, "HELD", held)
    monkeypatch.setattr(suffix_dedup, "WAITING", 3)
    rng = random.Random(8)
    text = lambda n: "".join(rng.choices("abc é", k=n))
    shared = [text(n) for n in (49, 50, 51, 90, 300, 1200)]
    data = [(i, t) for i, t in ODD if i != 5] + [(5, "word " * 200)]
    for i in range(60):
        data.append((rng.randrange(10, 60), text(rng.randrange(80)) + rng.choice(shared) + text(rng.randrange(80)) + rng.choice(shared)[: rng.randrange(400)]))
    data += [(70, shared[5]), (71, shared[5]), (9, shared[4][3:200])]
    got = suffix_dedup.remove_repeats(docs(data)).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_repeats(data)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 and sum(s.end - s.start for s in r.spans) == r.n_removed for r in got)


def test_shard_writes_strings_of_many_anchors_together(monkeypatch):
    """Most anchors bring a shard two or three strings. Its files are written once for many of them, and what waits in
    memory is bounded; the runs are the same."""
    rng = random.Random(9)
    both = ["".join(rng.choices("abcdefgh", k=50)).encode() for _ in range(1_000)]
    writes = lambda: int(re.search(r"syscw: (\d+)", open("/proc/self/io").read())[1])
    for buffer in (suffix_dedup.BUFFER, 300):
        monkeypatch.setattr(suffix_dedup, "BUFFER", buffer)
        shard, before = suffix_dedup.Shard(2_000_000, 50), writes()
        for i, text in enumerate(both):
            shard.add([(b"x" + text + b"y", 1, i, 0, 7), (text + b"z", 2, i, 1, 5)])
            assert sum(len(x[0]) for x in shard.buffer) <= buffer
        if buffer > 300:
            assert writes() - before < len(both)
        runs = [r for found in shard.covered() for r in zip(*(found[k].tolist() for k in ("r1", "r2", "start", "end")), strict=True)]
        shard.close()
        assert sorted(runs) == [(i, 1, 5, 6) for i in range(len(both))]


def test_remove_repeats_empty(none):
    assert suffix_dedup.remove_repeats(none).count() == 0


# ---------------------------------------------------------------- WARC

PAGE = """<!DOCTYPE html><html lang="fr"><head><meta charset="utf-8"><title>A &amp; B</title><style>p{}</style>
<script>var t = "</p>";</script></head><body><!-- no --><p>One<br>two &lt;3</p><a href="/x?a=1&amp;b=2" title="a > b">link</a><a href='http://o.example/'>o</a></body></html>"""


def test_warc_records(tmp_path, spark):
    headers, block = warc.response(7, "http://e.example/d/", PAGE)
    made = warc.derive(headers, block)
    (m, meta), (c, text) = made
    m, c = dict(m), dict(c)
    own = dict(headers)["WARC-Record-ID"]
    assert m["WARC-Refers-To"] == c["WARC-Refers-To"] == own and m["WARC-Concurrent-To"] == c["WARC-Record-ID"] and c["WARC-Concurrent-To"] == m["WARC-Record-ID"]
    assert text.decode() == "One\ntwo <3\nlinko"
    lines = meta.decode().split("\r\n")
    assert {"title: A & B", "lang: fr", "charset: utf-8", "outlink: http://e.example/x?a=1&b=2", "outlink: http://o.example/"} <= set(lines)
    assert c["WARC-Source-Payload-Digest"] == warc.digest(PAGE.encode()) and c["WARC-Block-Digest"] == warc.digest(text)
    assert warc.parse(b"".join(warc.record(h, b) for h, b in made)) == [(h + [("Content-Length", str(len(b)))], b) for h, b in made]
    pages = spark.createDataFrame([(1, "http://a.example/", PAGE, 0), (2, None, None, 0), (3, "::bad[", "<a href='http://[x'>t<script>open", 0), (3, "u", "<p", 0)], "page_id long, url string, html string, n_bytes int")
    rows = warc.derivatives(pages)
    files = warc.write(rows, str(tmp_path / "out")).collect()
    read = lambda f: warc.parse(open(f, "rb").read())
    found = [x for f in files if f.records for x in read(f.file)]
    assert len(found) == 8 == rows.count() and {dict(h)["WARC-Record-ID"] for h, _ in found} == {r.record_id for r in rows.collect()}
    assert warc.derivatives(pages.limit(0)).count() == 0


class Plain(HTMLParser):
    """Text by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.hidden, self.title = [], None, False

    def handle_starttag(self, tag, attrs):
        self.out.append("\n" if tag in warc._BLOCK and not self.hidden else "")
        self.hidden = self.hidden or (tag if tag in warc._HIDDEN else None)
        self.title = self.title or tag == "title"

    def handle_endtag(self, tag):
        self.out.append("\n" if tag in warc._BLOCK and not self.hidden else "")
        self.hidden = None if tag == self.hidden else self.hidden
        self.title = self.title and tag != "title"

    def handle_data(self, data):
        if not self.hidden and not self.title:
            self.out.append(data)


def test_warc_text_by_brute_force():
    rng = random.Random(15)
    word = lambda: rng.choice(["İİ", "plain", "ǅ", "x &amp; y", "é", "&#304;", "ẞ", "a  b", "&lt;p>"])
    for _ in range(300):
        page = ""
        for _ in range(rng.randrange(1, 25)):
            tag = rng.choice(["p", "div", "b", "SPAN", "h1", "li"])
            page += rng.choice([
                f"<{tag}>{word()} {word()}</{tag}>", f"<SCRIPT>var {rng.choice(['İ', 'x'])} = 1</Script>", f"<style>{word()}</STYLE>", f"<!-- {word()} -->", "<br>", f"{word()}\n", f'<a href="/{word()}" title="a > b">{word()}</a>', f"<title>{word()}</title>",
            ])
        plain = Plain()
        plain.feed(page)
        plain.close()
        want = "\n".join(x for line in "".join(plain.out).split("\n") if (x := re.sub(r"[ \t\r\f\v ]+", " ", line).strip(" ")))
        assert warc.read_page(page)[0] == want, page
    assert warc.read_page("İ" * 30 + "<script>x</script><p>visible text here</p>")[0] == "İ" * 30 + "\nvisible text here"
    assert warc.read_page("<p>" + "long " * 300_000 + "<SCRIPT>" + "x" * 1000)[0] == ("long " * 300_000).strip()


def test_warc_source(spark, tmp_path):
    """Response records of files come out as linked records, whatever stands between them."""
    rng, want = random.Random(16), {}
    for n in range(3):
        data = b""
        for k in range(40):
            kind = rng.choice(["response", "response", "request", "warcinfo"])
            body = f"<title>T{k}</title><p>İ page {n} {k}</p>".encode()
            fields = b"content-type: text/html; Charset=UTF-8\r\n"
            if k % 3 == 1:
                body, fields = gzip.compress(body), fields + b"Content-Encoding: gzip\r\n"
            if k % 3 == 2:
                body, fields = b"%x\r\n%s\r\n0\r\n\r\n" % (len(body), body), fields + b"Transfer-Encoding: chunked\r\n"
            rid = f"<urn:uuid:{n}-{k}>"
            headers = [("warc-type", kind), ("WARC-Record-ID", rid), ("WARC-Target-URI", f"http://e.example/{n}/{k}"), ("WARC-Date", "2024-01-02T03:04:05Z"), ("WARC-Payload-Digest", f"sha1:{n}{k}")]
            r = warc.record(headers, b"HTTP/1.1 200 OK\r\n" + fields + b"\r\n" + body)
            data += gzip.compress(r) if n else r
            if kind == "response":
                want[rid] = (f"İ page {n} {k}", f"sha1:{n}{k}", f"http://e.example/{n}/{k}")
        (tmp_path / f"{n}.warc{'.gz' if n else ''}").write_bytes(data)
    rows = warc.derived(warc.responses(spark, str(tmp_path / "*.warc*"))).collect()
    texts = {r.refers_to: r for r in rows if r.kind == "conversion"}
    about = {r.refers_to: r for r in rows if r.kind == "metadata"}
    assert {k: (r.content, r.source_digest, r.target_uri) for k, r in texts.items()} == want and set(about) == set(want) and len(rows) == 2 * len(want)
    assert all(about[k].record_id == texts[k].concurrent_to and texts[k].record_id == about[k].concurrent_to and f"title: T" in about[k].content for k in want)
    for r in rows:
        (headers, block), = warc.parse(r.record)
        assert warc.digest(block) == r.block_digest == dict(headers)["WARC-Block-Digest"] and dict(headers)["WARC-Refers-To"] == r.refers_to
    assert warc.responses(spark, str(tmp_path / "0.warc")).limit(0).count() == 0


# ---------------------------------------------------------------- pipeline and registry


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(2)
    words = [a + b for a in ("ka", "lo", "mi", "nu", "re") for b in ("bar", "den", "fol", "gur", "hin", "jop")]
    text = lambda n: " ".join(rng.choices(words, k=n))
    docs = [(i, text(60), "en", f"s{i % 3}") for i in range(300)]
    labels = []
    for k, (i, t, lang, source) in enumerate(docs):
        if i % 6 == 0:
            docs[k] = (i, " ".join("vilewort" if j % 8 == 0 else w for j, w in enumerate(t.split())), lang, source)
        labels.append((i, 1, int(i % 6 == 0)))
    item = text(20)
    docs += [(301, docs[1][1], "en", "s"), (302, docs[1][1] + " extra", "en", "s"), (303, text(20) + " " + item + " " + text(9), "en", "s"), (304, "write to bob@corp.example now", "en", "s"), (305, None, None, None), (306, "", "en", "s"), (7, docs[7][1], "en", "s7"), (None, text(30), "en", "s")]
    spark.createDataFrame([(*d, len(d[1] or "")) for d in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        kept[name] = Counter(r.doc_id for r in now.select("doc_id").collect())
        if k < 4:
            assert now.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    toxic = {i for i in range(300) if i % 6 == 0}
    assert not toxic & set(kept["toxicity"]) and len(set(kept["toxicity"])) == 300 - len(toxic) + 7
    assert set(kept["toxicity"]) - set(kept["near_duplicates"]) == {301, 302} and kept["near_duplicates"][7] == 1
    assert set(kept["near_duplicates"]) - set(kept["decontamination"]) == {303}
    texts = lambda k: Counter((r.doc_id, r.text) for r in spark.read.parquet(f"{tmp_path}/{k}").collect())
    assert texts(3) == Counter(sanitised(list(texts(2).elements()))) and "[EMAIL]" in dict(texts(3).keys())[304]
    assert set(kept["pii"]) == set(kept["decontamination"]) == set(kept["packing"])


def test_pipeline_of_nothing(spark, tmp_path):
    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registry():
    assert [int(q[2:].split("_")[0]) for q in queries.QUERIES] == list(range(1, 11)) and set(queries.ORACLE_SQL) <= set(queries.QUERIES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "pii", "packing"]
