"""Operators on pages and vectors, the registered queries and the pipeline."""

import hashlib
import re

import numpy as np
import pytest

from tracklake.llm import archive, extraction, neighbours, queries
from tests.conftest import SF

ARTICLE = "<h1>Title &amp; more</h1><p>First paragraph,  with\n <b>bold</b> text and <a href='/x'>a link</a>.</p><p>Second: short.<br>After break, with more words to read.</p>"
WANT = "Title & more\nFirst paragraph, with bold text and a link.\nSecond: short. After break, with more words to read."
LINKS = "<ul>" + "".join(f"<li><a href='/{i}'>Item {i}</a></li>" for i in range(8)) + "</ul>"


@pytest.mark.parametrize(
    "page",
    [
        f"<html><head><title>x</title><style>p{{}}</style></head><body><nav>{LINKS}</nav><article>{ARTICLE}</article><footer>(c) us, all rights.</footer></body></html>",
        f"<body><header><a href='/'>Site</a> Our slogan, here.</header><main>{ARTICLE}</main><aside><p>Read this too, please. It is nice.</p></aside></body>",
        f"<body><div class='menu'>{LINKS}</div><div id='content'>{ARTICLE}</div><div class='sidebar'><p>Other things, which are here.</p></div></body>",
        f"<body><div class='cookie-banner'><p>We use cookies, as you know. Agree?</p></div><div><div class='post'>{ARTICLE}</div></div><div id='comments'><p>Nice, really. I liked it.</p></div></body>",
        f"<body><article>{ARTICLE}<script>var t='</p>';</script><form><p>Your mail, please.</p><input></form><div class='ad'>Buy, now!</div></article><section class='comments'><article class='comment'><p>So, what?</p></article></section></body>",
        f"<body><article><!-- c <p> -->{ARTICLE}<div class='share'>Share, like.</div></article><div hidden>Unseen, text.</div>",
    ],
)
def test_extract_article(page):
    assert extraction.extract(page) == WANT


def test_extract_edges(spark):
    assert [extraction.extract(x) for x in (None, "", " ", "<p>", "<script>x", "<!-- x", "<nav>a</nav>")] == [""] * 7
    assert extraction.extract("just text &lt;here&gt; &#233;&nbsp;x") == "just text <here> é x"
    assert extraction.extract("<article><p>One, two.<p>Three, four.<p cla") == "One, two.\nThree, four."
    long = "<article>" + "".join(f"<p>Paragraph {i}, with words.</p>" for i in range(20_000)) + "</article>"
    assert extraction.extract(long).count("\n") == 19_999
    assert extraction.extract("<article><h1>Hi</h1><p>So.</p></article><div><p>" + "Other text, much longer, that is not the article. " * 9 + "</p></div>") == "Hi\nSo."
    deep = "<div>" * 3000 + "<p>Down here, at last.</p>"
    assert extraction.extract(deep) == "Down here, at last."
    rows = [(1, "u", f"<article>{ARTICLE}</article>", 5), (1, "u", f"<article>{ARTICLE}</article>", 6), (None, None, None, 7)]
    got = extraction.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, "u", WANT, len(WANT))] * 2 + [(None, None, "", 0)], key=str)
    assert extraction.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_extract_whole_table_like_the_markup(spark):
    """The pages of the test table have one article each, whose markup can be read directly."""
    import html

    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    got = {r["page_id"]: r["text"] for r in queries.QUERIES["op4_extraction"](spark, SF).collect()}
    for r in pages:
        body = re.sub(r"<[^>]*$", "", re.search(r"<article>(.*?)(</article>|\Z)", r["html"], re.S)[1]).replace("<br>", " ")
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in re.split(r"</?(?:p|h1|li|ul)[^>]*>", body)]
        assert got[r["page_id"]] == "\n".join(b for b in blocks if b)


def test_archive_round_trip(spark):
    big, other = "<p>" + "é" * 700 + "</p>", "x" * 1000
    rows = [(i, f"http://a/{i}", big) for i in range(5)] + [(10, "u", other), (11, "u\r\nx", "small"), (12, None, "small"), (13, "", None), (14, "", ""), (9, "z", other), (9, "z", other), (None, "n", other)]
    pages = spark.createDataFrame([(*r, 1, 2) for r in rows], "page_id long, url string, html string, header int, address int").repartition(4)
    folder = archive.write(pages)
    assert spark.read.parquet(f"{folder}/payloads").count() == 4
    records = archive.read(spark, folder)
    got = sorted(map(tuple, archive.listing(records).collect()), key=str)
    want = []
    for page_id, _, page in rows:
        raw = (page or "").encode()
        last = max(p for p, _, h in rows if (h or "") == (page or "") and p is not None)
        revisit = len(raw) >= 1000 and page_id != last
        want.append((page_id, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", last if revisit else None))
    assert got == sorted(want, key=str)
    for r in archive.restore(records).collect():
        head, block = bytes(r["record"]).split(b"\r\n\r\n", 1)
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        page = next((h or "").encode() for p, _, h in rows if p == r["page_id"])
        own = b"" if fields["WARC-Type"] == "revisit" else page
        assert head.startswith(b"WARC/1.1\r\n") and block == own + b"\r\n\r\n" and int(fields["Content-Length"]) == len(own)
        assert fields["WARC-Payload-Digest"] == "sha1:" + hashlib.sha1(page).hexdigest()
    assert archive.listing(archive.read(spark, archive.write(pages.limit(0)))).count() == 0


def test_archive_detects_damage(spark):
    from pyspark.sql import functions as F

    folder = archive.write(spark.createDataFrame([(1, "u", "text")], "page_id long, url string, html string"))
    stored = spark.read.parquet(f"{folder}/payloads").withColumn("payload", F.lit(b"other")).collect()
    spark.createDataFrame(stored, "address string, payload binary").write.mode("overwrite").parquet(f"{folder}/payloads")
    with pytest.raises(Exception, match="damaged payload"):
        archive.read(spark, folder).collect()


def brute_nearest(data, step, k):
    usable = [(i, np.array(v, dtype=float)) for i, v in data if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    out = set()
    for q, a in usable:
        if q % step == 0:
            scores = {(-float(sum(x * y for x, y in zip(a, b))), i) for i, b in usable if i != q and len(b) == len(a)}
            out |= {(q, r, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k], 1)}
    return out


@pytest.mark.parametrize("shard_rows,block_queries", [(10_000, 10_000), (37, 5)])
def test_neighbours_exact(spark, shard_rows, block_queries):
    rng = np.random.default_rng(0)
    data = [(i, rng.integers(-3, 4, 6).astype(float).tolist()) for i in range(400)]
    data += [(1000 + i, [1.0, 2.0, 0.0, 1.0, 0.0, 0.0]) for i in range(60)]
    data += [(2000, None), (2001, []), (2002, [0.0] * 6), (2003, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2004, [float("nan")] + [1.0] * 5), (2005, [float("inf")] + [1.0] * 5)]
    data += [(2020, [1.0, 1.0]), (2021, [2.0, 1.0]), (40, data[40][1]), (None, [1.0] * 6), (2040, [5.0] * 3)]
    df = spark.createDataFrame([(i, v, 0, 0) for i, v in data], "vec_id long, embedding array<double>, score int, rank int").repartition(3)
    got = neighbours.nearest(df, neighbours.every(20), k=7, factor=1.0, shard_rows=shard_rows, block_queries=block_queries)
    assert got.count() == len(brute_nearest(data, 20, 7))
    assert {tuple(r) for r in got.collect()} == brute_nearest(data, 20, 7)
    assert neighbours.nearest(df.limit(0), neighbours.every()).count() == 0


def test_neighbours_recall(spark):
    data = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want = {(q, i) for q, _, i, _ in brute_nearest(data, 20, 20)}
    got = {(r["query_id"], r["vec_id"]) for r in queries.QUERIES["op10_neighbours"](spark, SF).collect()}
    assert len(want & got) >= 0.9 * len(want)


def test_tree_skips_on_clustered_vectors():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 0.02, (400, 8)) for c in rng.normal(0, 1, (12, 8))])
    x /= np.linalg.norm(x, axis=1)[:, None]
    work, recall = {}, {}
    for factor in (1.0, neighbours.FACTOR, 3.0):
        who, row, work[factor] = neighbours.search(x, x[:100], 10, factor)
        found = [len(set(np.argsort(-(x @ x[q]))[:10].tolist()) & set(row[who == q].tolist())) for q in range(100)]
        recall[factor] = sum(found) / 1000
    assert work[3.0] < work[neighbours.FACTOR] < work[1.0] < 0.6 * 100 * len(x)
    assert recall[1.0] == 1.0 and recall[neighbours.FACTOR] >= 0.95


def test_every_operator_is_registered():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 11))


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in p.STAGES[:-1]:
        docs = p.materialize(stage(spark, docs, SF))
        assert docs.columns == columns, name
        counts.append(docs.count())
    assert counts[0] >= counts[1] > counts[2] > 0.8 * counts[0] and counts[3] <= counts[2]
    packed = p.packed(spark, docs, SF)
    assert packed.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert {r[0] for r in packed.select("doc_id").distinct().collect()} == {r[0] for r in docs.select("doc_id").distinct().collect()}
