import os
import sqlite3

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import tokens
from corpusloom.operators import chunking, corpus, graph, html, pages, retrieval, serp
from corpusloom.plans import catalog

DATA = "/root/testdata/sf0.001"


def test_chunks_at_headings():
    body = "\n\n".join(f"## Part {i}\n\n" + f"Sentence {i} of the text. " * 20 for i in range(60))
    got = chunking.pieces(body, 1200, 150)
    assert all(len(p["text"]) <= 1200 for p in got) and [p["seq"] for p in got] == list(range(len(got)))
    assert "Part 0" in got[0]["text"] and "Part 59" in got[-1]["text"]
    assert chunking.pieces("short") == [{"seq": 0, "text": "short", "start_char": 0}]
    assert chunking.pieces("") == chunking.pieces(None) == chunking.pieces(" \n ") == []


@given(st.text(alphabet="ab #\né", max_size=300), st.integers(1, 40), st.integers(-1, 50))
@settings(max_examples=300, deadline=None)
def test_chunks_cover(text, size, overlap):
    spans = chunking.spans(text, size, overlap)
    assert not text or (spans[0][0] == 0 and spans[-1][1] == len(text))
    for (a, b), (c, d) in zip(spans, spans[1:]):
        assert a < c <= b <= d
    assert all(b - a <= size for a, b in spans)


PAGE = """<html><head><title> A page </title><style>p{}</style></head><body><nav><a href="https://menu.example/">m</a></nav>
<h1>Head <em>one</em></h1><p>Text with <strong>bold</strong>, <code>code</code> and <a href="https://a.example/x">a link</a>.<br>Next
<p>Second<ul><li>one<li>two<ol><li>in</ol></ul><blockquote><p>said</p></blockquote><pre><code class="language-py">x = 1
y</code></pre><table><tr><th>a|b<th>c<tr><td>1</table><script>if (a < b) "</p>"</script>
<div hidden>never</div><div style="display: none">nor</div><hr><img src="i.png"><a href="javascript:void(0)">js</a><footer>foot</footer></body></html>"""


def test_html_markdown():
    e = html.extracted(PAGE)
    assert e["title"] == "A page" and e["links"] == ["https://a.example/x"]
    md = e["markdown"]
    for part in ("# Head *one*", "Text with **bold**, `code` and [a link](https://a.example/x).  \nNext", "\n\nSecond\n\n- one\n\n- two\n\n    1. in", "> said", "```py\nx = 1\ny\n```", "| a\\|b | c |\n| --- | --- |\n| 1 |  |", "---", "![image](i.png)"):
        assert part in md, part
    for gone in ("menu", "foot", "never", "nor\n", "</p>", "p{}"):
        assert gone not in md
    assert "**" not in e["plain"] and "a\\|b  c\n1  " in e["plain"]


def test_html_prefers_the_article():
    menu = "".join(f'<li><a href="/{i}">Item {i} of menu</a></li>' for i in range(30))
    body = f"<div><ul>{menu}</ul></div><article><h1>T</h1>" + "<p>A sentence, with commas, of the article.</p>" * 10 + "</article>"
    e = html.extracted(body)
    assert e["extraction"] == "readability" and "Item 3" not in e["markdown"] and e["markdown"].startswith("# T")
    assert html.extracted("<p>x</p>")["extraction"] == "fallback" and html.extracted(None)["markdown"] == ""


@pytest.mark.parametrize(
    "body,shut",
    [("User-agent: *\nDisallow: /", True), ("User-agent: bot\nDisallow: /", False), ("User-agent: *\nDisallow: /a", False), ("user-agent: a\nUSER-AGENT: *\nDisallow: /* # x", True), ("User-agent: *\nAllow: /\n\nUser-agent: b\nDisallow: /", False), (None, False), ("", False)],
)
def test_robots(spark, body, shut):
    from corpusloom.operators.pages import robots_closed

    assert spark.createDataFrame([(body,)], "b string").select(pages.robots_blocked(F.col("b"))).first()[0] is shut
    assert robots_closed(body) is shut


@pytest.mark.parametrize("kind,body,want", [("", "%PDF-1", "pdf"), ("text/html", "x", "html"), ("", "<!DOCTYPE HTML>", "html"), ("text/markdown", "x", "markdown"), ("application/json", "{}", "text"), (None, "words", "text"), ("application/octet-stream", "a\0b", "binary")])
def test_document_type(spark, kind, body, want):
    assert spark.createDataFrame([(kind, body)], "k string, b string").select(pages.document_type(F.col("k"), F.col("b"))).first()[0] == want


SERP = {
    "ddg-html": '<div class="result"><a class="result__a" href="/l/?uddg=https%3A%2F%2Fa.example%2F">One</a><a class="result__snippet">One is first</a></div><div class="result"><p>no link</p></div>',
    "ddg-lite": '<a class="result-link" href="https://a.example/">One</a>',
    "mojeek": '<ul class="results-list"><li><a class="ob" href="https://a.example/">One</a><p class="s">is first</p></li><li><a href="https://b.example/">Two</a></li></ul>',
    "bing-browser": '<li class="b_algo"><h2><a href="https://a.example/">One</a></h2><div class="b_caption"><p>is first</p></div></li><li class="b_algo"><h2><a href="http://bing.com/x">Ad</a></h2></li>',
}


def test_result_pages(spark):
    rows = [(1, p, h) for p, h in SERP.items()] + [(1, "mojeek", "<html>verify you are human</html>"), (1, "other", "x"), (1, "mojeek", None)]
    got = serp.parsed_results(spark.createDataFrame(rows, "query_id long, provider string, html string")).collect()
    assert [(r.provider, r.rank, r.title, r.url, r.snippet) for r in got] == [
        ("ddg-html", 1, "One", "https://a.example/", "is first"), ("ddg-lite", 1, "One", "https://a.example/", ""),
        ("mojeek", 1, "One", "https://a.example/", "is first"), ("mojeek", 2, "Two", "https://b.example/", ""), ("bing-browser", 1, "One", "https://a.example/", "is first"),
    ]
    js = '{"results":[{"title":"T","url":"https://a.example","content":"c"},{"title":"n","url":""}]}'
    assert [r.url for r in serp.parsed_json(spark.createDataFrame([(js,), ('{"error":"x"}',), ("no",)], "body string")).collect()] == ["https://a.example"]


def test_bm25_matches_fts5(spark):
    texts = ["the crawler fetched pages", "crawlers normalize page links and pages", "rankers rank", "a page about nothing at all", "généralités sur les pages"]
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table t using fts5(x, tokenize='porter unicode61')")
    con.executemany("insert into t(rowid, x) values (?, ?)", list(enumerate(texts)))
    want = {i: -r for i, r in con.execute("select rowid, rank from t where t match '\"crawlers\" OR \"page\" OR \"page\" OR \"generalites\"'")}
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string")
    w = tokens.stemmed(F.col("text"))
    q = [s for x in ("crawlers", "page", "page", "généralités") for s in tokens.stems(x)]
    got = {r.chunk_id: r.bm25 for r in retrieval.bm25(retrieval.postings(chunks, w), retrieval.corpus_size(chunks, w), q).collect()}
    assert got == pytest.approx(want, rel=1e-9)
    scan = retrieval.scanned(chunks.unionByName(chunks), w, q)
    assert {r.chunk_id: r.bm25 for r in retrieval.scanned_top(scan, q).collect()} == pytest.approx(want, rel=1e-9)


def test_cosine_edges(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, []), (3, None), (4, [1.0]), (5, [-1.0, 0.0]), (6, [2.0, 2.0])]
    v = spark.createDataFrame(rows, "chunk_id long, vec array<float>")
    assert [(r.chunk_id, round(r.cosine, 6)) for r in retrieval.vector_top(v, [1.0, 0.0], 0).collect()] == [(0, 1.0), (6, 0.707107)]


def test_fusion(spark):
    kw = spark.createDataFrame([(1, 5.0), (2, 4.0)], "chunk_id long, bm25 double")
    vec = spark.createDataFrame([(2, 0.9), (3, 0.8)], "chunk_id long, cosine double")
    got = [(r.chunk_id, r.matched_by, r["rank"]) for r in retrieval.fused(kw, vec, 0).orderBy("rank").collect()]
    assert got == [(2, "both", 1), (1, "keyword", 2), (3, "vector", 3)]


def test_crawl_is_a_queue(spark):
    import random

    rng = random.Random(2)
    name = lambda i: f"https://h{i % 3}.site.example/{i:03d}"
    links = sorted({(name(rng.randrange(60)), name(rng.randrange(80)) + ("#f" if rng.random() < 0.2 else "")) for _ in range(220)}) + [(name(0), "https://far.other/")]
    bad = {name(i) for i in range(5, 80, 9)}
    out = {}
    for a, b in links:
        out.setdefault(a, set()).add(b.split("#")[0])
    queue, seen, met = [name(0)], set(), []
    while queue and len(met) < 20:
        u = queue.pop(0)
        if u in seen:
            continue
        seen.add(u)
        if u in bad:
            continue
        met.append(u)
        queue += [x for x in sorted(out.get(u, ())) if x not in seen and ".site.example/" in x]
    got = graph.crawl(spark.createDataFrame(links, "src string, dst string"), name(0), 20, failed=spark.createDataFrame([(b,) for b in bad], "url string"))
    assert [r.url for r in got.orderBy("n").collect()] == met


def test_vector_codec(spark):
    v = spark.createDataFrame([([1.5, -2.0],), (None,)], "v array<float>")
    back = v.select(corpus.decoded_vector(corpus.encoded_vector("v")).alias("v")).collect()
    assert [r.v for r in back] == [[1.5, -2.0], None]


@pytest.mark.skipif(not os.path.exists(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    got = catalog.queries()[name](spark, DATA).toPandas()
    want = con.execute(catalog.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    plain = lambda df: sorted(str(["" if v is None or v != v else round(v, 6) if isinstance(v, float) else str(v) for v in r]) for r in df[sorted(df.columns)].itertuples(index=False))
    assert plain(got) == plain(want)
