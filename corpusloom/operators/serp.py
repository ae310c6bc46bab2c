"""Stored result pages: parsers, the provider chain, and the search pipeline."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import risk, text, urls
from corpusloom.operators.html import Node, parsed

_KIND = "array<struct<title:string,url:string,snippet:string>>"


def _has(n: Node, *classes: str) -> bool:
    return any(c in n.attrs.get("class", "").split() for c in classes)


def _all(root: Node, tag: str | None, *classes: str) -> list[Node]:
    return [n for n in root.walk() if (tag is None or n.tag == tag) and (not classes or _has(n, *classes)) and n.tag != "#root"]


def _row(link: Node | None, href: str, snippet: str) -> dict | None:
    name = link.text().strip() if link else ""
    return {"title": name, "url": href, "snippet": snippet} if href and name else None


def _first(nodes: list[Node]) -> Node | None:
    return nodes[0] if nodes else None


def _text(n: Node | None) -> str:
    return n.text().strip() if n else ""


def _unwrapped(href: str) -> str:
    from urllib.parse import parse_qs, urlsplit

    try:
        return (parse_qs(urlsplit(href).query).get("uddg") or [""])[0] or href
    except ValueError:
        return href


def scoped_results(html: str) -> list[dict]:
    """Results in their own boxes, links wrapped in a redirect; a page without any is read as the light layout."""
    out = []
    for box in (n for tag in ("div", "li") for n in _all(parsed(html), tag, "result")):
        link = _first(_all(box, "a", "result__a"))
        snippet = _text(_first(_all(box, None, "result__snippet")))
        name = _text(link)
        if name and snippet.startswith(name):
            snippet = snippet[len(name) :].strip()
        out.append(_row(link, _unwrapped(link.attrs.get("href", "")) if link else "", snippet))
    return [r for r in out if r] or light_results(html)


def light_results(html: str) -> list[dict]:
    found = (_row(a, _unwrapped(a.attrs.get("href", "")), "") for a in _all(parsed(html), "a", "result-link"))
    return [r for r in found if r]


def listed_results(html: str) -> list[dict]:
    out = []
    for box in _all(parsed(html), "ul", "results-list"):
        for item in _all(box, "li"):
            link = _first(_all(item, "a", "ob")) or _first([a for a in _all(item, "a") if "href" in a.attrs])
            out.append(_row(link, link.attrs.get("href", "") if link else "", _text(_first(_all(item, "p", "s")))))
    return [r for r in out if r]


def headed_results(html: str) -> list[dict]:
    out = []
    for item in _all(parsed(html), "li", "b_algo"):
        link = _first([a for h in _all(item, "h2") for a in _all(h, "a")])
        href = link.attrs.get("href", "") if link else ""
        if not href.startswith("http://bing.com"):
            out.append(_row(link, href, _text(_first(_all(item, "p")))))
    return [r for r in out if r]


PARSERS = {"ddg-html": scoped_results, "ddg-lite": light_results, "mojeek": listed_results, "bing-browser": headed_results}


def parsed_results(pages: DataFrame, provider: str = "provider", html: str = "html") -> DataFrame:
    """A row a result: the page's other columns, rank on the page, title, url and snippet. Unknown providers have none."""

    @F.pandas_udf(_KIND)
    def read(p: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series([PARSERS[a](b) if a in PARSERS and b else [] for a, b in zip(p, h)])

    rest = [c for c in pages.columns if c != html]
    rows = pages.select(*rest, F.posexplode(read(F.col(provider), F.col(html))).alias("_n", "_r"))
    return rows.select(*rest, (F.col("_n") + 1).alias("rank"), "_r.title", "_r.url", "_r.snippet")


def parsed_json(responses: DataFrame, body: str = "body", limit: int = 10) -> DataFrame:
    """Results of a JSON metasearch response; responses with an error, and results without url, give none."""
    kind = "struct<results:array<struct<title:string,url:string,content:string>>,error:string>"
    rest = [c for c in responses.columns if c != body]
    r = responses.select(*rest, F.from_json(body, kind).alias("_j")).where("_j IS NOT NULL AND coalesce(_j.error, '') = ''")
    good = F.slice(F.filter("_j.results", lambda x: F.coalesce(x["url"], F.lit("")) != ""), 1, max(1, limit))
    rows = r.select(*rest, F.posexplode(good).alias("_n", "_r"))
    return rows.select(*rest, (F.col("_n") + 1).alias("rank"), "_r.title", "_r.url", F.col("_r.content").alias("snippet"))


def first_provider(results: DataFrame, chain: list[str], by: list[str], provider: str = "provider") -> DataFrame:
    """The results of the first provider of the chain that has any, for each query."""
    place = F.coalesce(*(F.when(F.col(provider) == p, i) for i, p in enumerate(chain)))
    rows = results.withColumn("_place", place).where("_place IS NOT NULL")
    best = rows.groupBy(*by).agg(F.min("_place").alias("_best"))
    return rows.join(best, by).where("_place = _best").drop("_place", "_best")


def search(results: DataFrame, chain: list[str], by: list[str], order: list[str], limit: int = 10) -> DataFrame:
    """Chosen, deduplicated and numbered results with cleaned, defanged texts and their risk.

    A result's risk is taken over title and snippet together, so a signal that spans both counts."""
    rows = urls.deduplicated(first_provider(results, chain, by), by, order, limit=limit)
    rows = rows.withColumn("title", text.one_line(text.clean_unicode(F.coalesce("title", F.lit(""))))).withColumn("snippet", text.one_line(text.clean_unicode(F.coalesce("snippet", F.lit("")))))
    rows = risk.assessed(rows.withColumn("_all", F.concat_ws(" ", "title", "snippet")), "_all").drop("_all")
    return rows.withColumn("title", text.defang(F.col("title"))).withColumn("snippet", text.defang(F.col("snippet")))


def numbered(results: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    return results.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
