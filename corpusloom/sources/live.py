"""Live search and rendering: providers by URL template, JSON metasearch, and a pluggable renderer for challenged pages."""

from __future__ import annotations

import importlib
import json
import urllib.error
import urllib.parse
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from corpusloom.operators.pages import CHALLENGE_MARKERS
from corpusloom.operators.serp import PARSERS
from corpusloom.sources.config import Embed, Http, Search
from corpusloom.sources.web import fetched, get_json

# Result pages of the providers; those of browser providers need a renderer.
TEMPLATES = {
    "ddg-html": "https://html.duckduckgo.com/html/?q={}",
    "ddg-lite": "https://lite.duckduckgo.com/lite/?q={}",
    "mojeek": "https://www.mojeek.com/search?q={}",
    "ddg-browser": "https://html.duckduckgo.com/html/?q={}",
    "bing-browser": "https://www.bing.com/search?q={}",
}
JSON_CAP = 4 << 20
RESULT = "query_id long, provider string, rank int, title string, url string, snippet string, error string"
Renderer = Callable[[str], str]


def escaped(query: str) -> str:
    """The query as a URL parameter, blanks as +."""
    return urllib.parse.quote_plus(query)


def renderer(name: str) -> Renderer | None:
    """The function (url) -> html that `module:function` names; None where it can't be imported. It blocks what it likes and keeps its own profile."""
    try:
        module, _, function = name.partition(":")
        return getattr(importlib.import_module(module), function) if function else None
    except (ImportError, AttributeError):
        return None


def challenged(html: str | None) -> bool:
    return any(m in (html or "").lower() for m in CHALLENGE_MARKERS)


def rendered(url: str, http: Http, render: Renderer | None) -> dict:
    """The page as a browser draws it, looked at for a challenge once more."""
    out = dict.fromkeys(("final_url", "status", "content_type", "etag", "body", "content")) | {"url": url, "fetched_at": pd.Timestamp.now("UTC").tz_localize(None), "error": "no renderer"}
    if render:
        try:
            html = render(url)
            out |= {"error": "bot challenge"} if challenged(html) else {"final_url": url, "content_type": "text/html", "body": html, "error": None}
        except Exception as e:
            out["error"] = str(e) or type(e).__name__
    return out


def page(url: str, http: Http, mode: str = "", render: Renderer | None = None) -> dict:
    """Plain HTTP first and the renderer where that meets a challenge; mode force renders at once."""
    if mode == "force":
        return rendered(url, http, render)
    got = fetched(url, http)
    return rendered(url, http, render) if got["error"] == "bot challenge" and render else got


def metasearch(base: str, query: str, limit: int, timeout: float = 10) -> list[dict]:
    """Results of a JSON endpoint: at most JSON_CAP bytes are read; refusals and its own errors are errors; results without url are skipped."""
    url = f"{base.rstrip('/')}/search?q={escaped(query)}&format=json"
    try:
        got = get_json(url, timeout, JSON_CAP)
    except urllib.error.HTTPError as e:
        if e.code in (403, 429):
            raise ValueError(f"http {e.code}: the endpoint refuses JSON or limits its rate") from e
        raise
    if got.get("error"):
        raise ValueError(str(got["error"]))
    rows = [r for r in got.get("results") or [] if r.get("url")]
    return [{"title": r.get("title") or "", "url": r["url"], "snippet": r.get("content") or ""} for r in rows[:limit]]


def chain(s: Search) -> list[str]:
    """Names of the providers in order, one for each metasearch address."""
    out: list[str] = []
    for name in s.providers:
        out += [f"searxng:{urllib.parse.urlsplit(u).hostname}" for u in s.searx_urls] if name == "searxng" else [name]
    return out


def ask(query: str, s: Search, http: Http, render: Renderer | None = None) -> tuple[str, list[dict], str | None]:
    """(provider, results, errors): the first provider of the chain that has any."""
    errors = []
    bases = {f"searxng:{urllib.parse.urlsplit(u).hostname}": u for u in s.searx_urls}
    for name in chain(s):
        try:
            if name in bases:
                found = metasearch(bases[name], query, s.max_results)
            elif name in TEMPLATES:
                got = page(TEMPLATES[name].format(escaped(query)), http, "force" if name.endswith("-browser") else "", render)
                if got["error"]:
                    raise ValueError(got["error"])
                found = PARSERS["ddg-html" if name == "ddg-browser" else name](got["body"])
            else:
                raise ValueError("unknown provider")
            if found:
                return name, found, None
            errors.append(f"{name}: no results")
        except Exception as e:
            errors.append(f"{name}: {e}")
    return "", [], "; ".join(errors)


def search(queries: DataFrame, s: Search, http: Http = Http(), render: str = "") -> DataFrame:
    """Rows (query_id, query_text) to their results; a query whose providers all fail is one row with an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        draw = renderer(render) if render else None
        for b in batches:
            rows = []
            for i, q in zip(b["query_id"], b["query_text"]):
                name, found, error = ask(q, s, http, draw)
                rows += [(i, name, n, r["title"], r["url"], r["snippet"], None) for n, r in enumerate(found, 1)] or [(i, None, None, None, None, None, error)]
            frame = pd.DataFrame(rows, columns=[c.split()[0] for c in RESULT.split(", ")])
            yield frame.astype({"rank": "Int32"})

    return queries.select("query_id", "query_text").mapInPandas(run, RESULT)


def models(e: Embed) -> list[str]:
    """Names of the models that a local embedding server has; none where it doesn't answer."""
    try:
        return [m["name"] for m in get_json(f"{e.url.rstrip('/')}/api/tags", 5, JSON_CAP).get("models") or []]
    except (OSError, ValueError, json.JSONDecodeError):
        return []


