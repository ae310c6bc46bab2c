"""Live sources, for runs with a network: guarded HTTP pages and embedding servers. They run on the executors, one host a partition."""

from __future__ import annotations

import json
import socket
import time
import urllib.error
import urllib.parse
import urllib.request
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import urls
from corpusloom.functions.urls import is_private_address
from corpusloom.operators.pages import CHALLENGE_MARKERS, CHALLENGE_STATUS
from corpusloom.sources.config import Embed, Http

PAGE = "url string, final_url string, status int, content_type string, etag string, body string, content binary, error string, fetched_at timestamp"


class Blocked(Exception):
    pass


def checked(url: str, http: Http) -> str:
    """The url if it may be fetched: http(s), a host, no user info, no private address behind the name."""
    u = urllib.parse.urlsplit(url)
    if u.scheme not in ("http", "https") or not u.hostname or "@" in u.netloc:
        raise Blocked("url not admissible")
    if not http.allow_private:
        for info in socket.getaddrinfo(u.hostname, u.port or 80):
            if is_private_address(info[4][0]) is not False:
                raise Blocked("private address")
    return url


class _Redirects(urllib.request.HTTPRedirectHandler):
    def __init__(self, http: Http):
        self.http = http
        self.max_redirections = http.redirects

    def redirect_request(self, req, fp, code, msg, headers, newurl):
        return super().redirect_request(req, fp, code, msg, headers, checked(newurl, self.http))


def opened(url: str, http: Http, timeout: float):
    opener = urllib.request.build_opener(_Redirects(http))
    return opener.open(urllib.request.Request(checked(url, http), headers={"User-Agent": http.user_agent, "Accept-Encoding": "gzip"}), timeout=timeout)


def inflated(raw: bytes, most: int) -> bytes:
    """The content of a gzip body, no more than a byte above the cap."""
    return zlib.decompressobj(31).decompress(raw, most + 1)


def get_json(url: str, timeout: float, most: int) -> dict:
    with urllib.request.urlopen(urllib.request.Request(url, headers={"Accept": "application/json"}), timeout=timeout) as r:
        raw = r.read(most + 1)
    if len(raw) > most:
        raise ValueError(f"answer exceeds {most} bytes")
    return json.loads(raw)


def fetched(url: str, http: Http) -> dict:
    """One page. Errors, statuses from 400, bodies above the cap and bot walls are named in error; the body stays empty."""
    out = dict.fromkeys(("final_url", "status", "content_type", "etag", "error")) | {"url": url, "body": None, "content": None, "fetched_at": pd.Timestamp.now("UTC").tz_localize(None)}
    try:
        try:
            r = opened(url, http, http.timeout)
        except urllib.error.HTTPError as e:
            r = e
        with r:
            raw = r.read(http.max_bytes + 1)
            if r.headers.get("Content-Encoding", "").lower() == "gzip":
                raw = inflated(raw, http.max_bytes)
            out |= {"final_url": r.geturl(), "status": r.status, "content_type": r.headers.get("Content-Type"), "etag": r.headers.get("ETag")}
        pdf = raw.startswith(b"%PDF-")
        text = "" if pdf else raw.decode("utf-8", "replace")
        if len(raw) > http.max_bytes:
            out["error"] = f"body exceeds {http.max_bytes} bytes"
        elif out["status"] in CHALLENGE_STATUS or any(m in text.lower() for m in CHALLENGE_MARKERS):
            out["error"] = "bot challenge"
        elif out["status"] >= 400:
            out["error"] = f"http {out['status']}"
        elif pdf:
            out["content"] = raw  # bytes, for a reader of PDF
        else:
            out["body"] = text
    except Exception as e:
        out["error"] = str(e) or type(e).__name__
    return out


def robots_body(host_url: str, http: Http) -> str | None:
    """robots.txt of a host up to 64 KiB; any failure allows everything."""
    try:
        with opened(urllib.parse.urljoin(host_url, "/robots.txt"), http, 8) as r:
            return r.read(64 << 10).decode("utf-8", "replace") if r.status == 200 else None
    except Exception:
        return None


_ROBOTS: dict[tuple[str, bool], tuple[float, bool]] = {}
_ROBOTS_S = 3600


def closed_by_robots(url: str, http: Http, disallowed: Callable[[str | None], bool]) -> bool:
    """Whether robots.txt closes the host, asked once an hour in each worker; trusted hosts are open."""
    u = urllib.parse.urlsplit(url)
    host = (u.hostname or "").rstrip(".")
    if not http.respect_robots or any(host == t or host.endswith("." + t) for t in http.trusted):
        return False
    at = (f"{u.scheme}://{u.netloc.lower()}", http.allow_private)
    known = _ROBOTS.get(at)
    if known is None or known[0] < time.monotonic():
        known = _ROBOTS[at] = (time.monotonic() + _ROBOTS_S, disallowed(robots_body(url, http)))
    return known[1]


def fetch(addresses: DataFrame, http: Http = Http(), disallowed: Callable[[str | None], bool] = lambda body: False, mode: str = "", renderer: str = "") -> DataFrame:
    """A row a url. Requests of one host run in one partition, spaced by the rate; a host that robots close is an error row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        free: dict[str, float] = {}
        from corpusloom.sources import live

        draw = live.renderer(renderer) if renderer else None
        for b in batches:
            rows = []
            for u in b["url"]:
                host = urllib.parse.urlsplit(u).netloc.lower()
                if closed_by_robots(u, http, disallowed):
                    rows.append(fetched("", http) | {"url": u, "error": "disallowed by robots.txt"})
                    continue
                wait = free.get(host, 0) - time.monotonic()
                time.sleep(max(0.0, wait))
                free[host] = time.monotonic() + (1 / http.per_second if http.per_second > 0 else 0)
                rows.append(live.page(u, http, mode, draw))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in PAGE.split(", ")])

    return addresses.select("url").distinct().repartition(urls.host(F.col("url"))).mapInPandas(run, PAGE)


def _post(url: str, body: dict, key: str, timeout: float) -> dict:
    head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
    with urllib.request.urlopen(urllib.request.Request(url, json.dumps(body).encode(), head), timeout=timeout) as r:
        return json.load(r)


def embedded(texts: list[str], e: Embed) -> list[list[float]]:
    """Vectors of the texts, in their order, asked for in batches; a missing vector is an error."""
    out: list[list[float]] = []
    for i in range(0, len(texts), e.batch):
        part = texts[i : i + e.batch]
        if e.kind == "ollama":
            got = _post(f"{e.url}/api/embed", {"model": e.model, "input": part}, e.key, e.timeout)["embeddings"]
        else:
            rows = _post(f"{e.url}/embeddings", {"model": e.model, "input": part}, e.key, e.timeout)["data"]
            by = {r["index"]: r["embedding"] for r in rows}
            got = [by[n] for n in range(len(part))]
        if len(got) != len(part):
            raise ValueError(f"{len(got)} vectors for {len(part)} texts")
        out += got
    return out


def embedder(e: Embed):
    """A column function text -> array<float>, or None where no embedder is set."""
    if e.kind == "none":
        return None

    @F.pandas_udf("array<float>")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(embedded(s.tolist(), e))

    return run
