"""python -m corpusloom index|query|crawl|search|fetch|delete|stats|reindex|config|health|tools"""

from __future__ import annotations

import argparse
import importlib.util
import json
import shutil
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text
from corpusloom.operators import pages
from corpusloom.plans.engine import PREVIEW, Engine
from corpusloom.sources import config, files, live, web


def emit(df: DataFrame, as_json: bool) -> None:
    """All rows, a partition at a time: JSON with two blanks of indent, or lines of tab-separated values."""
    if as_json:
        for (row,) in df.select(F.to_json(F.struct("*"))).toLocalIterator():
            print(json.dumps(json.loads(row), indent=2, ensure_ascii=False))
    else:
        print("\t".join(df.columns))
        for row in df.toLocalIterator():
            print("\t".join("" if v is None else str(v)[:PREVIEW] for v in row))


def health(s: config.Settings) -> dict:
    return {"data": s.folder, "pdftotext": bool(shutil.which("pdftotext")), "pypdf": bool(importlib.util.find_spec("pypdf")), "embedder": s.embed.kind, "model": s.embed.model, "models": live.models(s.embed) if s.embed.kind == "ollama" else [], "renderer": bool(live.renderer(s.browser.renderer))}


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="corpusloom", description=__doc__)
    p.add_argument("--config")
    p.add_argument("--json", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)
    i = sub.add_parser("index", help="index pages")
    i.add_argument("url", nargs="*")
    i.add_argument("--from-file", help="a list of urls")
    i.add_argument("--pages", help="Parquet with url and body instead of fetching")
    q = sub.add_parser("query")
    q.add_argument("text", nargs="+")
    q.add_argument("-k", type=int, default=8)
    c = sub.add_parser("crawl")
    c.add_argument("seed")
    c.add_argument("--edges", help="Parquet with src and dst")
    c.add_argument("--max", type=int, default=25)
    s = sub.add_parser("search")
    s.add_argument("text", nargs="*", help="a query for the live providers")
    s.add_argument("--stored", help="Parquet with query_id, provider and html")
    f = sub.add_parser("fetch", help="one page as a document")
    f.add_argument("url")
    f.add_argument("--index", action="store_true")
    d = sub.add_parser("delete", help="documents by url")
    d.add_argument("url", nargs="+")
    for name in ("stats", "reindex", "config", "health", "tools"):
        sub.add_parser(name)
    a = p.parse_args(argv)
    settings = config.load(a.config)
    if a.command in ("config", "health"):
        print(json.dumps(asdict(settings) if a.command == "config" else health(settings), indent=2))
        return 0
    spark = SparkSession.builder.appName("corpusloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    engine = Engine(spark, settings, web.embedder(settings.embed))
    if a.command == "index":
        if a.pages:
            found = spark.read.parquet(a.pages)
        else:
            wanted = files.url_list(spark, a.from_file) if a.from_file else spark.createDataFrame([(u,) for u in a.url], "url string")
            found = web.fetch(wanted, settings.http, pages.robots_closed, settings.browser.mode, settings.browser.renderer)
        emit(engine.ingest(found), a.json)
    elif a.command == "query":
        answer = engine.query(" ".join(a.text), a.k)
        level = answer.suspicion.first()
        if level and level.suspicion in ("medium", "high"):
            print(answer.suspicion.select(text.warning(answer.suspicion.suspicion, answer.suspicion.signals)).first()[0])
        rows = answer.hits if a.json else answer.hits.withColumn("text", text.preview(answer.hits.text, PREVIEW))
        emit(rows.orderBy("rank"), a.json)
    elif a.command == "crawl":
        emit(engine.crawl(spark.read.parquet(a.edges), a.seed, a.max) if a.edges else engine.crawl_pages(a.seed, a.max), a.json)
    elif a.command == "search":
        emit(engine.search(spark.read.parquet(a.stored)) if a.stored else engine.ask(" ".join(a.text)), a.json)
    elif a.command == "fetch":
        emit(engine.fetch_page(a.url, a.index), a.json)
    elif a.command == "delete":
        engine.delete(engine.store.read("docs").where(F.col("url").isin(a.url)).select("doc_id"))
    elif a.command == "tools":
        print("\n".join(engine.tools()))
    elif a.command == "stats":
        emit(engine.status(), a.json)
    else:
        engine.reindex()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
