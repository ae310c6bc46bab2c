"""The engine: ingest, query, crawl, search and status over one store."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import risk, text, tokens, urls
from corpusloom.operators import chunking, corpus, graph, html, pages, retrieval, serp
from corpusloom.plans.shared import materialize
from corpusloom.sources import files, live, web
from corpusloom.sources.config import Settings

PREVIEW = 600


@dataclass(frozen=True)
class Answer:
    hits: DataFrame
    mode: str
    suspicion: DataFrame


class Engine:
    def __init__(self, spark: SparkSession, settings: Settings = Settings(), embed=None):
        """embed: a column function from text to array<float>, with the model's name in settings.embed.model."""
        self.spark, self.settings, self.embed = spark, settings, embed
        self.store = corpus.Store(spark, settings.folder)

    def extract(self, fetched: DataFrame) -> DataFrame:
        """Pages (url, body, and if known final_url, content_type, etag, fetched_at) as documents with text, hash and risk.

        Oversized, challenged and binary pages have status rejected and a reason; the rest extracted."""
        given = lambda c, kind: F.col(c).cast(kind) if c in fetched.columns else F.lit(None).cast(kind)
        raw = given("content", "binary")
        is_pdf = F.substring(raw, 1, 5) == F.encode(F.lit("%PDF-"), "utf-8")
        fetched = fetched.withColumn("_pdf", F.when(is_pdf, files.pdf(F.when(is_pdf, raw)))).withColumn("_raw", raw)
        fetched = fetched.withColumn("body", F.when(F.col("_pdf").isNotNull(), F.col("_pdf.text")).otherwise(F.col("body")))
        kind = F.when(F.col("_pdf").isNotNull(), "pdf").otherwise(pages.document_type(given("content_type", "string"), F.col("body")))
        why = (
            F.when(F.col("body").isNull(), "no body")
            .when(~urls.admissible(F.col("url")), "url not admissible")
            .when(~pages.within_cap(F.col("body"), self.settings.http.max_bytes), "body above the cap")
            .when(pages.challenge_body(F.col("body")), "bot challenge")
            .when(kind == "binary", "unsupported type")
            .when((kind == "pdf") & F.col("_pdf").isNull(), "PDF without its bytes")
            .when((kind == "pdf") & (F.trim("body") == ""), F.concat(F.lit("no text in PDF: "), F.col("_pdf.warning")))
        )
        rows = fetched.select("url", F.coalesce(given("final_url", "string"), F.col("url")).alias("final_url"), "body", kind.alias("doc_type"), given("etag", "string").alias("etag"), F.coalesce(given("fetched_at", "timestamp"), F.current_timestamp()).alias("fetched_at"), why.alias("reason"), F.nullif(F.col("_pdf.warning"), F.lit("")).alias("warned"), F.sha2(F.coalesce(F.col("_raw"), F.col("body").cast("binary")), 256).alias("sha256"))
        page = F.when(F.col("reason").isNull() & (F.col("doc_type") == "html"), F.col("body"))
        e = rows.withColumn("_e", html.extract(page))
        ok, is_html = F.col("reason").isNull(), F.col("doc_type") == "html"
        out = e.withColumn("text", text.clean_unicode(F.when(ok, F.when(is_html, F.col("_e.markdown")).otherwise(F.col("body")))))
        out = risk.assessed(out)
        return out.select(
            "url", "final_url", "doc_type", "sha256", "etag",
            F.when(is_html, text.one_line(F.col("_e.title"))).otherwise(F.lit("")).alias("title"),
            F.when(~ok, F.lit(None)).when(is_html, F.col("_e.extraction")).otherwise("passthrough").alias("extraction"),
            F.col("warned").alias("extract_warning"), "signals", F.col("_e.links").alias("links"), "fetched_at", F.col("fetched_at").alias("updated_at"),
            "text", "suspicion", F.when(ok, "extracted").otherwise("rejected").alias("status"), "reason",
        )

    def ingest(self, fetched: DataFrame) -> DataFrame:
        """Index a batch of pages; (url, doc_id, status, reason, chunks) for each, status new, unchanged, changed or rejected.

        Only new and changed documents are chunked and embedded. All tables appear at once as a new version."""
        self._same_model()
        staged = materialize(self.extract(fetched), "staged")
        docs, chunks, vectors, index = (self.store.read(t) for t in ("docs", "chunks", "vectors", "postings"))
        classes = materialize(corpus.classified(staged.where("status = 'extracted'").drop("status", "reason", "suspicion"), docs), "classes")
        fresh = classes.where("status <> 'unchanged'")
        new = chunking.chunked(fresh.select("doc_id", "text"), size=self.settings.index.size, overlap=self.settings.index.overlap)
        new = materialize(new.withColumn("chunk_id", F.xxhash64("doc_id", "seq")).select("doc_id", "seq", "chunk_id", "text", "start_char"), "chunks")
        dead = chunks.join(fresh.select("doc_id"), "doc_id", "left_semi").select("chunk_id")
        tables = {
            "docs": corpus.upserted(classes, docs),
            "chunks": corpus.without(chunks, fresh, "doc_id").unionByName(new),
            "postings": corpus.without(index, dead, "chunk_id").unionByName(retrieval.postings(new, tokens.stemmed(F.col("text"))).select("term", "chunk_id", "dl", "tf")),
            "vectors": corpus.without(vectors, dead, "chunk_id"),
        }
        if self.embed is not None:
            tables["vectors"] = tables["vectors"].unionByName(self._vectors(new))
        self.store.write(tables, **({"vec_model": self.settings.embed.model} if self.embed is not None else {}))
        n = new.groupBy("doc_id").agg(F.count("*").cast("int").alias("chunks"))
        report = classes.select("url", "doc_id", "status", F.lit(None).cast("string").alias("reason")).join(n, "doc_id", "left").select("url", "doc_id", "status", "reason", F.coalesce("chunks", F.lit(0)).alias("chunks"))
        bad = staged.where("status = 'rejected'").select("url", F.lit(None).cast("long").alias("doc_id"), "status", "reason", F.lit(0).alias("chunks"))
        return report.unionByName(bad)

    def _same_model(self) -> None:
        have = self.store.get("vec_model")
        if self.embed is not None and have and have != self.settings.embed.model:
            raise ValueError(f"vectors are of model {have!r}; reindex before using {self.settings.embed.model!r}")

    def _vectors(self, chunks: DataFrame) -> DataFrame:
        v = chunks.select("chunk_id", self.embed(F.col("text")).alias("vec"))
        return v.select("chunk_id", F.lit(self.settings.embed.model).alias("model"), F.size("vec").alias("dim"), "vec")

    def reindex(self) -> None:
        """All vectors anew from the stored chunks, for another model."""
        if self.embed is None:
            raise ValueError("no embedder")
        self.store.write({"vectors": materialize(self._vectors(self.store.read("chunks")), "vectors")}, vec_model=self.settings.embed.model)

    def query(self, q: str, k: int = retrieval.RESULTS) -> Answer:
        """The k best chunks with provenance, their text cleaned and enveloped, and the risk of what is returned."""
        k = k if k > 0 else retrieval.RESULTS
        chunks, index = self.store.read("chunks"), self.store.read("postings")
        dl = index.select("chunk_id", "dl").distinct()
        n = chunks.agg(F.count("*").alias("n")).crossJoin(dl.agg(F.coalesce(F.sum("dl"), F.lit(0)).alias("s"))).select("n", (F.col("s") / F.greatest("n", F.lit(1))).alias("avgdl"))
        terms = [s for w in tokens.query_words(q) for s in tokens.stems(w.replace("_", " "))]
        kw = retrieval.keyword_top(index, n, terms)
        if self.embed is not None:
            one = self.spark.createDataFrame([(q,)], "text string").select(self.embed(F.col("text")).alias("v")).first().v
            vec = retrieval.vector_top(retrieval.nearest_model(self.store.read("vectors"), self.settings.embed.model), one)
            mode = "hybrid"
        else:
            vec, mode = self.spark.createDataFrame([], "chunk_id long, cosine double"), "keyword-only"
        hits = retrieval.enriched(retrieval.fused(kw, vec, k), chunks, self.store.read("docs"))
        hits = materialize(risk.assessed(hits), "hits")
        level = risk.folded(hits, [], ["rank"])
        safe = text.envelope(text.clean_unicode(F.col("text")), F.col("url"), text.envelope_salt())
        return Answer(hits.withColumn("text", safe), mode, level)

    def search(self, stored: DataFrame, limit: int | None = None) -> DataFrame:
        """Stored result pages (query_id, provider, html) to the results of each query."""
        cfg = self.settings.search
        return serp.search(serp.parsed_results(stored), list(cfg.providers), ["query_id"], ["rank"], limit or cfg.max_results)

    def fetch(self, addresses: DataFrame) -> DataFrame:
        """Pages of the addresses (url) as the settings ask for them: robots, rate, caps, and the renderer where HTTP meets a challenge."""
        s = self.settings
        got = web.fetch(addresses, s.http, pages.robots_closed, s.browser.mode, s.browser.renderer)
        return materialize(got, "pages")

    def fetch_page(self, url: str, index: bool = False) -> DataFrame:
        """One page as a document, indexed too where that is asked for or set; a failure to index is a value of the row, not an error."""
        got = self.fetch(self.spark.createDataFrame([(url,)], "url string"))
        page = self.extract(got)
        note = None
        if index or self.settings.index.auto:
            try:
                self.ingest(got)
            except Exception as e:
                note = str(e)
        return page.withColumn("index_error", F.lit(note).cast("string"))

    def ask(self, query: str, limit: int | None = None) -> DataFrame:
        """Live results of the first provider that has any, cleaned and with their risk."""
        cfg = self.settings.search
        q = self.spark.createDataFrame([(0, query)], "query_id long, query_text string")
        got = materialize(live.search(q, cfg, self.settings.http, self.settings.browser.renderer), "results").where("error IS NULL").drop("error")
        return serp.search(got, live.chain(cfg), ["query_id"], ["rank"], limit or cfg.max_results)

    def crawl_pages(self, seed: str, budget: int = graph.BUDGET, source=None) -> DataFrame:
        """One row (fetched, unchanged, failed): pages fetched and indexed level by level from the seed, inside its domain.

        source gives pages for addresses (self.fetch by default). Pages that fail are free; at most TOOL_PAGES are asked for."""
        source, budget = source or self.fetch, min(budget if budget > 0 else graph.BUDGET, graph.TOOL_PAGES)
        home = urls.registrable(urls.host(F.lit(seed)))
        front = self.spark.createDataFrame([(seed,)], "url string")
        seen, n = front, {"fetched": 0, "unchanged": 0, "failed": 0}
        while (left := budget - n["fetched"] - n["unchanged"]) > 0 and not front.isEmpty():
            got = source(front.orderBy("url").limit(left))
            report = materialize(self.ingest(got), "report")
            for r in report.groupBy("status").count().collect():
                n["unchanged" if r.status == "unchanged" else "failed" if r.status == "rejected" else "fetched"] += r["count"]
            links = self.extract(got).where("status = 'extracted'").select(F.explode(urls.outgoing(F.col("links"))).alias("url")).select(urls.without_fragment(F.col("url")).alias("url")).distinct()
            front = materialize(links.where(urls.registrable(urls.host(F.col("url"))) == home).join(seen, "url", "left_anti"), "front")
            seen = materialize(seen.unionByName(front), "seen")
        return self.spark.createDataFrame([tuple(n.values())], "fetched long, unchanged long, failed long")

    def tools(self) -> dict:
        """The engine's operations by name, for a server of tools."""
        return {"search": self.ask, "fetch": self.fetch_page, "index": lambda url: self.fetch_page(url, index=True), "crawl": self.crawl_pages, "query": self.query, "status": self.status}

    def crawl(self, edges: DataFrame, seed: str, budget: int = graph.BUDGET) -> DataFrame:
        return graph.crawl(edges, seed, budget)

    def delete(self, gone: DataFrame) -> None:
        """Documents (doc_id) with their chunks, vectors and postings."""
        docs, chunks, vectors = (self.store.read(t) for t in ("docs", "chunks", "vectors"))
        dead = chunks.join(gone.select("doc_id").distinct(), "doc_id", "left_semi")
        d, c, v = corpus.cascaded(docs, chunks, vectors, gone)
        self.store.write({"docs": d, "chunks": c, "vectors": v, "postings": corpus.without(self.store.read("postings"), dead, "chunk_id")})

    def status(self) -> DataFrame:
        s = corpus.stats(*(self.store.read(t) for t in ("docs", "chunks", "vectors")))
        return s.withColumn("vec_model", F.lit(self.store.get("vec_model"))).withColumn("version", F.lit(self.store.meta()["version"]))
