"""Keyword, vector and hybrid retrieval over chunk tables.

postings(term, chunk_id, tf, dl) is the inverted index. Ranking works on narrow columns; texts join the winners last."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.plans.shared import materialize

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
CANDIDATES, RRF_K, RESULTS = 50, 60, 8
HIT = ["chunk_id", "doc_id", "text", "url", "title", "doc_type", "fetched_at", "sha256"]


def postings(chunks: DataFrame, words: Column, key: str = "chunk_id") -> DataFrame:
    """A row for each term of each text; dl is the text's number of words."""
    w = chunks.select(key, words.alias("_w")).select(key, F.explode("_w").alias("term"), F.size("_w").alias("dl"))
    return w.groupBy("term", key, "dl").agg(F.count("*").alias("tf"))


def corpus_size(chunks: DataFrame, words: Column) -> DataFrame:
    """One row: n texts and their average number of words."""
    return chunks.agg(F.count("*").alias("n"), F.avg(F.coalesce(F.size(words), F.lit(0))).alias("avgdl"))


def scanned(chunks: DataFrame, words: Column, terms: list[str], key: str = "chunk_id") -> DataFrame:
    """(key, dl, hits) of each text in one pass: its number of words, and those of them that a query has.

    For texts without an index yet. Rows of equal keys count once; texts don't move."""
    w = chunks.select(key, F.coalesce(words, F.array().cast("array<string>")).alias("_w"))
    rows = w.select(key, F.size("_w").alias("dl"), F.filter("_w", lambda x: x.isin(*terms)).alias("hits"))
    return materialize(rows.dropDuplicates([key]), "scan")


def scanned_top(scan: DataFrame, terms: list[str], limit: int = CANDIDATES, key: str = "chunk_id") -> DataFrame:
    """keyword_top over a scan."""
    index = scan.select(key, "dl", F.explode("hits").alias("term")).groupBy("term", key, "dl").agg(F.count("*").alias("tf"))
    return keyword_top(index, scan.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")), terms, limit, key)


def bm25(index: DataFrame, size: DataFrame, terms: list[str], key: str = "chunk_id") -> DataFrame:
    """(key, bm25) of every text with a term; a term given twice counts twice."""
    if not terms:
        return index.where("false").select(key, F.lit(0.0).alias("bm25"))
    spark = index.sparkSession
    q = F.broadcast(spark.createDataFrame(list(Counter(terms).items()), "term string, qtf long"))  # a query's words
    hits = index.where(F.col("term").isin(sorted(set(terms)))).join(q, "term")
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    hits = hits.join(F.broadcast(df), "term").crossJoin(F.broadcast(size))
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(LEAST_IDF))
    tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return hits.groupBy(key).agg(F.sum(F.col("qtf") * idf * tf).alias("bm25"))


def keyword_top(index: DataFrame, size: DataFrame, terms: list[str], limit: int = CANDIDATES, key: str = "chunk_id") -> DataFrame:
    limit = limit if limit > 0 else CANDIDATES
    return bm25(index, size, terms, key).orderBy(F.desc("bm25"), key).limit(limit)


def _double(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """In double precision; 0 for null or empty vectors, unequal lengths and zero norms."""
    x, y = _double(a), _double(b)
    norm = F.sqrt(_dot(x, x) * _dot(y, y))
    usable = a.isNotNull() & b.isNotNull() & (F.size(a) > 0) & (F.size(a) == F.size(b))
    return F.coalesce(F.when(usable, F.when(norm > 0, _dot(x, y) / norm)), F.lit(0.0))


def vector_top(vectors: DataFrame, query: list[float], limit: int = CANDIDATES, key: str = "chunk_id", vec: str = "vec") -> DataFrame:
    """(key, cosine) of the nearest vectors with a positive cosine; limit 0 or less keeps all."""
    q = F.array(*(F.lit(float(x)) for x in query))
    rows = vectors.select(key, cosine(F.col(vec), q).alias("cosine")).where("cosine > 0").orderBy(F.desc("cosine"), key)
    return rows.limit(limit) if limit > 0 else rows


def fused(keyword: DataFrame, vector: DataFrame, limit: int = RESULTS, k: int = RRF_K, key: str = "chunk_id") -> DataFrame:
    """(key, score, matched_by, rank) by reciprocal rank fusion; equal scores go by key. limit 0 or less keeps all."""
    place = lambda df, by, name: df.select(key, F.row_number().over(Window.orderBy(F.desc(by), key)).alias(name))  # noqa: E731 (lists of at most CANDIDATES rows)
    both = place(keyword, "bm25", "kr").join(place(vector, "cosine", "vr"), key, "full")
    part = lambda c: F.coalesce(F.lit(1.0) / (k + F.col(c)), F.lit(0.0))
    how = F.when(F.col("kr").isNull(), "vector").when(F.col("vr").isNull(), "keyword").otherwise("both")
    ranked = both.select(key, (part("kr") + part("vr")).alias("score"), how.alias("matched_by")).orderBy(F.desc("score"), key)
    ranked = ranked.limit(limit) if limit > 0 else ranked
    return ranked.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key)))


def enriched(hits: DataFrame, chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """hits with text and provenance; a hit without chunk or document keeps an empty record."""
    at = chunks.select("chunk_id", "doc_id", "text", F.lit(True).alias("_at")).dropDuplicates(["chunk_id"])
    of = docs.select("doc_id", "url", "title", "doc_type", "fetched_at", "sha256", F.lit(True).alias("_of")).dropDuplicates(["doc_id"])
    whole = hits.join(at, "chunk_id", "left").join(of, "doc_id", "left")
    empty = lambda c, found: F.when(F.col(found).isNull(), F.lit("")).otherwise(F.col(c))
    whole = whole.withColumns({"text": empty("text", "_at"), "url": empty("url", "_of"), "title": empty("title", "_of")})
    return whole.select(*HIT, *(c for c in hits.columns if c != "chunk_id"))


def nearest_model(vectors: DataFrame, model: str) -> DataFrame:
    """The vectors of one model; those of others have another space."""
    return vectors.where(F.col("model") == model)


def vector_summary(vectors: DataFrame, model: str | None = None) -> DataFrame:
    """One row: number of vectors, smallest dim and model; a model that the store's values name overrides what the rows say."""
    return vectors.agg(F.count("*").alias("n"), F.min("dim").alias("dim"), F.coalesce(F.lit(model), F.min("model")).alias("model"))
