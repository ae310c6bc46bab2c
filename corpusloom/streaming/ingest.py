"""Continuous ingest: stored pages as a stream, each micro-batch upserted by url and content hash.

A batch that is delivered again finds its pages unchanged, so a restart adds nothing twice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom.plans.engine import Engine

PAGES = "url string, body string, content_type string, fetched_at timestamp"


def page_stream(spark: SparkSession, folder: str, per_batch: int = 100) -> DataFrame:
    """Parquet files of pages, as they arrive."""
    return spark.readStream.schema(PAGES).option("maxFilesPerTrigger", per_batch).parquet(folder)


def start(engine: Engine, stream: DataFrame, checkpoint: str, once: bool = False) -> StreamingQuery:
    def batch(df: DataFrame, epoch: int) -> None:
        engine.ingest(df)

    w = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime="30 seconds")).start()


def arrivals(stream: DataFrame, delay: str = "1 hour", window: str = "10 minutes") -> DataFrame:
    """Pages and hosts in each window of fetch time; pages later than the delay are dropped by the watermark."""
    host = F.lower(F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1))
    w = stream.withWatermark("fetched_at", delay).groupBy(F.window("fetched_at", window).alias("w"))
    return w.agg(F.count("*").alias("pages"), F.approx_count_distinct(host).alias("hosts")).select("w.start", "w.end", "pages", "hosts")
