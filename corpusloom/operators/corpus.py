"""The corpus: staged documents against the current ones, and what follows from a change.

Tables live in versioned folders; a pointer file names the current version, so a reader never sees half a write."""

from __future__ import annotations

import json
import os
import shutil
import uuid
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType

DOCS = "doc_id long, url string, final_url string, doc_type string, sha256 string, etag string, title string, extraction string, extract_warning string, signals array<string>, links array<string>, fetched_at timestamp, updated_at timestamp"
CHUNKS = "doc_id long, seq int, chunk_id long, text string, start_char int"
VECTORS = "chunk_id long, model string, dim int, vec array<float>"
POSTINGS = "term string, chunk_id long, dl int, tf long"
_REFRESHED = ("etag", "title", "extraction", "extract_warning", "fetched_at")


def classified(staged: DataFrame, current: DataFrame) -> DataFrame:
    """staged with status new, unchanged or changed by url and content hash, and the doc_id it has or gets.

    Of several staged rows of one url the last fetched holds. A new document's id follows from its url."""
    last = Window.partitionBy("url").orderBy(F.desc("fetched_at"), "sha256")
    s = staged.where("url IS NOT NULL").drop("doc_id").withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")
    old = current.select("url", F.col("doc_id").alias("_id"), F.col("sha256").alias("_sha"))
    status = F.when(F.col("_id").isNull(), "new").when(F.col("_sha").eqNullSafe(F.col("sha256")), "unchanged").otherwise("changed")
    j = s.join(old, "url", "left").withColumn("status", status)
    return j.withColumn("doc_id", F.coalesce("_id", F.xxhash64("url"))).drop("_id", "_sha")


def upserted(classes: DataFrame, current: DataFrame) -> DataFrame:
    """The documents after the batch: unchanged ones get new bookkeeping only, changed and new ones all fields."""
    cols = current.columns
    now = current.join(classes.select("doc_id", F.col("status").alias("_s"), *(F.col(c).alias(f"_{c}") for c in _REFRESHED)), "doc_id", "left")
    kept = now.where("_s IS NULL OR _s = 'unchanged'").select(*(F.when(F.col("_s").isNotNull(), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in _REFRESHED else c for c in cols))
    return kept.unionByName(classes.where("status <> 'unchanged'").select(*cols))


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def cascaded(docs: DataFrame, chunks: DataFrame, vectors: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables after the documents in gone (doc_id) are deleted, with all that hangs on them."""
    dead = chunks.join(gone.select("doc_id").distinct(), "doc_id", "left_semi")
    return without(docs, gone, "doc_id"), without(chunks, gone, "doc_id"), without(vectors, dead, "chunk_id")


def replaced(rows: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """rows with those of new in place of the ones with equal keys."""
    return without(rows, new, key).unionByName(new.select(*rows.columns))


def batch_status(log: DataFrame, by: str = "url", order: tuple[str, ...] = ("batch_id", "doc_id")) -> DataFrame:
    """log with each row's status against the row of its url before it: new, unchanged or changed."""
    w = Window.partitionBy(by).orderBy(*order)
    before, n = F.lag("sha256").over(w), F.row_number().over(w)
    return log.withColumn("status", F.when(n == 1, "new").when(before.eqNullSafe(F.col("sha256")), "unchanged").otherwise("changed"))


def stats(docs: DataFrame, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row of table sizes."""
    n = lambda df, c: df.agg(F.count("*").alias(c))
    return n(docs, "docs").crossJoin(n(chunks, "chunks")).crossJoin(n(vectors, "vectors"))


@F.pandas_udf(ArrayType(FloatType()))
def decoded_vector(blob: pd.Series) -> pd.Series:
    """Vectors from blobs of little-endian 32-bit floats."""
    import numpy as np

    return blob.map(lambda b: None if b is None else np.frombuffer(b, "<f4"))


@F.pandas_udf(BinaryType())
def encoded_vector(vec: pd.Series) -> pd.Series:
    import numpy as np

    return vec.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())


class Store:
    """Versioned tables docs, chunks, vectors and postings under one folder, with a small key-value file."""

    TABLES = {"docs": DOCS, "chunks": CHUNKS, "vectors": VECTORS, "postings": POSTINGS}

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, Path(folder)
        self.folder.mkdir(parents=True, exist_ok=True)

    def meta(self) -> dict:
        at = self.folder / "current.json"
        return json.loads(at.read_text()) if at.exists() else {"version": 0, "values": {}}

    def get(self, key: str) -> str | None:
        return self.meta()["values"].get(key)

    def put(self, key: str, value: str) -> None:
        m = self.meta()
        m["values"][key] = value
        self._point(m)

    def _point(self, m: dict) -> None:
        new = self.folder / f"current-{uuid.uuid4().hex}.json"
        new.write_text(json.dumps(m))
        os.replace(new, self.folder / "current.json")

    def read(self, name: str) -> DataFrame:
        at = self.folder / f"v{self.meta()['version']}" / name
        return self.spark.read.schema(self.TABLES[name]).parquet(str(at)) if at.exists() else self.spark.createDataFrame([], self.TABLES[name])

    def write(self, tables: dict[str, DataFrame], **values: str) -> None:
        """All tables of a new version, then the pointer; tables not given stay as they are. A broken write leaves no trace."""
        m = self.meta()
        old, new = self.folder / f"v{m['version']}", self.folder / f"v{m['version'] + 1}"
        shutil.rmtree(new, ignore_errors=True)
        for name in self.TABLES:
            if name in tables:
                df = tables[name]
                df = df.repartitionByRange("term").sortWithinPartitions("term") if name == "postings" else df
                df.write.parquet(str(new / name))
            elif (old / name).exists():
                shutil.copytree(old / name, new / name)
        m["version"] += 1
        m["values"].update(values)
        self._point(m)
