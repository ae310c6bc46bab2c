"""File sources: url lists, stored pages, binary documents."""

from __future__ import annotations

import shutil
import subprocess

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from corpusloom.operators import pages


def url_list(spark: SparkSession, path: str) -> DataFrame:
    """(url): one a line, without blank lines and lines that start with #."""
    return spark.read.text(path).select(F.trim("value").alias("url")).where("url <> '' AND url NOT LIKE '#%'")


def html_pages(spark: SparkSession, path: str, cap: int = 10 << 20) -> DataFrame:
    """(url, body) of stored files, the path as url; files above the cap are left out (see oversized)."""
    raw = spark.read.format("binaryFile").load(path)
    return raw.where(F.col("length") <= cap).select(F.col("path").alias("url"), F.decode("content", "UTF-8").alias("body"))


def oversized(spark: SparkSession, path: str, cap: int = 10 << 20) -> DataFrame:
    return spark.read.format("binaryFile").load(path).where(F.col("length") > cap).select(F.col("path").alias("url"), "length")


def typed(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents with doc_type, rejects): binary documents can't be read and go to the rejects."""
    t = df.withColumn("doc_type", pages.document_type(F.col("content_type") if "content_type" in df.columns else F.lit(""), F.col("body")))
    return t.where("doc_type <> 'binary'"), t.where("doc_type = 'binary'").withColumn("reason", F.lit("unsupported type"))


def pdf_text(data: bytes | None, timeout: float = 60) -> tuple[str, str]:
    """(text, warning). The external pdftotext is used where it is installed, else pypdf; without either the text is empty."""
    if not data:
        return "", "empty document"
    if tool := shutil.which("pdftotext"):
        done = subprocess.run([tool, "-layout", "-", "-"], input=data, capture_output=True, timeout=timeout)
        if not done.returncode:
            return done.stdout.decode("utf-8", "replace"), ""
    try:
        import io

        from pypdf import PdfReader
    except ImportError:
        return "", "no PDF reader installed"
    out, warning = [], ""
    try:
        for n, p in enumerate(PdfReader(io.BytesIO(data)).pages, 1):
            try:
                out.append(p.extract_text() or "")
            except Exception as e:
                warning = f"page {n}: {e}"
    except Exception as e:
        warning = str(e)
    return "\n\n".join(out), warning


@F.pandas_udf(StructType().add("text", StringType()).add("warning", StringType()))
def pdf(data: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([pdf_text(d) for d in data], columns=["text", "warning"])
