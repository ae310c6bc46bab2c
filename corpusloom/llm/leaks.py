"""Problem 8: evaluation texts that leak into training text.

A prefix-filtered set join. A leak is a run of RUN consecutive words of an item that stands in a document; such a run
holds RUN-SHINGLE+1 word shingles, all of which the document must have, so the rarest one is a sufficient prefix:

1. A pass over the documents keeps the positions of shingles that an item has. A bitmap of fixed size tests them.
2. Shingles are ordered by their number of places in the whole corpus; of each run only the rarest is joined.
3. A match at document position d and item position i fixes the diagonal d-i; the run must lie inside both texts.
4. The words of each candidate are compared over an item-sized window of the document, for a run of RUN words.

Words are maximal runs of letters and digits in lower case. Null, empty and shorter texts hold nothing. Items with equal
texts are reported each; equal duplicate rows count once.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm import kernel as K
from corpusloom.llm.stream import map_batches
from corpusloom.plans.shared import materialize

RUN, SHINGLE = 13, 5
BITS, BLOCK = 24, 16  # a bitmap of 2**BITS bits, built and sent in blocks of 2**BLOCK
_WORD = re.compile(r"[^\W_]+")


def word_list(text: str | None) -> list[str]:
    """The words that the hashes stand for."""
    low = (text or "").lower()
    if low.isascii():
        return _WORD.findall(low)
    out, start = [], None
    for i, ch in enumerate(low):
        if ch.isalnum():
            start = i if start is None else start
        elif start is not None:
            out.append(low[start:i])
            start = None
    return out + ([low[start:]] if start is not None else [])


def _shingles(id_col: str, k: int, bitmap=None):
    def fn(b: pa.RecordBatch) -> dict:
        ids, texts = np.array(b[id_col].to_pylist(), np.int64), b["text"].to_pylist()
        keep_id, keep_pos, keep_h = [], [], []
        bits = bitmap.value if bitmap is not None else None
        for i, j in K.batches(texts):
            w, bounds = K.words(texts[i:j])
            at, text = K.gram_index(bounds, k)
            h = K.grams(w, k)[at] if len(at) else np.zeros(0, K.U)
            if bits is not None and len(h):
                slot = (h >> K.U(64 - BITS)).astype(np.int64)
                hit = (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1
                at, text, h = at[hit], text[hit], h[hit]
            keep_id.append(ids[i:j][text])
            keep_pos.append(at - bounds[text])
            keep_h.append(h)
        return {id_col: np.concatenate(keep_id), "pos": np.concatenate(keep_pos), "h": K.signed(np.concatenate(keep_h))}

    return fn


def _bitmap(shingles: DataFrame):
    """2**BITS bits as a broadcast array; at most 2**(BITS-BLOCK) rows of 2**BLOCK/8 bytes reach the driver."""
    spark = shingles.sparkSession
    slot = F.shiftrightunsigned("h", 64 - BITS)
    blocks = shingles.select(slot.alias("s")).distinct().groupBy(F.shiftright("s", BLOCK).alias("block")).agg(F.collect_list("s").alias("slots"))  # up to 2**BLOCK a row

    def fn(b: pa.RecordBatch) -> dict:
        out = []
        for slots in b["slots"].to_pylist():
            bits = np.zeros(1 << BLOCK, np.uint8)
            bits[np.array(slots, np.int64) & ((1 << BLOCK) - 1)] = 1
            out.append(np.packbits(bits, bitorder="little").tobytes())
        return {"block": b["block"], "bits": out}

    whole = np.zeros(1 << (BITS - 3), np.uint8)
    for block, bits in map_batches(blocks, fn, "block long, bits binary").collect():
        whole[block << (BLOCK - 3) : (block + 1) << (BLOCK - 3)] = np.frombuffer(bits, np.uint8)
    return spark.sparkContext.broadcast(whole)


def _verify(run: int):
    def fn(b: pa.RecordBatch) -> dict:
        docs, items = [], []
        for doc, text, found in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), b["found"].to_pylist()):
            have = word_list(text)
            for item in {f["item_id"] for f in found}:
                own = [f for f in found if f["item_id"] == item]
                want = word_list(own[0]["item"])
                if any(_runs(have, want, f["diagonal"]) >= run for f in own):
                    docs.append(doc)
                    items.append(item)
        return {"doc_id": docs, "item_id": items}

    return fn


def _runs(have: list[str], want: list[str], diagonal: int) -> int:
    """Longest run of equal words with item position i at document position i+diagonal."""
    best = now = 0
    for i in range(max(0, -diagonal), min(len(want), len(have) - diagonal)):
        now = now + 1 if have[i + diagonal] == want[i] else 0
        best = max(best, now)
    return best


def candidates(documents: DataFrame, items: DataFrame, run: int = RUN, k: int = SHINGLE) -> DataFrame:
    """(doc_id, item_id, diagonal): where a document has the rarest shingle of one of an item's runs."""
    of_items = materialize(map_batches(items.select("item_id", "text").where("text IS NOT NULL").distinct(), _shingles("item_id", k), "item_id long, pos long, h long"), "items")
    bits = _bitmap(of_items.select("h"))
    seen = materialize(map_batches(documents.select("doc_id", "text").where("text IS NOT NULL"), _shingles("doc_id", k, bits), "doc_id long, pos long, h long"), "seen")
    places = seen.groupBy("h").agg(F.count("*").alias("df"))
    ranked = of_items.join(places, "h", "left").withColumn("rank", F.struct(F.coalesce("df", F.lit(0)).alias("df"), F.col("h"), F.col("pos")))
    # one item's shingles are one text's: a window over them is bounded by its length
    ahead = Window.partitionBy("item_id").orderBy("pos").rowsBetween(0, run - k)
    runs = ranked.withColumn("best", F.min("rank").over(ahead)).withColumn("n", F.count("*").over(ahead)).where(F.col("n") == run - k + 1)
    prefix = runs.select("item_id", F.col("best.h").alias("h"), F.col("best.pos").alias("ipos"), F.col("best.df").alias("df")).where("df > 0")
    prefix = prefix.select("item_id", "h", "ipos").distinct()
    return seen.join(prefix, "h").select("doc_id", "item_id", (F.col("pos") - F.col("ipos")).alias("diagonal")).distinct()


def leaks(documents: DataFrame, items: DataFrame, run: int = RUN, k: int = SHINGLE) -> DataFrame:
    """(doc_id, item_id): documents with a run of at least `run` words of the item."""
    if run < k:
        raise ValueError("run must be at least the shingle's length")
    found = candidates(documents, items, run, k).join(items.select("item_id", F.col("text").alias("item")).distinct(), "item_id")
    per_doc = found.groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "item", "diagonal")).alias("found"))
    texts = documents.select("doc_id", "text").join(per_doc, "doc_id")
    return map_batches(texts, _verify(run), "doc_id long, item_id long").distinct()


def by_item(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, suite, n_docs): how many documents hold each item; items that leaked nowhere have 0."""
    n = leaks(documents, items).groupBy("item_id").agg(F.count("*").alias("n_docs"))
    return items.select("item_id", "suite").distinct().join(n, "item_id", "left").select("item_id", "suite", F.coalesce("n_docs", F.lit(0)).alias("n_docs"))
