"""Problem 10: long exact spans shared between records.

A generalized suffix tree over all texts, kept sparse and partitioned:

1. Winnowing picks the suffixes that can start a shared span. Every window of min_len characters holds at least one
   picked suffix, the same one in every text, so no span of min_len characters is missed.
2. Suffixes fall into groups by a prefix of SEED characters; a prefix that only one text has is dropped. A group of
   more than GROUP suffixes is split by longer contexts: a span of min_len around a suffix has, for some j, an
   equal prefix of STEP*j and equal left context of at least min_len-STEP*(j+1) characters.
3. In each memory-sized group the sorted suffixes form a subtree; its internal nodes, extended to the left, are
   the repeats. A node counts when it is at least min_len characters deep.

Texts are compared character for character. Null and shorter texts share nothing. Equal texts form a class, are
compared once, and are expanded only where pairs of documents are the result. Equal duplicate rows count once; if one
doc_id has several different texts, each is a text of that document and a document isn't paired with itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import kernel as K
from corpusloom.llm.stream import map_batches, map_groups
from corpusloom.plans.shared import materialize

SEED = 64
GROUP = 512
STEP = 50
_LOW = (1 << 24) - 1


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each window of w values, by block prefix and suffix minima."""
    n = len(x)
    pad = -n % w
    full = np.concatenate([x, np.full(pad, np.iinfo(np.uint64).max, K.U)]).reshape(-1, w)
    left = np.minimum.accumulate(full, axis=1).ravel()
    right = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def anchors(text: str, min_len: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes of seed characters) of the winnowed suffixes of one text."""
    if len(text) < min_len:
        return np.zeros(0, np.int64), np.zeros(0, K.U)
    run = K.RunHash(K.codes(text))
    n = len(text) - seed + 1
    i = np.arange(n)
    h = run(i, i + seed)
    w = min_len - seed + 1
    low = _sliding_min((h & ~K.U(_LOW)) | (i.astype(K.U) & K.U(_LOW)), w)
    start = np.arange(len(low))
    at = np.unique(start + (((low & K.U(_LOW)).astype(np.int64) - start) & _LOW))
    return at, h[at]


def _scan(min_len: int, seed: int):
    def fn(b: pa.RecordBatch) -> dict:
        ids, cls, size, text, pos, h = b["doc_id"].to_pylist(), b["cls"].to_pylist(), [], b["text"].to_pylist(), [], []
        for t in text:
            p, x = anchors(t, min_len, seed)
            size.append(len(p))
            pos.append(p)
            h.append(x)
        rep = lambda v: np.repeat(np.array(v, np.int64), size)
        return {"doc_id": rep(ids), "cls": rep(cls), "pos": np.concatenate(pos), "h": K.signed(np.concatenate(h))}

    return fn


def _contexts(min_len: int, seed: int):
    """Each suffix with its context, and the key of its group: the prefix, or the contexts of a hot prefix."""

    def fn(b: pa.RecordBatch) -> dict:
        out: dict[str, list] = {k: [] for k in ("key", "n", "doc_id", "pos", "left", "right")}
        for doc, text, suffixes in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), b["suffixes"].to_pylist()):
            run = None
            for s in suffixes:
                p, keys = s["pos"], [s["h"]]
                if s["n"] > GROUP:
                    run, keys = run or K.RunHash(K.codes(text)), []
                    for r in range(STEP, min_len + 1, STEP):
                        lo = max(0, min_len - r - STEP)
                        if p + r <= len(text) and p >= lo:
                            keys.append(int(K.signed(run(np.array([p - lo]), np.array([p + r])))[0]) ^ r)
                for k in keys:
                    for name, v in zip(out, (k, s["n"], doc, p, text[max(0, p - min_len) : p], text[p : p + min_len])):
                        out[name].append(v)
        return out

    return fn


def _common(a: str, b: str) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[:mid] == b[:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def _subtree(min_len: int, pairs: bool):
    """The deep nodes of one group's subtree: rows (doc_a, doc_b, from_a, to_a, from_b), or (doc, from, to) as cover."""

    def fn(rows: list[dict]) -> list[tuple]:
        rows.sort(key=lambda r: (r["right"], r["doc_id"], r["pos"]))
        lcp = [0] + [_common(rows[i - 1]["right"], rows[i]["right"]) for i in range(1, len(rows))]
        flip = [r["left"][::-1] for r in rows]
        two = any(r["side"] == 1 for r in rows)
        out: set[tuple] = set()
        for i in range(len(rows)):
            depth = len(rows[i]["right"])
            for j in range(i + 1, len(rows)):
                depth = min(depth, lcp[j])
                if not depth:
                    break
                a, b = rows[i], rows[j]
                if a["doc_id"] == b["doc_id"] or (two and a["side"] == b["side"]):
                    continue
                back = _common(flip[i], flip[j])
                if depth + back < min_len:
                    continue
                if a["doc_id"] > b["doc_id"]:
                    a, b = b, a
                if pairs:
                    out.add((a["doc_id"], b["doc_id"], a["pos"] - back, a["pos"] + depth, b["pos"] - back))
                else:
                    out.update((x["doc_id"], x["pos"] - back, x["pos"] + depth) for x in (a, b))
        return list(out)

    return fn


class SharedSpans:
    """Spans of at least min_len characters that stand verbatim in more than one document."""

    def __init__(self, documents: DataFrame, min_len: int = 400):
        if min_len < 2:
            raise ValueError("min_len must be 2 or more")
        self.min_len, seed = min_len, min(SEED, max(1, min_len // 2))
        texts = documents.select("doc_id", "text", F.xxhash64("text").alias("cls"), F.length("text").alias("size")).where(F.col("size") >= min_len)
        scanned = materialize(map_batches(texts.select("doc_id", "cls", "text"), _scan(min_len, seed), "doc_id long, cls long, pos long, h long"), "anchors")
        # the class of a text is its hash; a document with several texts stands in several classes
        self.members = materialize(scanned.select("cls", "doc_id").distinct(), "members")
        self.rep = rep = self.members.groupBy("cls").agg(F.min("doc_id").alias("rep"))
        hot = scanned.groupBy("h").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi"), F.count("*").alias("n")).where("lo <> hi")
        shared = scanned.join(hot.select("h", "n"), "h").join(rep, "cls").where("doc_id = rep").dropDuplicates(["cls", "pos"])
        need = shared.groupBy("doc_id", "cls").agg(F.collect_list(F.struct("pos", "h", "n")).alias("suffixes"))
        picked = texts.join(need, ["doc_id", "cls"]).groupBy("cls").agg(F.first("text").alias("text"), F.first("suffixes").alias("suffixes"))
        suffixes = map_batches(picked.select(F.col("cls").alias("doc_id"), "text", "suffixes"), _contexts(min_len, seed), "key long, n long, doc_id long, pos long, left string, right string")
        self.suffixes = materialize(suffixes, "suffixes")

    def _groups(self) -> DataFrame:
        """Groups of at most 2*GROUP rows; a larger one becomes pairs of its blocks."""
        sizes = self.suffixes.where(F.col("n") > GROUP).groupBy("key").agg(F.count("*").alias("m"))
        s = self.suffixes.join(sizes, "key", "left").withColumn("blocks", F.ceil(F.coalesce("m", F.lit(1)) / GROUP).cast("int"))
        s = s.withColumn("b", F.pmod(F.xxhash64("doc_id", "pos"), F.col("blocks")).cast("int"))
        s = s.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        lo, hi = F.least("b", "o"), F.greatest("b", "o")
        return s.select("key", lo.alias("b0"), hi.alias("b1"), F.when(lo == hi, 0).when(F.col("b") == lo, 1).otherwise(2).alias("side"), "doc_id", "pos", "left", "right")

    def class_spans(self) -> DataFrame:
        """(doc_id_a, doc_id_b, start_a, end_a, start_b) for each maximal equal span of two different texts.

        Each text is named by the smallest doc_id that has it; members maps texts to all their documents."""
        found = map_groups(self._groups(), ["key", "b0", "b1"], _subtree(self.min_len, True), "a long, b long, from_a long, to_a long, from_b long")
        # neighbouring suffixes see parts of one long span: parts on one diagonal that touch are joined
        rows = found.distinct().withColumn("shift", F.col("from_b") - F.col("from_a"))
        runs = rows.groupBy("a", "b", "shift").agg(F.array_sort(F.collect_list(F.struct("from_a", "to_a"))).alias("parts"))
        flat = runs.select("a", "b", "shift", F.inline(_joined("parts", "from_a", "to_a")))
        name = lambda c: self.rep.select(F.col("cls").alias(c), F.col("rep").alias(f"doc_id_{c}"))
        return flat.join(name("a"), "a").join(name("b"), "b").select("doc_id_a", "doc_id_b", F.col("from").alias("start_a"), F.col("to").alias("end_a"), (F.col("from") + F.col("shift")).alias("start_b"))

    def pairs(self) -> DataFrame:
        """(doc_id_a, doc_id_b), smaller first: all pairs of documents that share a span."""
        links = self._pairs_of_classes()
        m = self.members
        across = links.join(m.select(F.col("cls").alias("a"), F.col("doc_id").alias("x")), "a").join(m.select(F.col("cls").alias("b"), F.col("doc_id").alias("y")), "b").select("x", "y")
        several = m.join(m.groupBy("cls").agg(F.count("*").alias("k")).where("k > 1").select("cls"), "cls")
        within = several.select("cls", F.col("doc_id").alias("x")).join(several.select("cls", F.col("doc_id").alias("y")), "cls").where("x < y").select("x", "y")
        both = across.unionByName(within).where("x <> y")
        return both.select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b")).distinct()

    def _pairs_of_classes(self) -> DataFrame:
        return map_groups(self._groups(), ["key", "b0", "b1"], _subtree(self.min_len, True), "a long, b long, from_a long, to_a long, from_b long").select("a", "b").distinct()

    def shared(self, documents: DataFrame) -> DataFrame:
        """(doc_id, n_chars, shared_chars, shared_part, copies): how much of each document stands elsewhere too."""
        cover = map_groups(self._groups(), ["key", "b0", "b1"], _subtree(self.min_len, False), "cls long, from long, to long").distinct()
        parts = cover.groupBy("cls").agg(F.array_sort(F.collect_list(F.struct("from", "to"))).alias("parts"))
        of_class = parts.select("cls", F.aggregate(_joined("parts", "from", "to"), F.lit(0).cast("long"), lambda s, x: s + x["to"] - x["from"]).alias("covered"))
        size = self.members.groupBy("cls").agg(F.count("*").alias("copies"))
        per = documents.select("doc_id", F.xxhash64("text").alias("cls"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars")).distinct()
        got = per.join(size, "cls", "left").join(of_class, "cls", "left")
        whole = (F.col("copies") > 1) & (F.col("n_chars") >= self.min_len)
        got = got.withColumn("shared_chars", F.when(whole, F.col("n_chars")).otherwise(F.coalesce("covered", F.lit(0))).cast("long"))
        return got.select("doc_id", "n_chars", "shared_chars", F.when(F.col("n_chars") > 0, F.round(F.col("shared_chars") / F.col("n_chars"), 6)).otherwise(F.lit(0.0)).alias("shared_part"), F.coalesce("copies", F.lit(1)).alias("copies"))


def _joined(parts: str, start: str, end: str):
    """Sorted intervals with those that touch or overlap made one, as array<struct<from, to>>."""
    kind = "array<struct<from:bigint,to:bigint>>"

    def step(acc, x):
        last = F.element_at(acc, -1)
        new = F.struct(x[start].alias("from"), x[end].alias("to"))
        grown = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["from"].alias("from"), F.greatest(last["to"], x[end]).alias("to"))))
        return F.when(F.size(acc) == 0, F.array(new)).when(x[start] <= last["to"], grown).otherwise(F.concat(acc, F.array(new))).cast(kind)

    return F.aggregate(F.col(parts), F.array().cast(kind), step)
