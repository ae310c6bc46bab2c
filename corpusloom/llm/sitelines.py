"""Problem 1: lines repeated across one site's documents.

A site's documents are dealt to shards of about SHARD_DOCS. In each shard the line identifiers of all its chunks are
concatenated, a suffix array is built by prefix doubling, and its intervals of common prefixes (the nodes of the suffix
tree) are counted by distinct documents: an interval of depth d is a block of d lines, one of depth 1 a single line. A block that a share of the whole
site has, has that share in some shard, so blocks below it in every shard are out, as are those that shards without them can't
lift over the bound. The others, and of a site of several shards their single lines too, are counted over all shards, and
the blocks that span enough documents are deleted wherever they stand. Shards bound a task, whatever the size of the site.

A line's normal form has its ends trimmed, inner white space as one space, lower case and each run of digits as one 0;
lines with a normal form under min_chars break blocks. Chunks without a site (null or unreadable url, no docs row) and
null texts have no repeated lines. Equal duplicate rows count once; a doc_id with several urls takes the smallest site.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.stream import map_batches, map_groups, merge
from corpusloom.plans.shared import materialize

SHARD_DOCS = 1000
MIN_CHARS, MIN_DOCS, MIN_SHARE = 15, 4, 0.1
_DIGITS = re.compile(r"\d+")


def site_of(url: str | Column) -> Column:
    """Host in lower case without a leading www. and port; null if there is none."""
    host = F.lower(F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1))
    return F.nullif(F.regexp_replace(host, r"^www\.", ""), F.lit(""))


def normal(line: str) -> str:
    return _DIGITS.sub("0", " ".join(line.split()).lower())


def line_key(line: str, min_chars: int = MIN_CHARS) -> int:
    """64-bit identifier of the line's normal form; 0 if that is too short."""
    n = normal(line)
    if len(n) < min_chars:
        return 0
    h = xxhash.xxh3_64_intdigest(n.encode("utf-8", "surrogatepass")) or 1
    return h - (1 << 64) if h >> 63 else h


def keyed(chunks: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, chunk_id, seq, keys): the line identifiers of every chunk."""

    def fn(b: pa.RecordBatch) -> dict:
        return {"doc_id": b["doc_id"], "chunk_id": b["chunk_id"], "seq": b["seq"], "keys": [[line_key(x, min_chars) for x in t.split("\n")] for t in b["text"].to_pylist()]}

    rows = chunks.select("doc_id", "chunk_id", "seq", "text").where("text IS NOT NULL AND doc_id IS NOT NULL")
    return map_batches(rows, fn, "doc_id long, chunk_id long, seq int, keys array<long>")


def suffix_array(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of the suffixes, common prefix of each with the one before), by prefix doubling.

    Negative symbols are breaks: each differs from all others."""
    n = len(symbols)
    s = symbols.astype(np.int64).copy()
    breaks = np.flatnonzero(s < 0)
    s[breaks] = (s.max(initial=-1) + 1) + np.arange(len(breaks))
    rank = np.unique(s, return_inverse=True)[1].astype(np.int64)
    levels, h = [rank], 1
    while h < n and len(np.unique(rank)) < n:
        ahead = np.full(n, -1, np.int64)
        ahead[:-h] = rank[h:]
        rank = np.unique(rank * (n + 1) + ahead + 1, return_inverse=True)[1].astype(np.int64)
        levels.append(rank)
        h *= 2
    order = np.argsort(rank, kind="stable")
    lcp = np.zeros(n, np.int64)
    a, b = order[:-1].copy(), order[1:].copy()
    for k in range(len(levels) - 1, -1, -1):
        ok = (a < n) & (b < n)
        same = np.zeros(len(a), bool)
        same[ok] = levels[k][a[ok]] == levels[k][b[ok]]
        step = np.where(same, 1 << k, 0)
        lcp[1:] += step
        a, b = a + step, b + step
    return order, np.minimum(lcp, n)


def repeated_blocks(symbols: np.ndarray, docs: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(position, lines, documents) of the left-maximal blocks in at least `least` documents, as deep as all their places agree; of one place only where least is 1."""
    order, lcp = suffix_array(symbols)
    keep = symbols[order] >= 0
    order, lcp = order[keep], np.where(keep, lcp, 0)[keep]
    before = np.where(order > 0, symbols[np.maximum(order - 1, 0)], -1)
    seen: dict[int, int] = {}
    out: list[tuple[int, int, int]] = []
    stack: list[list[int]] = [[0, 0, 0, -2]]  # depth, first suffix, suffixes of documents that are in it already, line before
    lows = [0]

    def join(x: int, y: int) -> int:
        return y if x == -2 else x if x == y and x >= 0 else -1

    for i in range(len(order) + 1):
        depth = int(lcp[i]) if 0 < i < len(order) else 0
        low, again, left = i - 1, 0, int(before[i - 1]) if i else -2
        while stack[-1][0] > depth:
            d, low, dup, prev = stack.pop()
            lows.pop()
            again, left = again + dup, join(prev, left)
            n = i - low - again
            if d >= 1 and n >= least and left < 0:
                out.append((int(order[low]), d, n))
            if stack[-1][0] >= depth:
                stack[-1][2] += again
                stack[-1][3] = join(stack[-1][3], left)
                again, left = 0, stack[-1][3] if stack[-1][0] > depth else left
        if stack[-1][0] < depth:
            stack.append([depth, low, again, left])
            lows.append(low)
        elif i:
            stack[-1][3] = join(stack[-1][3], int(before[i - 1]))
        if i < len(order):
            doc = int(docs[order[i]])
            if doc in seen:
                stack[max(0, bisect_right(lows, seen[doc]) - 1)][2] += 1
            seen[doc] = i
    if least <= 1:
        out += [(int(p), 1, 1) for i, p in enumerate(order) if lcp[i] == 0 and (i + 1 == len(order) or lcp[i + 1] == 0)]
    return out


def _sequence(rows: list[dict], keep: dict[int, int] | None = None) -> tuple[np.ndarray, np.ndarray, dict[int, int]]:
    """The rows' lines end to end as small numbers, -1 for breaks; the document of each; the numbers.

    Blank and short lines, chunk ends and lines outside keep break blocks; a line repeated at once counts as one."""
    rows.sort(key=lambda r: (r["doc_id"], r["seq"] if r["seq"] is not None else -1, r["chunk_id"] or 0))
    numbers: dict[int, int] = {} if keep is None else keep
    seq, docs = [], []
    for d, r in enumerate(rows):
        for k in r["keys"]:
            x = numbers.setdefault(k, len(numbers)) if k and keep is None else numbers.get(k, -1)
            if x < 0 and (not seq or seq[-1] < 0) or seq and x == seq[-1]:
                continue
            seq.append(x)
            docs.append(r["doc_id"])
        if seq and seq[-1] >= 0:
            seq.append(-1)
            docs.append(r["doc_id"])
    return np.array(seq, np.int64), np.array(docs, np.int64), numbers


def _docs_of(rows: list[dict]) -> dict[int, int]:
    """Number of documents of each line."""
    per: dict[int, set] = {}
    for r in rows:
        per.setdefault(r["doc_id"], set()).update(r["keys"])
    n: dict[int, int] = {}
    for keys in per.values():
        for k in keys:
            n[k] = n.get(k, 0) + 1
    n.pop(0, None)
    return n


def _local(min_docs: int, share: float):
    """Candidates of one shard: (site, lines, documents there, documents there that are too few)."""

    def fn(rows: list[dict]) -> list[tuple]:
        site, alone = rows[0]["site"], rows[0]["shards"] == 1
        size = rows[0]["shard_docs"]
        least = max(1, int(np.ceil(share * size - 1e-9)))
        if alone:
            least = max(least, min_docs)
        # a line in fewer documents is in no block
        often = {k: n for k, n in _docs_of(rows).items() if n >= least}
        if not often:
            return []
        names = sorted(often)
        seq, docs, _ = _sequence(rows, {k: i for i, k in enumerate(names)})
        blocks = {tuple(names[x] for x in seq[p : p + d]): n for p, d, n in repeated_blocks(seq, docs, least)}
        if not alone:  # elsewhere the line may stand without the block
            blocks |= {(k,): often[k] for b in blocks for k in b}
        return [(site, list(b), n, least - 1) for b, n in sorted(blocks.items())]

    return fn


def _count(rows: list[dict]) -> list[tuple]:
    """Documents of one shard that have each candidate: (site, lines, documents)."""
    blocks = [tuple(r["block"]) for r in rows if r["block"]]
    own = [r for r in rows if not r["block"]]
    if not blocks or not own:
        return []
    site = rows[0]["site"]
    first: dict[int, list[tuple]] = {}
    for b in blocks:
        first.setdefault(b[0], []).append(b)
    have: dict[tuple, set] = {b: set() for b in blocks}
    names = {k: i for i, k in enumerate({k for b in blocks for k in b})}
    back = list(names)
    seq, docs, _ = _sequence(own, dict(names))
    line = [back[x] if x >= 0 else 0 for x in seq.tolist()]
    for i, k in enumerate(line):
        for b in first.get(k, ()):
            if len(b) == 1 or tuple(line[i : i + len(b)]) == b:
                have[b].add(int(docs[i]))
    return [(site, list(b), len(d)) for b, d in have.items() if d]


class SiteLines:
    """Blocks of lines that at least min_docs documents and a share of all documents of the site have."""

    def __init__(self, chunks: DataFrame, docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, share: float = MIN_SHARE, shard_docs: int = SHARD_DOCS):
        of_doc = docs.where("doc_id IS NOT NULL").select("doc_id", site_of("url").alias("site")).groupBy("doc_id").agg(F.min("site").alias("site")).where("site IS NOT NULL")
        sizes = of_doc.groupBy("site").agg(F.count("*").alias("site_docs")).where(F.col("site_docs") >= min_docs)
        sizes = sizes.withColumn("shards", F.ceil(F.col("site_docs") / shard_docs).cast("int"))
        placed = merge(of_doc).join(merge(sizes), "site").withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.col("shards")).cast("int"))
        per = placed.groupBy("site", "shard").agg(F.count("*").alias("shard_docs"))
        placed = merge(placed).join(merge(per), ["site", "shard"])
        cols = ["doc_id", "site", "shard", "shards", "site_docs", "shard_docs"]
        self.rows = materialize(merge(keyed(chunks, min_chars)).join(merge(placed.select(cols)), "doc_id").distinct(), "lines")
        found = materialize(map_groups(self.rows, ["site", "shard"], _local(min_docs, share), "site string, block array<long>, n long, below long"), "candidates")
        many = sizes.where("shards > 1")
        # documents that shards without a candidate may add at most
        below = F.sum(F.greatest(F.ceil(F.col("shard_docs") * share - F.lit(1e-9)), F.lit(1)) - 1).alias("unseen")
        bound = merge(many).join(merge(per.groupBy("site").agg(below)), "site")
        seen = found.groupBy("site", "block").agg(F.sum(F.col("n") - F.col("below")).alias("surplus"))
        most = F.col("surplus") + F.col("unseen")
        blocks = merge(seen).join(merge(bound), "site").where((most >= min_docs) & (most >= F.col("site_docs") * share - F.lit(1e-9))).select("site", "block", "shards")
        probes = blocks.select("site", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), "block")
        typed = lambda df: df.select("site", "shard", *(c if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in (("doc_id", "long"), ("chunk_id", "long"), ("seq", "int"), ("keys", "array<long>"), ("block", "array<long>"))))
        split = self.rows.where("shards > 1")
        counted = map_groups(typed(split).unionByName(typed(probes)), ["site", "shard"], _count, "site string, block array<long>, n long")
        total = counted.groupBy("site", "block").agg(F.sum("n").alias("n"))
        single = merge(found.drop("below")).join(merge(many.select("site")), "site", "left_anti")
        enough = (F.col("n") >= min_docs) & (F.col("n") >= F.col("site_docs") * share - F.lit(1e-9))
        self.accepted = materialize(merge(single.unionByName(total)).join(merge(sizes), "site").where(enough).select("site", "block", "n", "site_docs", "shards"), "blocks")

    def blocks(self) -> DataFrame:
        """(site, lines, docs, site_docs, line_keys): the repeated blocks."""
        return self.accepted.select("site", F.size("block").alias("lines"), F.col("n").alias("docs"), "site_docs", F.array_join(F.transform("block", lambda x: F.hex(x)), " ").alias("line_keys"))

    def lines(self) -> DataFrame:
        """(chunk_id, line_nos): the lines of each chunk that stand in an accepted block."""
        # a block's lines are each in as many documents
        keys = self.accepted.groupBy("site", "shards").agg(F.array_distinct(F.flatten(F.collect_list("block"))).alias("accepted"))
        keys = keys.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).drop("shards")
        at = F.transform("keys", lambda k, i: F.when(F.array_contains("accepted", k), i))
        hit = merge(self.rows).join(merge(keys), ["site", "shard"]).select("chunk_id", F.array_compact(at).alias("line_nos"))
        return hit.where(F.size("line_nos") > 0).distinct()

    def found(self) -> DataFrame:
        """(chunk_id, line_no) of every repeated line."""
        return self.lines().select("chunk_id", F.explode("line_nos").alias("line_no")).distinct()

    def clean(self, chunks: DataFrame) -> DataFrame:
        """(chunk_id, text) of all chunks, without the repeated lines."""
        kept = F.array_join(F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains("line_nos", i)), "\n")
        rows = merge(chunks.select("chunk_id", "text").distinct()).join(merge(self.lines()), "chunk_id", "left")
        return rows.select("chunk_id", F.when(F.col("line_nos").isNull(), F.col("text")).otherwise(kept).alias("text"))
