"""Problem 9: sources mixed to target weights.

Documents are counted in tokens of a public tokenizer and packed, source by source, into blocks of BLOCK tokens. Each of
output shards (of about SLOTS blocks) draws multinomial counts of its sources; a source's slots are numbered over all shards, and slot
j holds block perm(j mod n) of pass j div n, where perm is a keyed permutation of the source's n blocks. Slots and blocks
meet in a join by index; a source has no more than max_repeats passes, and slots beyond them are refused. Packing sorts a source's documents in
lanes of about LANE tokens, so neither a task nor an array grows with the data.

Source names are compared trimmed and in lower case; documents without a source count for the total only. A null text
has 0 tokens. Every document row counts. Equal target rows count once; of several targets of one source the largest
share and repeats hold, a null share is 0 and null repeats are 1. A source without documents delivers nothing.
"""

from __future__ import annotations

import base64
import functools
import math

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm import kernel as K
from corpusloom.llm.stream import map_batches, merge
from corpusloom.plans.shared import materialize

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the public pre-tokenizing pattern that belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK, SLOTS, LANE, SEED = 2048, 8192, 1 << 24, 20240301
_PART = 1 << 17
DEVIATIONS = 6


@functools.cache
def _encoding(vocabulary: str):
    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str | None, vocabulary: str = VOCABULARY) -> int:
    """Tokens of the text; one beyond _PART characters is counted in parts that end at a blank where there is one."""
    if not text:
        return 0
    enc, n, i = _encoding(vocabulary), 0, 0
    while i < len(text):
        j = min(len(text), i + _PART)
        if j < len(text) and (cut := max(text.rfind(" ", i + 1, j), text.rfind("\n", i + 1, j))) > i:
            j = cut
        n += len(enc.encode_ordinary(text[i:j]))
        i = j
    return n


def sized(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, n_tokens), source trimmed and in lower case."""

    def fn(b: pa.RecordBatch) -> dict:
        return {"doc_id": b["doc_id"], "source": b["source"], "n_tokens": [count_tokens(t, vocabulary) for t in b["text"].to_pylist()]}

    name = F.nullif(F.lower(F.trim("source")), F.lit(""))
    return map_batches(documents.select("doc_id", name.alias("source"), "text"), fn, "doc_id long, source string, n_tokens long")


def permuted(index: np.ndarray, n: np.ndarray, key: np.ndarray, rounds: int = 4) -> np.ndarray:
    """A keyed permutation of 0..n-1 for each row: a Feistel network over the next even number of bits, walked until it falls inside."""
    half = np.array([max(1, (max(1, int(x) - 1).bit_length() + 1) // 2) for x in n], np.uint64)
    mask = (K.U(1) << half) - K.U(1)
    out, todo = index.astype(K.U), np.ones(len(index), bool)
    size, key = n.astype(K.U), key.astype(K.U)
    while todo.any():
        x, h, m, k = out[todo], half[todo], mask[todo], key[todo]
        left, right = x >> h, x & m
        for r in range(rounds):
            left, right = right, left ^ (K.mix(right + k * K.U(K.STEP) + K.U(r)) & m)
        out[todo] = (left << h) | right
        todo = out >= size
    return out.astype(np.int64)


class Mixture:
    """A selection of blocks in which each source has its target share of `total` tokens (all documents' by default)."""

    def __init__(self, documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY, block: int = BLOCK, shards: int | None = None, seed: int = SEED, total: int | None = None):
        self.spark, self.block, self.seed = documents.sparkSession, block, seed
        self.sizes = materialize(sized(documents, vocabulary), "sizes")
        name = F.nullif(F.lower(F.trim("source")), F.lit(""))
        share, repeats = F.coalesce(F.col("target_share"), F.lit(0.0)), F.coalesce(F.col("max_repeats"), F.lit(1))
        self.targets = targets.select(name.alias("source"), share.alias("share"), repeats.alias("repeats")).where("source IS NOT NULL").groupBy("source").agg(F.max("share").alias("target_share"), F.max("repeats").alias("max_repeats"))
        own = self.sizes.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n_docs"))
        # targets are settings, a few rows; what is broadcast below is theirs, or a single row
        whole = F.lit(total).cast("long") if total is not None else F.col("all_tokens")
        every = own.agg(F.coalesce(F.sum("tokens"), F.lit(0)).cast("long").alias("all_tokens"))
        plan = self.targets.join(own, "source", "left").crossJoin(F.broadcast(every)).withColumn("whole", whole)
        plan = plan.withColumn("tokens", F.coalesce("tokens", F.lit(0)).cast("long")).withColumn("n_docs", F.coalesce("n_docs", F.lit(0)).cast("long"))
        plan = plan.select("source", "target_share", "max_repeats", "tokens", "n_docs", "whole", F.ceil(F.col("tokens") / block).cast("long").alias("blocks"), F.ceil(F.greatest("tokens", F.lit(1)) / LANE).cast("long").alias("lanes"))
        rows = plan.collect()  # a row a target
        self.plan = self.spark.createDataFrame(rows, plan.schema)
        self.shards = shards or max(1, math.ceil(sum(max(0.0, r.target_share) * r.whole for r in rows) / block / SLOTS))

    def packed(self) -> DataFrame:
        """(source, idx, doc_id, from_token, to_token): which tokens of which documents make up each block.

        Documents lie end to end in the order (lane, doc_id)."""
        s = self.sizes.join(F.broadcast(self.plan.select("source", "lanes")), "source").where("n_tokens > 0").withColumn("lane", F.pmod(F.xxhash64("doc_id"), "lanes"))
        lanes = s.groupBy("source", "lane").agg(F.sum("n_tokens").alias("w"))
        before = Window.partitionBy("source").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
        lanes = lanes.select("source", "lane", F.coalesce(F.sum("w").over(before), F.lit(0)).alias("base"))
        inside = Window.partitionBy("source", "lane").orderBy("doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        placed = merge(s.withColumn("upto", F.sum("n_tokens").over(inside))).join(merge(lanes), ["source", "lane"])
        end = F.col("base") + F.col("upto")
        placed = placed.select("source", "doc_id", (end - F.col("n_tokens")).alias("start"), end.alias("end"))
        idx = F.explode(F.sequence(F.expr(f"start div {self.block}"), F.expr(f"(end - 1) div {self.block}")))
        parts = placed.withColumn("idx", idx)
        lo, hi = F.greatest("start", F.col("idx") * self.block), F.least("end", (F.col("idx") + 1) * self.block)
        return parts.select("source", "idx", "doc_id", (lo - F.col("start")).alias("from_token"), (hi - F.col("start")).alias("to_token"))

    def drawn(self) -> DataFrame:
        """(source, shard, drawn): the multinomial counts of each shard."""
        block, shards, seed = self.block, self.shards, self.seed
        # a row a shard carries the few targets; counts are drawn, numbered and expanded without leaving the cluster
        rows = self.plan.agg(F.collect_list(F.struct("source", "target_share", "whole")).alias("plan"), F.max("whole").alias("whole"))
        table = self.spark.range(0, shards, 1, min(shards, 16)).withColumnRenamed("id", "shard").crossJoin(F.broadcast(rows))

        def draw(b: pa.RecordBatch) -> dict:
            out: dict[str, list] = {"shard": [], "source": [], "drawn": []}
            for shard, plan, whole in zip(b["shard"].to_pylist(), b["plan"].to_pylist(), b["whole"].to_pylist()):
                plan = sorted(plan or [], key=lambda r: r["source"])
                p = np.array([max(0.0, r["target_share"]) for r in plan])
                total = math.ceil((whole or 0) / block * p.sum())
                n = total // shards + (shard < total % shards)
                if n and p.sum() > 0:
                    for r, c in zip(plan, np.random.default_rng([seed, shard]).multinomial(n, p / p.sum())):
                        for k, v in zip(out, (shard, r["source"], int(c))):
                            out[k].append(v)
            return out

        return map_batches(table, draw, "shard long, source string, drawn long")

    def slots(self) -> DataFrame:
        """(source, shard, slot, pass, idx): the block of each slot, with no more than max_repeats passes over a source."""
        seed, drawn = self.seed, self.drawn()
        before = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
        drawn = drawn.withColumn("base", F.coalesce(F.sum("drawn").over(before), F.lit(0))).where("drawn > 0")
        num = drawn.select("source", "shard", F.explode(F.sequence(F.col("base"), F.col("base") + F.col("drawn") - 1)).alias("slot"))
        num = num.join(F.broadcast(self.plan.select("source", "blocks", "max_repeats")), "source").where("slot < blocks * max_repeats")

        def place(b: pa.RecordBatch) -> dict:
            slot, n = (np.array(b[c].to_pylist(), np.int64) for c in ("slot", "blocks"))
            source = b["source"].to_pylist()
            turn = slot // n
            names = {s: int(K.RunHash(K.codes(s))(np.array([0]), np.array([len(s)]))[0]) for s in set(source)}
            key = np.array([names[s] for s in source], K.U) + turn.astype(K.U) * K.U(K.BASE) + K.U(seed)
            return {"source": source, "shard": b["shard"], "slot": slot, "pass": turn, "idx": permuted(slot % n, n, key)}

        return map_batches(num, place, "source string, shard long, slot long, pass long, idx long")

    def selection(self) -> DataFrame:
        """(shard, slot, source, pass, idx, doc_id, from_token, to_token): the mixture."""
        return merge(self.slots()).join(merge(self.packed()), ["source", "idx"])

    def report(self) -> DataFrame:
        """A row a target: supply and demand in tokens, what was delivered, actual share and repeats, and whether the source falls short."""
        got = self.selection().groupBy("source").agg(F.sum(F.col("to_token") - F.col("from_token")).alias("delivered"), F.max("pass").alias("last"))
        asked = self.drawn().groupBy("source").agg(F.sum("drawn").alias("drawn"))
        r = self.plan.join(got, "source", "left").join(asked, "source", "left").withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("delivered", "drawn")})
        out = F.sum("delivered").over(Window.partitionBy(F.lit(1)))  # one row a target
        return r.select(
            "source",
            "target_share",
            "max_repeats",
            "tokens",
            "n_docs",
            (F.col("tokens") * F.col("max_repeats")).alias("supply"),
            (F.col("whole") * F.col("target_share")).alias("demand"),
            "delivered",
            "drawn",
            F.greatest(F.col("drawn") - F.col("blocks") * F.col("max_repeats"), F.lit(0)).cast("long").alias("refused"),
            F.when(out > 0, F.col("delivered") / out).otherwise(0.0).alias("actual_share"),
            F.when(F.col("tokens") > 0, F.col("delivered") / F.col("tokens")).otherwise(0.0).alias("repeats"),
            (F.col("tokens") * F.col("max_repeats") < F.col("whole") * F.col("target_share")).alias("short"),
        )

    def short(self) -> DataFrame:
        """(source) of the targets that the mixture leaves unmet for want of supply.

        Those whose draw had slots refused by the cap on repeats, or came so close to the cap that chance may have spared it
        (within DEVIATIONS of a multinomial count, and a block for each pass); the token sums decide among them."""
        asked = self.drawn().groupBy("source").agg(F.sum("drawn").alias("drawn"))
        near = F.col("drawn") + DEVIATIONS * F.sqrt("drawn") + F.col("max_repeats") + 1 > F.col("blocks") * F.col("max_repeats")
        return self.plan.join(asked, "source").where(near).where(F.col("tokens") * F.col("max_repeats") < F.col("whole") * F.col("target_share")).select("source")
