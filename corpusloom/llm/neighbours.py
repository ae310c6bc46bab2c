"""Problem 5: the most similar vectors of every vector.

Multi-index hashing. Rotations learned by iterative quantization on a bounded sample of each model's vectors give every
vector a code of CODE bits, cut into substrings of about log2(n) bits; each substring is a table. Two codes that differ in
fewer bits than there are substrings agree in one of them (pigeonhole), so equal substrings retrieve every code within that radius;
beyond it codes are met with a probability that the fit measures: the substrings are shortened until they retrieve RECALL of the
neighbours at least LEAST similar that QUERIES sampled vectors have among all rows. What meets is compared by the whole code, in
numpy inside the bucket, and pairs at most FAR bits apart are ranked by their floats: vectors are not centred, so bits differ in
proportion to the angle, 37 of CODE at a cosine of 0.9 with a deviation of 6. `mutual` reads this index.

A bucket above BUCKET rows, or one whose rows are nearly all near each other, gives no pairs: its rows are compared by their floats
in blocks that keep k+1 neighbours a row. Keys that a thousandth of all rows have go that way at once. So nothing is dropped, no task
holds more than two blocks, and a crowd of rows in one bucket costs no pair a row and row.

Neighbours farther apart than LEAST have codes like any two vectors', which no radius tells from the rest; so `neighbours` compares all rows of a
model, in a grid of blocks of GRID rows: exact, at a cost that is quadratic in the rows.

Copies of one vector are indexed once, with the k+1 smallest ids, which is all that their neighbours can see.

Vectors that are null, empty, zero, not finite, or of a length other than dim are left out, as are rows without
chunk_id or model. Equal duplicate rows count once; several vectors of one chunk and model are one row each and not
each other's neighbours. Ties go to the smaller id. `search` compares a stated set of queries with all rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm import kernel as K
from corpusloom.llm.stream import map_batches, merge
from corpusloom.plans.shared import materialize

CODE, SAMPLE, SAMPLES, ROUNDS, FAR, SEED = 256, 4000, 1 << 16, 15, 64, 7  # at most SAMPLE vectors a model and SAMPLES in all are fitted on
BUCKET, DENSE, BLOCK, GRID, HOT = 2048, 8, 1024, 1 << 15, 1024
LEAST, RECALL, QUERIES = 0.9, 0.99, 500


def usable(vectors: DataFrame) -> DataFrame:
    """(chunk_id, model, vec) of the vectors that have a direction."""
    v = vectors.select("chunk_id", "model", "dim", F.col("vec").cast("array<float>").alias("vec")).where("chunk_id IS NOT NULL AND model IS NOT NULL AND vec IS NOT NULL AND size(vec) > 0 AND size(vec) = dim")
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.where(finite & F.exists("vec", lambda x: x != 0)).select("chunk_id", "model", "vec")


def _matrix(vecs: list) -> np.ndarray:
    return _unit(np.array(vecs, np.float64))


def learned_rotation(x: np.ndarray, rng: np.random.Generator, rounds: int = ROUNDS) -> np.ndarray:
    """Iterative quantization: the rotation under which signs lose least, from a random start."""
    dim = x.shape[1]
    r = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    for _ in range(rounds):
        z = x @ r
        u, _, vt = np.linalg.svd(np.where(z >= 0, 1.0, -1.0).T @ x)
        r = vt.T @ u.T
    return r


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _stacked(vecs: pa.Array) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(dim, rows, unit vectors as a matrix) of a list column, one for each length, without a Python object a number."""
    sizes = pc.list_value_length(vecs).to_numpy(zero_copy_only=False)
    out = []
    for dim in np.unique(sizes):
        at = np.flatnonzero(sizes == dim)
        flat = (vecs if len(at) == len(vecs) else vecs.take(pa.array(at))).flatten().to_numpy(zero_copy_only=False)
        out.append((int(dim), at, _unit(flat.astype(np.float64).reshape(len(at), dim))))
    return out


def _by_model(b: pa.RecordBatch):
    """(model, dim, rows, unit vectors) for each model and length."""
    models = np.array(b["model"].to_pylist(), object)
    for dim, at, x in _stacked(b["vec"]):
        for m in set(models[at]):
            own = models[at] == m
            yield m, dim, at[own], x[own]


def tuned(equal: np.ndarray, bits: int) -> int:
    """The most bits a substring, up to `bits`, that retrieve RECALL of the pairs (equal bits of two neighbours)."""
    while bits > 4 and equal[:, : CODE // bits * bits].reshape(len(equal), CODE // bits, bits).all(axis=2).any(axis=1).mean() < RECALL:
        bits -= 1
    return bits


def _top(ids: np.ndarray, others: np.ndarray, near: np.ndarray, n: int) -> np.ndarray:
    """Positions of the n nearest of each id, by (similarity, smaller other)."""
    order = np.lexsort((others, -near, ids))
    first = np.flatnonzero(np.diff(ids[order], prepend=ids[order[:1]] - 1))
    place = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
    return order[place < n]


def nearest_across(ids: np.ndarray, x: np.ndarray, others: np.ndarray, y: np.ndarray, n: int, both: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, other, similarity): the n nearest rows of y for each of x, and with both also the other way round.

    A row's n-th nearest among the first rows of the other side bounds what can be among its nearest; only what
    passes in single precision is ranked, in double. Equal ids are one row and don't meet."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    u, v = x.astype(np.float32), y.astype(np.float32)

    def bound(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        if len(q) <= n + 1:
            return np.full(len(p), -3, np.float32)
        part = q[: 2 * BLOCK]
        # one more than n, as a row may meet itself
        return np.concatenate([np.partition(p[i : i + BLOCK] @ part.T, len(part) - n - 1, axis=1)[:, -n - 1] for i in range(0, len(p), BLOCK)]) - np.float32(1e-5)

    low, high = bound(u, v), bound(v, u) if both else None
    for i in range(0, len(u), BLOCK):
        s = u[i : i + BLOCK] @ v.T
        for hit, turn in ((s >= low[i : i + BLOCK, None], False), *([(s >= high[None, :], True)] if both else [])):
            a, b = np.nonzero(hit)
            keep = ids[i + a] != others[b]
            a, b = i + a[keep], b[keep]
            if turn:
                some = _top(b, ids[a], s[a - i, b], n + 4)
                found.append((a[some] + len(v), b[some]))
            else:
                some = _top(a, others[b], s[a - i, b], n + 4)
                found.append((a[some], b[some]))
    out = []
    for turn in (False, True)[: 1 + both]:
        own = [(a - len(v) * turn, b) for k, (a, b) in enumerate(found) if (k % 2 == 1 if both else False) == turn]
        a, b = (np.concatenate([z[k] for z in own]) if own else np.zeros(0, np.int64) for k in (0, 1))
        near = np.concatenate([np.einsum("ij,ij->i", x[a[i : i + (1 << 18)]], y[b[i : i + (1 << 18)]]) for i in range(0, len(a), 1 << 18)]) if len(a) else np.zeros(0)
        left, right = (others[b], ids[a]) if turn else (ids[a], others[b])
        some = _top(left, right, near, n)
        out.append((left[some], right[some], near[some]))
    return tuple(np.concatenate([o[k] for o in out]) for k in range(3))


def _pairs_inside(key: np.ndarray, code: np.ndarray):
    """Of rows sorted by key: (bucket of each row, positions i < j of equal keys at most FAR bits apart), walked by distance in the order."""
    bucket = np.cumsum(np.diff(key, prepend=key[:1]) != 0)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    at, gap = np.arange(len(key)), 1
    while len(at):
        at = at[at + gap < len(key)]
        at = at[bucket[at] == bucket[at + gap]]
        near = at[np.bitwise_count(code[at] ^ code[at + gap]).sum(axis=1, dtype=np.int64) <= FAR]
        left.append(near)
        right.append(near + gap)
        gap += 1
    return bucket, np.concatenate(left), np.concatenate(right)


def _met(batches):
    """Rows (key, cls, code) sorted by key to (key, a, b): pairs of a bucket near in the code; where it is large or dense its rows instead, with null for b."""
    schema = pa.schema([("key", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])

    def out(key, a, b=None):
        return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(a, pa.int64()), pa.nulls(len(a), pa.int64()) if b is None else pa.array(b, pa.int64())], schema=schema)

    def done(key, cls, code):
        bucket, i, j = _pairs_inside(key, code)
        n = bucket[-1] + 1 if len(bucket) else 0
        size, pairs = np.bincount(bucket, minlength=n), np.bincount(bucket[i], minlength=n)
        dense = pairs > DENSE * size
        rows, keep = dense[bucket], ~dense[bucket[i]]
        yield out(key[rows], cls[rows])
        yield out(key[i][keep], np.minimum(cls[i], cls[j])[keep], np.maximum(cls[i], cls[j])[keep])

    held, large = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, cls = batch["key"].to_numpy(), batch["cls"].to_numpy()
        code = np.frombuffer(b"".join(batch["code"].to_pylist()), K.U).reshape(len(key), -1)
        if held is not None:
            key, cls, code = np.concatenate([held[0], key]), np.concatenate([held[1], cls]), np.concatenate([held[2], code])
        # the last bucket may go on in the next batch; one known to be large is passed on as it comes
        last = np.searchsorted(key, key[-1]) if (key[:-1] <= key[1:]).all() else np.flatnonzero(np.diff(key, prepend=key[:1]) != 0)[-1]
        first, count = np.unique(key, return_counts=True)
        big = set(first[count > BUCKET].tolist()) | ({large} if large is not None else set())
        many = np.isin(key, list(big)) if big else np.zeros(len(key), bool)
        yield out(key[many], cls[many])
        large = int(key[-1]) if int(key[-1]) in big else None
        ready = ~many & (np.arange(len(key)) < last)
        if ready.any():
            yield from done(key[ready], cls[ready], code[ready])
        rest = ~many & (np.arange(len(key)) >= last)
        held = (key[rest], cls[rest], code[rest])
    if held is not None and len(held[0]):
        yield from done(*held)


class VectorIndex:
    def __init__(self, vectors: DataFrame, k: int = 5, sample: int = SAMPLE, seed: int = SEED, fit: bool = True):
        self.spark, self.k = vectors.sparkSession, k
        good = usable(vectors).withColumn("cls", F.xxhash64("model", "vec"))
        # row_number below a bound is applied before the exchange, so a third of all rows with one vector moves as k+1 a partition
        first = Window.partitionBy("cls").orderBy("chunk_id")
        few = good.dropDuplicates(["cls", "chunk_id"]).withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1)
        grouped = few.groupBy("cls", "model").agg(F.array_sort(F.collect_list("chunk_id")).alias("ids"), F.first("vec").alias("vec"))
        self.rows = materialize(grouped, "vectors")
        self.all = good.select("chunk_id", "model", "cls").distinct()
        if fit:
            self._fit(sample, seed)

    def _fit(self, sample: int, seed: int) -> None:
        """Learn each model's rotations on at most `sample` of its vectors, those of the least hashes."""
        models = {(r.model, r.dim): r.n for r in self.rows.groupBy("model", F.size("vec").alias("dim")).agg(F.count("*").alias("n")).collect()}
        self.total = sum(models.values())
        sample = max(1, min(sample, SAMPLES // max(1, len(models))))
        least = Window.partitionBy("model", F.size("vec")).orderBy("cls")
        some = self.rows.withColumn("n", F.row_number().over(least)).where(F.col("n") <= sample).select("model", "vec").collect()
        near = self._true_neighbours(some)
        rotations: dict[tuple[str, int], tuple[np.ndarray, int]] = {}
        for (model, dim), n in models.items():
            x = _matrix([r.vec for r in some if r.model == model and len(r.vec) == dim])
            rng = np.random.default_rng([seed, dim])
            r = np.hstack([learned_rotation(x, rng) for _ in range(-(-CODE // dim))])[:, :CODE].astype(np.float32)
            bits = int(np.clip(np.ceil(np.log2(max(2, n))) - 4, 4, 24))
            if (model, dim) in near:
                on = [_matrix(v).astype(np.float32) @ r >= 0 for v in near[model, dim]]
                bits = tuned(on[0] == on[1], bits)
            rotations[model, dim] = (r, bits)
        self.rotations = self.spark.sparkContext.broadcast(rotations)

    def _true_neighbours(self, some: list) -> dict[tuple[str, int], tuple[list, list]]:
        """For each model the vectors of QUERIES sampled rows and of their neighbours among all rows, by exact search, that are LEAST similar or more."""
        by: dict[tuple[str, int], list] = {}
        for r in some:
            own = by.setdefault((r.model, len(r.vec)), [])
            if len(own) < QUERIES:
                own.append(r.vec)
        queries = self.spark.sparkContext.broadcast({at: _matrix(v) for at, v in by.items()})  # a part of the sample
        n = self.k + 2  # a query finds itself as well

        def fn(b: pa.RecordBatch) -> dict:
            out: dict[str, list] = {"model": [], "dim": [], "q": [], "similarity": [], "vec": []}
            for model, dim, at, x in _by_model(b):
                q = queries.value[model, dim]
                i, j, s = nearest_across(-1 - np.arange(len(q)), q, np.arange(len(x)), x, n, False)
                for c, v in zip(out, ([model] * len(i), [dim] * len(i), -1 - i, s, [y.tobytes() for y in x[j]])):
                    out[c] += list(v)
            return out

        got = map_batches(self.rows.select("cls", "model", "vec"), fn, "model string, dim int, q long, similarity double, vec binary").where(F.col("similarity") >= LEAST)
        best = Window.partitionBy("model", "dim", "q").orderBy(F.desc("similarity"), "vec")
        out: dict[tuple[str, int], tuple[list, list]] = {}
        for r in got.withColumn("n", F.row_number().over(best)).where(F.col("n") <= n - 1).collect():
            own, other = queries.value[r.model, r.dim][r.q], np.frombuffer(r.vec)
            if not np.array_equal(own, other):
                a, b = out.setdefault((r.model, r.dim), ([], []))
                a.append(own)
                b.append(other)
        return out

    def coded(self) -> DataFrame:
        """(cls, code, keys): the whole code, and the key of each substring's table."""
        rotations = self.rotations

        def fn(b: pa.RecordBatch) -> dict:
            code, keys = [b""] * b.num_rows, [None] * b.num_rows
            for model, dim, at, x in _by_model(b):
                r, bits = rotations.value[model, dim]
                on = x.astype(np.float32) @ r >= 0
                own = K.RunHash(K.codes(model))(np.array([0]), np.array([len(model)]))[0] ^ K.U(dim)
                packed, tables = np.packbits(on, axis=1), CODE // bits
                part = on[:, : tables * bits].reshape(len(at), tables, bits) @ (K.U(1) << np.arange(bits, dtype=K.U))
                key = K.signed(K.mix(K.mix(part ^ own) + np.arange(tables, dtype=K.U) * K.U(K.STEP)))
                for i, n in enumerate(at):
                    code[n], keys[n] = packed[i].tobytes(), key[i]
            return {"cls": b["cls"], "code": code, "keys": keys}

        return map_batches(self.rows.select("cls", "model", "vec"), fn, "cls long, code binary, keys array<long>")

    def candidates(self) -> tuple[DataFrame, DataFrame]:
        """(a, b): classes that share a substring and are near in the code, a < b; and (key, cls) of the buckets to compare in blocks."""
        coded = materialize(self.coded(), "codes")
        rows = coded.select("cls", "code", F.explode("keys").alias("key"))
        # at most HOT keys of each table have more than a HOT-th of all rows
        hot = materialize(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > max(BUCKET, self.total // HOT)).select("key"), "hot-keys")
        cold = rows.join(F.broadcast(hot), "key", "left_anti")
        met = materialize(cold.select("key", "cls", "code").repartition("key").sortWithinPartitions("key").mapInArrow(_met, "key long, a long, b long"), "met")
        blocks = met.where("b IS NULL").select("key", F.col("a").alias("cls")).unionByName(rows.join(F.broadcast(hot), "key", "left_semi").select("key", "cls"))
        return met.where("b IS NOT NULL").select("a", "b").distinct(), blocks

    def _ranked(self, pairs: DataFrame) -> DataFrame:
        """(cls, other, similarity) both ways, of candidate pairs."""
        vec = merge(self.rows.select("cls", "vec"))
        both = merge(pairs).join(vec.toDF("a", "vec_a"), "a").join(vec.toDF("b", "vec_b"), "b")

        def fn(b: pa.RecordBatch) -> dict:
            s = np.zeros(b.num_rows)
            # both vectors of a pair are of one model, so of one length
            for (_, at, x), (_, _, y) in zip(_stacked(b["vec_a"]), _stacked(b["vec_b"])):
                s[at] = np.einsum("ij,ij->i", x, y)
            return {"cls": np.concatenate([b["a"].to_numpy(), b["b"].to_numpy()]), "other": np.concatenate([b["b"].to_numpy(), b["a"].to_numpy()]), "similarity": np.concatenate([s, s])}

        return map_batches(both, fn, "cls long, other long, similarity double")

    def _grid(self, rows: DataFrame, keys: list[str], sizes: DataFrame, most: int) -> DataFrame:
        """(cls, other, similarity): the k+1 nearest of each row (keys, cls, vec) among those of equal keys, block by block of at most about `most` rows."""
        n = self.k + 1
        rows = merge(rows).join(merge(sizes.withColumn("blocks", F.ceil(F.col("n") / most).cast("int")).drop("n")), keys)
        rows = rows.withColumn("b", F.pmod(F.xxhash64("cls", F.lit(1)), "blocks").cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        rows = rows.select(*keys, F.least("b", "o").alias("b0"), F.greatest("b", "o").alias("b1"), (F.col("b") > F.col("o")).alias("second"), "cls", "vec")

        def fn(t: pa.Table) -> pa.Table:
            cls, second = t["cls"].to_numpy(), t["second"].to_numpy()
            x = _stacked(t["vec"].combine_chunks())[0][2]
            same = t["b0"][0].as_py() == t["b1"][0].as_py()
            a, b = ~second, (~second if same else second)
            got = nearest_across(cls[a], x[a], cls[b], x[b], n, not same) if a.any() and b.any() else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
            return pa.table(dict(zip(("cls", "other", "similarity"), got)))

        return rows.groupBy(*keys, "b0", "b1").applyInArrow(fn, "cls long, other long, similarity double")

    def _blocked(self, blocks: DataFrame) -> DataFrame:
        """(cls, other, similarity): the k+1 nearest of each row of the large and dense buckets, inside them."""
        rows = merge(blocks).join(merge(self.rows.select("cls", "vec")), "cls")
        return self._grid(rows, ["key"], blocks.groupBy("key").agg(F.count("*").alias("n")), 2 * BLOCK)

    def _all_neighbours(self) -> DataFrame:
        """(cls, other, similarity): the k+1 nearest of each row among all rows of its model."""
        rows = self.rows.select("cls", "model", F.size("vec").alias("dim"), "vec")
        return self._grid(rows, ["model", "dim"], rows.groupBy("model", "dim").agg(F.count("*").alias("n")), GRID)

    def neighbour_lists(self, least: bool = False) -> DataFrame:
        """(cls, id, similarity): the k+1 nearest ids of each class of copies, its own members among them; with least, those that the index finds."""
        if least:
            pairs, blocks = self.candidates()
            near = self._ranked(pairs).unionByName(self._blocked(blocks)).groupBy("cls", "other").agg(F.max("similarity").alias("similarity"))
        else:
            near = self._all_neighbours()
        ids = merge(self.rows.select(F.col("cls").alias("other"), F.explode("ids").alias("id")))
        rank = Window.partitionBy("cls").orderBy(F.desc("similarity"), "other")
        near = near.withColumn("n", F.row_number().over(rank)).where(F.col("n") <= self.k + 1).select("cls", "other", "similarity")
        own = self.rows.select("cls", F.explode("ids").alias("id"), F.lit(1.0).alias("similarity"))
        listed = own.unionByName(merge(near).join(ids, "other").select("cls", "id", "similarity"))
        best = Window.partitionBy("cls").orderBy(F.desc("similarity"), "id")
        return listed.withColumn("n", F.row_number().over(best)).where(F.col("n") <= self.k + 1).select("cls", "id", "similarity")

    def neighbours(self, members: DataFrame | None = None, least: bool = False) -> DataFrame:
        """(chunk_id, neighbour, similarity, rank): the k nearest of every row, with least as far as the index finds them; members limits the rows to some (chunk_id, cls)."""
        rows = self.all.select("chunk_id", "cls") if members is None else members
        listed = merge(rows).join(merge(self.neighbour_lists(least)), "cls").where("chunk_id <> id")
        rank = Window.partitionBy("cls", "chunk_id").orderBy(F.desc("similarity"), "id")
        return listed.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= self.k).select("chunk_id", F.col("id").alias("neighbour"), "similarity", "rank")

    def mutual(self, least: float = 0.9) -> DataFrame:
        """(chunk_id_a, chunk_id_b): pairs at least that similar, each among the other's k nearest."""
        # of copies only the k+1 smallest ids are among any other's nearest
        near = materialize(self.neighbours(self.rows.select(F.explode("ids").alias("chunk_id"), "cls"), least=True).where(F.col("similarity") >= least).select("chunk_id", "neighbour").distinct(), "near")
        back = near.select(F.col("neighbour").alias("chunk_id"), F.col("chunk_id").alias("neighbour"))
        return merge(near).join(merge(back), ["chunk_id", "neighbour"]).where("chunk_id < neighbour").select(F.col("chunk_id").alias("chunk_id_a"), F.col("neighbour").alias("chunk_id_b")).distinct()


def search(queries: DataFrame, vectors: DataFrame, k: int = 5, block: int = 2048, lanes: int = 32) -> DataFrame:
    """(chunk_id, neighbour, similarity, rank): exact nearest rows of a stated set of queries, block against block.

    Blocks of rows are dealt to lanes; each lane gets all blocks of queries, so a model's comparisons spread over all tasks."""

    def blocks(df: DataFrame, name: str) -> DataFrame:
        def fn(it):
            at = 0
            for b in it:
                ids = b["chunk_id"].to_numpy()
                for model, dim, rows, x in _by_model(b):
                    for i in range(0, len(rows), block):
                        at += 1
                        yield pa.RecordBatch.from_pydict({"model": [model], "dim": [dim], "at": [int(ids[rows[i]]) + at], f"ids_{name}": [ids[rows[i : i + block]].tobytes()], f"x_{name}": [x[i : i + block].tobytes()]})

        return df.mapInArrow(fn, f"model string, dim long, at long, ids_{name} binary, x_{name} binary")

    def fn(b: pa.RecordBatch) -> dict:
        out: dict[str, list] = {c: [] for c in ("chunk_id", "neighbour", "similarity")}
        for dim, iq, xq, iv, xv in zip(*(b[c].to_pylist() for c in ("dim", "ids_q", "x_q", "ids_v", "x_v"))):
            q, v = np.frombuffer(iq, np.int64), np.frombuffer(iv, np.int64)
            got = nearest_across(q, np.frombuffer(xq).reshape(len(q), dim), v, np.frombuffer(xv).reshape(len(v), dim), k, False)
            for c, x in zip(out, got):
                out[c].append(x)
        return {c: np.concatenate(x) for c, x in out.items()}

    lane = F.pmod(F.xxhash64("at"), F.lit(lanes))
    q = blocks(usable(queries).distinct(), "q").withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1)))).drop("at")
    pairs = merge(q).join(merge(blocks(usable(vectors).distinct(), "v").withColumn("lane", lane).drop("at")), ["model", "dim", "lane"])
    rank = Window.partitionBy("chunk_id").orderBy(F.desc("similarity"), "neighbour")
    got = map_batches(pairs, fn, "chunk_id long, neighbour long, similarity double")
    return got.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)


def recall(vectors: DataFrame, least: float | None = None, k: int = 5, every: int = 20) -> DataFrame:
    """(true_neighbours, found, recall) of all k nearest against brute force, over the queries whose id is divisible by `every`; with least, of the index and the neighbours at least that similar."""
    index = VectorIndex(vectors, k, fit=least is not None)
    exact = search(vectors.where(F.col("chunk_id") % every == 0), vectors, k).where(F.lit(least is None) | (F.col("similarity") >= F.lit(least))).select("chunk_id", "neighbour")
    members = index.all.where(F.col("chunk_id") % every == 0).select("chunk_id", "cls")
    got = index.neighbours(members, least is not None).select("chunk_id", "neighbour", F.lit(1).alias("hit")).distinct()
    both = merge(exact).join(merge(got), ["chunk_id", "neighbour"], "left")
    n = both.agg(F.count("*").alias("true_neighbours"), F.coalesce(F.sum("hit"), F.lit(0)).alias("found"))
    return n.withColumn("recall", F.when(F.col("true_neighbours") > 0, F.col("found") / F.col("true_neighbours")).otherwise(1.0))
