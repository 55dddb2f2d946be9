"""Nearest neighbours by inner product with multiprobe p-stable hashing.

Vectors are scaled to unit length in one more dimension, so that the largest inner product is the least distance.
Each of ``TABLES`` tables hashes a vector by the slots of width ``WIDTH`` into which a few Gaussian projections fall; the
number of projections grows with the number of vectors. A query visits the buckets that hold vectors in the order of
estimated success, the chance that a neighbour lies there: given a query's projection z, that of a neighbour with cosine c
is normal around c z with variance 1 - c^2. (The chance for each vector held would look at fewer vectors, but in more
buckets, and costs more.) Each query has a c of its own, in two passes. The first guesses it from the query's cosines with a bounded sample (``SAMPLE`` vectors by hash). The k-th best
score it finds is no more than the true one, so the second pass takes that for c and visits what is still missing until the
tables together reach the share of the chance at which, within the sample, neighbours of that rank are found with
``RECALL``. Candidates of all tables are merged and ranked by their exact inner products in double precision. A query that
finds fewer than it should, or whose k-th best score isn't positive, visits all buckets. Every valid vector is indexed; no
partners are capped.

Equal vectors are one class and hashed once; of a class only the ``k + 1`` least ids can ever be among k nearest, so
these alone travel on. Buckets over ``CHUNK`` classes are dealt in chunks, and so are the queries that visit them: a
task holds one chunk of each. Chunks give their best k + 1 classes for each query.

Vectors that are null, zero or hold a null or non-finite component take no part, nor do vectors of another length than
most, nor rows with a null id. Rows that share an id and a vector count once. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import cut, table

TABLES, WIDTH, SLOTS = 2, 1.0, 4
RECALL = 0.95
SAMPLE = 2000
#: Queries of the sample that the share is fitted on, and the shares of the estimated chance that are tried.
CALIBRATE = 400
SHARES = (0.8, 0.85, 0.9, 0.925, 0.95, 0.965, 0.975, 0.985, 0.995, 0.999)
CHUNK = 4096
K = 20
QUERY_EVERY = 20


def valid(v: Column) -> Column:
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(v, lambda x: x != 0), F.lit(False))


class Tables:
    """The hash functions. Slots run from -SLOTS to SLOTS - 1; the outermost are open."""

    def __init__(self, sample: np.ndarray, functions: int, norm: float, nearest: float, recall: float = RECALL, tables: int = TABLES, seed: int = 7):
        """nearest: the share of all vectors that are a query's nearest."""
        rng = np.random.default_rng(seed)
        self.directions = rng.standard_normal((tables, sample.shape[1] + 1, functions))
        self.shifts = rng.uniform(0, WIDTH, (tables, functions))
        self.norm, self.sample, self.nearest = norm, sample / norm, nearest
        self.share = 1 - (1 - recall) ** (1 / tables)
        self.combos = np.array(list(product(range(2 * SLOTS), repeat=functions)))
        self.codes = self.combos @ (2 * SLOTS) ** np.arange(functions)
        self.held = np.ones((tables, len(self.codes)))

    def count(self, rows: list[tuple[int, int, int]]) -> None:
        """Take in how many vectors the buckets hold: (table, bucket, n)."""
        self.held[:] = 0
        place = np.argsort(self.codes)
        for t, bucket, n in rows:
            self.held[t, place[bucket]] = n

    def calibrate(self, recall: float) -> None:
        """Take the least share of the estimated chance at which the sample's own neighbours, of the rank that is asked for, are found often enough."""
        own = self.sample[:CALIBRATE]
        rank = max(1, round(self.nearest * len(self.sample)))
        if len(self.sample) <= rank:
            return
        cosines = self.lift(own * self.norm, True)[:, :-1] @ self.sample.T
        cosines[np.arange(len(own)), np.arange(len(own))] = -np.inf
        near = np.argsort(-cosines, axis=1)[:, rank - 1]
        bound = np.take_along_axis(cosines, near[:, None], 1)[:, 0]
        y, place = self.lift(own * self.norm, True), np.argsort(self.codes)
        at = [place[b] for b in self.buckets(self.sample[near] * self.norm)]
        chances = [self.chances(y, t, bound) for t in range(len(self.directions))]
        for goal in SHARES:
            self.share = 1 - (1 - goal) ** (1 / len(self.directions))
            found = np.zeros(len(own), bool)
            for t, chance in enumerate(chances):
                found |= self.visit(chance, np.zeros(chance.shape, bool), t)[np.arange(len(own)), at[t]]
            if found[bound <= np.median(bound)].mean() >= recall:  # those whose neighbours are farther
                return

    def lift(self, x: np.ndarray, query: bool) -> np.ndarray:
        if query:
            return np.concatenate([x / np.linalg.norm(x, axis=1, keepdims=True), np.zeros((len(x), 1))], 1)
        x = x / self.norm
        return np.concatenate([x, np.sqrt(np.maximum(0, 1 - (x**2).sum(1, keepdims=True)))], 1)

    def buckets(self, x: np.ndarray) -> list[np.ndarray]:
        """The bucket of each vector in each table."""
        y, size = self.lift(x, False), (2 * SLOTS) ** np.arange(self.shifts.shape[1])
        return [(np.clip(np.floor((y @ d + s) / WIDTH), -SLOTS, SLOTS - 1).astype(np.int64) + SLOTS) @ size for d, s in zip(self.directions, self.shifts, strict=True)]

    def guess(self, x: np.ndarray) -> np.ndarray:
        """Each query's cosine with its farthest wanted neighbour, as far as the sample tells."""
        return np.quantile(self.lift(x, True)[:, :-1] @ self.sample.T, 1 - self.nearest, axis=1)

    def chances(self, y: np.ndarray, table: int, cosine: np.ndarray) -> np.ndarray:
        """For each query the chance of each bucket to hold a neighbour with the query's cosine."""
        c, s = np.clip(cosine, 0.0, 0.999)[:, None, None], self.shifts[table]
        edges, z = np.arange(-SLOTS + 1, SLOTS) * WIDTH, y @ self.directions[table]
        normal = np.vectorize(lambda t: 0.5 * (1 + math.erf(t / math.sqrt(2))), otypes=[float])
        below = normal((edges[None, None, :] - s[None, :, None] - c * z[:, :, None]) / np.sqrt(1 - c**2))
        chance = np.diff(np.concatenate([np.zeros((*z.shape, 1)), below, np.ones((*z.shape, 1))], 2), axis=2)
        each = np.prod([chance[:, f, self.combos[:, f]] for f in range(z.shape[1])], axis=0) * (self.held[table] > 0)
        return each / np.maximum(each.sum(1, keepdims=True), 1e-300)

    def visit(self, chance: np.ndarray, seen: np.ndarray, table: int) -> np.ndarray:
        """Which buckets to visit besides those seen, the likeliest first, until the share is reached; empty ones never."""
        full = self.held[table] > 0
        order = np.argsort(np.where(seen | ~full, np.inf, -chance), axis=1, kind="stable")
        before = (chance * seen).sum(1, keepdims=True) + np.cumsum(np.take_along_axis(chance * ~seen, order, 1), axis=1) - np.take_along_axis(chance * ~seen, order, 1)
        out = np.zeros_like(seen)
        np.put_along_axis(out, order, before < self.share, axis=1)
        return out & ~seen & full

    def probes(self, x: np.ndarray, bound: np.ndarray | None = None) -> list[list[np.ndarray]]:
        """For each table and query the buckets to visit. bound: the cosine that the first pass reached; gives the buckets of the second."""
        y, guess, out = self.lift(x, True), self.guess(x), []
        for t in range(len(self.directions)):
            picked = self.visit(self.chances(y, t, guess), np.zeros((len(x), len(self.codes)), bool), t)
            if bound is not None:
                more = self.visit(self.chances(y, t, bound), picked, t)
                picked = np.where((bound > 0)[:, None], more, ~picked & (self.held[t] > 0))
            out.append([self.codes[r] for r in picked])
        return out


def _matrix(column: pa.Array) -> np.ndarray:
    if not len(column):
        return np.zeros((0, 1))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _bytes(x: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in np.ascontiguousarray(x)], pa.binary())


def _rows(tables, probing: bool, again: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 1024):
                batch = whole.slice(lo, 1024)
                x, ids = _matrix(batch.column("v")), batch.column("class").to_numpy()
                packed = np.array([r.tobytes() for r in x], object)
                bound = batch.column("bound").to_numpy(zero_copy_only=False) if again else None
                per = tables.value.probes(x, bound) if probing else [[np.array([b]) for b in t] for t in tables.value.buckets(x)]
                for t, codes in enumerate(per):
                    who = np.repeat(np.arange(len(x)), [len(c) for c in codes])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(who), t, np.int32)), pa.array(np.concatenate(codes)), pa.array(ids[who]), pa.array(packed[who].tolist(), pa.binary())], names=["t", "bucket", "class", "v"])

    return run


def _best(k: int):
    def run(index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(index) or not len(queries):
            return pd.DataFrame({"query": [], "found": [], "score": []}).astype({"query": "int64"})
        order = np.argsort(index["class"].to_numpy(), kind="stable")
        ids = index["class"].to_numpy()[order]
        x = np.stack([np.frombuffer(b, np.float64) for b in index["v"]])[order]
        q = np.stack([np.frombuffer(b, np.float64) for b in queries["v"]])
        n = min(k + 1, len(ids))
        found, scores = [], []
        for lo in range(0, len(q), 256):
            s = q[lo : lo + 256] @ x.T
            if n < len(ids):
                # All that tie with the last one in stay in, so that ids may decide later.
                edge = np.partition(s, len(ids) - n, axis=1)[:, len(ids) - n]
                keep = [np.nonzero(r >= e - 1e-9)[0] for r, e in zip(s, edge, strict=True)]
            else:
                keep = [np.arange(len(ids))] * len(s)
            found += [ids[a] for a in keep]
            scores += [s[i, a] for i, a in enumerate(keep)]
        return pd.DataFrame({"query": queries["class"].to_numpy(), "found": found, "score": scores})

    return run


def nearest(df: DataFrame, is_query: Column, vec_id: str = "vec_id", vector: str = "embedding", k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows that is_query picks, against all rows but the query's own."""
    spark = df.sparkSession
    rows = df.where(F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")).where(valid(F.col("v")))
    dims = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).alias("norm")).orderBy(F.desc("n"), "dim").limit(1).first()
    empty = "query_id long, rank int, vec_id long, score double"
    if dims is None:
        return spark.createDataFrame([], empty)
    rows = rows.where(F.size("v") == dims["dim"])
    # A class's k + 1 least ids; the limit is applied before rows are shuffled.
    first = rows.select("id", "v").withColumn("n", F.dense_rank().over(Window.partitionBy("v").orderBy("id"))).where(F.col("n") <= k + 1)
    classes = cut(first.groupBy("v").agg(F.sort_array(F.collect_set("id")).alias("ids")).select(F.col("ids")[0].alias("class"), "ids", "v"), "classes")
    asked = cut(rows.where("q").select("id", "v").distinct().join(classes.select("class", "v"), "v").select(F.col("id").alias("query_id"), "class"), "asked")
    wanted = classes.join(asked.select("class").distinct(), "class", "left_semi").select("class", "v")
    n = classes.count()
    total = rows.select("id").distinct().count()
    sample = np.array([r["v"] for r in classes.select("v", "class").orderBy(F.xxhash64("class"), "class").limit(SAMPLE).collect()])
    functions = max(2, min(4, round(math.log2(max(n, 2)) / 8)))
    made = Tables(sample, functions, dims["norm"], k / max(n, k + 1))
    schema = "t int, bucket long, class long, v binary"
    index = cut(classes.select("class", "v").mapInArrow(_rows(spark.sparkContext.broadcast(made), False), schema), "index")
    # There are TABLES x (2 x SLOTS)^functions buckets at most: few enough to collect and to broadcast.
    made.count([tuple(r) for r in index.groupBy("t", "bucket").count().collect()])
    made.calibrate(RECALL)
    tables = spark.sparkContext.broadcast(made)

    def search(queries: DataFrame, again: bool) -> DataFrame:
        probes = queries.mapInArrow(_rows(tables, True, again), schema)
        held = index.groupBy("t", "bucket").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
        probes = cut(probes.join(F.broadcast(held), ["t", "bucket"]), "probes")
        visits = probes.groupBy("t", "bucket").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("parts"))
        left = index.join(F.broadcast(held.join(visits, ["t", "bucket"])), ["t", "bucket"]).withColumn("chunk", F.pmod(F.xxhash64("class"), "chunks").cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        right = probes.join(F.broadcast(visits), ["t", "bucket"]).withColumn("part", F.pmod(F.xxhash64("class"), "parts").cast("int")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        keys = ["t", "bucket", "chunk", "part"]
        best = left.select(*keys, "class", "v").groupBy(*keys).cogroup(right.select(*keys, "class", "v").groupBy(*keys)).applyInPandas(_best(k), "query long, found array<long>, score array<double>")
        pairs = best.select("query", F.explode(F.arrays_zip("found", "score")).alias("x")).groupBy("query", F.col("x.found").alias("found")).agg(F.max("x.score").alias("score"))
        ids = pairs.join(classes.select(F.col("class").alias("found"), "ids"), "found").select("query", "score", F.explode("ids").alias("vec_id"))
        top = ids.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).where(F.col("n") <= k + 1)
        return cut(top.select("query", "vec_id", "score"), "found")

    found = search(wanted, False)
    reached = found.groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("score")).where(F.col("n") >= min(k + 1, total))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    bound = F.coalesce(F.col("score") / (length * dims["norm"]), F.lit(0.0))
    missing = wanted.join(reached.select(F.col("query").alias("class"), "score"), "class", "left").select("class", "v", bound.alias("bound"))
    found = found.unionByName(search(missing, True)).groupBy("query", "vec_id").agg(F.max("score").alias("score"))
    out = asked.join(found.withColumnRenamed("query", "class"), "class").where("vec_id <> query_id")
    ranked = out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op8_multiprobe_lsh(spark, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % QUERY_EVERY == 0)
