"""Approximate nearest neighbours by learned partitions.

A bounded sample of vectors gets a neighbour graph (inner product, brute force), which is cut into parts of nearly equal
size: balanced k-means starts the parts, then vectors move to the part that holds most of their neighbours while it has
room. A small classifier (softmax regression) learns from each vector the parts of its neighbours. Every row is indexed
under its most probable part; a query goes to its most probable parts, as many as reach ``RECALL`` on the sample, and
on to more until they hold enough rows. Parts are cut into chunks of rows (by row numbers, so repeated ids and vectors
spread too) and of queries, so no task holds a whole part.

There are sqrt(n) / 4 parts for n rows, learned from ``PER_PART`` to twice as many different vectors each, up to
``SAMPLE`` in all; so the rows compared grow as n ** 1.5 up to 4 million rows, and with the square, 512 parts, beyond.

Scores are exact inner products of the original vectors in double precision; ties go to the smaller id. Vectors that are
null, zero, of an unusual length, or hold null or non-finite components take no part, nor do null ids. A row with the
query's id is the query's own; of repeated query ids the least vector is asked. Other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hourline.llm.common import local_table, table, written

SAMPLE, PER_PART, RECALL = 16384, 32, 0.98
CHUNK, QUERIES = 8192, 16384


def parts_of(n: int, sample: int = SAMPLE) -> int:
    """How many parts an index of n rows has: a quarter of the square root, with PER_PART rows of the sample each."""
    return int(max(1, min(round(n**0.5 / 4), sample // PER_PART)))


def clean(vectors: DataFrame, id_col: str, vec_col: str, dim: int | None = None) -> DataFrame:
    """id and v (array<double>) of the rows that take part; of the most frequent length unless dim is given."""
    v = F.col(vec_col).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col(id_col).isNotNull() & (F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0))
    if dim is not None:
        return rows.where(F.size("v") == dim)
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.where(F.size("v") == (sizes[0]["n"] if sizes else 0))


def top(scores: np.ndarray, k: int) -> np.ndarray:
    return np.argpartition(-scores, k - 1, axis=1)[:, :k] if scores.shape[1] > k else np.tile(np.arange(scores.shape[1]), (len(scores), 1))


def graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest other rows of each row."""
    out = []
    for i in range(0, len(x), 1024):
        s = x[i : i + 1024] @ x.T
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -np.inf
        out.append(top(s, min(k, len(x) - 1)))
    return np.vstack(out)


def fill(gain: np.ndarray, room: int) -> np.ndarray:
    """A part of each row, of highest gain among those with room; rows of highest gain choose first."""
    part, left = np.full(len(gain), -1), np.full(gain.shape[1], room)
    order = np.argsort(-gain, axis=1)
    for i in np.argsort(-gain.max(axis=1), kind="stable"):
        p = next(p for p in order[i] if left[p])
        part[i], left[p] = p, left[p] - 1
    return part


def partition(x: np.ndarray, near: np.ndarray, parts: int, rng: np.random.Generator, slack: float = 1.1) -> np.ndarray:
    """Balanced partitioning of the neighbour graph."""
    room = int(np.ceil(slack * len(x) / parts))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    centre = unit[rng.choice(len(x), parts, replace=False)]
    for _ in range(8):
        part = fill(unit @ centre.T, room)
        centre = np.stack([unit[part == p].mean(axis=0) if (part == p).any() else centre[p] for p in range(parts)])
    for _ in range(5):
        votes = np.zeros((len(x), parts))
        np.add.at(votes, (np.repeat(np.arange(len(x)), near.shape[1]), part[near].ravel()), 1)
        np.add.at(votes, (near.ravel(), np.repeat(part, near.shape[1])), 1)
        part = fill(votes + 1e-3 * (unit @ centre.T), room)
    return part


@dataclass
class Router:
    weight: np.ndarray
    bias: np.ndarray
    probes: int = 1

    def logits(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weight + self.bias


def learn(x: np.ndarray, near: np.ndarray, part: np.ndarray, parts: int, steps: int = 200) -> Router:
    """Softmax regression from a vector to the parts of itself and its neighbours."""
    target = np.zeros((len(x), parts))
    np.add.at(target, (np.repeat(np.arange(len(x)), near.shape[1]), part[near].ravel()), 1)
    target[np.arange(len(x)), part] += near.shape[1]
    target /= target.sum(axis=1, keepdims=True)
    scale = np.sqrt((x**2).sum(axis=1).mean())
    z = x / scale * 4
    w, b = np.zeros((x.shape[1], parts)), np.zeros(parts)
    w0 = w
    for k in range(steps):
        v = w + k / (k + 3) * (w - w0)
        s = z @ v + b
        p = np.exp(s - s.max(axis=1, keepdims=True))
        g = (p / p.sum(axis=1, keepdims=True) - target) / len(x)
        w0, w = w, v - 1.5 * (z.T @ g)
        b = b - 1.5 * g.sum(axis=0)
    return Router(w * 4 / scale, b)


def fit(rows: DataFrame, k: int, sample: int = SAMPLE, recall: float = RECALL, seed: int = 5) -> Router:
    """Learns from about PER_PART different vectors for each part, sample at most (twice that is a hard bound); only those come to the driver."""
    n = rows.count()
    wanted = min(sample, 2 * PER_PART * parts_of(n, sample))
    share = min(1.0, wanted / max(n, 1))
    drawn = rows.where(F.pmod(F.xxhash64("v"), F.lit(1 << 30)) < share * (1 << 30)).select("v").groupBy("v").count()
    x = drawn.select("v").limit(2 * sample).toPandas()["v"]
    if not len(x):
        return Router(np.zeros((0, 1)), np.zeros(1))
    x = np.unique(np.stack(x.to_numpy()), axis=0)
    parts = min(parts_of(n, sample), max(len(x) // 4, 1))
    if parts == 1:
        return Router(np.zeros((x.shape[1], 1)), np.zeros(1))
    rng = np.random.default_rng(seed)
    near = graph(x, 10)
    router = learn(x, near, partition(x, near, parts, rng), parts)
    logits = router.logits(x)
    home, asked = logits.argmax(axis=1), rng.choice(len(x), min(len(x), 1000), replace=False)
    true = home[graph(x, k)[asked]]
    place = np.argsort(np.argsort(-logits[asked], axis=1), axis=1)
    rank = np.take_along_axis(place, true, axis=1)
    router.probes = next((m for m in range(1, parts) if (rank < m).mean() >= recall), parts)
    return router


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", router: Router | None = None) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest rows of vectors to each of queries."""
    spark = vectors.sparkSession
    rows = written(clean(vectors, id_col, vec_col))
    router = router or fit(rows, k)
    held = spark.sparkContext.broadcast(router)  # dimensions x parts numbers

    def home(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield b.assign(part=held.value.logits(np.stack(b["v"].to_numpy())).argmax(axis=1).astype(np.int32))

    base = written(rows.mapInPandas(home, "id long, v array<double>, part int").withColumn("row", F.monotonically_increasing_id()))
    size = {r["part"]: r["count"] for r in base.groupBy("part").count().collect()}  # a row a part

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            order = np.argsort(-held.value.logits(np.stack(b["v"].to_numpy())), axis=1, kind="stable")
            out = []
            for i, parts in enumerate(order):
                got, n = [], 0
                for p in parts:
                    if p in size and (len(got) < held.value.probes or n <= k):
                        got.append(int(p))
                        n += size[p]
                out.append(got)
            yield b.assign(parts=out)

    one = rows.select(F.size("v").alias("n")).first()
    asked = clean(queries, id_col, vec_col, one["n"] if one else 0).groupBy("id").agg(F.min("v").alias("v"))
    asked = written(asked.mapInPandas(route, "id long, v array<double>, parts array<int>").select("id", "v", F.explode("parts").alias("part")))
    load = {r["part"]: r["count"] for r in asked.groupBy("part").count().collect()}
    cuts = local_table(spark, [(p, -(-n // CHUNK), -(-load.get(p, 1) // QUERIES)) for p, n in size.items()] or [(0, 1, 1)], "part int, chunks int, lots int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n, c: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    b = base.join(F.broadcast(cuts), "part").withColumn("chunk", own("chunks", "row")).withColumn("lot", every("lots")).select("part", "chunk", "lot", "id", "v")
    q = asked.join(F.broadcast(cuts), "part").withColumn("lot", own("lots", "id")).withColumn("chunk", every("chunks")).select("part", "chunk", "lot", "id", "v")

    def nearest(ask: pd.DataFrame, have: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(ask) and len(have):
            have = have.sort_values("id", kind="stable")
            x, ids, z, names = np.stack(have["v"].to_numpy()), have["id"].to_numpy(), np.stack(ask["v"].to_numpy()), ask["id"].to_numpy()
            for i in range(0, len(z), 128):
                s = z[i : i + 128] @ x.T
                s[names[i : i + 128, None] == ids[None, :]] = -np.inf
                least = -np.partition(-s, k - 1, axis=1)[:, k - 1] if s.shape[1] > k else np.full(len(s), -np.inf)
                for j, row in enumerate(s):
                    near = np.flatnonzero((row >= least[j] - 1e-9 * (1 + abs(least[j]))) & (row > -np.inf)) if least[j] > -np.inf else np.flatnonzero(row > -np.inf)
                    exact = (x[near] * z[i + j]).sum(axis=1)
                    keep = np.lexsort((ids[near], -exact))[:k]
                    out.append((np.repeat(names[i + j], len(keep)), ids[near[keep]], exact[keep]))
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*out))))) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    keys = ["part", "chunk", "lot"]
    found = q.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInPandas(nearest, "query_id long, vec_id long, score double")
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).alias("rank")
    return found.select("query_id", place, "vec_id", "score").where(F.col("rank") <= k)


def op5_neighbours(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where("vec_id % 20 = 0"))
