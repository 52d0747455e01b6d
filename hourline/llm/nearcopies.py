"""Near copies: documents whose sets of five-word shingles have a Jaccard similarity of ``SIMILARITY`` or more.

Candidates come from two places. SimHash links of five-word fingerprints (three bits) are one. At a similarity of 0.8
fingerprints differ in about ten of 64 bits, too many for an exact search by blocks, so MinHash bands are the other: two
sets of similarity J agree on one of ``BANDS`` bands of ``ROWS`` minima with probability 1 - (1 - J^ROWS)^BANDS, that
is 0.99995 at 0.8 and more above. Every candidate is then verified on the sets of 64-bit hashes of shingles, so no link
is below the similarity, whatever named it.

Equal sets are one node. In a band's bucket each node is first compared with the one that meets most nodes in all its
buckets (ties: the least). Nodes that are then in one
component need no comparison with each other; all other pairs of the bucket are, in tiles of ``TILE`` nodes, first by a
bound: with the hashes of a set counted in ``BINS`` bins, two sets have no more in common than the sum of the lesser
counts. Only pairs whose bound and sizes allow the similarity are compared as sets. So a large group of near copies costs
about its size, few pairs leave a bucket, and components are those of all pairs of the bucket.
Words and hashes are those of ``simhash``. Texts without a word are equal to each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourline.llm import simhash
from hourline.llm.common import forget, written
from hourline.llm.graph import components

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 25, 5
BINS, TILE = 256, 256
_RANDOM = np.random.default_rng(42)
_TIMES = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def bands(hashes: np.ndarray) -> list[int]:
    """The keys of a set's bands, as signed longs."""
    import xxhash

    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 2048):
        part = hashes[None, i : i + 2048] * _TIMES[:, None] + _PLUS[:, None]
        np.minimum(least, part.min(axis=1), out=least)
    keys = [xxhash.xxh64_intdigest(least[i * ROWS : (i + 1) * ROWS].tobytes(), i) for i in range(BANDS)]
    return np.array(keys, dtype=np.uint64).view(np.int64).tolist()


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, fp (SimHash), s1 and s2 (two hashes of the set), n (its size) and bands of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for b in batches:
            out = []
            for t in b["t"]:
                h = simhash.shingle_hashes(t, SHINGLE)
                own = np.unique(h)
                raw = own.tobytes()
                out.append((simhash.majority(h), xxhash.xxh64_intdigest(raw, 1), xxhash.xxh64_intdigest(raw, 2), len(own), bands(own)))
            fp, s1, s2 = (np.array([o[i] for o in out], dtype=np.uint64).view(np.int64) for i in range(3))
            yield pd.DataFrame({"id": b["id"], "fp": fp, "s1": s1, "s2": s2, "n": [o[3] for o in out], "bands": [o[4] for o in out]})

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInPandas(run, "id long, fp long, s1 long, s2 long, n long, bands array<long>")


def sets(docs: DataFrame) -> DataFrame:
    """id and set (the distinct hashes of shingles) of documents id, t."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            own = [np.unique(simhash.shingle_hashes(t, SHINGLE)) for t in b["t"]]
            bins = [np.bincount(x & np.uint64(BINS - 1), minlength=BINS).astype("<u4").tobytes() for x in own]
            yield pd.DataFrame({"id": b["id"], "set": [x.view(np.int64) for x in own], "bins": bins})

    return docs.mapInPandas(run, "id long, set array<long>, bins binary")


def _possible(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by tile (key, a, b) -> the pairs u, v of different roots in a tile that the bound allows."""
    rest = pd.DataFrame()
    for b in simhash._with_end(batches):
        last = b is None
        b = rest if last else pd.concat([rest, b], ignore_index=True)
        if not len(b):
            continue
        edge = np.flatnonzero(np.r_[True, (b[["key", "a", "b"]].to_numpy()[1:] != b[["key", "a", "b"]].to_numpy()[:-1]).any(axis=1), True])
        if not last:  # the last tile may go on
            rest, edge = b.iloc[edge[-2] :], edge[:-1]
        for lo, hi in zip(edge[:-1], edge[1:]):
            g = b.iloc[lo:hi]
            node, root, n = (g[c].to_numpy() for c in ("node", "root", "n"))
            counts = np.frombuffer(b"".join(g["bins"]), "<u4").reshape(-1, BINS).astype(np.float32)
            us, vs = [], []
            for i in range(len(g) - 1):
                j = i + 1 + np.flatnonzero((root[i + 1 :] != root[i]) & (np.minimum(n[i + 1 :], n[i]) >= SIMILARITY * np.maximum(n[i + 1 :], n[i])))
                if len(j):
                    common = np.minimum(counts[j], counts[i]).sum(axis=1)
                    j = j[common >= SIMILARITY * (n[i] + n[j] - common) - 1e-3]
                    us.append(np.full(len(j), node[i]))
                    vs.append(node[j])
            if us:
                u, v = np.concatenate(us), np.concatenate(vs)
                yield pd.DataFrame({"u": np.minimum(u, v), "v": np.maximum(u, v)})


def crossing(open_: DataFrame, owned: DataFrame) -> DataFrame:
    """The pairs u, v of different components (root) inside buckets (key) that the bound allows; open_: key, node, n, root."""
    sizes = written(open_.groupBy("key").count())
    bins = written(open_.select("node").distinct().join(owned.select("node", "bins"), "node"))
    tiles = F.ceil(F.col("count") / TILE).cast("int")
    own = F.pmod(F.xxhash64("node"), tiles).cast("int")
    others = F.expr("filter(sequence(0, greatest(tiles, 2) - 1), x -> x <> own)")
    cut = open_.join(sizes, "key").withColumn("tiles", tiles).withColumn("own", own).withColumn("other", F.explode(others)).join(bins, "node")
    rows = cut.select("key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "node", "n", "root", "bins")
    return rows.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b", "node").mapInPandas(_possible, "u long, v long").distinct()


def verified(pairs: DataFrame, owned: DataFrame) -> DataFrame:
    """The pairs u, v whose sets (node, set) have the similarity."""
    both = pairs.hint("shuffle_hash").join(owned.select(F.col("node").alias("u"), F.col("set").alias("a")), "u")
    both = both.join(owned.select(F.col("node").alias("v"), F.col("set").alias("b")), "v")
    common = both.select("u", "v", F.size(F.array_intersect("a", "b")).alias("c"), (F.size("a") + F.size("b")).alias("n"))
    return common.where(F.col("c") >= F.lit(SIMILARITY) * (F.col("n") - F.col("c"))).select("u", "v")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and component_id, the smallest id of the component, of every row of docs; ids (longs) are unique and not null."""
    rows = written(signatures(docs, id_col, text_col))
    nodes = written(rows.groupBy("s1", "s2").agg(F.min("id").alias("node"), F.min("n").alias("n"), F.min("fp").alias("fp"), F.min("bands").alias("bands")))
    ids = written(rows.select("id", "s1", "s2"))
    forget(rows)
    keyed = nodes.select("node", "n", F.explode("bands").alias("key"))
    full = written(keyed.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"))
    shared = written(keyed.join(full, "key").select("key", "node", "n", "m"))
    # the text that others were made from meets most others in its bands, so a group gathers around it
    weight = written(shared.groupBy("node").agg(F.sum("m").alias("weight")))
    weighed = shared.select("key", "node").join(weight, "node")
    centres = written(weighed.groupBy("key").agg(F.max(F.struct("weight", (-F.col("node")).alias("node")))["node"].alias("least")).select("key", (-F.col("least")).alias("centre")))
    buckets = written(shared.join(centres, "key").select("key", "node", "n", "centre"))
    forget(full, shared, weight, centres)
    stars = buckets.where("node <> centre").select(F.col("centre").alias("u"), F.col("node").alias("v"))
    same = nodes.groupBy("fp").agg(F.min("node").alias("rep"))
    equal = nodes.join(same, "fp").where("node <> rep").select(F.col("rep").alias("u"), F.col("node").alias("v"))
    tried = written(stars.unionByName(simhash.links(same)).unionByName(equal).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    needed = tried.select(F.col("u").alias("id")).union(tried.select("v")).union(buckets.select("node")).distinct()
    owned = written(sets(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).join(needed, "id", "left_semi")).withColumnRenamed("id", "node"), bucket="node")  # sets are dealt out once
    linked = written(verified(tried, owned))
    found = components(linked)
    placed = buckets.join(found.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left")
    placed = written(placed.select("key", "node", "n", F.coalesce("root", "node").alias("root")))
    forget(buckets, found)
    counts = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).select("key", (F.when(F.col("low") < F.col("high"), 2).otherwise(1)).alias("roots"))
    open_ = placed.join(counts.where("roots > 1").select("key"), "key").select("key", "node", "n", "root")
    cross = crossing(open_, owned)
    pairs = written(cross.join(tried, ["u", "v"], "left_anti"))
    more = written(verified(pairs, owned))
    forget(tried, owned, placed, pairs)
    roots = components(linked.unionByName(more))
    named = nodes.join(roots.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left")
    named = written(named.select("s1", "s2", F.coalesce("root", "node").alias("component_id")))
    out = written(ids.join(named, ["s1", "s2"]).select("id", "component_id"))
    forget(ids, nodes, linked, more, roots, named)
    return out
