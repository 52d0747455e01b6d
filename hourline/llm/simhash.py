"""SimHash near-duplicates with bit-sliced comparison.

Fingerprints: A-Z is lower-cased, words are runs of anything but ASCII white space, each shingle of ``shingle`` words
(repeats included; a shorter text is one shingle) is hashed by XXH64, and a bit is set if it is set in over half of
the hashes. A null, empty or blank text has fingerprint zero, which links like any other.

Links: two distinct fingerprints that differ in at most three bits agree on two of five blocks at least, so each goes
to ten buckets. In a bucket bit p of 64 fingerprints is one word of plane p. The planes are added up for many queries
and words at once with carry-save counters (ones, twos, and a sticky bit for four and more), and words whose lanes are
all beyond the radius for all queries are left out from then on. A bucket gives a spanning forest of its links, never
all of them. Buckets beyond ``tile`` members are cut into tiles that are compared two by two in tasks of their own.

Equal fingerprints are one node, so repeated rows and copies cost nothing beyond the grouping. A fingerprint of which
every row has a null id takes no part in links and has a null component. Columns other than the named are dropped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourline.llm.common import forget, table, written
from hourline.llm.graph import components

RADIUS, BLOCKS = 3, 5
TILE = 4096
_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(text: str | None, shingle: int = 3, seed: int = 42) -> np.ndarray:
    """XXH64 of each shingle, repeats included; a shorter text is one shingle, a text without words has none."""
    import xxhash

    words = _WORDS.findall((text or "").encode().lower())
    h, join = xxhash.xxh64_intdigest, b" ".join
    if 0 < len(words) < shingle:
        return np.array([h(join(words), seed)], dtype="<u8")
    n = max(len(words) - shingle + 1, 0)
    return np.fromiter((h(join(z), seed) for z in zip(*(words[i:] for i in range(shingle)))), dtype="<u8", count=n)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes; zero without any."""
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The 64 bits of one text."""
    return majority(shingle_hashes(text, shingle, seed))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """doc_id and fp (the 64 bits as a long) of every row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = np.array([fingerprint(t, shingle) for t in b["t"]], dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": b["doc_id"], "fp": fp})

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t")).mapInPandas(run, f"doc_id {kind}, fp long")


def planes(fps: np.ndarray) -> np.ndarray:
    """Bit planes, 64 x words of 64 lanes; the last word is filled with zero lanes."""
    n = -(-len(fps) // 64) * 64
    bits = np.unpackbits(np.pad(fps, (0, n - len(fps))).astype("<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8")


def beyond(p: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """queries x words: a bit is set where the lane differs from the query in more than three bits."""
    out = np.full((len(queries), p.shape[1]), _FULL)
    live = np.arange(p.shape[1])
    one, two, over = (np.zeros((len(queries), len(live)), np.uint64) for _ in range(3))
    for k in range(64):
        mask = np.where(queries >> np.uint64(k) & np.uint64(1), _FULL, np.uint64(0))[:, None]
        x = p[k, live][None, :] ^ mask
        carry = one & x
        one ^= x
        over |= two & carry
        two ^= carry
        if k % 8 == 7 and k > 7:
            keep = (over != _FULL).any(axis=0)
            if 2 * keep.sum() < len(live):
                live, one, two, over = live[keep], one[:, keep], two[:, keep], over[:, keep]
                if not len(live):
                    return out
    out[:, live] = over
    return out


def forest(fps: np.ndarray) -> np.ndarray:
    """For each of a bucket's distinct fingerprints the least index that it is linked to through links inside the bucket."""
    n, step = len(fps), 512
    p = planes(fps)
    near = np.vstack([~beyond(p, fps[i : i + 64]) for i in range(0, n, 64)])
    label = np.arange(n)
    while True:
        new = np.empty_like(label)
        for i in range(0, n, step):
            m = np.unpackbits(near[i : i + step].view(np.uint8), axis=1, bitorder="little")[:, :n].astype(bool)
            new[i : i + step] = np.where(m, label[None, :], n).min(axis=1)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _pairs(fp: np.ndarray, rep: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links inside small buckets, all at once: lane i against lane i + d, in bit planes of whole batches."""
    left, right = [], []
    for d in range(1, int(size.max(initial=1))):
        has = size > d
        n = size[has] - d
        at = np.repeat(start[has], n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        a, b = planes(fp[at]), planes(fp[at + d])
        one, two, over = (np.zeros(a.shape[1], np.uint64) for _ in range(3))
        live = np.arange(a.shape[1])
        for k in range(64):
            x = a[k, live] ^ b[k, live]
            carry = one & x
            one ^= x
            over |= two & carry
            two ^= carry
            if k % 16 == 15:
                keep = over != _FULL
                if 2 * keep.sum() < len(live):
                    live, one, two, over = live[keep], one[keep], two[keep], over[keep]
        near = np.zeros(a.shape[1], np.uint64)
        near[live] = ~over
        hit = np.flatnonzero(np.unpackbits(near.view(np.uint8), bitorder="little")[: len(at)])
        left.append(rep[at[hit]])
        right.append(rep[at[hit] + d])
    return (np.concatenate(left), np.concatenate(right)) if left else (rep[:0], rep[:0])


def _linked(batches: Iterator[pd.DataFrame], small: int = 16) -> Iterator[pd.DataFrame]:
    """Rows sorted by bucket (t, k, a, b) -> links u, v between the smallest ids of fingerprints."""
    rest = pd.DataFrame()
    for b in _with_end(batches):
        last = b is None
        b = rest if last else pd.concat([rest, b], ignore_index=True)
        if not len(b):
            continue
        key = b[["t", "k", "a", "b"]].to_numpy()
        edge = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1), True])
        if not last:  # the last bucket may go on
            rest, edge = b.iloc[edge[-2] :], edge[:-1]
        fp, rep = b["fp"].to_numpy().view(np.uint64), b["rep"].to_numpy()
        start, size = edge[:-1], np.diff(edge)
        few = (size > 1) & (size <= small)
        u, v = _pairs(fp, rep, start[few], size[few])
        us, vs = [u], [v]
        for s, n in zip(start[size > small], size[size > small]):
            label = forest(fp[s : s + n])
            to = np.flatnonzero(label != np.arange(n))
            us.append(rep[s + to])
            vs.append(rep[s + label[to]])
        yield pd.DataFrame({"u": np.concatenate(us), "v": np.concatenate(vs)}).drop_duplicates()


def _with_end(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def links(fps: DataFrame, tile: int = TILE) -> DataFrame:
    """u, v: links that join all fingerprints of fps (fp, rep) within the radius, named by rep; each is given once or a few times."""
    ends = [round(64 * i / BLOCKS) for i in range(BLOCKS + 1)]
    masks = [sum(((1 << ends[i + 1]) - (1 << ends[i])) for i in two) for two in combinations(range(BLOCKS), BLOCKS - RADIUS)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for t, m in enumerate(signed)])
    rows = fps.select("fp", "rep", F.explode(keys).alias("key")).select("fp", "rep", "key.t", "key.k")
    sizes = written(rows.groupBy("t", "k").count().where("count > 1"))
    tiles = F.ceil(F.col("count") / tile).cast("int")
    own = F.pmod(F.xxhash64("fp"), tiles).cast("int")
    others = F.expr("filter(sequence(0, greatest(tiles, 2) - 1), x -> x <> own)")
    cut = rows.join(sizes, ["t", "k"]).withColumn("tiles", tiles).withColumn("own", own).withColumn("other", F.explode(others))
    pairs = cut.select("t", "k", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "fp", "rep")
    return pairs.repartition("t", "k", "a", "b").sortWithinPartitions("t", "k", "a", "b", "rep").mapInPandas(_linked, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, tile: int = TILE) -> DataFrame:
    """doc_id, fp (long) and component_id, the smallest id of the component, of every row of docs."""
    rows = written(fingerprints(docs, id_col, text_col, shingle))
    fps = written(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    roots = components(links(fps.where("rep is not null"), tile))
    named = written(fps.join(roots, fps["rep"] == roots["node"], "left").select("fp", F.coalesce("root", "rep").alias("component_id")))
    forget(fps, roots)
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def hex64(fp):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", hex64(F.col("fp")).alias("fingerprint"), "component_id")
