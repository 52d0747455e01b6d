"""The manifest and its proofs against plain Python."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from hourline.llm import merkle

KIND = "doc_id long, text string, lang string, source string, n_chars long, at long, tree string"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf(r):
    return sha("".join("-" if r[i] is None else f"{len(str(r[i]).encode())}:{r[i]}" for i in (0, 3, 2, 4, 1)))


def tree(hs):
    out = [hs]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def way(levels, i):
    for level in levels[:-1]:
        a = i - i % 8
        yield "".join(level[a:i]), "".join(level[i + 1 : a + 8])
        i //= 8


def brute(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    own = {g: sorted((r for r in rows if r[2] == g), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for g in langs}
    trees = {g: tree([leaf(r) for r in own[g]]) for g in langs}
    top, out = tree([trees[g][-1][0] for g in langs]), []
    for k, g in enumerate(langs):
        for i, r in enumerate(own[g]):
            path = [*way(trees[g], i), *way(top, k)]
            now = list(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[1] is not None:
                now[1] = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1])
            h = leaf(now)
            for a, b in path:
                h = sha(a + h + b)
            out.append((r[0], leaf(r), trees[g][-1][0], top[-1][0], sha("".join(a + b for a, b in path)), h, h == top[-1][0]))
    return out


def odd(n, langs, seed=1):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["Some Text", "text", "", None, "Ünï ÀB"]) and f"T{i}", rng.choice(langs), rng.choice(["s", None, "ß"]), i, 1, "x") for i in range(n)]
    rows += [(None, "Null Id", langs[0], None, None, 1, "x")] * 2 + [(5, "Again", langs[0], "s", 1, 1, "x"), (6, None, None, None, None, 1, "x")]
    return rows + [(3, "Copy", langs[0], "s", 4, 1, "x")] * 20 + [(n + 1, "A" * 1_000_000, langs[-1], "s", 9, 1, "x")]


def of(spark, tmp_path, rows, parts):
    spark.createDataFrame(rows, KIND).repartition(parts).write.parquet(f"{tmp_path}/documents.parquet")
    got = merkle.op12_merkle(spark, str(tmp_path))
    return sorted((tuple(r) for r in got.collect()), key=str)


@pytest.mark.parametrize("n, langs, parts", [(700, ["en", "de", None, "zz", "é"], 3), (90, [f"l{i}" for i in range(70)], 5), (64, ["en"], 4), (0, ["en"], 1)])
def test_brute(spark, tmp_path, n, langs, parts):
    rows = odd(n, langs)
    assert of(spark, tmp_path, rows, parts) == sorted(brute(rows), key=str)


@pytest.mark.parametrize("rows", [[], [(1, "X", "en", "s", 1, 1, "x")], [(1, "X", "en", "s", 1, 1, "x"), (2, None, None, None, None, 1, "x")]])
def test_smallest(spark, tmp_path, rows):
    assert of(spark, tmp_path, rows, 1) == sorted(brute(rows) if rows else [], key=str)


def test_any_change_is_seen(spark):
    docs = spark.createDataFrame([(i, f"t{i}", "en") for i in range(30)], "doc_id long, text string, lang string")
    fields = [F.col("doc_id"), F.col("text")]
    got = merkle.manifest(docs, [F.col("doc_id"), F.when(F.col("doc_id") == 7, "other").otherwise(F.col("text"))], fields)
    assert [r["doc_id"] for r in got.where("not verified").collect()] == [7]


def test_missing_is_minimal():
    """A piece fetches at most a run less one on each side a level, and nothing that it can derive."""
    h = [sha(str(i)) for i in range(100)]
    levels = tree(h)
    a, b = 19, 61
    asked = {}
    for level, nodes in enumerate(levels[:-1]):
        lo, hi = a // 8**level, (b - 1) // 8**level
        for i in [*range(lo - lo % 8, lo), *range(hi + 1, min(len(nodes), hi - hi % 8 + 8))]:
            asked[level, i] = nodes[i]
    shared = merkle.Shared(a, h[a:b], 100, asked)
    assert shared.root == levels[-1][0] and len(asked) <= 14 * (len(levels) - 1)
    assert shared.way(30) == list(way(levels, 30))
