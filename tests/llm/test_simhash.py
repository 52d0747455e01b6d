import random

import numpy as np
import xxhash

from hourline.llm import simhash
from hourline.llm.graph import components


def brute(fps):
    n, label = len(fps), {}
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(n)]


def test_fingerprint():
    assert simhash.fingerprint(None) == simhash.fingerprint("") == simhash.fingerprint(" \n\t") == 0
    assert simhash.fingerprint("Ab cD") == xxhash.xxh64_intdigest(b"ab cd", 42)
    assert simhash.fingerprint("É") == xxhash.xxh64_intdigest("É".encode(), 42)
    words = ("x y z " * 3 + "w").split()
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), 42) for i in range(len(words) - 2)]
    want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    assert simhash.fingerprint("\t".join(words)) == want


def test_forest_and_pairs():
    r = random.Random(1)
    base = [r.getrandbits(64) for _ in range(6)]
    fps = list({b ^ sum(1 << r.randrange(64) for _ in range(r.randrange(4))) for b in base for _ in range(40)})
    fps = np.array(fps, dtype=np.uint64)
    assert simhash.forest(fps).tolist() == brute([int(x) for x in fps])
    u, v = simhash._pairs(fps, np.arange(len(fps)), np.array([0, 50]), np.array([50, 30]))
    want = {(i, j) for s, n in ((0, 50), (50, 30)) for i in range(s, s + n) for j in range(i + 1, s + n) if bin(int(fps[i]) ^ int(fps[j])).count("1") <= 3}
    assert set(zip(u.tolist(), v.tolist())) == want


def test_links_with_tiles(spark):
    r = random.Random(2)
    centre = r.getrandbits(64)
    fps = sorted({centre ^ sum(1 << r.randrange(64) for _ in range(r.randrange(5))) for _ in range(300)} | {r.getrandbits(64) for _ in range(50)})
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate(fps)], "fp long, rep long")
    for tile in (20, 4096):
        got = {x.node: x.root for x in components(simhash.links(df, tile)).collect()}
        assert [got.get(i, i) for i in range(len(fps))] == brute(fps)


def test_components(spark):
    path = [(i, i + 1) for i in range(100, 116)] + [(1, 2), (2, 2), (7, 5), (5, 6)] + [(500, i) for i in range(501, 600)]
    got = {x.node: x.root for x in components(spark.createDataFrame(path, "u long, v long")).collect()}
    assert all(got[i] == 100 for i in range(101, 117)) and got[2] == 1 and got[6] == got[7] == 5 and all(got[i] == 500 for i in range(501, 600))
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_documents(spark):
    long = " ".join(f"w{i}" for i in range(400))
    rows = [(5, long, 1), (3, long.replace("w77 ", "other "), 1), (9, long, 1), (9, long, 1), (4, None, 1), (6, "", 1), (8, "one two", 1), (None, "alone in the world here", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = [(r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()]
    assert sorted(got, key=str) == sorted([(5, 3), (3, 3), (9, 3), (9, 3), (4, 4), (6, 4), (8, 8), (None, None)], key=str)
    assert simhash.near_duplicates(df.limit(0)).count() == 0
