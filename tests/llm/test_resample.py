"""Importance resampling against plain Python."""

import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from hourline.llm import resample

KIND = "doc_id long, text string, score string, at int"


def features(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return len(w), [zlib.crc32(x.encode()) % 10_000 for x in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]


def brute(docs, target, percent=25):
    s, t = [0] * 10_000, [0] * 10_000
    for texts, n in ((docs, s), (target, t)):
        for _, text in texts:
            for b in features(text)[1]:
                n[b] += 1
    gain = [math.floor(1000 * math.log((y + 1) * (sum(s) + 10_000) / ((x + 1) * (sum(t) + 10_000)))) for x, y in zip(s, t)]
    rows = []
    for i, text in docs:
        n, f = features(text)
        weight = math.floor(sum(gain[b] for b in f) / len(f)) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), n >= 20))
    able = sorted((-r[3], r[0] is None, r[0] or 0) for r in rows if r[4])
    ranks = {}
    for k, key in enumerate(able[: len(able) * percent // 100], 1):
        ranks.setdefault(key, []).append(k)
    out = []
    for r in rows:
        mine = ranks.get((-r[3], r[0] is None, r[0] or 0), []) if r[4] else []
        out.append((r[0], r[1], r[2], r[3], mine.pop(0) if mine else None))
    return out


def text(rng, n, words="ab cd ef gh ij kl mn op Qr ST ué ß 12 x-y z_w".split()):
    return " ".join(rng.choice(words) for _ in range(n))


def odd(rng):
    rows = [(i, text(rng, rng.randint(0, 60))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, " \n"), (None, text(rng, 30)), (None, text(rng, 30)), (203, "tail " * 500_000)]
    return rows + [(300, "same old words " * 10)] * 7


def same(got):
    return sorted(got, key=lambda r: tuple((x is None, x or 0) for x in r))


@pytest.mark.parametrize("parts", [1, 5])
def test_brute(spark, parts):
    rng = random.Random(3)
    rows, target = odd(rng), [(i, text(rng, 40, ["ab", "cd", "ué"])) for i in range(10)] + [(11, None)]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], KIND).repartition(parts)
    got = resample.resample(docs, spark.createDataFrame(target, "item_id long, text string"))
    assert same(map(tuple, got.collect())) == same(brute(rows, target))


def test_draw_is_exact_at_every_share(spark):
    rows = [(i % 40, "word " * 25) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    target = spark.createDataFrame([(0, "word")], "item_id long, text string")
    for percent in (0, 1, 50, 99, 100):
        ranks = sorted(r["rank"] for r in resample.resample(docs, target, percent).where("rank is not null").collect())
        assert ranks == list(range(1, 90 * percent // 100 + 1))


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resample.resample(none, none).count() == 0
    one = spark.createDataFrame([("a", "x " * 30)], "doc_id string, text string")
    assert resample.resample(one, none, 100).first()["rank"] == 1


def test_follows_the_target(spark):
    rng = random.Random(5)
    near = [(i, text(rng, 60, ["sun", "moon", "star"])) for i in range(50)]
    far = [(100 + i, text(rng, 60, ["tax", "form", "law"])) for i in range(150)]
    docs = spark.createDataFrame(near + far, "doc_id long, text string")
    got = resample.resample(docs, spark.createDataFrame([(0, text(rng, 500, ["sun", "moon", "star"]))], "item_id long, text string"))
    assert got.where("rank is not null").agg(F.avg((F.col("doc_id") < 100).cast("int"))).first()[0] > 0.9  # a draw, so some others may come in
