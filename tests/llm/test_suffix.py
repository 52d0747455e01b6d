import hashlib
import random
from collections import defaultdict

import pytest

from hourline.llm import suffix


def brute(texts, length=200):
    raws = [(t or "").encode() for t in texts]
    at = defaultdict(list)
    for k, r in enumerate(raws):
        for i in range(len(r) - length + 1):
            at[r[i : i + length]].append((k, i))
    gone = [bytearray(len(r)) for r in raws]
    for places in at.values():
        if len(places) > 1:
            for k, i in places:
                gone[k][i : i + length] = b"\1" * length
    out = []
    for r, g in zip(raws, gone):
        kept = bytes(c for c, x in zip(r, g) if not x)
        out.append((len(r), sum(g), sum(1 for i, x in enumerate(g) if x and not (i and g[i - 1])), hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed):
    r = random.Random(seed)
    words = ["the", "of", "été", "ring", "tion", "a", "straße", "in", "and", "whereas"]
    prose = lambda n: " ".join(r.choice(words) + r.choice(["", "", "s", "ing"]) + str(r.randrange(40)) * r.randrange(2) for _ in range(n))
    passages = [prose(n) for n in (30, 36, 42, 50, 70, 120, 200)]
    texts = [None, "", "short", "x" * 199, "y" * 200, "z" * 201, "ab" * 400, "same " * 90]
    for k in range(70):
        p = r.choice(passages)
        cut = r.randrange(len(p) // 2)
        p = p[cut : cut + r.randrange(150, 900)]
        texts.append(prose(r.randrange(80)) + p + prose(r.randrange(60)))
    texts += [prose(150)] * 4 + [passages[5] + "!" + passages[6]] * 2
    near = prose(300).split(" ")
    for k in range(12):
        w = list(near)
        for _ in range(r.randrange(5)):
            w[r.randrange(len(w))] = "edit"
        texts.append(" ".join(w))
    return texts


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_brute(spark, seed):
    texts = corpus(seed)
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, n_bytes2 int").repartition(5)
    got = {r.doc_id: r for r in suffix.remove(df).collect()}
    want = brute(texts)
    for i, w in enumerate(want):
        assert (got[i].n_bytes, got[i].n_removed, len(got[i].spans), hashlib.sha256(bytes(got[i].kept)).hexdigest()) == w, i
    assert sum(w[1] > 0 for w in want) > 30


def test_blocks(spark, monkeypatch):
    texts = corpus(9)
    text = " ".join(t for t in texts if t)
    import numpy as np

    raw = np.frombuffer(text.encode(), np.uint8)
    whole = suffix.elected(raw)
    monkeypatch.setattr(suffix, "BLOCK", 1000)
    parts = [suffix.elected(b) + at for at, b in suffix._blocks(raw, 200)]
    assert (np.concatenate(parts) == whole).all()


def test_repeated_rows_and_empty(spark):
    t = " ".join(f"word{i}" for i in range(60))
    df = spark.createDataFrame([(1, t), (1, t), (None, None), (2, t[:150])], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_removed) for r in suffix.remove(df).collect())
    assert got == sorted([("1", len(t)), ("1", len(t)), ("None", 0), ("2", 0)])
    assert suffix.remove(df.limit(0)).count() == 0
