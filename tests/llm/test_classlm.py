"""The class model against plain Python loops."""

import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from hourline.llm import classlm

KIND = "doc_id long, text string, score double, block long"


def learned(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 != 2


def brute(rows, classes, rounds):
    """(id, held out, tokens, known, training tokens, base, score) of rows, and the model's parts."""
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    texts = [(i, [*re.findall(r"[^\x20\x09-\x0D]+", low(t)), "\n"]) for i, t in rows]
    train = [t for i, t in texts if learned(i)]
    count = {}
    for t in train:
        for w in t:
            count[w] = count.get(w, 0) + 1
    key = {w: xxhash.xxh64_intdigest(w.encode()) for w in count}
    signed = lambda w: key[w] - (1 << 64 if key[w] >> 63 else 0)
    cls = dict.fromkeys(count, classes - 1)
    for k, w in enumerate(sorted(count, key=lambda w: (-count[w], signed(w)))[: classes - 1]):
        cls[w] = k
    pairs = {}
    for t in train:
        for a, b in zip(["\n", *t], t):
            pairs[a, b] = pairs.get((a, b), 0) + 1

    def table():
        n = [[0] * classes for _ in range(classes)]
        for (a, b), c in pairs.items():
            n[cls[a]][cls[b]] += c
        return n

    for turn in range(rounds):
        n, new = table(), {}
        log = [[math.log(x + 0.5) for x in r] for r in n]
        ends = [math.log(sum(n[k]) + classes / 2) + math.log(sum(r[k] for r in n) + classes / 2) for k in range(classes)]
        gain = {w: [-count[w] * e for e in ends] for w in count}
        for (a, b), c in pairs.items():
            for k in range(classes):
                gain[b][k] += c * log[cls[a]][k]
                gain[a][k] += c * log[k][cls[b]]
        for w, g in gain.items():
            stay = ((key[w] >> 7) + turn) % 2 == 1 or g[cls[w]] >= max(g) - 1e-9
            new[w] = cls[w] if stay else g.index(max(g))
        cls = new
    n, total = table(), sum(count.values())
    once, twice = (sum(c == k for c in count.values()) for k in (1, 2))
    d = (once + 1) / (once + 2 * twice + 2)
    size = [sum(r[k] for r in n) for k in range(classes)]
    types = [sum(c == k for c in cls.values()) for k in range(classes)]
    follow = [[(n[a][b] + classes * size[b] / total) / (sum(n[a]) + classes) for b in range(classes)] for a in range(classes)] if total else []
    unknown = [d * types[k] / size[k] if size[k] else 0.0 for k in range(classes)]
    out = []
    for i, t in texts:
        state, score = None, 0.0
        for w in t if total else []:
            share = follow[cls["\n"]] if state is None else [sum(state[a] * follow[a][b] for a in range(classes)) for b in range(classes)]
            emit = [(count[w] - d) / size[k] if k == cls[w] else 0.0 for k in range(classes)] if w in count else unknown
            p = [x * y for x, y in zip(share, emit)]
            score += math.log10(sum(p))
            state = [x / sum(p) for x in p]
        base = sum(math.log10((count.get(w, 0) + 1) / (total + len(count) + 1)) for w in t)
        out.append((i, not learned(i), len(t), sum(w in count for w in t), total, base, score))
    return out, cls


def text(rng, n):
    """Words of two kinds that take turns, and now and then a rare one."""
    kinds = (["the", "A", "this", "no"], ["cat", "dog", "Sun", "sea", "ünd"])
    return " ".join(f"{'xyz'[k % 3]}{rng.randint(0, 80)}" if rng.random() < 0.1 else rng.choice(kinds[k % 2]) for k in range(n))


def odd():
    rng = random.Random(2)
    rows = [(i, text(rng, rng.randint(0, 40))) for i in range(120)]
    return rows + [(200, None), (201, ""), (202, "\x1c \n\x85"), (None, "the cat never"), (None, None), (203, "new " * 60), (204, "the dog " * 3)] + [(300, "this very row the cat")] * 9


def same(got):
    return sorted(got, key=lambda r: tuple((x is None, round(x, 6) if x is not None else 0) for x in r))


@pytest.mark.parametrize("parts, size, merged, share", [(1, 1 << 21, 256, 1 << 21), (4, 200, 2, 100)])
def test_brute(spark, parts, size, merged, share):
    rows = odd()
    docs = spark.createDataFrame([(*r, 1.0, 1) for r in rows], KIND).repartition(parts)
    flag = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 != 2, F.lit(False))
    got = classlm.language_model(docs, flag, classes=4, rounds=4, size=size, merged=merged, share=share).drop("perplexity").collect()
    want, _ = brute(rows, 4, 4)
    for a, b in zip(same(map(tuple, got)), same(want), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9)


def test_counts_are_sent_as_bytes():
    counts = np.array([1, 254, 255, 256, 3, 1 << 40, 0])
    small, large = classlm._packed(counts)
    assert len(small) == 7 and len(large) == 3 * 8
    assert classlm._unpacked(small, large).tolist() == counts.tolist() and classlm._unpacked(*classlm._packed(counts[:0])).tolist() == []
    assert classlm._starts(np.array([4, 4, 5, 7, 7])).tolist() == [0, 2, 3] and classlm._starts(counts[:0]).tolist() == []


def test_tokens_are_counted_in_one_pass_a_round(spark, monkeypatch):
    passes = []
    counted = classlm.transitions
    monkeypatch.setattr(classlm, "transitions", lambda *args: passes.append(1) or counted(*args))
    docs = spark.createDataFrame([(i, text(random.Random(i), 20)) for i in range(30)], "doc_id long, text string").repartition(2)
    assert classlm.language_model(docs, F.lit(True), classes=3, rounds=3).count() == 30
    assert len(passes) == 1  # the last classes' pairs; those of the rounds come with what blocks send


def test_what_blocks_send(spark):
    docs = spark.createDataFrame(odd(), "doc_id long, text string").repartition(3)
    flag = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 != 2, F.lit(False))
    texts = classlm.blocks(docs, flag, "doc_id", "text", 300)
    asked = classlm.entries(texts, 5, 1)
    told, _, top = classlm.vocabulary(asked, 1, 3)
    _, place = classlm.places(asked, told, top, 4)
    rows = texts.join(place, "block")
    sent = classlm.neighbours(rows, 4)
    assert (classlm.sent_pairs(sent, 4) == classlm.transitions(rows, 4)).all()
    for r in sent.collect():  # a byte a word for its place, class and number of counts, and no fingerprints
        assert len(r.steps) == len(r.cls) == len(r.nnz) > 0 and len(r.codes) == len(r.counts) == sum(r.nnz)


def test_words_of_texts():
    rows = [None, "", *(f"A{chr(i)}Bc{chr(i)}ÀÉ d é " for i in range(128)), "\x1c \n\x85", " ", "Long one " * 200_000, "x" * 2_000_000]
    low = [bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()) for t in rows]
    want = [re.findall(rb"[^\x20\x09-\x0D]+", t) for t in low]
    for at, upto in ((0, len(rows)), (1, 131)):  # with and without texts that are cut
        words, n = classlm._split(pa.array(rows).slice(at, upto - at))
        assert n.tolist() == [len(w) for w in want[at:upto]]
        assert words.cast(pa.binary()).to_pylist() == [x for w in want[at:upto] for x in w]


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    count = rng.integers(1, 9, 40)
    cls = rng.integers(0, 3, 40).astype(np.uint8)
    cls[:3] = range(3)
    size = np.bincount(cls, weights=count, minlength=3)
    n = np.round(np.outer(size, size) / size.sum()).astype(int)
    n[0] += (size - n.sum(axis=0)).astype(int)
    figures = {"tokens": int(size.sum()), "words": 40, "once": int((count == 1).sum()), "twice": int((count == 2).sum())}
    model = classlm.Model(figures, n, np.bincount(cls, minlength=3), int(cls[0]))
    for before in ([], [3], [40], [5, 40, 40]):
        both = np.append(cls, classlm.NONE), np.append(count, 0)
        alone = model.score(np.array(before, dtype=np.int64), np.array([len(before)]), *both)[2][0] if before else 0.0
        ps = [10 ** (model.score(np.array([*before, w]), np.array([len(before) + 1]), *both)[2][0] - alone) for w in range(41)]
        assert sum(ps) == pytest.approx(1)


def test_classes_help(spark):
    rng = random.Random(4)
    docs = spark.createDataFrame([(i, text(rng, 60)) for i in range(200)], "doc_id long, text string").repartition(3)
    got = classlm.language_model(docs, F.col("doc_id") % 5 > 0, classes=5).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > 0.92 * got[1]


def test_untrained(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = classlm.language_model(docs, F.lit(False)).collect()
    assert {(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got} == {(1, 3, 0, 0, 0.0, 0.0), (2, 1, 0, 0, 0.0, 0.0)}
    assert classlm.language_model(docs.limit(0), F.lit(True)).count() == 0


def test_long_text(spark):
    docs = spark.createDataFrame([(1, "word other " * 300_000), (2, "word"), (3, "x" * 3_000_000)], "doc_id long, text string")
    got = {r.doc_id: r for r in classlm.language_model(docs, F.col("doc_id") < 3, rounds=1).collect()}
    assert got[1].n_tokens == 600_001 and got[3].n_known == 1
