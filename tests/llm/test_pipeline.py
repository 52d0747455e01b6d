"""The stages on a small corpus, against what plain Python expects of it."""

import hashlib

import numpy as np
import public_tokenizers as P
import tiktoken

import corpus_pipeline
from hourline.llm import bpe
from hourline.llm.common import written

WORDS = {"en": "the house of ring and this that with there water", "de": "und die straße ist nicht für sich auch eine über"}


def prose(seed, lang="en", n=90):
    return " ".join(np.random.default_rng(seed).choice(WORDS[lang].split(), n)) + f" {seed}"


def test_stages(spark):
    passage = " ".join(f"shared{i}" for i in range(45))
    rows = [(i, prose(i, "en" if i % 2 else "de"), "en" if i % 2 else "de", f"s{i % 2}", 1) for i in range(60)]
    rows += [(100, rows[7][1], "en", "s0", 1), (101, None, "en", "s0", 1), (102, "123 456", "en", None, 1), (103, prose(103) + passage, "en", None, 1), (104, passage + prose(104), "en", "s1", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    seen = []
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, ""))
        seen.append(docs)
    ids = [sorted({r.doc_id for r in d.select("doc_id").collect()}) for d in seen]
    assert not {101, 102} & set(ids[0]) and set(range(60)) <= set(ids[0])
    assert 100 not in ids[1] and {7, 103, 104} <= set(ids[1])
    cut = {r.doc_id: r.text for r in seen[2].collect()}
    assert passage not in cut[103] and passage not in cut[104] and cut[103].startswith(prose(103)[:-1])
    assert all(d.columns == docs_columns for d, docs_columns in zip(seen[:4], [["doc_id", "text", "lang", "source", "n_chars"]] * 4))
    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    want = sorted((r.doc_id, hashlib.sha256(",".join(map(str, e.encode_ordinary(r.text))).encode()).hexdigest()) for r in seen[3].collect())
    assert sorted((r.doc_id, r.ids_sha256) for r in seen[4].collect()) == want


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0


def test_near_copies(spark):
    def jaccard(a, b):
        x, y = ({tuple(t.lower().split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in (a, b))
        return len(x & y) / len(x | y)

    r, rows = np.random.default_rng(5), []
    for k in range(60):  # every base beside two copies of a few words each; some copies fall below 0.8
        base = [f"w{k}x{i}" if i % 3 else f"W{k}x{i}" for i in range(300)]
        rows.append((len(rows), " ".join(base)))
        for _ in range(2):
            copy = list(base)
            for i in r.choice(300, r.integers(1, 9), replace=False):
                copy[i] += "new"
            rows.append((len(rows), " ".join(copy).lower()))
    texts = dict(rows)
    root = {i: i for i in texts}
    for _ in range(3):
        for k in range(0, len(texts), 3):
            for i, j in ((k, k + 1), (k, k + 2), (k + 1, k + 2)):
                if jaccard(texts[i], texts[j]) >= 0.8:
                    root[i] = root[j] = min(root[i], root[j])
    near = [jaccard(texts[k], texts[k + 1]) for k in range(0, len(texts), 3)]
    assert sum(0.8 <= j < 0.95 for j in near) > 20 and any(0.7 < j < 0.8 for j in near)
    docs = spark.createDataFrame([(i, t, "en", "s0", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {x.doc_id for x in corpus_pipeline.simhash_near_dedup(spark, docs, "").collect()}
    assert kept == {i for i in root if root[i] == i}
