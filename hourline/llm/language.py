"""Language identification by error-correcting output codes over hashed byte n-grams.

Each language has a codeword of ``bits`` signs; every bit has a binary classifier, a logistic regression on the hashed
2- and 3-grams of a text's lower-cased UTF-8 bytes. A text's loss for a language is the sum over bits of log(1 +
exp(-sign * margin)), each bit weighted by its classifier's training accuracy above chance; the nearest codeword wins.
The score is the softmax of the negative losses, and a text is ambiguous if it is below ``AMBIGUOUS``.

Training takes a bounded sample by a hash of id and text: about ``PER_LANGUAGE`` texts of a language, and about ``TOTAL``
texts in all, shared evenly, where there are many languages. Only such rows come to the driver, as counts of ``DIM``
hashed n-grams, never texts. A language with few rows is learned from all of them.
Whole texts are read for both, in chunks of ``CHUNK`` bytes. A letter is a character of Unicode's category L: null texts,
texts without one (such as fractions or Roman numerals alone) and corpora without labels give ``und`` with score 0.
Of languages that are equally near the first by code point wins. Repeated rows are judged each, and alike. Columns other
than the named are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hourline.llm.common import BYTES, settings, table, written

PER_LANGUAGE, TOTAL, DIM, BITS, AMBIGUOUS = 1500, 30_000, 2048, 15, 0.5
#: A chunk of a long text, of which the n-grams are counted at once.
CHUNK = 1 << 20
#: Texts whose features are held at once.
SLICE = 256


def features(text: str, dim: int = DIM) -> np.ndarray:
    """Counts of hashed 2- and 3-grams, square-rooted and of length 1."""
    raw = np.frombuffer(f" {text} ".lower().encode(), dtype=np.uint8)
    out = np.zeros(dim)
    for i in range(0, len(raw), CHUNK):
        a = raw[i : i + CHUNK + 2].astype(np.uint32)
        two = a[:-1] * np.uint32(257) + a[1:]
        three = two[:-1] * np.uint32(65599) + a[2:] * np.uint32(7919)
        for x in (two[: CHUNK], three):
            out += np.bincount(((x * np.uint32(2654435761)) >> np.uint32(16)) % np.uint32(dim), minlength=dim)
    out = np.sqrt(out)
    return (out / max(np.linalg.norm(out), 1e-12)).astype(np.float32)


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits, -1 or 1
    weight: np.ndarray  # dim x bits
    bias: np.ndarray
    trust: np.ndarray  # of each bit

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the language and score of each row of features."""
        margin = x @ self.weight + self.bias
        loss = np.stack([(np.logaddexp(0, -margin * c) * self.trust).sum(axis=1) for c in self.code], axis=1)
        p = np.exp(loss.min(axis=1, keepdims=True) - loss)
        p /= p.sum(axis=1, keepdims=True)
        return p.argmax(axis=1), p.max(axis=1)


def codewords(n: int, bits: int = BITS, seed: int = 7) -> np.ndarray:
    """n codewords, far from each other: the best of many random tables whose bits all divide the languages."""
    rng = np.random.default_rng(seed)
    bits = max(bits, int(4 * np.ceil(np.log2(max(n, 2)))))
    best, most = None, -1
    for _ in range(300):
        c = rng.choice([-1, 1], size=(n, bits))
        flat = np.abs(c.sum(axis=0)) == n
        c[0, flat] *= -1
        gap = (bits - (c @ c.T)[~np.eye(n, dtype=bool)].max()) / 2 if n > 1 else 0
        if gap > most:
            best, most = c, gap
    return best


def train(x: np.ndarray, lang: list[str], bits: int = BITS, steps: int = 150, ridge: float = 1e-4) -> Model:
    """Logistic regressions of all bits at once, by Nesterov's gradient steps."""
    languages = sorted(set(lang))
    if len(languages) < 2:
        return Model(languages, np.ones((len(languages), 1)), np.zeros((x.shape[1], 1)), np.ones(1), np.ones(1))
    y = np.array([languages.index(v) for v in lang])
    share = 1 / np.bincount(y)[y]
    share = (share / share.sum())[:, None].astype(np.float32)
    code = codewords(len(languages), bits)
    target = (code[y] > 0).astype(np.float32)
    w, b = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    w0, rate = w.copy(), 4.0
    for k in range(steps):
        v = w + k / (k + 3) * (w - w0)
        g = (1 / (1 + np.exp(-(x @ v + b))) - target) * share
        w0, w = w, v - rate * (x.T @ g + ridge * v)
        b = b - rate * g.sum(axis=0)
    right = (((x @ w + b > 0) == (target > 0)) * share).sum(axis=0)
    return Model(languages, code, w * 4, b * 4, np.maximum(2 * right - 1, 0.05))


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE, total: int = TOTAL, dim: int = DIM) -> tuple[np.ndarray, list[str]]:
    """Features and language of the bounded sample of docs (doc_id, text, lang)."""
    rows = docs.where("lang is not null and text is not null").select("doc_id", "lang", "text")
    counts = written(rows.groupBy("lang").count())
    n = counts.count()
    if not n:
        return np.zeros((0, dim), np.float32), []
    share = counts.select("lang", F.least(F.lit(1.0), F.lit(min(per_language, total / n)) / F.col("count")).alias("share"))
    rows = rows.withColumn("h", F.xxhash64("doc_id", "text"))
    taken = rows.join(share, "lang").where(F.pmod("h", F.lit(1 << 30)) < F.col("share") * (1 << 30))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"lang": b["lang"], "h": b["h"], "x": [(features(t, dim) * 255).round().astype(np.uint8).tobytes() for t in b["text"]]})

    with settings(docs.sparkSession, {BYTES: str(4 << 20)}):
        got = taken.select("lang", "text", "h").mapInPandas(run, "lang string, h long, x binary").toPandas()
    got = got.sort_values(["h", "lang"], kind="stable")
    x = np.frombuffer(b"".join(got["x"]), dtype=np.uint8).reshape(-1, dim).astype(np.float32)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9), list(got["lang"])


def predictor(spark: SparkSession, model: Model):
    """A function from a text column to a struct of lang_pred, score and ambiguous; to be used below written, which keeps batches small."""
    held = spark.sparkContext.broadcast(model)  # languages x bits and DIM x bits numbers

    @F.pandas_udf("lang_pred string, score double, ambiguous boolean")
    def said(texts: pd.Series) -> pd.DataFrame:
        import regex

        m, letter = held.value, regex.compile(r"\p{L}").search
        ok = np.array([bool(m.languages) and t is not None and letter(t) is not None for t in texts], dtype=bool)
        pred, score = np.full(len(texts), "und", dtype=object), np.zeros(len(texts))
        places = np.flatnonzero(ok)
        for k in (places[i : i + SLICE] for i in range(0, len(places), SLICE)):
            best, score[k] = m.predict(np.stack([features(t, m.weight.shape[0]) for t in texts.iloc[k]]))
            pred[k] = np.array(m.languages, dtype=object)[best]
        return pd.DataFrame({"lang_pred": pred, "score": score, "ambiguous": score < AMBIGUOUS})

    return said


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score and ambiguous of every row."""
    said = predictor(docs.sparkSession, model)(F.col(text_col))
    return written(docs.select(F.col(id_col).alias("doc_id"), said.alias("said")).select("doc_id", "said.*"))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def fit(docs: DataFrame) -> Model:
    """Learns from the rows (doc_id, text, lang) that are not held out."""
    return train(*sample(docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang")))


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")
