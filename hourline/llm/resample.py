"""Importance resampling toward a target distribution: documents that read like a target corpus are drawn more often.

Words are runs of letters and digits (any character beyond ASCII counts as one); features are all runs of 1 to ``n``
words, hashed into ``buckets``. A bucket's gain is the log ratio of its smoothed shares in the target and in the corpus,
a document's weight the mean gain of its features, looked up in one array. A Gumbel number fixed by the id is added, so
that the highest sums are a draw without replacement by weight.

1. Counts. Each task adds up one array of buckets; the arrays' sum, ``buckets`` numbers, comes to the driver.
2. Scores. Texts are read again; rows are written down, each part sorted by key: score (high first), id (null last), row.
3. Selection of the cutoff key by weighted medians of medians. A part's rows still in question are one run of its order. The
   medians of these runs, weighted by their lengths, have a weighted median; at least a quarter of all rows in question
   lies on either side of it, and one side is discarded. Rounds end at the exact key. Only a median and a count a part come to
   the driver, never keys in bulk.
4. The winners are sorted by ranges and numbered.

A null or empty text has no features, weight 0 and no part in the draw. A null id draws by the key ``<seed>:``. Rows of equal id
and score are told apart by row, so exactly as many are drawn as asked. Texts of any length are read in slices, whole.
Columns other than the named are dropped. An empty corpus gives an empty table, an empty target draws by smoothing alone.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourline.llm.common import forget, in_order, slices, table, written

BUCKETS, RUN = 10_000, 2
#: Other ASCII than digits and letters becomes a space; the rest is lower-cased.
_SPACED = bytes(b if b >= 128 or 48 <= b < 58 or 97 <= b < 123 else b + 32 if 65 <= b < 91 else 32 for b in range(256))


def words(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text, in lists of bounded length."""
    for piece in slices((text or "").encode().translate(_SPACED)):
        yield piece.split()


def hashed(text: str | None, buckets: int, run: int) -> Iterator[tuple[int, np.ndarray]]:
    """How many words a piece of a text has, and the buckets of the runs of words that end in it."""
    before: list[bytes] = []
    for ws in words(text):
        every = before + ws
        crcs: list[int] = []
        for k in range(1, run + 1):
            first = max(len(before) - k + 1, 0)
            if k == 1:
                crcs += map(zlib.crc32, ws)
            elif k == 2:
                crcs += [zlib.crc32(b"%b %b" % pair) for pair in zip(every[first:], every[first + 1 :])]
            else:
                crcs += [zlib.crc32(b" ".join(every[i : i + k])) for i in range(first, len(every) - k + 1)]
        before = every[len(every) - run + 1 :] if run > 1 else []
        yield len(ws), np.array(crcs, dtype=np.int64) % buckets


def counts(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS, run: int = RUN) -> np.ndarray:
    """How often each bucket is met in all texts."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for t in b.column(0):
                for _, at in hashed(t.as_py(), buckets, run):
                    total += np.bincount(at, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    summed = written(texts.select(text_col).mapInArrow(one, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")))
    for r in summed.collect():  # buckets rows at most
        out[r["bucket"]] = r["n"]
    forget(summed)
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A thousand times the log ratio of the smoothed shares, floored."""
    s, t, n = corpus.astype(float), target.astype(float), len(corpus)
    ratio = ((t + 1) * (s.sum() + n)) / ((s + 1) * (t.sum() + n))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], dtype=np.int64)


def gumbel(key: str) -> int:
    """Thousandths of a Gumbel number that is fixed by a string, floored."""
    h = int(hashlib.sha256(key.encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, least_words: int, seed: int, id_col: str, text_col: str, run: int) -> DataFrame:
    """doc_id, n_features, weight, score, ok (enough words) and at (the part and the place in it) of every row, each part in the order of keys."""
    held = docs.sparkSession.sparkContext.broadcast(gain)  # a number a bucket

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = held.value
        for b in batches:
            rows = []
            for i, t in zip(b.column(0), b.column(1)):
                n_words = n = total = 0
                for k, at in hashed(t.as_py(), len(g), run):
                    n_words, n, total = n_words + k, n + len(at), total + int(g[at].sum())
                weight = total // n if n else 0
                key = "" if i.as_py() is None else str(i.as_py())
                rows.append((n, weight, weight + gumbel(f"{seed}:{key}"), n_words >= least_words))
            new = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *new], ["doc_id", "n_features", "weight", "score", "ok"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("doc_id"), text_col).mapInArrow(one, f"doc_id {kind}, n_features long, weight long, score long, ok boolean")
    order = [F.desc("ok"), F.desc("score"), F.asc_nulls_last("doc_id")]
    return written(out.sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))


def _key() -> Column:
    """What rows are drawn in the order of; no two rows have the same."""
    return F.struct((-F.col("score")).alias("a"), F.col("doc_id").isNull().alias("b"), F.col("doc_id").alias("c"), F.col("at").alias("d"))


def _fixed(row, rows: DataFrame) -> Column:
    """The key of a row that came to the driver."""
    kind = rows.schema["doc_id"].dataType
    return F.struct(F.lit(-row["score"]).cast("long").alias("a"), F.lit(row["doc_id"] is None).alias("b"), F.lit(row["doc_id"]).cast(kind).alias("c"), F.lit(row["at"]).cast("long").alias("d"))


def cutoff(rows: DataFrame, k: int) -> Column | None:
    """The key that k rows, among those that are ok, do not exceed; None if there is none."""
    part, place = F.shiftright("at", 33).cast("int"), F.col("at").bitwiseAND((1 << 33) - 1)
    keys = rows.where("ok").select("score", "doc_id", "at")
    found = {r["part"]: r["n"] for r in keys.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}  # a row a part
    a, b = np.zeros(max(found, default=-1) + 1, np.int64), np.zeros(max(found, default=-1) + 1, np.int64)
    b[list(found)] = list(found.values())
    if not 0 < k <= b.sum():
        return None
    start = np.arange(len(a)) << 33
    while True:
        open_ = np.flatnonzero(a < b)
        middle, weight = (start + (a + b) // 2)[open_], (b - a)[open_]
        medians = keys.where(F.col("at").isin(middle.tolist())).collect()  # a row a part
        medians.sort(key=lambda r: (-r["score"], r["doc_id"] is None, 0 if r["doc_id"] is None else r["doc_id"], r["at"]))
        size = dict(zip(middle.tolist(), weight.tolist()))
        run = np.cumsum([size[r["at"]] for r in medians])
        pivot = medians[int(np.searchsorted(run, run[-1] / 2))]
        lowest, highest = (F.get(F.lit(x.tolist()), part) for x in (a, b))
        below = np.zeros(len(a), np.int64)
        for r in keys.where((place >= lowest) & (place < highest) & (_key() < _fixed(pivot, rows))).groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect():
            below[r["part"]] = r["n"]
        n = int(below.sum())
        if n + 1 == k:
            return _fixed(pivot, rows)
        if n >= k:
            b = a + below
        else:
            k, a = k - n - 1, a + below
            a[pivot["at"] >> 33] += 1


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = 25,
    least_words: int = 20,
    seed: int = 7,
    buckets: int = BUCKETS,
    run: int = RUN,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null where not drawn) of every row of docs."""
    gain = gains(counts(docs, text_col, buckets, run), counts(target, text_col, buckets, run))
    rows = scored(docs, gain, least_words, seed, id_col, text_col, run)
    last = cutoff(rows, rows.where("ok").count() * percent // 100)
    plain = ["doc_id", "n_features", "weight", "score"]
    if last is None:
        return rows.select(*plain, F.lit(None).cast("long").alias("rank"))
    drawn = rows.withColumn("drawn", F.col("ok") & (_key() <= last))
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("at")]
    winners = in_order(drawn.where("drawn").select(*plain, "at"), order, "rank").select(*plain, (F.col("rank") + 1).alias("rank"))
    return drawn.where("not drawn").select(*plain, F.lit(None).cast("long").alias("rank")).unionByName(winners)


def op13_resample(spark, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_CRC = "list_reduce(list_prepend(4294967295::BIGINT, [('0x' || substr(hex(encode({0})), 2 * i + 1, 2))::BIGINT for i in range(strlen({0}))]), lambda c, b: xor(c >> 8, tab.t[(xor(c, b) & 255) + 1]))"
#: crc32 of each distinct feature by the table that the polynomial gives.
OP13_SQL = rf"""
WITH tab AS MATERIALIZED (SELECT [list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) for i in range(256)] AS t),
w AS (SELECT 0 AS src, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL SELECT 1, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
f AS (SELECT src, id, unnest(w || [w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) AS g FROM w),
d AS (SELECT DISTINCT g FROM f),
c AS (SELECT g, xor({_CRC.format("g")}, 4294967295) % 10000 AS bucket FROM d, tab),
fc AS (SELECT src, id, bucket, count(*) AS n FROM f JOIN c USING (g) GROUP BY ALL),
st AS (SELECT bucket, coalesce(sum(n) FILTER (src = 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (src = 1), 0)::DOUBLE AS t FROM fc GROUP BY bucket),
n AS (SELECT sum(s) AS s, sum(t) AS t FROM st),
g AS (SELECT bucket, floor(1000 * ln(((st.t + 1) * (n.s + 10000)) / ((st.s + 1) * (n.t + 10000))))::BIGINT AS gain FROM st, n),
x AS (SELECT id, sum(n)::BIGINT AS n_features, floor(sum(n * gain) / sum(n))::BIGINT AS weight FROM fc JOIN g USING (bucket) WHERE src = 0 GROUP BY id),
y AS (SELECT w.id AS doc_id, len(w.w) AS words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
  ('0x' || substr(sha256('7:' || w.id), 1, 8))::BIGINT AS h FROM w LEFT JOIN x ON x.id = w.id WHERE src = 0),
z AS (SELECT *, (weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE))))::BIGINT AS score FROM y),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM z WHERE words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= n * 25 // 100 THEN rank END::BIGINT AS rank FROM z LEFT JOIN r USING (doc_id)
"""
