"""A corpus from raw documents to token digests, in five stages that each apply one operator.

Each stage takes what its predecessor kept, decides on that alone and returns the columns of its documents, whatever their
names; the last one returns the digests. Rows are told apart by row numbers that stages write down, so ids may be null or
repeated: rows that share an id and differ in text stay apart, and of copies with null ids one stays. Null and empty texts
go with the first stage, empty tables give empty ones, and texts of any length are read whole.

A stage's result is read from scratch tables. These go when the next stage of the session begins on documents that no longer
read them, so a result is to be written, or read to its end, before that.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourline.llm import bpe, language, mixing, nearcopies, suffix
from hourline.llm.common import forget, fresh, table, written


#: Scratch tables that results of stages still read.
_left: list[DataFrame] = []


def _settle(docs: DataFrame) -> None:
    """Deletes scratch tables of earlier stages that docs doesn't read: their results have been written since."""
    if _left:
        files = docs.inputFiles()
        for t in [t for t in _left if t.sparkSession is docs.sparkSession and not any(t.scratch.rsplit("/", 1)[-1] in f for f in files)]:
            forget(t)
            _left.remove(t)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: null texts, texts without a letter, and texts between languages."""
    _settle(docs)
    said = fresh(docs, "said")
    judged = docs.withColumn(said, language.predictor(spark, language.fit(docs))(F.col("text")))
    return judged.where(f"{said}.lang_pred <> 'und' and not {said}.ambiguous").select(*docs.columns)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id (null last) of each component of near copies (Jaccard of five-word shingles 0.8 or more)."""
    _settle(docs)
    row = fresh(docs, "row")
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()), bucket=row)
    found = nearcopies.near_copies(rows, row)
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.xxhash64("text"), F.col(row))
    ranked = rows.select(F.col(row).alias("id"), order.alias("order")).join(found, "id")
    first = written(ranked.groupBy("component_id").agg(F.min(F.struct("order", "id"))["id"].alias(row)).select(row))
    forget(found)
    _left.extend((rows, first))
    return rows.join(first, row, "left_semi").select(*docs.columns)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated passages out of the texts; a document of which no word is left goes."""
    _settle(docs)
    cut = suffix.remove(docs.select("text", F.struct(*docs.columns).alias("whole")))
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    out = written(cut.select(*[new.get(c, F.col("whole")[c]).alias(c) for c in docs.columns], (F.col("n_removed") > 0).alias(gone := fresh(docs, "gone"))))
    forget(*cut.behind)
    _left.append(out)
    return out.where(~F.coalesce(gone, F.lit(False)) | F.col("text").rlike(r"[^\x20\x09-\x0D]")).drop(gone)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each document as often as the mix takes it."""
    _settle(docs)
    row, copy = fresh(docs, "row"), fresh(docs, "copy")
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()))
    times = mixing.mix(rows, keep=(row,)).where("size > 0 and copies > 0").select(row, F.sequence(F.lit(1).cast("long"), F.col("copies")).alias(copy))
    _left.append(rows)
    return rows.join(times, row).withColumn(copy, F.explode(copy)).select(*docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left."""
    _settle(docs)
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language ID", language_id),
    ("SimHash near-dedup", simhash_near_dedup),
    ("suffix-array dedup", suffix_array_dedup),
    ("mixing sources", mix_sources),
    ("byte-level BPE", byte_bpe),
]

#: Fingerprints, learned languages and merges are beyond SQL; tests/llm/test_pipeline.py compares with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, kept = table(spark, sf_dir, "documents"), []
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
        if kept:
            forget(kept.pop())
        kept.append(docs)
    return docs
