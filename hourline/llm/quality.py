"""Quality rules over words and lines, with cross-document line frequency per host; DataFrame operations only.

Base figures come from one pass over each text. Lines are compared across documents by a hash of their lower-cased
form with white space collapsed: a line of a host that stands in more than max(``floor``, ``share`` of the host's
documents) distinct texts is boilerplate, and a document that keeps fewer than ``least_words`` words, or less than
``least_share`` of them, without its boilerplate is rejected as depleted.

A null text counts as empty; a null host is a host of its own. Copies of a text on a host count as one document, so a
copied document is not its own boilerplate. Repeated rows get the same verdict each. Columns other than the named are
dropped. Rows are told apart by id and text hash, so null and repeated ids do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourline.llm.common import let, table, words, written

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: A line is boilerplate above this many texts of its host, and above this share of them.
FLOOR, SHARE = 20, 0.002
LEAST_WORDS, LEAST_SHARE = 10, 0.5


def repeated_words(w: Column, n: int = 5) -> Column:
    """How many of the words w stand in an n-word window that is found twice or more among them."""

    def covered(h: Column) -> Column:
        def of_sorted(s: Column) -> Column:
            same = lambda i, j: F.coalesce(F.get(s, i)["h"] == F.get(s, j)["h"], F.lit(False))
            at = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: same(i, i - 1) | same(i, i + 1))
            places = F.sort_array(F.transform(at, lambda i: F.get(s, i)["i"]))
            step = lambda acc, p: F.struct((acc["total"] + F.least(F.lit(n), p - acc["last"])).alias("total"), p.alias("last"))
            return F.aggregate(places, F.struct(F.lit(0).alias("total"), F.lit(-n).alias("last")), step, lambda acc: acc["total"])

        return let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), of_sorted)

    hashes = F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.xxhash64(F.slice(w, i, n)))
    many = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h)))
    return F.when(F.size(w) < n + 1, 0).otherwise(many)


def lines(text: Column) -> Column:
    """The lines of a text that have a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.translate(x, SPACE, "") != "")


def base(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, th (hash of the text), n_words, the four figures and base_failed of every row."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    seen = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        F.xxhash64(t).alias("th"),
        let(words(t), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).cast("long").alias("r"))).alias("w"),
        F.length(F.translate(t, SPACE, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines(t), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )
    out = seen.select("doc_id", "source", "th", F.col("w.n").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", F.col("w.r").alias("n_repeat_words"))
    return out.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def boilerplate(docs: DataFrame, id_col: str, text_col: str, source_col: str, floor: int, share: float) -> DataFrame:
    """doc_id, th and removed_words of the documents that have boilerplate lines."""
    t = F.col(text_col)
    normal = F.transform(lines(t), lambda x: F.trim(F.regexp_replace(F.lower(x), r"[\x20\x09-\x0D]+", " ")))
    pairs = F.transform(normal, lambda x: F.struct(F.xxhash64(x).alias("lh"), (F.length(x) - F.length(F.translate(x, " ", "")) + 1).alias("nw")))
    one = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.xxhash64(F.coalesce(t, F.lit(""))).alias("th"), F.explode(pairs).alias("line"))
    rows = written(one.select("doc_id", "th", "line.*", F.xxhash64(F.col("source").isNull(), "source").alias("host")))
    hosts = rows.groupBy("host").agg(F.count_distinct("th").alias("texts"))
    common = rows.groupBy("host", "lh").agg(F.count_distinct("th").alias("found")).where(F.col("found") > floor)
    common = written(common.join(hosts, "host").where(F.col("found") > share * F.col("texts")).select("host", "lh"))
    return rows.join(common, ["host", "lh"]).groupBy("doc_id", "th").agg(F.sum("nw").alias("words"), F.count("*").alias("n"))


def judge(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    floor: int = FLOOR,
    share: float = SHARE,
    least_words: int = LEAST_WORDS,
    least_share: float = LEAST_SHARE,
) -> DataFrame:
    """The columns of base, removed_words and kept for every row of docs."""
    rows = base(docs, id_col, text_col, source_col)
    copies = rows.select("doc_id", "th").groupBy("doc_id", "th").agg(F.count("*").alias("rows"))
    cut = boilerplate(docs, id_col, text_col, source_col, floor, share)
    cut = cut.join(copies, cut["doc_id"].eqNullSafe(copies["doc_id"]) & (cut["th"] == copies["th"])).select(cut["doc_id"], cut["th"], (F.col("words") / F.col("rows")).cast("long").alias("removed"))
    out = rows.join(cut, rows["doc_id"].eqNullSafe(cut["doc_id"]) & (rows["th"] == cut["th"]), "left").drop(cut["doc_id"], cut["th"])
    out = out.withColumn("removed_words", F.coalesce("removed", F.lit(0))).drop("removed")
    left = F.col("n_words") - F.col("removed_words")
    full = (left >= least_words) & (left >= least_share * F.col("n_words"))
    return out.withColumn("kept", ~F.col("base_failed") & full)


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP4_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i AS p, array_to_string(w[i:i + 4], ' ') AS k FROM d, unnest(range(1, greatest(len(w) - 3, 1))) AS u(i)),
c AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, k) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT p + j) AS n FROM c, unnest([0, 1, 2, 3, 4]) AS v(j) WHERE c.n > 1 GROUP BY doc_id),
l AS (SELECT doc_id, source, t, unnest(string_split(t, chr(10))) AS line FROM d),
m AS (SELECT *, trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g')) AS k FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM m GROUP BY doc_id),
h AS (SELECT source, count(DISTINCT t) AS texts FROM m GROUP BY source),
f AS (SELECT m.source, k FROM m JOIN h ON m.source IS NOT DISTINCT FROM h.source GROUP BY m.source, k, texts HAVING count(DISTINCT t) > 20 AND count(DISTINCT t) > 0.002 * texts),
x AS (SELECT doc_id, sum(length(m.k) - length(replace(m.k, ' ', '')) + 1) AS n FROM m JOIN f ON m.k = f.k AND m.source IS NOT DISTINCT FROM f.source GROUP BY doc_id),
b AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, coalesce(x.n, 0) AS cut
  FROM d LEFT JOIN r USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN x USING (doc_id)),
e AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND n_words - cut >= 10 AND n_words - cut >= 0.5 * n_words AS kept FROM e
"""
