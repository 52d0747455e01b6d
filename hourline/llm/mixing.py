"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

Targets: sources in code point order (null last) weigh as the repeated pattern says and share a budget of
``share`` times all sizes by weight. No target exceeds ``cap`` times its source's size; what is cut is shared among
the others by weight until none is above. That is one level L with target = min(cap * size, L * weight), found from the
sources in the order of cap * size / weight.

Documents: a source is taken whole as often as its target holds its size. For the rest each document gets the key
-ln(u) / quality, u being fixed by its id and length; documents of ascending key are taken once more as long as their
sizes' prefix sum stays within the rest. What the first document beyond it leaves open is filled likewise: by those of the
others that are no larger than the gap, in the order of their keys, and at last by the one document whose size is nearest
to what is then missing, if it brings the sum nearer (ties: key, then id). So a source misses its target by no more than
half the size of the smallest document that is not taken, if that is no larger than the gap. Prefix sums run inside slices of the
key's range, to which the sums of the slices before are added, so that no source is sorted in one task; only the table of
sources, a row each, is.

A null text has size 0 and takes no words; a null source is a source of its own. Repeated rows have equal keys and
stand next to each other. An empty source gets no target. Of long texts only the size is carried on. Columns other than
the named ones and those in ``keep`` are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hourline.llm.common import WORD, forget, table, written

#: Slices of a source's key range.
SLICES = 1024


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality(text: Column) -> Column:
    """0.5 to 1.5: falls with the share of characters that are ASCII signs or digits."""
    odd = F.length(text) - F.length(F.translate(text, "0123456789#*$%&|<>@_=+/\\{}[]~^", ""))
    return F.coalesce(F.round(F.lit(1.5) - odd / F.greatest(F.length(text), F.lit(1)), 6), F.lit(1.0))


def uniform(key: Column) -> Column:
    """A number in (0, 1) that is fixed by a string."""
    return (F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("double") + 0.5) / float(16**12)


def targets(sizes: DataFrame, share: float, cap: float, pattern: tuple[int, ...]) -> DataFrame:
    """source, source_size and target of a table with a row per source."""
    order = W.orderBy(F.col("source").isNull(), "source")
    cycle = F.array(*[F.lit(float(x)) for x in pattern])
    by_ratio = W.orderBy("ratio", F.col("source").isNull(), "source")
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(W.currentRow, W.unboundedFollowing)
    ranked = (
        sizes.withColumn("weight", F.element_at(cycle, (F.row_number().over(order) - 1) % len(pattern) + 1))
        .withColumn("top", cap * F.col("source_size"))
        .withColumn("ratio", F.col("top") / F.col("weight"))
        .withColumn("budget", share * F.sum("source_size").over(W.partitionBy()))
        .withColumn("full", F.coalesce(F.sum("top").over(before), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(after))
        .withColumn("level", (F.col("budget") - F.col("full")) / F.col("open"))
    )
    # the first source that the level doesn't fill sets it; where the caps bind all, none does
    found = F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "level"))).over(W.partitionBy())["level"]
    return ranked.select("source", "source_size", F.coalesce(F.least("top", found * F.col("weight")), F.col("top")).alias("target"))


def prefix_sums(rows: DataFrame) -> DataFrame:
    """rows with prefix, the sum of size over the rows of its source up to each in the order of key, doc_id and size."""
    before = W.partitionBy("source").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = rows.groupBy("source", "slice").agg(F.sum("size").alias("n")).withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = W.partitionBy("source", "slice").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    summed = rows.withColumn("within", F.sum("size").over(inside))
    both = summed.join(offsets, summed["source"].eqNullSafe(offsets["source"]) & (summed["slice"] == offsets["slice"])).drop(offsets["source"], offsets["slice"])
    return both.withColumn("prefix", F.col("offset") + F.col("within")).drop("offset", "within")


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    share: float = 1.5,
    cap: float = 2.0,
    pattern: tuple[int, ...] = (5, 2, 1),
    seed: str = "mix",
    slices: int = SLICES,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (words, repeats counted), copies and the columns in keep of every row of docs."""
    text = F.col(text_col)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        n_words(text).alias("size"),
        uniform(F.concat_ws("|", F.lit(seed), F.col(id_col).cast("string"), F.length(text).cast("string"))).alias("u"),
        quality(text).alias("quality"),
        F.struct(*keep).alias("keep") if keep else F.lit(None).cast("string").alias("keep"),
    )
    rows = written(rows.withColumn("key", -F.ln("u") / F.col("quality")).withColumn("slice", F.floor(F.exp(-F.col("key")) * -slices).cast("int")))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = (
        targets(sizes, share, cap, pattern)
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    )
    goal = written(goal)  # a row a source

    def of_source(facts: DataFrame, df: DataFrame) -> DataFrame:
        return df.join(facts, df["source"].eqNullSafe(facts["source"])).drop(facts["source"])

    plain = [c for c in rows.columns if c not in ("u", "quality")]
    first = written(of_source(goal, prefix_sums(rows.select(*plain))).withColumn("again", F.col("prefix") <= F.col("rest")).drop("prefix").withColumn("row", F.monotonically_increasing_id()))
    gap = first.groupBy("source").agg((F.first("rest") - F.coalesce(F.sum(F.when(F.col("again"), F.col("size"))), F.lit(0))).alias("gap"))
    small = of_source(gap, first.where("not again and size > 0").select("row", "source", "doc_id", "size", "key", "slice")).where("size <= gap")
    second = written(prefix_sums(small).where("prefix <= gap").select("row", "source", "size"))
    filled = second.groupBy("source").agg(F.sum("size").alias("filled"))
    gap = gap.join(filled, gap["source"].eqNullSafe(filled["source"]), "left").select(gap["source"], (F.col("gap") - F.coalesce("filled", F.lit(0))).alias("gap"))
    open_ = first.where("not again and size > 0").join(second.select("row"), "row", "left_anti").select("row", "source", "doc_id", "size", "key")
    off = F.abs(F.col("size") - F.col("gap"))
    third = of_source(gap, open_).where(off < F.col("gap")).groupBy("source").agg(F.min(F.struct(off.alias("off"), "key", "doc_id", "row")).alias("best")).select("best.row")
    more = second.select("row").unionByName(third).withColumn("more", F.lit(True))
    more = written(more)
    out = first.join(more, "row", "left")
    copies = F.col("epochs") + (F.col("again") | F.coalesce("more", F.lit(False))).cast("long")
    kept = [F.col("keep")[c].alias(c) for c in keep]
    forget(rows, goal, second)
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"), *kept)


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    (('0x' || substr(md5(concat_ws('|', 'mix', doc_id::VARCHAR, length(text)::VARCHAR)), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0 AS u,
    coalesce(round(1.5 - (length(text) - length(regexp_replace(text, '[0-9#*$%&|<>@_=+/\\{}\[\]~^]', '', 'g')))::DOUBLE / greatest(length(text), 1), 6), 1.0) AS q
  FROM documents),
k AS (SELECT *, -ln(u) / q AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS top, 1.5::DOUBLE * sum(source_size) OVER () AS budget FROM s),
r AS (SELECT *, top / weight AS ratio FROM w),
l AS (SELECT *, (budget - coalesce(sum(top) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
f AS (SELECT arg_min(level, ratio) AS level FROM l WHERE ratio > level),
t AS (SELECT source, source_size, coalesce(least(top, f.level * weight), top) AS target FROM l, f),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM t),
p AS (SELECT k.*, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest,
  sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS prefix
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source),
g1 AS (SELECT source, any_value(rest) - coalesce(sum(size) FILTER (prefix <= rest), 0) AS gap FROM p GROUP BY source),
s1 AS (SELECT p.doc_id, p.source, p.size, gap, sum(size) OVER (PARTITION BY p.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS filled
  FROM p JOIN g1 ON p.source IS NOT DISTINCT FROM g1.source WHERE prefix > rest AND size > 0 AND size <= gap),
t1 AS (SELECT doc_id, source, size FROM s1 WHERE filled <= gap),
g2 AS (SELECT g1.source, gap - coalesce((SELECT sum(size) FROM t1 WHERE t1.source IS NOT DISTINCT FROM g1.source), 0) AS gap FROM g1),
c AS (SELECT p.doc_id, row_number() OVER (PARTITION BY p.source ORDER BY abs(p.size - gap), key, p.doc_id) AS n
  FROM p JOIN g2 ON p.source IS NOT DISTINCT FROM g2.source WHERE prefix > rest AND size > 0 AND abs(p.size - gap) < gap AND p.doc_id NOT IN (SELECT doc_id FROM t1)),
x AS (SELECT doc_id FROM t1 UNION SELECT doc_id FROM c WHERE n = 1)
SELECT doc_id, size, source_size, target, (size * (epochs + CASE WHEN prefix <= rest OR doc_id IN (SELECT doc_id FROM x) THEN 1 ELSE 0 END))::BIGINT AS taken FROM p
"""
