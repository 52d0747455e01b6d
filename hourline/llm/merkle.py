"""A Merkle manifest of a dataset with a proof for every row, by one octopus multiproof a leaf partition.

Rows become leaves: the hash of their fields. The leaves of a group (language) ascend by id and make a tree of fan-out 8;
the groups' roots, in the order of groups, make the tree above. A proof lists the siblings of each node on a leaf's way up.

1. Leaves are hashed in the rows' own partitions, sorted by ranges and numbered; texts don't go on. A piece is what a range holds
   of a group.
2. Interior nodes are written level by level, one row a node.
3. A piece works out the coordinates of the nodes that its leaves' proofs need and its leaves can't give: at each level the
   rest of the runs at its two edges, fourteen nodes at most, whatever the piece holds. This union is fetched by one join.
4. Each piece derives the nodes that its leaves share, once, and expands the proof of each leaf from them. What the proof gives
   with the row's present content is compared with the root.

Null fields count as ``-``, so null texts and groups have leaves, and a null group is the first tree. Null ids come
first. Rows with equal ids are ordered by their leaves, so repeated rows are neighbours of equal hashes but of own proofs.
A row without siblings (a table of one row) has the hash of nothing as proof. Texts of any length are hashed by the JVM,
whole. An empty table gives an empty one. Columns other than the named are no part of the leaves unless listed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hourline.llm.common import forget, in_order, table, written

FAN = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf(fields: list[Column]) -> Column:
    """The hash of fields, each told apart by its length in bytes."""
    one = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.sha2(F.concat(*[one(c.cast("string")) for c in fields]), 256)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def levels(nodes: DataFrame, most: int) -> list[DataFrame]:
    """The levels above nodes (tree, n, at, h), written, up to the one in which the largest tree (of most leaves) has one node; n is a tree's width in each."""
    out = [nodes]
    while most > 1:
        runs = out[-1].where("n > 1").groupBy("tree", F.floor(F.col("at") / FAN).alias("at")).agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("at", "h")))["h"].alias("hs"))
        out.append(written(runs.select("tree", F.ceil(F.col("n") / FAN).alias("n"), "at", F.sha2(F.array_join("hs", ""), 256).alias("h"))))
        most = -(-most // FAN)
    return out


def tops(nodes: list[DataFrame]) -> DataFrame:
    """tree and h of the roots of all trees."""
    found = [x.where("n = 1").select("tree", "h") for x in nodes]
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def missing(first: Column, last: Column, n: Column, depth: int) -> Column:
    """The coordinates (level, at) that the proofs of leaves first to last of a tree of n leaves need besides these."""

    def of(level: Column) -> Column:
        size = F.pow(F.lit(FAN), level).cast("long")
        a, b, width = F.floor(first / size), F.floor(last / size), F.ceil(n / size)
        left = F.filter(F.transform(F.sequence(F.lit(0), F.lit(FAN - 1)), lambda i: a - a % FAN + i), lambda x: x < a)
        right = F.filter(F.transform(F.sequence(F.lit(0), F.lit(FAN - 1)), lambda i: b - b % FAN + i), lambda x: (x > b) & (x < width))
        return F.when(width > 1, F.transform(F.concat(left, right), lambda x: F.struct(level.cast("int").alias("level"), x.alias("at")))).otherwise(F.array().cast("array<struct<level:int,at:bigint>>"))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(max(depth - 1, 0))), of))


class Shared:
    """What the leaves of a piece share: all nodes of the runs that they and their ancestors lie in."""

    def __init__(self, first: int, own: list[str], n: int, fetched: dict[tuple[int, int], str]):
        self.level: list[tuple[int, list[str]]] = []
        level = 0
        while n > 1:
            base, last = first - first % FAN, first + len(own)
            end = min(n, -(-last // FAN) * FAN)
            full = [fetched[level, i] for i in range(base, first)] + own + [fetched[level, i] for i in range(last, end)]
            self.level.append((base, full))
            own = [sha("".join(full[i : i + FAN])) for i in range(0, len(full), FAN)]
            first, n, level = base // FAN, -(-n // FAN), level + 1
        self.root = own[0] if n == 1 and own else ""

    def way(self, at: int, level: int = 0) -> list[tuple[str, str]]:
        """The siblings left and right of a node and of those above it, joined, level by level."""
        out = []
        for base, full in self.level[level:]:
            place = at - base
            run = place - place % FAN
            out.append(("".join(full[run:place]), "".join(full[place + 1 : run + FAN])))
            at //= FAN
        return out


def fold(h: str, way: list[tuple[str, str]]) -> str:
    for left, right in way:
        h = sha(left + h + right)
    return h


def expanded(leaves: pa.Table, fetched: pa.Table) -> Iterator[tuple[str, str, str, str]]:
    """subroot, root, proof_sha256 and folded_root of each leaf of a piece, by place."""
    if not leaves.num_rows:
        return
    facts = leaves.slice(0, 1).to_pylist()[0]
    known: tuple[dict, dict] = ({}, {})
    for r in fetched.to_pylist():
        known[r["top"]][r["level"], r["node"]] = r["h"]
    hs, now, first = leaves.column("leaf").to_pylist(), leaves.column("now").to_pylist(), facts["at"]
    tree = Shared(first, hs, facts["n"], known[0])
    subroot = tree.root if facts["n"] > 1 else hs[0]
    above = Shared(facts["tree"], [subroot], facts["trees"], known[1])
    root = above.root if facts["trees"] > 1 else subroot
    top = above.way(facts["tree"])
    parent, way, rest = -1, [], ""
    for i, (h, h2) in enumerate(zip(hs, now), first):
        if i // FAN != parent and facts["n"] > 1:
            parent = i // FAN
            way = tree.way(parent, 1) + top
            rest = "".join(a + b for a, b in way)
        if facts["n"] > 1:
            base, full = tree.level[0]
            run, place = parent * FAN - base, i - base
            left, right = "".join(full[run:place]), "".join(full[place + 1 : run + FAN])
            yield subroot, root, sha(left + right + rest), fold(sha(left + h2 + right), way)
        else:
            yield subroot, root, sha("".join(a + b for a, b in top)), fold(h2, top)


def manifest(docs: DataFrame, now: list[Column], fields: list[Column], id_col: str = "doc_id", group_col: str = "lang") -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root (of the content now) and verified of every row of docs."""
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    hashed = written(docs.select(F.col(id_col).alias("doc_id"), F.col(group_col).alias("grp"), leaf(fields).alias("leaf"), leaf(now).alias("now")))
    # the row number spreads copies of a row, whose order among themselves changes no hash
    order = [F.asc_nulls_first("grp"), F.asc_nulls_first("doc_id"), F.asc("leaf"), F.asc("now"), F.xxhash64("row")]
    placed = in_order(hashed.withColumn("row", F.monotonically_increasing_id()), order, "place", "part").drop("row")
    groups = placed.groupBy("grp").agg(F.min("place").alias("start"), F.count("*").alias("n"))
    groups = written(groups.withColumn("tree", F.row_number().over(W.orderBy("start")).cast("long") - 1))  # a row a group
    size = groups.agg(F.max("n").alias("n"), F.count("*").alias("trees")).first()
    if not size["trees"]:
        return hashed.select("doc_id", "leaf", *[F.lit("").alias(c) for c in ("subroot", "root", "proof_sha256", "folded_root")], F.lit(True).alias("verified"))
    rows = placed.join(groups.withColumnRenamed("grp", "g"), placed["grp"].eqNullSafe(F.col("g")))
    rows = written(rows.select("doc_id", "leaf", "now", "part", "tree", "n", (F.col("place") - F.col("start")).alias("at"), F.lit(size["trees"]).cast("long").alias("trees")))
    nodes = levels(rows.select("tree", "n", "at", F.col("leaf").alias("h")), size["n"])
    subroots = tops(nodes).select(F.lit(0).cast("long").alias("tree"), F.lit(size["trees"]).cast("long").alias("n"), F.col("tree").alias("at"), "h")
    above = levels(written(subroots), size["trees"])
    pieces = written(rows.groupBy("part", "tree").agg(F.min("at").alias("a"), F.max("at").alias("b"), F.max("n").alias("n")))

    def coordinates(first: Column, last: Column, n: Column, depth: int, top: int) -> DataFrame:
        return pieces.select("part", "tree", F.explode(missing(first, last, n, depth)).alias("c")).select("part", "tree", F.lit(top).alias("top"), "c.level", F.col("c.at").alias("node"))

    wanted = coordinates(F.col("a"), F.col("b"), F.col("n"), len(nodes) - 1, 0).unionByName(coordinates(F.col("tree"), F.col("tree"), F.lit(size["trees"]), len(above) - 1, 1))
    # of the leaves only those within a run of a piece's edges can be missing elsewhere
    near = rows.join(pieces.select("part", "tree", "a", "b"), ["part", "tree"]).where((F.col("at") < F.col("a") + FAN) | (F.col("at") > F.col("b") - FAN))
    there = near.select(F.lit(0).alias("top"), "tree", F.lit(0).alias("level"), F.col("at").alias("node"), F.col("leaf").alias("h"))
    for top, made in ((0, nodes), (1, above)):
        for level, x in enumerate(made):
            if top or level:
                there = there.unionByName(x.select(F.lit(top).alias("top"), "tree", F.lit(level).alias("level"), F.col("at").alias("node"), "h"))
    of = F.when(F.col("top") == 0, F.col("tree")).otherwise(0).alias("of")
    fetched = wanted.select("*", of).join(there.withColumnRenamed("tree", "of"), ["top", "of", "level", "node"]).select("part", "tree", "top", "level", "node", "h")

    def run(leaves: pa.Table, known: pa.Table) -> pa.Table:
        leaves = leaves.sort_by("at")
        made = list(expanded(leaves, known))
        new = [pa.array([r[k] for r in made], pa.string()) for k in range(4)]
        same = pa.array([r[1] == r[3] for r in made], pa.bool_())
        return pa.Table.from_arrays([leaves.column("doc_id"), leaves.column("leaf"), *new, same], ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    out = rows.groupBy("part", "tree").cogroup(fetched.groupBy("part", "tree")).applyInArrow(run, f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    out = written(out)
    forget(hashed, rows, pieces, *nodes[1:], *above)
    return out


def lowered(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def op12_merkle(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fields = [F.col(c) for c in FIELDS]
    hit = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    return manifest(docs, [*fields[:-1], F.when(hit, lowered(F.col("text"))).otherwise(F.col("text"))], fields)


_ONE = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"
_LEAF = "sha256(" + " || ".join(_ONE.format(c) for c in FIELDS) + ")"
_LOW = f"translate(text, '{_UPPER}', '{_LOWER}')"
_CRC3 = """xor(list_reduce(list_prepend(4294967295::BIGINT, [ord(x)::BIGINT for x in string_split(doc_id::VARCHAR, '')]),
  lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda e, z: CASE WHEN e & 1 = 1 THEN xor(3988292384, e >> 1) ELSE e >> 1 END)), 4294967295) % 3 = 0"""
#: Trees by level, those of groups and the one above; then all leaves' ways up, a level at a time.
OP12_SQL = f"""
WITH RECURSIVE d AS (SELECT *, {_LEAF} AS leaf, {_CRC3} AS hit, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM documents),
l AS (SELECT doc_id, tree, leaf, CASE WHEN hit THEN {_LEAF.replace("text", _LOW)} ELSE leaf END AS now, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM d),
t AS (SELECT tree, 0 AS level, pos, n, leaf AS h FROM l
  UNION ALL SELECT tree, level + 1, pos // 8, (max(n) + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM t WHERE n > 1 GROUP BY tree, level, pos // 8),
s AS (SELECT tree AS pos, h FROM t WHERE n = 1),
u AS (SELECT 0 AS level, pos, (SELECT count(*) FROM s) AS n, h FROM s
  UNION ALL SELECT level + 1, pos // 8, (max(n) + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM u WHERE n > 1 GROUP BY level, pos // 8),
x AS (SELECT tree, level, pos, h FROM t WHERE n > 1 UNION ALL SELECT -1, level, pos, h FROM u WHERE n > 1),
b AS (SELECT a.tree, a.level, a.pos, coalesce(string_agg(o.h, '' ORDER BY o.pos) FILTER (o.pos < a.pos), '') AS lft, coalesce(string_agg(o.h, '' ORDER BY o.pos) FILTER (o.pos > a.pos), '') AS rgt
  FROM x a JOIN x o ON a.tree = o.tree AND a.level = o.level AND a.pos // 8 = o.pos // 8 GROUP BY a.tree, a.level, a.pos),
f1 AS (SELECT doc_id, tree, leaf, pos, 0 AS level, now AS h, '' AS sib FROM l
  UNION ALL SELECT f1.doc_id, f1.tree, leaf, f1.pos // 8, f1.level + 1, sha256(lft || h || rgt), sib || lft || rgt FROM f1 JOIN b ON b.tree = f1.tree AND b.level = f1.level AND b.pos = f1.pos),
g1 AS (SELECT doc_id, tree, leaf, h, sib FROM (SELECT *, max(level) OVER (PARTITION BY tree) AS most FROM f1) WHERE level = most),
f2 AS (SELECT doc_id, tree, leaf, tree AS pos, 0 AS level, h, sib FROM g1
  UNION ALL SELECT doc_id, f2.tree, leaf, f2.pos // 8, f2.level + 1, sha256(lft || h || rgt), sib || lft || rgt FROM f2 JOIN b ON b.tree = -1 AND b.level = f2.level AND b.pos = f2.pos),
g2 AS (SELECT * FROM (SELECT *, max(level) OVER () AS most FROM f2) WHERE level = most)
SELECT doc_id, leaf, s.h AS subroot, (SELECT h FROM u WHERE n = 1) AS root, sha256(sib) AS proof_sha256, g2.h AS folded_root, g2.h = (SELECT h FROM u WHERE n = 1) AS verified
FROM g2 JOIN s ON s.pos = g2.tree
"""
