"""Helpers shared by the corpus operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the contracts: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: A byte of ASCII white space.
SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: Ends every SQL execution by dropping its shuffle files; written tables don't need them.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Without it, collected lists are grouped by sorting: once for both steps and the join after, a group at a time.
HASH_LISTS = "spark.sql.execution.useObjectHashAggregateExec"
#: Bytes that go to Python at once; texts may be long, and a batch is held by Spark and by Python.
BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: How written tables are stored: quick to write, since they are read once or a few times.
FAST = {"compression": "zstd", "parquet.compression.codec.zstd.level": "1", "parquet.enable.dictionary": "false", "parquet.block.size": str(16 << 20)}
_WHILE = {CLEANUP: "true", HASH_LISTS: "false", BYTES: str(4 << 20)}


@contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """Sets what is wanted and puts the session's own settings back."""
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def fresh(df: DataFrame, name: str) -> str:
    """The name, with as many underscores in front as it takes to be no column's."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the cluster's checkpoint folder (a temporary one is set where Spark runs in one process, as in tests)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return f"{sc.getCheckpointDir()}/{uuid.uuid4().hex}"


def written(df: DataFrame, bucket: str | None = None) -> DataFrame:
    """df, written to the shared folder and read again: cuts the lineage and survives lost executors.

    With a bucket column, rows are dealt out by its hash once, and later joins on it don't shuffle them again.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    with settings(spark, _WHILE):
        if bucket is None:
            df.write.options(**FAST).parquet(path)
            out = spark.read.schema(df.schema).parquet(path)
        else:
            parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
            name = f"scratch_{uuid.uuid4().hex}"
            dealt = df.repartition(parts, bucket).write.options(**FAST).option("path", path)
            try:
                dealt.bucketBy(parts, bucket).format("parquet").saveAsTable(name)
                out = spark.table(name).select(*df.columns)
            finally:  # the files stay when the name goes
                spark.sql(f"drop table if exists {name}")
    out.scratch = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.scratch)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def local_table(spark: SparkSession, rows: list, ddl: str) -> DataFrame:
    """A table of a few rows, by way of Arrow; rows of Python objects would start Python workers of another kind on each executor."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(ddl)
    return spark.createDataFrame(pa.Table.from_pylist([dict(zip(schema.names, r)) for r in rows], schema=to_arrow_schema(schema)), schema)


def in_order(df: DataFrame, order: list[Column], name: str, range_name: str | None = None) -> DataFrame:
    """df, written in ranges of the order, with each row's place in it from 0 (and the number of its range); a row a range comes to the driver."""
    spark, at = df.sparkSession, fresh(df, "at")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = written(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()))
    part, total, before = F.shiftright(at, 33), 0, []
    for r in sorted(rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()):
        before.append((r["part"], total))
        total += r["n"]
    of = local_table(spark, before, "_part long, _before long")
    placed = rows.join(F.broadcast(of), part == F.col("_part"), "left")  # a row a partition
    return placed.select(*df.columns, *([part.alias(range_name)] if range_name else []), (F.col("_before") + F.col(at).bitwiseAND((1 << 33) - 1)).alias(name))


def slices(raw: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """A text in pieces of about size bytes, cut at spaces only."""
    at = 0
    while at < len(raw):
        gap = SPACE.search(raw, at + size)
        end = gap.start() if gap else len(raw)
        yield raw[at:end]
        at = end


def words(text: Column) -> Column:
    """The words of a text as an array; null counts as empty."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")
