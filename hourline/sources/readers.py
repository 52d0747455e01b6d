"""Readers of untidy inputs."""

from __future__ import annotations

import re

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourline.functions.clean import parse_period


#: What reading raises: errors of planning, and those of tasks.
BROKEN = (PySparkException, Py4JJavaError)


def read_messy_csv(spark: SparkSession, path: str, columns: list[str], sep: str = ";", lang: str = "en") -> DataFrame:
    """Text columns of a delimited file whose preamble and footer are told by a first field that is no period."""
    df = spark.read.csv(path, sep=sep, schema=", ".join(f"`{c}` string" for c in columns), mode="PERMISSIVE", encoding="UTF-8")
    first = F.regexp_replace(F.col(columns[0]), "^\ufeff", "")
    return df.withColumn(columns[0], first).withColumn("period", parse_period(first, lang)).where("period is not null")


def read_wide_periods(spark: SparkSession, path: str, header: str = "Topic", sep: str = ";", key_cols: int = 2, halves: tuple[str, ...] = ("yy", "qq")) -> DataFrame:
    """topic, metric, period and value of a table whose period columns come once for each of halves; the header row starts with header."""
    text = spark.read.text(path, wholetext=False)
    cells = text.select(F.transform(F.split(F.regexp_replace("value", "^\ufeff", ""), sep), lambda x: F.trim(F.regexp_replace(x, '^"|"$', ""))).alias("c")).where(F.size("c") > key_cols)
    head = F.broadcast(cells.where(F.get("c", 0) == header).limit(1).select(F.col("c").alias("h")))
    pos = F.posexplode(F.slice("c", key_cols + 1, F.greatest(F.size("c") - key_cols, F.lit(0)))).alias("pos", "value")
    rows = cells.where((F.get("c", 0) != header) & ~F.get("c", 0).startswith("Source")).join(head).select(F.get("c", 0).alias("topic"), "h", pos)
    per_half = (F.size("h") - key_cols) / len(halves)
    names = F.array(*[F.lit(h) for h in halves])
    return rows.select("topic", F.get(names, F.floor(F.col("pos") / per_half).cast("int")).alias("metric"), F.get("h", F.col("pos") + key_cols).alias("period"), "value")


def two_columns(df: DataFrame, first: tuple[str, ...] = ("year", "jaar"), second: tuple[str, ...] = ("pop", "bev")) -> DataFrame:
    """year and population of a table whose header names them somehow; else its first two columns."""
    find = lambda parts, at: next((c for c in df.columns if any(p in c.lower() for p in parts)), df.columns[at])
    return df.select(F.col(find(first, 0)).alias("year"), F.col(find(second, 1)).alias("population"))


def layout(df: DataFrame) -> str:
    """wide if there is a country and numbered hour columns, else long."""
    hours = [c for c in df.columns if c.replace(".0", "").isdigit()]
    return "wide" if "Country" in df.columns and len(hours) >= 24 else "long"


def read_many(spark: SparkSession, paths: list[str], kind: str | None = None, schema: str | None = None, **options) -> tuple[DataFrame | None, list[tuple[str, str]]]:
    """The union of all files that can be read to their end, columns aligned by name (None if there is none), and the others with the reason.

    Files of one layout are read together. They are gone through once without keeping anything; a file that breaks is left
    out, whole, and the others are gone through again. So each bad file costs one more pass, and no file more than that. CSV rows that don't
    fit the columns break their file.
    """
    bad: list[tuple[str, str]] = []
    layouts: dict[str, list[str]] = {}
    frames: dict[str, DataFrame] = {}

    def opened(many: list[str]) -> DataFrame:
        how = kind or many[0].rsplit(".", 1)[-1]
        reader = spark.read.options(**({"mode": "FAILFAST"} if how in ("csv", "json") else {}) | options).format(how)
        return (reader.schema(schema) if schema else reader).load(many)

    for path in paths:
        try:
            layouts.setdefault(f"{path.rsplit('.', 1)[-1]} {opened([path]).schema.json()}", []).append(path)
        except BROKEN as e:
            bad.append((path, _reason(e)))
    for layout, many in layouts.items():
        while many:
            frame = opened(many).withColumn("file", F.col("_metadata.file_name"))
            try:
                frame.write.format("noop").mode("overwrite").save()
            except BROKEN as e:
                broken = [p for p in many if _named(p, str(e))] or (many if len(many) == 1 else [])
                if not broken:  # the error names no file: each is tried alone
                    broken = [p for p in many if not _whole(opened([p]))]
                if not broken:
                    raise
                bad += [(p, _reason(e)) for p in broken]
                many = [p for p in many if p not in broken]
                continue
            frames[layout] = frame
            break
    out = None
    for frame in frames.values():
        out = frame if out is None else out.unionByName(frame, allowMissingColumns=True)
    return out, bad


def _reason(e: Exception) -> str:
    """The last condition that an error names, which is the innermost."""
    found = re.findall(r"\[([A-Z][A-Z_]+)[\]. ]", str(e))
    return found[-1] if found else type(e).__name__


def _named(path: str, error: str) -> bool:
    """Whether an error names a file."""
    return re.search(rf"/{re.escape(path.rstrip('/').rsplit('/', 1)[-1])}(?![\w.-]*\w)", error) is not None


def _whole(df: DataFrame) -> bool:
    try:
        df.write.format("noop").mode("overwrite").save()
    except BROKEN:
        return False
    return True


def prefer_value(df: DataFrame, keys: list[str], value: str, fallback: str, name: str) -> DataFrame:
    """value where its file (keys) has any, else fallback."""
    has = df.groupBy(*keys).agg((F.count(value) > 0).alias("_has"))
    return df.join(has, keys).withColumn(name, F.when(F.col("_has"), F.col(value)).otherwise(F.col(fallback))).drop("_has")


def file_inventory(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """name and length of files, without reading them."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), "length")


def optional(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table, or an empty one of the schema if it is absent."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
    return spark.read.parquet(path) if there else spark.createDataFrame([], schema)


def discover(spark: SparkSession, patterns: list[str], exclude: str | None = None) -> list[str]:
    """Paths of the first of the patterns that finds any file whose name doesn't hold exclude; listed by Hadoop, so any store will do."""
    for pattern in patterns:
        glob = spark._jvm.org.apache.hadoop.fs.Path(pattern)
        found = glob.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(glob) or []
        paths = sorted(str(f.getPath().toString()) for f in found if exclude is None or exclude not in f.getPath().getName())
        if paths:
            return paths
    return []


def header_offset(spark: SparkSession, path: str, wanted: tuple[str, ...], sep: str = ";", most: int = 4) -> int | None:
    """How many lines stand above the header of a delimited file: the first of lines 0 to most that has all wanted names; None if none has."""
    return _header([r["value"] for r in spark.read.text(path).limit(most + 1).collect()], wanted, sep)


def _header(lines: list[str], wanted: tuple[str, ...], sep: str) -> int | None:
    return next((i for i, x in enumerate(lines) if set(wanted) <= {c.strip().strip('"') for c in x.lstrip("\ufeff").split(sep)}), None)


def read_below_header(spark: SparkSession, path: str, wanted: tuple[str, ...], sep: str = ";", most: int = 4) -> DataFrame | None:
    """The table below the header that is found by its names; columns are strings. None without a header.

    Lines are told apart by their place, so a row below that looks like the header or a line above it stays.
    """
    lines = [r["value"] for r in spark.read.text(path).limit(most + 1).collect()]
    at = _header(lines, wanted, sep)
    if at is None:
        return None
    names = [x.strip().strip('"') for x in lines[at].lstrip("\ufeff").split(sep)]
    # a file's first split begins with its first line, and lines of a split keep their order
    head = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("_at"), F.col("_metadata.file_block_start").alias("_block"))
    body = head.where((F.col("_block") > 0) | (F.col("_at").bitwiseAND((1 << 33) - 1) > at)).where(F.trim("value") != "")
    row = F.from_csv("value", F.lit(", ".join(f"`{c}` string" for c in names)), {"sep": sep, "mode": "PERMISSIVE"})
    return body.select(row.alias("r")).select("r.*")


def read_long_load(df: DataFrame, value: str = "Value", scaled: str = "Value_ScaleTo100", country: str | None = None) -> DataFrame:
    """timestamp_utc and load of a long table (CountryCode, DateUTC, value, scaled): value where the table has any, else scaled."""
    rows = df if country is None else df.where(F.trim("CountryCode") == country)
    cast = rows.select(F.lit(1).alias("k"), F.to_timestamp("DateUTC").alias("timestamp_utc"), *[F.expr(f"try_cast(`{c}` as double)").alias(n) if c in df.columns else F.lit(None).cast("double").alias(n) for c, n in ((value, "v"), (scaled, "s"))])
    return prefer_value(cast, ["k"], "v", "s", "load").select("timestamp_utc", "load")
