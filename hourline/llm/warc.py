"""Deterministic sharded WARC writer and reader.

Keys (page_id, digest, hash of the url) are counted, range-sorted, and summed up: a record's shard is the place of its
payload and header bytes in the whole order, divided by ``shard_bytes`` (or a share of all bytes, once that would make
more than ``MOST_SHARDS`` shards). So shards depend on the rows only, hold about the same bytes whatever the ids are, and
each is one task. Equal rows are counted, not moved: a group of them that lies in several shards is sent to each once,
with its share of the count. Inside a shard records are sorted by key and written as one gzip member each; a file is
rolled once it reaches ``roll_bytes`` compressed. Headers, record
ids and digests are made anew from the rows. A task writes under a temporary name of its own and renames finished files
to names that depend on shard and number alone, so an attempt that is repeated writes the same bytes to the same name.
What counts is the manifest, a Parquet table written last; the reader reads the files that it lists and checks records,
digests and lengths against it.

Payload: the html in UTF-8; null is empty. Of equal payloads of at least ``least`` bytes the one with the largest page_id
is a response and the others are revisits that refer to it; repeated rows of that page_id and payload are all responses.
Rows with a null page_id stand last, never are referred to, and revisit where an equal payload has an id. A null url has
no target field. Payloads are read whole at any length, an empty table gives an empty manifest, columns other than the
named are dropped.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hourline.llm.common import forget, local_table, shared_dir, table, written

MOST_SHARDS, SHARD_BYTES, ROLL_BYTES, LEAST = 1 << 16, 32 << 20, 8 << 20, 1000
READERS = 1 << 14
RECORD = 400  # bytes of headers, about
_SPACE = uuid.UUID("5e6f1b0e-7c0f-5d0b-9c59-3c0a4f0d8a11")
_MANIFEST = "shard int, file string, records long, bytes long, sha1 string"


def _uri(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}/{digest}')}>"


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """One record, not compressed; refers_to: the page_id of the response, else None."""
    b32 = base64.b32encode(bytes.fromhex(digest)).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_uri(page_id, digest)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in url))
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_uri(refers_to, digest)}", f"X-Refers-To-Page: {refers_to}"]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    head += [f"WARC-Payload-Digest: sha1:{b32}", f"X-Payload-Length: {len(payload)}", f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(data: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)  # the gzip header has no time or name
    return z.compress(data) + z.flush()


class _Roller:
    """Writes the files of one shard."""

    def __init__(self, fs, root: str, temp: str, shard: int, roll: int):
        self.fs, self.root, self.temp, self.shard, self.roll, self.number, self.out, self.done = fs, root, temp, shard, roll, 0, None, []

    def add(self, member: bytes) -> None:
        if self.out is None:
            self.name, self.records, self.size, self.sha1 = f"shard-{self.shard:06d}-{self.number:05d}.warc.gz", 0, 0, hashlib.sha1()
            self.out = self.fs.open_output_stream(f"{self.temp}/{self.name}", compression=None)
        self.out.write(member)
        self.sha1.update(member)
        self.records, self.size = self.records + 1, self.size + len(member)
        if self.size >= self.roll:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.fs.move(f"{self.temp}/{self.name}", f"{self.root}/{self.name}")
            self.done.append((self.shard, self.name, self.records, self.size, self.sha1.hexdigest()))
            self.out, self.number = None, self.number + 1


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "2024-01-01T00:00:00Z", least: int = LEAST, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES, level: int = 6) -> DataFrame:
    """Writes the archives and the manifest to path (a URI) and returns the manifest."""
    spark = pages.sparkSession
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    u = F.xxhash64("url")
    keys = rows.select("page_id", F.sha1("payload").alias("digest"), F.octet_length("payload").cast("long").alias("n"), u.alias("u"))
    kept = keys.groupBy("page_id", "digest", "u").agg(F.count("*").alias("copies"), F.first("n").alias("n"))
    kept = kept.select((F.col("page_id").isNull()).alias("last"), "page_id", "digest", "u", "copies", "n", (F.col("n") + RECORD).alias("each"))
    order = ["last", "page_id", "digest", "u"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(kept.repartitionByRange(parts, *order).withColumn("range", F.spark_partition_id()))
    before, sums = 0, []
    for r in ranged.groupBy("range").agg(F.sum(F.col("copies") * F.col("each")).alias("n")).orderBy("range").collect():  # a row a range
        sums.append((r["range"], before))
        before += r["n"]
    size = max(shard_bytes, -(-before // MOST_SHARDS))
    held = F.sum(F.col("copies") * F.col("each")).over(W.partitionBy("range").orderBy(*order)) - F.col("copies") * F.col("each")
    sums = F.broadcast(local_table(spark, sums or [(0, 0)], "range int, before long"))
    placed = ranged.join(sums, "range").withColumn("start", F.col("before") + held).withColumn("shard", F.floor(F.col("start") / F.lit(size)).cast("int"))
    final = F.floor((F.col("start") + (F.col("copies") - 1) * F.col("each")) / F.lit(size)).cast("int")
    placed = written(placed.withColumn("final", final).drop("range", "before"))
    forget(ranged)
    # a cut a shard and a row a group of equal rows that lies in several: MOST_SHARDS of each at most
    cuts = [(r["k"]["last"], r["k"]["page_id"] or 0, r["k"]["digest"], r["k"]["u"], r["shard"]) for r in placed.groupBy("shard").agg(F.min(F.struct(*order)).alias("k")).collect()]
    wide = [r for r in placed.where("final > shard").collect()]
    known = spark.sparkContext.broadcast((sorted(cuts), {(r["page_id"], r["digest"], r["u"]) for r in wide}))
    shards = before // size + 1

    @F.pandas_udf("int")
    def shard_of(page_id: pd.Series, digest: pd.Series, u: pd.Series) -> pd.Series:
        """The shard of a row; -1 for rows of a group that lies in several."""
        from bisect import bisect_right

        cuts, wide = known.value
        out = []
        for i, d, h in zip(page_id.astype(object), digest, u):
            i = None if pd.isna(i) else int(i)
            out.append(-1 if (i, d, h) in wide else cuts[bisect_right(cuts, (i is None, i or 0, d, h, MOST_SHARDS + 1)) - 1][4])
        return pd.Series(out, dtype="int32")

    large = placed.where(F.col("n") >= least)
    best = large.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.sum("copies").alias("rows")).where("rows > 1 and refers_to is not null").drop("rows")
    again = large.join(best, "digest").where("page_id is null or page_id < refers_to")
    again = again.select("page_id", "digest", "u", "refers_to", F.explode(F.sequence("shard", "final")).alias("shard"), F.lit(0).alias("kind"))
    named = rows.withColumn("digest", F.sha1("payload")).withColumn("u", u).withColumn("kind", F.lit(1)).withColumn("times", F.lit(1).cast("long"))
    # ids beyond 2 ** 53 would lose digits as the floats that nullable integers become in pandas
    named = named.withColumn("shard", shard_of(F.col("page_id").cast("string"), "digest", "u"))
    dealt = named.where("shard >= 0")
    if wide:
        spans = []
        for r in wide:
            ends = [min(r["copies"], -(-((s + 1) * size - r["start"]) // r["each"])) for s in range(r["shard"], r["final"] + 1)]
            spans += [(r["page_id"], r["digest"], r["u"], s, n - m) for s, n, m in zip(range(r["shard"], r["final"] + 1), ends, [0] + ends)]
        spans = F.broadcast(local_table(spark, [s for s in spans if s[4]], "w_id long, w_digest string, w_u long, w_shard int, w_times long"))
        one = named.where("shard < 0").groupBy("page_id", "digest", "u").agg(F.first("url").alias("url"), F.first("payload").alias("payload"), F.first("kind").alias("kind"))
        one = one.join(spans, F.col("page_id").eqNullSafe(F.col("w_id")) & (F.col("digest") == F.col("w_digest")) & (F.col("u") == F.col("w_u")))
        dealt = dealt.unionByName(one.withColumnsRenamed({"w_shard": "shard", "w_times": "times"}).select(*dealt.columns))
    dealt = dealt.unionByName(again, allowMissingColumns=True).repartitionById(int(shards), "shard")
    dealt = dealt.sortWithinPartitions("shard", F.col("page_id").asc_nulls_last(), "digest", "u", "kind", "url")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow.fs import FileSystem

        fs, root = FileSystem.from_uri(path)
        temp = f"{root}/_temporary/{uuid.uuid4().hex}"
        fs.create_dir(temp, recursive=True)
        out, ref, done = None, None, []
        for b in batches:
            for page_id, digest, refers, kind, url, payload, at, times in zip(b["page_id"].astype(object), b["digest"], b["refers_to"], b["kind"], b["url"], b["payload"], b["shard"], b["times"]):
                page_id = None if pd.isna(page_id) else int(page_id)
                if not kind:
                    ref = (page_id, digest, int(refers))
                    continue
                if out is None or out.shard != at:
                    if out is not None:
                        out.close()
                        done += out.done
                    out = _Roller(fs, root, temp, int(at), roll_bytes)
                to = ref[2] if ref is not None and ref[:2] == (page_id, digest) else None
                member = _member(record(page_id, url, bytes(payload), digest, to, date), level)
                for _ in range(int(times)):
                    out.add(member)
        if out is not None:
            out.close()
            done += out.done
        fs.delete_dir(temp)
        yield pd.DataFrame(done, columns=["shard", "file", "records", "bytes", "sha1"])

    dealt = dealt.select(F.col("page_id").cast("string"), "digest", F.col("refers_to").cast("string"), "kind", "url", "payload", "shard", "times")
    dealt.mapInPandas(run, _MANIFEST).write.mode("overwrite").parquet(f"{path}/manifest")
    forget(placed)
    return spark.read.schema(_MANIFEST).parquet(f"{path}/manifest")


def members(read, size: int = 1 << 18) -> Iterator[bytes]:
    """The gzip members of a stream; read(n) gives its next n bytes at most."""
    data = read(size)
    while data:
        z, out = zlib.decompressobj(31), []
        while True:
            out.append(z.decompress(data))
            if z.eof:
                break
            data = read(size)
            if not data:
                raise ValueError("the archive ends inside a record")
        data = z.unused_data or read(size)
        yield b"".join(out)


def parse(data: bytes) -> dict:
    """Fields and payload of one record; block and payload digests are checked."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n" or fields["WARC-Block-Digest"] != f"sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}":
        raise ValueError(f"a damaged record: {fields['WARC-Record-ID']}")
    digest = base64.b32decode(fields["WARC-Payload-Digest"][5:]).hex()
    payload = block.partition(b"\r\n\r\n")[2] if fields["WARC-Type"] == "response" else None
    if payload is not None and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"a payload differs from its digest: {fields['WARC-Record-ID']}")
    number = lambda k: int(fields[k]) if k in fields else None
    return {"page_id": number("X-Page-ID"), "url": fields.get("WARC-Target-URI"), "payload_bytes": int(fields["X-Payload-Length"]), "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": number("X-Refers-To-Page"), "payload": payload}


def read(manifest: DataFrame, path: str, payloads: bool = True) -> DataFrame:
    """A row per record of the listed archives; the payload of a revisit is null."""
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * payloads

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow.fs import FileSystem

        fs, root = FileSystem.from_uri(path)
        for b in batches:
            for name, records in zip(b["file"], b["records"]):
                with fs.open_input_stream(f"{root}/{name}", compression=None) as f:
                    rows, n, held = [], 0, 0
                    for m in members(f.read):
                        rows.append(parse(m))
                        n, held = n + 1, held + len(m)
                        if held > 1 << 24:
                            yield _frame(rows, names)
                            rows, held = [], 0
                    if n != records:
                        raise ValueError(f"{name} has {n} records, the manifest {records}")
                    yield _frame(rows, names)

    kinds = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads
    # a stated number, or the small manifest would be read by one task; about a file a task, several beyond READERS files
    return manifest.repartition(min(max(manifest.count(), 1), READERS), "file").mapInPandas(run, kinds)


def _frame(rows: list[dict], names: list[str]) -> pd.DataFrame:
    # nulls would make floats of ids, which lose digits beyond 2 ** 53
    return pd.DataFrame({k: pd.array([r[k] for r in rows], dtype="Int64") if k in ("page_id", "refers_to") else [r[k] for r in rows] for k in names})


def op7_warc(spark, sf_dir: str) -> DataFrame:
    path = shared_dir(spark)
    path = path if "://" in path or path.startswith("file:") else f"file://{path}"
    path = path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path
    manifest = write(table(spark, sf_dir, "pages"), path)
    return read(manifest, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP7_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id < last THEN last END AS refers_to FROM m
"""
