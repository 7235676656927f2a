"""Deterministic sharded WARC archives: write, commit and read back.

Records are range-sorted by page and cut into shards by counted bytes, so shard borders depend on the rows alone, not on
sampling. A shard's task sorts its rows, regenerates headers and digests, compresses each record as a gzip member of its
own and rolls to a new file once ``roll_bytes`` compressed bytes are written. Files get temporary names; the manifest of the
attempts that Spark accepted decides which of them are renamed, and readers follow the committed manifest only. So lost or
repeated attempts leave no trace in the archive. The folder may be any that pyarrow can write and all executors share.

Of pages with equal payloads of ``least`` bytes or more, that with the largest (identifier, url) is the response and the
others revisit it; of rows equal in all of these the first is the response. Null payloads are empty payloads. Null
identifiers and urls sort first and have no header. Large groups of equal payloads are reduced to their largest row
before they are joined back, and split again by page. An empty table gives an archive without files.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from decimal import Decimal

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blotter.llm.common import quoted

SHARD_BYTES = 256 << 20
ROLL_BYTES = 64 << 20
SLICES = 4096
#: Duplicate groups up to this number are sent to every executor; beyond, they are joined by shuffle.
BROADCAST_GROUPS = 100_000
HEADER_BYTES = 600
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNK_BYTES = 8 << 20
MANIFEST = "name string, staged string, shard int, records long, bytes long, sha256 string"
RECORD = "page_id string, url string, record_type string, refers_to string, payload_bytes long, payload_digest string, payload binary, file string"


def base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def _record_id(page: str | None, url: str | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page}\n{url}\n{digest}')}>"


def record(row: dict, date: str) -> bytes:
    """One record, uncompressed. ``row``: page, url, payload, size, sha, and for revisits keeper and keeper_url."""
    digest = base32(row["sha"])
    again = row["payload"] is None
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['size']}\r\n\r\n".encode()
    block = head if again else head + row["payload"]
    fields = [
        ("WARC-Type", "revisit" if again else "response"),
        ("WARC-Record-ID", _record_id(row["page"], row["url"], digest)),
        ("WARC-Date", date),
        ("WARC-Target-URI", row["url"]),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{base32(hashlib.sha1(block).digest())}"),
        ("X-Page-Id", row["page"]),
        ("X-Payload-Length", str(row["size"])),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if again:
        fields[3:3] = [
            ("WARC-Profile", PROFILE),
            ("WARC-Refers-To", _record_id(row["keeper"], row["keeper_url"], digest)),
            ("WARC-Refers-To-Target-URI", row["keeper_url"]),
            ("X-Refers-To-Page-Id", row["keeper"]),
        ]
    lines = [f"{k}: {v}".replace("\r", " ").replace("\n", " ") for k, v in fields if v is not None]
    return "\r\n".join(["WARC/1.1", *lines]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _roles(pages: DataFrame, payload: str, page_id: str, url: str, least: int) -> DataFrame:
    text = F.coalesce(F.col(quoted(payload)).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(quoted(page_id)).alias("page"), F.col(quoted(url)).cast("string").alias("url"), text.alias("payload"))
    rows = rows.withColumn("size", F.length("payload").cast("long")).withColumn("sha", F.unhex(F.sha1("payload")))
    own = F.struct("page", "url")
    groups = rows.filter(F.col("size") >= least).groupBy("sha").agg(F.max(own).alias("keeper"), F.count("*").alias("n")).filter("n > 1").drop("n")
    few = groups.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    joined = rows.join(F.broadcast(groups) if few else groups, "sha", "left")
    again = F.col("keeper").isNotNull() & ~own.eqNullSafe(F.col("keeper"))
    return joined.withColumn("payload", F.when(~F.coalesce(again, F.lit(False)), F.col("payload")))


def _shards(rows: DataFrame, shard_bytes: int) -> tuple[DataFrame, int]:
    """``rows`` with their ``shard``: page ranges of about ``shard_bytes``.

    Ranges are narrowed by counts: one that is too full is divided between its smallest and largest page, until it is small
    enough or a single page, and only rows of one page are dealt by hash. So shards are in page order whatever the gaps.
    """
    spark = rows.sparkSession
    load = F.sum(F.coalesce(F.length("payload"), F.lit(0)) + HEADER_BYTES)
    rows = rows.withColumn("slice", F.when(F.col("page").isNull(), F.lit(-1)).otherwise(F.lit(0)).cast("long"))
    settled, fresh, divided = [], -1, 1
    while True:
        # At most a few rows per shard come back, and only of the ranges divided last.
        found = rows.filter(F.col("slice") >= fresh).groupBy("slice").agg(load.alias("bytes"), F.min("page"), F.max("page")).collect()
        table, fresh = [], divided
        for s, size, low, high in sorted(found):
            if s >= 0 and low < high and (size > shard_bytes or s == 0):
                parts = max(SLICES if s == 0 else 2, 4 * -(-size // shard_bytes))
                table.append((s, Decimal(low), Decimal(-(-(high - low + 1) // parts)), divided))
                divided += parts
            else:
                settled.append((low if s >= 0 else None, s, size))
        if not table:
            break
        borders = spark.createDataFrame(table, "slice long, low decimal(20,0), width decimal(20,0), first long")
        place = F.expr("first + (cast(page as decimal(20,0)) - low) div width")
        rows = rows.join(F.broadcast(borders), "slice", "left").withColumn("slice", F.coalesce(place, F.col("slice"))).drop("low", "width", "first")
    plan, shard, filled = [], 0, 0
    for _, s, size in sorted(settled, key=lambda x: (x[0] is not None, x[0] or 0)):
        if filled and filled + size > shard_bytes:
            shard, filled = shard + 1, 0
        parts = max(1, round(size / shard_bytes))
        plan.append((s, shard, parts))
        shard, filled = (shard + parts, 0) if parts > 1 else (shard, filled + size)
    table = pa.table({"slice": pa.array([p[0] for p in plan], pa.int64()), "first": pa.array([p[1] for p in plan], pa.int32()), "parts": pa.array([p[2] for p in plan], pa.int32())})
    borders = F.broadcast(spark.createDataFrame(table))  # a few rows per shard, and SLICES
    part = F.pmod(F.xxhash64("page", "url", "sha"), F.col("parts").cast("long"))
    return rows.join(borders, "slice").withColumn("shard", (F.col("first") + part).cast("int")).drop("slice", "first", "parts"), shard + 1


def write(pages: DataFrame, folder: str, payload: str = "html", page_id: str = "page_id", url: str = "url", least: int = 0, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES, date: str = DATE, prefix: str = "pages") -> DataFrame:
    """Write ``pages`` (integer identifiers) below ``folder``, a fresh one, and return the committed manifest."""
    spark = pages.sparkSession
    rows, shards = _shards(_roles(pages, payload, page_id, url, least), shard_bytes)
    own = F.struct("page", "url")
    rows = rows.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "page", "url", "sha")
    text = lambda c: F.col(c).cast("string")
    rows = rows.select("shard", text("page").alias("page"), "url", "payload", "size", "sha", text("keeper.page").alias("keeper"), F.col("keeper.url").alias("keeper_url"), own.eqNullSafe(F.col("keeper")).alias("chosen"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = pa.fs.FileSystem.from_uri(folder)
        store.create_dir(f"{top}/_staged", recursive=True)
        done, out, shard, number, last = [], None, None, 0, None

        def close() -> None:
            nonlocal out
            if out:
                out["stream"].close()
                done.append({"name": out["name"], "staged": out["staged"], "shard": shard, "records": out["records"], "bytes": out["bytes"], "sha256": out["sum"].hexdigest()})
                out = None

        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if row["shard"] != shard:
                    close()
                    shard, number = row["shard"], 0
                if out is None:
                    name = f"{prefix}-{shard:06d}-{number:04d}.warc.gz"
                    staged = f"{name}.{uuid.uuid4().hex}"
                    out = {"name": name, "staged": staged, "stream": store.open_output_stream(f"{top}/_staged/{staged}", compression=None), "records": 0, "bytes": 0, "sum": hashlib.sha256()}
                    number += 1
                this = (row["page"], row["url"], row["sha"])
                if row["chosen"] and this == last:  # equal rows: the first is the response
                    row["payload"] = None
                last = this if row["chosen"] else None
                press = zlib.compressobj(6, zlib.DEFLATED, 31)
                data = press.compress(record(row, date)) + press.flush()
                out["stream"].write(data)
                out["sum"].update(data)
                out["records"] += 1
                out["bytes"] += len(data)
                if out["bytes"] >= roll_bytes:
                    close()
        close()
        if done:
            yield pa.RecordBatch.from_pylist(done, _arrow(MANIFEST))

    rows.mapInArrow(run, MANIFEST).write.parquet(f"{folder}/_attempts")

    def commit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rename accepted files; a second attempt finds the work done."""
        store, top = pa.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                staged, final = f"{top}/_staged/{row['staged']}", f"{top}/{row['name']}"
                if store.get_file_info(staged).type != pa.fs.FileType.NotFound:
                    store.move(staged, final)
                if store.get_file_info(final).size != row["bytes"]:
                    raise OSError(f"{final}: not {row['bytes']} bytes")
            yield batch

    accepted = spark.read.schema(MANIFEST).parquet(f"{folder}/_attempts")
    accepted.mapInArrow(commit, MANIFEST).write.parquet(f"{folder}/_manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/_manifest")


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in ddl.split(", "))])


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record of an uncompressed stream, one at a time."""
    while line := stream.readline():
        if line.strip() != b"WARC/1.1":
            raise ValueError(f"not a record: {line[:40]!r}")
        fields = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.decode().partition(": ")
            fields[name] = value
        block = stream.read(int(fields["Content-Length"]))
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record is cut short")
        yield fields, block


def parse(fields: dict[str, str], block: bytes) -> dict:
    """A record as a row; digests are computed anew and must agree."""
    if base32(hashlib.sha1(block).digest()) != fields["WARC-Block-Digest"].removeprefix("sha1:"):
        raise ValueError(f"{fields['WARC-Record-ID']}: block digest differs")
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
    payload = None
    if kind == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        if base32(hashlib.sha1(payload).digest()) != digest:
            raise ValueError(f"{fields['WARC-Record-ID']}: payload digest differs")
    return {
        "page_id": fields.get("X-Page-Id"), "url": fields.get("WARC-Target-URI"), "record_type": kind, "refers_to": fields.get("X-Refers-To-Page-Id"),
        "payload_bytes": len(payload) if payload is not None else int(fields["X-Payload-Length"]), "payload_digest": digest, "payload": payload,
    }


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The records of the committed files, streamed record by record in the tasks that own a file."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/_manifest")
    files = max(1, manifest.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = pa.fs.FileSystem.from_uri(folder)
        rows, held = [], 0
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with store.open_input_stream(f"{top}/{name}", compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:
                    for fields, block in records(stream):
                        rows.append(parse(fields, block) | {"file": name})
                        held += len(block) + HEADER_BYTES
                        if held >= CHUNK_BYTES:
                            yield pa.RecordBatch.from_pylist(rows, _arrow(RECORD))
                            rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _arrow(RECORD))

    return manifest.select("name").repartition(files, "name").mapInArrow(run, RECORD)
