"""WARC archives: a deterministic sharded writer and a reader.

Records are range-sorted by page and payload digest, and cut into shards by the running sum
of their bytes. So shards depend on the pages only, not on tasks, settings or samples. Each
shard is written into files that roll when
their compressed size passes ``roll_bytes``; every record is a gzip member of its own with
regenerated HTTP and WARC headers and digests. A file is written under a temporary name of
the task attempt and then renamed, so that a repeated attempt replaces the same bytes. Last
a manifest, written by Spark, names the files with their sizes and digests; readers open
only what it names, one task a file.

Marks of revisits travel beside the pages and meet them in the sorted range, so payloads are
shuffled once. Of records with equal payloads of LEAST_SHARED bytes or more the one with the smallest page
is a response and the others are revisits that refer to it. Files go to a file system that
driver and executors share (any that pyarrow opens by URI).
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veldspar.llm.scratch import Scratch

ROLL_BYTES = 64 << 20
#: Bytes of a shard; more where there would be over MOST_SHARDS, whose first keys go to the driver and to the tasks.
SHARD_BYTES = 32 << 20
MOST_SHARDS = 100_000
LEAST_SHARED = 100
SALTS = 64
BATCH_BYTES = 8 << 20
#: Archives of the same pages have the same bytes: the date is a parameter, not the clock.
DATE = "2024-01-01T00:00:00Z"
LEVEL = 6

_MANIFEST = "file string, records bigint, bytes bigint, sha256 string"
_RECORDS = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary"


def _filesystem(uri: str):  # noqa: ANN202
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def keyed(pages: DataFrame) -> DataFrame:
    """Pages with html (null counts as empty), payload_bytes and payload_digest."""
    html = F.coalesce("html", F.lit(""))
    return pages.select("page_id", "url", html.alias("html"), F.octet_length(html).cast("bigint").alias("payload_bytes"), F.sha2(html, 256).alias("payload_digest"))


def revisits(rows: DataFrame) -> DataFrame:
    """page_id, payload_digest and refers_to of the pages whose payload a smaller page has.

    Only keys are shuffled, never payloads. Rows that repeat both the smallest page and its
    payload are all responses. A page without an id is a revisit if an equal payload has one.
    """
    shared = rows.where(F.col("payload_bytes") >= LEAST_SHARED).select("payload_digest", "page_id", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).alias("salt"))
    near = shared.groupBy("payload_digest", "salt").agg(F.min("page_id").alias("least"), F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("payload_digest")
    near = near.select("payload_digest", "salt", F.min("least").over(whole).alias("least"), F.sum("n").over(whole).alias("n")).where("n > 1 and least is not null").drop("n")
    again = shared.join(near, ["payload_digest", "salt"]).where(~F.col("page_id").eqNullSafe(F.col("least")))
    return again.select("page_id", "payload_digest", F.col("least").alias("refers_to")).distinct()


def _name(page: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page}/{digest}')}>"


def _clean(value: str) -> str:
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _raw(value: str) -> str:
    return value.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def record_bytes(page: int | None, url: str | None, html: str | None, size: int, digest: str, refers_to: int | None, date: str = DATE) -> bytes:
    """One record. Line ends and per cent signs of the URL are escaped in its header; extension fields hold page numbers and the full payload's size."""
    payload = (html or "").encode("utf-8")
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + payload
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", _name(page, digest)), ("WARC-Date", date)]
    fields += [("WARC-Target-URI", _clean(url))] if url is not None else []
    fields += [("X-Page", str(page))] if page is not None else []
    if refers_to is not None:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _name(refers_to, digest)), ("X-Refers-To-Page", str(refers_to))]
    fields += [("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("X-Payload-Length", str(size))]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "".join(f"{k}: {v}\r\n" for k, v in fields)
    return f"WARC/1.1\r\n{head}\r\n".encode() + block + b"\r\n\r\n"


def _member(record: bytes) -> bytes:
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


def _place(page: Column, digest: Column) -> Column:
    """A string that sorts as (page, digest) does; pages without an id come first."""
    return F.concat(F.coalesce(F.lpad(F.hex(page.cast("bigint").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"), F.lit("")), F.lit("/"), digest)


def shard_starts(rows: DataFrame, scratch: Scratch, shard_bytes: int) -> np.ndarray:
    """The first place of each shard, in order. A shard ends where the running sum of payload bytes passes a multiple of its size."""
    keys = rows.select("place", (F.col("payload_bytes") + 512).alias("bytes"))  # with the headers
    keys = keys.repartitionByRange("place").sortWithinPartitions("place").withColumn("task", F.spark_partition_id())
    keys = scratch.save(keys, "keys")
    tasks = {r["task"]: r["bytes"] for r in keys.groupBy("task").agg(F.sum("bytes").alias("bytes")).collect()}  # one row a task
    sums = np.concatenate([[0], np.cumsum([tasks[t] for t in sorted(tasks)])]).astype(np.int64)
    if not len(tasks):
        return np.zeros(0, "S81")
    size = max(shard_bytes, -(-int(sums[-1]) // MOST_SHARDS))
    before = rows.sparkSession.createDataFrame([(t, int(b)) for t, b in zip(sorted(tasks), sums, strict=False)], "task int, before long")
    within = F.sum("bytes").over(Window.partitionBy("task").orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    shard = F.floor((F.col("before") + F.coalesce(within, F.lit(0))) / size)
    starts = keys.join(F.broadcast(before), "task").withColumn("shard", shard).groupBy("shard").agg(F.min("place").alias("place")).collect()  # MOST_SHARDS rows at most
    return np.array(sorted(r["place"].encode() for r in starts), "S81")


def write(pages: DataFrame, root: str, roll_bytes: int = ROLL_BYTES, date: str = DATE, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write archives of ``pages`` (page_id, url, html) under ``root`` and return the manifest.

    Null html is an empty payload; a null page or url leaves its header out, and so does
    reading. Repeated rows give repeated records, extra columns are ignored, and an empty
    table gives a manifest without files. Records of one page and payload are in one shard,
    however long the payload. ``pages`` must give the same rows each time (a stored table does).
    """
    spark = pages.sparkSession

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        files, base = _filesystem(root)
        files.create_dir(base, recursive=True)
        rows, state, nth = [], None, 0

        def finish(state: dict) -> None:
            state["out"].close()
            files.move(state["temporary"], f"{base}/{state['file']}")
            rows.append((state["file"], state["records"], state["bytes"], state["sha"].hexdigest()))

        mark, refers_to = None, None
        for batch in batches:
            for r in batch.to_pylist():
                key = r["page_id"], r["payload_digest"]
                if r["refers_to"] is not None:  # a mark, sorted before the pages of its key
                    mark, refers_to = key, r["refers_to"]
                    continue
                again = refers_to if key == mark else None
                packed = _member(record_bytes(r["page_id"], r["url"], r["html"] if again is None else None, r["payload_bytes"], r["payload_digest"], again, date))
                if state and (state["shard"] != r["shard"] or state["bytes"] + len(packed) > roll_bytes):
                    finish(state)
                    nth = nth + 1 if state["shard"] == r["shard"] else 0
                    state = None
                if not state:
                    file = f"part-{r['shard']:06d}-{nth:05d}.warc.gz"
                    temporary = f"{base}/.{file}.{task.taskAttemptId()}"
                    state = {"shard": r["shard"], "file": file, "temporary": temporary, "out": files.open_output_stream(temporary, compression=None), "records": 0, "bytes": 0, "sha": hashlib.sha256()}
                state["out"].write(packed)
                state["sha"].update(packed)
                state["records"] += 1
                state["bytes"] += len(packed)
        if state:
            finish(state)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["file", "records", "bytes", "sha256"])

    rows = keyed(pages).withColumn("place", _place(F.col("page_id"), F.col("payload_digest")))
    starts = spark.sparkContext.broadcast(shard_starts(rows, Scratch(spark, "warc-shards"), shard_bytes))

    @F.pandas_udf("int")
    def shard_of(place: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(starts.value, place.to_numpy().astype("S81"), side="right") - 1, dtype="int32")

    marks = revisits(rows).withColumn("place", _place(F.col("page_id"), F.col("payload_digest")))
    rows = rows.withColumn("refers_to", F.lit(None).cast("bigint")).unionByName(marks, allowMissingColumns=True)
    rows = rows.withColumn("shard", shard_of("place"))
    ranged = rows.repartitionById(max(1, len(starts.value)), "shard").sortWithinPartitions("shard", "place", F.col("refers_to").isNull(), "url").drop("place")
    ranged.mapInArrow(written, _MANIFEST).write.json(f"{root}/manifest")
    return spark.read.schema(_MANIFEST).json(f"{root}/manifest")


class _Verified:
    """A stream that sums up the digest and size of what is read from it."""

    def __init__(self, stream) -> None:  # noqa: ANN001
        self.stream, self.size, self.sha = stream, 0, hashlib.sha256()

    def read(self, n: int) -> bytes:
        data = self.stream.read(n)
        self.size += len(data)
        self.sha.update(data)
        return data


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:  # noqa: ANN001
    """Header fields and block of each record of an open archive file, one gzip member at a time."""
    unpacker, data = zlib.decompressobj(31), b""
    held = bytearray()
    while True:
        if not data:
            data = stream.read(1 << 20)
            if not data:
                if held or not unpacker.eof and unpacker.unconsumed_tail:
                    raise ValueError("the archive ends within a record")
                return
        held += unpacker.decompress(data)
        data = unpacker.unused_data if unpacker.eof else b""
        if unpacker.eof:
            head, _, rest = bytes(held).partition(b"\r\n\r\n")
            fields = dict(line.split(": ", 1) for line in head.decode("utf-8").split("\r\n")[1:])
            yield fields, rest[: int(fields["Content-Length"])]
            held.clear()
            unpacker = zlib.decompressobj(31)


def read(spark: SparkSession, root: str) -> DataFrame:
    """Records of the archives that the manifest of ``root`` names; payload is null for revisits.

    Sizes and digests of files, blocks and payloads are verified; what differs is an error.
    """

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _filesystem(root)
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
        for batch in batches:
            for name, known in zip(batch.column(0).to_pylist(), zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True), strict=True):
                rows, size = [], 0
                with files.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    stream = _Verified(stream)
                    for fields, block in records(stream):
                        if f"sha256:{hashlib.sha256(block).hexdigest()}" != fields["WARC-Block-Digest"]:
                            raise ValueError(f"{name}: the block of {fields['WARC-Record-ID']} does not have its digest")
                        payload = block.partition(b"\r\n\r\n")[2]
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                        again = fields["WARC-Type"] == "revisit"
                        if not again and hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError(f"{name}: the payload of {fields['WARC-Record-ID']} does not have its digest")
                        page, refers = fields.get("X-Page"), fields.get("X-Refers-To-Page")
                        uri = fields.get("WARC-Target-URI")
                        rows.append((page and int(page), _raw(uri) if uri is not None else None, fields["WARC-Type"], refers and int(refers), int(fields["X-Payload-Length"]), digest, None if again else payload))
                        size += len(payload)
                        if size > BATCH_BYTES:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                            rows, size = [], 0
                if (stream.size, stream.sha.hexdigest()) != known:
                    raise ValueError(f"{name} is not the file that the manifest names")
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    manifest = spark.read.schema(_MANIFEST).json(f"{root}/manifest").select("file", "bytes", "sha256")
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return manifest.repartition(width, "file").mapInArrow(opened, _RECORDS)
