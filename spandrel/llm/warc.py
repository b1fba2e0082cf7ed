"""WARC archives: a deterministic sharded writer and its reader.

Records are range-sorted by key into shards. Where shards end is found from exact histograms of bytes by key, refined
where a range is heavy, and not from a sample, so archives hang on the rows alone; one key with more than a shard's
bytes (a null key, say) is cut further by digest. Each shard's records, one gzip member each, go to files that roll
when their compressed size reaches a limit; a file is written under a name of its attempt and renamed when whole, so a
repeated task replaces equal bytes. Readers follow the manifest, which is written last, when what failed attempts have
left is deleted. Headers and digests come from the payload alone, with a fixed date.

Of records with equal payloads of at least `least_bytes`, the one with the largest key is a response and the others
revisit it, with HTTP headers but no payload. Which ones these are is found from digests, without payloads; those rows
meet their records in the same range sort, ahead of them, so payloads are shuffled once.

Defined results: a null payload is empty; rows with equal key and payload are written each, all as responses if the
key is the largest of theirs; a null key sorts first and is an empty header; a payload of any length is one record; an
empty table makes a manifest without files; further columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spandrel.llm.common import staged, stages_of

#: Fixed value: the date of every record, so that equal input gives equal archives.
DATE = "2024-01-01T00:00:00Z"
LEAST_BYTES = 1000
#: Compressed bytes at which a file ends, the usual size of such archives.
ROLL_BYTES = 1 << 30
#: Payload bytes that one task writes: least and most; between them the data are cut in PARTS.
LEAST_PART, MOST_PART, PARTS = 32 << 20, 1 << 30, 256
#: Bytes of a record that are not payload, about.
HEADERS = 500
#: Ranges of the first histogram, and of each heavy range in the next ones.
BINS, FINER = 4096, 16
MANIFEST = "file string, records long, bytes long, sha1 string"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def record_id(key: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{key}/{digest}')}>"


def record(key: int | None, url: str, payload: bytes, refers_to: int | None) -> bytes:
    """One record; with refers_to a revisit of that key's equal payload."""
    digest = hashlib.sha1(payload).hexdigest()
    labelled = "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(key, digest)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {' '.join(url.split())}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: {labelled}",
        f"X-Page-Id: {'' if key is None else key}",
    ]
    if refers_to is None:
        block += payload
    else:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {record_id(refers_to, digest)}",
            f"X-Refers-To-Page-Id: {refers_to}",
        ]
    head += [f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """One gzip member, without a time stamp."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def revisits(digests: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """(key, digest, refers_to) of the records that revisit another one, from `digests` (key, digest, n)."""
    digests = digests.filter(F.col("n") >= least_bytes).select("key", "digest")
    heads = digests.groupBy("digest").agg(F.max("key").alias("refers_to"), F.min("key").alias("low")).filter("low < refers_to").drop("low")
    return digests.distinct().join(heads, "digest").filter("key < refers_to").select("key", "digest", "refers_to")


def part_bytes(size: int) -> int:
    """Bytes of a part: by the data alone, so that archives do not depend on the cluster; 100 TB make some 100,000 files."""
    return min(MOST_PART, max(LEAST_PART, size // PARTS))


@dataclass(frozen=True)
class Shards:
    """Where shards begin: keys from starts[i] on have splits[i] shards from first[i] on, told apart by digest; null keys
    have the first null_shards."""

    starts: np.ndarray
    first: np.ndarray
    splits: np.ndarray
    null_shards: int

    @property
    def number(self) -> int:
        return max(1, self.null_shards + int(self.splits.sum()))


def histogram(sizes: DataFrame, edges: list[int]) -> np.ndarray:
    """Bytes of `sizes` (key, bytes) by range [edges[i], edges[i + 1]); keys elsewhere are not counted."""
    shared = sizes.sparkSession.sparkContext.broadcast(np.array(edges[:-1], np.int64))
    last = edges[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = shared.value
        held = np.zeros(len(starts), np.int64)
        for batch in batches:
            keys, n = (batch.column(i).to_numpy() for i in (0, 1))
            at = np.searchsorted(starts, keys, "right") - 1
            known = (at >= 0) & (keys < last if last < 1 << 63 else True)
            np.add.at(held, at[known], n[known])
        used = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(held[used])], ["at", "n"])

    out = np.zeros(len(edges) - 1, np.int64)
    for r in sizes.mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[r["at"]] = r["n"]
    shared.destroy()
    return out


def shards(digests: DataFrame, target: int) -> Shards:
    """Shards of about `target` bytes of `digests` (key, digest, n). The driver holds a few ranges for each shard."""
    sizes = digests.select("key", (F.col("n") + HEADERS).alias("bytes"))
    ends = sizes.agg(F.min("key").alias("low"), F.max("key").alias("high"), F.sum(F.when(F.col("key").isNull(), F.col("bytes"))).alias("none")).first()
    none = -(-(ends["none"] or 0) // target)
    if ends["low"] is None:
        return Shards(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), none)
    sizes = sizes.filter("key IS NOT NULL")
    cut = lambda low, high, n: [low + (high - low) * i // min(n, high - low) for i in range(min(n, high - low))]
    # each round looks at the heavy ranges of the one before
    asked = [(x, y) for x, y in itertools.pairwise([*cut(ends["low"], ends["high"] + 1, BINS), ends["high"] + 1]) if x < y]
    known: dict[int, int] = {}
    while asked:
        edges = sorted({e for pair in asked for e in pair})
        bytes_ = dict(zip(edges[:-1], histogram(sizes, edges).tolist(), strict=True))
        again = []
        for low, high in asked:
            if 2 * bytes_[low] > target and high - low > 1:
                again += itertools.pairwise([*cut(low, high, FINER), high])
            else:
                known[low] = bytes_[low]
        asked = again
    starts, splits, held = [], [], target
    for low in sorted(known):
        n = -(-known[low] // target)
        if n > 1 or held + known[low] > target:
            starts.append(low)
            splits.append(max(1, n))
            held = 0
        held = target if n > 1 else held + known[low]
    splits = np.array(splits, np.int64)
    return Shards(np.array(starts, np.int64), none + np.cumsum(splits) - splits, splits, none)


def shard_of(key: Column, digest: Column, dealt: Shards) -> Column:
    """The shard of a record, by key and the leading 32 bits of its payload's digest."""

    @F.pandas_udf("int")
    def number(keys: pd.Series, ties: pd.Series) -> pd.Series:
        at = np.maximum(np.searchsorted(dealt.starts, keys.to_numpy(), "right") - 1, 0)
        return pd.Series(dealt.first[at] + (ties.to_numpy() * dealt.splits[at] >> 32))

    tie = F.conv(F.left(digest, F.lit(8)), 16, 10).cast("long")
    none = F.shiftright(tie * dealt.null_shards, 32).cast("int")
    return F.when(key.isNull(), none).otherwise(number(F.coalesce(key, F.lit(0).cast("long")), tie)) if len(dealt.starts) else none


class Roller:
    """Writes members to files below `root` that end when they reach `limit` bytes."""

    def __init__(self, root: str, shard: int, attempt: str, limit: int):
        self.store, self.path = fs.FileSystem.from_uri(root)
        self.shard, self.attempt, self.limit, self.seq, self.out = shard, attempt, limit, 0, None
        self.done: list[tuple[str, int, int, str]] = []

    def add(self, data: bytes) -> None:
        if self.out is None:
            self.name = f"part-{self.shard:05d}-{self.seq:05d}.warc.gz"
            self.out = self.store.open_output_stream(f"{self.path}/.{self.name}.{self.attempt}", compression=None)
            self.records, self.bytes, self.sha = 0, 0, hashlib.sha1()
        self.out.write(data)
        self.records, self.bytes = self.records + 1, self.bytes + len(data)
        self.sha.update(data)
        if self.bytes >= self.limit:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.store.move(f"{self.path}/.{self.name}.{self.attempt}", f"{self.path}/{self.name}")
            self.done.append((self.name, self.records, self.bytes, self.sha.hexdigest()))
            self.out, self.seq = None, self.seq + 1

    def finish(self) -> list[tuple[str, int, int, str]]:
        self.close()
        return self.done


def write(pages: DataFrame, root: str, key: str = "page_id", url: str = "url", payload: str = "html", roll_bytes: int = ROLL_BYTES, least_bytes: int = LEAST_BYTES, partitions: int | None = None) -> DataFrame:
    """Writes the archives and then the manifest below `root` (a URI that all machines share); returns the manifest."""
    spark = pages.sparkSession
    rows = pages.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(url), F.lit("")).alias("url"), F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8").alias("payload"))
    digests = staged(rows.select("key", F.sha1("payload").alias("digest"), F.length("payload").alias("n")), "payload-digests")
    seen = revisits(digests, least_bytes)
    size = digests.select(F.sum(F.col("n") + HEADERS).alias("n")).first()["n"] or 0
    dealt = shards(digests, max(1, -(-size // partitions)) if partitions else part_bytes(size))
    marks = seen.select("key", F.lit(0).alias("kind"), "digest", "refers_to", F.lit("").alias("url"), F.lit(b"").alias("payload"))
    records = rows.select("key", F.lit(1).alias("kind"), F.sha1("payload").alias("digest"), F.lit(None).cast("long").alias("refers_to"), "url", "payload")
    placed = records.unionByName(marks).withColumn("shard", shard_of(F.col("key"), F.col("digest"), dealt))
    placed = placed.repartitionById(dealt.number, F.col("shard")).sortWithinPartitions("shard", "key", "digest", "kind", "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        roller, done, marked = None, [], (None, None, None)  # (key, digest, refers_to) of the revisits being read
        for batch in batches:
            columns = [batch.column(i) for i in range(7)]
            for i in range(batch.num_rows):
                k, kind, digest, refers_to, link, data, shard = (c[i].as_py() for c in columns)
                if kind == 0:
                    marked = k, digest, refers_to
                    continue
                if roller is None or roller.shard != shard:
                    done += roller.finish() if roller else []
                    roller = Roller(root, shard, f"{task.stageId()}-{task.taskAttemptId()}", roll_bytes)
                roller.add(member(record(k, link, data, marked[2] if marked[:2] == (k, digest) else None)))
        if roller:
            done += roller.finish()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], ["file", "records", "bytes", "sha1"])

    store, path = fs.FileSystem.from_uri(root)
    store.create_dir(path, recursive=True)
    placed.mapInArrow(run, MANIFEST).write.parquet(f"{root}/_manifest")
    for file in store.get_file_info(fs.FileSelector(path)):
        if file.base_name.startswith(".part-"):  # of an attempt that failed
            store.delete_file(file.path)
    return manifest(spark, root)


def manifest(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{root}/_manifest")


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC headers, HTTP headers, body) of one record; checks lengths and the block's digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    named = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
    block = rest[: int(named["Content-Length"])]
    if not first.startswith("WARC/") or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("not a whole WARC record")
    if named["WARC-Block-Digest"] != "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode():
        raise ValueError(f"digest of {named['WARC-Record-ID']}")
    http, _, body = block.partition(b"\r\n\r\n")
    return named, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), body


def members(store: fs.FileSystem, path: str, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a file, one after another."""
    with store.open_input_stream(path, compression=None) as f:
        z, out, data = zlib.decompressobj(31), [], b""
        while data := data or f.read(chunk):
            out.append(z.decompress(data))
            data = b""
            if z.eof:
                yield b"".join(out)
                z, out, data = zlib.decompressobj(31), [], z.unused_data
        if any(out):
            raise ValueError(f"{path} ends within a record")


def read(spark: SparkSession, root: str, with_payload: bool = False) -> DataFrame:
    """The records of the files that the manifest lists, with checked digests; payloads only if asked for (null for
    revisits)."""
    files = manifest(spark, root).select("file")
    schema = T._parse_datatype_string(RECORD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(root)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows = []
                for data in members(store, f"{path}/{name}"):
                    named, http, body = parse(data)
                    digest = base64.b32decode(named["WARC-Payload-Digest"][5:]).hex()
                    back, kind = named.get("X-Refers-To-Page-Id"), named["WARC-Type"]
                    if kind == "response" and (hashlib.sha1(body).hexdigest() != digest or len(body) != int(http["Content-Length"])):
                        raise ValueError(f"payload of {named['WARC-Record-ID']}")
                    number = lambda x: int(x) if x else None
                    rows.append((number(named["X-Page-Id"]), int(http["Content-Length"]), digest, kind, number(back), named["WARC-Target-URI"], body if with_payload and kind == "response" else None))
                    if len(rows) == 1000:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)

    n = max(1, files.count())
    return files.repartition(n).mapInArrow(run, schema)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Writes `pages` below the shared folder, reads the archives back: (page_id, payload_bytes, payload_digest,
    record_type, refers_to)."""
    spark = pages.sparkSession
    root = f"{stages_of(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, root)
    return read(spark, root).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, octet_length(encode(body))::BIGINT AS payload_bytes, sha1(body) AS payload_digest FROM p),
h AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS head FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < head THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < head THEN head END AS refers_to FROM h
"""
