"""WARC archives: a deterministic sharded writer, and a reader.

Writing. Of payloads of at least LEAST_REVISIT bytes that occur more than once, the record of the largest
key is the response; the others are revisits that refer to it. Records are cut into shards by key ranges
of about ``shard_bytes`` of payload, from exact running totals, so the cuts depend on the records alone and
not on how they were partitioned. Payloads are shuffled once: by shard, sorted by key; revisit marks come
as small rows just before their records. A task streams its shards into gzip members and starts a new file
when the compressed size passes ``roll_bytes``. Headers (WARC and HTTP), record ids and digests are made
anew from the record, so the same records always give the same bytes.

Commit. Files are written under temporary names, one for each task attempt; Spark's own commit of the
manifest table decides which attempts count; the listed files are then renamed, and writing the final
manifest is the commit. A reader opens the files of the final manifest only, so lost executors, repeated
tasks and dead jobs leave nothing that is read.

Defined cases: a null payload is empty; a null key sorts first, has no Page-ID and never is referred to; a
null url gives no target; rows that share key and payload are all responses if the key is the largest; an
empty table gives an empty manifest. Only the three named columns are read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as filesystems
from pyspark.sql import DataFrame, SparkSession, functions as F

from mailsift.llm.common import range_of, small_batches, written
from mailsift.operators.ranking import running_totals
from mailsift.operators.skew import hot_keys, join_facts

LEAST_REVISIT = 1000
SHARD_BYTES, ROLL_BYTES = 16 << 20, 8 << 20
#: Shards at most: a larger archive has larger shards, still rolled into files of ROLL_BYTES. Compressed bytes of a reading task.
MOST_SHARDS, READ_BYTES = 16_384, 16 << 20
#: The date of every record, unless the caller names another: a fixed one keeps files reproducible.
DATE = "2000-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "shard bigint, seq int, name string, temporary string, records bigint, bytes bigint, sha256 string"
RECORDS = ("page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, "
           "payload_digest string, payload binary")


def _store(path: str) -> tuple[filesystems.FileSystem, str]:
    """The file system of a path that driver and executors share: local or network mounts, HDFS, object stores."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[len("file:"):]
    return filesystems.FileSystem.from_uri(path)


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(key: int | None, content: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{key}:{content}')}>"


def _member(headers: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in headers if v is not None)
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n") + packer.flush()


def record(key: int | None, url: str | None, payload: bytes, content: str, refers_to: int | None, date: str) -> bytes:
    """One record as a gzip member."""
    target = None if url is None else " ".join(url.split())
    http = ("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode()
    block = http + payload if refers_to is None else http
    headers = [
        ("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(key, content)),
        ("WARC-Date", date), ("WARC-Target-URI", target), ("Page-ID", key),
        ("WARC-Payload-Digest", _sha1(payload)), ("WARC-Block-Digest", _sha1(block)),
    ]
    if refers_to is not None:
        headers += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(refers_to, content)),
                    ("Refers-To-Page-ID", refers_to)]
    return _member(headers + [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))], block)


def _file_info(name: str, date: str) -> bytes:
    block = b"format: WARC File Format 1.1\r\n"
    return _member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(None, name)), ("WARC-Date", date),
                    ("WARC-Filename", name), ("Content-Type", "application/warc-fields"),
                    ("Content-Length", len(block))], block)


class _Roll:
    """The open file of a shard."""

    def __init__(self, folder: str, shard: int, seq: int, date: str):
        self.shard, self.seq, self.name = shard, seq, f"shard-{shard:08d}-{seq:05d}.warc.gz"
        self.temporary = f"_temporary/{self.name}.{uuid.uuid4().hex}"
        store, at = _store(folder)
        store.create_dir(f"{at}/_temporary", recursive=True)
        self.out = store.open_output_stream(f"{at}/{self.temporary}", compression=None)
        self.records = self.bytes = 0
        self.digest = hashlib.sha256()
        self._put(_file_info(self.name, date))

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.digest.update(data)
        self.bytes += len(data)

    def add(self, data: bytes) -> None:
        self._put(data)
        self.records += 1

    def close(self) -> dict:
        self.out.close()
        return {"shard": self.shard, "seq": self.seq, "name": self.name, "temporary": self.temporary,
                "records": self.records, "bytes": self.bytes, "sha256": self.digest.hexdigest()}


def _writer(folder: str, roll_bytes: int, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("shard", pa.int64()), ("seq", pa.int32()), ("name", pa.string()), ("temporary", pa.string()),
                            ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())])
        roll, mark, refers_to = None, None, None
        for batch in batches:
            done = []
            for shard, key, content, kind, url, payload, refers in zip(*(c.to_pylist() for c in batch.columns)):
                if kind == 0:
                    mark, refers_to = (key, content), refers
                    continue
                if roll and (roll.shard != shard or roll.bytes >= roll_bytes):
                    seq = roll.seq + 1 if roll.shard == shard else 0
                    done.append(roll.close())
                    roll = _Roll(folder, shard, seq, date)
                roll = roll or _Roll(folder, shard, 0, date)
                roll.add(record(key, url, payload or b"", content, refers_to if mark == (key, content) else None, date))
            if done:
                yield pa.RecordBatch.from_pylist(done, schema)
        if roll:
            yield pa.RecordBatch.from_pylist([roll.close()], schema)

    return run


def _shard_starts(rows: DataFrame, shard_bytes: int, most: int = MOST_SHARDS) -> list[int]:
    """First keys of the second and later shards; of at least ``shard_bytes``, and so large that ``most`` suffice."""
    sizes = rows.where("key IS NOT NULL").groupBy("key").agg(F.sum("size").alias("size"))
    shard_bytes = max(shard_bytes, -(-(rows.agg(F.sum("size")).head()[0] or 0) // most))
    before = running_totals(sizes, "key", ["size"]).select(
        "key", F.floor((F.col("cum_size") - F.col("size")) / shard_bytes).alias("shard"))
    starts = before.groupBy("shard").agg(F.min("key").alias("start"))
    return sorted(r.start for r in starts.collect() if r.shard > 0)


def write(df: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html",
          shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES, date: str = DATE) -> DataFrame:
    """Write the archive to ``folder``, which must be new and shared; the final manifest is returned."""
    spark = df.sparkSession
    small_batches(spark)
    source = df.select(F.col(f"`{key}`").cast("bigint").alias("key"), F.col(f"`{url}`").alias("url"),
                       F.coalesce(F.col(f"`{payload}`").cast("binary"), F.lit(b"")).alias("payload"))
    source = source.withColumn("content", F.sha2("payload", 256))
    narrow = written(source.select("key", "content", F.octet_length("payload").alias("size")), "payloads")
    groups = narrow.where(F.col("size") >= LEAST_REVISIT).groupBy("content").agg(
        F.max("key").alias("refers_to"), F.count(F.lit(1)).alias("n"))
    repeated = join_facts(narrow.select("key", "content"), groups.where("n > 1").select("content", "refers_to"),
                          "content", hot_keys(groups, "content"))
    marks = repeated.where("refers_to IS NOT NULL AND NOT key <=> refers_to").select(
        "key", "content", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"),
        F.lit(None).cast("binary").alias("payload"), "refers_to").distinct()
    records = source.select("key", "content", F.lit(1).alias("kind"), "url", "payload",
                            F.lit(None).cast("bigint").alias("refers_to"))
    starts = _shard_starts(narrow, shard_bytes)
    rows = marks.unionByName(records).select(
        F.coalesce(range_of(F.col("key"), starts), F.lit(0)).alias("shard"), "key", "content", "kind", "url", "payload", "refers_to")
    files = rows.repartition(len(starts) + 1, "shard").sortWithinPartitions("shard", "key", "content", "kind", "url").mapInArrow(
        _writer(folder, roll_bytes, date), MANIFEST)
    files.write.parquet(f"{folder}/_written")
    spark.read.schema(MANIFEST).parquet(f"{folder}/_written").mapInArrow(_renamer(folder), MANIFEST).write.parquet(
        f"{folder}/manifest")
    store, at = _store(folder)
    if starts or store.get_file_info(f"{at}/_temporary").type != filesystems.FileType.NotFound:
        store.delete_dir_contents(f"{at}/_temporary", missing_dir_ok=True)
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def _renamer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = _store(folder)
        for batch in batches:
            for row in batch.to_pylist():
                target = f"{at}/{row['name']}"
                if store.get_file_info(f"{at}/{row['temporary']}").type == filesystems.FileType.File:
                    store.move(f"{at}/{row['temporary']}", target)
                if store.get_file_info(target).size != row["bytes"]:
                    raise OSError(f"{target} is not as the manifest has it")
            yield batch

    return run


def _members(stream) -> Iterator[bytes]:
    """The unpacked gzip members of a stream, one at a time."""
    unpacker, out = zlib.decompressobj(31), []
    while data := stream.read(1 << 20):
        while data:
            out.append(unpacker.decompress(data))
            data = unpacker.unused_data
            if unpacker.eof:
                yield b"".join(out)
                unpacker, out = zlib.decompressobj(31), []
    if out:
        raise ValueError("the file ends within a record")


def parse(member: bytes) -> dict | None:
    """A record as a row; digests are checked; None for records that hold no page."""
    head, _, rest = member.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    kind = fields["WARC-Type"]
    if kind not in ("response", "revisit"):
        return None
    block = rest[:int(fields["Content-Length"])]
    if _sha1(block) != fields["WARC-Block-Digest"] or rest[len(block):] != b"\r\n\r\n":
        raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
    http, _, payload = block.partition(b"\r\n\r\n")
    if kind == "response" and _sha1(payload) != fields["WARC-Payload-Digest"]:
        raise ValueError(f"payload of {fields['WARC-Record-ID']} is damaged")
    number = lambda name: int(fields[name]) if name in fields else None
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length:"))
    return {"page_id": number("Page-ID"), "url": fields.get("WARC-Target-URI"), "record_type": kind,
            "refers_to": number("Refers-To-Page-ID"), "payload_bytes": size,
            "payload_digest": base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex(),
            "payload": payload if kind == "response" else None}


def read(spark: SparkSession, folder: str, payloads: bool = True, task_bytes: int = READ_BYTES) -> DataFrame:
    """The records of all files of the manifest; the payload of a revisit is null, its size and digest are full.

    Files are dealt to as many tasks as the archive holds ``task_bytes``, whatever the number of shuffle partitions.
    """
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
                        ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = _store(folder)
        for name in (n for batch in batches for n in batch.column(0).to_pylist()):
            rows, held = [], 0
            with store.open_input_stream(f"{at}/{name}", compression=None) as stream:
                for row in filter(None, map(parse, _members(stream))):
                    row["payload"] = row["payload"] if payloads else None
                    rows.append(row)
                    held += 200 + len(row["payload"] or b"")
                    if held > 2_000_000:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
            yield pa.RecordBatch.from_pylist(rows, schema)

    files = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").select("name", "shard", "seq", "bytes")
    tasks = -(-(files.agg(F.sum("bytes")).head()[0] or 1) // task_bytes)
    return files.repartitionByRange(tasks, "shard", "seq").select("name").mapInArrow(run, RECORDS)
