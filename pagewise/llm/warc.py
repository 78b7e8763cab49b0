"""Web archives: a deterministic, sharded WARC writer and its reader.

Pages are range-sorted: a shard holds ``SPAN`` consecutive page ids, so what a shard holds depends on the ids alone, not on
the cluster. A task writes its shards in page order, each record as its own gzip member with headers and digests made
afresh, and starts another file when one has reached the compressed size. Files are written under names only that attempt
has. Attempts that succeed report their files; the report is stored, and a second job gives the reported files their final
names and lists them in a manifest. Lost or repeated attempts leave files that no manifest names.

Of equal payloads that of the largest page id is the response; the others revisit it. Which page holds a payload is found
on digests alone and reaches a task as small rows, sorted in front of the pages they speak of, so html is shuffled once.

Defined cases: a null html is an empty payload. A null url gives a record without target. Rows with a null page id are
written last, spread by payload, with an empty id. Rows that repeat a page id and payload are records of their own and of
the same type. Other columns are not used, whatever their names. An empty table gives an empty manifest and no records.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewise.llm.common import shipped, small_batches, stored
from pagewise.session import shared_folder

shipped(__name__)

SPAN = 512
ROLL_BYTES = 64 << 20
WRITTEN = "1970-01-01T00:00:00Z"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
CHUNK = 1 << 16

REPORT = "shard long, number int, attempt_name string, name string, records long, bytes long, sha1 string"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, name string"


def filesystem(uri: str):
    """File system and path of a folder every executor can reach."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _number(value) -> str:
    return "" if value is None or pd.isna(value) else str(int(value))


def record(page_id, url: str | None, html: str | None, holder) -> bytes:
    """One WARC record; ``holder`` is the page id of the response of this payload."""
    payload = (html or "").encode()
    digest, own, other = base32_sha1(payload), _number(page_id), _number(holder)
    revisit = own != other
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{own}/{digest}')}>"),
        ("WARC-Date", WRITTEN),
        ("WARC-Target-URI", quote(url, safe="%/:=&?~#+!$,;'@()*[]") if url else ""),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"),
        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if revisit else ""),
        ("WARC-Refers-To", f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{other}/{digest}')}>" if revisit else ""),
        ("X-Page-ID", own),
        ("X-Refers-To-Page-ID", other if revisit else ""),
        ("X-Payload-Length", str(len(payload))),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    head = "WARC/1.1\r\n" + "".join(f"{name}: {value}\r\n" for name, value in fields if value) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class _Files:
    """The files of one task: one at a time, under names of this attempt."""

    def __init__(self, folder: str, roll: int):
        self.system, self.folder = filesystem(folder)
        self.roll, self.attempt, self.out, self.report = roll, uuid.uuid4().hex, None, []

    def open(self, shard: int, number: int) -> None:
        self.shard, self.number = shard, number
        name = f"shard-{shard:012d}-{number:05d}.warc.gz" if shard >= 0 else f"unnumbered-{-shard:05d}-{number:05d}.warc.gz"
        self.names = (f"_attempts/{self.attempt}-{name}", name)
        self.out, self.sum, self.size, self.records = self.system.open_output_stream(f"{self.folder}/{self.names[0]}", compression=None), hashlib.sha1(), 0, 0

    def add(self, shard: int, data: bytes) -> None:
        if self.out is None:
            self.open(shard, 0)
        elif shard != self.shard:
            self.close()
            self.open(shard, 0)
        elif self.size >= self.roll:
            number = self.number + 1
            self.close()
            self.open(shard, number)
        self.out.write(data)
        self.sum.update(data)
        self.size, self.records = self.size + len(data), self.records + 1

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.report.append((self.shard, self.number, *self.names, self.records, self.size, self.sum.hexdigest()))
            self.out = None


def _writer(folder: str, roll: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, holder = _Files(folder, roll), None
        for frame in frames:
            for shard, page_id, verdict, url, html, told in frame[["shard", "page_id", "verdict", "url", "html", "holder"]].itertuples(index=False, name=None):
                if verdict:
                    holder = told
                else:
                    files.add(shard, member(record(page_id, url, html, holder)))
        files.close()
        yield pd.DataFrame(files.report, columns=["shard", "number", "attempt_name", "name", "records", "bytes", "sha1"])

    return run


def _commit(folder: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system, path = filesystem(folder)
        for frame in frames:
            for before, after in zip(frame["attempt_name"], frame["name"], strict=True):
                # A commit that is run again finds the file under its final name.
                if system.get_file_info(f"{path}/{before}").type != fs.FileType.NotFound:
                    system.move(f"{path}/{before}", f"{path}/{after}")
            yield frame.drop(columns="attempt_name")

    return run


def _dealt(files: DataFrame) -> DataFrame:
    """Few small rows that each stand for a file, dealt over all cores by name."""
    return files.repartition(4 * files.sparkSession.sparkContext.defaultParallelism, "name")


def write_archives(pages: DataFrame, folder: str, span: int = SPAN, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write all ``pages`` (page_id, url, html) under ``folder``; returns the manifest, also kept in ``folder``/manifest."""
    spark = pages.sparkSession
    small_batches(spark)
    system, path = filesystem(folder)
    system.create_dir(f"{path}/_attempts", recursive=True)
    own = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")
    )
    shard = F.coalesce(F.floor(F.col("page_id") / F.lit(span)), -1 - F.pmod(F.xxhash64("mark", "size"), F.lit(1024))).cast("long").alias("shard")
    marked = own.select("*", F.sha1(F.col("html").cast("binary")).alias("mark"), F.octet_length("html").alias("size"))
    places = stored(marked.select(shard, "page_id", "mark", "size").distinct())
    holders = places.groupBy("mark", "size").agg(F.max("page_id").alias("holder"))
    verdicts = places.join(holders, ["mark", "size"]).select(
        "shard", "page_id", "mark", "size", F.lit(True).alias("verdict"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "holder"
    )
    records = marked.select(shard, "page_id", "mark", "size", F.lit(False).alias("verdict"), "url", "html", F.lit(None).cast("long").alias("holder"))
    ordered = records.union(verdicts).repartition("shard").sortWithinPartitions("shard", "page_id", "mark", "size", F.desc("verdict"), "url")
    report = stored(ordered.mapInPandas(_writer(folder, roll_bytes), REPORT))
    final = "shard long, number int, name string, records long, bytes long, sha1 string"
    _dealt(report).mapInPandas(_commit(folder), final).write.json(f"{folder}/manifest")
    return spark.read.schema(final).json(f"{folder}/manifest")


def members(stream) -> Iterator[bytes]:
    """Unpacked gzip members of a stream, one at a time."""
    held = b""
    while True:
        held = held or stream.read(CHUNK)
        if not held:
            return
        packer, out = zlib.decompressobj(31), io.BytesIO()
        while True:
            out.write(packer.decompress(held))
            if packer.eof:
                held = packer.unused_data
                break
            held = stream.read(CHUNK)
            if not held:
                raise EOFError("archive ends inside a record")
        yield out.getvalue()


def parsed(data: bytes) -> tuple:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload; digests of responses are checked."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if base32_sha1(block) != fields["WARC-Block-Digest"].removeprefix("sha1:"):
        raise ValueError("block digest differs")
    digest, kind, payload = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"], None
    if kind == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        if base32_sha1(payload) != digest or len(payload) != int(fields["X-Payload-Length"]):
            raise ValueError("payload differs")
    number = {name: int(fields[name]) if name in fields else None for name in ("X-Page-ID", "X-Refers-To-Page-ID")}
    return number["X-Page-ID"], fields.get("WARC-Target-URI"), int(fields["X-Payload-Length"]), digest, kind, number["X-Refers-To-Page-ID"], payload


def _reader(folder: str, with_payload: bool):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, path = filesystem(folder)
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload", "name"]
        for frame in frames:
            for name in frame["name"]:
                rows = []
                with system.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    for data in members(stream):
                        row = parsed(data)
                        rows.append((*(row if with_payload else row[:-1] + (None,)), name))
                        if len(rows) == 256:
                            yield pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})
                            rows = []
                yield pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})

    return run


def read_archives(manifest: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """Every record of the archives the manifest lists."""
    return _dealt(manifest.select("name")).mapInPandas(_reader(folder, with_payload), RECORD)


def archive_digest(pages: DataFrame) -> DataFrame:
    """Write, read back, and return page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark: SparkSession = pages.sparkSession
    folder = f"{shared_folder(spark)}/archives-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(folder)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    records = read_archives(write_archives(pages, folder), folder, with_payload=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
