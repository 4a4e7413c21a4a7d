"""WARC archives: a deterministic sharded writer and its reader.

Records are sorted by id in shards that are ranges of ids, cut at quantiles of payload bytes over a sample of ids that
their own hash picks. Each shard is one task, which rolls to a new file once the compressed size passes a limit. A file
is written under a temporary name and then renamed; its name and bytes depend only on the records, so a task that runs
again writes the same file. A manifest, committed by Spark, lists the files that count; each is read back by a task.
"""

from __future__ import annotations

import hashlib
import posixpath
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwork.llm.shared import new_folder, spill

#: Payload bytes a shard aims at, compressed bytes after which a file is closed, ids that are sampled for each shard.
SHARD_BYTES, FILE_BYTES, SAMPLED = 32 << 20, 8 << 20, 256
#: Equal ranges of ids in which the cuts are looked up.
CELLS = 4096
#: Payloads below this size are never revisits.
LEAST_BYTES = 100
#: Stands for a null id in the archive.
NO_ID = -(2**63)
DATE = "2024-01-01T00:00:00Z"
_SCHEMA = "file string, shard long, records long, bytes long"


def _header(pairs: list[tuple[str, str]]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in pairs) + "\r\n").encode()


def record(page_id: int, url: str, payload: bytes, refers_to: int | None) -> bytes:
    """One gzip member: a response with its payload, or a revisit without it; headers and digests are made anew."""
    digest = hashlib.sha256(payload).hexdigest()
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id}/{digest}/{'' if refers_to is None else refers_to}")
    kind = "response" if refers_to is None else "revisit"
    block = payload if refers_to is None else b""
    uri = "".join(c if c.isprintable() else f"%{ord(c):02X}" for c in url) or "urn:none"
    pairs = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{name}>"), ("WARC-Date", DATE), ("WARC-Target-URI", uri)]
    pairs += [("X-Page-ID", str(page_id)), ("X-Payload-Length", str(len(payload))), ("WARC-Payload-Digest", f"sha256:{digest}")]
    pairs += [("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}")]
    if refers_to is not None:
        pairs += [("WARC-Refers-To-Page", str(refers_to)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    pairs += [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(block)))]
    zipped = zlib.compressobj(6, zlib.DEFLATED, 31)
    return zipped.compress(_header(pairs) + block + b"\r\n\r\n") + zipped.flush()


class _Shard:
    """Open files of one shard: gathers records, and closes a file once it is large enough."""

    def __init__(self, folder: str, shard: int) -> None:
        self.fs, root = pafs.FileSystem.from_uri(folder)
        self.root, self.shard, self.number, self.done = root, shard, 0, []
        self.fs.create_dir(root, recursive=True)
        self.out = None

    def add(self, data: bytes) -> None:
        if self.out is None:
            self.temporary = posixpath.join(self.root, f".tmp-{uuid.uuid4().hex}")
            self.out, self.records, self.bytes = self.fs.open_output_stream(self.temporary, compression=None), 0, 0
        self.out.write(data)
        self.records += 1
        self.bytes += len(data)
        if self.bytes >= FILE_BYTES:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            name = posixpath.join(self.root, f"part-{self.shard:08d}-{self.number:05d}.warc.gz")
            self.fs.move(self.temporary, name)
            self.done.append((posixpath.basename(name), self.shard, self.records, self.bytes))
            self.out, self.number = None, self.number + 1


def _cuts(facts: DataFrame, shard_bytes: int) -> list[int]:
    """The first ids of the shards after the first: cumulated payload bytes of sampled ids pass a multiple of `shard_bytes`.

    The ids are sampled by their hash, about SAMPLED for each shard (all of them where there is one), so that the cuts
    depend on the records alone and follow any distribution of ids. One narrow row a shard reaches the driver.
    """
    n, total = facts.agg(F.count(F.lit(1)), F.sum("payload_bytes")).first()
    shards = max(1, (total or 0) // shard_bytes)
    every = max(1, n // (shards * SAMPLED))
    sample = facts.where((F.pmod(F.xxhash64("page_id"), F.lit(every)) == 0) & F.col("page_id").isNotNull())
    sample = sample.groupBy("page_id").agg(F.sum("payload_bytes").alias("b"))
    held = sample.agg(F.sum("b")).first()[0]
    if not held:
        return []
    before = F.sum("b").over(Window.orderBy("page_id").rowsBetween(Window.unboundedPreceding, -1))  # of the sample, about SAMPLED rows a shard
    shard = F.floor(F.coalesce(before, F.lit(0)) * (total / held) / shard_bytes)
    rows = sample.withColumn("shard", shard).groupBy("shard").agg(F.min("page_id").alias("first")).where("shard > 0").orderBy("first").collect()
    return [r["first"] for r in rows]


def _sharded(rows: DataFrame, facts: DataFrame, cuts: list[int]) -> DataFrame:
    """`rows` with their shard: the cuts at or below their id. Null ids are in the first shard."""
    if not cuts:
        return rows.withColumn("shard", F.lit(0).cast("long"))
    low, high = facts.agg(F.min("page_id"), F.max("page_id")).first()
    step = (high - low) // CELLS + 1
    inside: list[list[int]] = [[] for _ in range(CELLS)]
    for cut in cuts:
        inside[(cut - low) // step].append(cut)
    table, before = [], 0
    for cell, own in enumerate(inside):
        table.append((cell, before, own))
        before += len(own)
    cells = F.broadcast(rows.sparkSession.createDataFrame(table, "cell long, before long, cuts array<long>"))  # CELLS rows
    cell = F.coalesce(F.expr(f"(cast(page_id as decimal(20,0)) - {low}BD) div {step}BD"), F.lit(0))
    shard = F.expr("before + size(filter(cuts, c -> c <= coalesce(page_id, -9223372036854775808)))").cast("long")
    return rows.withColumn("cell", cell).join(cells, "cell").withColumn("shard", shard).drop("cell", "before", "cuts")


def write_archive(pages: DataFrame, folder: str, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes pages(page_id, url, html) and returns the committed manifest (file, shard, records, bytes).

    Of records with equal payloads of LEAST_BYTES or more the smallest page_id is a response, the others revisit it;
    of repeated rows with that id, one is the response. Null html is an empty payload, a null url an unnamed target;
    rows with a null page_id are written first in the first shard and are never revisited. page_id is a whole number. An
    empty table gives an empty manifest. The html is shuffled once, to its shard; the decisions travel beside it.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    facts = rows.select("page_id", F.octet_length("html").cast("long").alias("payload_bytes"), F.sha2("html", 256).alias("digest"))
    facts = spill(facts, "warc-facts")
    cuts = _cuts(facts, shard_bytes)
    large = facts.where(F.col("payload_bytes") >= LEAST_BYTES)
    first = large.groupBy("digest").agg(F.min("page_id").alias("keep"), F.count(F.lit(1)).alias("n")).where("n > 1 AND keep IS NOT NULL")
    told = large.join(first, "digest").select("page_id", "digest", "keep").distinct()
    placed = lambda df: _sharded(df, facts, cuts)
    told = placed(told).select("shard", "page_id", F.lit(0).alias("kind"), "digest", "keep", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"))
    sent = placed(rows).select("shard", "page_id", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("digest"), F.lit(None).cast("long").alias("keep"), "url", F.col("html").cast("binary").alias("payload"))
    lined = told.union(sent).repartitionById(len(cuts) + 1, F.col("shard").cast("int")).sortWithinPartitions("shard", "page_id", "kind", "digest", F.sha2("payload", 256), "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_shard, at, keeps, used, done = None, None, {}, set(), []
        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                for r in batch.slice(k, 200).to_pylist():
                    if open_shard is None or r["shard"] != open_shard.shard:
                        if open_shard is not None:
                            open_shard.close()
                            done += open_shard.done
                        open_shard, at = _Shard(folder, r["shard"]), None
                    if r["page_id"] != at:
                        at, keeps, used = r["page_id"], {}, set()
                    if r["kind"] == 0:
                        keeps[r["digest"]] = r["keep"]
                        continue
                    digest = hashlib.sha256(r["payload"]).hexdigest() if keeps else ""
                    keep = keeps.get(digest)
                    response = keep is None or keep == at and digest not in used
                    used.add(digest)
                    open_shard.add(record(NO_ID if at is None else at, r["url"] or "", r["payload"], None if response else keep))
        if open_shard is not None:
            open_shard.close()
            done += open_shard.done
        columns = list(zip(*done, strict=True)) if done else [(), (), (), ()]
        types = (pa.string(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["file", "shard", "records", "bytes"])

    spark = pages.sparkSession
    lined.mapInArrow(run, _SCHEMA).write.mode("overwrite").parquet(f"{folder}/manifest")
    return spark.read.schema(_SCHEMA).parquet(f"{folder}/manifest")


def _members(stream: pa.NativeFile) -> Iterator[bytes]:
    """The gzip members of a file, one after another; the file is read in pieces."""
    unzip, held = zlib.decompressobj(31), []
    data = stream.read(1 << 20)
    while data:
        held.append(unzip.decompress(data))
        if unzip.eof:
            yield b"".join(held)
            data, unzip, held = unzip.unused_data, zlib.decompressobj(31), []
            if data:
                continue
        data = stream.read(1 << 20)


def read_archive(manifest: DataFrame, folder: str) -> DataFrame:
    """One row for each record of the manifest's files: page_id, url, record_type, payload_bytes, payload_digest, refers_to, html.

    html is null for a revisit. The digests of blocks are recomputed; a record that doesn't agree fails the task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows: list[tuple] = []
                with fs.open_input_stream(posixpath.join(root, name), compression=None) as stream:
                    for data in _members(stream):
                        head, _, rest = data.partition(b"\r\n\r\n")
                        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
                        block = rest[: int(fields["Content-Length"])]
                        sha = hashlib.sha256(block).hexdigest()
                        if fields["WARC-Block-Digest"] != f"sha256:{sha}":
                            raise ValueError(f"{name}: record {fields['WARC-Record-ID']} is damaged")
                        revisit = fields["WARC-Type"] == "revisit"
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha256:") if revisit else sha
                        length = int(fields["X-Payload-Length"]) if revisit else len(block)
                        page, url = int(fields["X-Page-ID"]), fields["WARC-Target-URI"]
                        rows.append((None if page == NO_ID else page, url, fields["WARC-Type"], length, digest, int(fields["WARC-Refers-To-Page"]) if revisit else None, None if revisit else block.decode()))
                        if len(rows) == 500:
                            yield _batch(rows)
                            rows = []
                yield _batch(rows)

    schema = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, html string"
    files = manifest.select("file")  # a task for each file, which FILE_BYTES bounds but for its last record
    return files.repartitionByRange(max(1, files.count()), "file").mapInArrow(run, schema)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "html"]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes the pages to a fresh shared folder and reads the archives back."""
    folder = new_folder(pages.sparkSession, "warc")
    return read_archive(write_archive(pages, folder), folder)
