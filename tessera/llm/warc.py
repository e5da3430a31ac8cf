"""A deterministic sharded WARC writer, and a reader.

Records are sorted by (page id, digest) and cut into shards of about equal payload; the cuts come from exact byte counts
over ranges of ids, refined where a range is heavy, so equal input gives equal files however the job is scheduled.
Each shard is written in order, each record a gzip member of its own, rolling to a new file at a compressed size.
Headers, record ids and digests are made anew from the payload. Of records with equal payloads the least page id is the
response; the others are revisits that refer to it and hold the response's HTTP header alone.

A task writes under a temporary name and renames when a file is whole; a repeated task writes the same bytes under the
same name. The manifest, itself renamed into place last, lists the files; readers read what it lists and nothing else.

Defined cases: a null page is an empty payload; a null url is about:blank; a null id sorts first and stays null, and is a
response's id only where it has no other; of rows that repeat the least id of a payload one is the response; an
empty table gives an archive without files; other columns play no part.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import bound_batches, cut, shared_dir, spread_join, table

DATE = "2000-01-01T00:00:00Z"
SOFTWARE = "tessera"
ROLL = 256 << 20
#: Payload bytes of a shard at least; there are no more than SHARDS.
SHARD, SHARDS = 8 << 20, 20_000
LEVEL = 3
_CELLS = 4096
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_MANIFEST = "file string, records long, bytes long, sha1 string, shard int, roll int"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _urn(page: int | None, n: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'page/{page}/{n}')}>"


def _uri(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "about:blank")


def member(head: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member."""
    lines = [("WARC-Date", DATE), *head, ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"), ("Content-Length", str(len(block)))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n"
    return gzip.compress(text.encode() + block + b"\r\n\r\n", LEVEL, mtime=0)


def record(page: int | None, url: str | None, payload: bytes, keeper: int | None, revisit: bool, n: int) -> bytes:
    """A response, or a revisit of the response of page keeper; n numbers rows with the same page id and part."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _urn(page, n)), ("WARC-Target-URI", _uri(url)), ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"), ("Content-Type", "application/http; msgtype=response")]
    if page is not None:
        head.append(("X-Page-Id", str(page)))
    if revisit:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _urn(keeper, 0)), ("WARC-Truncated", "length")]
        if keeper is not None:
            head.append(("X-Refers-To-Page-Id", str(keeper)))
    return member(head, http if revisit else http + payload)


def _range_of(column: str, starts: np.ndarray, ends: np.ndarray) -> Column:
    """The number of the range starts[k]..ends[k] that a value is in, -1 if in none."""

    @F.arrow_udf("int")
    def of(values: pa.Array) -> pa.Array:
        x = values.to_numpy(zero_copy_only=False)
        k = np.searchsorted(starts, x, side="right") - 1
        return pa.array(np.where((k >= 0) & (x <= ends[np.maximum(k, 0)]), k, -1).astype(np.int32))

    return of(column)


def cuts(sizes: DataFrame, shard_bytes: int) -> np.ndarray:
    """First ids of the shards after the first. sizes: id, bytes. Each round counts bytes in _CELLS ranges of ids, or two for each heavy one, and refines the heavy ones."""
    low, high, total = sizes.agg(F.min("id"), F.max("id"), F.sum("bytes")).first()
    if low is None:
        return np.empty(0, np.int64)
    target = max(shard_bytes, -(-total // SHARDS))
    done: list[tuple[int, int]] = []
    heavy = [(low, high + 1)]
    while heavy:
        parts = []
        each = max(2, _CELLS // len(heavy))
        for a, b in heavy:
            width = -(-(b - a) // each)
            parts += [(x, min(x + width, b)) for x in range(a, b, width)]
        starts = np.array([a for a, _ in parts], dtype=np.int64)
        ends = np.array([b - 1 for _, b in parts], dtype=np.int64)
        found = {r["cell"]: r["n"] for r in sizes.where("id is not null").groupBy(_range_of("id", starts, ends).alias("cell")).agg(F.sum("bytes").alias("n")).collect()}
        heavy = []
        for k, (a, b) in enumerate(parts):
            n = found.get(k, 0)
            if n > target and b - a > 1:  # fewer than SHARDS, as each holds more than its share
                heavy.append((a, b))
            elif n:
                done.append((a, n))
    out, held = [], 0
    for a, n in sorted(done):
        if held and held + n > target:
            out.append(a)
            held = 0
        held += n
    return np.array(out, dtype=np.int64)


class _Files:
    """Writes the files of one shard after another under temporary names."""

    def __init__(self, base: str, roll: int) -> None:
        self.fs, self.root = pa.fs.FileSystem.from_uri(base)
        self.limit, self.out, self.done = roll, None, []

    def add(self, shard: int, data: bytes) -> None:
        if self.out is not None and (shard != self.shard or self.size + len(data) > self.limit):
            number = self.number + 1 if shard == self.shard else 0
            self.close()
            self.open(shard, number)
        elif self.out is None:
            self.open(shard, 0)
        self._write(data)
        self.records += 1

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.digest.update(data)
        self.size += len(data)

    def open(self, shard: int, number: int) -> None:
        self.shard, self.number, self.size, self.records, self.digest = shard, number, 0, 0, hashlib.sha1()
        self.name = f"shard-{shard:06d}-{number:04d}.warc.gz"
        self.temporary = f"{self.root}/_temporary/{self.name}.{uuid.uuid4().hex}"
        self.fs.create_dir(f"{self.root}/_temporary", recursive=True)
        self.out = self.fs.open_output_stream(self.temporary, compression=None)
        info = f"software: {SOFTWARE}\r\nformat: WARC File Format 1.1\r\n".encode()
        self._write(member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(_SPACE, self.name)}>"), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], info))

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.fs.move(self.temporary, f"{self.root}/{self.name}")
            self.done.append((self.name, self.records, self.size, self.digest.hexdigest(), self.shard, self.number))
            self.out = None


def _move(spark: SparkSession, source: str, target: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(source).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.rename(path(source), path(target)):
        raise OSError(f"can't rename {source} to {target}")


def remove(spark: SparkSession, base: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def write_warc(pages: DataFrame, base: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", revisit_bytes: int = 0, roll: int = ROLL, shard_bytes: int = SHARD) -> DataFrame:
    """Writes the archive to the folder base, a URI, and returns its manifest. Payloads of fewer than revisit_bytes are never revisited."""
    spark = pages.sparkSession
    bound_batches(spark)
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("payload", 256)))
    narrow = cut(rows.select("id", "digest", F.octet_length("payload").cast("long").alias("bytes")))
    edges = spark.sparkContext.broadcast(cuts(narrow, shard_bytes))

    @F.arrow_udf("int")
    def shard(ids: pa.Array) -> pa.Array:
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        return pa.array(np.where(known, np.searchsorted(edges.value, ids.fill_null(0).to_numpy(zero_copy_only=False), side="right"), 0).astype(np.int32))

    alike = narrow.where(F.col("bytes") >= revisit_bytes).groupBy("digest").agg(F.min("id").alias("keeper"), F.count(F.lit(1)).alias("n")).where("n > 1")
    kept = spread_join(narrow.select("id", "digest"), cut(alike), "digest", "n").select("id", "digest", "keeper").distinct()
    # The decisions travel beside the pages and meet them in the order of each shard, so pages are exchanged once.
    none = F.lit(None)
    both = rows.select("id", "digest", F.lit(1).alias("part"), "url", "payload", none.cast("long").alias("keeper"))
    both = both.unionByName(kept.select("id", "digest", F.lit(0).alias("part"), none.cast("string").alias("url"), none.cast("binary").alias("payload"), "keeper"))
    both = both.withColumn("shard", shard("id"))

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = _Files(base, roll)
        decided, keeper, last, n, response = None, None, None, 0, False
        for batch in batches:
            for page, digest, part, url, payload, by, at in zip(*(batch.column(c) for c in ("id", "digest", "part", "url", "payload", "keeper", "shard")), strict=True):
                page, digest = page.as_py(), digest.as_py()
                if not part.as_py():
                    decided, keeper, response = (page, digest), by.as_py(), False
                    continue
                revisit = decided == (page, digest) and (page != keeper or response)
                if decided == (page, digest) and page == keeper:
                    response = True
                # Number 0 is the row that revisits of its page refer to: one row of a page id is it, or the least digest's.
                n, last = (n + 1 if page == last else 0), page
                number = 0 if decided == (page, digest) and not revisit else n + 1
                files.add(at.as_py(), record(page, url.as_py(), payload.as_py(), keeper if revisit else None, revisit, number))
        files.close()
        if files.done:
            yield pa.record_batch([pa.array(c) for c in zip(*files.done, strict=True)][:4] + [pa.array([x[4] for x in files.done], pa.int32()), pa.array([x[5] for x in files.done], pa.int32())], names=["file", "records", "bytes", "sha1", "shard", "roll"])

    ordered = both.repartitionById(len(edges.value) + 1, F.col("shard")).sortWithinPartitions("shard", "id", "digest", "part", "url")
    manifest = cut(ordered.mapInArrow(written, _MANIFEST))
    manifest.orderBy("file").coalesce(1).write.mode("overwrite").json(f"{base}/_manifest.tmp")
    _move(spark, f"{base}/_manifest.tmp", f"{base}/manifest")
    remove(spark, f"{base}/_temporary")
    return manifest


def members(source, size: int = 1 << 20) -> Iterator[bytes]:  # noqa: ANN001
    """The gzip members of a stream, each decompressed."""
    held, one, out = b"", None, []
    while True:
        if not held:
            held = source.read(size)
            if not held:
                if one is not None:
                    raise EOFError("the last record is not whole")
                return
        one = one or zlib.decompressobj(31)
        out.append(one.decompress(held))
        held = b""
        if one.eof:
            held, one = one.unused_data, None
            yield b"".join(out)
            out = []


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record; the block is checked against its digest."""
    top, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = top.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    head = dict(x.split(": ", 1) for x in lines)
    block = rest[: int(head["Content-Length"])]
    if len(block) != int(head["Content-Length"]) or head.get("WARC-Block-Digest") not in (None, f"sha1:{base32_sha1(block)}"):
        raise ValueError(f"{head.get('WARC-Record-ID')}: the block doesn't match its header")
    return head, block


def read_warc(spark: SparkSession, base: str, with_payload: bool = False) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to (and payload; null for revisits) of the listed files' records."""
    names = spark.read.schema(_MANIFEST).json(f"{base}/manifest")
    files = names.repartition(max(1, min(names.count(), 100_000)), "file").select("file")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pa.fs.FileSystem.from_uri(base)
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()][: 6 + with_payload]
        names_ = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"][: 6 + with_payload]
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows: list[tuple] = []
                waiting = 0
                with fs.open_input_stream(f"{root}/{name}", compression=None) as source:
                    for data in members(source):
                        head, block = parse(data)
                        if head["WARC-Type"] not in ("response", "revisit"):
                            continue
                        http, _, payload = block.partition(b"\r\n\r\n")
                        size = int(re.search(rb"(?im)^Content-Length: *(\d+)", http)[1])
                        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                        whole = head["WARC-Type"] == "response"
                        if whole and (len(payload) != size or base32_sha1(payload) != digest):
                            raise ValueError(f"{name}: {head['WARC-Record-ID']}: the payload doesn't match its digest")
                        number = [int(head[k]) if k in head else None for k in ("X-Page-Id", "X-Refers-To-Page-Id")]
                        rows.append((number[0], head["WARC-Target-URI"], size, digest, head["WARC-Type"], number[1], *([payload if whole else None] * with_payload)))
                        waiting += len(data) if with_payload else 256
                        if waiting > 8 << 20:
                            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names_)
                            rows, waiting = [], 0
                if rows:
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names_)

    return files.mapInArrow(read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(table(spark, sf_dir, "pages"), base)
    out = cut(read_warc(spark, base).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
    remove(spark, base)
    return out


SQL = {
    # Base 32 takes 20 bits, five hexadecimal digits, to four letters.
    "op2_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages),
        h AS (SELECT *, sha1(html) AS hex FROM p)
        SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
               array_to_string(list_transform(range(8), lambda i: array_to_string(list_transform(range(4),
                   lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(hex, i * 5 + 1, 5))::BIGINT >> (15 - 5 * j)) & 31) + 1)::BIGINT, 1)), '')), '') AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first THEN first END AS refers_to
        FROM h
    """,
}
QUERIES = {"op2_warc": op2_warc}
