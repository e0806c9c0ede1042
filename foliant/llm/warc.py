"""WARC archives with a two-level capture index.

Each task writes its rows as one archive: a gzip member for each record, so a record can be read alone. The payload of a capture whose payload another
capture has is written once, with the largest id; the others are revisit records that refer to it.

The index: captures sorted by reversed-host URL key are packed into compressed blocks of BLOCK lines, one index file for each key range (first level:
the files and their first keys; second level: a sparse directory with the first key, offset and length of each block). A lookup finds the file,
binary-searches its directory, reads one block range, binary-searches the block, and only then reads the record's range from the archive.

Tasks write under names of their own and only files named in committed tables are ever read, so a task that is run again leaves nothing wrong.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import new_path, ship, table

BLOCK = 1_000
_KINDS = ("response", "revisit")


def digest(payload: Column) -> Column:
    """SHA-1 as bare upper-case base32: 160 bits in 32 digits of 5."""
    bits = F.sha1(payload)
    digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    out = []
    for i in range(4):  # 10 hex digits are 40 bits, 8 digits of base32
        part = F.conv(F.substring(bits, 1 + 10 * i, 10), 16, 32)
        out.append(F.lpad(part, 8, "0"))
    return F.translate(F.concat(*out), "0123456789ABCDEFGHIJKLMNOPQRSTUV", digits)


def url_key(url: Column) -> Column:
    """Reversed host, then port, path and query in lower case: org,example,www)/path?query. Null or odd URLs sort under what they are."""
    u = F.lower(F.trim(F.coalesce(url, F.lit(""))))
    parts = F.regexp_extract(u, r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)(.*)$", 1)
    rest = F.regexp_replace(F.regexp_extract(u, r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)(.*)$", 2), "#.*$", "")
    host = F.regexp_replace(parts, r"^www\d*\.", "")
    return F.when(parts == "", u).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest))


def deduplicated(pages: DataFrame, smallest: int = 0) -> DataFrame:
    """page_id, url, html with key, payload_bytes, payload_digest, record_type and refers_to.

    One row a digest that occurs twice or more is joined back; a digest that a third of all rows have is summed on the map side, and its join is split
    by adaptive execution (the digests' side is unique).
    """
    body = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "utf-8")
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
        digest(body).alias("payload_digest"), F.octet_length(body).cast("long").alias("payload_bytes"), url_key(F.col("url").cast("string")).alias("key"))
    same = rows.where(F.col("payload_bytes") >= smallest).groupBy("payload_digest").agg(F.max("page_id").alias("first_id"),
        F.count("*").alias("n")).where("n > 1").drop("n")
    both = rows.join(same, "payload_digest", "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return both.withColumn("record_type", F.when(revisit, "revisit").otherwise("response")).withColumn("refers_to",
        F.when(revisit, F.col("first_id"))).drop("first_id")


def _record(page_id, url: str, html: bytes, sha: str, kind: str, refers_to) -> bytes:
    payload = html if kind == "response" else b""
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Target-URI: {url}", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{sha}", f"X-Payload-Bytes: {len(html)}", "Content-Type: text/html; charset=utf-8",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head.append(f"Content-Length: {len(payload)}")
    return "\r\n".join([*head, "", ""]).encode() + payload + b"\r\n\r\n"


def _gzip(data: bytes) -> bytes:
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _gunzip(data: bytes) -> bytes:
    return zlib.decompress(data, 31)


def _opened(path: str):
    return fs.FileSystem.from_uri(path)


def _one_line(url: str) -> str:
    return url.replace("\r", "%0D").replace("\n", "%0A")


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """Writes each task's rows of deduplicated() as an archive. Returns the captures: key, page_id, file, offset, length."""
    ship(rows.sparkSession)
    source = rows.select(F.col("page_id").cast("string").alias("id"), F.coalesce("url", F.lit("")).alias("url"), "html", "key", "payload_digest",
        "record_type", F.col("refers_to").cast("string").alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, at, name = None, 0, f"{folder}/{uuid.uuid4().hex}.warc.gz"
        try:
            for batch in batches:
                found = []
                for r in batch.to_pylist():
                    if out is None:
                        store, path = _opened(name)
                        store.create_dir(path.rsplit("/", 1)[0], recursive=True)
                        out = store.open_output_stream(path, compression=None)
                    data = _gzip(_record("" if r["id"] is None else r["id"], _one_line(r["url"]), r["html"].encode(), r["payload_digest"],
                        r["record_type"], r["refers_to"]))
                    out.write(data)
                    found.append((r["key"], r["id"], name, at, len(data)))
                    at += len(data)
                yield _batch(found, ("key", "id", "file", "offset", "length"), (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()))
        finally:
            if out is not None:
                out.close()

    return source.mapInArrow(run, "key string, id string, file string, offset long, length long")


def _batch(rows: list[tuple], names: tuple, kinds: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=list(names))


def write_index(captures: DataFrame, folder: str, block: int = BLOCK) -> DataFrame:
    """Sorts captures by key over the cluster and writes an index file for each range. Returns the first level: file, first_key, directory offset and length, n."""
    ordered = captures.repartitionByRange("key", "id").sortWithinPartitions("key", "id", "file", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name, directory, lines, at, n = None, f"{folder}/{uuid.uuid4().hex}.idx", [], [], 0, 0

        def flush():
            nonlocal at, lines
            data = zlib.compress("\n".join(json.dumps(x) for x in lines).encode())
            out.write(data)
            directory.append((lines[0][0], at, len(data)))
            at, lines = at + len(data), []

        for batch in batches:
            for r in batch.to_pylist():
                if out is None:
                    store, path = _opened(name)
                    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
                    out = store.open_output_stream(path, compression=None)
                lines.append([r["key"], r["id"], r["file"], r["offset"], r["length"]])
                n += 1
                if len(lines) >= block:
                    flush()
        if out is None:
            return
        if lines:
            flush()
        data = zlib.compress(json.dumps(directory).encode())
        out.write(data)
        out.close()
        yield _batch([(name, directory[0][0], at, len(data), n)], ("file", "first_key", "offset", "length", "n"), (pa.string(), pa.string(),
            pa.int64(), pa.int64(), pa.int64()))

    return ordered.mapInArrow(run, "file string, first_key string, offset long, length long, n long")


class IndexFile:
    """One file of the index; blocks are read by range when a key needs them, and the last one is kept."""

    def __init__(self, name: str, offset: int, length: int):
        store, path = _opened(name)
        self.file = store.open_input_file(path)
        self.directory = json.loads(zlib.decompress(self.file.read_at(length, offset)))
        self.first = [d[0] for d in self.directory]
        self.kept: tuple[int, list, list] = (-1, [], [])

    def block(self, i: int) -> tuple[list, list]:
        if self.kept[0] != i:
            _, offset, length = self.directory[i]
            lines = [json.loads(x) for x in zlib.decompress(self.file.read_at(length, offset)).decode().split("\n")]
            self.kept = (i, lines, [x[0] for x in lines])
        return self.kept[1:]

    def find(self, key: str) -> Iterator[list]:
        """Captures of a key: they may begin in the block before the first one that starts with it."""
        i = max(0, bisect.bisect_left(self.first, key) - 1)
        while i < len(self.first) and self.first[i] <= key:
            lines, keys = self.block(i)
            yield from lines[bisect.bisect_left(keys, key) : bisect.bisect_right(keys, key)]
            i += 1


def lookup(spark: SparkSession, keys: DataFrame, index: DataFrame) -> DataFrame:
    """Captures of each distinct key: key, id, file, offset, length.

    The first level has a row for each index file, so its size follows the number of tasks; tasks read it from the shared folder as a broadcast of
    at most that many rows. A first search over it names the files that may hold a key. A key that many pages share (that of pages without a URL, say) is
    split over files by the index's ranges, and each of its files is looked up by itself, in the task that has the file's other keys.
    """
    ship(spark)
    files = sorted((r["first_key"], r["file"], r["offset"], r["length"]) for r in index.collect())
    shared = spark.sparkContext.broadcast(files)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = [x[0] for x in shared.value]
        for batch in batches:
            keys = batch.column(0).to_pylist()
            spans = [range(max(0, bisect.bisect_left(first, k) - 1), bisect.bisect_right(first, k)) for k in keys]
            yield _batch([(i, k) for k, span in zip(keys, spans, strict=True) for i in span], ("part", "key"), (pa.int32(), pa.string()))

    placed = keys.select("key").distinct().mapInArrow(places, "part int, key string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, opened = -1, None
        names, kinds = ("key", "id", "file", "offset", "length"), (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
        found: list[list] = []
        for batch in batches:
            for part, key in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != at:
                    at, opened = part, IndexFile(*shared.value[part][1:])
                for line in opened.find(key):
                    found.append(line)
                    if len(found) == 10_000:
                        yield _batch(found, names, kinds)
                        found = []
        yield _batch(found, names, kinds)

    return placed.repartitionByRange("part", "key").sortWithinPartitions("part", "key").mapInArrow(run, "key string, id string, file string, offset "
        "long, length long")


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:] if ": " in x)
    return fields, rest[: int(fields["Content-Length"])]


def read_records(found: DataFrame, payload: bool = False) -> DataFrame:
    """Range-reads captures: id, payload_bytes, payload_digest, record_type, refers_to, ok (a response's digest agrees with its payload), and the payload if wanted.

    Captures are put together by file and read in order of offset, many tasks to a file.
    """
    ordered = found.repartition("file", F.floor(F.col("offset") / (8 << 20))).sortWithinPartitions("file", "offset")
    schema = "id string, payload_bytes long, payload_digest string, record_type string, refers_to string, ok boolean" + ", payload binary" * payload
    names = tuple(x.split()[0] for x in schema.split(", "))
    kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.binary())[: len(names)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, file = None, None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["file"] != name:
                    name = r["file"]
                    store, path = _opened(name)
                    file = store.open_input_file(path)
                head, body = parse(_gunzip(file.read_at(r["length"], r["offset"])))
                sha = head["WARC-Payload-Digest"].removeprefix("sha1:")
                kind = head["WARC-Type"]
                real = base64.b32encode(hashlib.sha1(body).digest()).decode() if kind == "response" else sha
                refers = head.get("WARC-Refers-To", "<urn:page:>")[10:-1] if kind == "revisit" else None
                size = len(body) if kind == "response" else int(head["X-Payload-Bytes"])
                out.append((r["id"], size, real, kind, refers, real == sha, body)[: len(names)])
            yield _batch(out, names, kinds)

    return ordered.mapInArrow(run, schema)


def archive(pages: DataFrame, smallest: int = 0) -> tuple[DataFrame, DataFrame]:
    """Writes pages as archives with their index into the shared folder. Returns the captures and the index's first level, both as tables.

    A null html is an empty payload; a null url has the key "" and is written as an empty URI; rows with the same id and payload are each a record, of
    the same type; a null id counts as smaller than any other. An empty table writes nothing. Other columns aren't read.
    """
    folder = new_path(pages.sparkSession, "warc")
    captures = table(write_archives(deduplicated(pages, smallest), f"{folder}/records"), "warc-captures")
    return captures, table(write_index(captures, f"{folder}/index"), "warc-index")


def read_back(pages: DataFrame, index: DataFrame) -> DataFrame:
    """The records of all captures of the pages' URLs, found by way of the index."""
    return read_records(lookup(pages.sparkSession, pages.select(url_key(F.col("url").cast("string")).alias("key")), index))
