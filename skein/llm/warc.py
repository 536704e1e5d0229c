"""WARC archives with a two-level capture index.

Archives are ``.warc.gz`` files of one gzip member a record. The index is a sorted list of captures (reversed-host key,
page_id) cut into shards by key range; a shard is a file of compressed blocks of lines and a sparse directory with the first
capture of each block. A look-up binary-searches shards, then the directory, reads one block's bytes, and then one record's.
Many look-ups at once, as in reading all back, are dealt to the shards in key order, and the captures they find to their
archives, each of which is opened once. Only files named in the manifests count, so files of lost or repeated task attempts do
no harm.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Payloads of fewer bytes are never revisits.
LEAST_REVISIT = 1000
#: Date of all records; the pages carry none.
DATE = "1970-01-01T00:00:00Z"
LEVEL = 1
#: Bytes of one archive, about; captures of one index block; captures of one index shard, about, and of one where there are
#: fewer shards than cores otherwise.
ARCHIVE_BYTES = 256 << 20
BLOCK_LINES = 1000
SHARD_LINES = 100_000
LEAST_SHARD_LINES = 5000
PAGE_URN = "urn:x-page:"
#: Tasks that read archives back, at most; each has some archives whole.
MOST_TASKS = 20_000

URL = re.compile(r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?//(?:[^/?#@]*@)?([^/?#:]*)(?::(\d+))?([^#]*)")
PORTS = {"http": "80", "https": "443"}
CAPTURES = "key string, page_id long, url string, file string, offset long, length long"


def sort_key(url: str | None) -> str:
    """Host reversed by label, then port unless usual, path and query: ``com,example,www)/a?b``. No host: the url itself; null: empty."""
    m = URL.match(url or "")
    if not m or not m[2]:
        return url or ""
    port = f":{m[3]}" if m[3] and m[3] != PORTS.get((m[1] or "").lower()) else ""
    return ",".join(reversed(m[2].lower().rstrip(".").split("."))) + port + ")" + (m[4] or "/")


def kinds(pages: DataFrame, spark: SparkSession) -> DataFrame:
    """page_id, url, payload, digest (hex SHA-1) and refers_to (page_id of the response, null for a response itself).

    Counts are summed before the shuffle; only digests of more than one row take part in the join.
    """
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    large = rows.where(F.octet_length("payload") >= LEAST_REVISIT).groupBy("digest").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null")
    first = common.cut(spark, large.select(F.col("digest").alias("of"), "first"), "copies")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return rows.join(first, F.col("digest") == F.col("of"), "left").select("page_id", "url", "payload", "digest", refers.alias("refers_to"))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response record, or a revisit with the payload's length and digest but not the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    target = re.sub(r"[\r\n]", " ", url or "")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{PAGE_URN}{page_id}>",
        f"WARC-Target-URI: {target}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{PAGE_URN}{refers_to}>"]
    return "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def compress(raw: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def decompress(raw: bytes) -> bytes:
    return zlib.decompress(raw, 31)


def parse_record(raw: bytes) -> dict:
    """page_id, type, digest, refers_to, payload_bytes and payload (None for a revisit) of an uncompressed record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode("utf-8", "replace").split("\r\n")[1:] if ": " in x)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    page = lambda v: None if v in (None, f"<{PAGE_URN}None>") else int(v[len(PAGE_URN) + 1 : -1])
    revisit = fields["WARC-Type"] == "revisit"
    return {"page_id": page(fields["WARC-Record-ID"]), "type": fields["WARC-Type"], "digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"), "refers_to": page(fields.get("WARC-Refers-To")), "payload_bytes": size, "payload": None if revisit else payload}


def write_archives(spark: SparkSession, pages: DataFrame, folder: str) -> DataFrame:
    """Writes the archives; the captures (see CAPTURES), as a table written out."""

    def put(batches):
        import pyarrow as pa

        fs, top = common.file_system(folder)
        out, name, at = None, "", 0
        for b in batches:
            rows = []
            for page_id, url, payload, digest, refers_to in zip(*(c.to_pylist() for c in b.columns)):
                if out is None or at >= ARCHIVE_BYTES:
                    if out:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{top}/{name}", compression=None)
                raw = compress(record(page_id, url, payload, digest, refers_to))
                out.write(raw)
                rows.append((sort_key(url), page_id, url, name, at, len(raw)))
                at += len(raw)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()))], ["key", "page_id", "url", "file", "offset", "length"])
        if out:
            out.close()

    return common.cut(spark, kinds(pages, spark).mapInArrow(put, CAPTURES), "captures")


def write_index(captures: DataFrame, folder: str, shard_lines: int = SHARD_LINES, block_lines: int = BLOCK_LINES) -> list[dict]:
    """Sorts captures into shards of compressed blocks; the manifest, in key order: a row for each shard."""
    total = captures.count()
    cores = captures.sparkSession.sparkContext.defaultParallelism
    n = max(1, -(-total // shard_lines), min(cores, total // min(shard_lines, LEAST_SHARD_LINES)))

    def put(batches):
        import pyarrow as pa

        fs, top = common.file_system(folder)
        out, directory, at, lines = None, [], 0, []
        name = uuid.uuid4().hex

        def block():
            nonlocal at, lines
            raw = compress("\n".join(json.dumps(x, ensure_ascii=False) for x in lines).encode("utf-8", "replace"))
            out.write(raw)
            directory.append([lines[0][0], lines[0][1], at, len(raw)])
            at, lines = at + len(raw), []

        count = 0
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                out = out or fs.open_output_stream(f"{top}/{name}.cdx", compression=None)
                lines.append(row)
                count += 1
                if len(lines) >= block_lines:
                    block()
        if out:
            if lines:
                block()
            out.close()
            with fs.open_output_stream(f"{top}/{name}.dir", compression=None) as f:
                f.write(json.dumps(directory, ensure_ascii=False).encode("utf-8", "replace"))
            yield pa.RecordBatch.from_pylist([{"first": directory[0][0], "page_id": directory[0][1], "name": name, "n": count}], schema=pa.schema([("first", pa.string()), ("page_id", pa.int64()), ("name", pa.string()), ("n", pa.int64())]))

    sorted_ = captures.repartitionByRange(n, "key", "page_id").sortWithinPartitions("key", "page_id").mapInArrow(put, "first string, page_id long, name string, n long")
    return sorted((r.asDict() for r in sorted_.collect()), key=lambda r: (r["first"], _low(r["page_id"])))


def _low(page_id: int | None) -> tuple[bool, int]:
    return (page_id is not None, page_id or 0)


class Index:
    """One shard: the directory is held, blocks are read as byte ranges; the last block read is kept."""

    def __init__(self, folder: str, name: str):
        self.fs, top = common.file_system(folder)
        self.path = f"{top}/{name}.cdx"
        with self.fs.open_input_stream(f"{top}/{name}.dir", compression=None) as f:
            self.directory = json.loads(f.read().decode("utf-8"))
        self.firsts = [x[0] for x in self.directory]
        self.held: tuple[int, list, list] = (-1, [], [])

    def block(self, k: int) -> tuple[list[list], list[str]]:
        """The captures of a block, and their keys."""
        if self.held[0] != k:
            _, _, at, size = self.directory[k]
            with self.fs.open_input_file(self.path) as f:
                f.seek(at)
                lines = [json.loads(x) for x in decompress(f.read(size)).decode("utf-8").split("\n")]
            self.held = (k, lines, [x[0] for x in lines])
        return self.held[1:]

    def find(self, key: str):
        """The captures of a key, a block's at a time: binary search in the directory, then in each block that may hold it."""
        for k in range(max(0, bisect_left(self.firsts, key) - 1), bisect_right(self.firsts, key)):
            lines, keys = self.block(k)
            if found := lines[bisect_left(keys, key) : bisect_right(keys, key)]:
                yield found


def shards_of(firsts: list[str], key: str) -> range:
    """The shards that may hold a key, by the first key of each."""
    return range(max(0, bisect_left(firsts, key) - 1), bisect_right(firsts, key))


def look_up(folder: str, manifest: list[dict], url: str) -> list[dict]:
    """The records of a url's captures, by page_id."""
    key, firsts = sort_key(url), [m["first"] for m in manifest]
    fs, top = common.file_system(folder)
    out = []
    for k in shards_of(firsts, key):
        for lines in Index(folder, manifest[k]["name"]).find(key):
            for _, _, _, file, at, size in lines:
                with fs.open_input_file(f"{top}/{file}") as f:
                    f.seek(at)
                    out.append(parse_record(decompress(f.read(size))))
    return out


def find_captures(spark: SparkSession, folder: str, manifest: list[dict], urls: DataFrame) -> DataFrame:
    """page_id, url, file, offset and length of all captures of the urls (one column), each url's once, by binary search.

    A url's key goes to the shards that may hold it; there a task looks its keys up in order, so a block is read once.
    """
    firsts, names = [m["first"] for m in manifest], [m["name"] for m in manifest]

    def ask(batches):
        import pyarrow as pa

        for b in batches:
            got = [(k, key) for key in sorted({sort_key(u) for u in b.column(0).to_pylist()}) for k in shards_of(firsts, key)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in got], pa.int32()), pa.array([x[1] for x in got], pa.string())], ["shard", "key"])

    def find(batches):
        import pyarrow as pa

        index, open_ = None, -1
        for b in batches:
            for shard, key in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if shard != open_:
                    index, open_ = Index(folder, names[shard]), shard
                for lines in index.find(key):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*lines))[1:], (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()))], ["page_id", "url", "file", "offset", "length"])

    asked = urls.mapInArrow(ask, "shard int, key string").distinct()
    asked = asked.repartitionById(max(1, len(manifest)), F.col("shard")).sortWithinPartitions("shard", "key")
    return asked.mapInArrow(find, "page_id long, url string, file string, offset long, length long")


def read_records(folder: str, captures: DataFrame, tasks: int = MOST_TASKS) -> DataFrame:
    """The records of captures: page_id, url, payload_bytes, payload_digest, record_type, refers_to; archives are read in order.

    A response's bytes and digest are taken from its payload as read; a revisit carries those of the payload it refers to.
    """

    def get(batches):
        import pyarrow as pa

        fs, top = common.file_system(folder)
        name, f = None, None
        for b in batches:
            rows = []
            for page_id, url, file, at, size in zip(*(c.to_pylist() for c in b.columns)):
                if file != name:
                    if f:
                        f.close()
                    name, f = file, fs.open_input_file(f"{top}/{file}")
                f.seek(at)
                r = parse_record(decompress(f.read(size)))
                payload = r["payload"]
                if r["page_id"] != page_id or payload is not None and len(payload) != r["payload_bytes"]:
                    raise ValueError(f"{file} at {at} is not the record of the index")
                digest = r["digest"] if payload is None else hashlib.sha1(payload).hexdigest()
                rows.append((page_id, url, r["payload_bytes"], digest, r["type"], r["refers_to"]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()))], ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])
        if f:
            f.close()

    ordered = captures.repartition(tasks, "file").sortWithinPartitions("file", "offset")
    return ordered.mapInArrow(get, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def read_back(spark: SparkSession, folder: str, manifest: list[dict], urls: DataFrame, archives: int = MOST_TASKS) -> DataFrame:
    """Every record of the urls, looked up in the index and then read from its archive, of which there are so many."""
    return read_records(folder, find_captures(spark, folder, manifest, urls), max(1, min(MOST_TASKS, archives)))


def archive(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Writes archives and index of ``pages`` (page_id, url, html; more columns are not read) and reads all back.

    Null html is an empty payload, null url an empty target. Of equal payloads of at least LEAST_REVISIT bytes the row of the
    largest page_id is the response; rows that share that page_id all are. A null page_id refers to the response like any
    other, or is a response if no copy has a page_id. Rows that repeat a page_id repeat its record id. No rows: no files, no rows.
    """
    common.bounded_batches(spark)
    folder = common.shared_dir(spark, "warc")
    captures = write_archives(spark, pages, folder)
    manifest, archives = write_index(captures, folder), captures.select("file").distinct().count()
    return read_back(spark, folder, manifest, pages.select(F.col("url").cast("string")), archives)


#: DuckDB SQL for the query's digest columns.
ORACLE = f"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS t FROM pages),
d AS (SELECT page_id, url, octet_length(encode(t))::BIGINT AS payload_bytes, sha1(t) AS payload_digest FROM p),
f AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, url, payload_bytes, payload_digest, CASE WHEN payload_bytes >= {LEAST_REVISIT} AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN payload_bytes >= {LEAST_REVISIT} AND page_id <> first THEN first END AS refers_to FROM f
"""
