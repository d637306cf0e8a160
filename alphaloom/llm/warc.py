"""WARC archives with a two-level capture index.

Archives: one gzip member a record.  Of records with equal payloads the one with the largest page_id is a response, the
others are revisits that refer to it.  Index: captures sorted by reversed-host URL key, cut into compressed blocks of
``BLOCK_LINES`` lines; each index file ends with a sparse directory of its blocks' first keys.  A lookup searches the list
of index files, then a directory, then the lines of a block, each by halving, and reads the record by its byte range.

Files are written by tasks under temporary names and moved into place, so a retried task leaves the same file.  The driver
holds one row for each index file.

Edge cases: a null html is an empty payload; a null url has the key ``-``; a null page_id is never referred to unless all
records of that payload lack one, which are then all responses, as are repeated rows of the largest page_id; records of
less than ``min_bytes`` are all responses; an empty table gives no files and no rows; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import zlib
from bisect import bisect_left, bisect_right
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alphaloom.llm.common import batch, shuffle_partitions, stored
from alphaloom.llm.files import Appender, Ranges
from alphaloom.sources.storage import scratch_path

DATE = "1970-01-01T00:00:00Z"       # pages carry no time of capture
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BLOCK_LINES = 1000
MIN_BYTES = 0
MAGIC = b"CAPINDX1"
LEVEL = 4                           # of gzip
_ODD = re.compile(r"[\s\x00-\x20\x7f]")


def url_key(url: str | None) -> str:
    """Sort key: host labels reversed, then path and query; scheme, user, fragment and letter case of the host dropped."""
    if not url:
        return "-"
    try:
        u = urlsplit(url.strip())
        host, port = u.hostname or "", u.port
    except ValueError:
        u, host, port = None, "", None
    if not host:
        key = url
    else:
        key = ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + (u.path or "/") + (f"?{u.query}" if u.query else "")
    return _ODD.sub(lambda m: quote(m[0]), key)


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
            f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest32(payload)}", "Content-Type: application/http;msgtype=response"]
    if url:
        head.append(f"WARC-Target-URI: {_ODD.sub(lambda m: quote(m[0]), url)}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    body = http + (payload if refers_to is None else b"")
    head.append(f"Content-Length: {len(body)}")
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + z.flush()


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, payload) of a record."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    return fields, body.partition(b"\r\n\r\n")[2]


def _page(urn: str) -> int | None:
    text = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(text) if text else None


CAPTURE = pa.schema([("url_key", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
CAPTURE_DDL = "url_key string, page_id long, file string, offset long, length long"


def write_archives(pages: DataFrame, folder: str, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Write one archive for each partition; returns its captures: url_key, page_id, file, offset, length."""
    p = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    p = p.withColumn("sha", F.sha1("payload"))
    # only payloads that occur twice or more, with the page that keeps them
    keep = stored(p.where(F.octet_length("payload") >= min_bytes).groupBy("sha").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n"))
                  .where("n > 1 and keeper is not null").select("sha", "keeper"), "payloads")
    rows = p.join(keep, "sha", "left").select("page_id", "url", "payload", F.when(
        F.col("page_id").isNull() | (F.col("page_id") < F.col("keeper")), F.col("keeper")).alias("refers_to"))

    def write(batches):
        from pyspark import TaskContext

        out, path = None, f"{folder}/archive-{TaskContext.get().partitionId():06d}.warc.gz"
        for b in batches:
            cols = {f.name: [] for f in CAPTURE}
            for page, url, payload, to in zip(*(c.to_pylist() for c in b.columns)):
                if out is None:
                    out = Appender(path)
                    out.write(_info())
                member = record(page, url, payload, to)
                for c, v in zip(cols.values(), (url_key(url), page, path, out.write(member), len(member))):
                    c.append(v)
            yield batch(CAPTURE, **cols)
        if out:
            out.close()

    return stored(rows.mapInArrow(write, CAPTURE_DDL), "captures")


def _info() -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    body = b"format: WARC File Format 1.1\r\n"
    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Date: {DATE}\r\nWARC-Record-ID: <urn:page:info>\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(body)}\r\n\r\n"
    return z.compress(head.encode() + body + b"\r\n\r\n") + z.flush()


SHARD = pa.schema([("path", pa.string()), ("first", pa.string()), ("last", pa.string()), ("n", pa.int64())])


def write_index(captures: DataFrame, folder: str) -> DataFrame:
    """Write the index files; returns one row for each: path, first and last key, number of captures."""
    def write(batches):
        from pyspark import TaskContext

        path = f"{folder}/index-{TaskContext.get().partitionId():06d}.cdx"
        out, lines, blocks, first, last, n = None, [], [], None, None, 0

        def flush():
            body = zlib.compress("\n".join(lines).encode(), 6)
            blocks.append(f"{lines[0].partition(' ')[0]} {out.write(body)} {len(body)}")
            lines.clear()

        for b in batches:
            for key, page, file, offset, length in zip(*(c.to_pylist() for c in b.columns)):
                if out is None:
                    out, first = Appender(path), key
                    out.write(MAGIC)
                last, n = key, n + 1
                lines.append(f"{key} {'' if page is None else page} {offset} {length} {file}")
                if len(lines) >= BLOCK_LINES:
                    flush()
        if out:
            if lines:
                flush()
            directory = zlib.compress("\n".join(blocks).encode(), 6)
            at = out.write(directory)
            out.write(struct.pack("<QQ", at, len(directory)) + MAGIC)
            out.close()
            yield batch(SHARD, path=[path], first=[first], last=[last], n=[n])

    order = ["url_key", "page_id", "file", "offset"]
    dealt = captures.repartitionByRange(shuffle_partitions(captures.sparkSession), *order).sortWithinPartitions(*order)
    return stored(dealt.select(*CAPTURE.names).mapInArrow(write, "path string, first string, last string, n long"), "index-files")


def _directory(r: Ranges, path: str) -> tuple[list[str], list[tuple[int, int]]]:
    end = r.size(path)
    at, length, magic = struct.unpack("<QQ8s", r.read(path, end - 24, 24))
    if magic != MAGIC:
        raise ValueError(f"not an index file: {path}")
    rows = [x.split(" ") for x in zlib.decompress(r.read(path, at, length)).decode().split("\n")]
    return [x[0] for x in rows], [(int(x[1]), int(x[2])) for x in rows]


BLOCK = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url_key", pa.string())])


def lookup(keys: DataFrame, index: DataFrame) -> DataFrame:
    """All captures of the url_keys asked for.  A key over many blocks is looked up in each of them by itself."""
    spark = keys.sparkSession
    shards = spark.sparkContext.broadcast(sorted((r["first"], r["last"], r["path"]) for r in index.collect()))
    parts = shuffle_partitions(spark)

    def find_blocks(batches):
        firsts, lasts, paths = map(list, zip(*shards.value)) if shards.value else ([], [], [])
        r, held, keys, spans = Ranges(), None, [], []
        for b in batches:
            out = {f.name: [] for f in BLOCK}
            for key in b.column(0).to_pylist():
                for k in range(bisect_left(lasts, key), bisect_right(firsts, key)):
                    if held != k:
                        held, (keys, spans) = k, _directory(r, paths[k])
                    for j in range(max(0, bisect_left(keys, key) - 1), bisect_right(keys, key)):
                        for c, v in zip(out.values(), (paths[k], *spans[j], key)):
                            c.append(v)
            yield batch(BLOCK, **out)
        r.close()

    def read_blocks(batches):
        r, now, lines, keys = Ranges(), None, [], []
        for b in batches:
            out = {f.name: [] for f in CAPTURE}
            for path, offset, length, key in zip(*(c.to_pylist() for c in b.columns)):
                if now != (path, offset):
                    now, lines = (path, offset), zlib.decompress(r.read(path, offset, length)).decode().split("\n")
                    keys = [x.partition(" ")[0] for x in lines]
                for j in range(bisect_left(keys, key), bisect_right(keys, key)):
                    _, page, at, size, file = lines[j].split(" ", 4)
                    for c, v in zip(out.values(), (key, int(page) if page else None, file, int(at), int(size))):
                        c.append(v)
            yield batch(CAPTURE, **out)
        r.close()

    asked = keys.select("url_key").distinct().repartitionByRange(parts, "url_key").sortWithinPartitions("url_key")
    blocks = asked.mapInArrow(find_blocks, "path string, offset long, length long, url_key string")
    dealt = blocks.repartition(parts, "path", "offset").sortWithinPartitions("path", "offset", "url_key")
    return dealt.select(*BLOCK.names).mapInArrow(read_blocks, CAPTURE_DDL)


RECORD = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()),
                    ("payload_bytes", pa.int64()), ("url", pa.string())])


def read_records(captures: DataFrame) -> DataFrame:
    """Records at the captures' byte ranges, in order of file and offset; a revisit has the digest it states and no size."""
    def read(batches):
        r = Ranges()
        for b in batches:
            out = {f.name: [] for f in RECORD}
            for file, offset, length in zip(*(c.to_pylist() for c in b.columns)):
                head, payload = parse(r.read(file, offset, length))
                stated, to = head["WARC-Payload-Digest"].removeprefix("sha1:"), head.get("WARC-Refers-To")
                whole = head["WARC-Type"] == "response"
                if whole and digest32(payload) != stated:
                    raise ValueError(f"payload of {head['WARC-Record-ID']} in {file} is damaged")
                for c, v in zip(out.values(), (_page(head["WARC-Record-ID"]), head["WARC-Type"], _page(to) if to else None, stated,
                                               len(payload) if whole else None, head.get("WARC-Target-URI"))):
                    c.append(v)
            yield batch(RECORD, **out)
        r.close()

    dealt = captures.repartition(shuffle_partitions(captures.sparkSession), "file").sortWithinPartitions("file", "offset")
    return dealt.select("file", "offset", "length").mapInArrow(
        read, "page_id long, record_type string, refers_to long, payload_digest string, payload_bytes long, url string")


def with_targets(records: DataFrame) -> DataFrame:
    """Revisits take size and digest from the response they refer to."""
    records = stored(records, "records")
    whole, other = records.where("record_type = 'response'"), records.where("record_type <> 'response'")
    target = whole.where("page_id is not null").select(F.col("page_id").alias("refers_to"), "payload_digest", "payload_bytes").distinct()
    found = other.drop("payload_bytes").join(target, ["refers_to", "payload_digest"], "left")
    return whole.unionByName(found)


def keys_of(pages: DataFrame) -> DataFrame:
    schema = pa.schema([("url_key", pa.string())])

    def run(batches):
        for b in batches:
            yield batch(schema, url_key=[url_key(u) for u in b.column(0).to_pylist()])
    return pages.select(F.col("url").cast("string")).mapInArrow(run, "url_key string")


def archived(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write archives and index, look every page's URL up, and read its records back."""
    folder = folder or scratch_path(pages.sparkSession, "warc")
    index = write_index(write_archives(pages, folder), folder)
    return with_targets(read_records(lookup(keys_of(pages), index)))
