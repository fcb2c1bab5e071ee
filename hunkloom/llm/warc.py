"""WARC archives with a two-level capture index.

`write_archives` writes one gzip member per record, so that a record is a byte range of its file;
of records with equal payloads the one with the largest id is a response and the others are
revisits that refer to it. `build_index` sorts captures by reversed-host URL key over the cluster
and writes them as compressed blocks; each index file ends with a sparse directory of its blocks
(first key, offset, length) and a footer. `lookup` finds captures by binary search in the list of
files, in a file's directory and in a block, and then reads the record's byte range only.

All files go to the folder in spark.checkpoint.dir, through pyarrow's file systems. A task that
is run again writes a file of its own name; only files named in the written manifest are used.

Defined results: null html is the empty payload, a null url has an empty key, rows with a null id
are records without an id (a response if the group has no other id); rows repeating an id are
records of their own, and all that hold the group's largest id are responses; an empty table gives
an empty index. Other columns of the input are not archived.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import struct
import uuid
import zlib
from collections import OrderedDict

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, new_folder

BLOCK_LINES = 2000
#: Smallest payload that becomes a revisit.
MIN_REVISIT = 0
FOOTER = struct.Struct("<QQ")
DATE = "1970-01-01T00:00:00Z"  # the tables hold no time of capture
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MANIFEST = "key string, file string, at long, size long"
_FOUND = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def url_key(url: F.Column) -> F.Column:
    """Reversed-host key: scheme, user, port and fragment go, `www.a.org/x` becomes `org,a,www)/x`."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), r"#[\s\S]*$", "")
    site = F.regexp_extract(bare, r"^[^/?]*", 0)
    host = F.lower(F.regexp_replace(F.regexp_replace(site, r"^.*@", ""), r":\d*$", ""))
    rest = F.substring(bare, F.length(site) + 1, F.length(bare))
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(rest.startswith("/"), "").otherwise("/"), rest)


def capture_key(url: F.Column, page_id: F.Column) -> F.Column:
    return F.concat(url_key(url), F.lit(" "), F.lpad(F.coalesce(page_id.cast("string"), F.lit("")), 20, "0"))


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def footer(at: int, size: int) -> bytes:
    """Where the directory of an index file is."""
    return FOOTER.pack(at, size)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """An uncompressed WARC record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    name = lambda i: f"<urn:page:{i}>"
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name('' if page_id is None else page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {(url or '').replace(chr(13), '%0D').replace(chr(10), '%0A')}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest(payload)}"]
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {name('' if refers_to is None else refers_to)}"]
    return "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """What a record says: type, id, url, payload (None for revisits), its length and digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
    size = int(fields["Content-Length"])
    if version != "WARC/1.1" or rest[size:] != b"\r\n\r\n":
        raise ValueError("no whole WARC record")
    http, _, payload = rest[:size].partition(b"\r\n\r\n")
    length = int(next(x.split(b":")[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")))
    number = lambda x: int(x[len("<urn:page:") : -1]) if x and x != "<urn:page:>" else None
    out = {"record_type": fields["WARC-Type"], "page_id": number(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "payload_bytes": length, "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"), "refers_to": number(fields.get("WARC-Refers-To", "")), "payload": None}
    if out["record_type"] == "response":
        if len(payload) != length or digest(payload) != out["payload_digest"]:
            raise ValueError(f"record {out['page_id']} is damaged")
        out["payload"] = payload
    return out


def write_archives(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write the archives; the manifest (key, file, at, size), itself a written table."""
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.sha1("html")).withColumn("key", capture_key(F.col("url"), F.col("page_id")))
    twins = rows.where(F.octet_length("html") >= MIN_REVISIT).groupBy("sha").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1").drop("n")
    rows = rows.join(twins, "sha", "left").select("page_id", "url", "html", "key", "last")

    def run(it):
        store, top = fs.FileSystem.from_uri(folder)
        file, at = f"{uuid.uuid4().hex}.warc.gz", 0
        out = None
        for batch in it:
            made = []
            for page_id, own_url, text, own_key, last in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "key", "last")), strict=True):
                if out is None:
                    store.create_dir(top, recursive=True)
                    out = store.open_output_stream(f"{top}/{file}", compression=None)
                data = gzip.compress(record(page_id, own_url, text.encode(), last, last is not None and page_id != last), 6, mtime=0)
                out.write(data)
                made.append((own_key, file, at, len(data)))
                at += len(data)
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*made, strict=True)], names=["key", "file", "at", "size"])
        if out is not None:
            out.close()

    return cut(rows.mapInArrow(run, _MANIFEST), "warc-manifest")


def build_index(manifest: DataFrame, folder: str) -> list[tuple[str, str]]:
    """Write the index; first key and name of each file, in order (one for each sorted partition)."""
    order = manifest.repartitionByRange("key").sortWithinPartitions("key")

    def run(it):
        store, top = fs.FileSystem.from_uri(folder)
        file, at, out, lines, directory = f"{uuid.uuid4().hex}.cdx.gz", 0, None, [], []

        def flush():
            nonlocal at
            data = gzip.compress("\n".join(x for _, x in lines).encode(), 6, mtime=0)
            out.write(data)
            directory.append([lines[0][0], at, len(data)])
            at += len(data)
            lines.clear()

        for batch in it:
            for key, warc, start, size in zip(*(batch.column(c).to_pylist() for c in ("key", "file", "at", "size")), strict=True):
                if out is None:
                    store.create_dir(top, recursive=True)
                    out = store.open_output_stream(f"{top}/{file}", compression=None)
                lines.append((key, json.dumps([key, warc, start, size], ensure_ascii=False)))
                if len(lines) == BLOCK_LINES:
                    flush()
        if out is not None:
            if lines:
                flush()
            data = zlib.compress(json.dumps(directory).encode())
            out.write(data + footer(at, len(data)))
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([directory[0][0]]), pa.array([file])], names=["first", "file"])

    files = cut(order.mapInArrow(run, "first string, file string"), "warc-index").collect()
    return sorted((tuple(r) for r in files), key=lambda r: r[0].encode())


class Reader:
    """Range reads with small caches of open files, directories and blocks."""

    def __init__(self, folder: str, files: list[tuple[str, str]]):
        self.store, self.top = fs.FileSystem.from_uri(folder)
        self.firsts, self.files = [k.encode() for k, _ in files], [f for _, f in files]
        self.cache: OrderedDict[tuple, object] = OrderedDict()

    def kept(self, what: tuple, make, limit: int = 64):
        if what in self.cache:
            self.cache.move_to_end(what)
        else:
            self.cache[what] = make()
            if len(self.cache) > limit:
                self.cache.popitem(last=False)
        return self.cache[what]

    def range(self, file: str, at: int, size: int) -> bytes:
        return self.kept(("file", file), lambda: self.store.open_input_file(f"{self.top}/{file}")).read_at(size, at)

    def directory(self, file: str) -> tuple[list[bytes], list]:
        size = self.kept(("file", file), lambda: self.store.open_input_file(f"{self.top}/{file}")).size()
        at, length = FOOTER.unpack(self.range(file, size - FOOTER.size, FOOTER.size))
        rows = json.loads(zlib.decompress(self.range(file, at, length)))
        return [r[0].encode() for r in rows], rows

    def block(self, file: str, at: int, size: int) -> tuple[list[bytes], list]:
        rows = [json.loads(x) for x in gzip.decompress(self.range(file, at, size)).decode().split("\n")]
        return [r[0].encode() for r in rows], rows

    def captures(self, key: str) -> list:
        """All captures of a key: file, then block, then line, each by binary search; equal keys may cross blocks and files."""
        want, found = key.encode(), []
        f = max(0, bisect.bisect_left(self.firsts, want) - 1)
        while f < len(self.files) and self.firsts[f] <= want:
            file = self.files[f]
            firsts, blocks = self.kept(("directory", file), lambda file=file: self.directory(file))
            b = max(0, bisect.bisect_left(firsts, want) - 1)
            while b < len(blocks) and firsts[b] <= want:
                keys, rows = self.kept(("block", file, b), lambda file=file, b=b, blocks=blocks: self.block(file, *blocks[b][1:]))
                found += rows[bisect.bisect_left(keys, want) : bisect.bisect_right(keys, want)]
                b += 1
            f += 1
        return found

    def records(self, key: str) -> list[dict]:
        return [parse(gzip.decompress(self.range(file, at, size))) for _, file, at, size in self.captures(key)]


def lookup(keys: DataFrame, folder: str, files: list[tuple[str, str]], payloads: bool = True) -> DataFrame:
    """The records of all captures of the distinct values of `key`, which are sorted so that a task meets each block once."""
    # keys are small and each is a read, so their number of tasks isn't left to their size
    parts = max(2 * len(files), int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = keys.select("key").distinct().repartitionByRange(parts, "key").sortWithinPartitions("key")
    names = [f.split()[0] for f in _FOUND.split(", ")][: 7 if payloads else 6]
    schema = ", ".join(_FOUND.split(", ")[: len(names)])
    kinds = dict(zip(names, [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()], strict=False))

    def run(it):
        reader = Reader(folder, files)
        for batch in it:
            wanted = batch.column("key").to_pylist()
            for at in range(0, len(wanted), 200):
                found = [r for key in wanted[at : at + 200] for r in reader.records(key)]
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in found], kinds[n]) for n in names], names=names)

    return order.mapInArrow(run, schema)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    folder = new_folder(spark, "warc")
    files = build_index(write_archives(pages, folder), folder)
    keys = pages.select(capture_key(F.col("url"), F.col("page_id").cast("long")).alias("key"))
    return lookup(keys, folder, files, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP4_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body)::BIGINT AS payload_bytes, sha1(body) AS sha FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY sha) AS last FROM d),
b AS (SELECT *, list_transform(range(0, 8), lambda k: ('0x' || substr(sha, (5 * k + 1)::INT, 5))::BIGINT) AS fives FROM m)
SELECT page_id, payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((fives[(j // 4 + 1)::INT] >> (15 - 5 * (j % 4))::INT) & 31)::INT + 1, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> last THEN last END AS refers_to
FROM b
"""
