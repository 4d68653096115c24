"""WARC archives with a two-level capture index.

Writing: every task writes archives of its own, one gzip member for each record, and returns where the records are. Of
records with equal payloads of REVISIT_FROM bytes or more, the one with the largest id is a response, and the others revisit
it without the payload.

Index: captures are sorted by reversed-host URL key over all tasks. Level two are index files of compressed blocks of
BLOCK_CAPTURES captures; level one is a sparse directory with the first key of every block. A lookup finds the index file
among the files' first keys, reads its directory, finds the block by binary search, reads only that block's range, and
then only the records' ranges.

File names are new for each attempt of a task, and only what successful tasks return is ever read: a lost executor or a second
attempt leaves files that nothing points to.

Defined cases: null html is the empty payload; a null url has the key `-` and no target header; a null id is written as an
empty record name and read back as null, and ranks below every id; rows alike in id and payload are each written, and all
but one revisit that id; an empty table writes no files; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import chain
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import storage
from .common import cut, pick, place, shared_dir, small_batches
from .rows import PLACE, located, told

REVISIT_FROM = 1000
#: Bytes of an archive after which a new one is begun, captures of an index block, blocks of an index file, bytes read at once.
ARCHIVE_BYTES = 256 << 20
BLOCK_CAPTURES = 1000
FILE_BLOCKS = 200
READ_BYTES = 4 << 20
DATE = "2026-01-01T00:00:00Z"
NO_URL = "-"

CAPTURES = "key string, id bigint, url string, file string, offset bigint, length bigint"
BLOCKS = "first_key string, last_key string, file string, offset bigint, length bigint, captures bigint"


def url_key(url: str | None) -> str:
    """The sort key of a URL: its host reversed by commas, then port, path and query."""
    if not url:
        return NO_URL
    try:
        p = urlsplit(url.strip())
        host, port = (p.hostname or "").lower(), p.port
    except ValueError:
        return url
    if not host:
        return url
    return ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + (p.path or "/") + (f"?{p.query}" if p.query else "")


def _one_line(x: str) -> str:
    return "".join(c if c.isprintable() else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in x)


def record(id_: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record: HTTP headers, and the payload unless it is a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    name = lambda x: "" if x is None else str(x)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{name(id_)}>", f"WARC-Date: {DATE}"]
    if url:
        head.append(f"WARC-Target-URI: {_one_line(url)}")
    head.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(hashlib.sha1(payload).digest()).decode()}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{name(refers_to)}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[int | None, str | None, bytes | None, int, str, str, int | None]:
    """(id, url, payload or None, payload bytes, digest, type, refers_to) of one record; a damaged one raises an error."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a record")
    h = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
    block = rest[: int(h["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: ")).split(": ")[1])
    digest = base64.b32decode(h["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    name = lambda x: int(n) if (n := x.removeprefix("<urn:page:").removesuffix(">")) else None
    revisit = h["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"record {h['WARC-Record-ID']} does not match its digest")
    return name(h["WARC-Record-ID"]), h.get("WARC-Target-URI"), None if revisit else payload, size, digest, h["WARC-Type"], name(h["WARC-Refers-To"]) if revisit else None


def gzip_member(data: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _rows(batch: dict[str, list], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(batch[n], kinds[t]) for n, t in fields], names=[n for n, _ in fields])


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write `pages` as archives under `folder`; returns the captures (CAPTURES), written when this function returns."""
    small_batches(pages.sparkSession)
    full, in_files = located(pages)
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    names = {"id": id_col, "url": url_col, "html": html_col}
    rows = full.select(*PLACE, *[F.col(f"c{place(pages, c)}").alias(k) for k, c in names.items()])
    # Two hashes and the length stand for a payload; payloads are read again only to be written.
    narrow = cut(rows.select(*PLACE, "id", F.octet_length(payload).cast("bigint").alias("n"), F.unhex(F.sha1(payload)).alias("digest"), F.xxhash64(payload).alias("x")).where(F.col("n") >= REVISIT_FROM))
    same = ["digest", "x", "n"]
    groups = narrow.groupBy(*same).agg(F.max(F.struct("id", *PLACE)).alias("best"), F.count(F.lit(1)).alias("k")).where("k > 1")
    again = narrow.join(groups, same).where((F.col("best.at_file") != F.col("at_file")) | (F.col("best.at_row") != F.col("at_row"))).select(*PLACE, F.col("best.id").alias("number"))
    decided = told(rows, again, in_files).select("id", "url", payload.alias("payload"), F.col("number").alias("refers_to"), F.col("named").alias("revisit"))

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, name, at = None, "", 0
        for b in batches:
            out: dict[str, list] = {k.split()[0]: [] for k in CAPTURES.split(", ")}
            for id_, url, body, refers_to, again in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if f is None or at >= ARCHIVE_BYTES:
                    if f is not None:
                        f.close()
                    name, at = f"{folder}/archive-{uuid.uuid4().hex}.warc.gz", 0
                    f = storage.create(name)
                member = gzip_member(record(id_, url, body, refers_to, again))
                f.write(member)
                for k, v in zip(out, (url_key(url), id_, url, name, at, len(member)), strict=True):
                    out[k].append(v)
                at += len(member)
            if out["key"]:
                f.flush()
                yield _rows(out, CAPTURES)
        if f is not None:
            f.close()

    return cut(decided.mapInArrow(archive, CAPTURES))


def index(captures: DataFrame, folder: str) -> DataFrame:
    """Write the index files of `captures`; returns the directory (BLOCKS), one row for each block."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, name, at, n = None, "", 0, 0
        held: list[list] = []
        for b in chain(batches, [None]):
            if b is not None:
                held += [list(x) for x in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            while len(held) >= BLOCK_CAPTURES or (b is None and held):
                if f is None or n == FILE_BLOCKS:
                    if f is not None:
                        f.close()
                    name, at, n = f"{folder}/index-{uuid.uuid4().hex}.cdxz", 0, 0
                    f = storage.create(name)
                part, held = held[:BLOCK_CAPTURES], held[BLOCK_CAPTURES:]
                data = zlib.compress("\n".join(json.dumps(x, ensure_ascii=False) for x in part).encode())
                f.write(data)
                f.flush()
                yield _rows({"first_key": [part[0][0]], "last_key": [part[-1][0]], "file": [name], "offset": [at], "length": [len(data)], "captures": [len(part)]}, BLOCKS)
                at, n = at + len(data), n + 1
        if f is not None:
            f.close()

    # The id after the key lets a key with many captures spread over tasks.
    order = ["key", "id", "file", "offset"]
    return cut(captures.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(blocks, BLOCKS))


def block_captures(file: str, offset: int, length: int) -> list[list]:
    return [json.loads(x) for x in zlib.decompress(storage.read(file, offset, length)).decode().split("\n")]


def captures_of(directory: DataFrame) -> DataFrame:
    """All captures, read from the index blocks."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [k.split()[0] for k in CAPTURES.split(", ")]
        for b in batches:
            for file, offset, length in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rows = block_captures(file, offset, length)
                yield _rows(dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)), CAPTURES)

    return directory.select("file", "offset", "length").mapInArrow(entries, CAPTURES)


class Directory:
    """Level one, in the order of keys: the index files' first and last keys, and for each file its blocks' first keys."""

    def __init__(self, rows: list[tuple[str, str, str, int, int]]):
        rows = sorted(rows, key=lambda r: (r[0], r[1], r[2], r[3]))
        self.first = [r[0] for r in rows]
        self.last = [r[1] for r in rows]
        self.blocks = [(r[2], r[3], r[4]) for r in rows]

    def of(self, key: str) -> list[tuple[str, int, int]]:
        """The blocks that can hold `key`, by binary search."""
        return self.blocks[bisect_left(self.last, key) : bisect_right(self.first, key)]


def lookup(directory: DataFrame, urls: DataFrame, url_col: str = "url") -> DataFrame:
    """The captures of each url of `urls`, by key; reads only the blocks that can hold them.

    The files' first and last keys come to the driver, one row for each index file (of up to FILE_BLOCKS * BLOCK_CAPTURES captures). A
    query goes to the task of its file, which holds that file's part of the directory only. A capture comes once, however often it is
    asked for.
    """
    files = sorted((r["lo"], r["hi"], r["file"]) for r in directory.groupBy("file").agg(F.min("first_key").alias("lo"), F.max("last_key").alias("hi")).collect())
    lows, highs = [x[0] for x in files], [x[1] for x in files]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {"key": [], "file": []}
            for u in b.column(0).to_pylist():
                key = url_key(u)
                for _, _, file in files[bisect_left(highs, key) : bisect_right(lows, key)]:
                    out["key"].append(key)
                    out["file"].append(file)
            yield _rows(out, "key string, file string")

    asked = pick(urls, url=url_col).mapInArrow(route, "key string, file string").distinct()
    names = [k.split()[0] for k in CAPTURES.split(", ")]

    def search(_key, left: pa.Table, right: pa.Table) -> pa.Table:
        level = Directory(list(zip(*(right.column(c).to_pylist() for c in ("first_key", "last_key", "file", "offset", "length")), strict=True)))
        by_block: dict[tuple[str, int, int], list[str]] = {}
        for k in left.column("key").to_pylist():
            for block in level.of(k):
                by_block.setdefault(block, []).append(k)
        found = []
        for block, keys in by_block.items():
            rows = block_captures(*block)
            sorted_keys = [r[0] for r in rows]
            for k in keys:
                found += rows[bisect_left(sorted_keys, k) : bisect_right(sorted_keys, k)]
        return pa.Table.from_batches([_rows(dict(zip(names, map(list, zip(*found, strict=True)), strict=True)) if found else {n: [] for n in names}, CAPTURES)])

    return asked.groupBy("file").cogroup(directory.groupBy("file")).applyInArrow(search, CAPTURES)


def read(captures: DataFrame, payloads: bool = False) -> DataFrame:
    """The records of `captures`: page_id, url, payload (if asked for), payload_bytes, payload_digest, record_type, refers_to.

    Captures are dealt out by archive and offset, so that neighbours are read together.
    """
    small_batches(captures.sparkSession)
    schema = "page_id bigint, url string, payload binary, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in schema.split(", ")]
        for b in batches:
            places = list(zip(*(c.to_pylist() for c in b.columns), strict=True))
            i = 0
            while i < len(places):
                j, (file, begin, length) = i + 1, places[i]
                end = begin + length
                while j < len(places) and places[j][0] == file and end <= places[j][1] <= end + 65536 and places[j][1] + places[j][2] - begin <= READ_BYTES:
                    end = places[j][1] + places[j][2]
                    j += 1
                data = storage.read(file, begin, end - begin)
                rows = [parse(zlib.decompress(data[o - begin : o - begin + n], 31)) for _, o, n in places[i:j]]
                yield _rows(dict(zip(names, ([x if payloads or k != 2 else None for x in c] for k, c in enumerate(zip(*rows, strict=True))), strict=True)), schema)
                i = j

    dealt = captures.select("file", "offset", "length").repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(records, schema)


def new_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
