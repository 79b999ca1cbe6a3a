"""WARC transaction assembly: request, response and metadata records joined through their concurrent-to identifiers.

Records that name each other, directly or through others, belong to one capture. Records that stand together in a file
are joined while they are parsed, in groups; each record then bears its group's root. Ids that are named in several
groups make a small graph of roots whose components are found from headers alone; only then are payloads parsed, and
each moves once, to its capture's row.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, release, ship, small, stored
from .components import components

RECORD = "struct<record_id: string, type: string, target_uri: string, date: string, content_type: string, headers: array<struct<name: string, value: string>>, payload: binary>"
RECORDS = "record_id string, concurrent_to array<string>, type string, target_uri string, date string, content_type string, headers array<struct<name: string, value: string>>, payload binary, root string"
CAPTURES = f"capture_id string, target_uri string, requests array<{RECORD}>, responses array<{RECORD}>, metadata array<{RECORD}>, others array<{RECORD}>"

#: How the types are grouped in a capture's row; any other type goes to others.
GROUPS = {"request": "requests", "response": "responses", "metadata": "metadata"}
#: Bytes of payload in one Arrow batch, and in a group of a file's records.
BATCH_BYTES = 8 << 20
_CHUNK = 1 << 16


class BadRecord(ValueError):
    """Bytes that aren't a WARC record where one should start."""


def _headers(head: bytes) -> list[tuple[str, str]]:
    """Named fields in order; a line that starts with white space goes on with the one before."""
    fields: list[tuple[str, str]] = []
    for line in head.decode("utf-8", "replace").split("\n"):
        line = line.rstrip("\r")
        if line[:1] in (" ", "\t") and fields:
            fields[-1] = (fields[-1][0], f"{fields[-1][1]} {line.strip()}")
        elif ":" in line:
            name, _, value = line.partition(":")
            fields.append((name.strip(), value.strip()))
    return fields


def _record(fields: list[tuple[str, str]], payload: bytes | None) -> tuple:
    first: dict[str, str] = {}
    for name, value in fields:
        first.setdefault(name.lower(), value)
    links = [v for n, v in fields if n.lower() == "warc-concurrent-to" and v]
    kind = first.get("warc-type")
    return first.get("warc-record-id") or None, links, kind.lower() if kind else None, first.get("warc-target-uri"), first.get("warc-date"), first.get("content-type"), fields, payload


def _length(fields: list[tuple[str, str]]) -> int:
    said = next((v for n, v in fields if n.lower() == "content-length"), "")
    if not said.isascii() or not said.isdigit():
        raise BadRecord(f"no valid Content-Length: {said[:40]!r}")
    return int(said)


def parse(data: bytes) -> Iterator[tuple]:
    """The records of some bytes (RECORDS's fields), plain or gzip members one after another."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at, end = 0, len(data)
    while True:
        while at < end and data[at] in b"\r\n":
            at += 1
        if at >= end:
            return
        if data[at : at + 5] != b"WARC/":
            raise BadRecord(f"no record at byte {at}")
        stop = data.find(b"\r\n\r\n", at)
        if stop < 0:
            raise BadRecord(f"a record's header at byte {at} has no end")
        fields = _headers(data[data.find(b"\n", at) + 1 : stop])
        n = _length(fields)
        if stop + 4 + n > end:
            raise BadRecord(f"a record at byte {at} is cut off")
        yield _record(fields, data[stop + 4 : stop + 4 + n])
        at = stop + 4 + n


def stream(file: BinaryIO) -> Iterator[tuple]:
    """The records of an open WARC file, one in memory at a time."""
    while True:
        line = file.readline(_CHUNK)
        if not line:
            return
        if line in (b"\r\n", b"\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise BadRecord(f"no record where one should start: {line[:40]!r}")
        head = []
        while (line := file.readline()) not in (b"\r\n", b"\n"):
            if not line:
                raise BadRecord("a record's header has no end")
            head.append(line)
        fields = _headers(b"".join(head))
        payload = file.read(n := _length(fields))
        if len(payload) < n:
            raise BadRecord("a record is cut off")
        yield _record(fields, payload)


_NAMES = ["record_id", "concurrent_to", "type", "target_uri", "date", "content_type", "headers", "payload"]
_PAIR = pa.struct([("name", pa.string()), ("value", pa.string())])
_TYPES = [pa.string(), pa.list_(pa.string()), *[pa.string()] * 4, pa.list_(_PAIR), pa.binary(), pa.string()]


def rooted(records: list[tuple]) -> Iterator[tuple]:
    """Records of a group, each with its root: the lowest id of the responses that it is linked to, else the lowest id of the records.

    A record without an id goes by the first that it names; if it names none its root is null.
    """
    over: dict[str, str] = {}

    def find(x: str) -> str:
        while (y := over.setdefault(x, x)) != x:
            over[x] = x = over[y]
        return x

    own = [r[0] or next((t for t in r[1] if t), None) for r in records]
    for key, r in zip(own, records):
        for to in r[1]:
            if key and to:
                over[find(key)] = find(to)
    lowest: dict[str, tuple[bool, str]] = {}
    for key, r in zip(own, records):
        if key:
            at, rank = find(key), (r[2] != "response", key)
            lowest[at] = min(lowest.get(at, rank), rank)
    for key, r in zip(own, records):
        yield (*r, lowest[find(key)][1] if key else None)


def _grouped(records: Iterator[tuple]) -> Iterator[tuple]:
    """Records of a file with their roots, in groups of about BATCH_BYTES; where a group ends depends on the file alone."""
    group: list[tuple] = []
    held = 0
    for r in records:
        group.append(r)
        held += 512 + len(r[7] or b"")
        if held >= BATCH_BYTES:
            yield from rooted(group)
            group, held = [], 0
    yield from rooted(group)


def _batched(records: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    held = 0

    def made() -> pa.RecordBatch:
        cols = [list(c) for c in zip(*rows)]
        cols[6] = [[{"name": n, "value": v} for n, v in fields] for fields in cols[6]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _TYPES)], [*_NAMES, "root"])

    for r in records:
        rows.append(r)
        held += 512 + len(r[7] or b"")
        if held >= BATCH_BYTES:
            yield made()
            rows, held = [], 0
    if rows:
        yield made()


def warc_records(blocks: DataFrame, column: str = "warc", payloads: bool = True) -> DataFrame:
    """The records of a binary column that holds WARC bytes: one row each, in RECORDS's columns; a value is a group.

    A null or empty value has none. Bytes that are no WARC raise an error, which names the place. Without payloads
    the payload is null.
    """
    ship(blocks.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = (r for b in batches for x in b.column(0) if x.is_valid for r in rooted(list(parse(x.as_py()))))
        yield from _batched(every if payloads else ((*r[:7], None, r[8]) for r in every))

    return blocks.select(F.col(column).cast("binary")).mapInArrow(run, RECORDS)


def opened(uri: str) -> BinaryIO:
    """A file of any file system that Arrow knows (local, HDFS, S3, GCS, Azure), as Spark names it; gzip is undone."""
    from pyarrow import fs

    scheme, _, rest = uri.partition(":")
    if scheme in ("s3a", "s3n"):
        uri = f"s3:{rest}"
    if scheme == "file":  # Spark escapes what a URI can't hold, or writes one slash
        from urllib.parse import unquote

        uri = "/" + unquote(rest).lstrip("/")
    files, path = (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri)
    raw = io.BufferedReader(files.open_input_stream(path, compression=None), 1 << 20)
    return gzip.open(raw) if path.endswith(".gz") else raw  # type: ignore[return-value]


def read_warc(spark: SparkSession, paths: str | list[str], payloads: bool = True) -> DataFrame:
    """The records of .warc and .warc.gz files of a file system that all executors reach; each task streams its files.

    Spark lists the files; one can't be split, as gzip members can't be found from within, so each is one task's.
    """
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[tuple]:
            for b in batches:
                for path in b.column(0).to_pylist():
                    with opened(path) as f:
                        yield from _grouped(stream(f))

        every = records()
        yield from _batched(every if payloads else ((*r[:7], None, r[8]) for r in every))

    files = spark.read.format("binaryFile").load(paths).select("path")
    return files.repartition(max(1, files.rdd.getNumPartitions()), "path").mapInArrow(run, RECORDS)


def assemble(records: DataFrame, headers: DataFrame | None = None) -> DataFrame:
    """One row (CAPTURES) for each capture of records.

    capture_id is the lowest id of its responses, or where there is none the lowest of its records; target_uri the
    lowest URI of its responses, else of its records. The arrays hold the records by type, in the order of their
    values. Records that are the same in every value stand once. A record whose concurrent-to names a record that
    isn't there still joins others that name it. A record without an id joins what it names; if it names nothing it
    is a capture of its own, with a null capture_id, as often as it stands there. An empty table gives an empty
    table; further columns of records are left out.

    headers are the same records without payloads, where they cost less to read. Without a column root each record is
    a group of its own. A capture is one row, so all its records are one task's in the end.
    """
    if headers is None:
        headers = records
    key = F.coalesce(F.nullif("record_id", F.lit("")), F.get(F.filter("concurrent_to", lambda x: (x != "")), F.lit(0)))
    at = lambda df: F.col("root") if "root" in df.columns else key
    answer = F.col("type").eqNullSafe("response")
    named = F.transform(F.filter(F.coalesce("concurrent_to", F.array().cast("array<string>")), lambda x: x != ""), lambda x: F.struct(x.alias("id"), F.lit(False).alias("answers")))
    own = F.array(F.struct(key.alias("id"), answer.alias("answers")))
    seen = stored(headers.where(key.isNotNull()).select(at(headers).alias("root"), F.explode(F.concat(own, named)).alias("x")).select("root", "x.*"), "seen")
    # an id in several groups links their roots; most ids are in one
    both = stored(seen.groupBy("id").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select(F.col("id").alias("__of"), "low"), "both")
    low = components(seen.join(small(both), F.col("id") == F.col("__of")).select(F.col("low").alias("a"), F.col("root").alias("b")))
    member = low.select(F.col("id").alias("__in"), F.col("root").alias("__top")).unionByName(low.select(F.col("root").alias("__in"), F.col("root").alias("__top"))).distinct()
    member = stored(member, "member")
    answers = stored(seen.where("answers").join(small(member), F.col("root") == F.col("__in")).groupBy("__top").agg(F.min("id").alias("__answer")).withColumnRenamed("__top", "__top2"), "answers")
    lowest = member.groupBy("__top").agg(F.min("__in").alias("__least"))
    named_as = lowest.join(small(answers), F.col("__top") == F.col("__top2"), "left").select(F.col("__top").alias("__t"), F.coalesce("__answer", "__least").alias("__capture"))
    moved = stored(member.join(named_as, F.col("__top") == F.col("__t")).where("__in <> __capture").select(F.col("__in").alias("__id"), "__capture"), "moved")
    release(seen, both, low, member, answers)

    payload = F.struct(*[c for c in _NAMES if c != "concurrent_to"])
    kind = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k in GROUPS for x in (k, k)]), F.col("type")), F.lit("other"))
    lone = F.when(F.col("root").isNull(), F.monotonically_increasing_id())
    rows = records.select(at(records).alias("root"), kind.alias("kind"), payload.alias("r"))
    rows = rows.join(small(moved), F.col("root") == F.col("__id"), "left").select(F.coalesce("__capture", "root").alias("capture_id"), lone.alias("single"), "kind", "r")
    lists = GROUPS | {"other": "others"}
    gathered = [F.array_sort(F.array_distinct(F.collect_list(F.when(F.col("kind") == k, F.col("r"))))).alias(n) for k, n in lists.items()]
    whole = rows.groupBy("capture_id", "single").agg(*gathered)
    uris = F.flatten(F.array(*[F.transform(c, lambda r: r["target_uri"]) for c in lists.values()]))
    first = F.coalesce(F.array_min(F.transform("responses", lambda r: r["target_uri"])), F.array_min(uris))
    return whole.select("capture_id", first.alias("target_uri"), *lists.values())


def page_id(kind: str):
    """A record id made of the page's values, the same in every run."""
    h = F.md5(F.concat(F.lit(f"{kind}:"), F.coalesce(F.col("page_id").cast("string"), F.lit("-")), F.lit(":"), F.coalesce("url", F.lit("-")), F.lit(":"), F.coalesce("html", F.lit("-"))))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", part(1, 8), part(9, 4), part(13, 4), part(17, 4), part(21, 12)), F.lit(">"))


def pages_as_warc(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """warc: for each page the bytes of its request, response and metadata records. A null html is an empty body, a null url stands in no header."""
    url = F.coalesce(F.regexp_replace("url", r"[\r\n]", ""), F.lit(""))
    uri = F.when(url != "", F.concat(F.lit("WARC-Target-URI: "), url, F.lit("\r\n"))).otherwise("")

    def record(kind: str, rid, content: str, body, to=None):
        link = F.concat(F.lit("WARC-Concurrent-To: "), to, F.lit("\r\n")) if to is not None else F.lit("")
        head = F.concat(F.lit(f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: "), rid, F.lit(f"\r\nWARC-Date: {date}\r\n"), uri, link, F.lit(f"Content-Type: {content}\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
        return F.concat(head, body, F.lit("\r\n\r\n"))

    ids = pages.select("page_id", "url", "html", *[page_id(k).alias(f"__{k}") for k in GROUPS])
    html = F.coalesce("html", F.lit(""))
    host = F.regexp_extract(url, r"^[a-z]+://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"^[a-z]+://[^/?#]*([^#]*)", 1)
    request = record("request", F.col("__request"), "application/http; msgtype=request", F.concat(F.lit("GET "), path, F.lit(" HTTP/1.1\r\nHost: "), host, F.lit("\r\n\r\n")), F.col("__response"))
    response = record("response", F.col("__response"), "application/http; msgtype=response", F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"), html))
    metadata = record("metadata", F.col("__metadata"), "application/warc-fields", F.concat(F.lit("pageId: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit("\r\n")), F.col("__request"))
    return ids.select(F.concat(request, response, metadata).cast("binary").alias("warc"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as three records in WARC bytes, which are parsed and assembled again."""
    blocks = pages_as_warc(read(spark, sf_dir, "pages"))
    return assemble(warc_records(blocks), warc_records(blocks, payloads=False))
