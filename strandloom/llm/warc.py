"""WARC records: reading, writing, and resolving not-modified revisits.

A revisit record says that a page had not changed; its body is that of the latest earlier full
response for the same canonical url. The as-of join sorts all records by (url, time, id) over the
whole cluster, carries the latest response forward within each partition in one pass, and hands
each partition the response that was open at its start: one row a partition, so a url that a third
of all records share is split like any other, ties included. Only ids, validators and headers
move; bodies stay where they are.

A response is used only if no validator contradicts it: of payload digest, ETag and Last-Modified
those that both records carry must be equal (ETags weakly), and one at least must be there.
Headers of the revisit replace the response's, but for those that describe the stored body.

Status: ``response``; ``resolved``; ``changed`` (the latest earlier response contradicts);
``unchecked`` (no validator in common); ``missing`` (no earlier response, or no url). Records of
one time are ordered by id; a response at a revisit's own time counts as earlier if its id is less.
Nulls in any column are allowed; an empty table gives an empty one; bodies of any length stay where they are.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, shuffle_partitions, spread_join

#: Headers that describe the stored body, which a not-modified answer may not change.
BODY_HEADERS = ["connection", "content-encoding", "content-length", "content-md5", "content-range", "content-type", "keep-alive", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade"]

RECORD = "id long, url string, time long, kind string, etag string, last_modified string, digest string, headers map<string,string>"


def canonical_url(url: Column) -> Column:
    """Without scheme, user, default port, a leading www label, fragment, tracking parameters, and a closing slash; host in lower case."""
    rest = F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), r"#.*$", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1)), r"^.*@", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(rest, r"\?(.*)$", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(r"^(utm_[a-z]+|ref|fbclid|gclid)(=|$)")), "&")
    return F.concat(F.regexp_replace(host, r"^www\.", ""), path, F.when(kept == "", F.lit("")).otherwise(F.concat(F.lit("?"), kept)))


_CARRIED = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("pid", "seq", "row")]
    + [T.StructField("canonical", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("source", T.LongType())]
)


def _carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    pid, seq, url, open_id = TaskContext.get().partitionId(), 0, None, None
    for batch in batches:
        ids, kinds = batch.column("row"), batch.column("kind").to_pylist()
        sources = []
        for number, canonical, kind in zip(ids.to_pylist(), batch.column("canonical").to_pylist(), kinds):
            if canonical != url:
                url, open_id = canonical, None
            sources.append(open_id)
            if kind == "response":
                open_id = number
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([pid] * n, pa.int64()),
                pa.array(range(seq, seq + n), pa.int64()),
                ids,
                batch.column("canonical"),
                batch.column("kind"),
                pa.array(sources, pa.int64()),
            ],
            names=_CARRIED.names,
        )
        seq += n


def latest_responses(records: DataFrame) -> DataFrame:
    """(row, source) of every revisit with a canonical url: the latest earlier response's row or null."""
    spark = records.sparkSession
    light = records.where("canonical is not null").select("canonical", "time", "id", "row", "kind")
    ordered = light.repartitionByRange(shuffle_partitions(spark), "canonical", "time", "id", "row").sortWithinPartitions("canonical", "time", "id", "row")
    carried = cut(ordered.mapInArrow(_carry, _CARRIED))
    last = F.when(F.col("kind") == "response", F.col("row")).otherwise(F.col("source"))
    ends = carried.groupBy("pid").agg(
        F.min_by("canonical", "seq").alias("first"), F.max_by("canonical", "seq").alias("last"), F.max_by(last, "seq").alias("open")
    )
    waiting, url, open_id = [], None, None
    for e in sorted(ends.collect(), key=lambda e: e["pid"]):  # a row a partition
        if e["first"] == url and open_id is not None:
            waiting.append((e["pid"], url, open_id))
        if e["last"] != url or e["open"] is not None:
            url, open_id = e["last"], e["open"]
    handed = spark.createDataFrame(waiting, "pid long, canonical string, handed long")
    return (
        carried.where("kind = 'revisit'")
        .join(F.broadcast(handed), ["pid", "canonical"], "left")
        .select("row", F.coalesce("source", "handed").alias("source"))
    )


def _agrees(a: Column, b: Column) -> Column:
    weak = [F.regexp_replace(x, r"^W/", "") for x in (a, b)]
    return weak[0] == weak[1]


def resolve_revisits(records: DataFrame) -> DataFrame:
    """All ``records`` (RECORD) with canonical, source_id, status and merged headers.

    Repeated rows and ids: a result for each. Further columns stay, whatever their names, but for those named like the first three
    of the four, which the result replaces.
    """
    place = {c.lower(): f"c{k}" for k, c in enumerate(records.columns)}
    col = lambda c: F.col(place[c])
    inner = records.select(*[F.col(c).alias(place[c.lower()]) for c in records.columns], canonical_url(F.col("url")).alias("canonical"), F.monotonically_increasing_id().alias("row"))
    known = cut(inner)
    found = cut(latest_responses(known.select("canonical", "row", col("time").alias("time"), col("id").alias("id"), col("kind").alias("kind"))))
    asked = found.where("source is not null").groupBy("source").agg(F.count("*").alias("n"))
    full = known.where(col("kind") == "response").select(F.col("row").alias("source"), *[col(c).alias(f"stored_{c}") for c in ("id", "etag", "last_modified", "digest", "headers")])
    given = spread_join(found.where("source is not null"), full.join(asked, "source"), "source", "n", F.col("row")).drop("n")
    joined = known.join(given, "row", "left")
    checks = [_agrees(col(c), F.col(f"stored_{c}")) for c in ("digest", "etag", "last_modified")]
    contradicts = F.coalesce(F.greatest(*[~c for c in checks]), F.lit(False))
    checked = F.coalesce(F.greatest(*checks), F.lit(False))
    status = (
        F.when(col("kind") == "response", "response")
        .when(F.col("source").isNull(), "missing")
        .when(contradicts, "changed")
        .when(checked, "resolved")
        .otherwise("unchecked")
    )
    none = F.map_from_arrays(F.array(), F.array()).cast("map<string,string>")
    fixed = F.array(*map(F.lit, BODY_HEADERS))
    stored = F.coalesce(F.col("stored_headers"), none)
    fresh = F.map_filter(F.coalesce(col("headers"), none), lambda k, _: ~F.array_contains(fixed, F.lower(k)))
    merged = F.map_concat(F.map_filter(stored, lambda k, _: ~F.map_contains_key(fresh, k)), fresh)
    resolved = F.col("status") == "resolved"
    return joined.withColumn("status", status).select(
        *[F.col(place[c.lower()]).alias(c) for c in records.columns if c.lower() not in ("canonical", "source_id", "status", "headers")],
        "canonical",
        F.when(resolved, F.col("stored_id")).alias("source_id"),
        "status",
        F.when(resolved, merged).otherwise(col("headers")).alias("headers"),
    )


def write_record(kind: str, url: str, date: str, http: bytes, extra: dict[str, str] | None = None) -> bytes:
    """One gzip member with one WARC/1.1 record."""
    head = {"WARC-Type": kind, "WARC-Target-URI": url, "WARC-Date": date, **(extra or {}), "Content-Length": str(len(http))}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return gzip.compress(f"WARC/1.1\r\n{lines}\r\n".encode() + http + b"\r\n\r\n", mtime=0)


def parse_records(source: bytes | io.IOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of each record of a file, gzipped by member or plain; one record is in memory at a time."""
    raw = io.BufferedReader(io.BytesIO(source) if isinstance(source, bytes) else source)
    stream = io.BufferedReader(gzip.GzipFile(fileobj=raw)) if raw.peek(2)[:2] == b"\x1f\x8b" else raw
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record starts with {line[:40]!r}")
        fields = {}
        while (line := stream.readline().strip()):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        yield fields, stream.read(int(fields.get("content-length", 0)))


def http_headers(head: bytes) -> dict[str, str]:
    """Fields in lower case; the values of a field that is there several times are joined by commas (RFC 9110, 5.3)."""
    out: dict[str, str] = {}
    for line in head.decode("latin-1").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        if name := name.strip().lower():
            out[name] = f"{out[name]}, {value.strip()}" if name in out else value.strip()
    return out


def _opened(path: str) -> io.IOBase:
    """A file as a stream: local, or of a store that pyarrow knows."""
    if path.startswith("file:") or "://" not in path:
        from urllib.parse import unquote, urlparse

        return open(unquote(urlparse(path).path), "rb")
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def _epoch(date: str) -> int:
    from datetime import datetime

    return int(datetime.fromisoformat(date.replace("Z", "+00:00")).timestamp())


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records (RECORD and body) of the WARC files under ``path``; ids are by file and place.

    Spark lists the files, and each is read as a stream, record by record, so that a file may have any size.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with _opened(name) as file:
                    for at, (fields, block) in enumerate(parse_records(file)):
                        if fields.get("warc-type") not in ("response", "revisit"):
                            continue
                        head, _, body = block.partition(b"\r\n\r\n")
                        headers = http_headers(head)
                        yield pa.RecordBatch.from_pylist(
                            [
                                {
                                    "file": name, "at": at, "url": fields.get("warc-target-uri"), "time": _epoch(fields["warc-date"]), "kind": fields["warc-type"],
                                    "etag": headers.get("etag"), "last_modified": headers.get("last-modified"), "digest": fields.get("warc-payload-digest"),
                                    "headers": list(headers.items()), "body": body,
                                }
                            ],
                            schema=_arrow,
                        )

    text, number = pa.string(), pa.int64()
    _arrow = pa.schema(
        [("file", text), ("at", number), ("url", text), ("time", number), ("kind", text), ("etag", text), ("last_modified", text), ("digest", text), ("headers", pa.map_(text, text)), ("body", pa.binary())]
    )
    schema = "file string, at long, url string, time long, kind string, etag string, last_modified string, digest string, headers map<string,string>, body binary"
    files = spark.read.format("binaryFile").load(path).select("path")
    files = files.repartition(max(1, min(files.count(), 10_000)))
    made = files.mapInArrow(rows, schema)
    return made.withColumn("id", F.xxhash64("file", "at")).drop("file", "at")
