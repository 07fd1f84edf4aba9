import random

import pytest
from pyspark.sql import functions as F

from strandloom.llm import warc


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("HTTP://www.Example.com:80/a/?utm_source=x&b=1#f", "example.com/a?b=1"),
        ("https://user@h.org", "h.org"),
        ("https://h.org/?ref=x", "h.org"),
        ("h.org/A/b.html", "h.org/A/b.html"),
        ("", ""),
    ],
)
def test_canonical(spark, url, want):
    assert spark.range(1).select(warc.canonical_url(F.lit(url))).first()[0] == want


def slow(records):
    def canon(u):
        return u and u.split("://")[-1].rstrip("/")

    out = {}
    for r in records:
        k, u, t, kind, etag, modified, digest, headers = r
        if kind == "response":
            out[k] = ("response", None, headers)
            continue
        earlier = [x for x in records if x[3] == "response" and u is not None and canon(x[1]) == canon(u) and (x[2], x[0]) < (t, k)]
        if not earlier:
            out[k] = ("missing", None, headers)
            continue
        best = max(earlier, key=lambda x: (x[2], x[0]))
        pairs = [(a, b) for a, b in ((digest, best[6]), (etag, best[4]), (modified, best[5])) if a is not None and b is not None]
        same = [a.removeprefix("W/") == b.removeprefix("W/") for a, b in pairs]
        status = "unchecked" if not pairs else "resolved" if all(same) else "changed"
        merged = {**best[7], **{a: b for a, b in (headers or {}).items() if a not in warc.BODY_HEADERS}}
        out[k] = (status, best[0] if status == "resolved" else None, merged if status == "resolved" else headers)
    return out


def made(n, seed):
    rnd = random.Random(seed)
    rows = []
    for k in range(n):
        tag = rnd.choice([None, '"1"', 'W/"1"', '"2"'])
        rows.append((k, rnd.choice(["http://hot.org/", "https://hot.org", "http://b.org/x", f"http://c.org/{k % 9}", None]), rnd.randrange(0, 40), rnd.choice(["response", "revisit", "revisit"]),
                     tag, rnd.choice([None, "Mon"]), rnd.choice([None, "sha1:A", "sha1:B"]), rnd.choice([{"etag": "x", "content-length": "5"}, {"date": str(k), "content-type": "t"}])))
    return rows


@pytest.mark.parametrize("seed", [0, 1])
def test_against_a_plain_search(spark, seed):
    rows = made(250, seed)
    records = spark.createDataFrame(rows, warc.RECORD).withColumn("status", F.lit(1)).withColumn("row", F.lit(2)).withColumn("body", F.lit(b"x"))
    found = warc.resolve_revisits(records)
    assert {"body", "row"} <= set(found.columns)
    assert {r["id"]: (r["status"], r["source_id"], r["headers"]) for r in found.collect()} == slow(rows)


def test_odd_rows(spark):
    rows = [(1, None, None, "revisit", None, None, None, None), (2, "", 1, "response", None, None, None, None), (2, "", 1, "response", None, None, None, None), (3, "", 2, "revisit", None, None, "d", None)]
    got = [(r["id"], r["status"]) for r in warc.resolve_revisits(spark.createDataFrame(rows, warc.RECORD)).collect()]
    assert sorted(got) == [(1, "missing"), (2, "response"), (2, "response"), (3, "unchecked")]
    assert warc.resolve_revisits(spark.createDataFrame([], warc.RECORD)).count() == 0


def test_files_round_trip(spark, tmp_path):
    body = b"HTTP/1.1 200 OK\r\nETag: \"1\"\r\nContent-Type: text/html\r\n\r\n<p>\r\n\r\nx"
    again = b"HTTP/1.1 304 Not Modified\r\nETag: \"1\"\r\nCache-Control: max-age=1\r\n\r\n"
    content = warc.write_record("warcinfo", "", "2024-01-01T00:00:00Z", b"x") + warc.write_record("response", "http://a.org/", "2024-01-01T00:00:00Z", body, {"WARC-Payload-Digest": "sha1:A"}) + warc.write_record("revisit", "https://a.org", "2024-01-02T00:00:00Z", again)
    (tmp_path / "one.warc.gz").write_bytes(content)
    (tmp_path / "bad.warc.gz").write_bytes(b"")
    records = warc.read_warc(spark, str(tmp_path))
    got = {r["kind"]: r for r in warc.resolve_revisits(records).collect()}
    assert got["revisit"]["status"] == "resolved" and got["response"]["body"] == b"<p>\r\n\r\nx"
    assert got["revisit"]["headers"] == {"etag": '"1"', "content-type": "text/html", "cache-control": "max-age=1"}


@pytest.mark.parametrize("name", ["stored_id", "source", "row", "n", "c0", "stored_headers", "handed", "Canonical_", "pid"])
def test_names_that_are_used_inside_come_back(spark, name):
    rows = made(40, 3)
    records = spark.createDataFrame(rows, warc.RECORD).withColumn(name, F.concat(F.lit("x"), F.col("id").cast("string")))
    found = {r["id"]: (r["status"], r["source_id"], r["headers"], r[name]) for r in warc.resolve_revisits(records).collect()}
    assert found == {k: (*v, f"x{k}") for k, v in slow(rows).items()}


def test_a_response_that_most_revisits_name(spark, monkeypatch):
    monkeypatch.setattr("strandloom.llm.common.LEAST_HOT", 10)
    rows = [(0, "http://hot.org/", 0, "response", "t", None, None, {"a": "b"})] + [(k, "http://hot.org/", k, "revisit", "t", None, None, None) for k in range(1, 300)]
    found = warc.resolve_revisits(spark.createDataFrame(rows, warc.RECORD)).where("source_id = 0 and headers['a'] = 'b'")
    assert found.count() == 299


def test_repeated_http_headers_are_joined():
    assert warc.http_headers(b"HTTP/1.1 200 OK\r\nVia: a\r\nX: 1\r\nvia: b") == {"via": "a, b", "x": "1"}
