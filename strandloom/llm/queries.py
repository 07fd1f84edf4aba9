"""One query per operator, over the whole table it is meant for, and SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html_text, packing, quality, secrets, simhash, toxicity, urls, vectors, warc
from .common import table

#: The rules that the url query judges by.
URL_RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]
QUALITY_THRESHOLD = 0.3


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    chain = toxicity.train(docs, table(spark, sf_dir, "labels"), ["toxic"])
    found, name = toxicity.classify(docs.select("doc_id", "text"), chain)
    p = F.col(f"{name}.probabilities")
    return found.select("doc_id", p[0].alias("p_varied"), p[1].alias("p_dense"), p[2].alias("score"), F.col(f"{name}.toxic").cast("int").alias("toxic"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id")
    )


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    rest = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5))
    voter = quality.train(docs, labels.where(rest != 0), "quality")
    scored = docs.select("doc_id", F.coalesce(rest == 0, F.lit(False)).alias("held_out"), quality.score_udf(voter)("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= QUALITY_THRESHOLD).cast("int"))


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vectors.near_duplicates(table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_shared")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # The documents name no repository or owner; a source stands for an owner, its rows of one language for a repository.
    found, spans = secrets.scan(docs, owner=F.col("source"), repository=F.concat_ws("/", "source", "lang"), keep=["doc_id"])

    def count(kind: str):
        return F.size(F.filter(spans, lambda s: s["kind"] == secrets.KINDS.index(kind))).cast("long").alias(f"n_{kind}")

    base = F.filter(spans, lambda s: s["kind"] < len(secrets.KINDS))
    return found.select(
        "doc_id", *map(count, secrets.KINDS), F.sha2(secrets.span_text(base), 256).alias("base_sha256"), secrets.span_text(F.col(spans)).alias("spans"),
        F.size(F.filter(spans, lambda s: s["live"])).cast("long").alias("n_live"), secrets.class_text(F.col(spans)).alias("classes"),
    )


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


def warc_records(pages: DataFrame) -> DataFrame:
    """Captures that stand for each page: a response (but for every fifth page) and later a revisit.

    Pages come in order of their id. Every seventh revisit claims another ETag than the response.
    """
    tag = F.md5(F.coalesce("html", F.lit("")))
    date = F.concat(F.lit("day "), F.col("page_id").cast("string"))
    n = F.length(F.coalesce("html", F.lit(""))).cast("string")
    response = pages.where("page_id % 5 <> 0 or page_id is null").select(
        (F.col("page_id") * 2).alias("id"), "url", (F.col("page_id") * 10).alias("time"), F.lit("response").alias("kind"), tag.alias("etag"), date.alias("last_modified"), tag.alias("digest"),
        F.create_map(F.lit("etag"), tag, F.lit("date"), date, F.lit("content-length"), n, F.lit("cache-control"), F.lit("max-age=60")).alias("headers"),
    )
    own = F.when(F.col("page_id") % 7 == 0, F.lit("other")).otherwise(tag)
    revisit = pages.select(
        (F.col("page_id") * 2 + 1).alias("id"), "url", (F.col("page_id") * 10 + 5).alias("time"), F.lit("revisit").alias("kind"), own.alias("etag"), F.lit(None).cast("string").alias("last_modified"), F.lit(None).cast("string").alias("digest"),
        F.create_map(F.lit("etag"), own, F.lit("date"), F.concat(date, F.lit(" again")), F.lit("content-length"), F.lit("0"), F.lit("expires"), F.lit("never")).alias("headers"),
    )
    return response.union(revisit)


def op10_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.resolve_revisits(warc_records(table(spark, sf_dir, "pages")))
    names = {"h_etag": "etag", "h_date": "date", "h_content_length": "content-length", "h_cache_control": "cache-control", "h_expires": "expires"}
    headers = [F.try_element_at(F.col("headers"), F.lit(v)).alias(k) for k, v in names.items()]
    return found.select("id", "time", "kind", "canonical", "source_id", "status", *headers)


QUERIES = {
    f.__name__: f
    for f in (op1_decontaminate, op2_pack, op3_toxicity, op4_simhash, op5_quality, op6_embeddings, op7_html, op8_secrets, op9_urls, op10_revisits)
}

_URL = """
parts as (select *, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
cut_ as (select *, regexp_extract(rest, '^[^/?#]*') as raw_host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from parts)
"""

_SECRET_KINDS = {
    "assign": (r"""(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 1, "length(v) >= 6"),
    "access": (r"(AKIA[A-Z0-9]+)", 1, "length(v) >= 20"),
    "hex": (r"([0-9a-f]{24,})", 1, "length(v) >= 24"),
    "token": (r"([A-Za-z0-9+/_=-]{20,})", 1, "regexp_matches(v, '[a-z]') and regexp_matches(v, '[A-Z]') and regexp_matches(v, '[0-9]')"),
}


def _secret_sql() -> str:
    parts = " union all ".join(
        f"""select rn, doc_id, source, lang, {k} as kind, unnest(range(1, len(w) + 1)) as i, w, g, regexp_extract_all(t, '{p}', {n}) as vs
        from (select *, regexp_extract_all(t, '{p}', 0) as w, string_split_regex(t, '{p}') as g from docs) where len(w) > 0"""
        for k, (p, n, _) in enumerate(_SECRET_KINDS.values())
    )
    tests = " ".join(f"when {k} then {c}" for k, (_, _, c) in enumerate(_SECRET_KINDS.values()))
    return f"""
with docs as (select row_number() over () as rn, doc_id, source, lang, coalesce(text, '') as t from documents),
found as ({parts}),
placed as (
  select rn, doc_id, source, lang, kind, vs[i] as v,
    cast(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(w[1:i - 1], lambda x: length(x))), 0) as bigint) as s,
    length(w[i]) as n
  from found),
kept as (select *, s + n as e from placed where case kind {tests} end),
owned as (
  select v, count(distinct source) as owners, count(distinct concat_ws('/', source, lang)) as repositories,
    count(distinct source) <= {secrets.MOST_OWNERS} and count(distinct concat_ws('/', source, lang)) <= {secrets.MOST_REPOSITORIES} as live
  from kept group by v),
reported as (
  select k.*, o.live, o.owners, o.repositories from kept k join owned o on o.v = k.v
  where kind < 3 or (o.live and not exists (select 1 from kept b where b.rn = k.rn and b.kind < 3 and b.s < k.e and k.s < b.e))),
lists as (
  select rn, count(*) filter (kind = 0) as n_assign, count(*) filter (kind = 1) as n_access, count(*) filter (kind = 2) as n_hex,
    string_agg(['assign', 'access', 'hex', 'token'][kind + 1] || ':' || s || ':' || e, ',' order by s, kind) filter (kind < 3) as base,
    string_agg(['assign', 'access', 'hex', 'token'][kind + 1] || ':' || s || ':' || e, ',' order by s, kind) as spans,
    count(*) filter (live) as n_live, string_agg(case when live then 'live' else 'copied' end || ':' || owners || ':' || repositories, ',' order by s, kind) as classes
  from reported group by rn)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans,
  coalesce(n_live, 0) as n_live, coalesce(classes, '') as classes
from docs left join lists using (rn)
"""


_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)

ORACLES = {
    "op6_embeddings": """
with recursive v as (
  select vec_id, label, cast(embedding as double[]) as e from embeddings),
u as (
  select vec_id, label, e, sqrt(list_dot_product(e, e)) as n from v
  where label is not null and e is not null and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
links as (
  select a.vec_id as a, b.vec_id as b from u a join u b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.93),
reach(a, b) as (select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a),
counts as (select a, count(*) as n from links group by a),
least_ as (select a, min(b) as m from reach group by a)
select vec_id, coalesce(n, 0) as n_links, least(vec_id, coalesce(m, vec_id)) as component_id, vec_id = least(vec_id, coalesce(m, vec_id)) as kept
from embeddings left join counts c on c.a = vec_id left join least_ l on l.a = vec_id
""",
    "op8_secrets": _secret_sql(),
    "op9_urls": f"""
with {_URL},
judged as (
  select page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, path from cut_),
rules(rh, rp, v) as (values {_RULES}),
fits as (
  select j.*, rh, rp, v, row_number() over (partition by page_id order by length(rh || rp) desc nulls last, length(rh) desc) as k
  from judged j left join rules on (host = rh or suffix(host, '.' || rh)) and starts_with(path, rp))
select page_id, host, path, rh || rp as rule, coalesce(v, 'allow') as verdict from fits where k = 1
""",
    "op10_revisits": r"""
with r as (
  select *, md5(coalesce(html, '')) as tag, cast(length(coalesce(html, '')) as varchar) as n, 'day ' || page_id as d,
    regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '#.*$', '') as rest from pages),
c as (
  select *, regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), '^.*@', ''), ':(80|443)$', ''), '^www\.', '')
    || regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '')
    || case when q = '' then '' else '?' || q end as canonical
  from (select *, array_to_string(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'),
    lambda p: p <> '' and not regexp_matches(p, '^(utm_[a-z]+|ref|fbclid|gclid)(=|$)')), '&') as q from r)),
resp as (select page_id * 2 as id, page_id * 10 as time, canonical, tag, d, n from c where page_id % 5 <> 0),
rev as (select page_id * 2 + 1 as id, page_id * 10 + 5 as time, canonical, case when page_id % 7 = 0 then 'other' else tag end as tag, d from c),
matched as (
  select v.*, s.id as sid, s.tag as stag, s.n as sn from rev v asof left join resp s on v.canonical = s.canonical and v.time >= s.time)
select id, time, 'response' as kind, canonical, cast(null as bigint) as source_id, 'response' as status, tag as h_etag, d as h_date,
  n as h_content_length, 'max-age=60' as h_cache_control, cast(null as varchar) as h_expires from resp
union all
select id, time, 'revisit', canonical, case when stag = tag then sid end, case when sid is null then 'missing' when stag = tag then 'resolved' else 'changed' end,
  tag, d || ' again', case when stag = tag then sn else '0' end, case when stag = tag then 'max-age=60' end, 'never' from matched
""",
}
