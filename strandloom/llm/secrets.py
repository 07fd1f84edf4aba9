r"""Secret scan by corpus-wide ownership frequency, in DataFrame and SQL functions only.

Three kinds of candidates are found in whole texts, leftmost and non-overlapping per kind:

* ``assign``: a keyword, ``:`` or ``=``, and a value of 6 or more characters;
* ``access``: ``AKIA`` and capitals or digits, 20 or more characters;
* ``hex``: 24 or more hexadecimal digits.

A fourth, ``token``, has any run of 20 or more characters of a value that mixes lower case,
capitals and digits. Every candidate's value is hashed, and the corpus is asked how many distinct
owners and repositories hold that hash: one with many is a copied example, one with few is
specific to its owner and looks live. A ``token`` is reported only if it looks live and no span of
another kind covers it; the other kinds are always reported. Each reported span has its class and its numbers of owners and repositories.

Spans are in code points, end exclusive. Spark has no function for positions of all matches; here
they follow from the lengths of the matches and of the texts between them (``split`` by the same
pattern), as running sums that are made in blocks, so that a very long text of many matches takes time in proportion. Null and
empty texts have no spans. Null owners and repositories aren't counted, and a
candidate that only rows without an owner hold counts as live. Spans of two kinds that begin together come in the order of the
kinds. Repeated rows and ids: a result row for each row. Extra columns come back as they are, whatever their names: columns of the
input are never read by name beyond those given. An empty table gives an empty one. One value may be in any share of
all rows: its rows are dealt over tasks where they meet its counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, free_name, spread_join, text_or_empty

KINDS = ("assign", "access", "hex")
#: pattern, group of the value, least length of the value. Java's patterns; runs of a character class are maximal.
PATTERNS = {
    "assign": (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    "access": (r"(AKIA[A-Z0-9]{16,})", 1, 20),
    "hex": (r"([0-9a-f]{24,})", 1, 24),
    "token": (r"([A-Za-z0-9+/_=-]{20,})", 1, 20),
}
#: A value that more owners or repositories than these hold is a copied example.
MOST_OWNERS = 2
MOST_REPOSITORIES = 3
#: Values of a running total that are made together.
RUN = 128


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _blocks(values: Column) -> Column:
    """``values`` in arrays of at most RUN."""

    def cut_(v: Column) -> Column:
        count = F.ceil(F.size(v) / F.lit(RUN)).cast("int")
        return F.transform(F.filter(F.sequence(F.lit(0), count), lambda k: k < count), lambda k: F.slice(v, k * RUN + 1, F.lit(RUN)))

    return _let(values, cut_)


def running(values: Column, add) -> Column:
    """array<int>: ``add`` of each of ``values`` (array<int>, none negative) with all before it, from 0.

    Blocks have their totals, these are added up, and each block goes on from what is before it.
    """
    zero = F.lit(0)
    after = lambda out, v: F.concat(out, F.array(add(F.element_at(out, -1), v)))

    def whole(parts: Column) -> Column:
        before = F.aggregate(F.transform(parts, lambda b: F.aggregate(b, zero, add)), F.array(zero), after)
        rows = F.arrays_zip(parts.alias("part"), F.slice(before, F.lit(1), F.size(parts)).alias("before"))
        return F.flatten(F.transform(rows, lambda r: F.slice(F.aggregate(r["part"], F.array(r["before"]), after), F.lit(2), F.lit(RUN))))

    return F.when(F.size(values) > 0, _let(_blocks(values), whole)).otherwise(F.array().cast("array<int>"))


def spans_of(text: Column, kind: str) -> Column:
    """array<struct<start, kind, end, value>> of one kind, in text order; positions in code points."""
    pattern, group, least = PATTERNS[kind]
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    between = F.split(text, pattern, -1)
    sizes = F.transform(F.arrays_zip(whole.alias("whole"), values.alias("value"), F.slice(between, F.lit(1), F.size(whole)).alias("gap")), lambda m: F.struct(m["value"].alias("value"), F.length(m["whole"]).alias("size"), F.length(m["gap"]).alias("gap")))
    empty = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")
    order = list(PATTERNS).index(kind)

    def counts(value: Column) -> Column:
        long = F.length(value) >= least
        return long & value.rlike("[a-z]") & value.rlike("[A-Z]") & value.rlike("[0-9]") if kind == "token" else long

    def placed(found: Column) -> Column:
        ends = running(F.transform(found, lambda m: m["gap"] + m["size"]), lambda x, y: x + y)
        kept = F.filter(F.arrays_zip(found.alias("m"), ends.alias("end")), lambda r: counts(r["m"]["value"]))
        return F.transform(kept, lambda r: F.struct((r["end"] - r["m"]["size"]).alias("start"), F.lit(order).alias("kind"), r["end"].alias("end"), r["m"]["value"].alias("value")))

    return F.when(text.rlike(pattern), _let(sizes, placed)).otherwise(empty)


def candidates(text: Column) -> Column:
    """All kinds' spans of one text, by start and kind."""
    return F.transform(
        F.sort_array(F.concat(*[spans_of(text, k) for k in PATTERNS])),
        lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.sha2(s["value"], 256).alias("hash")),
    )


def ownership(found: DataFrame, most_owners: int = MOST_OWNERS, most_repositories: int = MOST_REPOSITORIES) -> DataFrame:
    """(hash, owners, repositories, n, live): distinct owners and repositories, and all candidates, by candidate hash.

    Distinct pairs first: a value's copies are gone before its hash meets another's.
    """
    pairs = found.groupBy("hash", "owner", "repository").agg(F.count("*").alias("n"))
    counts = pairs.groupBy("hash").agg(F.countDistinct("owner").alias("owners"), F.countDistinct("repository").alias("repositories"), F.sum("n").alias("n"))
    live = (F.col("owners") <= most_owners) & (F.col("repositories") <= most_repositories)
    return counts.withColumn("live", live)


def scan(
    docs: DataFrame, text_column: str = "text", owner: Column | None = None, repository: Column | None = None, keep: list[str] | None = None
) -> tuple[DataFrame, str]:
    """The columns ``keep`` of ``docs`` (all by default) with ``spans``: array<struct<start, kind, end, live, owners,
    repositories>> by start and kind; and that column's name. kind: 0 assign, 1 access, 2 hex, 3 token.

    The texts are read once. The candidates are written with their rows' other columns, counted,
    classed, and come back to their rows by a number written with them.
    """
    owner = F.lit(None).cast("string") if owner is None else owner
    repository = owner if repository is None else repository
    keep = docs.columns if keep is None else keep
    row, spans, own, repo = (free_name(docs, x) for x in ("row", "spans", "owner", "repository"))
    table = cut(
        docs.select(
            *keep,
            F.monotonically_increasing_id().alias(row),
            owner.alias(own),
            repository.alias(repo),
            candidates(text_or_empty(F.col(text_column))).alias(spans),
        )
    )
    found = table.where(F.size(spans) > 0).select(
        F.col(row).alias("row"), F.col(own).alias("owner"), F.col(repo).alias("repository"), F.explode(spans).alias("s")
    ).select("row", "owner", "repository", "s.*")
    owned = cut(ownership(found))
    classed = spread_join(found, owned, "hash", "n", F.col("row")).select("row", F.struct("start", "kind", "end", "live", "owners", "repositories").alias("s"))
    lists = classed.groupBy("row").agg(F.sort_array(F.collect_list("s")).alias("list"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int,live:boolean,owners:bigint,repositories:bigint>>")
    joined = table.select(*keep, row).join(lists.select(F.col("row").alias(row), F.col("list").alias(spans)), row, "left")
    return joined.select(*keep, _reported(F.coalesce(F.col(spans), none)).alias(spans)), spans


def _reported(spans: Column) -> Column:
    """Without tokens that are copied examples or that a span of another kind covers."""
    own = F.filter(spans, lambda s: s["kind"] < len(KINDS))
    return F.filter(
        spans,
        lambda s: (s["kind"] < len(KINDS))
        | (s["live"] & ~F.exists(own, lambda o: (o["start"] < s["end"]) & (s["start"] < o["end"]))),
    )


def span_text(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in PATTERNS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def class_text(spans: Column) -> Column:
    """``live`` or ``copied`` and the numbers of owners and repositories of each span, in the order of ``span_text``."""
    each = lambda s: F.concat_ws(":", F.when(s["live"], "live").otherwise("copied"), s["owners"].cast("string"), s["repositories"].cast("string"))
    return F.array_join(F.transform(spans, each), ",")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with every run of overlapping spans replaced by ``mark``. Pieces are cut in blocks, each from its own part of the text."""

    def pieces(reach: Column) -> Column:
        """What stands before each run of spans, and after the last; ``reach``: the greatest end so far, with 0 before the first."""
        ends = F.slice(reach, F.lit(1), F.size(spans))
        runs = F.filter(F.arrays_zip(ends.alias("a"), F.transform(spans, lambda s: s["start"]).alias("b")), lambda p: p["b"] >= p["a"])
        last = F.array(F.struct(F.element_at(reach, -1).alias("a"), F.length(text).alias("b")))

        def cut_(block: Column) -> Column:
            first = F.element_at(block, 1)["a"]
            part = F.substring(text, first + 1, F.element_at(block, -1)["b"] - first)
            return _let(part, lambda t: F.transform(block, lambda p: F.substring(t, p["a"] - first + 1, p["b"] - p["a"])))

        return F.flatten(F.transform(_blocks(F.concat(runs, last)), cut_))

    reach = F.concat(F.array(F.lit(0)), running(F.transform(spans, lambda s: s["end"]), lambda x, y: F.greatest(x, y)))
    return F.when(F.size(spans) > 0, F.array_join(_let(reach, pieces), mark)).otherwise(text)


def redact_secrets(docs: DataFrame, text_column: str = "text", owner: Column | None = None, repository: Column | None = None) -> DataFrame:
    """``docs`` with its columns, the reported spans of its texts replaced; rows without any are unchanged."""
    columns = docs.columns
    found, spans = scan(docs, text_column, owner, repository)
    return found.withColumn(text_column, redact(F.col(text_column), F.col(spans))).select(*columns)
