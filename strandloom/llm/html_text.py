"""Main text of HTML pages by nearest-URL page differencing.

A page becomes lines: the texts of its blocks, in page order, with character references decoded and
white space folded. Pages of one host are sorted by url path; each is paired with the neighbour
whose path shares the longer beginning. The two pages' lines are aligned by a longest common
subsequence, and lines that both have are template and are deleted, in and out of an article. Only a
passage of running text (``p``, ``blockquote``, ``pre``) or a title (``h1``) in an ``article`` or ``main``
stays: an article may quote a passage that its neighbour quotes too, and pages that are nearly copies
have one title.

Differencing alone keeps what is boilerplate but differs from page to page (an advert, a footer
with the host's name), so markup that says what it is counts as well: ``nav``, ``aside``,
``footer``, ``form``, scripts, styles, elements whose class, id or role name a menu, advert, notice
or reader comments. What merely stands outside an article stays unless it is shared or so named. Elements around all
articles of a page never drop the largest of them.

The pages are parsed twice, which is cheaper than keeping their lines. The pairing is a range sort of (host, path, row) over the whole cluster, so
a host with a third of all pages is split like any other; a pair over a partition's edge is made
from one row a partition. The pairing moves hashes of lines only; texts move once, to their template. Null and empty pages have an empty text; null
urls are a host of their own; repeated urls are each other's neighbours. Of two neighbours as near the one before is taken; equal
rows are one page in the pairing and a result row each. Very long pages are aligned in bounded memory. Extra columns come back
but for ``text`` and ``n_shared``, whose names the result needs. An empty table gives an empty one.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import cut, free_name, shuffle_partitions
from .urls import host_of, path_of

# Element names of HTML, and usual names of page parts.
RAW = {"script", "style", "noscript", "template", "iframe", "textarea", "title", "svg", "object", "canvas", "math"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
MAIN = {"article", "main"}
#: Elements that a part of a class, as in site-footer, may name; all others it names as a whole word.
CONTAINERS = {"div", "section", "ul", "ol", "dl", "table", "span"}
PASSAGES = {"h1", "p", "blockquote", "pre"}
#: Where a line stands.
OUTSIDE, IN_ARTICLE, IN_PASSAGE = 0, 1, 2
DROPPED = {"head", "header", "nav", "aside", "footer", "form", "button", "select", "dialog", "menu"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar"}
PARTS = {"ad", "ads", "advert", "advertisement", "adverts", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disqus", "footer", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "popup", "promo", "related", "replies", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget"}

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<![^>]*(?:>|$)|<\?[^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: Elements that one of the same kind closes where it is open in the same container.
CLOSED_BY_NEXT = {"p", "li", "dt", "dd", "tr", "td", "th", "option"}


def _names_a_part(name: str, attributes: str) -> bool:
    for kind, *values in ATTRIBUTE.findall(attributes):
        for value in next((v for v in values if v), "").lower().split():
            if kind.lower() == "role":
                if value in ROLES:
                    return True
            elif value in PARTS or name in CONTAINERS and not PARTS.isdisjoint(re.split(r"[^a-z]+", value)):
                return True
    return False


def lines_of(page: str | None) -> list[tuple[str, int, bool]]:
    """(line, where it stands, dropped by its markup) of one page, in page order.

    Elements that hold every article of the page don't drop the one with the most text, whatever they are
    called: a page's layout may be a form, or named for the sidebar that stands in it.
    """
    page = page or ""
    out: list[tuple[str, int, tuple[int, ...]]] = []
    text: list[str] = []
    stack: list[tuple[str, int, tuple[int, ...], int]] = []  # element, where it stands, the dropping elements around it, its article
    mains: list[list] = []  # of each outermost article: the dropping elements around it, its characters
    at, inside, causes, main, dropping = 0, OUTSIDE, (), -1, 0

    def flush() -> None:
        line = " ".join("".join(text).split())
        text.clear()
        if line:
            out.append((line, inside, causes))
            if main >= 0 and causes == mains[main][0]:
                mains[main][1] += len(line)

    while at < len(page):
        found = TOKEN.search(page, at)
        end = found.start() if found else len(page)
        if end > at:
            text.append(html.unescape(page[at:end]))
        if not found:
            break
        at = found.end()
        name = (found[2] or "").lower()
        if not name:
            continue
        if name not in INLINE:
            flush()
        if found[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
        elif name in RAW:
            closing = re.compile(rf"</{name}\b[^>]*(?:>|$)", re.I).search(page, at)
            at = closing.end() if closing else len(page) if name in ("script", "style") else at
        elif name not in VOID and not found[3].rstrip().endswith("/"):
            if name in CLOSED_BY_NEXT:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        del stack[k:]
                        break
                    if stack[k][0] in MAIN or stack[k][0] in ("div", "section", "ul", "ol", "table", "tbody", "blockquote", "body"):
                        break
            _, inside, causes, main = stack[-1] if stack else ("", OUTSIDE, (), -1)
            if name in DROPPED or name not in ("html", "body") and _names_a_part(name, found[3]):
                dropping += 1
                causes = (*causes, dropping)
            if name in MAIN and main < 0:
                main = len(mains)
                mains.append([causes, 0])
            where = IN_PASSAGE if inside and name in PASSAGES else max(inside, IN_ARTICLE if name in MAIN else OUTSIDE)
            stack.append((name, where, causes, main))
        _, inside, causes, main = stack[-1] if stack else ("", OUTSIDE, (), -1)
    flush()
    spared = set(max(mains, key=lambda m: m[1])[0]) if mains and all(m[0] for m in mains) else set()
    return [(line, where, not spared.issuperset(around)) for line, where, around in out]


def line_hash(line: str) -> int:
    """32 bits: lines are compared with one other page's lines only."""
    return zlib.crc32(line.encode("utf-8", "surrogatepass")) - (1 << 31)


#: Bits of an alignment's table that are kept; larger ones are halved (Hirschberg, 1975).
MOST_TABLE = 1 << 25


def _rows(mine: list[int], other: list[int]) -> Iterator[int]:
    """After each of ``mine``: an integer whose zero bits are the places of ``other`` at which the longest common subsequence grows (Hyyroe, 2004)."""
    at: dict[int, int] = {}
    for j, value in enumerate(other):
        at.setdefault(value, []).append(j)
    masks = {}
    for value in set(mine) & at.keys():
        bits = np.zeros(len(other), dtype=np.uint8)
        bits[at[value]] = 1
        masks[value] = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
    full = (1 << len(other)) - 1
    row = full
    for value in mine:
        if mask := masks.get(value):
            both = row & mask
            row = (row + both | row - both) & full
        yield row


def _lengths(mine: list[int], other: list[int]) -> np.ndarray:
    """The longest common subsequence's length of ``mine`` with every beginning of ``other``."""
    row = (1 << len(other)) - 1
    for row in _rows(mine, other):  # noqa: B007  the last
        pass
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(other) // 8 + 1, "little"), dtype=np.uint8), bitorder="little")
    return np.concatenate([[0], np.cumsum(1 - bits[: len(other)].astype(np.int64))])


def _aligned(mine: list[int], other: list[int], first: int) -> list[int]:
    if not mine or not other:
        return []
    if len(mine) > 1 and len(mine) * len(other) > MOST_TABLE:
        half = len(mine) // 2
        ahead = _lengths(mine[:half], other)
        behind = _lengths(mine[:half - 1 if half else None:-1], other[::-1])[::-1]
        cut_ = int((ahead + behind).argmax())
        return _aligned(mine[:half], other[:cut_], first) + _aligned(mine[half:], other[cut_:], first + half)
    rows, out = list(_rows(mine, other)), []
    i, j = len(mine), len(other)
    while i and j:
        if rows[i - 1] >> j - 1 & 1:
            j -= 1
            continue
        i -= 1
        if not i or rows[i - 1] >> j - 1 & 1:  # what grows here doesn't in the row before: a match
            out.append(first + i)
            j -= 1
    return out[::-1]


def shared(mine: list[int], other: list[int]) -> list[int]:
    """Places in ``mine`` of a longest common subsequence with ``other``.

    Bits of whole rows are handled at once, and a large table is halved, so that pages of many equal lines take no
    more than those of unlike ones, and memory is bounded. Of several such subsequences any one is taken.
    """
    start = 0
    while start < min(len(mine), len(other)) and mine[start] == other[start]:
        start += 1
    end = 0
    while end < min(len(mine), len(other)) - start and mine[-1 - end] == other[-1 - end]:
        end += 1
    known = set(other[start : len(other) - end])
    places = [k for k in range(start, len(mine) - end) if mine[k] in known]
    wanted = {mine[k] for k in places}
    left = [x for x in other[start : len(other) - end] if x in wanted]
    middle = [places[k] for k in _aligned([mine[k] for k in places], left, 0)]
    return [*range(start), *middle, *range(len(mine) - end, len(mine))]


#: Place of what stays whatever the neighbour has.
STAYS = -1
_PARTS = T.ArrayType(T.StructType([T.StructField("line", T.StringType()), T.StructField("place", T.IntegerType())]))


def parts_of(page: str | None) -> list[tuple[str, int]]:
    """The lines that their markup doesn't drop, with their places; passages of an article that follow each other as one."""
    out: list[tuple[str, int]] = []
    passages: list[str] = []
    for k, (line, where, dropped) in enumerate(lines_of(page)):
        if dropped:
            continue
        if where == IN_PASSAGE:
            passages.append(line)
            continue
        if passages:
            out.append((" ".join(passages), STAYS))
            passages = []
        out.append((line, k))
    return [*out, (" ".join(passages), STAYS)] if passages else out


@F.pandas_udf(_PARTS)
def _parts_column(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for pages in batches:
        yield pd.Series([[{"line": line, "place": k} for line, k in parts_of(p)] for p in pages], dtype=object)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _hashes_column(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for pages in batches:
        yield pd.Series([[line_hash(a) for a, _, _ in lines_of(p)] for p in pages])


def _neighbours(row_type: T.DataType):
    """(schema, function): each row with the rows before and after it, where they are of its host."""
    schema = T.StructType(
        [T.StructField("pid", T.LongType())]
        + [T.StructField(c, row_type) for c in ("row", "before", "after")]
        + [T.StructField(c, T.StringType()) for c in ("host", "path", "path_before", "path_after")]
    )
    arrow = to_arrow_schema(schema)

    def made(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [()] * 8
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], names=arrow.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        before = now = None
        for batch in batches:
            out = []
            for after in zip(*(batch.column(c).to_pylist() for c in ("host", "path", "row"))):
                if now:
                    out.append(_joined(pid, before, now, after))
                before, now = now, after
            yield made(out)
        if now:
            yield made([_joined(pid, before, now, None)])

    return schema, run


def _joined(pid: int, before: tuple | None, now: tuple, after: tuple | None) -> tuple:
    host, path, row = now
    before = before if before and before[0] == host else (None, None, None)
    after = after if after and after[0] == host else (None, None, None)
    return pid, row, before[2], after[2], host, path, before[1], after[1]


def _common(a: pd.Series, b: pd.Series) -> list[int]:
    out = []
    for x, y in zip(a, b):
        if not isinstance(y, str):
            out.append(-1)
            continue
        n = min(len(x), len(y))
        out.append(next((k for k in range(n) if x[k] != y[k]), n))
    return out


@F.pandas_udf(T.BooleanType())
def _first_is_nearer(path: pd.Series, path_before: pd.Series, path_after: pd.Series) -> pd.Series:
    return pd.Series(np.array(_common(path, path_before)) >= np.array(_common(path, path_after)))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _template(mine: pd.Series, other: pd.Series) -> pd.Series:
    """Shared places; none where all are: a page's copy tells nothing about its template."""
    out = []
    for a, b in zip(mine, other):
        places = shared([int(x) for x in a], [int(x) for x in b])
        out.append([] if len(places) == len(a) else places)
    return pd.Series(out)


def partners(keys: DataFrame) -> DataFrame:
    """(row, partner) for every row of ``keys`` (host, path, row; distinct) whose host has another."""
    spark = keys.sparkSession
    ordered = keys.repartitionByRange(shuffle_partitions(spark), "host", "path", "row").sortWithinPartitions("host", "path", "row")
    kind = keys.schema["row"].dataType
    schema, run = _neighbours(kind)
    near = cut(ordered.select("host", "path", "row").mapInArrow(run, schema))
    ends = near.groupBy("pid").agg(
        F.min(F.struct("host", "path", "row")).alias("first"), F.max(F.struct("host", "path", "row")).alias("last")
    )
    listed = sorted(ends.collect(), key=lambda e: e["pid"])  # a row a partition
    edges = []
    for a, b in zip(listed, listed[1:]):
        if a["last"]["host"] == b["first"]["host"]:
            edges.append((a["last"]["row"], None, None, b["first"]["row"], b["first"]["path"]))
            edges.append((b["first"]["row"], a["last"]["row"], a["last"]["path"], None, None))
    name = kind.simpleString()
    over = spark.createDataFrame(edges, f"row {name}, b {name}, pb string, a {name}, pa string").groupBy("row").agg(*[F.max(c).alias(c) for c in ("b", "pb", "a", "pa")])
    joined = near.join(F.broadcast(over), "row", "left")
    first = _first_is_nearer("path", F.coalesce("path_before", "pb"), F.coalesce("path_after", "pa"))
    pairs = joined.select("row", F.when(first, F.coalesce("before", "b")).otherwise(F.coalesce("after", "a")).alias("partner"))
    return pairs.where("partner is not null")


def extract(pages: DataFrame, url_column: str = "url", html_column: str = "html", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``pages`` (all but the html by default) with ``text``, the main text, and
    ``n_shared``, the number of its lines that its neighbour has too.

    A page is known by a digest of its url and html, so equal rows are one page in the pairing.
    """
    keep = [c for c in pages.columns if c != html_column] if keep is None else keep
    keep = [c for c in keep if c.lower() not in ("text", "n_shared")]
    key, lines, common = (free_name(pages, x) for x in ("key", "lines", "common"))
    url = F.coalesce(F.col(url_column).cast("string"), F.lit(""))
    page = F.coalesce(F.col(html_column).cast("string"), F.lit(""))
    digest = F.unhex(F.md5(F.concat(url, F.lit("\x00"), page)))
    hashed = pages.select(digest.alias("row"), host_of(url).alias("host"), path_of(url).alias("path"), _hashes_column(page).alias("hashes"))
    known = cut(hashed.groupBy("row").agg(*[F.first(c).alias(c) for c in ("host", "path", "hashes")]))
    pairs = partners(known.select("host", "path", "row"))
    other = known.select(F.col("row").alias("partner"), F.col("hashes").alias("others"))
    template = pairs.join(known.select("row", "hashes"), "row").join(other, "partner")
    template = template.select(F.col("row").alias(key), _template("hashes", "others").alias(common))
    joined = pages.select(*keep, digest.alias(key), _parts_column(page).alias(lines)).join(template, key, "left")
    places = F.coalesce(F.col(common), F.array().cast("array<int>"))
    rest = F.filter(F.col(lines), lambda x: ~F.array_contains(places, x["place"]))
    text = F.array_join(F.transform(rest, lambda x: x["line"]), " ")
    return joined.select(*keep, text.alias("text"), F.size(places).cast("long").alias("n_shared"))
