"""Main text of pages by differencing with the nearest pages of the same host.

Pages are ordered by host, path, URL, page_id and content; a page's neighbours in that order, within its host, are its
nearest by URL path. Lines of both are aligned by a longest common subsequence (of 64-bit digests of lines), and lines
that a page shares with a neighbour are its template: they are deleted. Two rules keep that right:

- Neighbours that share more than `COPIES` of either one's unmarked text are copies of one page, and tell nothing of a
  template.
- Where markup names the article (`article`, or an element with that role), it is the text, and shared lines in it
  stay: articles quote, share passages and end in the same licence, and deleting those would lose text (of the given
  pages, one article in sixteen shares a line with its neighbour). Markup that names furniture (menus, footers,
  scripts, adverts, comments, ...) always takes it out, and lines outside the article go with it. Without an article
  the lines of `main` count, and without that all lines of the page, both less what is shared.

The order is cut into ranges by the pages' keys, a row for each range on the driver; pages go through one shuffle, as
lines, and a range's first and last page also go, as digests only, to the range before or after. So the result depends
on the order alone, never on where the ranges end, and a hot host has as many ranges as its pages need.

Defined cases: null html is empty and gives an empty text; pages without a URL or a host have no neighbours; rows equal
in page_id, URL and html get the same result each, and count once as neighbours; texts of any length are read whole (a
comparison's memory is bounded, its time is the product of both pages' shared lines, 64 at a time); an empty table gives
an empty result; further columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .page_lines import ARTICLE, FURNITURE, LOOSE, line_key, lines_of, shared

#: The part of its unmarked characters that a page shares with a copy.
COPIES = 0.8
OUT_CHARS = 4 << 20

ORIGIN = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#]*)"
KEY = ("host", "path", "url", "page_id", "digest")


def host_of(url: Column) -> Column:
    host = F.lower(F.regexp_extract(url, ORIGIN, 1))
    return F.when(host != "", host)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(url, ORIGIN, ""), r"^([^?#]*)", 1)


def keyed(pages: DataFrame) -> DataFrame:
    url, html = F.col("url").cast("string"), F.col("html").cast("string")
    return pages.select(host_of(url).alias("host"), path_of(url).alias("path"), url.alias("url"), F.col("page_id").cast("long").alias("page_id"), F.xxhash64(F.coalesce(html, F.lit("")), html.isNull()).alias("digest"), F.coalesce(html, F.lit("")).alias("html"))


def _order(row) -> tuple:
    """Nulls first; strings by code point, as Spark has them."""
    return tuple((v is not None, "" if v is None and i < 3 else 0 if v is None else v) for i, v in enumerate(row))


def ranges(rows: DataFrame) -> list[tuple[tuple, tuple]]:
    """The first and last key of each range of pages, in order: as many rows as a shuffle has partitions, or the table
    has. The keys alone are small, so their number isn't left to what the keys' size asks for."""
    count = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.rdd.getNumPartitions())
    dealt = rows.select(*KEY).repartitionByRange(count, *KEY).select(F.spark_partition_id().alias("part"), F.struct(*KEY).alias("key"))
    found = dealt.groupBy("part").agg(F.min("key").alias("first"), F.max("key").alias("last")).collect()
    return sorted((_order(r["first"]), _order(r["last"])) for r in found)


LINED = pa.schema(
    [("part", pa.int32()), ("own", pa.bool_()), ("host", pa.string()), ("path", pa.string()), ("url", pa.string()), ("page_id", pa.int64()), ("digest", pa.int64())]
    + [("keys", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("kinds", pa.binary()), ("texts", pa.list_(pa.large_string()))]
)
LINED_DDL = "part int, own boolean, host string, path string, url string, page_id long, digest long, keys array<long>, sizes array<int>, kinds binary, texts array<string>"


def lined(rows: DataFrame, bounds: list[tuple[tuple, tuple]]) -> DataFrame:
    """Pages as lines, each in its range, and once more (without texts) in the range that it borders on."""
    firsts, lasts = [b[0] for b in bounds], [b[1] for b in bounds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, chars = [], 0
            for *key, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lines = lines_of(html)
                keys, sizes, kinds = [line_key(x) for x, _ in lines], [len(x) for x, _ in lines], bytes(k for _, k in lines)
                own = _order(key)
                part = max(0, bisect_right(firsts, own) - 1)
                out.append((part, True, *key, keys, sizes, kinds, [x for x, k in lines if k != FURNITURE]))
                if own == firsts[part] and part:
                    out.append((part - 1, False, *key, keys, sizes, kinds, []))
                if own == lasts[part] and part + 1 < len(firsts):
                    out.append((part + 1, False, *key, keys, sizes, kinds, []))
                chars += len(html)
                if chars >= OUT_CHARS:
                    yield _batch(out, LINED)
                    out, chars = [], 0
            if out:
                yield _batch(out, LINED)

    return rows.mapInArrow(run, LINED_DDL)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


class Page:
    """One of a range's different pages, with the number of its own rows."""

    def __init__(self, host, url, page_id, keys, sizes, kinds):
        self.host, self.url, self.page_id = host, url, page_id
        self.keys, self.sizes, self.kinds = keys, sizes, kinds
        self.texts, self.rows, self.template = [], 0, set()

    def compare(self, other: Page) -> None:
        """Notes the lines that both share, unless they are copies."""
        if self.host is None or self.host != other.host:
            return
        pairs = shared(self.keys, other.keys)
        for page, places in ((self, [i for i, _ in pairs]), (other, [j for _, j in pairs])):
            if sum(page.sizes[i] for i in places if page.kinds[i]) > COPIES * sum(s for s, k in zip(page.sizes, page.kinds, strict=True) if k):
                return
        self.template.update(i for i, _ in pairs)
        other.template.update(j for _, j in pairs)

    def result(self) -> tuple:
        unmarked = [i for i, k in enumerate(self.kinds) if k != FURNITURE]
        kind = max((self.kinds[i] for i in unmarked), default=LOOSE)
        text = "\n\n".join(t for i, t in zip(unmarked, self.texts, strict=True) if self.kinds[i] == kind and (kind == ARTICLE or i not in self.template))
        return self.page_id, self.url, text, len(text), len(self.keys), len(self.keys) - len(unmarked), len(self.template)


FOUND = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.large_string())] + [(n, pa.int64()) for n in ("n_chars", "n_lines", "n_marked", "n_shared")])


def _difference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A range's pages in order; a page is held until the next one has been compared with it."""
    at, at_key = None, None
    out, chars = [], 0
    for batch in batches:
        for _, own, *key, keys, sizes, kinds, texts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != at_key:
                page = Page(key[0], key[2], key[3], keys, sizes, kinds)
                if at is not None:
                    at.compare(page)
                    if at.rows:
                        found = at.result()
                        for _ in range(at.rows):
                            out.append(found)
                            chars += found[3]
                            if chars >= OUT_CHARS or len(out) >= 10_000:
                                yield _batch(out, FOUND)
                                out, chars = [], 0
                at, at_key = page, key
            if own:
                at.rows += 1
                at.texts = texts
    if at is not None and at.rows:
        out += [at.result()] * at.rows
    for i in range(0, len(out), 1000):
        yield _batch(out[i : i + 1000], FOUND)


def main_text(pages: DataFrame) -> DataFrame:
    """For each row of pages (page_id, url, html): page_id, url, text, n_chars, n_lines (of the page), n_marked (in
    furniture that markup names), n_shared (with a neighbour that isn't a copy)."""
    rows = keyed(pages)
    bounds = ranges(rows)
    if not bounds:
        return rows.limit(0).selectExpr("page_id", "url", "html AS text", *(f"0L AS {n}" for n in ("n_chars", "n_lines", "n_marked", "n_shared")))
    dealt = lined(rows, bounds).repartitionById(len(bounds), F.col("part")).sortWithinPartitions(*KEY)
    return dealt.mapInArrow(_difference, "page_id long, url string, text string, n_chars long, n_lines long, n_marked long, n_shared long")
