"""HTML pages to plain documents: headings as `#` lines, blocks apart by an empty line.

Spark has no HTML parser, so batches of pages go to the standard library's. Parsing recovers as HTML5 does where it
matters here: a block's start tag closes an open paragraph, list items and table cells close their own kind, and void
elements hold nothing.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What is furniture, what is taken whole, and how headings are marked.
SKIPPED_TAGS = {"script", "style", "nav", "aside", "footer", "header", "form", "button", "svg", "noscript", "template"}
SKIPPED_CLASS = re.compile(r"(?:^|\s)(?:self-link|doclinks|screenreader|skip-link|toc|sidebar|breadcrumb|app-example|app-contact-panel)(?:[\s_-]|$)")
SKIPPED_ID = re.compile(r"(?:toc|table-of-contents|sotd|sidebar|navigation|changelog|acknowledgements|acknowledgments|references|ack_.*)")
BLOCK_TAGS = {"p", "li", "dt", "dd", "pre", "blockquote", "figcaption", "caption", "tr"}
HEADING_TAGS = {f"h{i}": i for i in range(1, 7)}
VOID_TAGS = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Start tags that close an open paragraph, and kinds that close each other.
ENDS_PARAGRAPH = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPES = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}


class Node:
    def __init__(self, tag: str, attributes: dict[str, str | None]):
        self.tag, self.attributes, self.content = tag, attributes, []

    def elements(self) -> Iterator[Node]:
        return (x for x in self.content if isinstance(x, Node))

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                out.append(x)
            else:
                stack.extend(reversed(x.content))
        return "".join(out)

    def first(self, tag: str) -> Node | None:
        stack = [self]
        while stack:
            x = stack.pop()
            if x.tag == tag:
                return x
            stack.extend(reversed(list(x.elements())))
        return None


class TreeBuilder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.open = [self.root]

    def _close(self, tags: set[str], scope: set[str]) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in tags:
                del self.open[i:]
                return
            if self.open[i].tag in scope:
                return

    def handle_starttag(self, tag, attributes):
        if tag in ENDS_PARAGRAPH:
            self._close({"p"}, {"li", "td", "th", "button", "blockquote"})
        if tag in SIBLINGS:
            self._close(SIBLINGS[tag], SCOPES[tag])
        node = Node(tag, dict(attributes))
        self.open[-1].content.append(node)
        if tag not in VOID_TAGS:
            self.open.append(node)

    def handle_startendtag(self, tag, attributes):
        self.handle_starttag(tag, attributes)
        if tag not in VOID_TAGS and len(self.open) > 1:
            self.open.pop()

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        self.open[-1].content.append(data)


WHITE = re.compile(r"[\s\ufeff]+")


def squeeze(text: str) -> str:
    return WHITE.sub(" ", text).strip(" ")


def heading_level(node: Node) -> int | None:
    if node.tag in HEADING_TAGS:
        return HEADING_TAGS[node.tag]
    if node.attributes.get("role") != "heading":
        return None
    level = node.attributes.get("aria-level") or ""
    return int(level) if re.fullmatch(r"\s*[1-6]\s*", level) else 5


def is_skipped(node: Node) -> bool:
    a = node.attributes
    return node.tag in SKIPPED_TAGS or "hidden" in a or bool(SKIPPED_CLASS.search(a.get("class") or "")) or bool(SKIPPED_ID.fullmatch(a.get("id") or ""))


def blocks(root: Node) -> list[str]:
    """Depth first. Text that stands in no block or heading is dropped."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if is_skipped(node):
            continue
        level = heading_level(node)
        if level:
            text = squeeze(node.text())
            out += [f"{'#' * level} {text}"] if text else []
        elif node.tag in BLOCK_TAGS:
            text = " | ".join(x for x in (squeeze(c.text()) for c in node.elements()) if x) if node.tag == "tr" else squeeze(node.text())
            out += [("- " if node.tag == "li" else "") + text] if text else []
        else:
            stack.extend(reversed(list(node.elements())))
    return out


def normalize(html: str | None, doc_id: str, title: str | None = None) -> tuple[str, str]:
    """(title, text) of one page."""
    builder = TreeBuilder()
    builder.feed(html or "")
    builder.close()
    root = builder.root
    text = unicodedata.normalize("NFC", "\n\n".join(blocks(root.first("main") or root.first("body") or root)))
    named = (squeeze(n.text()) if (n := root.first(tag)) else "" for tag in ("h1", "title"))
    return title or next((x for x in named if x), "") or doc_id, text


#: Characters of texts that go out together, so that a task holds little besides the batch that it reads.
OUT_CHARS = 1 << 20


def normalize_pages(pages: DataFrame) -> DataFrame:
    """(doc_id, doc_title, source_url, text) of pages (page_id, url, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, found, chars = 0, [], 0
            for i in range(batch.num_rows):
                found.append(normalize(batch.column(2)[i].as_py(), str(batch.column(0)[i].as_py())))
                chars += len(found[-1][1])
                if chars >= OUT_CHARS or i + 1 == batch.num_rows:
                    part = batch.slice(first, len(found))
                    titles, texts = (pa.array([x[j] for x in found], pa.string()) for j in (0, 1))
                    yield pa.RecordBatch.from_arrays([part.column(0), titles, part.column(1), texts], ["doc_id", "doc_title", "source_url", "text"])
                    first, found, chars = i + 1, [], 0

    own = pages.select(F.col("page_id").cast("string"), F.col("url").cast("string"), F.col("html").cast("string"))
    return own.mapInArrow(run, "doc_id string, doc_title string, source_url string, text string")


#: Ampersands that begin none of the four references of XML's text, semicolon and all.
LOOSE = "&(?!(?:amp|lt|gt|quot);)"


def whole_references(html: Column) -> Column:
    """Pages in which only `&amp;`, `&lt;`, `&gt;` and `&quot;` are references: HTML5 also reads `&amp` without its
    semicolon, as a text leaves that was cut after it was escaped."""
    return F.regexp_replace(html, LOOSE, "&amp;")


def links(pages: DataFrame, pattern: str) -> DataFrame:
    """(link): the distinct first groups of a pattern in all pages, without slashes at the ends."""
    return pages.select(F.explode(F.regexp_extract_all("html", F.lit(pattern), F.lit(1))).alias("link")).distinct().select(F.regexp_replace("link", "^/|/$", "").alias("link"))


def linked_documents(pages: DataFrame, pattern: str, folder: str) -> DataFrame:
    """(doc_id, source_url): the distinct first groups of a pattern in all pages, named folder/slug, the slug being the
    last part of the path without `.html`."""
    found = pages.select(F.explode(F.regexp_extract_all("html", F.lit(pattern), F.lit(1))).alias("source_url")).distinct()
    slug = F.regexp_replace(F.substring_index("source_url", "/", -1), r"\.html$", "")
    return found.select(F.concat(F.lit(f"{folder}/"), slug).alias("doc_id"), "source_url")
