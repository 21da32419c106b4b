"""Chunks of documents: structure-aware ones with overlap, and fixed windows.

Structure-aware chunking is a state machine over one document's blocks, so documents go through it in batches, one row
each, without a shuffle. Fixed windows are cut in one pass over each text.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.scratch import settle

HEADING = re.compile(r"(#{1,6}) (.+)")
SENTENCE_GAP = re.compile(r"(?<=[.!?:;])\s+")
SECTION_LEVEL = 3
#: Characters of chunks and windows that go out together, and rows that are read as Python's objects at once.
OUT_CHARS, READ_ROWS = 1 << 20, 256


@dataclass(frozen=True)
class Sizes:
    """In tokens. overlap: the share of target that may be carried over; None carries nothing."""

    target: int = 400
    least: int = 250
    most: int = 480
    overlap: float | None = 0.15


VARIANTS = {"structure": Sizes(), "no overlap": Sizes(overlap=0.0), "200 tokens": Sizes(200, 120, 240)}


def tokens_in(length: int) -> int:
    return math.ceil(length / T.CHARS_PER_TOKEN)


@dataclass(frozen=True)
class Block:
    start: int
    end: int
    level: int = 0
    title: str = ""


def cut_hard(start: int, end: int, most: int) -> Iterator[Block]:
    step = int(most * T.CHARS_PER_TOKEN)
    return (Block(a, min(a + step, end)) for a in range(start, end, step))


def cut_block(text: str, start: int, end: int, most: int) -> Iterator[Block]:
    """A block that is too large, at sentence ends: as many sentences as their estimates allow, then by length."""
    if tokens_in(end - start) <= most:
        yield Block(start, end)
        return
    borders = [(start, start), *((m.start(), m.end()) for m in SENTENCE_GAP.finditer(text, start, end)), (end, end)]
    sentences = [(a[1], b[0]) for a, b in zip(borders, borders[1:], strict=False)]
    held: list[tuple[int, int]] = []

    def piece() -> Iterator[Block]:
        a, b = held[0][0], held[-1][1]
        if b > a:
            yield from cut_hard(a, b, most) if tokens_in(b - a) > most else [Block(a, b)]

    size = 0
    for a, b in sentences:
        n = tokens_in(b - a)
        if size > 0 and size + n > most:
            yield from piece()
            held, size = [], 0
        held.append((a, b))
        size += n
    if held:
        yield from piece()


def hard_pieces(docs: DataFrame, most: int = Sizes.most) -> DataFrame:
    """(doc_id, char_start, char_end) of docs (doc_id, text), cut by length alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, x.start, x.end) for i, n in enumerate(batch.column(1).to_pylist()) for x in cut_hard(0, n, most)]
            at, start, end = (pa.array([f[j] for f in found], pa.int32()) for j in range(3))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), start, end], ["doc_id", "char_start", "char_end"])

    sizes = docs.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("n"))
    return sizes.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, char_start int, char_end int")


def blocks_of(text: str, most: int) -> Iterator[Block]:
    start = 0
    for raw in text.split("\n\n"):
        end = start + len(raw)
        if raw:
            m = HEADING.fullmatch(raw)
            if m:
                yield Block(start, end, len(m[1]), m[2])
            else:
                yield from cut_block(text, start, end, most)
        start = end + 2


@dataclass
class Chunker:
    """The state between the blocks of one document."""

    sizes: Sizes
    stack: list[Block] = field(default_factory=list)
    held: list[Block] = field(default_factory=list)
    path: list[str] = field(default_factory=list)
    has_body: bool = False
    out: list[tuple[int, int, list[str]]] = field(default_factory=list)

    @staticmethod
    def size(blocks: list[Block]) -> int:
        return tokens_in(blocks[-1].end - blocks[0].start) if blocks else 0

    def flush(self) -> list[Block]:
        done, self.held, self.has_body = self.held, [], False
        if done:
            self.out.append((done[0].start, done[-1].end, self.path))
        return done

    def take(self, block: Block) -> None:
        if block.level:
            while self.stack and self.stack[-1].level >= block.level:
                self.stack.pop()
            self.stack.append(block)
        else:
            self.has_body = True
        if not self.has_body or not self.held:  # the path grows with the leading headings, then stays
            self.path = [x.title for x in self.stack]
        self.held.append(block)

    def carried(self, following: Block, before: list[Block]) -> list[Block]:
        if self.sizes.overlap is None:
            return []
        first = len(before)
        while first > 1:
            more = before[first - 1 :]
            if first < len(before) and self.size(more) > self.sizes.target * self.sizes.overlap or self.size([*more, following]) > self.sizes.most:
                break
            first -= 1
        return before[first:]

    def run(self, text: str) -> list[tuple[int, int, list[str]]]:
        before: list[Block] = []
        for block in blocks_of(text, self.sizes.most):
            if 0 < block.level <= SECTION_LEVEL:
                if self.size(self.held) >= self.sizes.least:
                    self.flush()
                before = []
            if self.held and self.size([*self.held, block]) > self.sizes.most:
                before = self.flush()
            if not self.held:
                for x in self.carried(block, before):
                    self.take(x)
            self.take(block)
            if self.size(self.held) >= self.sizes.target:
                before = self.flush()
        self.flush()
        return self.out


def spans(text: str | None, sizes: Sizes = Sizes()) -> list[tuple[int, int, list[str]]]:
    """(start, end, heading path) of each chunk of one text."""
    return Chunker(sizes).run(text or "")


def with_ids(chunks: DataFrame) -> DataFrame:
    """Adds id: of the document, path and text, with a counter for repeats in one document."""
    keyed = chunks.withColumn("key", T.chunk_key(F.col("doc_id"), F.col("heading_path"), F.col("text")))
    again = F.row_number().over(Window.partitionBy("doc_id", "key").orderBy("char_start")) - 1
    return keyed.withColumn("again", again).withColumn("id", F.when(F.col("again") == 0, F.col("key")).otherwise(F.concat("key", F.lit("-"), F.col("again").cast("string")))).drop("key", "again")


def chunks(docs: DataFrame, sizes: Sizes = Sizes()) -> DataFrame:
    """docs (doc_id, doc_title, source_url, text) in chunks: id, doc_id, doc_title, source_url, heading_path, sc_ref,
    text, char_start, char_end, token_count."""

    names = ["doc_id", "doc_title", "source_url", "heading_path", "text", "char_start", "char_end"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            rows, starts, ends, paths, texts = zip(*held, strict=True)
            own = [batch.column(c).take(pa.array(rows)) for c in range(3)]
            return pa.RecordBatch.from_arrays([*own, pa.array(paths, pa.list_(pa.string())), pa.array(texts, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names)

        for batch in batches:
            held, chars = [], 0
            for i, whole in enumerate(batch.column(3)):
                text = whole.as_py() or ""
                for start, end, path in spans(text, sizes):
                    held.append((i, start, end, path, text[start:end]))
                    chars += end - start
                    if chars >= OUT_CHARS:
                        yield out()
                        held, chars = [], 0
            if held:
                yield out()

    schema = "doc_id string, doc_title string, source_url string, heading_path array<string>, text string, char_start int, char_end int"
    found = docs.select(*[F.col(c).cast("string") for c in ("doc_id", "doc_title", "source_url", "text")]).mapInArrow(run, schema)
    return with_ids(found).select("id", "doc_id", "doc_title", "source_url", "heading_path", T.sc_ref_of(F.col("heading_path")).alias("sc_ref"), "text", "char_start", "char_end", T.estimate_tokens(F.col("text")).alias("token_count"))


def windows_of(text: str, size: int, step: int) -> Iterator[tuple[int, int]]:
    """(start, end) of windows of `size` characters, `step` apart, until one reaches the end: a window's end moves back
    to a space in its second half, its start on to behind one of its first 40 characters."""
    n = len(text)
    for at in range(0, n, step):
        if at and at - step + size >= n:
            return
        end = min(at + size, n)
        if end < n:
            back = text.rfind(" ", at + size // 2 + 1, at + size + 1)
            end = back if back >= 0 else end
        ahead = text.find(" ", at, at + 40) if at else -1
        yield (ahead + 1 if ahead >= 0 else at), end


def fixed_windows(docs: DataFrame, tokens: int = 400, overlap: float = 0.15) -> DataFrame:
    """(doc_id, char_start, char_end, text) of docs (doc_id, text): windows of one size, rounded down, moved to spaces;
    blank ones are left out. One pass over each text, whose time is the windows' length."""
    size = math.floor(tokens * T.CHARS_PER_TOKEN)
    step = math.floor(size * (1 - overlap))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            rows, starts, ends, texts = zip(*held, strict=True)
            return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(texts, pa.string())], ["doc_id", "char_start", "char_end", "text"])

        for batch in batches:
            held, chars = [], 0
            for i, whole in enumerate(batch.column(1)):
                text = whole.as_py() or ""
                for start, end in windows_of(text, size, step):
                    if start < end:
                        held.append((i, start, end, text[start:end]))
                        chars += end - start
                    if chars >= OUT_CHARS:
                        yield out()
                        held, chars = [], 0
            if held:
                yield out()

    cut = docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, char_start int, char_end int, text string")
    return cut.where(F.col("text").rlike(T.NOT_WHITE))


HEADING_LINE = r"(?m)^(#{1,6}) (.+)$"


def headings(docs: DataFrame) -> DataFrame:
    """(doc_id, at, level, title) of the heading lines of docs (doc_id, text), wherever they stand in a block."""
    found = F.regexp_extract_all("text", F.lit(HEADING_LINE), F.lit(0))
    between = F.transform(F.split("text", HEADING_LINE, -1), F.length)
    listed = docs.where(F.col("text").rlike(HEADING_LINE)).select("doc_id", F.posexplode(F.arrays_zip(found.alias("line"), F.slice(between, 1, F.size(found)).alias("gap"))).alias("i", "h"))
    line = F.col("h.line")
    # what stands before a heading: all gaps up to its own, and all headings before it
    at = F.sum(F.col("h.gap") + F.length(line)).over(Window.partitionBy("doc_id").orderBy("i")) - F.length(line)
    return listed.select("doc_id", at.cast("int").alias("at"), F.length(F.regexp_extract(line, HEADING_LINE, 1)).alias("level"), F.regexp_extract(line, HEADING_LINE, 2).alias("title"))


def path_at(windows: DataFrame, heads: DataFrame) -> DataFrame:
    """windows (doc_id, char_start, ...) with heading_path: of the headings at or before the start, those that no later
    one of their own or a higher level has closed. One pass over a document's windows and headings in their order: the
    last heading of a level counts unless one of a higher level came after it."""
    rows = windows.withColumns({"__at": F.col("char_start"), "__kind": F.lit(1)}).unionByName(heads.select("doc_id", F.col("at").alias("__at"), F.lit(0).alias("__kind"), F.col("level").alias("__level"), F.col("title").alias("__title")), allowMissingColumns=True)
    so_far = Window.partitionBy("doc_id").orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    last = [F.max(F.when(F.col("__level") == n, F.struct("__at", "__title"))).over(so_far).alias(f"__h{n}") for n in range(1, 7)]
    rows = rows.select("*", *last).where("__kind = 1")
    open_ = [F.when(F.col(f"__h{n}").isNotNull() & (F.greatest(F.lit(-1), *[F.col(f"__h{m}.__at") for m in range(1, n)]) < F.col(f"__h{n}.__at") if n > 1 else F.col("__h1").isNotNull()), F.col(f"__h{n}.__title")) for n in range(1, 7)]
    return rows.withColumn("heading_path", F.filter(F.array(*open_), lambda x: x.isNotNull())).select(*windows.columns, "heading_path")


def quantile(values: Column, p: float) -> Column:
    """The element at floor(p n) of the sorted values, the last at most."""
    ordered = F.sort_array(F.collect_list(values))
    return F.element_at(ordered, F.least(F.size(ordered), F.floor(F.size(ordered) * F.lit(p)).cast("int") + 1))


def exact_quantiles(rows: DataFrame, value: str, ps: dict[str, float], keys: tuple[str, ...] = ()) -> DataFrame:
    """One row (for each key) with the elements at floor(p n) of the sorted values: from counts of equal values, so no
    task holds more rows than there are different values."""
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("c"))
    of = Window.partitionBy(*keys)
    upto = counts.withColumn("upto", F.sum("c").over(of.orderBy(value))).withColumn("n", F.sum("c").over(of))
    picked = [F.min(F.when(F.col("upto") > F.least(F.col("n") - 1, F.floor(F.col("n") * F.lit(q))), F.col(value))).alias(name) for name, q in ps.items()]
    found = upto.groupBy(*keys).agg(F.max("n").alias("n"), *picked)
    return found if keys else found.where("n IS NOT NULL")


def beside_documents(chunked: DataFrame, docs: DataFrame, own: list[Column]) -> DataFrame:
    """own, holds, to_end, starts: for each chunk (doc_id, text, char_start, char_end) and document of its id, whether
    the offsets cut out the chunk's text, whether they reach the document's end, and whether they start with it or right
    after a line end. A document and its chunks, in their order, stream through one task, which holds one document: no
    chunk carries a document with it."""
    parts = chunked.where("doc_id IS NOT NULL").select("doc_id", F.col("char_start").alias("at"), "char_end", "text", F.struct(*own).alias("own"))
    wholes = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.lit(-1).alias("at"), "text")
    both = parts.unionByName(wholes, allowMissingColumns=True).repartition("doc_id").sortWithinPartitions("doc_id", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc_id, held = None, []  # several, if documents share an id
        for batch in (b.slice(i, READ_ROWS) for b in batches for i in range(0, b.num_rows, READ_ROWS)):
            rows, flags = [], []
            for i, (doc, at, end, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True)):
                if doc != doc_id:
                    doc_id, held = doc, []
                if at < 0:
                    held.append(text)
                    continue
                for whole in held:
                    rows.append(i)
                    flags.append((int(whole[at:end] == text), int(end == len(whole)), int(at == 0 or whole[at - 1 : at] == "\n")))
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(4).take(pa.array(rows)), *(pa.array(f, pa.int32()) for f in zip(*flags, strict=True))], ["own", "holds", "to_end", "starts"])

    kind = parts.schema["own"].dataType.simpleString()
    return both.select("doc_id", "at", "char_end", "text", "own").mapInArrow(run, f"own {kind}, holds int, to_end int, starts int").select("own.*", "holds", "to_end", "starts")


def statistics(chunked: DataFrame, docs: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """One row (for each key): count, token quantiles, and shares of chunks whose offsets hold, that end cleanly (in a
    mark, a line end, or with the document), that start cleanly (with the document, or right after a line end), and that
    have a reference. chunked: keys, doc_id, text, char_start, char_end, sc_ref."""
    text = F.col("text")
    own = [*map(F.col, keys), T.estimate_tokens(text).alias("tokens"), text.rlike(CLEAN_END).alias("clean"), F.col("sc_ref").isNotNull().cast("int").alias("referenced")]
    # written, as both halves of the result read it
    wide = settle(beside_documents(chunked, docs, own).withColumn("ends", (F.col("clean") | (F.col("to_end") == 1)).cast("int")), "measured")
    shares = wide.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in ("holds", "ends", "starts", "referenced")])
    found = exact_quantiles(wide.select(*keys, "tokens"), "tokens", {"median": 0.5, "p10": 0.1, "p90": 0.9}, keys)
    return found.join(shares, list(keys)) if keys else found.crossJoin(shares)  # one row each


# Fixed value: how a chunk ends cleanly.
CLEAN_END = r"[.!?:;)\"'”’\]](?U:[\s\x{FEFF}]*)\z|\n(?U:[\s\x{FEFF}]*)\z"
