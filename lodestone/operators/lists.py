"""First hits of batches of queries over tokenized documents, in blocks: no pair of a document and a query is ever a row.

Documents are counted once, in blocks: the different words of a block, and for each document the numbers of its words with
their counts. Lists of tokens that are equal for most documents share these, and where it is known what will be asked, a
bit table of fixed size tells the words that stay. Queries come together in blocks, too, with the list of their different
terms; of a block of documents, only its different words are looked up there. What is found lies by document, counted
again where rows share an id, and gives the terms' frequencies. A task then sums the scores of a
block of documents for a block of queries in arrays of fixed size, and keeps each query's best k; what leaves a task is k
rows a query, however many documents it has.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import settle

#: Queries of a block; tokens of a block of documents, and its rows at most; documents that are scored at once; rows
#: that a task keeps before it cuts them to each query's best; pairs of a posting and a query that are held at once.
QUERIES, TOKENS, ROWS, SCORED, HELD, PAIRS = 256, 1 << 18, 4096, 512, 1 << 16, 1 << 20
#: Bits of the table of words that are asked for, whatever the input; bytes of text that are looked at together.
CELLS, BYTES = 1 << 20, 1 << 22


def query_blocks(terms: DataFrame) -> DataFrame:
    """(block, queries, sizes, numbers, places, vocabulary) of terms (query_id, pos, term): for each query its terms, by
    their numbers in the block's vocabulary, and their places in the query. Written, as blocks get their numbers here."""
    kind = dict(terms.dtypes)["query_id"]
    # a query's different terms, as SQL counts them where rows share a query_id
    rows = terms.groupBy("query_id", "term").agg(F.min("pos").alias("pos")).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("pos", "term"))).alias("t")).select("query_id", F.col("t.pos").alias("pos"), F.col("t.term").alias("term"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, QUERIES):
                part = batch.slice(at, QUERIES)
                coded = part.column(2).flatten().dictionary_encode()
                sizes = part.column(2).value_lengths().cast(pa.int32())
                lists = [part.column(0), sizes, coded.indices.cast(pa.int32()), part.column(1).flatten().cast(pa.int32()), coded.dictionary]
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays([0, len(x)], x) for x in lists], ["queries", "sizes", "numbers", "places", "vocabulary"])

    packed = rows.mapInArrow(pack, f"queries array<{kind}>, sizes array<int>, numbers array<int>, places array<int>, vocabulary array<string>")
    return settle(packed.select(F.monotonically_increasing_id().alias("block"), "*"), "query-blocks")


def _ends(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)])


def _cuts(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about TOKENS tokens and ROWS rows at most."""
    first, held = 0, 0
    for i, n in enumerate(sizes):
        held += int(n)
        if held >= TOKENS or i - first + 1 >= ROWS:
            yield first, i + 1
            first, held = i + 1, 0
    if first < len(sizes):
        yield first, len(sizes)


#: ASCII but letters and digits as blanks; and in lower case, too.
BLANKED = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))
LOWERED = BLANKED.lower()

#: What a character is: letter of lower or upper case, number, what joins words, or one that `text.ODD` finds, as are all
#: characters beyond the table.
LOWER, UPPER, NUMBER, JOINS, BEYOND = 1, 2, 4, 8, 16
KINDS = np.array([JOINS if chr(c) in "-_." else BEYOND if c > 0x17F or c in (0xD7, 0xF7, 0x130) or 0x7F < c < 0xC0 else {"Ll": LOWER, "Lu": UPPER, "Nd": NUMBER}.get(unicodedata.category(chr(c)), 0) for c in range(0x181)], np.uint8)


_L, _U, _N = ("".join(map(chr, np.flatnonzero(KINDS[:-1] == k))) for k in (LOWER, UPPER, NUMBER))
#: `text.WORD` and `text.CAMEL` for these characters.
WORD = re.compile(f"[{_L}{_U}{_N}]+(?:[-_.][{_L}{_U}{_N}]+)*")
CAMEL = re.compile(f"(?<=[{_L}{_N}])(?=[{_U}])|(?<=[{_U}])(?=[{_U}][{_L}])")
DOTTED_NUMBER = re.compile(r"[0-9]+(?:\.[0-9]+)+")
#: All ASCII but letters, digits and what joins words as blanks.
APART = bytes(c if c > 127 or chr(c).isalnum() or chr(c) in "-_." else 32 for c in range(256))


def _looked(lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(which texts `text.ODD` finds, which others `text.SPECIAL` finds). Where neither does, both lists of tokens are the
    runs of letters and digits of the lowered text."""
    sizes = pc.utf8_length(lines).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    odd, special = np.zeros((2, len(lines)), bool)
    try:
        code = np.frombuffer("".join(lines.to_pylist()).encode("utf-32-le"), np.uint32)
    except UnicodeError:  # what is no UTF-8 is read as Java reads it
        return ~odd, special
    kind = np.zeros(len(code) + 2, np.uint8)
    kind[1:-1] = KINDS[np.minimum(code, len(KINDS) - 1)]
    at = np.flatnonzero(kind & (UPPER | JOINS | BEYOND))
    row = np.searchsorted(ends, at - 1, "right")
    own, before, after = kind[at], kind[at - 1], kind[at + 1]
    before[at - 1 == (ends - sizes)[row]] = 0
    after[at == ends[row]] = 0
    word = LOWER | UPPER | NUMBER
    joined = (own & JOINS > 0) & (before & word > 0) & (after & word > 0)
    camel = (own & UPPER > 0) & ((before & (LOWER | NUMBER) > 0) | (before & UPPER > 0) & (after & LOWER > 0))
    odd[row[own & BEYOND > 0]] = True
    special[row[joined | camel]] = True
    return odd, special & ~odd


def _pieces(run: str) -> list[str]:
    """The tokens of a text without blanks, as `text.tokens` has them, for characters of these kinds."""
    out = []
    for word in WORD.findall(run):
        out.append(word.lower())
        if not DOTTED_NUMBER.fullmatch(word):
            parts = re.split("[-_.]", word)
            out += [p.lower() for p in parts] if len(parts) > 1 else []
            for cut in map(CAMEL.split, parts):
                out += [p.lower() for p in cut] if len(cut) > 1 else []
    return out


def _compound(lines: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(how many tokens each text has, all tokens), compounds with their parts; each different run is cut once."""
    lens, runs = _cut_up(lines, True, APART)
    coded = runs.dictionary_encode()
    different = coded.dictionary
    _, special = _looked(different)
    size, tokens = _cut_up(different.filter(pa.array(~special)), True, LOWERED)
    others = pa.array([_pieces(x) for x in different.filter(pa.array(special)).to_pylist()], pa.list_(runs.type))
    each = pa.concat_arrays([pa.ListArray.from_arrays(pa.array(_ends(size), pa.int32()), tokens), others])
    place = np.where(special, len(size) + np.cumsum(special), np.cumsum(~special)) - 1
    each = each.take(pa.array(place[coded.indices.to_numpy()]))
    ends = _ends(each.value_lengths().to_numpy(zero_copy_only=False))[_ends(lens)]
    return np.diff(ends), each.flatten()


#: Factors of a word's bytes by their place.
FACTORS = np.cumprod(np.full(256, 0x9E3779B97F4A7C15, np.uint64))


def hashes(held: np.ndarray, at: np.ndarray) -> np.ndarray:
    """64 bits for each word, of all words' bytes and where each begins, with the end."""
    place = np.arange(len(held)) - np.repeat(at[:-1], np.diff(at))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((held + np.uint64(1)) * FACTORS[place & 255])])
    h = sums[at[1:]] - sums[at[:-1]]
    return (h ^ (h >> np.uint64(29))) * FACTORS[1]


def held_bytes(lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes of texts, where each begins, with the end); no text is null."""
    wide = pa.types.is_large_string(lines.type)
    at = np.frombuffer(lines.buffers()[1], np.int64 if wide else np.int32)[lines.offset : lines.offset + len(lines) + 1].astype(np.int64)
    held = np.frombuffer(lines.buffers()[2], np.uint8)[at[0] : at[-1]] if len(at) and at[-1] > at[0] else np.zeros(0, np.uint8)
    return held, at - at[0] if len(at) else np.zeros(1, np.int64)


def _cells(words: pa.Array) -> np.ndarray:
    """The place of each word in a table of CELLS bits."""
    return (hashes(*held_bytes(words)) >> np.uint64(40)).astype(np.int64) & (CELLS - 1)


def asked_words(terms: DataFrame) -> Broadcast:
    """A table of CELLS bits: which words searches for terms (term, and others) look for, and some others with them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(_cells(batch.column(0))))], ["cell"])

    table = np.zeros(CELLS, bool)
    table[terms.select("term").mapInArrow(run, "cell long").distinct().toArrow().column(0).to_numpy()] = True
    return terms.sparkSession.sparkContext.broadcast(table)


def _cut_up(lines: pa.Array, raw: bool, blanked: bytes = BLANKED) -> tuple[np.ndarray, pa.Array]:
    """(how many tokens each line has, all tokens) of lists of tokens, or of texts with blanks between tokens; where they
    are raw, other ASCII characters than letters and digits are blanks."""
    if pa.types.is_list(lines.type):
        return pc.fill_null(lines.value_lengths(), 0).to_numpy(zero_copy_only=False).astype(np.int64), lines.flatten()
    lines = pc.fill_null(lines, "")
    if raw and len(lines):
        wide = pa.types.is_large_string(lines.type)
        at = np.frombuffer(lines.buffers()[1], np.int64 if wide else np.int32)[lines.offset : lines.offset + len(lines) + 1]
        held = lines.buffers()[2].slice(int(at[0]), int(at[-1] - at[0])).to_pybytes() if at[-1] > at[0] else b""
        lines = type(lines).from_buffers(len(lines), pa.py_buffer(at - at[0]), pa.py_buffer(held.translate(blanked)))
    parts = pc.split_pattern(lines, " ")
    tokens = parts.flatten()
    some = pc.greater(pc.binary_length(tokens), 0)
    ends = _ends(some.to_numpy(zero_copy_only=False))[_ends(parts.value_lengths().to_numpy(zero_copy_only=False))]
    return np.diff(ends), tokens.filter(some)


def _int32(x: np.ndarray) -> pa.Array:
    return pa.array([x.astype(np.int32).tobytes()], pa.binary())


COUNTED = ["lists", "ids", "lens", "words", "sizes", "term", "tf"]


def _counted_schema(kind: str) -> str:
    return f"lists array<string>, ids array<{kind}>, lens array<long>, words array<string>, sizes binary, term binary, tf binary"


def _block(of: list[str], ids: pa.Array, lens: np.ndarray, tokens: pa.Array, table: np.ndarray | None, lower: bool = False) -> pa.RecordBatch:
    """A row of `counted`. lower: the tokens' letters beyond ASCII are lowered here, each different token once."""
    coded = tokens.dictionary_encode("encode")
    words, numbers = coded.dictionary, coded.indices.to_numpy()
    if lower and len(words):
        again = pc.utf8_lower(words).dictionary_encode()
        words, numbers = again.dictionary, again.indices.to_numpy()[numbers]
    doc = np.repeat(np.arange(len(lens)), lens)
    if table is not None and len(words):
        stays = table[_cells(words)]
        held = stays[numbers]
        words, numbers, doc = words.filter(pa.array(stays)), (np.cumsum(stays) - 1)[numbers[held]], doc[held]
    n = max(1, len(words))
    keys, tf = np.unique(doc * n + numbers, return_counts=True)
    doc = keys // n
    lists = [pa.array(of, pa.string()), ids, pa.array(lens, pa.int64()), words]
    return pa.RecordBatch.from_arrays([*(pa.ListArray.from_arrays([0, len(x)], x) for x in lists), _int32(np.bincount(doc, minlength=len(lens))), _int32(keys - doc * n), _int32(tf)], COUNTED)


def counted(listed: DataFrame, raw: tuple[str, ...] = (), only: tuple[str, ...] = (), asked: Broadcast | None = None) -> DataFrame:
    """(lists, ids, lens, words, sizes, term, tf) of listed (id, and columns of tokens, as lists or as texts with blanks
    between tokens, in those of raw also other ASCII characters than letters and digits): for documents that lie together
    their different words, and for each the numbers of its words with counts, as 32-bit numbers; lists names the columns
    that this holds for. Where a column after the first is null, it is as the first. only: columns that are counted, if
    not all; asked: the words that stay, if not all (lens count all tokens). Written."""
    kind, names = dict(listed.dtypes)["id"], [c for c in listed.columns if c != "id"]
    only = only or tuple(names)

    def blocks(name: str, of: list[str], ids: pa.Array, lines: pa.Array) -> Iterator[pa.RecordBatch]:
        if of and len(ids):
            lens, tokens = _cut_up(lines, name in raw)
            ends = _ends(lens)
            for a, b in _cuts(lens):
                yield _block(of, ids[a:b], lens[a:b], tokens[ends[a] : ends[b]], asked and asked.value)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # rows by which columns are as the first
            own = [pc.is_valid(batch.column(i)).to_numpy(zero_copy_only=False) for i in range(2, len(names) + 1)]
            which = sum((x.astype(np.int64) << i for i, x in enumerate(own)), np.zeros(batch.num_rows, np.int64))
            for w in np.unique(which):
                part = batch if len(own) == 0 else batch.filter(pa.array(which == w))
                apart = [name for i, name in enumerate(names[1:]) if w >> i & 1]
                yield from blocks(names[0], [c for c in only if c not in apart], part.column(0), part.column(1))
                for name in apart:
                    yield from blocks(name, [c for c in only if c == name], part.column(0), part.column(1 + names.index(name)))

    return settle(listed.select("id", *names).mapInArrow(pack, _counted_schema(kind)), "counted", heavy=True)


def counted_texts(docs: DataFrame, of: tuple[str, ...], asked: Broadcast | None = None) -> tuple[DataFrame, DataFrame]:
    """(`counted`'s rows for the texts of docs (id, text) that `text.ODD` doesn't find, of lists "plain" and "full", or of
    one of them; the other documents). Texts are looked at once, and written counted or as they are."""
    kind = dict(docs.dtypes)["id"]

    def rows(of: list[str], ids: pa.Array, lens: np.ndarray, tokens: pa.Array) -> Iterator[pa.RecordBatch]:
        ends = _ends(lens)
        for a, b in _cuts(lens) if of else ():
            row = _block(of, ids[a:b], lens[a:b], tokens[ends[a] : ends[b]], asked and asked.value, lower=True)
            yield pa.RecordBatch.from_arrays([*row.columns, pa.nulls(1, ids.type), pa.nulls(1, pa.string())], [*COUNTED, "id", "text"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lines = batch.column(0), pc.fill_null(batch.column(1), "")
            ends = _ends(pc.binary_length(lines).to_numpy(zero_copy_only=False))
            first = 0
            while first < len(lines):
                last = max(first + 1, int(np.searchsorted(ends, ends[first] + BYTES)))
                own, part = ids[first:last], lines[first:last]
                odd, special = _looked(part)
                kinds = [(~odd & ~special, list(of))]
                kinds += [(special, ["plain"] if "plain" in of else [])] if special.any() else []
                for which, names in kinds:
                    yield from rows(names, own.filter(pa.array(which)), *_cut_up(part.filter(pa.array(which)), True, LOWERED))
                if special.any() and "full" in of:
                    yield from rows(["full"], own.filter(pa.array(special)), *_compound(part.filter(pa.array(special))))
                if odd.any():
                    nulls = [pa.nulls(int(odd.sum()), t) for t in (pa.list_(pa.string()), pa.list_(ids.type), pa.list_(pa.int64()), pa.list_(pa.string()), *[pa.binary()] * 3)]
                    yield pa.RecordBatch.from_arrays([*nulls, own.filter(pa.array(odd)), part.filter(pa.array(odd))], [*COUNTED, "id", "text"])
                first = last

    both = settle(docs.select("id", "text").mapInArrow(pack, f"{_counted_schema(kind)}, id {kind}, text string"), "counted", heavy=True)
    return both.where("text IS NULL").select(*COUNTED), both.where("text IS NOT NULL").select("id", "text")


def of_list(counts: DataFrame, name: str) -> DataFrame:
    """Of `counted`'s rows, those of one column."""
    return counts.where(F.array_contains("lists", name))


def _counted(doc: np.ndarray, size: np.ndarray, term: np.ndarray, tf: np.ndarray) -> tuple[np.ndarray, ...]:
    """Postings with equal document, length and term as one, their counts added."""
    order = np.lexsort((term, size, doc))
    doc, size, term, tf = doc[order], size[order], term[order], tf[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (size[1:] != size[:-1]) | (term[1:] != term[:-1])
    at = np.flatnonzero(new)
    return doc[at], size[at], term[at], np.add.reduceat(tf, at) if len(at) else tf


def postings(listed: DataFrame, blocks: DataFrame) -> DataFrame:
    """(block, ids, doc, len, term, tf): for blocks of documents, the postings of a block's terms; doc is a place in ids,
    term a number in the vocabulary; doc, len and tf are 32-bit numbers. Rows of listed (id, tokens) with one id are one
    document. Written."""
    return postings_of(counted(listed.select("id", "tokens")), blocks)


def ids_repeat(counts: DataFrame) -> bool:
    """Whether a document lies in more than one place."""
    return not counts.select(F.explode("ids").alias("id")).groupBy("id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()


def postings_of(counts: DataFrame, blocks: DataFrame) -> DataFrame:
    """The same from `counted`'s rows of one column."""
    kind = dict(counts.dtypes)["ids"][6:-1]

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for r in range(batch.num_rows):
                block, ids, lens, words, sizes, term, tf, vocabulary = (c[r] for c in batch.columns)
                sizes, term, tf = (np.frombuffer(x.as_buffer(), np.int32) for x in (sizes, term, tf))
                found = pc.fill_null(pc.index_in(words.values, value_set=vocabulary.values), -1).to_numpy(zero_copy_only=False)[term]
                yield block, ids, lens, sizes, found, np.flatnonzero(found >= 0), np.repeat(np.arange(len(sizes)), sizes), tf

    def out(block: int, ids: pa.Array, rows: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        doc, size, term, tf = rows
        lists = [pa.ListArray.from_arrays([0, len(x)], x) for x in (ids, pa.array(term, pa.int32()))]
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), lists[0], _int32(doc), _int32(size), lists[1], _int32(tf)], ["block", "ids", "doc", "len", "term", "tf"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ids, lens, _, found, at, doc, tf in known(batches):
            if len(at):
                yield out(block.as_py(), ids.values, (doc[at], lens.values.to_numpy(zero_copy_only=False)[doc[at]], found[at], tf[at]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ids, lens, sizes, found, at, doc, tf in known(batches):
            ends = pa.array(np.searchsorted(doc[at], np.arange(len(sizes) + 1)), pa.int32())
            terms = pa.ListArray.from_arrays(ends, pa.array(found[at], pa.int32()))
            out = pa.RecordBatch.from_arrays([pa.array(np.full(len(sizes), block.as_py()), pa.int64()), ids.values, lens.values, terms, pa.ListArray.from_arrays(ends, pa.array(tf[at], pa.int64()))], ["block", "id", "len", "term", "tf"])
            yield out.filter(pc.greater(terms.value_lengths(), 0))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the last id's postings wait, as the next rows may have more of them
        own, ids, held = None, None, None
        for batch in batches:
            blocks_ = batch.column(0).to_numpy()
            for first, last in zip(edges := np.concatenate([[0], np.flatnonzero(np.diff(blocks_)) + 1, [len(blocks_)]]), edges[1:], strict=False):
                sizes = batch.column(3)[first:last].value_lengths().to_numpy(zero_copy_only=False)
                for a, b in _cuts(sizes):
                    part = batch.slice(first + a, b - a)
                    block, count = int(blocks_[first + a]), part.column(3).value_lengths().to_numpy(zero_copy_only=False)
                    if held is not None and own != block:
                        yield out(own, ids, held)
                        held = None
                    named = part.column(1) if held is None else pa.concat_arrays([ids, part.column(1)])
                    same = pc.fill_null(pc.equal(named[1:], named[:-1]), False).to_numpy(zero_copy_only=False) | (pc.is_null(named[1:]).to_numpy(zero_copy_only=False) & pc.is_null(named[:-1]).to_numpy(zero_copy_only=False))
                    number = np.concatenate([[0], np.cumsum(~same)])
                    skip = len(named) - len(part)
                    rows = (np.repeat(number[skip:], count), np.repeat(part.column(2).to_numpy(zero_copy_only=False), count), part.column(3).flatten().to_numpy(zero_copy_only=False), part.column(4).flatten().to_numpy(zero_copy_only=False))
                    if held is not None:
                        rows = tuple(np.concatenate(x) for x in zip(held, rows, strict=True))
                    if same.any():
                        rows = _counted(*rows)
                    named = named.filter(pa.array(np.concatenate([[True], ~same])))
                    cut = np.searchsorted(rows[0], len(named) - 1)
                    if len(named) > 1:
                        yield out(block, named[:-1], tuple(x[:cut] for x in rows))
                    own, ids, held = block, named[-1:], (rows[0][cut:] * 0, *(x[cut:] for x in rows[1:]))
        if held is not None:
            yield out(own, ids, held)

    met = counts.crossJoin(blocks.select("block", "vocabulary")).select("block", "ids", "lens", "words", "sizes", "term", "tf", "vocabulary")  # of blocks
    schema = f"block long, ids array<{kind}>, doc binary, len binary, term array<int>, tf binary"
    if not ids_repeat(counts):
        return settle(met.mapInArrow(whole, schema), "postings", heavy=True)  # every document lies whole
    found = met.mapInArrow(find, f"block long, id {kind}, len long, term array<int>, tf array<long>")
    dealt = found.repartition("id").sortWithinPartitions("block", "id")
    return settle(dealt.mapInArrow(pack, schema), "postings", heavy=True)


def frequencies(posted: DataFrame) -> DataFrame:
    """(block, term, df)"""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, term in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                numbers, n = np.unique(term.values.to_numpy(zero_copy_only=False), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), block), pa.int64()), pa.array(numbers, pa.int32()), pa.array(n, pa.int64())], ["block", "term", "df"])

    return posted.select("block", "term").mapInArrow(count, "block long, term int, df long").groupBy("block", "term").agg(F.sum("df").alias("df"))


def weighted(blocks: DataFrame, posted: DataFrame, stats: DataFrame, idf: Column) -> DataFrame:
    """blocks with the weight of each of their terms that documents hold: idf is an expression over n and df. Written."""
    return weights(blocks, frequencies(posted), stats, idf)


def weights(blocks: DataFrame, often: DataFrame, stats: DataFrame, idf: Column) -> DataFrame:
    """The same from the terms' frequencies (block, term, df)."""
    known = often.crossJoin(F.broadcast(stats.select("n", "avgdl"))).select("block", "term", idf.alias("idf"), "avgdl")  # one row
    listed = known.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("term", "idf"))).alias("w"), F.first("avgdl").alias("avgdl"))  # of a block's vocabulary
    return settle(blocks.join(listed, "block").select("block", "queries", "sizes", "numbers", "places", F.size("vocabulary").alias("n_terms"), F.col("w.term").alias("known"), F.col("w.idf").alias("idf"), "avgdl"), "weights")


class Best:
    """Each query's best k of a block of queries, for one k1 and b, as far as a task has come."""

    def __init__(self, queries: pa.Array, k: int):
        self.queries, self.k = queries, k
        self.least = np.full(len(queries), -np.inf)
        self.held: list[pa.Table] = []
        self.size = 0

    def add(self, query: np.ndarray, ids: pa.Array, score: np.ndarray, first: np.ndarray) -> None:
        self.held.append(pa.table({"query": pa.array(query, pa.int32()), "id": ids, "score": score, "near": np.round(score, 9), "first": pa.array(first, pa.int32())}))
        self.size += len(query)
        if self.size >= max(HELD, 2 * self.k * len(self.queries)):
            self.cut()

    def cut(self) -> None:
        t = pa.concat_tables(self.held).combine_chunks()
        # Spark puts null ids first
        t = t.take(pc.sort_indices(t, [("query", "ascending"), ("near", "descending"), ("first", "ascending"), ("id", "ascending")], null_placement="at_start"))
        query = t["query"].to_numpy()
        place = np.arange(len(query)) - np.searchsorted(query, query)
        last = np.flatnonzero(place == self.k - 1)
        self.least[query[last]] = t["near"].to_numpy()[last]
        t = t.filter(pa.array(place < self.k))
        self.held, self.size = [t], len(t)

    def rows(self) -> pa.Table:
        self.cut()
        return self.held[0]


class Block:
    """A block of queries by term: which queries have it, and at which place."""

    def __init__(self, row: dict[str, pa.Scalar], params: list[tuple[float, float]], k: int):
        own = {c: row[c].values.to_numpy(zero_copy_only=False) for c in ("sizes", "numbers", "places", "known", "idf")}
        n = row["n_terms"].as_py()
        order = np.argsort(own["numbers"], kind="stable")
        self.query, self.place = np.repeat(np.arange(len(own["sizes"])), own["sizes"])[order], own["places"][order]
        self.count = np.bincount(own["numbers"], minlength=n)
        self.start = _ends(self.count)[:-1]
        self.idf = np.zeros(n)
        self.idf[own["known"]] = own["idf"]
        self.avgdl, self.n = row["avgdl"].as_py(), len(own["sizes"])
        self.best = [Best(row["queries"].values, k) for _ in params]

    def score(self, ids: pa.Array, doc: np.ndarray, size: np.ndarray, term: np.ndarray, tf: np.ndarray, params: list[tuple[float, float]], open_in: np.ndarray | None = None, width: int = 1) -> None:
        """doc is in order; a part of the documents is scored at once. open_in: for each query and each `width` documents,
        whether they are scored, if not all are."""
        upto = _ends(self.count[term])
        a = 0
        while a < len(doc):
            # whole documents: as many as SCORED says and as PAIRS holds, one at least
            b = min(np.searchsorted(doc, doc[a] + SCORED), np.searchsorted(doc, doc[max(a, np.searchsorted(upto, upto[a] + PAIRS, "right") - 2)]))
            b = int(b) if b > a else int(np.searchsorted(doc, doc[a] + 1))
            n, base = self.count[term[a:b]], int(doc[a])
            row = np.repeat(np.arange(b - a), n)
            entry = np.arange(len(row)) - np.repeat(upto[a:b] - upto[a], n) + np.repeat(self.start[term[a:b]], n)
            if open_in is not None:
                stays = open_in[self.query[entry], doc[a:b][row] // width]
                row, entry = row[stays], entry[stays]
            key = (doc[a:b][row] - base) * self.n + self.query[entry]
            cells = (int(doc[b - 1]) - base + 1) * self.n
            for (k1, bb), best in zip(params, self.best, strict=True):
                part = self.idf[term[a:b]] * (tf[a:b] * (k1 + 1)) / (tf[a:b] + k1 * (1 - bb + bb * size[a:b] / self.avgdl))
                total = np.bincount(key, weights=part[row], minlength=cells)
                open_ = (total > 0) & (np.round(total, 9).reshape(-1, self.n) >= best.least).ravel()
                cell = np.flatnonzero(open_)
                if len(cell):
                    at = np.flatnonzero(open_[key])
                    first = np.full(cells, np.iinfo(np.int32).max, np.int32)
                    np.minimum.at(first, key[at], self.place[entry[at]])
                    best.add(cell % self.n, ids.take(pa.array(cell // self.n + base)), total[cell], first[cell])
            a = b

    def rows(self, params: list[tuple[float, float]]) -> Iterator[pa.RecordBatch]:
        """(k1, b, query_id, id, score, first) of what was best."""
        for (k1, b), best in zip(params, self.best, strict=True):
            if best.held:
                t = best.rows()
                yield from pa.table({"k1": np.full(len(t), k1), "b": np.full(len(t), b), "query_id": best.queries.take(t["query"].combine_chunks()), "id": t["id"], "score": t["score"], "first": t["first"]}).to_batches()


def hits(posted: DataFrame, blocks: DataFrame, params: list[tuple[float, float]], k: int) -> DataFrame:
    """(k1, b, query_id, id, score, first): k rows at most for each task, query and pair of parameters; every query's
    first k of all documents are among them. blocks: those of `weighted`."""
    columns = ["block", "queries", "sizes", "numbers", "places", "n_terms", "known", "idf", "avgdl"]
    own = ["ids", "doc", "len", "term", "tf"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[int, Block] = {}
        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: batch.column(c)[r] for c in (*columns, *own)}
                at = row["block"].as_py()
                if at not in met:
                    met[at] = Block(row, params, k)
                doc, size, tf = (np.frombuffer(row[c].as_buffer(), np.int32) for c in ("doc", "len", "tf"))
                met[at].score(row["ids"].values, doc, size, row["term"].values.to_numpy(zero_copy_only=False), tf, params)
        for block in met.values():
            yield from block.rows(params)

    kinds = dict(posted.dtypes)["ids"][6:-1], dict(blocks.dtypes)["queries"][6:-1]
    wide = posted.join(blocks, "block").select(*columns, *own)
    return wide.mapInArrow(run, f"k1 double, b double, query_id {kinds[1]}, id {kinds[0]}, score double, first int")
