"""Token-ID output: independent zstandard frames with a trailing seek table and a checksum for each frame.

A file is a sequence of zstandard frames of little-endian unsigned 32-bit ids, then two skippable frames: the
documents (id and number of tokens, in order) and the seek table (compressed size, size and checksum of each frame,
as in the public seekable zstandard layout). Any zstandard reader can read the whole; `read_documents` reads the
tables first and then decompresses only the frames that hold the documents asked for.

Defined cases: a null or empty text holds only the end id; a null doc_id comes first and is kept; rows with the same
doc_id are all kept, ordered by text; an empty table gives no file; further columns are ignored. Texts of any length
are encoded whole: a frame holds at most FRAME_IDS ids, so a long document has several.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch, settle, slices

#: Ids in a frame, about: documents are put together until a frame holds so many, and longer ones are cut.
FRAME_IDS = 1 << 14
#: Bytes that the words which a worker remembers take, with what Python needs for each; beyond it, it starts afresh.
#: Longer words are never remembered. Both bound memory and never change an id.
KNOWN_BYTES, WORD_BYTES, WORD_COST = 192 << 20, 256, 200
#: Bytes of text whose words are looked up at once; longer texts are cut at white space.
PART_BYTES = 2 << 20

# Rules by which a text's ids are those of its words, one after another. White space becomes a space and
# is no part of any match, the composed form never joins what a space separates, and lowering goes by character.
WORD_RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}

#: All ASCII characters that are neither letters, digits nor white space, but for control characters.
MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum())
SPACE = re.compile(rb"[ \t-\r]")
# Fixed values of the public seekable zstandard layout.
SKIPPABLE_DOCUMENTS, SKIPPABLE_SEEK, SEEK_END, HAS_CHECKSUM = 0x184D2A5D, 0x184D2A5E, 0x8F92EAB1, 0x80


class WordEncoder:
    """Encodes texts with a tokenizer; by words where its rules are WORD_RULES, else each text whole.

    By words, a text's ids are the ids of its words, one after another, and a word's are those of what stands before its
    last ASCII marks and of the marks. Each such part goes to the library once, many in one call with a special token
    between them. Lowering A-Z first is harmless as the tokenizer lowers too, but not where a special token's string
    may stand; such words go to the library on their own.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        added = list(self.tokenizer.get_added_tokens_decoder().items())
        plain = all(t.special and t.content.startswith("<|") and not re.search(r"\s", t.content) and not (t.lstrip or t.rstrip or t.single_word or t.normalized) for _, t in added)
        self.by_word = bool(added) and plain and all(rules.get(k) == v for k, v in WORD_RULES.items()) and not rules["model"].get("dropout")
        self.border = max((i, t.content) for i, t in added) if self.by_word else None
        self.known: dict[bytes, bytes] = {}
        self.held = 0

    def _library(self, words: list[bytes]) -> Iterator[bytes]:
        plain = [w for w in words if b"<|" not in w] if self.border else []
        found: dict[bytes, bytes] = {}
        for i in range(0, len(plain), 256):
            part = plain[i : i + 256]
            ids = self.tokenizer.encode_batch_fast([self.border[1].join(w.decode("utf-8", "replace") for w in part)], add_special_tokens=False)[0].ids
            at, stop = 0, self.border[0]
            for w in part[:-1]:
                end = ids.index(stop, at)
                found[w] = array("I", ids[at:end]).tobytes()
                at = end + 1
            found[part[-1]] = array("I", ids[at:]).tobytes()
        rest = [w for w in words if w not in found]
        if rest:
            found.update(zip(rest, (array("I", x.ids).tobytes() for x in self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in rest], add_special_tokens=False)), strict=True))
        return map(found.__getitem__, words)

    def _ids_of(self, words: list[bytes]) -> dict[bytes, bytes]:
        heads = [w.rstrip(MARKS) for w in words]
        # only where the head ends in a letter or digit: a mark there would join what follows
        cut = [(h, w[len(h) :]) if len(h) < len(w) and h[-1:].isalnum() and b"<|" not in w else (w, b"") for h, w in zip(heads, words, strict=True)]
        parts = list({p for pair in cut for p in pair if p}.difference(self.known))
        new = dict(zip(parts, self._library(parts), strict=True))
        get = lambda p: new[p] if p in new else self.known[p]
        new |= {w: get(h) + get(m) for w, (h, m) in zip(words, cut, strict=True) if m}
        return new

    def _lookup(self, words: set[bytes]) -> Callable[[bytes], bytes]:
        """What gives the ids of any of the words."""
        new = words.difference(self.known)
        if new and self.held > KNOWN_BYTES:
            self.known, self.held, new = {}, 0, words
        found = self._ids_of(list(new)) if new else {}
        short = found if max(map(len, found), default=0) <= WORD_BYTES else {w: ids for w, ids in found.items() if len(w) <= WORD_BYTES}
        self.held += sum(map(len, short)) + sum(map(len, short.values())) + WORD_COST * len(short)
        self.known.update(short)
        return self.known.__getitem__ if len(short) == len(found) else lambda w: found[w] if w in found else self.known[w]

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        if not self.by_word:
            return [array("I", x.ids).tobytes() for x in self.tokenizer.encode_batch_fast([(t or b"").decode("utf-8", "replace") for t in texts], add_special_tokens=False)]
        out: list[list[bytes]] = [[] for _ in texts]
        for group in groups(texts):
            words = [(p if b"<|" in p else p.lower()).split() for _, p in group]
            ids = self._lookup(set(chain.from_iterable(words)))
            for (i, _), ws in zip(group, words, strict=True):
                out[i].append(b"".join(map(ids, ws)))
        return [b"".join(x) for x in out]


def groups(texts: list[bytes | None]) -> Iterator[list[tuple[int, bytes]]]:
    """(place, part) of the texts in groups of about PART_BYTES; longer texts are cut at white space."""
    group, held = [], 0
    for i, text in enumerate(texts):
        at, size = 0, len(text or b"")
        while at < size:
            gap = SPACE.search(text, at + PART_BYTES)
            end = gap.start() if gap else size
            if group and held + end - at > PART_BYTES:
                yield group
                group, held = [], 0
            group.append((i, text[at:end]))
            held += end - at
            at = end
    if group:
        yield group


ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One for each worker, kept between tasks."""
    if path not in ENCODERS:
        ENCODERS[path] = WordEncoder(path)
    return ENCODERS[path]


class FrameWriter:
    def __init__(self, sink):
        self.sink, self.compressor = sink, zstandard.ZstdCompressor(level=3)
        self.frames: list[tuple[int, int, int]] = []
        self.doc_ids, self.counts = [], array("Q")
        self.held: list[bytes] = []
        self.size = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.doc_ids.append(doc_id)
        self.counts.append(len(ids) // 4)
        self.held.append(ids)
        self.size += len(ids)
        if self.size >= 4 * FRAME_IDS:
            self._flush()

    def _flush(self) -> None:
        data, self.held, self.size = b"".join(self.held), [], 0
        for i in range(0, len(data), 4 * FRAME_IDS * 2):
            part = data[i : i + 4 * FRAME_IDS * 2]
            packed = self.compressor.compress(part)
            self.sink.write(packed)
            self.frames.append((len(packed), len(part), xxhash.xxh64_intdigest(part) & 0xFFFFFFFF))

    def close(self) -> None:
        self._flush()
        n = len(self.doc_ids)
        present = np.array([x is not None for x in self.doc_ids], dtype="u1")
        table = struct.pack("<Q", n) + np.array([x or 0 for x in self.doc_ids], dtype="<i8").tobytes() + present.tobytes() + np.array(self.counts, dtype="<u8").tobytes()
        self.sink.write(struct.pack("<II", SKIPPABLE_DOCUMENTS, len(table)) + table)
        seek = b"".join(struct.pack("<III", *x) for x in self.frames) + struct.pack("<IBI", len(self.frames), HAS_CHECKSUM, SEEK_END)
        self.sink.write(struct.pack("<II", SKIPPABLE_SEEK, len(seek)) + seek)


class FrameReader:
    """Of one open file: doc_ids, counts, and documents by their place."""

    def __init__(self, source, size: int):
        self.source = source
        self.decompressor = zstandard.ZstdDecompressor()
        self.decompressed = 0
        source.seek(size - 9)
        n, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEK_END or flags != HAS_CHECKSUM:
            raise ValueError("no seek table at the end of the file")
        source.seek(size - 9 - 12 * n)
        self.frames = np.frombuffer(source.read(12 * n), dtype="<u4").reshape(n, 3)
        self.at = np.concatenate([[0], np.cumsum(self.frames[:, 0], dtype=np.int64)])
        self.ends = np.cumsum(self.frames[:, 1], dtype=np.int64)
        source.seek(int(self.at[-1]))
        magic, length = struct.unpack("<II", source.read(8))
        if magic != SKIPPABLE_DOCUMENTS:
            raise ValueError("no table of documents before the seek table")
        table = source.read(length)
        (m,) = struct.unpack_from("<Q", table)
        ids, present = np.frombuffer(table, "<i8", m, 8), np.frombuffer(table, "u1", m, 8 + 8 * m)
        self.doc_ids = [int(x) if p else None for x, p in zip(ids, present, strict=True)]
        self.counts = np.frombuffer(table, "<u8", m, 8 + 9 * m).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.counts)])
        self.cache: tuple[int, bytes] = (-1, b"")

    def frame(self, k: int) -> bytes:
        if self.cache[0] != k:
            self.source.seek(int(self.at[k]))
            data = self.decompressor.decompress(self.source.read(int(self.frames[k, 0])), max_output_size=int(self.frames[k, 1]))
            if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.frames[k, 2]:
                raise ValueError(f"frame {k} doesn't match its checksum")
            self.cache = (k, data)
            self.decompressed += 1
        return self.cache[1]

    def ids(self, i: int) -> bytes:
        """Of the i-th document of the file."""
        start, end = 4 * int(self.starts[i]), 4 * int(self.starts[i + 1])
        k, parts = int(np.searchsorted(self.ends, start, side="right")), []
        while start < end:
            first = int(self.ends[k]) - int(self.frames[k, 1])
            parts.append(self.frame(k)[start - first : end - first])
            start = min(end, int(self.ends[k]))
            k += 1
        return b"".join(parts)


def read_documents(path: str, wanted: Iterable[int]) -> dict[int, np.ndarray]:
    """The ids of the wanted documents of one file; only their frames are decompressed."""
    fs, name = pa.fs.FileSystem.from_uri(path)
    wanted = set(wanted)
    with fs.open_input_file(name) as source:
        reader = FrameReader(source, source.size())
        return {d: np.frombuffer(reader.ids(i), dtype="<u4") for i, d in enumerate(reader.doc_ids) if d in wanted}


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int) -> DataFrame:
    """Writes docs, in ascending doc_id order, as token files below folder.

    Returns a row for each file: path, part (their order), n_docs, n_tokens, start (tokens of all files before). A
    retried task writes a file of another name, and only files of tasks that succeeded are in the result.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end, writer, sink = struct.pack("<I", end_id), None, None
        fs, root = pa.fs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.tok.zst"
        for batch, texts in slices(batches, "text"):
            if writer is None:
                fs.create_dir(root, recursive=True)
                sink = fs.open_output_stream(f"{root}/{name}", compression=None)
                writer = FrameWriter(sink)
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder(tokenizer_path).encode(texts), strict=True):
                writer.add(doc_id, ids + end)
        if writer:
            writer.close()
            sink.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "part": pa.array([task.partitionId()], pa.int32()), "n_docs": [len(writer.doc_ids)], "n_tokens": [sum(writer.counts)]})

    # a doc_id that many rows share (null, say) has ranges by what texts begin with; whole texts would go to the driver
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.substring("text", 1, 128).alias("begin"))
    ordered = rows.repartitionByRange("doc_id", "begin").sortWithinPartitions("doc_id", "text").select("doc_id", "text")
    files = settle(ordered.mapInArrow(write, "path string, part int, n_docs long, n_tokens long"), "token-manifest")
    # a row for each file, so one task can sum them
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_token_files(files: DataFrame) -> DataFrame:
    """A row for each document of the files: doc_id, start, n_tokens, ids_crc32, read from the files themselves."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, name = pa.fs.FileSystem.from_uri(path)
                with fs.open_input_file(name) as source:
                    reader = FrameReader(source, source.size())
                    crcs = [zlib.crc32(reader.ids(i)) for i in range(len(reader.doc_ids))]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array(reader.doc_ids, pa.int64()),
                        "start": pa.array([base + x for x in accumulate(reader.counts.tolist(), initial=0)][:-1], pa.int64()),
                        "n_tokens": pa.array(reader.counts, pa.int64()),
                        "ids_crc32": pa.array(crcs, pa.int64()),
                    }
                )

    n = max(1, files.count())
    return files.select("path", "start").repartition(n).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_index(docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """Writes docs as token files in the shared folder and returns what reading them back gives for each document."""
    folder = scratch(docs.sparkSession, "tokens")
    return read_token_files(write_token_files(docs, folder, tokenizer_path, end_id))
