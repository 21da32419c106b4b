"""SentencePiece encoding and decoding that keeps offsets.

`Normaliser` reads the compiled character map of a model file (a double array over UTF-8 bytes): at each place the
longest prefix it knows is replaced, and every byte of the result remembers the bytes it came from. Only places whose
first bytes the map knows are walked one by one; what lies between is copied at once.

`PieceEncoder` gives each text to the library and projects every piece back through that alignment. A piece's span goes
from where its first byte came from to where the next piece's first byte came from, the library's own rule: spans tile
the text, and of the pieces of one character all but the last have an empty span.

Texts of more than PART_BYTES are encoded in parts, cut before a space, where the model's pieces hold a mark for a space
only at their start and the map is empty: then no piece lies across a cut, and the ids are those of the whole text. With
any other model they go to the library whole. Models with user-defined pieces, or with marks after words, are refused.

Defined cases: a null or empty text holds only the begin and end ids and decodes to an empty text; invalid bytes count
as U+FFFD; repeated rows, ties and null doc_ids are kept as they are; an empty table gives an empty result; further
columns are ignored; texts of any length are encoded whole.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH_BYTES, slices

#: U+2581, which stands for a space in pieces.
MARK = "▁".encode()
#: Bytes of text that the library gets at once, where a text may be cut.
PART_BYTES = 1 << 20
#: Bytes of text in a batch whose lists are returned.
LIST_BYTES = 2 << 20
#: A space between two other characters.
GAP = re.compile(rb"(?<=[^ ]) (?=[^ ])")


def proto_fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(data):
        key = number()
        if key & 7 == 0:
            value: int | bytes = number()
        else:
            size = number() if key & 7 == 2 else 8 if key & 7 == 1 else 4
            value = data[at : at + size]
            at += size
        yield key >> 3, value


class Normaliser:
    """Of a model: its compiled map and its white space rules."""

    def __init__(self, model: bytes):
        spec = next((v for k, v in proto_fields(model) if k == 3), b"")
        found = dict(proto_fields(spec))
        self.dummy_prefix, self.squeeze, self.mark = (bool(found.get(k, 1)) for k in (3, 4, 5))
        blob = found.get(2, b"")
        self.units: tuple[int, ...] = ()
        self.strings = b""
        #: By the first two bytes (of a text's last byte: and 0), whether the map may know a prefix that starts so.
        self.starts = np.zeros(1 << 16, dtype=bool)
        if blob:
            (size,) = struct.unpack_from("<I", blob)
            self.units, self.strings = struct.unpack_from(f"<{size // 4}I", blob, 4), blob[4 + size :]
            root = self._offset(self.units[0])
            for one in range(1, 256):
                if self._is(root ^ one, one):
                    unit = self.units[root ^ one]
                    below = root ^ one ^ self._offset(unit)
                    self.starts[one << 8 : (one + 1) << 8] = [unit >> 8 & 1 or self._is(below ^ two, two) for two in range(256)]

    def _is(self, node: int, byte: int) -> bool:
        return node < len(self.units) and self.units[node] & 0x800000FF == byte

    @property
    def plain(self) -> bool:
        return not self.units and not self.squeeze and self.dummy_prefix and self.mark

    def longest(self, data: bytes, at: int) -> tuple[bytes, int]:
        """What replaces the longest known prefix of data[at:], and its length; else the next character as it is."""
        found, size, node = None, 0, 0
        if self.units:
            node = self._offset(self.units[0])
            for k in range(at, len(data)):
                node ^= data[k]
                if not self._is(node, data[k]):
                    break
                unit = self.units[node]
                node ^= self._offset(unit)
                if unit >> 8 & 1:
                    found, size = self.units[node] & 0x7FFFFFFF, k - at + 1
        if found is not None:
            return self.strings[found : self.strings.index(b"\0", found)], size
        head = data[at]
        return data[at : at + sizes_of(head)], sizes_of(head)

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def _mapped(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bytes after the map, start and end in data of what each of them came from)."""
        raw = np.frombuffer(data, dtype=np.uint8)
        heads = np.flatnonzero((raw & 0xC0) != 0x80)
        sizes = np.diff(heads, append=len(raw))
        starts, ends = np.repeat(heads, sizes), np.repeat(heads + sizes, sizes)
        if not self.units:
            return raw, starts, ends
        pair = raw.astype(np.uint16) << 8
        pair[:-1] |= raw[1:]
        parts, at = [], 0
        for place in np.flatnonzero(self.starts[pair]).tolist():
            if place < at:
                continue
            what, size = self.longest(data, place)
            parts.append((raw[at:place], starts[at:place], ends[at:place]))
            parts.append((np.frombuffer(what, dtype=np.uint8), np.full(len(what), place), np.full(len(what), place + size)))
            at = place + size
        parts.append((raw[at:], starts[at:], ends[at:]))
        return tuple(np.concatenate([p[i] for p in parts]) for i in range(3))

    def align(self, data: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
        """(normal form, origin, end): origin has where in data each of its bytes came from and, last, where the text
        that it stands for ends; end has where what each byte came from ends. data: valid UTF-8."""
        raw, starts, ends = self._mapped(data)
        lead, stop = 0, len(data)
        if self.squeeze:  # white space at both ends goes, and runs become one
            while lead < stop and (first := self.longest(data, lead))[0] == b" ":
                lead += first[1]
            if lead == stop:
                return b"", np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.int64)
            blank = raw == 32
            keep = ~(blank & np.concatenate([[True], blank[:-1]])) if len(raw) else blank
            raw, starts, ends = raw[keep], starts[keep], ends[keep]
        if self.dummy_prefix and lead < len(data):
            raw, starts, ends = np.concatenate([[32], raw]).astype(np.uint8), np.concatenate([[lead], starts]), np.concatenate([[lead], ends])
        if self.mark and len(raw):
            blank = raw == 32
            sizes = np.where(blank, len(MARK), 1)
            at = np.cumsum(sizes) - sizes
            raw, starts, ends = np.repeat(raw, sizes), np.repeat(starts, sizes), np.repeat(ends, sizes)
            for i, byte in enumerate(MARK):
                raw[at[blank] + i] = byte
        normal, space = raw.tobytes(), MARK if self.mark else b" "
        n = len(normal) if self.squeeze else 0
        while n and normal.endswith(space, 0, n):
            n -= len(space)
            normal, starts, ends, stop = normal[:n], starts[:n], ends[:n], int(starts[n])
        return normal, np.append(starts, stop), ends

    def normalise(self, data: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
        """(normal form, start and end in data of each of its bytes)."""
        normal, origin, ends = self.align(data)
        return normal, origin[:-1], ends


def sizes_of(head: int) -> int:
    """Bytes of the character that starts so."""
    return 1 if head < 0x80 else 2 if head < 0xE0 else 3 if head < 0xF0 else 4


class PieceEncoder:
    def __init__(self, path: str | None = None, model: bytes | None = None):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path) if path else sentencepiece.SentencePieceProcessor(model_proto=model)
        proto = self.model.serialized_model_proto()
        if any(dict(proto_fields(v)).get(3) == 4 for k, v in proto_fields(proto) if k == 1):
            raise ValueError("the model has user-defined pieces, which the character map doesn't reach")
        if any(dict(proto_fields(v)).get(24) for k, v in proto_fields(proto) if k == 2):
            raise ValueError("the model marks the ends of words")
        self.normaliser = Normaliser(proto)
        n = self.model.get_piece_size()
        names = [self.model.id_to_piece(i) for i in range(n)]
        #: Bytes of the normal form that each id stands for; -1 for the unknown piece.
        self.sizes = np.array([1 if self.model.is_byte(i) else -1 if self.model.is_unknown(i) else len(x.encode()) for i, x in enumerate(names)], dtype=np.int64)
        self.by_word = self.normaliser.plain and "▁" in names and all("▁" not in x.lstrip("▁") for x in names)

    def parts(self, text: bytes) -> list[tuple[int, int]]:
        """(start, end) of the parts that the library gets; all but the first start at a space."""
        cuts = [0]
        if len(text) > PART_BYTES and self.by_word and MARK not in text:
            while m := GAP.search(text, cuts[-1] + PART_BYTES):
                cuts.append(m.start())
        return list(zip(cuts, [*cuts[1:], len(text)], strict=True))

    def encode(self, texts: list[bytes]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
        """For each text (valid UTF-8), its ids and the start and end of each id's span of bytes."""
        whole = [i for i, t in enumerate(texts) if len(t) <= PART_BYTES]
        found = dict(zip(whole, self.model.encode([texts[i].decode() for i in whole], num_threads=1), strict=True))
        for i, text in enumerate(texts):
            if i in found:
                yield self._aligned(text, found[i])
                continue
            ids, starts, ends = [], [], []
            for a, b in self.parts(text):
                part = text[a + (a > 0) : b]  # the library's own mark at the start stands for the space
                own = self._aligned(part, self.model.encode(part.decode(), num_threads=1))
                ids += own[0]
                if a:
                    own[1][1:] += a + 1
                    own[1][0] = a
                    own[2][:] += a + 1
                starts.append(own[1])
                ends.append(own[2])
            yield ids, np.concatenate(starts), np.concatenate(ends)

    def _aligned(self, text: bytes, ids: list[int]) -> tuple[list[int], np.ndarray, np.ndarray]:
        normal, origin, _ = self.normaliser.align(text)
        sizes = self.sizes[ids] if ids else np.zeros(0, dtype=np.int64)
        if (sizes < 0).any():  # an unknown piece covers what lies between its neighbours
            names, k, rest = [self.model.id_to_piece(i).encode() if s >= 0 else None for i, s in zip(ids, sizes, strict=True)], 0, []
            for j, s in enumerate(sizes.tolist()):
                if s < 0:
                    after = next((x for x in names[j + 1 :] if x is not None), None)
                    at = normal.find(after, k + 1) if after else len(normal)
                    s = (at if at >= 0 else len(normal)) - k
                rest.append(s)
                k += s
            sizes = np.array(rest, dtype=np.int64)
        bounds = origin[np.concatenate([[0], np.cumsum(sizes)])]
        return ids, bounds[:-1].copy(), bounds[1:].copy()


ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One for each worker, kept between tasks."""
    if path not in ENCODERS:
        ENCODERS[path] = PieceEncoder(path)
    return ENCODERS[path]


def encode_documents(docs: DataFrame, model_path: str, lists: tuple[str, ...] = ()) -> DataFrame:
    """For each row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256, n_bytes, spans_crc32 (of all starts and ends
    as little-endian 64-bit integers), and those of the lists ids, starts, ends (of the pieces' spans) and decoded (the
    text) that are asked for."""
    kinds = {"ids": (pa.list_(pa.int32()), "array<int>"), "starts": (pa.list_(pa.int64()), "array<long>"), "ends": (pa.list_(pa.int64()), "array<long>"), "decoded": (pa.string(), "string")}
    fields = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("n_bytes", pa.int64()), ("spans_crc32", pa.int64()), *((x, kinds[x][0]) for x in lists)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(model_path)
        begin, end = coder.model.bos_id(), coder.model.eos_id()
        for batch, texts in slices(batches, "text", LIST_BYTES if lists else BATCH_BYTES):
            bodies = [(t or b"").decode("utf-8", "replace").encode() if t and not t.isascii() else t or b"" for t in texts]
            rows = []
            for text, (ids, starts, ends) in zip(bodies, coder.encode(bodies), strict=True):
                all_ids = [begin, *ids, end]
                decoded = coder.model.decode(all_ids)
                row = [len(all_ids), hashlib.sha256(np.array(all_ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), len(text), zlib.crc32(ends.astype("<i8").tobytes(), zlib.crc32(starts.astype("<i8").tobytes()))]
                whole = {"ids": all_ids, "starts": starts, "ends": ends, "decoded": decoded}
                rows.append([*row, *(whole[x] for x in lists)])
            columns = [pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(fields)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *(name for name, _ in fields)])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long, spans_crc32 long" + "".join(f", {x} {kinds[x][1]}" for x in lists)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)
