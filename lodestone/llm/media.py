"""Media columns: baseline JPEG.

`write_jpegs` stores a payload in a baseline grey JPEG without loss: each 8 x 8 block's 64 quantised coefficients, in
the format's zigzag order and with quantisers of 1, are 64 payload bytes as signed numbers. `read_jpegs` parses the
markers, Huffman-decodes the scan and gives dimensions and coefficients; the luminance thumbnail comes from the DC
coefficients alone, one pixel for each block. Both work on many images at once: each row of blocks is a restart
interval, which begins at a byte of its own, and numpy takes one code of every interval at a time.

`read_jpegs` takes any baseline file of one component, with or without restart markers and with any tables.

Defined cases: a null or empty text has one block of zeros; equal texts have equal files; repeated rows and null
doc_ids are kept as they are; an empty table gives an empty result; further columns are ignored; texts of any length
are stored whole, in wider images once they have too many rows.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Bytes of payload that are coded together, besides one image.
CODE_BYTES = 2 << 20
#: Blocks in a row of blocks of small images, and most rows of an image.
ROW_BLOCKS, MOST_ROWS = 8, 8191


def huffman_lengths(weights: dict[int, int]) -> dict[int, int]:
    """Code lengths for the weights; one code more is reserved, so that no code is all ones."""
    heap = [(w, s, [s]) for s, w in weights.items()] + [(0, 1 << 9, [None])]
    heapq.heapify(heap)
    lengths = dict.fromkeys([*weights, None], 0)
    while len(heap) > 1:
        (w, s, a), (v, t, b) = heapq.heappop(heap), heapq.heappop(heap)
        for x in a + b:
            lengths[x] += 1
        heapq.heappush(heap, (w + v, min(s, t), a + b))
    del lengths[None]
    if max(lengths.values()) > 16:
        raise ValueError("a code is longer than 16 bits")
    return lengths


def canonical(bits: list[int], symbols: list[int]) -> dict[int, tuple[int, int]]:
    """symbol: (code, length), as the format assigns them from the counts of lengths 1 to 16."""
    out, code, at = {}, 0, 0
    for length, n in enumerate(bits, 1):
        for _ in range(n):
            out[symbols[at]] = code, length
            code, at = code + 1, at + 1
        code <<= 1
    return out


def _table(weights: dict[int, int]) -> tuple[list[int], list[int]]:
    lengths = huffman_lengths(weights)
    symbols = sorted(lengths, key=lambda s: (lengths[s], s))
    return [sum(1 for s in symbols if lengths[s] == n) for n in range(1, 17)], symbols


#: Rules for the tables: letters are numbers of 7 bits, marks and spaces of 6, and zeros are rare but at the end.
DC_TABLE = _table({s: 1 << (12 - abs(s - 5)) for s in range(12)})
AC_TABLE = _table({(r << 4) | s: max(24, (1 << 16) >> (3 * r + 2 * abs(s - 7) - (s == 6))) for r in range(16) for s in range(1, 11)} | {0x00: 1 << 11, 0xF0: 24})


def _arrays(table: tuple[list[int], list[int]]) -> tuple[np.ndarray, np.ndarray]:
    codes, lengths = np.zeros(256, np.int64), np.zeros(256, np.int64)
    for s, (c, n) in canonical(*table).items():
        codes[s], lengths[s] = c, n
    return codes, lengths


DC_CODES, DC_LENGTHS = _arrays(DC_TABLE)
AC_CODES, AC_LENGTHS = _arrays(AC_TABLE)


def bit_sizes(x: np.ndarray) -> np.ndarray:
    """Bits of each absolute value."""
    return np.frexp(np.abs(x).astype(np.float32))[1].astype(np.int64)


def _bits(x: np.ndarray, codes: np.ndarray, lengths: np.ndarray, run: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The whole code of each number after `run` zeros, and its length: the symbol's code, then the number's bits."""
    size = bit_sizes(x)
    symbol = run << 4 | size
    return (codes[symbol] << size | np.where(x < 0, x + (1 << size) - 1, x)).astype(np.uint32), (lengths[symbol] + size).astype(np.uint8)


DC_VALUES, DC_SIZES = _bits(np.arange(-255, 256), DC_CODES, DC_LENGTHS)
AC_VALUES, AC_SIZES = (np.stack(x) for x in zip(*(_bits(np.arange(256, dtype=np.uint8).view(np.int8).astype(np.int64), AC_CODES, AC_LENGTHS, r) for r in range(16)), strict=True))


def shape_of(n_blocks: int) -> tuple[int, int]:
    """Columns and rows of blocks."""
    columns = ROW_BLOCKS
    while -(-n_blocks // columns) > MOST_ROWS:
        columns *= 2
    columns = min(columns, n_blocks)
    return columns, -(-n_blocks // columns)


def pack_bits(values: np.ndarray, sizes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, ends): values of the given sizes in bits (most 32) put after each other; where `first` is set a value
    begins a byte, and what is left of the byte before is filled with ones. ends: where each such run of bytes ends."""
    begins = np.flatnonzero(first)
    run_bits = np.add.reduceat(sizes, begins)
    run_bytes = (run_bits + 7) // 8
    ends = np.cumsum(run_bytes)
    before = np.cumsum(sizes) - sizes
    runs = np.diff(np.append(begins, len(sizes)))
    at = before - np.repeat(before[begins], runs) + np.repeat((ends - run_bytes) * 8, runs)
    fill = run_bytes * 8 - run_bits
    # fillers go in as values, too
    where = np.concatenate([at, ends * 8 - fill])
    what = np.concatenate([values, (1 << fill) - 1])
    size = np.concatenate([sizes, fill])
    word = where >> 5
    shifted = what.astype(np.uint64) << (64 - (where & 31) - size).astype(np.uint64)
    out = np.zeros(int(ends[-1]) // 4 + 3, dtype=np.uint32)
    n = len(values)
    for part in (slice(0, n), slice(n, None)):  # each is in ascending order
        w, x = word[part], shifted[part]
        heads = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
        joined = np.bitwise_or.reduceat(x, heads)
        out[w[heads]] |= (joined >> np.uint64(32)).astype(np.uint32)
        out[w[heads] + 1] |= (joined & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return out.byteswap().view(np.uint8)[: int(ends[-1])], ends


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def header(columns: int, rows: int) -> bytes:
    """All markers before the scan's data."""
    out = b"\xff\xd8" + _segment(0xDB, b"\0" + b"\1" * 64)
    out += _segment(0xC0, struct.pack(">BHHB", 8, rows * 8, columns * 8, 1) + b"\1\x11\0")
    for place, (bits, symbols) in ((0x00, DC_TABLE), (0x10, AC_TABLE)):
        out += _segment(0xC4, bytes([place, *bits, *symbols]))
    return out + _segment(0xDD, struct.pack(">H", columns)) + _segment(0xDA, b"\1\1\0\0\x3f\0")


def write_jpegs(payloads: list[bytes]) -> list[bytes]:
    """Each payload, a positive multiple of 64 bytes long, as a file."""
    shapes = [shape_of(len(p) // 64) for p in payloads]
    padded = [p + bytes(64 * c * r - len(p)) for p, (c, r) in zip(payloads, shapes, strict=True)]
    blocks = np.frombuffer(b"".join(padded), dtype=np.int8).reshape(-1, 64)
    n = len(blocks)
    per_row = np.concatenate([np.full(r, c) for c, r in shapes])
    row_start = np.zeros(n, dtype=bool)
    row_start[np.cumsum(per_row) - per_row] = True
    # DC: the difference to the block before, within a row
    dc = blocks[:, 0].astype(np.int64)
    delta = dc - np.where(row_start, 0, np.concatenate([[0], dc[:-1]]))
    # a slot for the DC code, one for each AC code and one for the end of block; most blocks have no zero
    values, sizes = np.zeros((n, 65), dtype=np.uint32), np.zeros((n, 65), dtype=np.uint8)
    values[:, 0], sizes[:, 0] = DC_VALUES[delta + 255], DC_SIZES[delta + 255]
    ac = blocks[:, 1:].view(np.uint8)
    full = (ac != 0).all(axis=1)
    if full.all():
        values[:, 1:64], sizes[:, 1:64] = AC_VALUES[0][ac], AC_SIZES[0][ac]
    else:
        values[full, 1:64], sizes[full, 1:64] = AC_VALUES[0][ac[full]], AC_SIZES[0][ac[full]]
    rest = np.flatnonzero(~full)
    block, place = np.nonzero(ac[rest])
    block = rest[block]
    last = np.full(n, -1)
    last[block] = place  # the last one stays
    short = np.flatnonzero(~full & (last < 62))
    values[short, 64], sizes[short, 64] = AC_CODES[0x00], AC_LENGTHS[0x00]
    long_at, long_times = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(block):
        new = np.concatenate([[True], block[1:] != block[:-1]])
        run = place - np.where(new, -1, np.concatenate([[0], place[:-1]])) - 1
        values[block, place + 1] = AC_VALUES[run & 15, ac[block, place]]
        sizes[block, place + 1] = AC_SIZES[run & 15, ac[block, place]]
        far = np.flatnonzero(run > 15)
        long_at, long_times = block[far] * 65 + place[far] + 1, run[far] >> 4
    values, sizes = values.reshape(-1), sizes.reshape(-1)
    first = np.zeros(n * 65, dtype=bool)
    first[np.flatnonzero(row_start) * 65] = True
    if len(long_at):  # codes for 16 zeros go before the value's
        where = np.repeat(long_at, long_times)
        values = np.insert(values, where, AC_CODES[0xF0])
        sizes = np.insert(sizes, where, AC_LENGTHS[0xF0])
        first = np.insert(first, where, False)
    used = sizes > 0
    if not used.all():
        values, sizes, first = values[used], sizes[used], first[used]
    data, ends = pack_bits(values, sizes.astype(np.int64), first)
    stuffed = np.cumsum(data == 0xFF)
    out_ends = ends + stuffed[ends - 1]
    scan = np.repeat(data, 1 + (data == 0xFF))
    places = np.flatnonzero(data == 0xFF)
    scan[places + np.arange(len(places)) + 1] = 0
    body, at, row = scan.tobytes(), 0, 0
    files = []
    for columns, rows in shapes:
        parts = [header(columns, rows)]
        for i in range(rows):
            end = int(out_ends[row])
            if i:
                parts.append(bytes([0xFF, 0xD0 + (i - 1) % 8]))
            parts.append(body[at:end])
            at, row = end, row + 1
        files.append(b"".join(parts) + b"\xff\xd9")
    return files


class Jpeg:
    """The markers of one file."""

    def __init__(self, data: bytes):
        if data[:2] != b"\xff\xd8":
            raise ValueError("no JPEG file")
        self.tables: dict[int, tuple[list[int], list[int]]] = {}
        self.interval, at = 0, 2
        while True:
            if data[at] != 0xFF:
                raise ValueError("no marker where one belongs")
            marker = data[at + 1]
            if marker == 0xFF:
                at += 1
                continue
            (length,) = struct.unpack_from(">H", data, at + 2)
            body = data[at + 4 : at + 2 + length]
            at += 2 + length
            if marker == 0xC0:
                precision, self.height, self.width, components = struct.unpack_from(">BHHB", body)
                if precision != 8 or components != 1:
                    raise ValueError("only 8 bits and one component are read")
            elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                raise ValueError("only baseline files are read")
            elif marker == 0xC4:
                k = 0
                while k < len(body):
                    bits = list(body[k + 1 : k + 17])
                    self.tables[body[k]] = bits, list(body[k + 17 : k + 17 + sum(bits)])
                    k += 17 + sum(bits)
            elif marker == 0xDB:
                k = 0
                while k < len(body):
                    wide = body[k] >> 4
                    if body[k] & 15 == 0:
                        self.quantiser = struct.unpack_from(">H", body, k + 1)[0] if wide else body[k + 1]
                    k += 1 + 64 * (1 + wide)
            elif marker == 0xDD:
                (self.interval,) = struct.unpack(">H", body)
            elif marker == 0xDA:
                self.table_ids = body[2] >> 4, 0x10 | body[2] & 15
                break
        self.columns, self.rows = -(-self.width // 8), -(-self.height // 8)
        self.scan = data[at : data.rindex(b"\xff\xd9")]


def _lookup(table: tuple[list[int], list[int]]) -> np.ndarray:
    """For every 16 bits: the first code's symbol and its length, as symbol << 8 | length; 0 where there is none."""
    out = np.zeros(1 << 16, dtype=np.int32)
    for s, (code, length) in canonical(*table).items():
        out[code << (16 - length) : (code + 1) << (16 - length)] = s << 8 | length
    return out


LOOKUPS: dict[tuple, np.ndarray] = {}


def lookup(table: tuple[list[int], list[int]]) -> np.ndarray:
    key = tuple(table[0]), tuple(table[1])
    if key not in LOOKUPS:
        if len(LOOKUPS) > 64:
            LOOKUPS.clear()
        LOOKUPS[key] = _lookup(table)
    return LOOKUPS[key]


def decode_scans(scans: list[bytes], blocks: list[int], intervals: list[int], dc: np.ndarray, ac: np.ndarray) -> list[np.ndarray]:
    """Coefficients, in zigzag order, of scans that share their tables. blocks: of each scan; intervals: blocks between
    restarts, 0 for none."""
    raw = np.frombuffer(b"".join(scans), dtype=np.uint8)
    scan_ends = np.cumsum([len(s) for s in scans])
    ff = np.flatnonzero(raw[:-1] == 0xFF) if len(raw) else np.zeros(0, np.int64)
    ff = ff[~np.isin(ff + 1, scan_ends)]
    after = raw[ff + 1]
    restart = ff[(after >= 0xD0) & (after <= 0xD7)]
    keep = np.ones(len(raw), dtype=bool)
    keep[ff[after == 0] + 1] = False
    keep[restart] = keep[restart + 1] = False
    data = np.concatenate([raw[keep], np.zeros(16, dtype=np.uint8)])
    kept_before = np.cumsum(keep) - keep
    starts = np.sort(np.concatenate([np.append(0, scan_ends[:-1]), restart + 2]))
    lane_at = np.where(starts < len(raw), kept_before[np.minimum(starts, max(0, len(raw) - 1))], len(data) - 16)
    counts, firsts, total = [], [], 0
    for n, k in zip(blocks, intervals, strict=True):
        k = k or n
        sizes = [k] * (n // k) + ([n % k] if n % k else [])
        counts += sizes
        firsts += [total + k * i for i in range(len(sizes))]
        total += n
    if len(counts) != len(lane_at):
        raise ValueError("restart markers and intervals don't match")
    window = np.zeros(len(data) - 8, dtype=np.uint64)
    for i in range(8):
        window = window << np.uint64(8) | data[i : i + len(window)]
    out = np.zeros((total, 64), dtype=np.int16)
    flat = out.reshape(-1)
    bit = lane_at.astype(np.int64) * 8
    left = np.array(counts, dtype=np.int64)
    block = np.array(firsts, dtype=np.int64)
    place, previous = np.zeros(len(left), dtype=np.int64), np.zeros(len(left), dtype=np.int64)
    both = np.concatenate([ac, dc])
    mask = np.array([(1 << s) - 1 for s in range(17)], dtype=np.int64)
    half = np.array([0] + [1 << (s - 1) for s in range(1, 17)], dtype=np.int64)
    limit = len(window) * 8
    while len(left):
        if int(bit.max()) >= limit:
            raise ValueError("a scan ends too early")
        w = window[bit >> 3] << (bit & 7).astype(np.uint64)
        is_dc = place == 0
        hit = both[(w >> np.uint64(48)).astype(np.int64) + (is_dc << 16)]
        length, symbol = hit & 255, (hit >> 8).astype(np.int64)
        if not length.all():
            raise ValueError("no such code")
        size = symbol & 15
        value = ((w << length.astype(np.uint64)) >> np.uint64(48)).astype(np.int64) >> (16 - size)
        value = np.where(value < half[size], value - mask[size], value)
        bit += length + size
        place += np.where(is_dc, 0, symbol >> 4)
        previous = np.where(is_dc, previous + value, previous)
        stop = ~is_dc & (symbol == 0)
        some = (size > 0) | is_dc
        target = block * 64 + place
        flat[target[some]] = np.where(is_dc, previous, value)[some]
        place += 1
        over = stop | (place > 63)
        if over.any():
            block += over
            left = left - over
            place[over] = 0
            done = left == 0
            if done.any():
                live = ~done
                bit, left, block, place, previous = bit[live], left[live], block[live], place[live], previous[live]
    return np.split(out, np.cumsum(blocks)[:-1])


def read_jpegs(files: list[bytes]) -> list[tuple[Jpeg, np.ndarray]]:
    """(markers, coefficients of each block in zigzag order) of each file."""
    parsed = [Jpeg(f) for f in files]
    groups: dict[tuple, list[int]] = {}
    for i, p in enumerate(parsed):
        groups.setdefault(tuple((tuple(p.tables[t][0]), tuple(p.tables[t][1])) for t in p.table_ids), []).append(i)
    out: list = [None] * len(files)
    for members in groups.values():
        dc, ac = (lookup(parsed[members[0]].tables[t]) for t in parsed[members[0]].table_ids)
        found = decode_scans([parsed[i].scan for i in members], [parsed[i].columns * parsed[i].rows for i in members], [parsed[i].interval for i in members], dc, ac)
        for i, x in zip(members, found, strict=True):
            out[i] = parsed[i], x
    return out


def thumbnail(markers: Jpeg, coefficients: np.ndarray) -> np.ndarray:
    """Luminance, a pixel for each block: a block's mean is its DC coefficient over 8, and 128."""
    level = (coefficients[:, 0].astype(np.int64) * markers.quantiser + 4 >> 3) + 128
    return np.clip(level, 0, 255).astype(np.uint8).reshape(markers.rows, markers.columns)


def thumbnail_hash(pixels: np.ndarray) -> str:
    """64 bits: of an 8 x 8 reduction of the thumbnail, which cells lie above the mean."""
    def cells(n: int) -> np.ndarray:
        return np.arange(8) * n // 8

    rows, columns = pixels.shape
    small = pixels.astype(np.int64)
    sums = np.zeros((rows + 1, columns + 1), dtype=np.int64)
    sums[1:, 1:] = small.cumsum(0).cumsum(1)
    r0, c0 = cells(rows), cells(columns)
    r1, c1 = np.maximum(r0 + 1, (np.arange(8) + 1) * rows // 8), np.maximum(c0 + 1, (np.arange(8) + 1) * columns // 8)
    total = sums[r1][:, c1] - sums[r0][:, c1] - sums[r1][:, c0] + sums[r0][:, c0]
    area = (r1 - r0)[:, None] * (c1 - c0)[None, :]
    above = total * rows * columns > int(sums[-1, -1]) * area
    return np.packbits(above.reshape(-1)).tobytes().hex()


def payload_of(text: bytes | None) -> bytes:
    text = text or b""
    return text + bytes((-len(text)) % 64 or (64 if not text else 0))


def media(docs: DataFrame, with_files: bool = False) -> DataFrame:
    """For each row of docs: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256 and
    feature (width x height : thumbnail hash); with_files: also the file."""

    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text", CODE_BYTES):
            files = write_jpegs([payload_of(t) for t in texts])
            rows = []
            for text, file, (markers, found) in zip(texts, files, read_jpegs(files), strict=True):
                n = len(text or b"")
                size = -(-max(n, 1) // 64) * 64
                payload = found.astype(np.int8).tobytes()[:size]
                w, h = markers.width, markers.height
                rows.append([n, size, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(file), hashlib.sha256(file).hexdigest(), f"{w}x{h}:{thumbnail_hash(thumbnail(markers, found))}"])
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            if with_files:
                columns.append(pa.array(files, pa.binary()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *names, *(["file"] if with_files else [])])

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", file binary" * with_files
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)
