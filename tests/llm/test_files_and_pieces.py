"""Token files, pieces and media: exact round trips against the libraries."""

import hashlib
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import media, pieces, token_files
from lodestone.llm.queries import tokenizer

WORD, PIECE = tokenizer("word_bpe_49k.json"), tokenizer("piece_bpe_32k.model")


def key(row):
    return repr(tuple(row))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORD)


def test_token_index(odd, texts, library):
    got = sorted(((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_files.token_index(odd, WORD).collect()), key=lambda r: r[1])
    rows = sorted(((d, t) for d, t, *_ in texts), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    expected, at = [], 0
    for d, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        expected.append((d, at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        at += len(ids)
    assert got == expected


def test_token_index_of_nothing(none):
    assert token_files.token_index(none, WORD).collect() == []


def test_reader_takes_what_is_asked(odd, texts, library, tmp_path):
    files = token_files.write_token_files(odd.where("doc_id is not null"), f"file://{tmp_path}/t", WORD, 2).collect()
    path = files[0]["path"]
    found = token_files.read_documents(path, [10, 5])
    by_id = {d: t for d, t, *_ in texts}
    assert all(v.tolist() == library.encode(by_id[k], add_special_tokens=False).ids + [2] for k, v in found.items())
    raw = open(path.removeprefix("file://"), "rb")
    reader = token_files.FrameReader(raw, raw.seek(0, 2))
    reader.ids(0)
    assert reader.decompressed <= 1 < len(reader.frames)
    data = bytearray(open(path.removeprefix("file://"), "rb").read())
    reader.frames = reader.frames.copy()
    reader.frames[0, 2] ^= 1
    reader.cache = (-1, b"")
    with pytest.raises(ValueError, match="checksum"):
        reader.frame(0)
    import zstandard

    whole = zstandard.ZstdDecompressor().stream_reader(bytes(data), read_across_frames=True).read()
    assert len(whole) == 4 * sum(r["n_tokens"] for r in files[:1])


@pytest.mark.parametrize("text", [" ", "a ", "a  ", " \t\n ", "a\n b ", "\u2581", "a\u2581 b ", "\u2581 "])
def test_spaces_at_the_end(text):
    coder = pieces.encoder(PIECE)
    ids, _, ends = next(iter(coder.encode([text.encode()])))
    assert ids == coder.model.encode(text)
    assert ends[-1] == len(text.encode())


MIXED = st.text(st.one_of(st.sampled_from("abcXYZ019 .,'!?$-_\n\t▁éÉßΣς　\xa0\x1ć"), st.characters(exclude_categories=["Cs"])), max_size=60)


@settings(max_examples=300, deadline=None)
@given(MIXED)
def test_words_equal_whole_texts(text):
    coder = token_files.encoder(WORD)
    assert np.frombuffer(coder.encode([text.encode()])[0], "<u4").tolist() == coder.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["日本語テキスト" * 400, "x" * 5000 + " " + "y" * 300, "a b " * 3000, "é" * 257 + "<|endoftext|>" + "w" * 700, ""])
def test_words_under_a_budget(text, monkeypatch, library):
    """Long words aren't remembered, and what is remembered stays near its bound."""
    coder = token_files.WordEncoder(WORD)
    monkeypatch.setattr(token_files, "KNOWN_BYTES", 10_000)
    monkeypatch.setattr(token_files, "PART_BYTES", 1_000)
    texts = [f"{text} {i} word{i} {text[:200]}" for i in range(30)]
    assert [np.frombuffer(x, "<u4").tolist() for x in coder.encode([t.encode() for t in texts])] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert max(map(len, coder.known), default=0) <= token_files.WORD_BYTES
    assert sum(len(k) + len(v) for k, v in coder.known.items()) <= coder.held <= 10_000 + 260 * (token_files.WORD_COST + 1_000)


def test_other_tokenizers_get_whole_texts(tmp_path, library):
    import json

    rules = json.load(open(WORD))
    assert token_files.WordEncoder(WORD).by_word
    rules["pre_tokenizer"] = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
    path = str(tmp_path / "other.json")
    json.dump(rules, open(path, "w"))
    coder = token_files.WordEncoder(path)
    assert not coder.by_word
    texts = ["one two  three.", "", "a\nb c"]
    assert [np.frombuffer(x, "<u4").tolist() for x in coder.encode([t.encode() for t in texts])] == [coder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert coder.tokenizer.encode(texts[0]).ids != library.encode(texts[0]).ids


def library_spans(model, text):
    return [(p.id, p.begin, p.end) for p in model.encode(text, return_type="proto").pieces]


def with_map(rule: str, **options) -> bytes:
    """The given model with the library's own compiled map of a rule in place of its own."""
    import sentencepiece

    other = sentencepiece.SentencePieceNormalizer(rule_name=rule, **options).serialized_model_proto()
    spec = next(v for k, v in pieces.proto_fields(other) if k == 3)
    return b"".join(field(k, v) for k, v in pieces.proto_fields(open(PIECE, "rb").read()) if k != 3) + field(3, spec)


@settings(max_examples=300, deadline=None)
@given(MIXED)
def test_pieces_equal_library(text):
    """Ids and spans, of the given model."""
    coder = pieces.encoder(PIECE)
    (ids, starts, ends), data = next(iter(coder.encode([text.encode()]))), text.encode()
    assert list(zip(ids, starts.tolist(), ends.tolist(), strict=True)) == library_spans(coder.model, text)
    if len(ids):
        assert (starts[0], ends[-1]) == (0, len(data))
        assert (starts[1:] == ends[:-1]).all()


EXPANDING = st.text(st.one_of(st.sampled_from("abXY 1.\n\t▁éß　\xa0\x1cﬁﬂ½Ａ㌀㍿\u200b\xadΣ\u0301"), st.characters(exclude_categories=["Cs"])), max_size=40)


@pytest.fixture(scope="module")
def mapped():
    return [pieces.PieceEncoder(model=with_map(rule)) for rule in ("nmt_nfkc", "nfkc_cf")]


@settings(max_examples=400, deadline=None)
@given(EXPANDING)
def test_spans_through_a_compiled_map(mapped, text):
    """Characters that the map expands, joins and drops: ids and spans are the library's own."""
    for coder in mapped:
        ids, starts, ends = next(iter(coder.encode([text.encode()])))
        assert list(zip(ids, starts.tolist(), ends.tolist(), strict=True)) == library_spans(coder.model, text)


@pytest.mark.parametrize("squeeze", [True, False])
@pytest.mark.parametrize("prefix", [True, False])
@settings(max_examples=150, deadline=None)
@given(text=EXPANDING)
def test_alignment_equals_library(squeeze, prefix, text):
    import sentencepiece

    lib = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc", add_dummy_prefix=prefix, remove_extra_whitespaces=squeeze, escape_whitespaces=True)
    normal, origin, _ = pieces.Normaliser(lib.serialized_model_proto()).align(text.encode())
    wanted, places = lib.Normalize(text, with_offsets=True)
    at = np.cumsum([0, *(len(c.encode()) for c in normal.decode())])
    assert normal.decode() == wanted
    assert [len(text.encode()[: origin[i]].decode()) for i in at] == places


def test_long_texts_in_parts(monkeypatch):
    coder = pieces.PieceEncoder(PIECE)
    texts = [t.encode() for t in ("one  two three   four " * 60, " lead" * 90, "日本語 " * 80, "unspaced" * 90, "a ▁ b " * 90, "x y" + " " * 300)]
    whole = list(coder.encode(texts))
    monkeypatch.setattr(pieces, "PART_BYTES", 64)
    assert len(coder.parts(texts[0])) > 5 and len(coder.parts(texts[3])) == len(coder.parts(texts[4])) == 1
    for a, b in zip(whole, coder.encode(texts), strict=True):
        assert a[0] == b[0] and a[1].tolist() == b[1].tolist() and a[2].tolist() == b[2].tolist()


def test_user_defined_pieces_are_refused():
    extra = field(1, field(1, b"<sep>") + b"\x15\x00\x00\x00\x00" + field(3, 4))
    with pytest.raises(ValueError, match="user-defined"):
        pieces.PieceEncoder(model=open(PIECE, "rb").read() + extra)


def test_encode_documents(odd, texts):
    model = pieces.encoder(PIECE).model
    expected = []
    for d, t, *_ in texts:
        ids = [1, *model.encode(t or ""), 2]
        expected.append((d, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(model.decode(ids).encode()).hexdigest()))
    got = pieces.encode_documents(odd, PIECE).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(key, got)) == sorted(map(key, expected))


def test_encode_nothing(none):
    assert pieces.encode_documents(none, PIECE, ("ids", "starts", "ends", "decoded")).collect() == []


def double_array(mapping: dict[bytes, bytes]) -> bytes:
    """A compiled character map: the array is grown one node at a time, children where all their places are free."""
    strings, at = b"", {}
    for k, v in mapping.items():
        at[k] = len(strings)
        strings += v + b"\0"
    units, used, bases = {0: 0}, {0}, set()

    def place(prefix: bytes, node: int) -> None:
        children = sorted({k[len(prefix)] for k in mapping if k.startswith(prefix) and len(k) > len(prefix)})
        leaf = prefix in mapping
        base = 1
        while base in bases or any((base ^ c) in used for c in children) or leaf and base in used or base >= 1 << 20:
            base += 1
        bases.add(base)
        # the unit of `node` holds the way to its children: places are node ^ offset ^ byte
        offset = node ^ base
        units[node] = units.get(node, 0) | offset << 10 | leaf << 8
        if leaf:
            used.add(base)
            units[base] = 1 << 31 | at[prefix]
        for c in children:
            used.add(base ^ c)
            units[base ^ c] = c
        for c in children:
            place(prefix + bytes([c]), base ^ c)

    place(b"", 0)
    size = max(units) + 1
    blob = struct.pack(f"<{size}I", *(units.get(i, 0) for i in range(size)))
    return struct.pack("<I", len(blob)) + blob + strings


def field(number: int, value: bytes | int) -> bytes:
    if isinstance(value, int):
        return bytes([number << 3, value])
    size, out = len(value), bytes([number << 3 | 2])
    while size > 127:
        out += bytes([size & 127 | 128])
        size >>= 7
    return out + bytes([size]) + value


def test_longest_prefix_normalisation():
    spec = field(2, double_array({"ﬁ".encode(): b"fi", b"a": b"b", b"ab": b"XY", "　".encode(): b" ", b"z": b""})) + field(3, 1) + field(4, 1) + field(5, 1)
    n = pieces.Normaliser(field(3, spec))
    text = " ﬁab a　zc "
    normal, starts, ends = n.normalise(text.encode())
    assert normal.decode() == "▁fiXY▁b▁c"
    data = text.encode()
    assert data[starts[normal.index(b"fi")] : ends[normal.index(b"fi")]].decode() == "ﬁ"
    assert data[starts[normal.index(b"XY")] : ends[normal.index(b"XY") + 1]] == b"ab"
    assert data[starts[-1] : ends[-1]] == b"c"


def test_media(odd, texts):
    got = media.media(odd).collect()
    expected = {}
    for d, t, *_ in texts:
        data = (t or "").encode()
        padded = data + b"\0" * (-len(data) % 64 or (64 if not data else 0))
        expected.setdefault(d, []).append((len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:])))
    found = {}
    for r in got:
        found.setdefault(r["doc_id"], []).append((r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]))
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in expected.items()}
    same = [r for r in got if r["doc_id"] in (6, 7)]
    assert len({(r["media_sha256"], r["feature"], r["media_bytes"]) for r in same}) == 1


def test_media_of_nothing(none):
    assert media.media(none).collect() == []


def plain_decode(data: bytes) -> tuple[int, int, list[list[int]]]:
    """A baseline decoder, one bit after another."""
    j = media.Jpeg(data)
    codes = [{(n, c): s for s, (c, n) in media.canonical(*j.tables[t]).items()} for t in j.table_ids]
    segments, current, i = [], bytearray(), 0
    while i < len(j.scan):
        if j.scan[i] == 0xFF and j.scan[i + 1] == 0:
            current.append(0xFF)
            i += 2
        elif j.scan[i] == 0xFF and 0xD0 <= j.scan[i + 1] <= 0xD7:
            segments.append(bytes(current))
            current = bytearray()
            i += 2
        else:
            current.append(j.scan[i])
            i += 1
    segments.append(bytes(current))
    out, total = [], j.columns * j.rows
    for segment in segments:
        bits = "".join(f"{b:08b}" for b in segment)
        at, previous = 0, 0

        def symbol(table):
            nonlocal at
            n = 1
            while (n, int(bits[at : at + n], 2)) not in table:
                n += 1
            s = table[n, int(bits[at : at + n], 2)]
            at += n
            return s

        def number(size):
            nonlocal at
            if not size:
                return 0
            v = int(bits[at : at + size], 2)
            at += size
            return v if v >> (size - 1) else v - (1 << size) + 1

        for _ in range(min(j.interval or total, total - len(out))):
            previous += number(symbol(codes[0]))
            block, k = [previous] + [0] * 63, 1
            while k < 64:
                s = symbol(codes[1])
                if s == 0:
                    break
                k += s >> 4
                if s & 15:
                    block[k] = number(s & 15)
                k += 1
            out.append(block)
    return j.width, j.height, out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=700), min_size=1, max_size=4))
def test_jpegs_against_a_plain_decoder(payloads):
    padded = [media.payload_of(p) for p in payloads]
    files = media.write_jpegs(padded)
    for p, f, (markers, found) in zip(padded, files, media.read_jpegs(files), strict=True):
        w, h, blocks = plain_decode(f)
        assert (w, h) == (markers.width, markers.height)
        assert found.tolist() == blocks
        assert found.astype(np.int8).tobytes()[: len(p)] == p
        pixels = media.thumbnail(markers, found)
        assert pixels.shape == (markers.rows, markers.columns)
        assert pixels[0, 0] == min(255, max(0, (blocks[0][0] + 4) // 8 + 128))


def test_reader_without_restarts_and_bad_files():
    data = media.write_jpegs([b"abcdefgh" * 8])[0]
    start = data.index(b"\xff\xdd")
    assert media.read_jpegs([data[:start] + data[start + 6 :]])[0][1].astype(np.int8).tobytes() == b"abcdefgh" * 8
    with pytest.raises(ValueError, match="JPEG"):
        media.read_jpegs([b"nothing"])
    with pytest.raises(ValueError, match="baseline"):
        media.read_jpegs([data.replace(b"\xff\xc0", b"\xff\xc2")])


def test_large_images_widen():
    assert media.shape_of(1) == (1, 1)
    assert media.shape_of(8 * 8191) == (8, 8191)
    columns, rows = media.shape_of(8 * 8191 + 1)
    assert columns == 16
    assert rows <= 8191
