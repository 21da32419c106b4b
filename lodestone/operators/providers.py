"""External models as pluggable functions over Arrow batches, with stand-ins that need no network.

A provider is a plain Python object that is sent to the tasks. What it raises becomes a reason in a column, and the
rows go on without it.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

DIMS = 384
#: Put before queries, never before documents.
QUERY_PREFIX = "Represent this sentence for searching relevant passages: "
# What a request may hold.
CAPS = {"query": 512, "candidates": 30, "sources": 8, "pairs": 12, "sentence": 1000, "chunk": 2400, "documents": 100}
RETRIES = 6
#: Words that the stand-in encoder remembers from text to text, about.
KNOWN = 1 << 16


class Encoder(Protocol):
    batch: int

    def encode(self, texts: list[str]) -> list[np.ndarray]: ...


class Retryable(Exception):
    """What is worth another try: too many requests, or a server's error."""


def with_backoff(call: Callable, retries: int = RETRIES, sleep: Callable[[float], None] = time.sleep):
    """call(), again after 1, 2, 4, ... seconds as long as it raises Retryable."""
    for n in range(retries):
        try:
            return call()
        except Retryable:
            sleep(2.0**n)
    return call()


@dataclass
class HashEncoder:
    """A stand-in encoder: signed hashed words, so texts that share words have close vectors."""

    dims: int = DIMS
    batch: int = 100

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        known: dict[str, int] = {}  # places of words: those that add, and after these those that take away
        for text in texts:
            words = text.lower().split()
            if len(known) > KNOWN:
                known = {}
            for word in set(words).difference(known):
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                known[word] = h % self.dims + (0 if h >> 63 else self.dims)
            n_at = np.bincount(np.fromiter(map(known.__getitem__, words), np.int64, len(words)), minlength=2 * self.dims)
            v = (n_at[: self.dims] - n_at[self.dims :]).astype(np.float64)
            n = np.sqrt((v**2).sum())
            out.append((v / n if n else v).astype(np.float32))
        return out


def embed(texts: DataFrame, encoder: Encoder, dims: int = DIMS) -> DataFrame:
    """(id, embedding) of texts (id, text), in requests of the encoder's size. Counts and widths are checked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for i in range(0, rows.num_rows, encoder.batch):
                part = rows.slice(i, encoder.batch)
                found = with_backoff(lambda part=part: encoder.encode([t or "" for t in part.column(1).to_pylist()]))
                if len(found) != part.num_rows:
                    raise ValueError(f"{len(found)} vectors for {part.num_rows} texts")
                if any(len(v) != dims for v in found):
                    raise ValueError(f"a vector's width isn't {dims}")
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([np.asarray(v, np.float32) for v in found], pa.list_(pa.float32()))], ["id", "embedding"])

    return texts.select("id", F.col("text").cast("string")).mapInArrow(run, f"id {dict(texts.dtypes)['id']}, embedding array<float>")


def query_text(question: Column) -> Column:
    return F.concat(F.lit(QUERY_PREFIX), F.substring(question, 1, CAPS["query"]))


def capped(column: Column, kind: str) -> Column:
    """Texts are cut to their cap."""
    return F.substring(column, 1, CAPS[kind])


def at_most(items: Column, kind: str) -> Column:
    """Lists beyond their cap are refused."""
    return F.when(F.size(items) <= CAPS[kind], items).otherwise(F.raise_error(F.lit(f"more than {CAPS[kind]} {kind}")))


def chain(frame: DataFrame, column: str, models: list[tuple[str, Callable[[str], str]]], tries: int = 3, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """frame with (answer, model, degraded): the first of the named models that answers the text in `column`; degraded
    holds all reasons, ` · ` between them, where none did. A quota that is used up isn't tried again."""

    def ask(text: str) -> tuple[str | None, str | None, str | None]:
        reasons = []
        for name, call in models:
            for n in range(tries):
                try:
                    return call(text), name, None
                except Retryable as e:
                    if "quota" in str(e) or n == tries - 1:
                        reasons.append(f"{name}: {e}")
                        break
                    sleep(0.8 * 2**n)
                except Exception as e:  # noqa: BLE001  a provider may raise anything
                    reasons.append(f"{name}: {e}")
                    break
        return None, None, " · ".join(reasons)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            found = [ask(t) for t in rows.column(rows.schema.get_field_index(column)).to_pylist()]
            more = [pa.array([x[i] for x in found], pa.string()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*rows.columns, *more], [*rows.schema.names, "answer", "model", "degraded"])

    schema = ", ".join(f"`{n}` {t}" for n, t in frame.dtypes) + ", answer string, model string, degraded string"
    return frame.mapInArrow(run, schema)


def has_uncited_answer(raw: Column) -> Column:
    """Whether an answer claims to answer but cites nothing; what can't be parsed is left to the parser."""
    v = F.try_parse_json(raw)
    return F.coalesce(F.try_variant_get(v, "$.answerable", "boolean") & (F.size(F.try_variant_get(v, "$.claims", "array<variant>")) == 0), F.lit(False))


def upstream_error(stage: Column, status: Column, detail: Column) -> Column:
    return F.concat(stage, F.lit(" returned "), status.cast("string"), F.lit(": "), F.substring(detail, 1, 300))


def prompt(question: Column, sources: Column, language: Column | None = None) -> Column:
    """sources: an array of (id, title, text). Quotes stay in the sources' language whatever the answer's is."""
    listed = F.array_join(F.transform(F.slice(sources, 1, CAPS["sources"]), lambda s: T.source_block(s["id"], s["title"], F.substring(s["text"], 1, CAPS["chunk"]))), "\n\n")
    rule = F.when(language == "it", "\n- Write the sentences in Italian and keep every quote as it is in the source.").otherwise("") if language is not None else F.lit("")
    return F.concat(F.lit("Answer from the sources only, with a quote for every claim."), rule, F.lit("\n\n"), listed, F.lit("\n\nQuestion: "), F.substring(question, 1, CAPS["query"]))
