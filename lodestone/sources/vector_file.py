"""A compact binary file of vectors: magic, count and width, then scales, then codes, all little-endian."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

# Fixed value of the format.
MAGIC = 0x52414756


def encode(scales: np.ndarray, codes: np.ndarray) -> bytes:
    """codes: a row of signed bytes for each scale."""
    return struct.pack("<III", MAGIC, *codes.shape) + scales.astype("<f4").tobytes() + codes.astype(np.int8).tobytes()


def decode(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    magic, n, dims = struct.unpack_from("<III", data)
    if magic != MAGIC:
        raise ValueError("not a vector file")
    return np.frombuffer(data, "<f4", n, 12), np.frombuffer(data, np.int8, n * dims, 12 + 4 * n).reshape(n, dims)


def read_vector_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, ordinal, scale, codes): a row for each vector of each file."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for name, content in zip(rows["path"], rows["content"], strict=True):
                scales, codes = decode(content)
                yield pd.DataFrame({"path": name, "ordinal": np.arange(len(scales), dtype=np.int32), "scale": scales, "codes": list(codes)})

    return files.mapInPandas(run, "path string, ordinal int, scale float, codes array<tinyint>")


def pack_vectors(vectors: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, content): each key's vectors (ordinal, scale, codes) as one file, for export in pieces that fit a row."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ordinal")
        return pd.DataFrame({**dict(zip(keys, ([k] for k in key), strict=True)), "content": [encode(rows["scale"].to_numpy(), np.stack(rows["codes"].to_list()))]})

    return vectors.groupBy(*keys).applyInPandas(run, ", ".join(f"{k} {dict(vectors.dtypes)[k]}" for k in keys) + ", content binary")
