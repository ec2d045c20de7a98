"""Bitmaps of fixed size over hashed values: a filter that may let more through, never less."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.session import shuffles_dropped

#: Bits of a filter. They bound what the driver collects and sends to the tasks: 4 MB.
FILTER_BITS = 1 << 25
_CHUNK_BITS = 1 << 19


def _packed(rows: pd.DataFrame) -> pd.DataFrame:
    bits = np.zeros(_CHUNK_BITS, dtype=np.uint8)
    bits[rows["bit"].to_numpy() % _CHUNK_BITS] = 1
    chunk = int(rows["bit"].iloc[0]) // _CHUNK_BITS
    return pd.DataFrame({"chunk": [chunk], "packed": [np.packbits(bits, bitorder="little").tobytes()]})


def bitmap(values: DataFrame, column: str) -> np.ndarray:
    """The bits of all values of a long column, modulo ``FILTER_BITS``.

    Bits are made distinct first, so a chunk is never more than its own bits, whatever the
    number of values; the driver gets at most 64 packed chunks. Shuffles of ``values`` go at the end.
    """
    out = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
    size = _CHUNK_BITS // 8
    bits = values.select(F.pmod(F.col(column), F.lit(FILTER_BITS)).alias("bit")).distinct()
    chunk = F.floor(F.col("bit") / _CHUNK_BITS).alias("part")
    with shuffles_dropped(values.sparkSession):
        rows = bits.groupBy(chunk).applyInPandas(_packed, "chunk long, packed binary").collect()
    for row in rows:
        out[row["chunk"] * size : (row["chunk"] + 1) * size] = np.frombuffer(row["packed"], dtype=np.uint8)
    return out


def has(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether the bit of each value is set."""
    bit = values.astype(np.int64) % FILTER_BITS
    return (bits[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool)
