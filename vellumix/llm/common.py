"""What the operators of this subpackage share."""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..sources.shared import cut, drop, shared_folder, tidy

__all__ = ["cut", "drop", "free_name", "map_batches", "pieces", "shared_folder", "table", "text_of", "tidy", "utf8", "worker_cache"]


PIECE_ROWS = 1 << 15


def free_name(df: DataFrame, base: str) -> str:
    """A name for a helper column that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def map_batches(df: DataFrame, run, schema: StructType) -> DataFrame:
    """mapInArrow for columns of any name: it can't take names with dots itself."""
    names = df.columns

    def renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return run(b.rename_columns(names) for b in batches)

    return df.toDF(*(f"c{k}" for k in range(len(names)))).mapInArrow(renamed, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """The column as a plain UTF-8 array with nulls as empty strings."""
    col = batch.column(batch.schema.get_field_index(name))
    if not pa.types.is_string(col.type):
        col = col.cast(pa.string())
    return col.fill_null("")


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all strings of a string array, and len + 1 offsets into them, without a copy."""
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = col.buffers()
    at = np.frombuffer(offsets, np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def pieces(batch: pa.RecordBatch, limit: int, name: str = "text") -> list[pa.RecordBatch]:
    """The batch cut into slices of at most `limit` bytes of text and PIECE_ROWS rows, or one row where a row alone is longer."""
    _, at = utf8(text_of(batch, name))
    out, start = [], 0
    while start < batch.num_rows:
        end = max(start + 1, min(start + PIECE_ROWS, int(np.searchsorted(at, at[start] + limit, side="right")) - 1))
        out.append(batch.slice(start, end - start))
        start = end
    return out


def worker_cache() -> dict:
    """A dict that lives as long as the Python worker: what a task builds (an automaton, a vocabulary) serves the next ones."""
    name = "vellumix_worker_cache"
    if name not in sys.modules:
        module = types.ModuleType(name)
        module.known = {}
        sys.modules[name] = module
    return sys.modules[name].known
