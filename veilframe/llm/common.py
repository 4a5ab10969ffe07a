"""Helpers of the operators: batches of bounded size in Python tasks, words, tables kept between steps."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.session import scratch_dir

#: Bytes of text that a Python task works on at once; a longer document is a piece of its own.
PIECE_BYTES = 4 << 20

#: Upper-case ASCII to lower case, as a table for bytes.translate.
ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def text_columns(df: DataFrame, key: str, text: str) -> DataFrame:
    """Only the key and the text, under fixed names, so that no other column can clash."""
    return df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))


def pieces(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each piece holds about limit bytes of the column, without copying."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = batch.column(column).cast(pa.large_binary())
        sizes = np.diff(np.frombuffer(lengths.buffers()[1], np.int64)[lengths.offset : lengths.offset + len(lengths) + 1])
        upto = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            before = upto[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(upto, before + limit, "right")))
            yield batch.slice(start, end - start)
            start = end


def text_bytes(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The texts as UTF-8; NULL is an empty text."""
    return [t or b"" for t in batch.column(column).cast(pa.large_binary()).to_pylist()]


def per_text(
    df: DataFrame, key: str, text: str, fields: list[T.StructField], fn: Callable[[list[bytes]], list[pa.Array]],
    columns: str = "text",
) -> DataFrame:
    """Key and the columns that fn makes of a list of texts; the work stays in the task that reads the rows."""
    slim = text_columns(df, key, text)
    out = T.StructType([T.StructField(key, slim.schema["key"].dataType), *fields])
    names = [f.name for f in out.fields]
    types = [None, *[_arrow(f.dataType) for f in fields]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            made = fn(text_bytes(piece))
            arrays = [piece.column("key"), *[_as(a, t) for a, t in zip(made, types[1:])]]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return slim.mapInArrow(run, out)


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def _as(values, kind: pa.DataType) -> pa.Array:
    return values.cast(kind) if isinstance(values, pa.Array) else pa.array(values, type=kind)


def written(df: DataFrame, name: str) -> DataFrame:
    """The table after a write to the shared folder and a read: lineage ends here and lost executors cost nothing."""
    path = f"{scratch_dir(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keep_rows(df: DataFrame, text: str, fn: Callable[[list[bytes]], np.ndarray]) -> DataFrame:
    """The rows, with all their columns, for whose text fn gives true."""
    names = df.columns
    own = f"c{names.index(text)}"  # columns may have any name, also one with a dot

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, own):
            yield piece.filter(pa.array(np.asarray(fn(text_bytes(piece, own)), bool))).rename_columns(names)

    return df.toDF(*[f"c{i}" for i in range(len(names))]).mapInArrow(run, df.schema)
