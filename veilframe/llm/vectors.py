"""Vectors of whole numbers in blocks: one row holds the keys of some vectors and their components as one matrix."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Vectors of a block at most.
BLOCK = 4096
#: What a NULL key or label is inside a block; it sorts behind all others.
NONE = np.iinfo(np.int64).max
#: Largest component, as sums of squares of differences have to fit into a long.
LARGEST = 1 << 27

SCHEMA = T.StructType([
    T.StructField("keys", T.BinaryType()), T.StructField("labels", T.BinaryType()), T.StructField("width", T.IntegerType()), T.StructField("cells", T.BinaryType()),
])


class Block(NamedTuple):
    keys: np.ndarray
    labels: np.ndarray
    cells: np.ndarray


def finite(vector: Column) -> Column:
    """Whether the vector and all its components are there and finite."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.forall(vector, fine), F.lit(False))


def blocks(df: DataFrame, key: str, vector: str, scale: int, label: Column | None = None) -> DataFrame:
    """Rows of SCHEMA with floor(scale * x) of each component x; all components have to be finite.

    Vectors of different lengths stand in different blocks. The work stays in the task that reads the rows.
    """
    label = F.lit(None) if label is None else label
    slim = df.select(
        F.col(f"`{key}`").cast("bigint").alias("key"), F.col(f"`{vector}`").cast("array<double>").alias("vector"), label.cast("bigint").alias("label")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                lists = part.column("vector")
                sizes = np.diff(lists.offsets.to_numpy())
                cells = np.floor(scale * lists.flatten().to_numpy(zero_copy_only=False))
                if len(cells) and np.abs(cells).max() >= LARGEST:
                    raise ValueError(f"a component is beyond {LARGEST} after scaling")
                keys, labels = (part.column(c).fill_null(NONE).to_numpy() for c in ("key", "label"))
                starts = np.cumsum(sizes) - sizes
                for width in np.unique(sizes):
                    own = np.flatnonzero(sizes == width)
                    matrix = cells[starts[own][:, None] + np.arange(width)].astype(np.int32)
                    yield pa.RecordBatch.from_arrays([
                        pa.array([keys[own].tobytes()], pa.binary()), pa.array([labels[own].tobytes()], pa.binary()), pa.array([int(width)], pa.int32()),
                        pa.array([matrix.tobytes()], pa.binary()),
                    ], SCHEMA.names)

    return slim.mapInArrow(run, SCHEMA)


def opened(row: dict) -> Block:
    keys = np.frombuffer(row["keys"], np.int64)
    return Block(keys, np.frombuffer(row["labels"], np.int64), np.frombuffer(row["cells"], np.int32).reshape(len(keys), row["width"]))


def each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The rows of the batches, one at a time."""
    for batch in batches:
        for r in range(batch.num_rows):
            yield batch.slice(r, 1).to_pylist()[0]


def keys_of(keys: np.ndarray) -> pa.Array:
    """Keys as a column, NULL again where they were."""
    return pa.array(keys, pa.int64(), mask=keys == NONE)
