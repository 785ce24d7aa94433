"""Vector tables as packed blocks: what the two embedding operators share."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def valid_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, embedding) of usable rows, one per id: no null id, vector or component, all finite, not zero.

    Of rows that repeat an id, the one with the smallest vector in array order stands.
    """
    ok = (F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
          & F.exists("embedding", lambda x: x != 0))
    return (df.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("embedding"))
            .where(F.col("vec_id").isNotNull() & ok)
            .groupBy("vec_id").agg(F.min("embedding").alias("embedding")))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column that all have ``dim`` components, as float64."""
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), dim)


def by_dimension(batch: pa.RecordBatch, column: int = 1) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Split a batch by vector length; vectors of different lengths are never compared."""
    lengths = np.asarray(pc.list_value_length(batch.column(column)))
    for dim in np.unique(lengths):
        yield int(dim), batch.filter(pa.array(lengths == dim))
