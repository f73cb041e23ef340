"""Sinks: text, JSON lines, partitioned fields, npz from long tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_text(df: DataFrame, path: str, col: str = "value", by: str | None = None) -> None:
    """One text dataset, or one folder per value of by."""
    w = (df.select(F.col(col).cast("string").alias("value"), by) if by else df.select(F.col(col).cast("string").alias("value"))).write.mode("overwrite")
    (w.partitionBy(by) if by else w).text(path)


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines with sorted keys."""
    df.select(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)])).alias("value")).write.mode("overwrite").text(path)


def write_fields(df: DataFrame, path: str) -> None:
    """(key, field, text) as one folder per field."""
    df.write.mode("overwrite").partitionBy("field").parquet(path)


def write_npz(cells: DataFrame, path: str, shape: tuple[int, int], limit: int = 5_000_000) -> None:
    """A small sparse matrix (row, col, val) as CSR members of an npz file; for
    exchange only, so more than limit cells are refused."""
    if cells.limit(limit + 1).count() > limit:
        raise ValueError("too many cells for one npz file; write Parquet")
    x = cells.orderBy("row", "col").toPandas()
    ptr = np.zeros(shape[0] + 1, np.int64)
    np.add.at(ptr, x["row"].to_numpy() + 1, 1)
    np.savez(path, data=x["val"].to_numpy(), indices=x["col"].to_numpy(), indptr=np.cumsum(ptr), shape=np.array(shape))
