"""Dealing documents into parts by ranges of doc_id, evenly and the same way every time."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import even_keys

FIRST = -(1 << 63)  # stands for a null doc_id, which comes first


def bounds(docs: DataFrame, n: int) -> np.ndarray:
    """At most n-1 doc_ids that cut the documents into parts of about equal size.

    They come from a mergeable quantile summary of doc_id alone; n-1 numbers reach the
    driver.  Rows of one doc_id share a part.
    """
    if n < 2:
        return np.empty(0, dtype=np.int64)
    share = [i / n for i in range(1, n)]
    cuts = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), share, F.lit(max(10_000, 20 * n)))).head()[0]
    return np.array(sorted(set(cuts or [])), dtype=np.int64)


def parts(cuts: np.ndarray, ids: pa.Array) -> np.ndarray:
    return np.searchsorted(cuts, ids.fill_null(FIRST).to_numpy(zero_copy_only=False), side="right")


def part(cuts: np.ndarray, doc_id: Column) -> Column:
    @F.pandas_udf("int")
    def part_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, ids.to_numpy(dtype=np.int64), side="right"), dtype="int32")

    return part_of(F.coalesce(doc_id.cast("long"), F.lit(FIRST)))


def dealt(df: DataFrame, n: int, column: str) -> DataFrame:
    """``df`` hash-partitioned so that values 0..n-1 of ``column`` fill n partitions one each."""
    keys = F.array(*[F.lit(k) for k in even_keys(df.sparkSession, n)])
    return df.withColumn("dealt_to", F.element_at(keys, F.col(column) + 1)).repartition(n, "dealt_to").drop("dealt_to")
