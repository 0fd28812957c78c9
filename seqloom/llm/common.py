"""What the text operators share: Arrow text access, shard keys, size-checked joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step works on.
STEP_BYTES = 1 << 20
#: Rows of an Arrow batch: texts of any length are in it, so it is kept short.
BATCH_ROWS = 1000
#: Ids that may be broadcast: 8 bytes each, so 8 MB before hashing overhead.
BROADCAST_IDS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, after the session's Arrow batches were limited to ``BATCH_ROWS``; a smaller limit stays."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df


def bucket_of(id_col: Column, buckets: int) -> Column:
    """crc32 of the id's decimal text, modulo ``buckets``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % buckets


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each value, null as empty."""
    return pc.fill_null(column.cast(pa.large_binary()), b"").to_pylist()


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column one after another, and the n + 1 offsets; null as empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def steps(offsets: np.ndarray, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes each; a longer row stands alone."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, hi
        lo = hi


def range_sums(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Sums of ``values[low:high]`` for each pair; an empty range sums to zero."""
    run = np.zeros(len(values) + 1)
    np.cumsum(values, dtype=np.float64, out=run[1:])
    return run[high] - run[low]


def without_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose ``key`` is not in the one-column table ``ids``; rows with a null key stay.

    ``ids`` should be materialised: its rows are counted, and it is broadcast only
    up to ``BROADCAST_IDS``; beyond that both sides are shuffled.
    """
    other = ids.select(F.col(ids.columns[0]).alias("__gone")).distinct()
    other = F.broadcast(other) if ids.count() <= BROADCAST_IDS else other
    return df.join(other, df[key] == F.col("__gone"), "left_anti")
