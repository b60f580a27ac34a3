"""Documents as ordered chunks of bounded size."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_checkpoints as shared_checkpoints

#: Text in one chunk, about.
SHARD_BYTES = 4 << 20
#: Chunks dealt to one task, about: several, so that tasks are even though chunks are hashed to them.
CHUNKS_A_TASK = 4
#: Bounds of chunks are quantiles of the ids, at two levels: at most QUANTILES squared chunks (4 TB of text; beyond, chunks grow).
QUANTILES = 1024
LAST = (1 << 63) - 1


def grid(parts: int) -> list[float]:
    return [i / parts for i in range(1, parts)]


def placed(keys: np.ndarray, bounds: np.ndarray) -> pd.Series:
    return pd.Series(np.searchsorted(bounds, keys, "left").astype(np.int32))


def by_id(docs: DataFrame, order: str = "doc_id", text: str = "text") -> tuple[DataFrame, int, int, int]:
    """docs with ``order_key`` and ``chunk``, which rises with the key: all rows of a key share a chunk.  Rows of null id come last,
    spread over chunks by their text.  Also the number of tasks, the bytes of all texts, and the first chunk of null ids.  The
    rows are dealt out by chunk."""
    keyed = docs.withColumn("order_key", F.coalesce(F.col(order).cast("long"), F.lit(LAST)))
    known, length = F.col(order).isNotNull(), F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    first = [F.sum(F.when(known, length)), F.sum(F.when(~known, length)), F.percentile_approx(F.when(known, F.col("order_key")), grid(QUANTILES), 20_000)]
    size, null_size, cuts = keyed.agg(*first).first()
    n, null_chunks = (max(1, -(-int(x or 0) // SHARD_BYTES)) for x in (size, null_size))
    coarse = np.array(cuts or [], np.int64)
    if n <= QUANTILES:
        bounds = coarse[[(i * QUANTILES) // n - 1 for i in range(1, n)]] if len(coarse) else coarse
    else:
        coarse, parts = np.unique(coarse), min(QUANTILES, -(-n // QUANTILES))

        @F.pandas_udf("int")
        def range_of(keys: pd.Series) -> pd.Series:
            return placed(keys.to_numpy(np.int64), coarse)

        inner = keyed.where(known).groupBy(range_of("order_key").alias("range")).agg(F.percentile_approx("order_key", grid(parts), 10 * parts).alias("cuts"))
        bounds = np.concatenate([coarse, *(np.array(r["cuts"], np.int64) for r in inner.select("cuts").collect() if r["cuts"])])
    bounds = np.unique(bounds)
    sent, null_from = docs.sparkSession.sparkContext.broadcast(bounds), len(bounds) + 1

    @F.pandas_udf("int")
    def chunk(keys: pd.Series) -> pd.Series:
        return placed(keys.to_numpy(np.int64), sent.value)

    spread = (F.lit(null_from) + F.pmod(F.xxhash64(text), F.lit(min(null_chunks, QUANTILES * QUANTILES)))).cast("int")
    tasks = max(1, -(-(n + null_chunks) // CHUNKS_A_TASK))
    return keyed.withColumn("chunk", F.when(known, chunk("order_key")).otherwise(spread)).repartition(tasks, "chunk"), tasks, int(size or 0) + int(null_size or 0), null_from
