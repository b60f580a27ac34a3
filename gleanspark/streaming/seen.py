"""Record streams: one key's first record, and batches merged into a deduplicated table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..functions.bibliography import norm_doi


def landed(spark: SparkSession, path: str, schema: StructType, per_trigger: int = 100) -> DataFrame:
    """New files of a landing folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).json(path)


def first_by_doi(stream: DataFrame, time: str, delay: str = "1 day") -> DataFrame:
    """The first record of each DOI within the delay; state older than that goes.  Records without DOI pass."""
    keyed = stream.withColumn("_doi", F.coalesce(norm_doi(F.col("doi")), F.concat(F.lit("id:"), F.col("record_id"))))
    return keyed.withWatermark(time, delay).dropDuplicatesWithinWatermark(["_doi"]).drop("_doi")


def into_batches(stream: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hands every batch of new rows to merge (rows, batch number), and ends when all that has landed is done; a restart goes
    on where the last run stopped."""
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
