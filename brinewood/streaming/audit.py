"""The audit log as a table and as a stream: append-only events, latest state, pages, incremental batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def started(files: DataFrame, at) -> DataFrame:
    """[SNK-06, SRC-17] A processing event for each of files(audit_id, file_name)."""
    return files.select("audit_id", "file_name", F.lit("processing").alias("status"), at.alias("at"), F.lit(None).cast("string").alias("error"))


def finished(files: DataFrame, at) -> DataFrame:
    """[SNK-06] A success or failed event for each of files(audit_id, file_name, error)."""
    return files.select("audit_id", "file_name", F.when(F.col("error").isNull(), "success").otherwise("failed").alias("status"), at.alias("at"), "error")


def latest_state(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """[SNK-06, STM-01] The last event of each key."""
    rest = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("e")).select(key, "e.*")


def page(events: DataFrame, order: str, tiebreak: str, limit: int, offset: int) -> DataFrame:
    """[WIN-08] Newest first, with limit (1 to 500) and offset."""
    return events.orderBy(F.desc(order), F.desc(tiebreak)).offset(max(0, offset)).limit(min(500, max(1, limit)))


def watch(spark: SparkSession, path: str, schema: StructType, push: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """[STM-01, STM-02] Pushes each batch of new events, once each, with the state of its keys after it."""
    stream = spark.readStream.schema(schema).parquet(path)
    return stream.writeStream.foreachBatch(push).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def not_done(files: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """[STM-05] Files without a result, or whose result is an error."""
    return files.join(results.where(~F.col("error")), key, "left_anti")
