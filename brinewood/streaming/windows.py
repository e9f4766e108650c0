"""Event-time extras that the reference has not: watermarked tumbling and session windows, dedup, as-of joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def tumbling(events: DataFrame, ts: str, width: str, keys: list[str], late: str | None = None) -> DataFrame:
    """Counts and sums of `value` per window. With `late`, a stream's watermark."""
    if late:
        events = events.withWatermark(ts, late)
    out = events.groupBy(F.window(ts, width).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), *keys, "n", "total")


def sessions(events: DataFrame, ts: str, gap: str, key: str, late: str | None = None) -> DataFrame:
    """Sessions of a key that a gap ends."""
    if late:
        events = events.withWatermark(ts, late)
    out = events.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_seen(events: DataFrame, ts: str, keys: list[str], late: str) -> DataFrame:
    """A stream's first event of each key within the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def as_of(left: DataFrame, right: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """left with the last value of right at or before each row's time: a union and one window, no inequality join."""
    a = left.select(key, ts, F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(right.schema[value].dataType).alias("_v"))
    b = right.select(key, ts, F.lit(0).alias("_side"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), F.col(value).alias("_v"))
    w = Window.partitionBy(key).orderBy(ts, "_side").rowsBetween(Window.unboundedPreceding, 0)
    return a.unionByName(b).withColumn("_v", F.last("_v", True).over(w)).where("_side = 1").select("_row.*", F.col("_v").alias(f"as_of_{value}"))


def rollup_totals(df: DataFrame, keys: list[str], amount: Column) -> DataFrame:
    """Totals of every prefix of the keys; `level` counts the keys that are summed over."""
    return df.rollup(*keys).agg(F.grouping_id().alias("level"), F.round(F.sum(amount), 2).alias("total"), F.count(F.lit(1)).alias("n"))
