"""Shared pieces of the corpus operators: scratch tables, words, distributed ranks, worker caches."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Words are runs of anything but space and the control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows that one ranking task is meant to sort.
RANK_ROWS = 10_000
#: A key that more than one row in SENT holds is hot, so that fewer than SENT keys are; parts that a hot key is dealt into.
SENT, SALTS = 1 << 13, 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir, or in local mode a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = found.get() if found.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="brinewood-"))
        return shared_dir(spark)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts lineage and outlives any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/brinewood/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def spread_join(rows: DataFrame, table: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """rows joined with a table of one row a key, where one key may hold any share of the rows.

    Keys are counted over the rows, per partition first. The rows of hot keys are dealt into SALTS parts, for which the
    table repeats the row of the key; fewer than SENT keys are hot, so their list is broadcast. All others are joined by
    the key alone. Rows without key meet nothing and are dealt out as well. `how` is inner or left.
    """
    counts = materialize(rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_hot")).agg(F.count(F.lit(1)).alias("_n")), "counts")
    total = counts.agg(F.sum("_n")).first()[0] or 0
    hot = F.broadcast(materialize(counts.where(F.col("_n") * SENT > total).select("_hot"), "hot"))
    part = F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int")
    dealt = rows.join(hot, F.col(key) == F.col("_hot"), "left").withColumn("_part", F.when(F.col("_hot").isNotNull() | F.col(key).isNull(), part).otherwise(0)).drop("_hot")
    every = F.sequence(F.lit(0), F.lit(SALTS - 1))
    again = table.join(hot, F.col(key) == F.col("_hot"), "left").withColumn("_part", F.explode(F.when(F.col("_hot").isNotNull(), every).otherwise(F.array(F.lit(0))))).drop("_hot")
    return dealt.join(again, [key, "_part"], how).drop("_part")


def _delete(spark: SparkSession, name: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def discard(*tables: DataFrame) -> None:
    """Delete scratch tables that nothing still to run reads."""
    for df in tables:
        _delete(df.sparkSession, df._scratch)


def drop_scratch(spark: SparkSession) -> None:
    """Delete all scratch tables of this application, once no result that reads them is needed."""
    _delete(spark, f"{shared_dir(spark)}/brinewood/{spark.sparkContext.applicationId}")


def process_cache(name: str) -> dict:
    """A dict that lives as long as the worker process, so that tasks in it share learned words."""
    home = sys.modules.setdefault("_brinewood_process", types.ModuleType("_brinewood_process"))
    return home.__dict__.setdefault(name, {})


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Hand at most so many rows to Python at once: whole texts are long, and a batch has to fit a worker's memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def word_count(text: Column) -> Column:
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(0))), F.lit(0)).cast("long")


def crc_share(doc_id: Column, parts: int) -> Column:
    """crc32(doc_id as text) mod parts; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def spread_rank(df: DataFrame, keys: Sequence[str], order: Column, out: str, rows: int) -> DataFrame:
    """Add `out`: each row's rank from 0 among the rows of its keys, in the order of a hash.

    A key may hold any share of the rows: rows are dealt by key and the leading bits of the hash, ranked
    within such a bucket, and lifted by the counts of the buckets before. `rows` is the row count.
    Rows that tie in the hash take ranks in any order.
    """
    bits = max(0, (rows // RANK_ROWS).bit_length())
    df = df.withColumn("_hash", order)
    df = df.withColumn("_bucket", (F.shiftrightunsigned("_hash", 64 - bits) if bits else F.lit(0)).cast("long"))
    counts = df.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    right = counts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_bucket").alias("_b"), "_before")
    on = F.col("_bucket") == F.col("_b")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy("_hash")
    ranked = df.withColumn("_rank", F.row_number().over(inside) - 1)
    return ranked.join(right, on).withColumn(out, (F.col("_before") + F.col("_rank")).cast("long")).drop("_hash", "_bucket", "_b", "_before", "_rank", *[f"_k{i}" for i in range(len(keys))])
