"""Dedup, keep-best and merge operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def keep_first(df: DataFrame, key: Column, order: list[Column], *, keyless: str = "keep") -> DataFrame:
    """[SET-01, SET-02] The first row of each key, nulls of `order` first. Rows without key are all kept, or dropped, or lost
    to one. An aggregate: the key is computed once, each task sends one row a key, and keyless rows have keys of their own."""
    alone = F.monotonically_increasing_id() if keyless == "keep" else F.lit(0)
    rows = df.withColumn("_key", key).withColumn("_alone", F.when(F.col("_key").isNull(), alone))
    if keyless == "drop":
        rows = rows.where(F.col("_key").isNotNull())
    rank = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    return rows.groupBy("_key", "_alone").agg(F.min_by(F.struct(*df.columns), rank).alias("_first")).select("_first.*")


def split_duplicates(df: DataFrame, key: Column, order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """[SET-02] (unique rows, duplicates); rows without key are in neither."""
    ranked = df.where(key.isNotNull()).withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return ranked.where("_n = 1").drop("_n"), ranked.where("_n > 1").withColumnRenamed("_n", "duplicate_no")


def keep_best(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """[WIN-01, WIN-02, WIN-06, WIN-09 to WIN-11] The best row of each key by an order with a unique last part.

    An aggregate, not a window: each task sends one row per key.
    """
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("_best"))
    return best.select(*keys, "_best.*")


def fill_from_losers(df: DataFrame, keys: list[str], rank: Column, longest: tuple[str, ...] = ()) -> DataFrame:
    """[WIN-02, SET-10] One row per key: each column from the best row that has it; `longest` columns by length."""
    rest = [c for c in df.columns if c not in keys]
    out = []
    for c in rest:
        has = F.col(c).isNotNull() & (F.col(c).cast("string") != "")
        by = F.struct(F.length(c).alias("n"), rank.alias("r")) if c in longest else rank
        out.append(F.max_by(c, F.when(has, by)).alias(c))
    return df.groupBy(*keys).agg(*out)


def duplicate_groups(df: DataFrame, keys: list[str]) -> DataFrame:
    """[AGG-17] Keys with more than one row, and their counts."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def cleanup_plan(ops: DataFrame, keys: list[str], order: list[Column], children: Column) -> DataFrame:
    """[WIN-10, SET-11] Each row with its action: KEEP the best of a key, DELETE others without children, REVIEW the rest."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return ops.withColumn("action", F.when(rank == 1, "KEEP").when(children == 0, "DELETE").otherwise("REVIEW"))


def upsert(current: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """[SET-08, SNK-01 to SNK-03] current with changes merged in: values that a change has win, null changes keep what was,
    new keys are added. Null keys are keys; of changes that share a key the greatest row counts. Doing it twice gives the
    same as once."""
    rest = [c for c in current.columns if c not in keys]
    given = [c for c in rest if c in changes.columns]
    one = changes.groupBy(*keys).agg(F.max(F.struct(*given)).alias("_v")) if given else changes.select(*keys).distinct().withColumn("_v", F.lit(None))
    new = one.select(*[F.col(k).alias(f"_{k}") for k in keys], *[F.col(f"_v.{c}").alias(f"_{c}") for c in given], F.lit(True).alias("_new"))
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    joined = current.withColumn("_old", F.lit(True)).join(new, on, "full_outer")
    pick = lambda c: F.coalesce(F.col(f"_{c}"), F.col(c)) if c in given else F.col(c)
    return joined.select(*[F.when(F.col("_old"), F.col(k)).otherwise(F.col(f"_{k}")).alias(k) for k in keys], *[pick(c).alias(c) for c in rest])


def number_suffixes(df: DataFrame, slug: str, scope: list[str], order: list[Column]) -> Column:
    """[JN-27] The slug, with -2, -3 ... for its repetitions in scope."""
    n = F.row_number().over(Window.partitionBy(*scope, slug).orderBy(*order))
    return F.when(n == 1, F.col(slug)).otherwise(F.concat(F.col(slug), F.lit("-"), n.cast("string")))
