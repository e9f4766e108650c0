"""Sinks: the entity graph, wide delimited text, reports, and the append-only audit log."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brinewood.operators.dedup import upsert
from brinewood.operators.graph import load_order


def write_graph(current: dict[str, DataFrame], changes: dict[str, DataFrame], keys: dict[str, list[str]], path: str, relations: DataFrame | None = None) -> dict[str, str]:
    """[SNK-01 to SNK-03, SRC-14] Each entity merged and written to a new version, parents before children; then the entity's
    pointer moves on, so that what `current` reads is never overwritten. The order is that of `changes`, or follows from
    relations(child, parent), of which a cycle is an error. Running it again with the same changes gives the same rows.
    Returns the folders in the order written."""
    out, order = {}, list(changes)
    if relations is not None and changes:
        names = next(iter(changes.values())).sparkSession.createDataFrame([(n,) for n in changes], "entity string")
        levels = {r["entity"]: r["level"] for r in load_order(names, relations).collect()}
        if looped := sorted(n for n, level in levels.items() if level is None):
            raise ValueError(f"{', '.join(looped)}: relations form a cycle")
        order.sort(key=levels.get)
    for name in order:
        df = changes[name]
        merged = upsert(current[name], df, keys[name]) if name in current else df
        out[name] = f"{path}/{name}/{uuid.uuid4().hex}"
        merged.write.parquet(out[name])
    for name, folder in out.items():
        spark = changes[name].sparkSession
        spark.createDataFrame([(folder,)], "folder string").coalesce(1).write.mode("overwrite").text(f"{path}/{name}-current")
    return out


def read_graph(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The rows of an entity's current version."""
    return spark.read.parquet(spark.read.text(f"{path}/{name}-current").first()[0])


def bridge(houses: DataFrame, containers: DataFrame, master: str) -> DataFrame:
    """[SNK-04] Every container of a master linked to every house of it."""
    return houses.select(master, "house_id").join(containers.select(master, "container_id"), master).select("house_id", "container_id").distinct()


def wide_csv(records: DataFrame, key: str, fields: str, preferred: list[str], path: str, most: int = 10_000) -> list[str]:
    """[SNK-05] A map column as columns: the preferred ones first, then all others found, sorted. Returns the header. More
    than `most` names are no table and raise."""
    names = [r[0] for r in records.select(F.explode(F.map_keys(fields))).distinct().limit(most + 1).collect()]
    if len(names) > most:
        raise ValueError(f"more than {most} column names")
    header = [c for c in preferred if c in names] + sorted(set(names) - set(preferred))
    wide = records.select(key, *[F.try_element_at(F.col(fields), F.lit(c)).alias(c) for c in header])
    wide.write.mode("overwrite").option("header", "true").csv(path)
    return [key, *header]


def cost_lines(documents: DataFrame) -> DataFrame:
    """[SNK-08] documents(file, groups array<struct<child, lines array<struct<term, amount>>>>) as flat lines."""
    groups = documents.select("file", F.explode("groups").alias("g"))
    return groups.select("file", F.col("g.child").alias("child"), F.posexplode("g.lines").alias("line_no", "l")).select("file", "child", "line_no", "l.term", "l.amount")


def invoice_cargo(expected: DataFrame, existing: DataFrame, measures: list[str], tolerance: float = 0.01) -> DataFrame:
    """[SNK-09] expected(child, measures) against existing(child, measures, tagged): insert, update (tagged or within the
    tolerance), or conflict."""
    e = existing.select("child", F.lit(True).alias("_there"), F.col("tagged").alias("_tagged"), *[F.col(m).alias(f"_{m}") for m in measures])
    joined = expected.join(e, "child", "left")
    near = F.lit(True)
    for m in measures:
        near = near & F.coalesce(F.abs(F.col(m) - F.col(f"_{m}")) <= tolerance, F.col(m).isNull() | F.col(f"_{m}").isNull())
    action = F.when(F.col("_there").isNull(), "insert").when(F.col("_tagged") | near, "update").otherwise("conflict")
    return joined.select(*expected.columns, action.alias("action"))


def post_lines(lines: DataFrame, operations: DataFrame, existing: DataFrame, terms: DataFrame) -> DataFrame:
    """[SNK-10, JN-21] lines(invoice, child, master, term, unit_price, rate) to postings: the child's operation, else the
    master's; the base price at the exchange rate; the term's id by equal label, else by a label that it contains; insert or update."""
    o = operations.select(F.col("number").alias("_no"), F.col("id").alias("_id"))
    child, master = o.toDF("c_no", "c_id"), o.toDF("m_no", "m_id")
    placed = lines.join(child, F.col("child") == F.col("c_no"), "left").join(master, F.col("master") == F.col("m_no"), "left")
    placed = placed.withColumn("operation_id", F.coalesce("c_id", "m_id")).withColumn("base_price", F.bround(F.col("unit_price") / F.coalesce("rate", F.lit(1.0)), 2))
    # each distinct term once: labels that it equals or contains share their first word with it
    words = lambda x: F.regexp_extract_all(x, F.lit("([A-Z0-9]+)"), F.lit(1))
    labels = terms.select("term_id", F.upper("label").alias("_label")).withColumn("_w", F.get(words(F.col("_label")), F.lit(0)))
    names = placed.select(F.upper("term").alias("_name")).distinct().withColumn("_w", F.explode(F.array_distinct(words(F.col("_name")))))
    met = names.join(labels, "_w").where(F.contains("_name", F.col("_label")))
    rank = F.struct((F.col("_name") != F.col("_label")).alias("inexact"), F.col("term_id").alias("id"))
    resolved = met.groupBy("_name").agg(F.min_by("term_id", rank).alias("term_id"))
    best = placed.join(resolved, F.upper("term") == F.col("_name"), "left")
    done = existing.select("operation_id", "invoice", "term_id", F.lit(True).alias("_done")).distinct()
    out = best.join(done, ["operation_id", "invoice", "term_id"], "left")
    status = F.when(F.col("operation_id").isNull(), "no_operation").when(F.col("term_id").isNull(), "no_term").when(F.col("_done"), "update").otherwise("insert")
    return out.select("invoice", "child", "operation_id", "term", "term_id", "base_price", status.alias("status"))
