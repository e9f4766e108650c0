"""Whole-record steps: kinds, acceptance, external records, chunk results, summaries and per-file reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brinewood.functions.ids import record_key
from brinewood.functions.text import alnum_upper, is_blank
from brinewood.operators.dedup import keep_first

#: Codes of operation kinds.
DIRECT, MASTER, HOUSE = 886150000, 886150001, 886150002


def kind_code(name: Column) -> Column:
    """[PRJ-14] The code of an operation kind's name; a code stays."""
    n = F.lower(F.trim(name))
    return F.when(n.isin("house", "hbl", str(HOUSE)), HOUSE).when(n.isin("direct", str(DIRECT)), DIRECT).when(n.isin("master", "mbl", "", str(MASTER)) | n.isNull(), MASTER)


def standalone_house(df: DataFrame) -> DataFrame:
    """[PRJ-14] A house without master: its kind set, the parent link cleared, its cargo its own."""
    alone = (F.col("kind") == HOUSE) & F.col("parent_id").isNull()
    return df.withColumn("cargo_of", F.when(alone, F.lit("house")).otherwise(F.col("cargo_of")))


def record_kind(method: Column, header: Column, row: Column) -> Column:
    """[FLT-05] manifest_header, manifest_house, draft or plain, from how a record came about."""
    return F.when(header, "manifest_header").when(row, "manifest_house").when(F.lower(method).contains("draft"), "draft").otherwise("plain")


def is_manifest(headers: Column, first: list[str], second: list[str]) -> Column:
    """[FLT-13] Headers that meet both required sets, compared by letters and digits."""
    keys = F.transform(headers, lambda h: alnum_upper(h))
    has = lambda names: F.arrays_overlap(keys, F.array(*[alnum_upper(F.lit(n)) for n in names]))
    return F.coalesce(has(first) & has(second), F.lit(False))


def needs_model(n_rows: Column, text: Column, marker: str) -> Column:
    """[FLT-14] Whether a workbook goes to the external extractor: three rows, a long text, or the marker and two rows."""
    return (n_rows >= 3) | (F.length(text) >= 25_000) | (F.contains(F.upper(text), F.lit(marker.upper())) & (n_rows >= 2))


def external_records(table: DataFrame, schema: str) -> DataFrame:
    """[SRC-13, UDF-02] (doc, record, broken) of payloads(doc, payload) that an external extractor left; what doesn't parse is
    told, not raised."""
    parsed = F.from_json("payload", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    valid = F.try_parse_json("payload").isNotNull()
    return table.select("doc", F.when(valid, parsed).alias("record"), (~valid).alias("broken"))


def merge_chunks(chunks: DataFrame) -> DataFrame:
    """[SET-03, AGG-16] chunks(doc, chunk, records array<struct<parent_no, child_no, v>>, warnings, layout, tokens) merged per
    document: first record of each key in chunk order, keyless records all kept, warnings in order, the first known
    layout, tokens summed."""
    rows = chunks.select("doc", "chunk", F.posexplode("records").alias("at", "r"))
    rows = rows.withColumn("key", F.concat_ws("|", "doc", record_key(F.col("r.child_no"), F.col("r.parent_no"))))
    rows = rows.withColumn("key", F.when(record_key(F.col("r.child_no"), F.col("r.parent_no")).isNotNull(), F.col("key")))
    first = keep_first(rows, F.col("key"), [F.col("chunk"), F.col("at")])
    merged = first.groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "at", "r"))), lambda x: x["r"]).alias("records"))
    rest = chunks.groupBy("doc").agg(
        F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "warnings"))), lambda x: x["warnings"]))).alias("warnings"),
        F.coalesce(F.min_by("layout", F.when(F.col("layout") != "unknown", F.col("chunk"))), F.lit("unknown")).alias("layout"),
        F.sum("tokens").alias("tokens"),
    )
    return rest.join(merged, "doc", "left")


def force_page_values(records: DataFrame, pages: DataFrame, columns: list[str]) -> DataFrame:
    """[RUL-11] Values that the record's own page anchors win over the record's."""
    p = pages.select(F.col("doc").alias("_d"), F.col("page").alias("_p"), *[F.col(c).alias(f"_{c}") for c in columns])
    joined = records.join(p, (F.col("doc") == F.col("_d")) & (F.col("page") == F.col("_p")), "left")
    return joined.withColumns({c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in columns}).select(*records.columns)


def merge_single(external: DataFrame, parsed: DataFrame, columns: list[str]) -> DataFrame:
    """[RUL-15] Documents with one record on each side are merged field by field; others keep the external records."""
    one = lambda df: df.groupBy("doc").count().where("count = 1").select("doc")
    alone = one(external).join(one(parsed), "doc")
    e, p = external.join(alone, "doc", "left_semi").alias("e"), parsed.join(alone, "doc", "left_semi").alias("p")
    merged = e.join(p, "doc").select("doc", *[F.coalesce(F.when(~is_blank(F.col(f"e.{c}").cast("string")), F.col(f"e.{c}")), F.col(f"p.{c}")).alias(c) for c in columns])
    return merged.unionByName(external.join(alone, "doc", "left_anti").select("doc", *columns))


def summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """[PRJ-17] The summary columns, and how many of them are filled."""
    return df.select(*columns, sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0)).alias("n_filled"))


def inventory(operations: DataFrame, children: DataFrame) -> DataFrame:
    """[AGG-17, AGG-18] Operations by kind: how many, how many without children, and their children."""
    n = children.groupBy(F.col("operation_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return operations.join(n, "id", "left").groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("n").isNull()).alias("n_empty"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_children"))


def file_report(parsed: DataFrame, judged: DataFrame, failed: DataFrame) -> DataFrame:
    """[DQ-04, DQ-05] One row a file: what parsed it, its records, score and verdict, or its error."""
    per = judged.groupBy("doc").agg(F.count(F.lit(1)).alias("n_records"), F.round(F.avg("score"), 1).alias("score"), F.every("passed").alias("passed"))
    good = parsed.select("doc", "parser").join(per, "doc", "left").withColumn("error", F.lit(None).cast("string"))
    bad = failed.select("doc", F.lit(None).cast("string").alias("parser"), F.lit(0).cast("long").alias("n_records"), F.lit(0.0).alias("score"), F.lit(False).alias("passed"), "error")
    return good.unionByName(bad)


def resolve_once(facts: DataFrame, column: str, resolved: DataFrame) -> DataFrame:
    """[STM-03] facts joined to resolved(name, id), which holds each distinct name once: the memo, misses included."""
    return facts.join(resolved.select(F.col("name").alias("_n"), F.col("id").alias(f"{column}_id")), F.col(column) == F.col("_n"), "left").drop("_n")


def stamped(df: DataFrame, at: Column | None = None) -> DataFrame:
    """[NUM-12] df with a time, that of the query unless one is given, as UTC text to the second in `at`."""
    time = F.current_timestamp() if at is None else at.cast("timestamp")
    return df.withColumn("at", F.date_format(F.to_utc_timestamp(time, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'"))


def number_or_null(x: Column) -> Column:
    """[NUM-16]"""
    return x.cast("string").try_cast("double")
