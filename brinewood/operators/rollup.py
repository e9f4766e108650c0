"""Roll-ups, stated against computed totals, conditional totals, and their tolerances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brinewood.functions.numbers import CAPS


def child_totals(children: DataFrame, parent: str, measures: list[str], caps: dict[str, str] | None = None) -> DataFrame:
    """[AGG-01, AGG-04, AGG-10] Sums of capped measures per parent, and the number of children; null if no value counts."""
    def value(m: str) -> Column:
        cap = CAPS[(caps or {}).get(m, "any")]
        return F.when(F.col(m).between(0, cap), F.col(m))

    return children.groupBy(parent).agg(*[F.bround(F.sum(value(m)), 3).alias(m) for m in measures], F.count(F.lit(1)).alias("n_children"))


def overwrite_totals(parents: DataFrame, totals: DataFrame, key: str, measures: list[str], least: int = 2) -> DataFrame:
    """[AGG-02, AGG-03] Parents with their totals replaced by the children's, where there are enough children; the stated
    value and the difference stay visible."""
    t = totals.select(F.col(key).alias("_k"), *[F.col(m).alias(f"_{m}") for m in measures], F.col("n_children").alias("_n"))
    joined = parents.join(t, F.col(key) == F.col("_k"), "left")
    enough = F.coalesce(F.col("_n") >= least, F.lit(False))
    out = [c for c in parents.columns if c not in measures]
    new = [F.when(enough, F.col(f"_{m}")).otherwise(F.col(m)).alias(m) for m in measures]
    diff = [F.when(enough, F.bround(F.col(m) - F.col(f"_{m}"), 3)).alias(f"{m}_difference") for m in measures]
    return joined.select(*out, *new, F.coalesce("_n", F.lit(0)).alias("n_children"), *diff)


def record_totals(records: DataFrame, doc: str, measures: dict[str, str], containers: str = "containers") -> DataFrame:
    """[AGG-03] (doc, measures..., teu, n_records): sums over the records of a document, and its distinct container numbers.

    A document of one record takes a measure that the record lacks from the first of its containers that has it (measures
    maps the record's column to the container's field); with several records it does not, since each repeats the
    containers. Null where nothing has a value; container numbers are compared by letters and digits.
    """
    first = lambda field: F.get(F.filter(F.transform(containers, lambda c: c[field].cast("double")), lambda v: v.isNotNull()), F.lit(0))
    sums = [F.bround(F.sum(F.col(m).cast("double")), 3).alias(m) for m in measures]
    spare = [F.bround(F.sum(first(f)), 3).alias(f"_{m}") for m, f in measures.items()]
    totals = records.groupBy(doc).agg(F.count(F.lit(1)).alias("n_records"), *sums, *spare)
    numbers = records.select(F.col(doc).alias("_doc"), F.explode(F.transform(containers, lambda c: F.regexp_replace(F.upper(c["number"]), "[^A-Z0-9]", ""))).alias("_no")).where("_no != ''")
    teu = numbers.groupBy("_doc").agg(F.count_distinct("_no").alias("teu"))
    joined = totals.join(teu, F.col(doc) == F.col("_doc"), "left")
    return joined.select(doc, *[F.when((F.col("n_records") == 1) & F.col(m).isNull(), F.col(f"_{m}")).otherwise(F.col(m)).alias(m) for m in measures], "teu", "n_records")


def fill_totals(parents: DataFrame, totals: DataFrame, key: str, measures: list[str]) -> DataFrame:
    """[AGG-04, AGG-11] Parents keep positive totals and take the children's otherwise."""
    t = totals.select(F.col(key).alias("_k"), *[F.col(m).alias(f"_{m}") for m in measures])
    joined = parents.join(t, F.col(key) == F.col("_k"), "left")
    out = [c for c in parents.columns if c not in measures]
    return joined.select(*out, *[F.coalesce(F.when(F.col(m) > 0, F.col(m)), F.col(f"_{m}")).alias(m) for m in measures])


def tolerance_status(stated: Column, computed: Column, tolerance: float) -> Column:
    """[AGG-08] missing, match or mismatch of a stated and a computed amount."""
    return F.when(stated.isNull() | computed.isNull(), "missing").when(F.abs(stated - computed) <= tolerance, "match").otherwise("mismatch")


def class_totals(rows: DataFrame, keys: list[str], amount: Column, classes: dict[str, Column]) -> DataFrame:
    """[AGG-05] Per key, count and sum of each class, and their net: the first class less the second."""
    aggs = []
    for name, test in classes.items():
        aggs += [F.count_if(test).alias(f"n_{name}"), F.round(F.coalesce(F.sum(F.when(test, amount)), F.lit(0.0)), 2).alias(f"total_{name}")]
    out = rows.groupBy(*keys).agg(*aggs)
    first, second = list(classes)[:2]
    return out.withColumn("net", F.round(F.col(f"total_{first}") - F.col(f"total_{second}"), 2))


def labelled_totals(cells: DataFrame, labels: dict[str, str]) -> DataFrame:
    """[AGG-06] cells(doc, sheet, row, label, value): the value of the last row whose label starts with each text."""
    aggs = [F.max_by("value", F.when(F.startswith(F.upper("label"), F.lit(text.upper())), F.col("row"))).alias(name) for name, text in labels.items()]
    return cells.groupBy("doc", "sheet").agg(*aggs)


def unpivot_charges(rows: DataFrame, ids: list[str], charges: list[str]) -> DataFrame:
    """[AGG-07] One line a charge that isn't null or zero."""
    return rows.unpivot(ids, charges, "charge", "amount").where(F.col("amount").isNotNull() & (F.col("amount") != 0))


def charge_groups(lines: DataFrame, child: str, order: str) -> DataFrame:
    """[AGG-09] All lines of each child in order, with the first measures given. Lines that repeat a number are ordered by
    term and amount, and of measures that still tie the smallest counts, so no line has to be left out."""
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.struct(order, "term", "amount", c))).alias(c)
    return lines.groupBy(child).agg(
        F.min(order).alias("first_line"),
        first("cbm"),
        first("kgs"),
        F.array_sort(F.collect_list(F.struct(order, "term", "amount"))).alias("lines"),
    )


def usage_totals(usages: DataFrame, key: str, order: str) -> DataFrame:
    """[AGG-16] Token counters summed, calls counted as one if null, provider and model of the first."""
    return usages.groupBy(key).agg(
        *[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("input_tokens", "output_tokens")],
        F.sum(F.coalesce("calls", F.lit(1))).alias("calls"),
        *[F.min_by(c, order).alias(c) for c in ("provider", "model")],
    )


def batch_metrics(files: DataFrame) -> DataFrame:
    """[AGG-13] files(ok, passed, score, ms): counts, the mean score (failed files count as 0) and the time."""
    return files.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("ok").alias("succeeded"),
        F.count_if(~F.col("ok")).alias("failed"),
        F.count_if(F.col("ok") & F.col("passed")).alias("passed"),
        F.count_if(F.col("ok") & ~F.col("passed")).alias("failed_validation"),
        F.round(F.avg(F.when(F.col("ok"), F.col("score")).otherwise(0)), 1).alias("avg_score"),
        F.sum("ms").alias("total_ms"),
    )
