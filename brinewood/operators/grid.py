"""Spreadsheet grids in long form: cells(doc, sheet, row, col, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brinewood.functions.text import alnum_upper


def rows_of(cells: DataFrame) -> DataFrame:
    """(doc, sheet, row, values): one array a row, ordered by column."""
    parts = F.array_sort(F.collect_list(F.struct("col", "value")))
    return cells.groupBy("doc", "sheet", "row").agg(F.transform(parts, lambda x: x["value"]).alias("values"))


def filled(values: Column) -> Column:
    return F.filter(values, lambda v: v.isNotNull() & (F.trim(v) != ""))


def header_score(values: Column, terms: list[str]) -> Column:
    """[AGG-20] How many header terms a row has."""
    upper = F.transform(filled(values), lambda v: F.upper(v))
    return F.size(F.filter(F.array(*[F.lit(t.upper()) for t in terms]), lambda t: F.exists(upper, lambda v: F.contains(v, t))))


def is_total_row(values: Column) -> Column:
    """[FLT-06, FLT-07] The first filled cell starts with total or subtotal."""
    return F.coalesce(F.upper(F.get(filled(values), F.lit(0))).rlike(r"^\s*(SUB\s*-?\s*)?(GRAND\s+)?TOTAL"), F.lit(False))


def is_data_row(values: Column) -> Column:
    """[FLT-06] Something filled, no total, and not two long texts."""
    return (F.size(filled(values)) > 0) & ~is_total_row(values) & (F.size(F.filter(values, lambda v: F.length(v) > 40)) < 2)


def sections(cells: DataFrame, terms: list[str], least_score: int = 3, least_filled: int = 4) -> DataFrame:
    """[WIN-14] Data rows with the latest header row above them: (doc, sheet, row, header_row, values, headers)."""
    rows = rows_of(cells)
    header = (header_score(F.col("values"), terms) >= least_score) & (F.size(filled(F.col("values"))) >= least_filled)
    running = Window.partitionBy("doc", "sheet").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    marked = rows.withColumn("is_header", header)
    marked = marked.withColumn("header_row", F.last(F.when(F.col("is_header"), F.col("row")), True).over(running))
    marked = marked.withColumn("headers", F.last(F.when(F.col("is_header"), F.col("values")), True).over(running))
    return marked.where(~F.col("is_header") & F.col("header_row").isNotNull() & is_data_row(F.col("values"))).drop("is_header")


def records(sectioned: DataFrame, most: int | None = None) -> DataFrame:
    """[PRJ-15, SRC-08] Sectioned rows as maps of normalised header to value; `most` rows a sheet, if given."""
    entries = F.filter(F.arrays_zip(F.transform("headers", lambda h: alnum_upper(h)).alias("k"), F.col("values").alias("v")), lambda e: e["k"].isNotNull() & (e["k"] != "") & e["v"].isNotNull())
    firsts = F.filter(entries, lambda e, i: F.array_position(F.transform(entries, lambda x: x["k"]), e["k"]) == i + 1)
    out = sectioned.select("doc", "sheet", "row", "header_row", F.map_from_entries(F.transform(firsts, lambda e: F.struct(e["k"], e["v"]))).alias("record"))
    if most is not None:
        out = out.withColumn("_n", F.row_number().over(Window.partitionBy("doc", "sheet").orderBy("row"))).where(F.col("_n") <= most).drop("_n")
    return out


def field(record: Column, *names: str) -> Column:
    """[PRJ-15] The first of the header synonyms that the record has."""
    return F.coalesce(*[F.try_element_at(record, alnum_upper(F.lit(n))) for n in names])


def key_values(cells: DataFrame, label: str, most: int = 4, reach: int = 4) -> DataFrame:
    """[WIN-15] Cells that match `label` (a pattern), with up to `most` filled cells right of them, then below, within reach."""
    a = cells.where(F.col("value").rlike(label)).select("doc", "sheet", F.col("row").alias("r"), F.col("col").alias("c"), F.col("value").alias("label"))
    steps = F.explode(F.sequence(F.lit(1), F.lit(reach)))
    right = a.select("*", steps.alias("k")).select("doc", "sheet", "r", "c", "label", F.lit(0).alias("way"), "k", F.col("r").alias("row"), (F.col("c") + F.col("k")).alias("col"))
    down = a.select("*", steps.alias("k")).select("doc", "sheet", "r", "c", "label", F.lit(1).alias("way"), "k", (F.col("r") + F.col("k")).alias("row"), F.col("c").alias("col"))
    met = right.unionByName(down).join(cells.where(F.trim("value") != ""), ["doc", "sheet", "row", "col"])
    found = met.groupBy("doc", "sheet", "r", "c", "label").agg(F.array_sort(F.collect_list(F.struct("way", "k", "value"))).alias("x"))
    return found.select("doc", "sheet", F.col("r").alias("row"), F.col("c").alias("col"), "label", F.transform(F.slice("x", 1, most), lambda x: x["value"]).alias("values"))


def value_below(cells: DataFrame, label: str) -> DataFrame:
    """[PRJ-16] The value in the cell under each label cell."""
    a = cells.where(F.col("value").rlike(label)).select("doc", "sheet", (F.col("row") + 1).alias("row"), "col", F.col("value").alias("label"))
    return a.join(cells, ["doc", "sheet", "row", "col"]).select("doc", "sheet", "label", "value")


def context_lines(cells: DataFrame, header_row: int, most: int = 12) -> DataFrame:
    """[WIN-16] The first filled rows above a header row, joined with bars."""
    above = rows_of(cells.where(F.col("row") < header_row)).withColumn("text", F.array_join(filled(F.col("values")), " | ")).where("text != ''")
    return above.withColumn("_n", F.row_number().over(Window.partitionBy("doc", "sheet").orderBy("row"))).where(F.col("_n") <= most).select("doc", "sheet", "row", "text")


def marked_sheets(cells: DataFrame, first: str, second: str, rows: int = 15) -> DataFrame:
    """[FLT-08, WIN-12] Sheets that have both marks in their first rows, and the row of each."""
    has = lambda m: F.min(F.when(F.contains(F.upper("value"), F.lit(m.upper())), F.col("row")))
    found = cells.where(F.col("row") < rows).groupBy("doc", "sheet").agg(has(first).alias("first_row"), has(second).alias("second_row"))
    return found.where("first_row is not null and second_row is not null")


def section_range(cells: DataFrame, bounds: DataFrame, skip: int = 4) -> DataFrame:
    """[WIN-13] Cells from `skip` rows after the first mark up to the second."""
    return cells.join(bounds, ["doc", "sheet"]).where((F.col("row") >= F.col("first_row") + skip) & (F.col("row") < F.col("second_row"))).drop("first_row", "second_row")
