"""Tables read from pages: grids of placed words, charge tables by a fold over lines, cargo lists that run over page breaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brinewood.functions.numbers import parse_number
from brinewood.functions.text import blank_to_null
from brinewood.operators.pages import PAGE_MARK, split_lines

#: Width of the strips by which spans of words and of column heads are joined.
STRIP = 64


def _strips(x0: Column, x1: Column) -> Column:
    return F.explode(F.sequence(F.floor(x0 / STRIP), F.floor(x1 / STRIP)))


def visual_grid(words: DataFrame, ids: str, tolerance: float = 3.0) -> DataFrame:
    """[RGX-14] words(doc, page, word, x0, x1, y) -> (doc, page, row_no, label, number, value): the cells of grids whose columns
    are headed by numbers that match `ids`.

    Words whose heights differ by no more than `tolerance` from the word above are a row; the first row with two or more
    numbers is the head. A word belongs to the column whose span it overlaps most, the left one of equals, whatever stands
    in the cells before it, so a missing cell moves no other; words left of all columns are the row's label. Words of the
    head, of rows above it, and words that overlap no column are left out. Spans meet by strips of the page, not by pairs
    of all words and columns. Columns are told apart by their place, so those that one number heads stay apart.
    """
    return _cells(words, ids, tolerance).drop("left_edge")


def _cells(words: DataFrame, ids: str, tolerance: float) -> DataFrame:
    """visual_grid with the left edge of each cell's column."""
    page = Window.partitionBy("doc", "page")
    down = page.orderBy("y", "x0", "word")
    rows = words.where("x1 >= x0").withColumn("new", (F.col("y") - F.lag("y").over(down) > tolerance).cast("int"))
    rows = rows.withColumn("row_no", F.coalesce(F.sum("new").over(down), F.lit(0)).cast("int")).withColumn("number", blank_to_null(F.regexp_extract("word", f"^(?:{ids})$", 0)))
    heads = rows.groupBy("doc", "page", "row_no").agg(F.count("number").alias("n")).where("n >= 2").groupBy("doc", "page").agg(F.min("row_no").alias("head"))
    rows = rows.join(heads, ["doc", "page"]).where("row_no >= head")
    columns = rows.where("row_no = head and number is not null").select("doc", "page", "number", F.col("x0").alias("c0"), F.col("x1").alias("c1"))
    left = columns.groupBy("doc", "page").agg(F.min("c0").alias("left"))
    cells = rows.where("row_no > head").drop("number", "new", "head")
    spans = cells.withColumn("strip", _strips(F.col("x0"), F.col("x1"))).join(columns.withColumn("strip", _strips(F.col("c0"), F.col("c1"))), ["doc", "page", "strip"])
    overlap = F.least("x1", "c1") - F.greatest("x0", "c0")
    best = spans.withColumn("overlap", overlap).where("overlap >= 0").groupBy("doc", "page", "row_no", "y", "x0", "x1", "word").agg(F.max(F.struct("overlap", (-F.col("c0")).alias("c"), "number")).alias("m"))
    best = best.select("doc", "page", "row_no", "y", "x0", "word", F.col("m.number").alias("number"), (-F.col("m.c")).alias("left_edge"))
    joined = lambda: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "y", "word"))), lambda w: w["word"]), " ")
    values = best.groupBy("doc", "page", "row_no", "number", "left_edge").agg(joined().alias("value"))
    labels = cells.join(left, ["doc", "page"]).where("x1 < left").groupBy("doc", "page", "row_no").agg(joined().alias("label"))
    return values.join(labels, ["doc", "page", "row_no"], "left").select("doc", "page", "row_no", "label", "number", "value", "left_edge")


def package_grid(words: DataFrame, ids: str, measures: dict[str, str], tolerance: float = 3.0) -> DataFrame:
    """[RGX-14, AGG-11] (doc, page, number, measures...) of visual_grid: for each measure the number in the row whose label
    matches its pattern; the upper one of several rows; a missing cell is null. A row a column, even if numbers repeat."""
    grid = _cells(words, ids, tolerance)
    heads = [F.min_by(parse_number(F.col("value")), F.when(F.upper("label").rlike(p), F.col("row_no"))).alias(m) for m, p in measures.items()]
    return grid.groupBy("doc", "page", "number", "left_edge").agg(*heads).drop("left_edge")


CHARGE = "struct<number:string,kgs:double,cbm:double,description:string,unit:string,quantity:double,unit_price:double,currency:string,debit:double,credit:double>"


def charge_row(line: Column) -> Column:
    """A charge line `NUMBER kgs cbm description... unit quantity price CUR debit credit`; null if it is none."""
    parts = F.split(F.trim(line), r"\s+")

    def read(t: Column) -> Column:
        at = lambda i: F.get(t, F.lit(i) if i >= 0 else F.size(t) + i)
        number = lambda i: at(i).try_cast("double")
        row = F.struct(
            F.upper(at(0)).alias("number"), number(1).alias("kgs"), number(2).alias("cbm"), F.upper(F.array_join(F.slice(t, F.lit(4), F.greatest(F.size(t) - 9, F.lit(0))), " ")).alias("description"),
            F.upper(at(-6)).alias("unit"), number(-5).alias("quantity"), number(-4).alias("unit_price"), F.upper(at(-3)).alias("currency"), number(-2).alias("debit"), number(-1).alias("credit"),
        )
        sound = (F.size(t) >= 9) & F.upper(at(0)).rlike("^[A-Z]{3,}[0-9]{5,}[A-Z0-9]*$") & F.upper(at(-3)).rlike("^[A-Z]{3}$")
        for i in (1, 2, -1, -2, -4, -5):
            sound = sound & number(i).isNotNull()
        return F.when(sound, row)

    return F.get(F.transform(F.array(parts), read), F.lit(0)).cast(CHARGE)


def charge_ledger(docs: DataFrame) -> DataFrame:
    """[WIN-17] docs(doc, text) -> (doc, place, row...): the rows of charge tables, by a fold over each text's lines.

    The state is whether a table is open, the description pending from lines above a row, the row that is still open for
    lines below it, and the rows done. A head with HBL/CNT and DEBIT opens a table, SUB TOTAL or TOTAL: closes it. A line
    that is no row is noise (empty, [..., WWW., copyright, repeated heads), which closes the open row, or it continues: the
    open row if there is one, else the next. Of rows equal in number, description, quantity, price and debit the first
    stays. Null and empty texts have no rows.
    """
    upper = lambda x: F.upper(x)
    none = F.lit(None).cast(CHARGE)
    start = F.struct(F.lit(False).alias("inside"), F.lit("").alias("pending"), none.alias("row"), F.array().cast(f"array<{CHARGE}>").alias("out"))
    flushed = lambda acc: F.when(acc["row"].isNotNull(), F.array_append(acc["out"], acc["row"])).otherwise(acc["out"])
    glue = lambda a, b: F.trim(F.regexp_replace(F.concat_ws(" ", a, b), r"\s+", " "))
    with_text = lambda row, text: row.withField("description", text)

    def state(inside: Column, pending: Column, row: Column, out: Column) -> Column:
        return F.struct(inside.alias("inside"), pending.alias("pending"), row.alias("row"), out.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        u, row = upper(x["line"]), x["row"]
        opens = F.contains(u, F.lit("HBL/CNT")) & F.contains(u, F.lit("DEBIT"))
        closes = F.startswith(u, F.lit("SUB TOTAL")) | F.startswith(u, F.lit("TOTAL:"))
        noise = (u == "") | F.startswith(u, F.lit("[")) | F.startswith(u, F.lit("HBL/CNT")) | F.startswith(u, F.lit("WWW.")) | F.contains(u, F.lit("COPYRIGHT"))
        continued = acc["row"].isNotNull()
        return (
            F.when(opens, state(F.lit(True), F.lit(""), none, flushed(acc)))
            .when(~acc["inside"], acc)
            .when(closes, state(F.lit(False), F.lit(""), none, flushed(acc)))
            .when(row.isNotNull(), state(F.lit(True), F.lit(""), with_text(row, upper(glue(acc["pending"], row["description"]))), flushed(acc)))
            .when(noise, state(F.lit(True), acc["pending"], none, flushed(acc)))
            .when(continued, state(F.lit(True), acc["pending"], with_text(acc["row"], upper(glue(acc["row"]["description"], x["line"]))), acc["out"]))
            .otherwise(state(F.lit(True), glue(acc["pending"], x["line"]), none, acc["out"]))
        )

    lines = F.transform(F.split("text", "\r?\n"), lambda x: F.struct(F.trim(x).alias("line"), charge_row(x).alias("row")))
    rows = docs.select("doc", F.posexplode(F.aggregate(lines, start, step, flushed)).alias("place", "r")).select("doc", "place", "r.*")
    same = ["doc", "number", "description", "quantity", "unit_price", "debit"]
    firsts = rows.groupBy(*same).agg(F.min("place").alias("place"), *[F.min_by(c, "place").alias(c) for c in ("kgs", "cbm", "unit", "currency", "credit")])
    return firsts.select("doc", "place", "number", "kgs", "cbm", "description", "unit", "quantity", "unit_price", "currency", "debit", "credit")


#: Lines that a page of a list begins or ends with, which no row of it runs into.
PAGE_NOISE = r"(?i)^\s*(?:PAGE\s+[0-9]+.*|ATTACHED\s+LIST.*|CARRIED\s+FORWARD.*|BROUGHT\s+FORWARD.*)?\s*$"


def attached_cargo(docs: DataFrame) -> DataFrame:
    """[RGX-16] docs(doc, text) -> (doc, place, shipper, packages, unit, gross_kg, description, first_page, last_page): the rows
    `S/ shipper` of an attached list, whose lines may go on over a page break.

    The list is what follows the first page. A row holds the lines up to the next S/ or a TOTAL line; page marks and the
    lines around them are left out, so that a count on one page and the weight on the next are one row. A row with neither
    count nor weight is none.
    """
    lines = split_lines(docs, "doc", "text")
    order = Window.partitionBy("doc").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    mark = F.col("line").rlike(PAGE_MARK)
    rows = lines.withColumn("page", F.sum(mark.cast("int")).over(order)).where("page > 1").where(~mark & ~F.col("line").rlike(PAGE_NOISE))
    shipper = blank_to_null(F.trim(F.regexp_extract("line", r"(?i)^\s*S/\s+(.+)$", 1)))
    total = F.col("line").rlike(r"(?i)^\s*TOTAL\s*:")
    rows = rows.withColumn("opens", shipper).withColumn("place", F.sum((shipper.isNotNull() | total).cast("int")).over(order))
    rows = rows.withColumn("inside", F.last(F.when(F.col("opens").isNotNull(), True).when(total, False), True).over(order)).where("inside")
    weight = parse_number(blank_to_null(F.regexp_extract("line", r"(?i)GW\s*:\s*([0-9][0-9,. ]*?)\s*-?\s*KGS?", 1)))
    count = r"(?i)\b([0-9]+)\s+(PALLETS?|BOXES|BOX|CARTONS?)\b"
    first = lambda value: F.min_by(value, F.when(value.isNotNull(), F.col("line_no")))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("opens").isNull() & weight.isNull(), F.struct("line_no", F.trim("line").alias("t"))))), lambda x: x["t"]), "\n")
    out = rows.groupBy("doc", "place").agg(
        F.max("opens").alias("shipper"), first(F.regexp_extract("line", count, 1).try_cast("int")).alias("packages"), F.upper(first(blank_to_null(F.regexp_extract("line", count, 2)))).alias("unit"),
        first(weight).alias("gross_kg"), body.alias("description"), F.min("page").alias("first_page"), F.max("page").alias("last_page"),
    )
    return out.where("packages is not null or gross_kg is not null")


def by_running_total(rows: DataFrame, houses: DataFrame, measure: str = "packages", *, place: str = "place", order: str = "house_no") -> DataFrame:
    """[RGX-16, AGG-12] rows(doc, place, measure) under houses(doc, house_no, measure): a list names no house, so the k-th house
    takes rows until its stated total is reached. Adds house_no, and `agrees`: the house's rows sum to what it states. Rows
    beyond all totals have no house. Sums are by whole thousandths, so that they are exact.
    """
    unit = lambda df: F.coalesce(F.bround(df[measure].cast("double") * 1000, 0).cast("long"), F.lit(0))
    up = lambda o: Window.partitionBy("doc").orderBy(o).rowsBetween(Window.unboundedPreceding, 0)
    a = rows.withColumn("_m", unit(rows)).withColumn("_to", F.sum("_m").over(up(place)))
    b = houses.select(F.col("doc").alias("_d"), F.col(order).alias("house_no"), unit(houses).alias("_stated"))
    upto = F.sum("_stated").over(Window.partitionBy("_d").orderBy("house_no").rowsBetween(Window.unboundedPreceding, 0))
    b = b.withColumn("_end", upto).withColumn("_from", F.col("_end") - F.col("_stated"))
    joined = a.join(b, (F.col("doc") == F.col("_d")) & (F.col("_to") > F.col("_from")) & (F.col("_to") <= F.col("_end")), "left")
    summed = F.sum("_m").over(Window.partitionBy("doc", "house_no"))
    return joined.withColumn("agrees", F.when(F.col("house_no").isNotNull(), summed == F.col("_stated"))).drop("_d", "_m", "_to", "_end", "_from", "_stated")
