"""Page-marked documents: split, multi-record detection, block and row layouts, keyword routing, parser registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brinewood.functions.fields import document_number, first_match, measures
from brinewood.functions.text import blank_to_null

PAGE_MARK = r"--- PAGE ([0-9]+) ---"


def split_pages(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """[RGX-09] (doc, page, text) of each page; a text without marks is page 1."""
    parts = F.split(F.col(text), PAGE_MARK, -1)
    numbers = F.regexp_extract_all(F.col(text), F.lit(PAGE_MARK), F.lit(1))
    body = F.when(F.size(numbers) == 0, F.array(F.struct(F.lit("1").alias("n"), F.col(text).alias("t")))).otherwise(
        F.transform(numbers, lambda n, i: F.struct(n.alias("n"), F.get(parts, i + 1).alias("t")))
    )
    return docs.select(F.col(doc).alias("doc"), F.explode(body).alias("x")).select("doc", F.col("x.n").cast("int").alias("page"), F.btrim(F.col("x.t"), F.lit(" \n")).alias("text"))


def split_lines(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, line_no, line), numbered from 0."""
    return docs.select(F.col(doc).alias("doc"), F.posexplode(F.split(F.col(text), "\n", -1)).alias("line_no", "line"))


def multi_record_docs(pages: DataFrame) -> DataFrame:
    """[RGX-10] Documents with at least two pages that carry at least two distinct numbers."""
    found = pages.withColumn("number", document_number(F.col("text")))
    return found.groupBy("doc").agg(F.count_distinct("page").alias("n_pages"), F.count_distinct("number").alias("n_numbers")).where("n_pages >= 2 and n_numbers >= 2")


def page_records(pages: DataFrame) -> DataFrame:
    """[RGX-11, SET-12] One record per page with a number; of pages that repeat a number the first; only for documents
    with two records or more."""
    found = pages.select("doc", "page", document_number(F.col("text")).alias("number"), measures(F.col("text")).alias("m")).where("number is not null")
    first = found.groupBy("doc", "number").agg(F.min("page").alias("page"), F.min_by("m", "page").alias("m"))
    many = first.groupBy("doc").count().where("count >= 2").select("doc")
    return first.join(many, "doc", "left_semi").select("doc", "page", "number", "m.*")


def blocks(docs: DataFrame, doc: str, text: str, anchor: str) -> DataFrame:
    """[RGX-12] (doc, block_no, block): the text from each anchor to the next, what stands before the first dropped."""
    parts = F.split(F.col(text), f"(?={anchor})", -1)
    return docs.select(F.col(doc).alias("doc"), F.posexplode(parts).alias("block_no", "block")).where(F.col("block").rlike(f"^(?:{anchor})"))


def house_blocks(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """[RGX-12, WIN-02, SET-09] Children of a manifest in blocks `HBL: ...`: number, consignee, description and measures;
    of repeated numbers the fullest block, its gaps filled from the others."""
    from brinewood.operators.dedup import fill_from_losers

    b = blocks(docs, doc, text, r"HBL\s*:")
    m = measures(F.col("block"))
    fields = b.select(
        "doc",
        "block_no",
        first_match(F.col("block"), r"HBL\s*:\s*([A-Z0-9-]+)").alias("number"),
        first_match(F.col("block"), r"CNEE[ \t]*:[ \t]*([^\n]+)").alias("consignee"),
        first_match(F.col("block"), r"STC[ \t]*:?[ \t]*([^\n]+)").alias("description"),
        m["packages"].alias("packages"),
        m["gross_kg"].alias("gross_kg"),
        m["volume_cbm"].alias("volume_cbm"),
    ).where("number is not null")
    filled = F.size(F.array_compact(F.array(*[F.col(c).cast("string") for c in ("consignee", "description", "packages", "gross_kg", "volume_cbm")])))
    ranked = fields.withColumn("rank", F.struct(filled.alias("n"), (-F.col("block_no")).alias("o")))
    return fill_from_losers(ranked, ["doc", "number"], F.col("rank"), longest=("description",)).drop("rank").withColumnRenamed("block_no", "first_block")


def manifest_rows(lines: DataFrame) -> DataFrame:
    """[RGX-15] Rows `1 NUMBER ...` of a manifest with the party lines S/, C/, N/ below them; the first of each tag."""
    head = r"^\s*[0-9]{1,3}\s+([A-Z]{2,}[A-Z0-9]*[0-9]{4,}[A-Z0-9]*)\b"
    number = blank_to_null(F.regexp_extract("line", head, 1))
    running = Window.partitionBy("doc").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("number", F.last(number, True).over(running)).where("number is not null")
    tag = F.regexp_extract("line", r"^\s*([SCN])/\s*\S", 1)
    value = blank_to_null(F.trim(F.regexp_extract("line", r"^\s*[SCN]/\s*(.+)$", 1)))
    pick = lambda t: F.min_by(value, F.when(tag == t, F.col("line_no")))
    return rows.groupBy("doc", "number").agg(F.min("line_no").alias("line_no"), pick("S").alias("shipper"), pick("C").alias("consignee"), pick("N").alias("notify"))


def consolidated(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """[RGX-13, AGG-10, AGG-12] (masters, children) of consolidated documents: children are the page records, the master
    sums them and counts distinct numbers."""
    children = page_records(pages)
    masters = children.groupBy("doc").agg(F.count_distinct("number").alias("n_children"), *[F.bround(F.sum(m), 3).alias(m) for m in ("packages", "gross_kg", "volume_cbm")])
    return masters, children


def until_stop(lines: DataFrame, label: str, stop: str, most: int = 5) -> DataFrame:
    """[WIN-18] Up to `most` lines after each label line, until one matches `stop`: (doc, label_no, lines)."""
    running = Window.partitionBy("doc").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    opens, ends = F.col("line").rlike(label), F.col("line").rlike(stop)
    marked = lines.withColumn("label_no", F.last(F.when(opens, F.col("line_no")), True).over(running))
    marked = marked.withColumn("stop_no", F.last(F.when(ends & ~opens, F.col("line_no")), True).over(running))
    inside = F.col("label_no").isNotNull() & ~opens & (F.coalesce("stop_no", F.lit(-1)) < F.col("label_no")) & (F.trim("line") != "")
    kept = marked.where(inside).withColumn("k", F.row_number().over(Window.partitionBy("doc", "label_no").orderBy("line_no"))).where(F.col("k") <= most)
    return kept.groupBy("doc", "label_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: F.trim(x["line"])).alias("lines"))


def anti_context(lines: DataFrame, pattern: str, context: str, back: int = 2) -> DataFrame:
    """[FLT-10] Codes that match the pattern (group 1) in lines where neither the line nor the `back` lines before mention
    the context, and that are not named in such a context anywhere in the document."""
    order = Window.partitionBy("doc").orderBy("line_no")
    near = F.col("line").rlike(context)
    for k in range(1, back + 1):
        near = near | F.coalesce(F.lag("line", k).over(order).rlike(context), F.lit(False))
    coded = lines.withColumn("near", near).select("doc", "line_no", "near", F.explode(F.regexp_extract_all("line", F.lit(pattern), F.lit(1))).alias("code"))
    bad = coded.where("near").select("doc", "code").distinct()
    return coded.where("not near").groupBy("doc", "code").agg(F.min("line_no").alias("first_line")).join(bad, ["doc", "code"], "left_anti")


def keyword_hits(text: Column, words: list[str]) -> Column:
    """[AGG-19] How many of the words a text has."""
    upper = F.upper(text)
    return sum((F.contains(upper, F.lit(w.upper())).cast("int") for w in words), F.lit(0))


def native_or_sparse(text: Column, words: list[str], chars: int = 600, hits: int = 5) -> Column:
    """[SRC-02] native if a text layer is long enough and has enough keywords."""
    return F.when((F.length(text) >= chars) & (keyword_hits(text, words) >= hits), "native").otherwise("native_sparse")


def route(text: Column, layouts: list[tuple[str, list[str]]], default: str = "generic") -> Column:
    """The first layout all of whose marks a text has."""
    upper, out = F.upper(text), F.lit(default)
    for name, marks in reversed(layouts):
        test = F.lit(True)
        for m in marks:
            test = test & F.contains(upper, F.lit(m.upper()))
        out = F.when(test, name).otherwise(out)
    return out


class Registry:
    """[UDF-01, WIN-01] Layout parsers: docs(doc, text) to candidates(doc, parser, confidence, record). A parser that can't be
    planned raises at once; values that can't be read are null, as all parsing columns are total."""

    def __init__(self) -> None:
        self.parsers: list[tuple[str, Callable[[DataFrame], DataFrame]]] = []

    def add(self, name: str, parser: Callable[[DataFrame], DataFrame]) -> None:
        self.parsers.append((name, parser))

    def candidates(self, docs: DataFrame) -> DataFrame:
        out = None
        for k, (name, parser) in enumerate(self.parsers):
            found = parser(docs).select("doc", F.lit(name).alias("parser"), F.lit(k).alias("ordinal"), "confidence", "record")
            out = found if out is None else out.unionByName(found)
        return out

    def best(self, docs: DataFrame) -> DataFrame:
        """The surest candidate of each document, the first parser's of several."""
        rank = F.struct("confidence", -F.col("ordinal"))
        return self.candidates(docs).groupBy("doc").agg(F.max_by(F.struct("parser", "confidence", "record"), rank).alias("b")).select("doc", "b.*")
