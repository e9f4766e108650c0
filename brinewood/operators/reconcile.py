"""Reconciliation of record sources with field-level precedence and provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brinewood.functions.parties import cleaner_name
from brinewood.functions.text import is_blank, longer, union_codes
from brinewood.operators.dedup import keep_first


def merge_fields(primary: str, secondary: str, columns: list[str], prefer_secondary: tuple[str, ...] = ()) -> list[Column]:
    """[RUL-13] Columns of two joined sides (aliases): fill if blank, with the order turned for some columns."""
    def value(side: str, c: str) -> Column:
        x = F.col(f"{side}.{c}")
        return F.when(~is_blank(x.cast("string")), x)

    return [(F.coalesce(value(secondary, c), value(primary, c)) if c in prefer_secondary else F.coalesce(value(primary, c), value(secondary, c))).alias(c) for c in columns]


def reconcile_lists(primary: DataFrame, fallback: DataFrame, key: str, order: str, columns: list[str], prefer_fallback: tuple[str, ...] = ()) -> DataFrame:
    """[JN-01] Full outer join on the key: matched rows merged field by field, unmatched rows of both sides kept, rows
    without key appended as they are. `source` tells where a row comes from. One row a key goes on, the first by order."""
    left = keep_first(primary, F.col(key), [F.col(order)], keyless="drop").alias("p")
    right = keep_first(fallback, F.col(key), [F.col(order)], keyless="drop").alias("f")
    joined = left.join(right, F.col(f"p.{key}") == F.col(f"f.{key}"), "full_outer")
    source = F.when(F.col(f"f.{key}").isNull(), "primary").when(F.col(f"p.{key}").isNull(), "fallback").otherwise("both")
    merged = joined.select(F.coalesce(F.col(f"p.{key}"), F.col(f"f.{key}")).alias(key), *merge_fields("p", "f", columns, prefer_fallback), source.alias("source"))
    loose = lambda df, name: df.where(F.col(key).isNull()).select(key, *columns, F.lit(name).alias("source"))
    return merged.unionByName(loose(primary, "primary")).unionByName(loose(fallback, "fallback"))


#: How a field is decided: the sides in order of trust, or a function of both.
POLICIES = ("first", "second", "longer", "cleaner", "union")


def reconcile_record(joined: DataFrame, columns: dict[str, str], first: str = "p", second: str = "f") -> DataFrame:
    """[RUL-14, JN-02] Per field a policy: `first` or `second` side wins if it isn't blank, the `longer` text, the `cleaner`
    name, or the `union` of codes. Returns the fields and `provenance`, a map of field to side (or both)."""
    out, prov = [], []
    for c, policy in columns.items():
        a, b = F.col(f"{first}.{c}"), F.col(f"{second}.{c}")
        has_a, has_b = ~is_blank(a.cast("string"), "trimmed"), ~is_blank(b.cast("string"), "trimmed")
        if policy == "union":
            value, who = union_codes(a, b), F.when(has_a & has_b, "both").when(has_a, first).when(has_b, second)
        elif policy == "longer":
            value = F.when(has_a & has_b, longer(a, b)).when(has_a, a).when(has_b, b)
            who = F.when(has_a & (~has_b | (F.length(a) >= F.length(b))), first).when(has_b, second)
        elif policy == "cleaner":
            value = cleaner_name(a, b)
            who = F.when(has_a & (~has_b | (value == a)), first).when(has_b, second)
        else:
            x, y, nx, ny = (a, b, first, second) if policy == "first" else (b, a, second, first)
            hx, hy = (has_a, has_b) if policy == "first" else (has_b, has_a)
            value, who = F.when(hx, x).when(hy, y), F.when(hx, nx).when(hy, ny)
        out.append(value.alias(c))
        prov.append(F.struct(F.lit(c).alias("key"), who.alias("value")))
    entries = F.filter(F.array(*prov), lambda e: e["value"].isNotNull())
    return joined.select(*[k for k in joined.columns if k not in columns and joined.columns.count(k) == 1], *out, F.map_from_entries(entries).alias("provenance"))


def canonical_join(canonical: DataFrame, records: DataFrame, pages: DataFrame) -> DataFrame:
    """[JN-03] canonical(doc, page, number) left-joined to records(doc, number, ...) by the digits of the number, else to
    pages(doc, page, ...) by page. Of records whose numbers have the same digits the smallest counts, so a canonical row
    stays one. Rows that neither anchors are dropped; `anchor` tells which did."""
    digits = lambda c: F.regexp_replace(c, "[^0-9]", "")
    by_no = records.select(F.col("doc").alias("d1"), digits(F.col("number")).alias("k1"), F.struct(*[c for c in records.columns if c != "doc"]).alias("by_number"))
    by_no = by_no.where("k1 != ''").groupBy("d1", "k1").agg(F.min("by_number").alias("by_number"))
    by_page = pages.select(F.col("doc").alias("d2"), F.col("page").alias("p2"), F.struct(*[c for c in pages.columns if c not in ("doc", "page")]).alias("by_page"))
    joined = canonical.join(by_no, (F.col("doc") == F.col("d1")) & (digits(F.col("number")) == F.col("k1")), "left")
    joined = joined.join(by_page, (F.col("doc") == F.col("d2")) & (F.col("page") == F.col("p2")), "left")
    anchor = F.when(F.col("by_number").isNotNull(), "number").when(F.col("by_page").isNotNull(), "page")
    return joined.withColumn("anchor", anchor).where("anchor is not null").drop("d1", "k1", "d2", "p2")


def record_page(records: DataFrame, pages: DataFrame) -> DataFrame:
    """[JN-04] records(doc, id, page_no) with their page's text: by number, else the first page of the document that
    contains the id, else null. The containment test runs inside the document, never across documents."""
    direct = records.join(pages.select("doc", F.col("page").alias("page_no"), "text"), ["doc", "page_no"], "left")
    found = direct.where("text is not null")
    open_ = direct.where("text is null").drop("text")
    within = open_.join(pages, "doc", "left")
    hit = F.contains(F.upper("text"), F.upper("id"))
    first = within.groupBy("doc", "id", "page_no").agg(F.min_by("text", F.when(hit, F.col("page"))).alias("text"))
    return found.select("doc", "id", "page_no", "text").unionByName(first)


def inherit(child: DataFrame, parent: DataFrame, on: Column, columns: list[str], child_alias: str = "c", parent_alias: str = "p") -> DataFrame:
    """[JN-24 to JN-26] Children with blank columns filled from their parent."""
    joined = child.alias(child_alias).join(parent.alias(parent_alias), on, "left")
    keep = [F.col(f"{child_alias}.{c}") for c in child.columns if c not in columns]
    fill = [F.coalesce(F.when(~is_blank(F.col(f"{child_alias}.{c}").cast("string")), F.col(f"{child_alias}.{c}")), F.col(f"{parent_alias}.{c}")).alias(c) for c in columns]
    return joined.select(*keep, *fill)
