"""Shaping flat records into targets and nested documents, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brinewood.functions.text import blank_to_null, smart_truncate


def computed(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with columns that are computed once a row: a generator stands between them and later steps, which would otherwise
    repeat their expressions wherever they use them."""
    return df.select("*", F.inline(F.array(F.struct(*[v.alias(k) for k, v in columns.items()]))))


def to_template(df: DataFrame, columns: dict[str, str], defaults: dict[str, object] | None = None) -> DataFrame:
    """[PRJ-01, PRJ-11] Exactly the template's columns (name to type): missing ones null, blanks filled by defaults."""
    have, out = set(df.columns), []
    for name, kind in columns.items():
        if defaults and name in defaults:
            x = F.col(name).cast(kind) if name in have else F.lit(None).cast(kind)
            out.append(F.coalesce(blank_to_null(x) if kind == "string" else x, F.lit(defaults[name]).cast(kind)).alias(name))
        else:
            out.append(F.expr(f"cast({f'`{name}`' if name in have else 'null'} AS {kind})").alias(name))
    return df.select(*out)


def party(block: Column, limit: int = 250) -> tuple[Column, Column]:
    """[PRJ-09] (name, address) of a party block: the first filled line, and the lines below up to contact details."""
    lines = F.filter(F.transform(F.split(F.translate(block, "\r", "\n"), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    contact = F.transform(lines, lambda x: x.rlike(r"(?i)^(TEL|PHONE|FAX|E-?MAIL|ATTN|CONTACT)\b"))
    stop = F.array_position(contact, F.lit(True)).cast("int")
    body = F.when(stop > 1, F.slice(lines, 2, stop - 2)).when(F.size(lines) > 1, F.slice(lines, F.lit(2), F.size(lines) - 1))
    return F.get(lines, F.lit(0)), blank_to_null(F.substring(F.array_join(body, "\n"), 1, limit))


def derive(df: DataFrame, derived: dict[str, Column], override: tuple[str, ...] = ()) -> DataFrame:
    """[PRJ-10] Derived values: they win for `override` columns and fill the others."""
    return df.withColumns({c: F.coalesce(x, F.col(c)) if c in override else F.coalesce(blank_to_null(F.col(c)), x) for c, x in derived.items()})


def annotated(fields: Column, name: str) -> Column:
    """[SRC-12] A field of a map by its formatted annotation, its lookup annotation, or raw; trimmed, blank is null."""
    keys = (f"{name}@formatted", f"_{name}_value@formatted", f"_{name}_value", name)
    return F.coalesce(*[blank_to_null(F.trim(F.try_element_at(fields, F.lit(k)))) for k in keys])


def unwrap(payload: Column) -> Column:
    """[PRJ-08] The JSON payload inside `data`, or the first of `value`, or the text itself."""
    return F.coalesce(F.get_json_object(payload, "$.data.data"), F.get_json_object(payload, "$.data"), F.get_json_object(payload, "$.value[0]"), payload)


def nest(masters: DataFrame, children: DataFrame, key: str, name: str, order: str) -> DataFrame:
    """[PRJ-12, PRJ-13] Masters with their children as an ordered array of structs; none is an empty array."""
    fields = [c for c in children.columns if c != key]
    parts = children.groupBy(F.col(key).alias("_k")).agg(F.array_sort(F.collect_list(F.struct(order, *[c for c in fields if c != order]))).alias(name))
    joined = masters.join(parts, F.col(key) == F.col("_k"), "left").drop("_k")
    return joined.withColumn(name, F.coalesce(name, F.array().cast(parts.schema[name].dataType)))


def flatten_operations(docs: DataFrame) -> DataFrame:
    """[SRC-11] One row per house of docs(master_no, vessel, houses array<struct<no, consignee, packages>>, containers
    array<struct<no, seal>>): master columns carried down, the first container alone, a master without houses one row."""
    out = docs.select("master_no", "vessel", F.get("containers", F.lit(0)).alias("c"), F.explode_outer("houses").alias("h"))
    return out.select("master_no", "vessel", F.col("c.no").alias("container_no"), F.col("c.seal").alias("seal_no"), F.col("h.no").alias("house_no"), F.col("h.consignee").alias("consignee"), F.col("h.packages").alias("packages"))


def cap_columns(df: DataFrame, limits: dict[str, int]) -> DataFrame:
    """[STR-09] All registered columns cut to their limits; applying it again changes nothing."""
    return df.withColumns({c: smart_truncate(F.col(c), n) for c, n in limits.items() if c in df.columns})


def over_limits(df: DataFrame, key: str, limits: dict[str, int]) -> DataFrame:
    """[STR-10] (key, field, limit, actual, overflow) of values longer than their limits."""
    rows = F.array(*[F.struct(F.lit(c).alias("field"), F.lit(n).alias("limit"), F.length(c).alias("actual")) for c, n in limits.items() if c in df.columns])
    return df.select(key, F.explode(rows).alias("x")).where("x.actual > x.limit").select(key, "x.*", (F.col("x.actual") - F.col("x.limit")).alias("overflow"))


def by_catalog(df: DataFrame, catalog: list[tuple[str, str, bool]]) -> DataFrame:
    """[RUL-17, PRJ-07] Columns cast as catalog fields (name, kind, writable) say; fields that can't be written are dropped."""
    kinds = {"Decimal": "decimal(38,10)", "Money": "decimal(38,4)", "Integer": "int", "BigInt": "bigint", "Double": "double", "DateTime": "date", "Boolean": "boolean", "Picklist": "int"}
    known = {n: (k, w) for n, k, w in catalog}
    out = []
    for c in df.columns:
        kind, writable = known.get(c, ("String", True))
        if writable:
            out.append((F.col(c).cast("string").try_cast(kinds[kind]) if kind in kinds else F.col(c)).alias(c))
    return df.select(*out)


def expand_references(masters: DataFrame, refs: str, inherited: list[str]) -> DataFrame:
    """[JN-27, RGX-22] One child row per distinct reference of a master, with the inherited columns."""
    return masters.select(*inherited, F.posexplode(F.array_distinct(F.col(refs))).alias("ref_no", "reference"))


def run_meta(df: DataFrame, defaults: dict[str, str], overrides: dict[str, str] | None = None) -> DataFrame:
    """[PRJ-18] Run settings as columns, overrides first."""
    return df.withColumns({k: F.lit((overrides or {}).get(k, v)) for k, v in defaults.items()})


def response(df: DataFrame, key: str, text: str, preview: int = 5000, cap: int = 220_000) -> DataFrame:
    """[SNK-07, DQ-06] (key, body, preview, truncated): the row as JSON, cut with a mark beyond the cap."""
    body = F.to_json(F.struct(*[c for c in df.columns if c != text]))
    cut = F.length("body") > cap
    out = df.select(key, body.alias("body"), F.substring(text, 1, preview).alias("preview"))
    return out.withColumn("truncated", cut).withColumn("body", F.when(cut, F.substring("body", 1, cap)).otherwise(F.col("body")))
