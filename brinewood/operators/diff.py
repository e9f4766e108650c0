"""Field differences between two versions of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType


LEAF = "array<struct<path:string,value:string>>"


def leaves(column: Column, kind: DataType, path: Column) -> Column:
    """Array of (path, value) of all leaves of a value of any nested type: dotted names, [i] for elements."""
    if isinstance(kind, StructType):
        parts = [leaves(column[f.name], f.dataType, F.concat(path, F.lit(f".{f.name}"))) for f in kind.fields]
        return F.coalesce(F.concat(*parts), F.array().cast(LEAF)) if parts else F.array().cast(LEAF)
    if isinstance(kind, ArrayType):
        found = F.flatten(F.transform(column, lambda v, i: leaves(v, kind.elementType, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")))))
    elif isinstance(kind, MapType):
        found = F.flatten(F.transform(F.map_entries(column), lambda e: leaves(e["value"], kind.valueType, F.concat(path, F.lit("."), e["key"].cast("string")))))
    else:
        found = F.array(F.struct(path.alias("path"), column.cast("string").alias("value")))
    return F.coalesce(found, F.array().cast(LEAF))


def flatten(df: DataFrame, key: str) -> DataFrame:
    """[PRJ-04] (key, path, value) of all leaves of a row's structs, arrays and maps, however deep."""
    parts = [leaves(F.col(f.name), f.dataType, F.lit(f.name)) for f in df.schema.fields if f.name != key]
    return df.select(key, F.explode(F.concat(*parts)).alias("x")).select(key, "x.path", "x.value")


def without_empty(column: Column, kind: DataType) -> Column:
    """[PRJ-03, PRJ-06] The value without nulls, empty texts, empty lists and structs of nothing, at any depth; null if nothing
    is left. Fields of structs stay, as null."""
    if isinstance(kind, StringType):
        return F.when(column != "", column)
    if isinstance(kind, ArrayType):
        kept = F.filter(F.transform(column, lambda v: without_empty(v, kind.elementType)), lambda v: v.isNotNull())
        return F.when(F.size(kept) > 0, kept)
    if isinstance(kind, MapType):
        kept = F.map_filter(F.transform_values(column, lambda _, v: without_empty(v, kind.valueType)), lambda _, v: v.isNotNull())
        return F.when(F.size(kept) > 0, kept)
    if isinstance(kind, StructType):
        parts = [without_empty(column[f.name], f.dataType) for f in kind.fields]
        some = sum((p.isNotNull().cast("int") for p in parts), F.lit(0)) > 0
        return F.when(some, F.struct(*[p.alias(f.name) for p, f in zip(parts, kind.fields, strict=True)]))
    return column


def drop_empty(df: DataFrame, *keep: str) -> DataFrame:
    """[PRJ-03, PRJ-06] All columns but `keep` without what is empty."""
    return df.select(*[F.col(f.name) if f.name in keep else without_empty(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields])


def field_diff(sent: DataFrame, saved: DataFrame, keys: list[str]) -> DataFrame:
    """[JN-23, DQ-03] Full outer join of (keys, path, value): saved, different, not_saved or extra. Nulls count as absent."""
    a = sent.where("value is not null").withColumnRenamed("value", "sent")
    b = saved.where("value is not null").withColumnRenamed("value", "saved")
    status = F.when(F.col("saved").isNull(), "not_saved").when(F.col("sent").isNull(), "extra").when(F.col("sent") == F.col("saved"), "saved").otherwise("different")
    return a.join(b, [*keys, "path"], "full_outer").withColumn("status", status)


def prune(entries, allow: tuple[str, ...] = ()):
    """[PRJ-02, PRJ-05] A map without annotations, underscore keys and empty values."""
    return F.map_filter(entries, lambda k, v: v.isNotNull() & (v != "") & (k.isin(*allow) | (~F.startswith(k, F.lit("_")) & ~F.contains(k, F.lit("@")))))


def json_leaves(df: DataFrame, key: str, column: str, most: int = 64) -> DataFrame:
    """[PRJ-04] (key, path, value) of all leaves of JSON texts of any shape: dotted names, [i] for elements; an empty object or
    array is a leaf, a JSON null has a null value.

    Each round opens the objects and arrays of one depth (variant_explode_outer, which leaves what is none as it is), so the
    rounds are as many as the deepest text is deep, at most `most`; deeper texts are an error. Rows that don't parse have no
    leaves. The rounds stop at a depth that a first pass over the texts counts, once for each shape of brackets.
    """
    shape = F.regexp_replace(column, r'"(?:[^"\\]++|\\.)*+"|[^"\[\]{}]+|"', "")
    shapes = df.select(shape.alias("shape")).distinct()
    signs = F.filter(F.split("shape", ""), lambda c: c != "")
    step = lambda acc, c: F.struct((acc["now"] + F.when(c.isin("{", "["), 1).otherwise(-1)).alias("now"), F.greatest(acc["top"], acc["now"] + F.when(c.isin("{", "["), 1).otherwise(-1)).alias("top"))
    depth = F.aggregate(signs, F.struct(F.lit(0).alias("now"), F.lit(0).alias("top")), step, lambda acc: acc["top"])
    deepest = shapes.agg(F.max(depth)).first()[0] or 0
    if deepest > most:
        raise ValueError(f"JSON of depth {deepest}; at most {most} are opened")
    rows = df.select(F.col(key).alias("_key"), F.lit("").alias("path"), F.try_parse_json(column).alias("v")).where("v is not null")
    for _ in range(deepest):
        spread = rows.lateralJoin(df.sparkSession.tvf.variant_explode_outer(F.col("v").outer()))
        name = F.when(F.col("key").isNull(), F.concat("path", F.lit("["), F.col("pos").cast("string"), F.lit("]"))).when(F.col("path") == "", F.col("key")).otherwise(F.concat_ws(".", "path", "key"))
        rows = spread.select("_key", F.when(F.col("pos").isNull(), F.col("path")).otherwise(name).alias("path"), F.coalesce("value", "v").alias("v"))
    return rows.select(F.col("_key").alias(key), "path", F.expr("cast(v AS string)").alias("value"))
