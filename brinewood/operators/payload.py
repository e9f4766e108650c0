"""Payloads of a store: maps of fields by the store's catalog, in long form, so that catalogs and dimensions are joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brinewood.functions.dates import normalize_date
from brinewood.functions.numbers import parse_number
from brinewood.functions.text import alnum_upper

#: The mark of a field that is bound to a row, and of names that are never sent.
BIND = "@odata.bind"
NOT_SENT = r"^(?:@|_|dg_)"


def prepare(payloads: DataFrame, catalog: DataFrame, labels: DataFrame, options: DataFrame) -> DataFrame:
    """[PRJ-07] payloads(id, fields map<string,string>) -> (id, raw, key, value, outcome): what becomes of each field.

    catalog(field, aliases array, kind, target, bind_as, most, writable) names the fields; labels(target, id, label) the
    rows that lookups find; options(field, label, code) the codes of option sets. In this order: fields that are bound
    already pass, and their plain names are dropped (`bound`); annotations, inner names and hazard notes are dropped
    (`not_sent`); aliases take their field's name; fields that can't be written are dropped (`read_only`); a lookup's text
    is bound to the one row of its target with that label (`bound_to`), or dropped (`unresolved`, `ambiguous`); dates
    become ISO texts and decimals numbers, else they are dropped (`no_date`, `no_number`); option texts become codes, else
    they are dropped (`no_option`); longer texts are cut (`cut`); all else passes (`sent`). Dropped fields have no key. Of
    several names of one field the field's own wins, then its aliases in their order (`repeated`). Null values and null
    maps are no fields; labels and options are compared by letters and digits.
    """
    names = catalog.select(F.posexplode(F.concat(F.array("field"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("place", "name"), "field", "kind", "target", "bind_as", "most", "writable")
    names = names.groupBy("name").agg(F.min_by(F.struct("place", "field", "kind", "target", "bind_as", "most", "writable"), "place").alias("c"))
    bound = F.transform(F.filter(F.map_keys(F.map_filter("fields", lambda _, v: v.isNotNull())), lambda k: F.endswith(k, F.lit(BIND))), lambda k: F.lower(F.substring(k, 1, F.length(k) - len(BIND))))
    rows = payloads.select("id", bound.alias("bound"), F.explode("fields").alias("raw", "value")).where("value is not null")
    rows = rows.join(names, F.col("raw") == F.col("name"), "left")
    field, kind = F.coalesce("c.field", "raw"), F.coalesce("c.kind", F.lit("text"))
    is_bind = F.endswith("raw", F.lit(BIND))
    taken = F.array_contains("bound", F.lower(field)) | F.array_contains("bound", F.lower("raw"))
    drop = F.when(is_bind, None).when(F.col("raw").rlike(NOT_SENT), "not_sent").when(~F.coalesce("c.writable", F.lit(True)), "read_only").when(taken, "bound")
    rows = rows.select("id", "raw", "value", field.alias("field"), F.when(is_bind, "bind").otherwise(kind).alias("kind"), F.col("c.target").alias("target"), F.coalesce("c.bind_as", field).alias("bind_as"), F.col("c.most").alias("most"), F.coalesce("c.place", F.lit(0)).alias("place"), drop.alias("drop"), alnum_upper(F.col("value")).alias("said"))
    # one row a label, so that ambiguous ones can be told
    found = labels.select("target", alnum_upper(F.col("label")).alias("said"), F.col("id").cast("string").alias("i")).groupBy("target", "said").agg(F.min("i").alias("lo"), F.max("i").alias("hi"))
    codes = options.select("field", alnum_upper(F.col("label")).alias("said"), "code").unionByName(options.select("field", F.col("code").cast("string").alias("said"), "code")).groupBy("field", "said").agg(F.min("code").alias("code"))
    rows = rows.join(found, ["target", "said"], "left").join(codes, ["field", "said"], "left")
    n = parse_number(F.col("value"), "auto")
    day = F.col("day")

    def row(key: Column | None, value: Column | None, outcome: Column | str) -> Column:
        text = lambda x: (F.lit(None) if x is None else x).cast("string")
        return F.struct(text(key).alias("key"), text(value).alias("value"), (F.lit(outcome) if isinstance(outcome, str) else outcome).alias("outcome"))

    rows = rows.withColumns({"n": n, "day": normalize_date(F.col("value"))})
    n, key = F.col("n"), F.col("field")
    number = F.when(n == F.floor(n), F.floor(n).cast("string")).otherwise(n.cast("string"))
    link = F.concat(F.lit("/"), "target", F.lit("("), "lo", F.lit(")"))
    told = (
        F.when(F.col("drop").isNotNull(), row(None, None, F.col("drop")))
        .when(F.col("kind") == "bind", row(F.col("raw"), F.col("value"), "sent"))
        .when((F.col("kind") == "lookup") & F.col("lo").isNull(), row(None, None, "unresolved"))
        .when((F.col("kind") == "lookup") & (F.col("lo") != F.col("hi")), row(None, None, "ambiguous"))
        .when(F.col("kind") == "lookup", row(F.concat("bind_as", F.lit(BIND)), link, "bound_to"))
        .when(F.col("kind") == "date", F.when(day.isNull(), row(None, None, "no_date")).otherwise(row(key, day, "sent")))
        .when(F.col("kind") == "decimal", F.when(n.isNull(), row(None, None, "no_number")).otherwise(row(key, number, "sent")))
        .when(F.col("kind") == "option", F.when(F.col("code").isNull(), row(None, None, "no_option")).otherwise(row(key, F.col("code"), "sent")))
        .when(F.length("value") > F.col("most"), row(key, F.substring("value", F.lit(1), F.col("most")), "cut"))
        .otherwise(row(key, F.col("value"), "sent"))
    )
    out = rows.select("id", "raw", "place", told.alias("t")).select("id", "raw", "place", "t.*")
    first = out.where("key is not null").groupBy("id", "key").agg(F.min(F.struct("place", "raw")).alias("w")).select(F.col("id").alias("_id"), F.col("key").alias("_key"), F.col("w.raw").alias("_raw"))
    joined = out.join(first, (F.col("id") == F.col("_id")) & (F.col("key") == F.col("_key")), "left")
    late = F.col("key").isNotNull() & (F.col("raw") != F.col("_raw"))
    return joined.select("id", "raw", F.when(~late | F.col("key").isNull(), F.col("key")).alias("key"), F.when(~late | F.col("key").isNull(), F.col("value")).alias("value"), F.when(late, "repeated").otherwise(F.col("outcome")).alias("outcome"))


def payload_maps(prepared: DataFrame) -> DataFrame:
    """(id, fields): what is sent, one map an id; an id of which nothing is sent has an empty one."""
    pairs = F.collect_list(F.when(F.col("key").isNotNull(), F.struct("key", "value")))
    return prepared.groupBy("id").agg(F.map_from_entries(F.array_sort(pairs)).alias("fields"))
