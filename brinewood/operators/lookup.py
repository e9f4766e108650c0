"""Dimension lookups: strict with statuses, fuzzy with scores, and option sets.

The dimension is the side that can be broadcast; Spark does so by its measured size and shuffles otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brinewood.functions.text import alnum_upper, blank_to_null, match_text, token_overlap


def match_score(a: Column, b: Column) -> Column:
    """[JN-07] 100 equal, 90 one starts the other, 75 one contains the other, else up to 60 by shared words."""
    x, y = alnum_upper(a), alnum_upper(b)
    words = F.floor(token_overlap(a, b) * 60).cast("int")
    score = F.when(x == y, 100).when(F.startswith(x, y) | F.startswith(y, x), 90).when(F.contains(x, y) | F.contains(y, x), 75).otherwise(words)
    return F.when((x == "") | (y == ""), 0).otherwise(score)


#: Legal forms that a name may carry or not.
LEGAL_FORMS = r"(?i)\b(?:COMPANY|CO|LTD|LIMITED|LLC|L\.L\.C|INC|CORPORATION|CORP|PRIVATE|PVT|S\.A\.E|S\.A|S\.P\.A)\b\.?"


def search_variants(name: Column, hints: dict[str, list[str]] | None = None) -> Column:
    """[JN-06] Ordered distinct alternates: the name, what stands before and in brackets, hints, the name without legal
    forms, and its first three and two words."""
    base = F.trim(F.regexp_replace(name, "\\s+", " "))
    # the last bracket, if the name ends with it: what stands behind the bracket closed before it, from its first opening
    body = F.when(F.endswith(base, F.lit(")")), F.substr(base, F.lit(1), F.length(base) - 1)).otherwise("")
    tail = F.substring_index(body, ")", -1)
    inside = F.when(F.instr(tail, "(") > 0, F.substr(tail, F.instr(tail, "(") + 1)).otherwise("")
    before = F.when(inside != "", F.trim(F.substr(body, F.lit(1), F.length(body) - F.length(inside) - 1))).otherwise("")
    bare = F.btrim(F.regexp_replace(F.regexp_replace(base, LEGAL_FORMS, " "), "\\s+", " "), F.lit(" ,.-"))
    words = F.filter(F.split(base, r"\W+"), lambda w: F.length(w) >= 3)
    parts = [F.array(base, before, inside)]
    for key, others in (hints or {}).items():
        parts.append(F.when(F.contains(alnum_upper(base), alnum_upper(F.lit(key))), F.array(*[F.lit(o) for o in others])).otherwise(F.array().cast("array<string>")))
    parts.append(F.array(bare, F.array_join(F.slice(words, 1, 3), " "), F.when(F.size(words) >= 2, F.array_join(F.slice(words, 1, 2), " "))))
    every = F.filter(F.flatten(F.array(*parts)), lambda v: v.isNotNull() & (F.trim(v) != ""))
    keys = F.transform(every, lambda v: F.upper(F.trim(v)))
    return F.filter(every, lambda v, i: F.array_position(keys, F.upper(F.trim(v))) == i + 1)


def _by_rarity(rows: DataFrame, ids: list[str], among: DataFrame) -> DataFrame:
    """(ids..., ranked): the distinct keys of rows(ids..., k), those that the fewest of among(k) have first; ties by key."""
    counts = among.groupBy(F.col("k").alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    told = rows.join(counts, F.col("k") == F.col("_k"), "left")
    each = F.struct(F.coalesce("_n", F.lit(0).cast("long")).alias("n"), "k")
    return told.groupBy(*ids).agg(F.array_sort(F.collect_set(each)).alias("ranked"))


def fuzzy_lookup(queries: DataFrame, dim: DataFrame, *, query_id: str, query_name: str, dim_id: str, dim_name: str, least: int = 60, variants: bool = True, hints: dict[str, list[str]] | None = None) -> DataFrame:
    """[JN-05, JN-06, JN-08, JN-09] The best dimension row of each query: (query_id, dim_id, score), null id below `least`.

    The first of the name's variants that reaches `least` decides; a variant of less than three characters has to be
    equal. Without `variants` only the name itself is scored. Ties go to the smaller dimension id.

    Every pair that can score `least` is met, by equality joins on rare keys. Names that share so many words as it takes
    share one of their rarest: of n words the first n + 1 - ceil(least / 60 * n), in the order of how many names have
    them; from 60 on that is the rarest word alone. A name inside another has its rarest run of three characters (a
    shorter name: itself) among the other's runs. So a word or run that all names have joins nothing, unless a name has
    no other.
    """
    def words(x: Column) -> Column:
        return F.array_distinct(F.regexp_extract_all(match_text(x), F.lit("([A-Z0-9]{3,})"), F.lit(1)))

    def runs(x: Column, sizes: tuple[int, ...]) -> Column:
        whole = F.flatten(F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.array(*[F.substr(x, i, F.lit(n)) for n in sizes])))
        return F.array_distinct(F.filter(whole, lambda r: F.length(r).isin(*sizes)))

    names = search_variants(F.col("_name"), hints) if variants else F.array("_name")
    named = queries.select(F.col(query_id).alias("_id"), F.col(query_name).alias("_name"))
    q = named.select(F.col("_id").alias("q"), F.posexplode(names).alias("v", "qn")).withColumn("x", alnum_upper("qn")).where("x != ''")
    d = dim.select(F.col(dim_id).alias("d"), F.col(dim_name).alias("dn")).withColumn("y", alnum_upper("dn")).where("y != ''")
    share = max(least, 1) / 60
    met = []
    if share <= 1:
        every = q.select(F.explode(words(F.col("qn"))).alias("k")).unionByName(d.select(F.explode(words(F.col("dn"))).alias("k")))
        n = F.size("ranked")
        prefix = F.explode(F.transform(F.slice("ranked", F.lit(1), n + 1 - F.ceil(n * F.lit(share) - F.lit(1e-9)).cast("int")), lambda r: r["k"])).alias("k")
        a = _by_rarity(q.select("q", "v", F.explode(words(F.col("qn"))).alias("k")), ["q", "v"], every).select("q", "v", prefix)
        b = _by_rarity(d.select("d", F.explode(words(F.col("dn"))).alias("k")), ["d"], every).select("d", prefix)
        met.append(a.join(b, "k").select("q", "v", "d"))
    for inner, own, x, outer, other, y in ((q, ["q", "v"], "x", d, ["d"], "y"), (d, ["d"], "y", q, ["q", "v"], "x")):
        held = outer.select(*other, F.explode(runs(F.col(y), (1, 2, 3))).alias("k"))
        keys = inner.select(*own, F.explode(F.when(F.length(x) < 3, F.array(x)).otherwise(runs(F.col(x), (3,)))).alias("k"))
        # no run of a name inside another is missing from that
        rare = _by_rarity(keys, own, held).select(*own, F.get("ranked", F.lit(0)).alias("r")).where("r.n > 0").select(*own, F.col("r.k").alias("k"))
        met.append(rare.join(held, "k").select("q", "v", "d"))
    pairs = met[0]
    for more in met[1:]:
        pairs = pairs.unionByName(more)
    both = pairs.distinct().join(q, ["q", "v"]).join(d, "d").withColumn("score", match_score(F.col("qn"), F.col("dn")))
    both = both.where((F.col("score") >= least) & ((F.col("v") == 0) | (F.length("x") >= 3) | (F.col("score") == 100)) & (F.col("score") > 0))
    best = both.groupBy("q").agg(F.max_by(F.struct("d", "score"), F.struct(-F.col("v"), "score", -F.col("d"))).alias("b"))
    out = queries.select(F.col(query_id).alias("q"))
    return out.join(best, "q", "left").select(F.col("q").alias(query_id), F.col("b.d").alias(dim_id), F.coalesce("b.score", F.lit(0)).alias("score"))


def strict_lookup(queries: DataFrame, dim: DataFrame, *, query_id: str, query_name: str, dim_id: str, labels: list[str], aliases: dict[str, str] | None = None) -> DataFrame:
    """[JN-10] (query_id, dim_id, status): missing (no name), unresolved (no row), ambiguous (several ids) or resolved.
    A name is replaced by its alias, then has to equal a label of the dimension, compared by letters and digits."""
    name = alnum_upper(F.col(query_name))
    if aliases:
        table = F.create_map(*[F.lit(x) for k, v in aliases.items() for x in (k, v)])
        name = F.coalesce(F.try_element_at(F.transform_values(F.transform_keys(table, lambda k, _: alnum_upper(k)), lambda _, v: alnum_upper(v)), name), name)
    q = queries.select(F.col(query_id), blank_to_null(name).alias("_k"))
    each = dim.select(F.col(dim_id), F.explode(F.array_distinct(F.array(*[alnum_upper(F.col(c).cast("string")) for c in labels]))).alias("_k")).where("_k != ''")
    ids = each.groupBy("_k").agg(F.min(dim_id).alias("lo"), F.max(dim_id).alias("hi"))
    status = F.when(F.col("_k").isNull(), "missing").when(F.col("lo").isNull(), "unresolved").when(F.col("lo") != F.col("hi"), "ambiguous").otherwise("resolved")
    out = q.join(ids, "_k", "left").withColumn("status", status)
    return out.select(query_id, F.when(F.col("status") == "resolved", F.col("lo")).alias(dim_id), "status")


def mapping_plan(facts: DataFrame, key: str, lookups: dict[str, tuple[DataFrame, str, str, list[str], bool]]) -> DataFrame:
    """[JN-11] A star join of strict lookups: name -> (dimension, fact column, id column, label columns, required).
    `ready` holds if no required lookup failed; `errors` lists those that did, with their status."""
    out, errors = facts.select(key), []
    for name, (dim, column, dim_id, labels, required) in lookups.items():
        found = strict_lookup(facts, dim, query_id=key, query_name=column, dim_id=dim_id, labels=labels)
        out = out.join(found.select(key, F.col(dim_id).alias(f"{name}_id"), F.col("status").alias(f"{name}_status")), key, "left")
        if required:
            errors.append(F.when(F.col(f"{name}_status") != "resolved", F.concat(F.lit(f"{name}:"), F.col(f"{name}_status"))))
    listed = F.array_compact(F.array(*errors)) if errors else F.array().cast("array<string>")
    return out.withColumn("errors", listed).withColumn("ready", F.size("errors") == 0)


def option_code(label: Column, options: dict[str, int], synonyms: dict[str, str] | None = None) -> Column:
    """[NUM-14, SRC-15] The code of a label: a valid code as it is, then a synonym, then equality, then a start either way."""
    k = alnum_upper(label)
    number = F.trim(label).try_cast("int")
    codes = list(options.values())
    out = F.lit(None).cast("int")
    for name, code in reversed(options.items()):
        n = alnum_upper(F.lit(name))
        out = F.when((k != "") & (F.startswith(k, n) | F.startswith(n, k)), code).otherwise(out)
    for name, code in reversed(options.items()):
        out = F.when(k == alnum_upper(F.lit(name)), code).otherwise(out)
    for name, target in (synonyms or {}).items():
        out = F.when(k == alnum_upper(F.lit(name)), options[target]).otherwise(out)
    return F.when(number.isin(*codes), number).otherwise(out)


def invoice_scope(lines: DataFrame, key: str, selected: Column) -> DataFrame:
    """[JN-22] The lines of the selected number; all lines if none has it."""
    hit = F.coalesce(alnum_upper(F.col(key)) == alnum_upper(selected), F.lit(False))
    some = lines.agg(F.max(hit.cast("int")).alias("_some"))
    return lines.withColumn("_hit", hit).crossJoin(F.broadcast(some)).where((F.col("_some") == 0) | F.col("_hit")).drop("_hit", "_some")
