"""Filter interaction audit: what each filter removes in every order, in long form.

Documents become cells of (part, mask of failed filters) first; cells are unpivoted against the steps of every order, a
running bit-or window over the steps before tells which cells an earlier filter removed, conditional sums give the metrics
of a step, and windows over all orders give each filter's total. Everything is DataFrame functions.

Skew: rows are combined before each shuffle, by (doc_id, text), then by (text, part, labels); the smallest doc_id of a
text is a window over these groups, of which a text has at most four a part, however many copies it has. Beyond the
cells, the work is 600 rows a cell and has no row of a document.

Cases: a null text counts as empty, a null part as the empty one; a row without doc_id is nobody's copy, makes no other
row a copy and has no labels; repeated rows count one by one and share a doc_id, so none is the other's copy; several
labels of a doc_id count as having any of them; very long texts are counted whole; other columns are not read; without
documents there is no row.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brinewood.llm.common import WORD, table

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
COPY = "E"


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions of a text that is not null, by filter letter."""
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(0))
    capitals = F.length(text) - F.length(F.translate(text, UPPER, ""))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * capitals.cast("long") > 2 * F.length(text).cast("long"),
        "D": text.rlike("[#$%&*|]"),
    }


def mask_of(conditions: dict[str, Column], letters: str) -> Column:
    """Failed filters as bits in the order of letters."""
    bits = [F.when(c, F.lit(1 << letters.index(k))).otherwise(F.lit(0)) for k, c in conditions.items()]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return out


def cells(docs: DataFrame, labels: DataFrame, letters: str, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): the documents of each part that fail the filters of mask, and those with labels."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        mask_of(text_filters(text), letters).alias("mask"),
    )
    rows = rows.groupBy("doc_id", "digest", "mask", "part").agg(F.count(F.lit(1)).alias("n"))
    # rows without doc_id meet no label; dealt by their text, they don't end in one task
    rows = rows.withColumn("deal", F.when(F.col("doc_id").isNull(), F.xxhash64("digest", "part")).otherwise(F.lit(0).cast("long")))
    known = labels.groupBy(F.col("doc_id").alias("l_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    known = known.withColumn("l_deal", F.lit(0).cast("long"))
    rows = rows.join(known, (F.col("doc_id") == F.col("l_id")) & (F.col("deal") == F.col("l_deal")), "left")
    rows = rows.select("doc_id", "digest", "mask", "part", "n", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    has_id = F.col("doc_id").isNotNull()
    groups = rows.groupBy("digest", "mask", "part", "good", "toxic").agg(
        F.sum("n").alias("n"),
        F.coalesce(F.sum(F.when(has_id, F.col("n"))), F.lit(0)).alias("known"),
        F.min(F.when(has_id, F.struct("doc_id", "n"))).alias("first"),
    )
    least = F.min("first.doc_id").over(Window.partitionBy("digest"))
    originals = F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(F.lit(0))
    groups = groups.withColumn("least", least).withColumn("copies", F.col("known") - F.coalesce(originals, F.lit(0)))
    both = F.array(
        F.struct(F.col("mask").alias("mask"), (F.col("n") - F.col("copies")).alias("n")),
        F.struct(F.col("mask").bitwiseOR(F.lit(1 << letters.index(COPY))).alias("mask"), F.col("copies").alias("n")),
    )
    split = groups.select("part", "good", "toxic", F.explode(both).alias("x")).where("x.n > 0")
    return split.groupBy("part", F.col("x.mask").alias("mask")).agg(
        F.sum("x.n").alias("n"), F.sum(F.col("x.n") * F.col("good")).alias("good"), F.sum(F.col("x.n") * F.col("toxic")).alias("toxic")
    )


def audit(found: DataFrame, letters: str) -> DataFrame:
    """cells(part, mask, n, good, toxic) -> one row a part, order of all filters and step."""
    orders = F.array(*[F.lit("".join(p)) for p in permutations(letters)])
    long = found.repartition("part").select("*", F.explode(orders).alias("filter_order"))
    long = long.select("*", F.posexplode(F.split("filter_order", "")).alias("at", "letter"))
    bit = F.call_function("shiftleft", F.lit(1), F.instr(F.lit(letters), F.col("letter")) - 1).alias("bit")
    long = long.select("*", bit).withColumn("hit", F.col("mask").bitwiseAND(F.col("bit")))
    before = Window.partitionBy("part", "filter_order", "mask").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    long = long.withColumn("gone", F.coalesce(F.bit_or("hit").over(before), F.lit(0)) != 0)
    fails, there = F.col("hit") != 0, ~F.col("gone")

    def total(condition: Column, what: str = "n") -> Column:
        return F.sum(F.when(condition, F.col(what)).otherwise(F.lit(0))).cast("long")

    steps = long.groupBy("part", "filter_order", "at", "letter").agg(
        total(there & ~fails).alias("kept"),
        total(there & fails).alias("removed"),
        total(fails & F.col("gone")).alias("redundant"),
        total(F.col("mask") == F.col("bit")).alias("unique_fails"),
        total(there & fails, "good").alias("good_lost"),
        total(there & fails, "toxic").alias("toxic_lost"),
    )
    shapley = F.sum("removed").over(Window.partitionBy("part", "letter")).cast("long")
    return steps.select("part", "filter_order", (F.col("at") + 1).cast("int").alias("step"), "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", shapley.alias("shapley"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 120 orders of filters A to E over the whole documents, by source."""
    letters = "ABCDE"
    return audit(cells(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), letters), letters)


ORACLE = r"""
with letters as (select unnest(['A','B','C','D','E']) as l),
orders as (
  select a.l || b.l || c.l || d.l || e.l as filter_order
  from letters a, letters b, letters c, letters d, letters e
  where len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5
),
texts as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t from documents),
worded as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w, min(doc_id) over (partition by t) as least from texts),
labelled as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by doc_id),
failed as (
  select part, doc_id, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic, map {
    'A': len(w) < 200,
    'B': 100 * len(list_distinct(w)) < 50 * len(w),
    'C': 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t),
    'D': regexp_matches(t, '[#$%&*|]'),
    'E': coalesce(doc_id > least, false)
  } as f
  from worded left join labelled using (doc_id)
),
numbered as (select row_number() over () as r, * from failed),
steps as (
  select part, filter_order, s as step, substr(filter_order, s, 1) as l, r, good, toxic,
    f[substr(filter_order, s, 1)] as fails,
    len(list_filter(range(1, s), lambda x: f[substr(filter_order, x, 1)])) > 0 as gone,
    len(list_filter(['A','B','C','D','E'], lambda x: f[x])) as every
  from numbered, orders, unnest([1, 2, 3, 4, 5]) as u(s)
),
sums as (
  select part, filter_order, step, l,
    count(*) filter (not fails and not gone) as kept,
    count(*) filter (fails and not gone) as removed,
    count(*) filter (fails and gone) as redundant,
    count(*) filter (fails and every = 1) as unique_fails,
    coalesce(sum(good) filter (fails and not gone), 0)::bigint as good_lost,
    coalesce(sum(toxic) filter (fails and not gone), 0)::bigint as toxic_lost
  from steps group by all
)
select part, filter_order, step::int as step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) over (partition by part, l))::bigint as shapley
from sums
"""
