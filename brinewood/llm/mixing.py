"""Mixing sources to target weights by subset sums over document lengths.

Each source gets a budget in words. Whole passes over the source come first; the rest of the budget is a
subset-sum problem over the counts of each length, solved by bounded-knapsack dynamic programming, and the
documents of each length are drawn by seeded hash.

Cases: null and empty texts have size 0 and nothing of them is taken; the null source is a source of its own,
after all others; repeated rows are documents of their own and which of them is taken makes no difference; very long texts
count like any other; the kept columns ride in the struct `row`, so their names can't clash; an empty table gives an empty
result.
"""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brinewood.llm.common import RANK_ROWS, materialize, spread_rank, table, word_count

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
SEED = 17
#: Least width of the dynamic program, in words; it is twice the longest document if that is more.
WINDOW = 1 << 16


def targets(sources: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """sources(source, words) with target, the words that the mix should take of each: shares of the total by weight, at
    most max_repeat times a source's size. Weights go round by code point order, null last.

    What a source can't give is shared among the others by weight until none is above its limit: each round is one
    aggregate over the sources, so there may be any number of them.
    """
    sources = materialize(code_point_order(sources), "sources")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("at") % len(weights) + 1).cast("int"))
    ready = sources.withColumns({"weight": weight.cast("long"), "most": F.col("words") * max_repeat})
    total, share, full = ready.agg(F.sum("words")).first()[0] or 0, -1.0, -1
    while True:
        fits = F.col("most") > share * F.col("weight")
        r = ready.agg(F.sum(F.when(fits, F.col("weight"))).alias("open"), F.sum(F.when(~fits, F.col("most"))).alias("given"), F.count_if(~fits).alias("full")).first()
        if not r["open"] or r["full"] == full:
            break
        share, full = (total - (r["given"] or 0)) / r["open"], r["full"]
    target = F.least(F.col("most").cast("double"), F.greatest(F.lit(float(share)), F.lit(0.0)) * F.col("weight"))
    return ready.select("source", "words", target.alias("target"))


def code_point_order(sources: DataFrame) -> DataFrame:
    """sources with `at`, the place of each in code point order from 0, null last: ranges are ranked apart and lifted by the
    counts before them."""
    parts = max(1, -(-sources.count() // RANK_ROWS))
    ranged = sources.repartitionByRange(parts, F.asc_nulls_last("source")).withColumn("_part", F.spark_partition_id())
    ranged = materialize(ranged, "ranges")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy("_part").orderBy(F.asc_nulls_last("source"))
    return ranged.withColumn("_rank", F.row_number().over(inside) - 1).join(sizes, "_part").withColumn("at", F.col("_before") + F.col("_rank")).drop("_part", "_before", "_rank")


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, seed: int = SEED, window: int = WINDOW) -> np.ndarray:
    """How many documents of each length to take so that their words come as near to the budget as can be.

    First the same share of every length, rounded down; then one more of lengths in seeded order while more than
    `window` words are open; then a bounded knapsack over what is left of each length for the exact remainder.
    """
    total = int((lengths * counts).sum())
    budget = min(budget, total)
    if budget <= 0 or not total:
        return np.zeros(len(lengths), np.int64)
    take = np.array([int(c) * budget // total for c in counts], np.int64)
    left = budget - int((take * lengths).sum())
    window = max(window, 2 * int(lengths.max()))
    order = np.arange(len(lengths))
    random.Random(seed).shuffle(order)
    for i in order:
        if left <= window:
            break
        if take[i] < counts[i] and lengths[i] <= left:
            take[i] += 1
            left -= int(lengths[i])
    # reach: bit s set if s words can be made; by[s]: the piece that first made s
    wide = left + int(lengths.max()) + 1
    mask, reach = (1 << wide) - 1, 1
    pieces: list[tuple[int, int]] = []
    by = np.full(wide, -1, np.int32)
    for i in order:
        spare, size = int(counts[i] - take[i]), 1
        if lengths[i] <= 0:
            continue
        spare = min(spare, wide // int(lengths[i]) + 1)
        while spare > 0 and not reach >> left & 1:
            n = min(size, spare)
            new = (reach << n * int(lengths[i])) & mask & ~reach
            if new:
                bits = np.unpackbits(np.frombuffer(new.to_bytes(wide // 8 + 1, "little"), np.uint8), bitorder="little")
                by[np.flatnonzero(bits[:wide])] = len(pieces)
                pieces.append((int(i), n))
                reach |= new
            spare, size = spare - n, size * 2
        if reach >> left & 1:
            break
    below = reach & ((1 << left + 1) - 1)
    best = below.bit_length() - 1
    above = reach >> left + 1
    if above and (above & -above).bit_length() < left - best:
        best = left + (above & -above).bit_length()
    while best > 0:
        i, n = pieces[by[best]]
        take[i] += n
        best -= n * int(lengths[i])
    return take


def mix(docs: DataFrame, *, text_col: str = "text", source_col: str = "source", keep: tuple[str, ...] = ("doc_id",), weights=WEIGHTS, max_repeat: int = MAX_REPEAT, seed: int = SEED) -> DataFrame:
    """Rows (row, size, source_size, target, copies): how often the mix takes each row of docs.

    `row` holds the columns `keep`. Only lengths and counts are gathered per source; documents are ranked within
    (source, size) in buckets, so that copies of one text may be any share of the rows.
    """
    rows = materialize(docs.select(F.struct(*keep).alias("row"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), F.xxhash64(F.lit(seed), *keep).alias("draw"), F.monotonically_increasing_id().alias("rid")), "mix")
    hist = rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    hist = materialize(hist, "sizes")
    per_source = hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("words"))
    plan = targets(per_source, weights, max_repeat)
    whole = F.when(F.col("words") > 0, F.least(F.lit(max_repeat), F.floor(F.col("target") / F.col("words")))).otherwise(0).cast("int")
    plan = plan.select(F.col("source").alias("p_source"), F.col("words").alias("source_size"), "target", whole.alias("whole"))
    rest = F.when(F.col("whole") == max_repeat, 0).otherwise(F.bround(F.col("target") - F.col("whole") * F.col("source_size"))).cast("long")
    plan = materialize(plan.withColumn("rest", rest), "plan")
    on_source = F.col("source").eqNullSafe(F.col("p_source"))

    def knapsack(pdf: pd.DataFrame) -> pd.DataFrame:
        take = fit(pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64), int(pdf["rest"].iloc[0]), seed)
        return pd.DataFrame({"q_source": pdf["source"], "q_size": pdf["size"], "picked": take})

    # rows of a group come in any order: sort them, since the seeded order is one of places
    quota = hist.join(plan, on_source).select("source", "size", "n", "rest")
    quota = quota.groupBy("source").applyInPandas(lambda pdf: knapsack(pdf.sort_values("size", ignore_index=True)), "q_source string, q_size long, picked long")
    # whole rows may hold texts: only their numbers are ranked
    ranked = spread_rank(rows.select("rid", "source", "size", "draw"), ["source", "size"], F.col("draw"), "rank", rows.count())
    ranked = ranked.join(quota, F.col("source").eqNullSafe(F.col("q_source")) & (F.col("size") == F.col("q_size"))).join(plan, on_source)
    copies = F.col("whole") + (F.col("rank") < F.col("picked")).cast("int")
    decided = ranked.select("rid", "source_size", "target", F.when(F.col("size") > 0, copies).otherwise(F.lit(0)).alias("copies"))
    return rows.select("rid", "row", "size").join(decided, "rid").drop("rid")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select(F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
