"""Fuzzy lookup against all pairs, with a word that every name has."""

import random

import pytest
from pyspark.sql import functions as F

from brinewood.operators import lookup


@pytest.mark.parametrize("least", [1, 25, 40, 60, 75, 90, 100])
def test_blocks_lose_no_pair(spark, least):
    r = random.Random(least)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "ab", "x", "nile"]
    make = lambda n: [(i, "trading " * r.randint(0, 1) + " ".join(r.choices(words, k=r.randint(1, 4)))) for i in range(n)] + [(n, None), (n + 1, ""), (n + 2, "x"), (n + 3, "TRADING")]
    q, d = spark.createDataFrame(make(40), "q int, qn string"), spark.createDataFrame(make(40), "d int, dn string")
    got = {x.q: (x.d, x.score) for x in lookup.fuzzy_lookup(q, d, query_id="q", query_name="qn", dim_id="d", dim_name="dn", least=least, variants=False).collect()}
    every = q.crossJoin(d).withColumn("score", lookup.match_score(F.col("qn"), F.col("dn"))).where(F.col("score") >= least)
    best = {x.q: (x.b.d, x.b.score) for x in every.groupBy("q").agg(F.max_by(F.struct("d", "score"), F.struct("score", -F.col("d"))).alias("b")).collect()}
    assert got == {i: best.get(i, (None, 0)) for i in range(44)}


def test_a_word_of_all_names_joins_nothing(spark):
    q = spark.createDataFrame([(i, f"company number{i} limited") for i in range(300)], "q int, qn string")
    d = q.toDF("d", "dn")
    names = {"query_id": "q", "query_name": "qn", "dim_id": "d", "dim_name": "dn"}
    assert all(x.d == x.q and x.score == 100 for x in lookup.fuzzy_lookup(q, d, **names, variants=False).collect())
