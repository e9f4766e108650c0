"""What only large tables bring about: numbers that repeat on a page, keys that many rows share, stores of many levels."""

import time

from pyspark.sql import functions as F

from brinewood.functions import scored
from brinewood.operators import diff, graph, layouts, link, tables


def test_grid_columns_that_one_number_heads_stay_apart(spark):
    words = [("A1111", 100.0, 150.0, 10.0), ("A1111", 200.0, 250.0, 10.0), ("A1111", 300.0, 350.0, 10.0), ("7", 110.0, 120.0, 30.0), ("8", 310.0, 320.0, 30.0), ("Total", 1.0, 40.0, 30.0), ("5", 210.0, 220.0, 50.0), ("Kilos", 1.0, 40.0, 50.0)]
    df = spark.createDataFrame([(1, 1, *w) for w in words], "doc int, page int, word string, x0 double, x1 double, y double")
    assert sorted((r.label, r.number, r.value) for r in tables.visual_grid(df, "A[0-9]{4}").collect()) == [("Kilos", "A1111", "5"), ("Total", "A1111", "7"), ("Total", "A1111", "8")]
    got = tables.package_grid(df, "A[0-9]{4}", {"total": "^TOTAL", "kilos": "^KILOS"})
    assert got.columns == ["doc", "page", "number", "total", "kilos"]
    assert sorted(((r.total, r.kilos) for r in got.collect()), key=str) == [(7.0, None), (8.0, None), (None, 5.0)]


def test_children_of_a_shared_number_are_found_without_pairs(spark):
    q = spark.range(20_000).select(F.col("id").alias("q"), F.lit("N").alias("number"), (F.col("id") % 3).alias("master_id"))
    ops = spark.range(20_000).select("id", F.lit("N").alias("number"), F.when(F.col("id") % 2 == 0, F.col("id") % 4).alias("parent_id"))
    began = time.time()
    got = {r.q: r.id for r in link.scoped_find(q, ops).collect()}
    assert got == {i: (0, 1, 2)[i % 3] for i in range(20_000)}
    assert time.time() - began < 60


def test_a_graph_is_written_twice_and_moved_once(spark):
    levels = [graph.Level("m", ["a"], None, (), ["s"]), graph.Level("h", ["a", "b"], "m", ["a"], ["q"]), graph.Level("c", ["a", "b", "d"], "h", ["a", "b"])]
    m = spark.createDataFrame([(1, "x"), (2, "y"), (2, "z"), (None, "w")], "a long, s string")
    h = spark.createDataFrame([(1, "p", 1), (2, "p", 2), (9, "p", 3), (1, None, 4)], "a long, b string, q int")
    c = spark.createDataFrame([(1, "p", 5), (2, "p", 6), (2, "q", 7)], "a long, b string, d int")
    stored = {"m": spark.createDataFrame([("own", None, 1, "x", 5), ("also", None, 1, "v", 6), ("gone", None, 3, "u", 7)], "id string, parent_id string, a long, s string, more int")}
    first = graph.write(levels, graph.together(levels, [{"m": m, "h": h, "c": c}], stored))
    got = {e: graph.rows_of(levels, first, e).collect() for e in "mhc"}
    assert sorted((r.a, r.id[:4], r.s, r.action, r.more) for r in got["m"] if r.a != 2) == [(1, "also", "x", "updated", 6), (1, "own", "x", "same", 5), (3, "gone", "u", "kept", 7)]
    assert [(r.s, r.action, r.more) for r in got["m"] if r.a == 2] == [("y", "created", None)]
    assert sorted((r.a, r.b, r.parent_id[:4]) for r in got["h"] if r.a == 1) == [(1, "p", "also"), (1, "p", "own")] and len(got["h"]) == len(got["c"]) == 3
    apart = graph.resolve(levels, {"m": m, "h": h, "c": c}, stored)
    assert all(sorted(map(str, apart[e].select("id", "parent_id", "action").collect())) == sorted(map(str, graph.rows_of(levels, first, e).select("id", "parent_id", "action").collect())) for e in "mhc")
    second = graph.write(levels, first.withColumn("was", F.col("action")))
    assert {(r.was, r.action) for r in graph.rows_of(levels, second, "c").collect()} == {("created", "same")}
    plan = second._jdf.queryExecution().executedPlan().toString()
    assert sum("Exchange hashpartitioning" in x for x in plan.splitlines()) == 1


def test_numbers_with_units_are_found_without_trying_every_start(spark):
    text = "12.5 PALLETS\nGROSS WEIGHT: 1,250.50 KGS\x01 2020 KGS BOX12 PKG, SAID TO CONTAIN\n3,000 bags S.T.C 4 rolls STC5 BOXES 12 M3"
    one = spark.createDataFrame([(text,), ("",), (None,)], "t string")
    got = one.select(scored.gross_weight(F.col("t")).alias("g"), scored.volume(F.col("t")).alias("v"), scored.package_unit(F.col("t")).alias("u")).collect()
    assert [tuple(r) for r in got] == [(1250.5, 12.0, "BAG"), (None, None, None), (None, None, None)]
    # the unit is told once, not once for each use of it
    plan = one.select(scored.package_unit(F.col("t")))._jdf.queryExecution().analyzed().toString()
    assert plan.count("CTNS") <= 8


def test_lines_below_a_label_are_split_once(spark):
    plan = spark.range(1).select(layouts.after_label(F.col("id").cast("string"), "NOTIFY").alias("x"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("split(") == 1


def test_json_is_parsed_once_however_deep(spark):
    deep = '{"a":[{"b":"{[","c":{}},[],null,"x"],"d":{"e":{"f":[1]}}}'
    texts = spark.createDataFrame([(1, deep), (2, '{"a": {'), (3, '"\\\\"')], "k int, j string")
    leaves = diff.json_leaves(texts, "k", "j")
    assert sorted((r.k, r.path, r.value) for r in leaves.collect()) == [(1, "a[0].b", "{["), (1, "a[0].c", "{}"), (1, "a[1]", "[]"), (1, "a[2]", None), (1, "a[3]", "x"), (1, "d.e.f[0]", "1"), (3, "", "\\")]
    plan = leaves._jdf.queryExecution().analyzed().toString()
    assert plan.count("parse_json(") + plan.count("parseJson(") == 1 and "Union" not in plan


def test_cargo_lines_are_completed_without_joins(spark):
    text = "SHIPPER: A\n5 PALLETS\nSHIPPER: B\n--- PAGE 2 ---\n20 KGS\n7 PALLETS\n30 KGS\nSHIPPER: C\n2 CBM\n--- PAGE 3 ---\n9 CBM"
    docs = spark.createDataFrame([(1, text), (2, "x"), (3, None)], "doc int, text string")
    got = layouts.groupage(docs)
    assert sorted((r.doc, r.shipper, r.packages, r.gross_kg, r.volume_cbm) for r in got.collect()) == [(1, "A", 5, None, None), (1, "B", 7, 20, 9), (1, "C", None, None, 2)]
    assert "Join" not in got._jdf.queryExecution().analyzed().toString()
