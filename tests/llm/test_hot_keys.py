"""Joins on keys that hold half of the rows, and samples of ids that repeat."""

import pytest
from pyspark.sql import functions as F

from brinewood.llm import common, learned, quality


@pytest.mark.parametrize("how", ["inner", "left"])
def test_rows_of_a_hot_key_meet_its_row_once(spark, how):
    rows = spark.range(4000).selectExpr("id", "CASE WHEN id % 2 = 0 THEN 7L WHEN id % 5 = 0 THEN NULL ELSE id END AS key").repartition(5)
    table = spark.range(0, 3000).selectExpr("id AS key", "concat('v', id) AS v")
    got = common.spread_join(rows, table, "key", how)
    assert sorted(got.columns) == ["id", "key", "v"]
    assert sorted(map(str, got.select("id", "key", "v").collect())) == sorted(map(str, rows.join(table, "key", how).select("id", "key", "v").collect()))
    assert common.spread_join(rows.where("id < 0"), table, "key", how).count() == 0


def test_ids_that_repeat_do_not_widen_the_sample(spark, monkeypatch):
    docs = spark.range(3000).selectExpr("CASE WHEN id < 2500 THEN 1L ELSE id END AS doc_id", "concat('text ', id) AS text", "'own' AS score").repartition(4)
    labels = spark.range(3000).selectExpr("CASE WHEN id < 2500 THEN 1L ELSE id END AS doc_id", "CASE WHEN id < 2500 THEN 1 ELSE cast(id % 2 AS int) END AS quality")
    seen = []
    plain = learned.labelled_sample
    monkeypatch.setattr(quality, "labelled_sample", lambda *a: seen.append(plain(*a)) or seen[-1])
    model = quality.train(docs, labels, docs_per_class=40)
    assert seen[0].groupby("label").size().max() <= 40
    scored = quality.predict(docs, model, 1)
    assert scored.columns.count("score") == 1 and scored.where(F.col("score").between(0, 1)).count() == 3000


def test_labels_without_bound_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(learned, "MOST_LABELS", 3)
    rows = spark.range(10).selectExpr("id", "id AS label")
    with pytest.raises(ValueError, match="labels"):
        learned.drawn_labels(rows, "id", "label", 5, 0)
