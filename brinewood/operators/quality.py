"""Record and document quality: issues as data, scores, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brinewood.functions.ids import form_serial
from brinewood.functions.text import digits, is_blank

#: Points that an issue costs a record, and a document.
RECORD_COST = {"critical": 30, "warning": 10, "info": 2}
DOCUMENT_COST = {"critical": 25, "warning": 8, "info": 2}
PASS_SCORE = 60
#: Ports whose imports need a customs id; phrases of delivery agents; garbled package units.
CUSTOMS_PORTS = ("ALEXANDRIA", "PORT SAID", "SOKHNA", "DAMIETTA")
AGENT_PHRASES = ("DELIVERY AGENT", "FOR DELIVERY PLEASE APPLY")
GARBLED_UNITS = ("ALLETS", "PALLETS")


def _contains_any(x: Column, words: tuple[str, ...]) -> Column:
    text = F.upper(F.coalesce(x, F.lit("")))
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def issue(test: Column, level: str, code: str, field: str | None = None) -> Column:
    return F.when(test, F.struct(F.lit(level).alias("level"), F.lit(code).alias("code"), F.lit(field).cast("string").alias("field")))


def record_issues(parent_no="parent_no", page="page_text") -> Column:
    """[DQ-01] The issues of a record with columns parent_no, consignee, shipper, origin, destination, customs_id,
    packages, gross_kg, tariff_code, error, warnings and page_text."""
    has = lambda c: ~is_blank(F.col(c).cast("string"))
    number = F.trim(F.col(parent_no))
    found = F.array_compact(
        F.array(
            issue(is_blank(number, "trimmed"), "critical", "missing_master_bl", parent_no),
            issue(~is_blank(number, "trimmed") & form_serial(number, F.coalesce(F.col(page), F.lit(""))), "critical", "invalid_master_bl", parent_no),
            issue(has("tariff_code") & has(parent_no) & (digits(F.col("tariff_code")) == digits(number)), "critical", "hscode_equals_bl", "tariff_code"),
            issue(~has("consignee"), "critical", "missing_consignee", "consignee"),
            issue(_contains_any(F.col("consignee"), AGENT_PHRASES), "warning", "consignee_looks_like_agent", "consignee"),
            issue(~has("origin"), "warning", "missing_origin", "origin"),
            issue(~has("destination"), "warning", "missing_destination", "destination"),
            issue(_contains_any(F.col("destination"), CUSTOMS_PORTS) & ~has("customs_id"), "warning", "missing_acid", "customs_id"),
            issue(~has("packages"), "warning", "missing_packages", "packages"),
            issue(F.upper("packages").isin(*GARBLED_UNITS), "warning", "packages_ocr_garbled", "packages"),
            issue(~has("gross_kg"), "warning", "missing_gross_weight", "gross_kg"),
            issue(has("error"), "critical", "record_processing_error"),
        )
    )
    notes = F.transform(F.coalesce("warnings", F.array().cast("array<string>")), lambda _: F.struct(F.lit("info").alias("level"), F.lit("validator_warning").alias("code"), F.lit(None).cast("string").alias("field")))
    return F.concat(found, notes)


def score(issues: Column, cost: dict[str, int]) -> Column:
    """100 less what the issues cost, within 0 and 100."""
    lost = F.lit(0)
    for level, points in cost.items():
        lost = lost + F.size(F.filter(issues, _of(level))) * points
    return F.greatest(F.lit(0), F.least(F.lit(100), F.lit(100) - lost))


def _of(level: str):
    return lambda i: i["level"] == level


def judge(df: DataFrame, issues: Column, cost: dict[str, int] = RECORD_COST) -> DataFrame:
    """[DQ-01] df with issues, score and passed: no critical issue and at least 60 points."""
    df = df.withColumn("issues", issues)
    df = df.withColumn("score", score(F.col("issues"), cost))
    return df.withColumn("passed", ~F.exists("issues", _of("critical")) & (F.col("score") >= PASS_SCORE))


def document_report(records: DataFrame, expected: DataFrame, *, legacy_duplicates: bool = False) -> DataFrame:
    """[DQ-02, AGG-14] Per document of records(doc, key, score, passed): counts against expected(doc, n_expected), missing
    and duplicate keys, and the score: 70 per cent the records' mean, 30 per cent the document's own issues.

    legacy_duplicates: a blank key counts as a duplicate too.
    """
    blank = is_blank(F.col("key"), "trimmed")
    per_doc = records.groupBy("doc").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct(F.when(~blank, F.col("key"))).alias("keys"),
        F.count_if(blank).alias("blanks"),
        F.avg("score").alias("mean"),
        F.every("passed").alias("all_passed"),
    )
    both = expected.join(per_doc, "doc", "full_outer")
    n, want = F.coalesce("n", F.lit(0)), F.coalesce("n_expected", F.lit(0))
    doubled = n - F.coalesce("blanks", F.lit(0)) > F.coalesce("keys", F.lit(0))
    if legacy_duplicates:
        doubled = doubled | (F.coalesce("blanks", F.lit(0)) > 0)
    issues = F.array_compact(
        F.array(
            issue(n == 0, "critical", "no_records"),
            issue((n > 0) & (n < want), "critical", "under_extraction"),
            issue((want > 0) & (n > want), "warning", "over_extraction"),
            issue(doubled, "warning", "duplicate_keys"),
            issue((want > 0) & (n != want), "info", "count_mismatch"),
        )
    )
    both = both.withColumn("issues", issues)
    own = score(F.col("issues"), DOCUMENT_COST)
    total = F.floor(F.coalesce("mean", F.lit(0.0)) * 0.7 + own * 0.3).cast("int")
    passed = ~F.exists("issues", _of("critical")) & (total >= PASS_SCORE) & F.coalesce("all_passed", F.lit(False))
    return both.select("doc", n.alias("n_records"), want.alias("n_expected"), "issues", total.alias("score"), passed.alias("passed"))
