"""Registered queries of the record engine over the driver's tables, and the same in SQL.

The tables hold no shipping documents; here orders stand for parents, line items for children, customers, suppliers,
parts and nations for dimensions, documents for raw text, conversations for paged documents and events for the audit
log. The document layouts themselves are tested on fixtures of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brinewood.functions import dates, ids, numbers, text
from brinewood.operators import dedup, diff, grid, link, lookup, pages, quality, reconcile, rollup, rules
from brinewood.operators.shape import over_limits
from brinewood.plans.registry import ORACLES, QUERIES, query, read
from brinewood.streaming import audit, windows

# ---- roll-ups and reconciliation -------------------------------------------------------------------------------


@query("""
WITH s AS (SELECT l_orderkey, round(sum(l_extendedprice), 2) AS computed, count(*) AS n_lines FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey, o_totalprice AS stated, computed, coalesce(n_lines, 0) AS n_lines, round(o_totalprice - computed, 2) AS difference,
  CASE WHEN computed IS NULL THEN 'missing' WHEN abs(o_totalprice - computed) <= 0.02 THEN 'match' ELSE 'mismatch' END AS status
FROM orders LEFT JOIN s ON o_orderkey = l_orderkey""")
def recon_totals(spark, sf_dir):
    """[AGG-08] Stated parent total against the sum of its children, with tolerance and status."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("stated"))
    sums = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("computed"), F.count(F.lit(1)).alias("n_lines"))
    joined = orders.join(sums, orders.o_orderkey == sums.l_orderkey, "left")
    status = rollup.tolerance_status(F.col("stated"), F.col("computed"), 0.02)
    return joined.select("o_orderkey", "stated", "computed", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.round(F.col("stated") - F.col("computed"), 2).alias("difference"), status.alias("status"))


@query("""
WITH t AS (SELECT l_orderkey, round_even(sum(CASE WHEN l_quantity BETWEEN 0 AND 1000000 THEN l_quantity END), 3) AS q, count(*) AS n FROM lineitem GROUP BY 1)
SELECT o_orderkey, CASE WHEN n >= 2 THEN q ELSE (o_custkey % 40)::DOUBLE END AS quantity, coalesce(n, 0) AS n_children,
  CASE WHEN n >= 2 THEN round_even((o_custkey % 40)::DOUBLE - q, 3) END AS quantity_difference
FROM orders LEFT JOIN t ON o_orderkey = l_orderkey""")
def master_rollup_overwrite(spark, sf_dir):
    """[AGG-01, AGG-02] Two children or more overwrite the parent's stated quantity."""
    parents = read(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 40).cast("double").alias("quantity"))
    children = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_quantity").alias("quantity"))
    totals = rollup.child_totals(children, "o_orderkey", ["quantity"], {"quantity": "packages"})
    return rollup.overwrite_totals(parents, totals, "o_orderkey", ["quantity"])


@query("""
WITH t AS (SELECT l_orderkey, round_even(sum(l_quantity), 3) AS q FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN 5.0::DOUBLE END, q) AS quantity FROM orders LEFT JOIN t ON o_orderkey = l_orderkey""")
def fill_missing_totals(spark, sf_dir):
    """[AGG-04, AGG-11] Positive stated totals stay, others come from the children."""
    parents = read(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, 5.0).otherwise(0.0).alias("quantity"))
    children = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_quantity").alias("quantity"))
    return rollup.fill_totals(parents, rollup.child_totals(children, "o_orderkey", ["quantity"]), "o_orderkey", ["quantity"])


@query("""
SELECT l_linestatus, count(*) FILTER (l_returnflag = 'A') AS n_debit, round(coalesce(sum(l_extendedprice) FILTER (l_returnflag = 'A'), 0), 2) AS total_debit,
  count(*) FILTER (l_returnflag = 'R') AS n_credit, round(coalesce(sum(l_extendedprice) FILTER (l_returnflag = 'R'), 0), 2) AS total_credit,
  round(round(coalesce(sum(l_extendedprice) FILTER (l_returnflag = 'A'), 0), 2) - round(coalesce(sum(l_extendedprice) FILTER (l_returnflag = 'R'), 0), 2), 2) AS net
FROM lineitem GROUP BY 1""")
def cond_class_totals(spark, sf_dir):
    """[AGG-05] Debit and credit style sums and their net."""
    classes = {"debit": F.col("l_returnflag") == "A", "credit": F.col("l_returnflag") == "R"}
    return rollup.class_totals(read(spark, sf_dir, "lineitem"), ["l_linestatus"], F.col("l_extendedprice").cast("decimal(18,2)"), classes).select(
        "l_linestatus", "n_debit", F.col("total_debit").cast("double").alias("total_debit"), "n_credit", F.col("total_credit").cast("double").alias("total_credit"), F.col("net").cast("double").alias("net")
    )


@query("""
SELECT count(*) AS total, count(*) FILTER (event_type <> 'error') AS succeeded, count(*) FILTER (event_type = 'error') AS failed,
  count(*) FILTER (event_type <> 'error' AND value >= 10) AS passed, count(*) FILTER (event_type <> 'error' AND value < 10) AS failed_validation,
  round(avg(CASE WHEN event_type <> 'error' THEN floor(value) ELSE 0 END), 1) AS avg_score, sum(event_id)::BIGINT AS total_ms FROM events""")
def batch_metrics(spark, sf_dir):
    """[AGG-13] Counts of outcomes, the mean score with failures as 0, and total time."""
    files = read(spark, sf_dir, "events").select((F.col("event_type") != "error").alias("ok"), (F.col("value") >= 10).alias("passed"), F.floor("value").cast("double").alias("score"), F.col("event_id").alias("ms"))
    return rollup.batch_metrics(files)


@query("""
SELECT l_orderkey, l_linenumber, charge, amount FROM (
  SELECT l_orderkey, l_linenumber, unnest(['l_discount', 'l_tax']) AS charge, unnest([l_discount, l_tax]) AS amount FROM lineitem)
WHERE amount IS NOT NULL AND amount <> 0""")
def unpivot_charges(spark, sf_dir):
    """[AGG-07] Charge columns to lines, zeros dropped."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_tax")
    return rollup.unpivot_charges(lines, ["l_orderkey", "l_linenumber"], ["l_discount", "l_tax"])


_CHARGE_GROUPS = """
SELECT l_orderkey, min(l_linenumber) AS first_line, arg_min(l_quantity, (l_linenumber, l_quantity)) FILTER (l_returnflag = 'A') AS cbm,
  string_agg(l_returnflag || '=' || (l_quantity::BIGINT)::VARCHAR, ',' ORDER BY l_linenumber, l_returnflag, l_quantity) AS lines FROM lineitem GROUP BY 1"""


@query(_CHARGE_GROUPS)
def charge_groups(spark, sf_dir):
    """[AGG-09] All lines of each parent in order, with the first measure given."""
    return _charge_groups(read(spark, sf_dir, "lineitem"))


def _charge_groups(lines: DataFrame) -> DataFrame:
    lines = lines.select(
        "l_orderkey", "l_linenumber", F.col("l_returnflag").alias("term"), F.col("l_quantity").alias("amount"), F.when(F.col("l_returnflag") == "A", F.col("l_quantity")).alias("cbm"), F.lit(None).cast("double").alias("kgs")
    )
    found = rollup.charge_groups(lines, "l_orderkey", "l_linenumber")
    listed = F.array_join(F.transform("lines", lambda x: F.concat(x["term"], F.lit("="), x["amount"].cast("long").cast("string"))), ",")
    return found.select("l_orderkey", "first_line", "cbm", listed.alias("lines"))


@query("""
SELECT p_brand, p_type, sum(l_quantity) AS quantity, count(*) AS n, count(DISTINCT l_orderkey) AS n_orders FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""")
def aggregate_totals(spark, sf_dir):
    """Sums and distinct counts over children joined to a dimension."""
    joined = read(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_quantity").join(read(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    return joined.groupBy("p_brand", "p_type").agg(F.sum("l_quantity").alias("quantity"), F.count(F.lit(1)).alias("n"), F.count_distinct("l_orderkey").alias("n_orders"))


@query("""
SELECT user_id, sum(coalesce(CASE WHEN event_type = 'view' THEN 1 END, 0))::BIGINT AS input_tokens, count(*)::BIGINT AS calls,
  arg_min(event_type, event_id) AS provider FROM events GROUP BY 1""")
def usage_totals(spark, sf_dir):
    """[AGG-16] Counters summed per run, provider of the first call."""
    usages = read(spark, sf_dir, "events").select(
        "user_id", "event_id", F.when(F.col("event_type") == "view", 1).cast("long").alias("input_tokens"), F.lit(0).alias("output_tokens"), F.lit(None).cast("long").alias("calls"), F.col("event_type").alias("provider"), F.lit("m").alias("model")
    )
    return rollup.usage_totals(usages, "user_id", "event_id").select("user_id", "input_tokens", F.col("calls").cast("long").alias("calls"), "provider")


# ---- audit -------------------------------------------------------------------------------------------------------


@query("SELECT event_id, user_id, event_type, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 50 OFFSET 100")
def audit_list_page(spark, sf_dir):
    """[WIN-08] A page of the log, newest first."""
    return audit.page(read(spark, sf_dir, "events"), "ts", "event_id", 50, 100).select("event_id", "user_id", "event_type", "value")


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS status FROM events GROUP BY 1")
def audit_latest_state(spark, sf_dir):
    """[SNK-06, STM-01] The last status of each key of an append-only log."""
    events = read(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.col("event_type").alias("status"))
    return audit.latest_state(events, "user_id", ["ts", "event_id"]).select("user_id", "event_id", "status")


@query("SELECT e.event_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM events r WHERE r.event_id = e.event_id AND r.event_type <> 'error')")
def incremental_open(spark, sf_dir):
    """[STM-05] What a further run has left to do."""
    events = read(spark, sf_dir, "events")
    return audit.not_done(events.select("event_id"), events.select("event_id", (F.col("event_type") == "error").alias("error")), "event_id")


@query("SELECT event_type, sum((props::JSON ->> '$.k')::BIGINT)::BIGINT AS k_sum, count(*) AS n FROM events GROUP BY 1")
def json_props_sum(spark, sf_dir):
    """A JSON field aggregated."""
    k = F.get_json_object("props", "$.k").try_cast("long")
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(k).alias("k_sum"), F.count(F.lit(1)).alias("n"))


@query("""
WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS brk FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, count(*) AS n FROM s GROUP BY user_id, k""")
def retry_sessions(spark, sf_dir):
    """Extra: sessions that a gap of 30 minutes ends."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    events = read(spark, sf_dir, "events").select("user_id", "ts", "event_id")
    broken = F.coalesce(F.col("ts") - F.lag("ts").over(order) > F.expr("INTERVAL 30 MINUTE"), F.lit(True)).cast("int")
    marked = events.withColumn("brk", broken).withColumn("k", F.sum("brk").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("user_id", "k").agg(F.count(F.lit(1)).alias("n")).select("user_id", "n")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def tumbling_counts(spark, sf_dir):
    """Extra: hourly windows."""
    events = read(spark, sf_dir, "events")
    out = windows.tumbling(events, "ts", "1 hour", ["event_type"])
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


@query("SELECT l_returnflag, l_linestatus, (CASE WHEN grouping(l_returnflag) = 1 THEN 3 WHEN grouping(l_linestatus) = 1 THEN 1 ELSE 0 END)::BIGINT AS level, sum(l_quantity) AS total, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup_levels(spark, sf_dir):
    """Extra: totals of every prefix of the keys."""
    return windows.rollup_totals(read(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], F.col("l_quantity")).withColumn("level", F.col("level").cast("long"))


@query("""
SELECT e.event_id, max_by(p.value, p.ts) AS as_of_value FROM (SELECT * FROM events WHERE event_type = 'purchase') e
LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'view' GROUP BY 1, 2) p ON e.user_id = p.user_id AND p.ts <= e.ts GROUP BY e.event_id""")
def as_of_value(spark, sf_dir):
    """Extra: the last view's value at each purchase."""
    events = read(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value", "event_type")
    views = events.where("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    return windows.as_of(events.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), views, "user_id", "ts", "value").select("event_id", "as_of_value")


# ---- text --------------------------------------------------------------------------------------------------------


@query("""SELECT doc_id, length(trim(regexp_replace(regexp_replace(regexp_replace(translate(text, chr(12) || chr(13), chr(10) || chr(10)), '[ \\t]+', ' ', 'g'), ' ?\\n ?', chr(10), 'g'), '\\n{4,}', repeat(chr(10), 3), 'g'), ' ' || chr(10)))::BIGINT AS n FROM documents""")
def normalize_text_len(spark, sf_dir):
    """[STR-01] Lengths of normalised texts."""
    return read(spark, sf_dir, "documents").select("doc_id", F.length(text.normalize_text(F.col("text"))).cast("long").alias("n"))


@query("""SELECT doc_id, nullif(trim(regexp_replace(text, '\\s+', ' ', 'g'), ' ,;:-'), '') AS cleaned,
  nullif(regexp_replace(text, '[^0-9]', '', 'g'), '') AS digits FROM documents""")
def clean_values(spark, sf_dir):
    """[STR-02, STR-03] Cleaned texts and their digits."""
    return read(spark, sf_dir, "documents").select("doc_id", text.clean_value(F.col("text")).alias("cleaned"), text.digits(F.col("text")).alias("digits"))


_WORDS = ["the", "license", "token", "public", "erest", "about"]


@query("SELECT doc_id, (" + " + ".join(f"contains(upper(text), '{w.upper()}')::INT" for w in _WORDS) + ")::BIGINT AS hits FROM documents")
def keyword_hits(spark, sf_dir):
    """[AGG-19] How many keywords a text has."""
    return read(spark, sf_dir, "documents").select("doc_id", pages.keyword_hits(F.col("text"), _WORDS).cast("long").alias("hits"))


@query("""SELECT doc_id, CASE WHEN contains(upper(text), 'LICENSE') AND contains(upper(text), 'PUBLIC') THEN 'license' WHEN contains(upper(text), 'TOKEN =') THEN 'secret'
  WHEN contains(upper(text), ' | ') THEN 'table' ELSE 'generic' END AS layout FROM documents""")
def layout_router(spark, sf_dir):
    """The first layout whose marks a text has."""
    layouts = [("license", ["license", "public"]), ("secret", ["token ="]), ("table", [" | "])]
    return read(spark, sf_dir, "documents").select("doc_id", pages.route(F.col("text"), layouts).alias("layout"))


@query("""
WITH x AS (SELECT doc_id, text, substr(text, 1, 200) AS h FROM documents), c AS (SELECT *, [length(h) - strpos(reverse(h), s) - length(s) + 1 FOR s IN [chr(10), ' .', ' ;', ' ,']] AS a, [strpos(reverse(h), s) FOR s IN [chr(10), ' .', ' ;', ' ,']] AS f FROM x),
w AS (SELECT *, [CASE WHEN f[i] > 0 THEN a[i] ELSE -1 END FOR i IN [1, 2, 3, 4]] AS p FROM c)
SELECT doc_id, CASE WHEN length(text) <= 200 THEN text WHEN p[1] >= 120 THEN rtrim(substr(h, 1, p[1]), ' .,;' || chr(10)) WHEN p[2] >= 120 THEN rtrim(substr(h, 1, p[2]), ' .,;' || chr(10))
  WHEN p[3] >= 120 THEN rtrim(substr(h, 1, p[3]), ' .,;' || chr(10)) WHEN p[4] >= 120 THEN rtrim(substr(h, 1, p[4]), ' .,;' || chr(10)) ELSE rtrim(h, ' ') END AS capped FROM w""")
def smart_truncate(spark, sf_dir):
    """[STR-09] Texts cut at a boundary in the last 40 per cent."""
    return read(spark, sf_dir, "documents").select("doc_id", text.smart_truncate(F.col("text"), 200).alias("capped"))


@query("""SELECT doc_id, 'text' AS field, 1500::INT AS "limit", length(text)::INT AS actual, (length(text) - 1500)::INT AS overflow FROM documents WHERE length(text) > 1500""")
def cap_overflow_report(spark, sf_dir):
    """[STR-10] Values longer than their limits."""
    return over_limits(read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", {"text": 1500})


@query("""
WITH c AS (SELECT doc_id, unnest(regexp_extract_all(text, '\\b[0-9]{9,20}\\b')) AS code, generate_subscripts(regexp_extract_all(text, '\\b[0-9]{9,20}\\b'), 1) AS i FROM documents),
f AS (SELECT doc_id, code, min(i) AS i FROM c GROUP BY 1, 2) SELECT doc_id, string_agg(code, '|' ORDER BY i) AS codes FROM f GROUP BY 1""")
def digits_extract_union(spark, sf_dir):
    """[SET-04, RGX-03] Ordered distinct codes of a text."""
    found = F.regexp_extract_all("text", F.lit(r"(\b[0-9]{9,20}\b)"), F.lit(1))
    return read(spark, sf_dir, "documents").select("doc_id", text.union_codes(F.array_join(found, "|")).alias("codes")).where("codes is not null")


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
n AS (SELECT *, regexp_matches(line, '(?i)token') OR coalesce(regexp_matches(lag(line, 1) OVER w, '(?i)token'), false) OR coalesce(regexp_matches(lag(line, 2) OVER w, '(?i)token'), false) AS near FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
c AS (SELECT doc_id, i, near, unnest(regexp_extract_all(line, '\\b([0-9]{9,20})\\b', 1)) AS code FROM n)
SELECT doc_id, code, min(i)::INT AS first_line FROM c WHERE NOT near AND NOT EXISTS (SELECT 1 FROM c b WHERE b.near AND b.doc_id = c.doc_id AND b.code = c.code) GROUP BY 1, 2""")
def anti_context_codes(spark, sf_dir):
    """[FLT-10] Codes away from lines that mention a context."""
    lines = pages.split_lines(read(spark, sf_dir, "documents"), "doc_id", "text")
    found = pages.anti_context(lines, r"\b([0-9]{9,20})\b", "(?i)token")
    return found.select(F.col("doc").alias("doc_id"), "code", "first_line")


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
s AS (SELECT *, last_value(CASE WHEN length(line) <= 12 THEN i END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS section FROM l)
SELECT doc_id, section::INT AS section, count(*) AS n_lines FROM s WHERE section IS NOT NULL GROUP BY 1, 2""")
def running_section(spark, sf_dir):
    """Lines by the latest short line above them."""
    lines = pages.split_lines(read(spark, sf_dir, "documents"), "doc_id", "text")
    running = Window.partitionBy("doc").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("section", F.last(F.when(F.length("line") <= 12, F.col("line_no")), True).over(running)).where("section is not null")
    return marked.groupBy(F.col("doc").alias("doc_id"), "section").agg(F.count(F.lit(1)).alias("n_lines"))


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS r FROM documents),
c AS (SELECT doc_id, r, unnest(string_split(line, ' | ')) AS value, generate_subscripts(string_split(line, ' | '), 1) - 1 AS c FROM l WHERE contains(line, ' | ')),
a AS (SELECT doc_id, r, c, value AS label FROM c WHERE regexp_matches(value, '^[A-Z]')),
m AS (SELECT a.*, 0 AS way, c.c - a.c AS k, c.value FROM a JOIN c USING (doc_id) WHERE c.r = a.r AND c.c - a.c BETWEEN 1 AND 4 AND trim(c.value) <> ''
  UNION ALL SELECT a.*, 1, c.r - a.r, c.value FROM a JOIN c USING (doc_id) WHERE c.c = a.c AND c.r - a.r BETWEEN 1 AND 4 AND trim(c.value) <> ''),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, r, c ORDER BY way, k) AS n FROM m)
SELECT doc_id, r::INT AS "row", c::INT AS col, label, string_agg(value, '~' ORDER BY way, k) AS vals FROM o WHERE n <= 4 GROUP BY 1, 2, 3, 4""")
def kv_neighborhood(spark, sf_dir):
    """[WIN-15] Label cells with the filled cells right of and below them."""
    lines = pages.split_lines(read(spark, sf_dir, "documents"), "doc_id", "text").where(F.contains("line", F.lit(" | ")))
    cells = lines.select("doc", F.lit("t").alias("sheet"), F.col("line_no").alias("row"), F.posexplode(F.split("line", r" \| ", -1)).alias("col", "value"))
    found = grid.key_values(cells, "^[A-Z]")
    return found.select(F.col("doc").alias("doc_id"), "row", "col", "label", F.array_join("values", "~").alias("vals"))


@query("SELECT page_id, nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '') AS title, nullif(regexp_extract(html, 'lang=\"([a-z]+)\"', 1), '') AS lang FROM pages")
def page_title(spark, sf_dir):
    """Titles and languages of raw markup."""
    return read(spark, sf_dir, "pages").select(
        "page_id", text.blank_to_null(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"), text.blank_to_null(F.regexp_extract("html", 'lang="([a-z]+)"', 1)).alias("lang")
    )


@query("SELECT conv_id, (turn + 1)::INT AS page, trim(text, ' ' || chr(10)) AS text FROM conversations")
def page_split_explode(spark, sf_dir):
    """[RGX-09] Page-marked texts, made of conversations, split again."""
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("--- PAGE "), (F.col("turn") + 1).cast("string"), F.lit(" ---\n"), F.col("text")).alias("t"))
    docs = turns.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "t"))), lambda x: x["t"]), "\n").alias("text"))
    return pages.split_pages(docs, "conv_id", "text").withColumnRenamed("doc", "conv_id")


@query("SELECT conv_id, count(DISTINCT turn) AS n_pages, count(DISTINCT role) AS n_roles FROM conversations GROUP BY 1 HAVING count(DISTINCT turn) >= 2 AND count(DISTINCT role) >= 2")
def multi_page_detect(spark, sf_dir):
    """Documents with two pages and two distinct roles at least."""
    found = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count_distinct("turn").alias("n_pages"), F.count_distinct("role").alias("n_roles"))
    return found.where("n_pages >= 2 and n_roles >= 2")


@query("""
WITH RECURSIVE l AS (SELECT doc_id, line, i, greatest(0, (length(line) - 1) // 2000) AS hi FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
s AS (SELECT doc_id, i, k, length(substr(line, k * 2000 + 1, 2000)) AS n FROM (SELECT *, unnest(range(0, hi + 1)) AS k FROM l)),
p AS MATERIALIZED (SELECT doc_id, n, row_number() OVER (PARTITION BY doc_id ORDER BY i, k) AS pos FROM s),
w AS (SELECT doc_id, pos, n AS size, 0 AS chunk_no FROM p WHERE pos = 1
  UNION ALL SELECT p.doc_id, p.pos, CASE WHEN w.size + 1 + p.n <= 2000 THEN w.size + 1 + p.n ELSE p.n END, w.chunk_no + CASE WHEN w.size + 1 + p.n <= 2000 THEN 0 ELSE 1 END FROM w JOIN p ON p.doc_id = w.doc_id AND p.pos = w.pos + 1)
SELECT doc_id, chunk_no::INT AS chunk_no, max(size)::INT AS n_chars FROM w GROUP BY 1, 2""")
def chunk_pack(spark, sf_dir):
    """[STR-23] Lines of documents packed greedily into chunks of 2000 characters."""
    packed = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.chunk_pack(F.split("text", "\n"), 2000)).alias("chunk_no", "chunk"))
    return packed.select("doc_id", "chunk_no", F.length("chunk").alias("n_chars"))


# ---- dedup and ranking -------------------------------------------------------------------------------------------


@query("""
WITH k AS (SELECT doc_id, md5(nullif(translate(regexp_replace(text, '[^A-Za-z0-9]+', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), '')) AS key FROM documents)
SELECT doc_id, key FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id) AS n FROM k) WHERE n = 1 OR key IS NULL""")
def dedupe_first_by_key(spark, sf_dir):
    """[SET-01] The first row of each key, keyless rows kept."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.md5(text.blank_to_null(text.alnum_upper(F.col("text")))).alias("key"))
    return dedup.keep_first(docs, F.col("key"), [F.col("doc_id")])


@query("""
WITH k AS (SELECT doc_id, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS n FROM documents)
SELECT doc_id, CASE WHEN n = 1 THEN 'unique' ELSE 'duplicate' END AS kind FROM k""")
def dedupe_split_duplicates(spark, sf_dir):
    """[SET-02] Unique rows and duplicates apart."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("key"))
    unique, repeated = dedup.split_duplicates(docs, F.col("key"), [F.col("doc_id")])
    return unique.select("doc_id", F.lit("unique").alias("kind")).unionByName(repeated.select("doc_id", F.lit("duplicate").alias("kind")))


@query("SELECT source, arg_max(doc_id, (n_chars, -doc_id)) AS doc_id, max(n_chars) AS n_chars FROM documents GROUP BY 1")
def keep_best_by_score(spark, sf_dir):
    """[WIN-02, WIN-06, WIN-09, WIN-11] The longest document of each source."""
    docs = read(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    return dedup.keep_best(docs, ["source"], [F.col("n_chars"), -F.col("doc_id")])


@query("""
WITH d AS (SELECT doc_id % 100 AS k, doc_id, CASE WHEN doc_id % 3 = 0 THEN lang END AS lang, CASE WHEN doc_id % 2 = 0 THEN source END AS source FROM documents)
SELECT k, arg_max(lang, doc_id) FILTER (lang IS NOT NULL) AS lang, arg_max(source, doc_id) FILTER (source IS NOT NULL) AS source FROM d GROUP BY 1""")
def fill_from_losers(spark, sf_dir):
    """[WIN-02, SET-10] Each column from the best row that has it."""
    docs = read(spark, sf_dir, "documents").select((F.col("doc_id") % 100).alias("k"), "doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("lang")).alias("lang"), F.when(F.col("doc_id") % 2 == 0, F.col("source")).alias("source"))
    return dedup.fill_from_losers(docs, ["k"], F.col("doc_id")).select("k", "lang", "source")


@query("""
WITH r AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders), c AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)
SELECT r.o_orderkey, CASE WHEN r.n = 1 THEN 'KEEP' WHEN coalesce(c.n, 0) = 0 THEN 'DELETE' ELSE 'REVIEW' END AS action FROM r LEFT JOIN c ON l_orderkey = o_orderkey""")
def cleanup_plan(spark, sf_dir):
    """[WIN-10, SET-11] Keepers, and what to do with the others by their children."""
    children = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("children"))
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice").join(children, "o_orderkey", "left").fillna(0, ["children"])
    return dedup.cleanup_plan(orders, ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], F.col("children")).select("o_orderkey", "action")


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1")
def duplicate_groups(spark, sf_dir):
    """[AGG-17] Keys with several rows."""
    return dedup.duplicate_groups(read(spark, sf_dir, "orders"), ["o_custkey"])


@query("""
SELECT coalesce(o.o_orderkey, c.k) AS o_orderkey, coalesce(c.s, o.o_orderstatus) AS o_orderstatus, coalesce(c.p, o.o_totalprice) AS o_totalprice FROM orders o
FULL JOIN (SELECT CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderkey ELSE o_orderkey + 100000000 END AS k, CASE WHEN o_orderpriority = '1-URGENT' THEN 'X' END AS s, o_totalprice + 1 AS p FROM orders WHERE o_orderstatus = 'P') c ON o.o_orderkey = c.k""")
def upsert_merge(spark, sf_dir):
    """[SET-08, SNK-01 to SNK-03] Changes merged in: updates, null changes that keep, and inserts."""
    orders = read(spark, sf_dir, "orders")
    urgent, low = F.col("o_orderpriority") == "1-URGENT", F.col("o_orderpriority") == "5-LOW"
    changes = orders.where("o_orderstatus = 'P'").select(
        F.when(~low, F.col("o_orderkey")).otherwise(F.col("o_orderkey") + 100000000).alias("o_orderkey"), F.when(urgent, "X").alias("o_orderstatus"), (F.col("o_totalprice") + 1).alias("o_totalprice")
    )
    orders = orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    return dedup.upsert(orders, changes, ["o_orderkey"])


# ---- joins and lookups -------------------------------------------------------------------------------------------


@query("""
SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, coalesce(d.lang, l.toxic::VARCHAR) AS lang, CASE WHEN l.doc_id IS NULL THEN 'primary' WHEN d.doc_id IS NULL THEN 'fallback' ELSE 'both' END AS source
FROM (SELECT doc_id, nullif(lang, 'de') AS lang FROM documents WHERE lang <> 'es') d FULL JOIN labels l ON d.doc_id = l.doc_id""")
def reconcile_full_outer(spark, sf_dir):
    """[JN-01] Two sources reconciled by key, gaps filled, origin told."""
    docs = read(spark, sf_dir, "documents").where("lang <> 'es'").select("doc_id", F.when(F.col("lang") != "de", F.col("lang")).alias("lang"), F.lit(0).alias("ord"))
    labels = read(spark, sf_dir, "labels").select("doc_id", F.col("toxic").cast("string").alias("lang"), F.lit(0).alias("ord"))
    return reconcile.reconcile_lists(docs, labels, "doc_id", "ord", ["lang"])


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN s_name ELSE c_name END AS name, CASE WHEN length(s_name) > length(c_name) THEN s_name ELSE c_name END AS label,
  CASE WHEN c_custkey % 3 <> 0 THEN 'name=p' WHEN s_name IS NOT NULL THEN 'name=f' END AS provenance FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey""")
def precedence_merge(spark, sf_dir):
    """[RUL-14] Per-field precedence with provenance."""
    p = read(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")).alias("name"), F.col("c_name").alias("label")).alias("p")
    f = read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("name"), F.col("s_name").alias("label")).alias("f")
    joined = p.join(f, F.col("c_custkey") == F.col("s_suppkey"), "left")
    out = reconcile.reconcile_record(joined, {"name": "first", "label": "longer"})
    return out.select("c_custkey", "name", "label", F.concat(F.lit("name="), F.col("provenance")["name"]).alias("provenance"))


@query("""
WITH q AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 5 = 1 THEN 'nowhere' ELSE replace(n_name, '_', ' ') END AS k, c_nationkey FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT c_custkey, CASE WHEN c_custkey % 5 > 1 THEN c_nationkey END AS n_nationkey, CASE WHEN k IS NULL THEN 'missing' WHEN k = 'nowhere' THEN 'unresolved' ELSE 'resolved' END AS status FROM q""")
def strict_lookup_status(spark, sf_dir):
    """[JN-10] Names resolved to one id, or why not."""
    nation = read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    named = read(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    name = F.when(F.col("c_custkey") % 5 == 0, None).when(F.col("c_custkey") % 5 == 1, "nowhere").otherwise(F.replace("n_name", F.lit("_"), F.lit(" ")))
    return lookup.strict_lookup(named.select("c_custkey", name.alias("q")), nation, query_id="c_custkey", query_name="q", dim_id="n_nationkey", labels=["n_name"])


@query(r"""
WITH d AS (SELECT min(p_partkey) AS d, p_name AS dn FROM part GROUP BY p_name),
n AS (SELECT s_suppkey AS q, CASE s_suppkey % 4 WHEN 0 THEN split_part(p_name, ' ', 1) || '  ' || s_suppkey WHEN 1 THEN 'Qq ' || s_suppkey || ' (' || split_part(p_name, ' ', 2) || ')' WHEN 2 THEN split_part(p_name, ' ', 1) || ' Trading Co. Ltd.' ELSE 'Zz Yy Xx' END AS qn FROM supplier JOIN part ON p_partkey = s_suppkey),
b AS (SELECT q, trim(regexp_replace(qn, '\s+', ' ', 'g')) AS base FROM n),
t AS (SELECT q, base, list_filter(regexp_split_to_array(base, '\W+'), lambda s: length(s) >= 3) AS w FROM b),
v AS (SELECT q, [base, regexp_extract(base, '^(.*?)\s*\(([^)]+)\)\s*$', 1), regexp_extract(base, '^(.*?)\s*\(([^)]+)\)\s*$', 2),
  trim(regexp_replace(regexp_replace(base, '(?i)\b(?:COMPANY|CO|LTD|LIMITED|LLC|L\.L\.C|INC|CORPORATION|CORP|PRIVATE|PVT|S\.A\.E|S\.A|S\.P\.A)\b\.?', ' ', 'g'), '\s+', ' ', 'g'), ' ,.-'), array_to_string(list_slice(w, 1, 3), ' '), CASE WHEN len(w) >= 2 THEN array_to_string(list_slice(w, 1, 2), ' ') END] AS vs FROM t),
e AS (SELECT q, unnest(vs) AS qn, unnest(range(6)) AS v FROM v),
w AS (SELECT q, v, d, regexp_replace(upper(qn), '[^A-Z0-9]+', '', 'g') AS x, regexp_replace(upper(dn), '[^A-Z0-9]+', '', 'g') AS y, list_distinct(regexp_extract_all(upper(qn), '[A-Z0-9]{3,}')) AS a, list_distinct(regexp_extract_all(upper(dn), '[A-Z0-9]{3,}')) AS b FROM e, d WHERE trim(qn) <> ''),
s AS (SELECT q, v, d, x, CASE WHEN x = y THEN 100 WHEN starts_with(x, y) OR starts_with(y, x) THEN 90 WHEN contains(x, y) OR contains(y, x) THEN 75 ELSE floor(len(list_intersect(a, b)) / greatest(len(a), len(b))::DOUBLE * 60)::INT END AS score FROM w WHERE x <> ''),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY v, score DESC, d) AS n FROM s WHERE score >= 40 AND (v = 0 OR length(x) >= 3 OR score = 100))
SELECT n.q AS s_suppkey, d AS p_partkey, coalesce(score, 0)::INT AS score FROM n LEFT JOIN r ON n.q = r.q AND r.n = 1""")
def fuzzy_lookup_best(spark, sf_dir):
    """[JN-05 to JN-09] The best-scoring dimension row of the first variant of each name that reaches 40: with ids, brackets
    and legal forms in the names, and names of nothing."""
    part = read(spark, sf_dir, "part").select("p_partkey", "p_name")
    dim = part.groupBy("p_name").agg(F.min("p_partkey").alias("p_partkey"))
    named = read(spark, sf_dir, "supplier").select("s_suppkey").join(part, F.col("p_partkey") == F.col("s_suppkey"))
    word, key, kind = lambda n: F.split_part("p_name", F.lit(" "), F.lit(n)), F.col("s_suppkey").cast("string"), F.col("s_suppkey") % 4
    name = F.when(kind == 0, F.concat(word(1), F.lit("  "), key)).when(kind == 1, F.concat(F.lit("Qq "), key, F.lit(" ("), word(2), F.lit(")"))).when(kind == 2, F.concat(word(1), F.lit(" Trading Co. Ltd."))).otherwise("Zz Yy Xx")
    return lookup.fuzzy_lookup(named.select("s_suppkey", name.alias("q")), dim, query_id="s_suppkey", query_name="q", dim_id="p_partkey", dim_name="p_name", least=40)


@query("""
SELECT a.p_partkey AS a, b.p_partkey AS b, levenshtein(a.p_name, b.p_name)::INT AS distance FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey
WHERE a.p_name = b.p_name OR (levenshtein(a.p_name, b.p_name) <= 2 AND levenshtein(a.p_name, b.p_name) / greatest(length(a.p_name), length(b.p_name))::DOUBLE < 0.3)""")
def levenshtein_pairs(spark, sf_dir):
    """[JN-17] Names two edits apart at most, within blocks."""
    part = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    a, b = part.alias("a"), part.alias("b")
    block = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("p_brand", "p_type", "p_size")]
    met = a.join(b, [*block, F.col("a.p_partkey") < F.col("b.p_partkey")]).where(ids.voyage_match(F.col("a.p_name"), F.col("b.p_name")))
    return met.select(F.col("a.p_partkey").alias("a"), F.col("b.p_partkey").alias("b"), F.levenshtein("a.p_name", "b.p_name").alias("distance"))


@query("""
WITH x AS (SELECT o_orderkey AS id, o_orderstatus AS st, 'V' || o_custkey || 'W' AS voyage, o_orderdate::DATE AS d FROM orders),
s AS (SELECT p.id AS payload_id, o.id AS operation_id, 6 + CASE WHEN p.voyage = o.voyage OR (levenshtein(p.voyage, o.voyage) <= 2 AND levenshtein(p.voyage, o.voyage) / greatest(length(p.voyage), length(o.voyage))::DOUBLE < 0.3) THEN 3 ELSE 0 END AS score
  FROM x p JOIN x o ON p.d = o.d AND p.st = 'P' AND o.st = 'F'),
t AS (SELECT *, max(score) OVER (PARTITION BY payload_id) AS top FROM s), u AS (SELECT *, count(*) OVER (PARTITION BY payload_id) AS ties FROM t WHERE score = top)
SELECT payload_id, operation_id, score::INT AS score FROM u WHERE ties = 1""")
def evidence_link(spark, sf_dir):
    """[JN-12, JN-18, JN-19] Parents found by evidence, ties rejected: here the day stands for a container and a date."""
    empty = F.array().cast("array<string>")
    day = F.array(F.col("o_orderdate").cast("date").cast("string"))
    orders = read(spark, sf_dir, "orders")
    side = lambda status: orders.where(F.col("o_orderstatus") == status).select(
        F.col("o_orderkey").alias("id"), F.lit("").alias("vessel"), F.concat(F.lit("V"), F.col("o_custkey").cast("string"), F.lit("W")).alias("voyage"), F.lit("").alias("origin"), F.lit("").alias("destination"),
        day.alias("containers"), empty.alias("seals"), day.alias("dates"), empty.alias("references"),
    )
    return link.best_by_evidence(side("P"), side("F")).select("payload_id", "operation_id", "score")


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN l_orderkey ELSE o_orderkey END AS parent, (l_linenumber % 2 = 1 AND o_orderkey IS NOT NULL) AS adopted
FROM lineitem LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') ON l_orderkey = o_orderkey""")
def orphan_adoption(spark, sf_dir):
    """[JN-14] Children without parent adopted by number."""
    children = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") % 2 == 0, F.col("l_orderkey")).alias("parent"))
    masters = read(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("l_orderkey"))
    return link.adopt_orphans(children, masters, "l_orderkey", "parent").select("l_orderkey", "l_linenumber", "parent", "adopted")


@query("SELECT o_orderkey, o_custkey, coalesce(CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END, c_mktsegment) AS label FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def parent_inherit_fill(spark, sf_dir):
    """[JN-24 to JN-26] Blank columns filled from the parent."""
    child = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).alias("label"))
    parent = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("label"))
    return reconcile.inherit(child, parent, F.col("c.o_custkey") == F.col("p.c_custkey"), ["label"])


@query("""
WITH a AS (SELECT o_orderkey, unnest(['o_orderstatus', 'o_orderpriority']) AS path, unnest([o_orderstatus, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END]) AS sent FROM orders),
b AS (SELECT o_orderkey, unnest(['o_orderstatus', 'o_orderpriority']) AS path, unnest([CASE WHEN o_orderkey % 5 = 0 THEN 'Z' WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderstatus END, o_orderpriority]) AS saved FROM orders)
SELECT o_orderkey, path, sent, saved, CASE WHEN saved IS NULL THEN 'not_saved' WHEN sent IS NULL THEN 'extra' WHEN sent = saved THEN 'saved' ELSE 'different' END AS status
FROM (SELECT * FROM a WHERE sent IS NOT NULL) FULL JOIN (SELECT * FROM b WHERE saved IS NOT NULL) USING (o_orderkey, path)""")
def field_diff(spark, sf_dir):
    """[JN-23, PRJ-04, DQ-03] Two versions of records compared leaf by leaf."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    sent = orders.withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderpriority")))
    saved = orders.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 5 == 0, "Z").when(F.col("o_orderkey") % 11 != 0, F.col("o_orderstatus")))
    return diff.field_diff(diff.flatten(sent, "o_orderkey"), diff.flatten(saved, "o_orderkey"), ["o_orderkey"])


@query("""
WITH h AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 4)
SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM h) AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""")
def semi_anti_filter(spark, sf_dir):
    """Existence and non-existence as semi and anti joins."""
    many = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").count().where("count > 4")
    owing = read(spark, sf_dir, "customer").where("c_acctbal < 0").select("c_custkey")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return orders.join(many, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").join(owing, F.col("o_custkey") == F.col("c_custkey"), "left_anti")


# ---- scalar families ---------------------------------------------------------------------------------------------


@query("""
WITH x AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS p, printf('%.2f', l_extendedprice) AS t FROM lineitem)
SELECT l_orderkey, l_linenumber, p AS plain, p AS european, CASE WHEN p <= 50000 THEN p END AS capped FROM x""")
def number_profiles(spark, sf_dir):
    """[NUM-01, NUM-02, NUM-05] Amounts written in several locales and read again."""
    price = F.format_string("%.2f", F.col("l_extendedprice"))
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", price.alias("us"), F.translate(price, ".", ",").alias("eu"))
    plain = numbers.parse_number(F.concat(F.lit("about "), F.col("us"), F.lit(" kg")), "plain")
    return lines.select("l_orderkey", "l_linenumber", plain.alias("plain"), numbers.parse_number(F.col("eu"), "european").alias("european"), F.when(plain <= 50000, plain).alias("capped"))


@query("""
WITH x AS (SELECT l_orderkey, l_linenumber, l_quantity::INT AS q, floor(l_extendedprice) AS f, l_extendedprice AS p FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN q % 2 = 0 THEN p END AS signed, CASE WHEN f >= 1000 THEN f / 1000 ELSE f END AS lone_comma, f * 1000 + 0.125 AS last_comma, f AS grouped, p AS auto_point, p AS auto_comma, CASE WHEN p * 10 <= 500000 THEN p * 10 END AS weight,
  CASE WHEN q % 2 = 0 THEN -p ELSE p END AS money, NULL::DOUBLE AS none FROM x""")
def number_locales(spark, sf_dir):
    """[NUM-01 to NUM-04, NUM-06] What the profiles disagree on: signs, a lone comma, several commas, groups, the last separator,
    caps of a measure, parentheses; a text without digits is no number."""
    price, q = F.col("l_extendedprice"), F.col("l_quantity").cast("int")
    whole = F.floor(price)
    cents = F.concat(F.format_number(whole, 0), F.substring(F.format_number(price, 2), -3, 3))
    turned = F.translate(cents, ",.", ".,")
    sign = F.when(q % 2 == 0, "").otherwise("-")
    read_ = numbers.parse_number
    return read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", read_(F.concat(F.lit("kg "), sign, cents), "signed").alias("signed"), read_(F.format_number(whole, 0), "decimal_comma").alias("lone_comma"),
        read_(F.concat(F.format_number(whole * 1000, 0), F.lit(",125")), "decimal_comma").alias("last_comma"), read_(F.format_number(whole, 0), "auto").alias("grouped"), read_(cents, "auto").alias("auto_point"), read_(turned, "auto").alias("auto_comma"),
        numbers.capped(price * 10, "weight").alias("weight"), numbers.money(F.concat(F.when(q % 2 == 0, "(USD ").otherwise("$ "), cents, F.when(q % 2 == 0, ")").otherwise(" -"))).alias("money"), read_(F.lit("none"), "european").alias("none"),
    )


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day_first, strftime(o_orderdate, '%Y-%m-%d') AS named, strftime(o_orderdate, '%Y-%m-%d') AS serial FROM orders")
def date_formats(spark, sf_dir):
    """[NUM-09 to NUM-11] Dates written in several forms and read again."""
    day = F.col("o_orderdate").cast("date")
    serial = F.datediff(day, F.lit("1899-12-30").cast("date")).cast("string")
    return read(spark, sf_dir, "orders").select(
        "o_orderkey", dates.normalize_date(F.date_format(day, "dd/MM/yyyy")).alias("day_first"), dates.normalize_date(F.upper(F.date_format(day, "d-MMM-yyyy"))).alias("named"), dates.serial_date(serial).alias("serial")
    )


@query("""
SELECT o_orderkey, CASE o_orderkey % 6 WHEN 1 THEN '20' || strftime(o_orderdate, '%y-%m-%d') WHEN 4 THEN NULL WHEN 5 THEN CASE WHEN day(o_orderdate) <= 12 THEN strftime(make_date(year(o_orderdate), day(o_orderdate), month(o_orderdate)), '%Y-%m-%d') ELSE strftime(o_orderdate, '%Y-%m-%d') END ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day,
  CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate::DATE END AS strict FROM orders""")
def date_forms(spark, sf_dir):
    """[NUM-09, NUM-10] Dates in texts: names on either side, years first, days and months that only one order allows, and
    days that don't exist."""
    k, at = F.col("o_orderkey") % 6, F.col("o_orderdate")
    month = F.upper(F.date_format(at, "MMMM"))
    x = (
        F.when(k == 0, F.concat(F.lit("issued on "), F.date_format(at, "d "), month, F.date_format(at, ", yyyy")))
        .when(k == 1, F.concat(month, F.date_format(at, " d, yy")))
        .when(k == 2, F.date_format(at, "yyyy/MM/dd"))
        .when(k == 3, F.date_format(at, "yyyy-MM-dd'T'HH:mm"))
        .when(k == 4, F.concat(F.lit("31/02/"), F.date_format(at, "yyyy")))
        .otherwise(F.date_format(at, "MM/dd/yyyy"))
    )
    strict = F.when(F.col("o_orderkey") % 2 == 0, F.upper(F.date_format(at, "dd-MMM-yyyy"))).otherwise("13/13/2020")
    return read(spark, sf_dir, "orders").select("o_orderkey", dates.normalize_date(x).alias("day"), dates.strict_date(strict).alias("strict"))


@query("""
WITH b AS (SELECT o_orderkey, 'MSCU' || lpad((o_orderkey * 7919 % 1000000)::VARCHAR, 6, '0') AS body FROM orders),
s AS (SELECT o_orderkey, body, list_sum([(CASE WHEN i <= 4 THEN [24, 30, 13, 32][i] ELSE substr(body, i, 1)::INT END) * (1 << (i - 1)) FOR i IN range(1, 11)]) % 11 % 10 AS d FROM b)
SELECT o_orderkey, body || '-' || d AS text, true AS valid FROM s""")
def container_ids(spark, sf_dir):
    """[STR-08, FLT-02] Container numbers with the standard check digit, checked."""
    body = F.concat(F.lit("MSCU"), F.lpad((F.col("o_orderkey") * 7919 % 1000000).cast("string"), 6, "0"))
    digits = F.array(*[F.lit(str(d)) for d in range(10)])
    rows = read(spark, sf_dir, "orders").select("o_orderkey", body.alias("body"))
    full = F.filter(F.transform(digits, lambda d: F.concat(F.col("body"), F.lit("-"), d)), ids.iso6346_valid)
    return rows.select("o_orderkey", F.get(full, F.lit(0)).alias("text")).withColumn("valid", ids.iso6346_valid(F.col("text")))


@query("""SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 WHEN '4-NOT SPECIFIED' THEN 4 WHEN '5-LOW' THEN 5 END::INT AS code FROM orders""")
def option_codes(spark, sf_dir):
    """[NUM-14] Labels to option codes: equality, then a start either way."""
    options = {"1-urgent": 1, "2 HIGH": 2, "3-Medium (normal)": 3, "4": 4, "5-LOW": 5}
    return read(spark, sf_dir, "orders").select("o_orderkey", lookup.option_code(F.col("o_orderpriority"), options).alias("code"))


@query("""SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN 'Prepaid' WHEN event_type = 'signup' THEN 'Collect' END AS term,
  CASE WHEN event_type IN ('view', 'click') THEN 886150000 WHEN event_type = 'signup' THEN 886150001 END AS booking FROM events""")
def freight_rules(spark, sf_dir):
    """[RUL-05] Freight terms and what follows from them."""
    said = F.when(F.col("event_type") == "view", "Freight Prepaid").when(F.col("event_type") == "click", "100000000").when(F.col("event_type") == "signup", "C.C")
    term = rules.freight_term(said)
    return read(spark, sf_dir, "events").select("event_id", term.alias("term"), rules.booking(term)[0].alias("booking"))


@query("""
SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 886150001 WHEN doc_id % 5 = 1 THEN 886150000 END AS status FROM documents""")
def release_votes(spark, sf_dir):
    """[AGG-21] A vote of patterns and stated originals."""
    said = F.when(F.col("doc_id") % 5 == 0, "cargo on TELEX  RELEASE terms").when(F.col("doc_id") % 5 == 1, "THREE (3) ORIGINAL bills, telex release").otherwise("none")
    originals = F.when(F.col("doc_id") % 5 == 1, "3")
    status = rules.release_status(F.lit(None).cast("string"), said, originals, F.lit(False))
    return read(spark, sf_dir, "documents").select("doc_id", status.alias("status"))


# ---- quality -----------------------------------------------------------------------------------------------------


def _verdicts(spark, sf_dir) -> DataFrame:
    labels = read(spark, sf_dir, "labels")
    issues = F.array_compact(
        F.array(
            quality.issue(F.col("quality") == 0, "warning", "low_quality", "text"),
            quality.issue(F.col("toxic") == 1, "critical", "toxic", "text"),
            quality.issue(F.col("doc_id") % 2 == 1, "info", "odd"),
        )
    )
    return quality.judge(labels, issues)


@query("""
SELECT doc_id, (greatest(0, 100 - 30 * toxic - 10 * (1 - quality) - 2 * (doc_id % 2)))::INT AS score, (toxic = 0) AS passed, (toxic + (1 - quality) + doc_id % 2)::INT AS n_issues FROM labels""")
def quality_score_record(spark, sf_dir):
    """[DQ-01] Issues, score and verdict of records."""
    return _verdicts(spark, sf_dir).select("doc_id", F.col("score").cast("int").alias("score"), "passed", F.size("issues").alias("n_issues"))


@query("""
WITH r AS (SELECT l.doc_id, source, greatest(0, 100 - 30 * toxic - 10 * (1 - quality) - 2 * (l.doc_id % 2)) AS s, toxic = 0 AS p FROM labels l JOIN documents USING (doc_id)),
e AS (SELECT source, count(*) AS want FROM documents GROUP BY 1), d AS (SELECT source, count(*) AS n, avg(s) AS mean, bool_and(p) AS allp FROM r GROUP BY 1),
j AS (SELECT source, coalesce(n, 0) AS n, want, mean, allp FROM e LEFT JOIN d USING (source)),
i AS (SELECT *, CASE WHEN n = 0 THEN 25 WHEN n < want THEN 25 ELSE 0 END + CASE WHEN n > want THEN 8 ELSE 0 END + CASE WHEN n <> want THEN 2 ELSE 0 END AS cost FROM j)
SELECT source AS doc, n AS n_records, want AS n_expected, floor(coalesce(mean, 0) * 0.7 + (100 - cost) * 0.3)::INT AS score, (n = want AND floor(coalesce(mean, 0) * 0.7 + (100 - cost) * 0.3) >= 60 AND coalesce(allp, false)) AS passed FROM i""")
def quality_score_doc(spark, sf_dir):
    """[DQ-02, AGG-14] Documents' scores from their records and their own issues."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source")
    records = _verdicts(spark, sf_dir).join(docs, "doc_id").select(F.col("source").alias("doc"), F.col("doc_id").cast("string").alias("key"), "score", "passed")
    expected = docs.groupBy(F.col("source").alias("doc")).agg(F.count(F.lit(1)).alias("n_expected"))
    return quality.document_report(records, expected).drop("issues")


from brinewood.plans import field_queries, record_queries, sink_queries  # noqa: E402, F401  (they register themselves)
