"""Registered queries of dictionaries, tables on pages, matching ladders, entity graphs and schemaless differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brinewood.operators import dictionary, diff, graph, payload, posting, rollup, rules, tables
from brinewood.plans.registry import query, read
from brinewood.streaming import live


def _text(x: str) -> Column:
    return F.col(x).cast("string")


# ---- dictionaries ------------------------------------------------------------------------------------------------


@query(r"""
WITH d AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, regexp_extract_all(replace(upper(line), 'ẞ', 'SS'), '[\p{L}\p{N}]+') AS w FROM d),
b AS (SELECT DISTINCT list_slice(regexp_extract_all(replace(upper(text), 'ẞ', 'SS'), '[\p{L}\p{N}]+'), 1, 6) AS p FROM benchmark),
g AS (SELECT doc_id, w[i:i + 5] AS p FROM (SELECT doc_id, w, unnest(range(1, len(w) - 4)) AS i FROM w))
SELECT array_to_string(p, ' ') AS phrase, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM g JOIN b USING (p) GROUP BY 1""")
def benchmark_mentions(spark, sf_dir):
    """[RGX-05] Where documents hold the first six words of a benchmark item, by a join on first words."""
    words = F.slice(dictionary.tokens(F.col("text")), 1, 6)
    names = read(spark, sf_dir, "benchmark").where(F.size(words) == 6).select(F.array_join(words, " ").alias("name")).distinct()
    found = dictionary.annotate(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text"), names)
    return found.groupBy("phrase").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("n_docs"))


@query("""
WITH o AS (SELECT o_orderkey, o_orderkey % 5 AS k, 'SEA STAR ' || o_orderkey AS ship, c_nationkey AS a, (c_nationkey + 1 + o_orderkey % 7) % 25 AS b, (c_nationkey + 9) % 25 AS c FROM orders JOIN customer ON o_custkey = c_custkey),
p AS (SELECT n_nationkey AS k, 'PORT ' || n_name || CASE WHEN n_nationkey % 3 = 0 THEN ' WEST' ELSE '' END AS port, n_regionkey AS region FROM nation)
SELECT o_orderkey, pa.port AS origin, pb.port AS destination, pc.port AS delivery, CASE WHEN o.k IN (1, 2) THEN regexp_replace(ship, '[^A-Z0-9]+', ' ', 'g') END AS vessel, pa.region AS origin_region
FROM o JOIN p pa ON o.a = pa.k JOIN p pb ON o.b = pb.k JOIN p pc ON pc.k = CASE WHEN o.k = 1 THEN o.c ELSE o.b END WHERE o.k < 4""")
def port_routes(spark, sf_dir):
    """[RGX-05, RGX-18] Routes by a table of ports, names of which begin others: behind labels, as a line of values below a head
    of labels, with and without a third port, and loose behind the head; a text without head has none."""
    n = read(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("Port "), "n_name", F.when(F.col("n_nationkey") % 3 == 0, " West").otherwise("")).alias("name"), F.col("n_regionkey").alias("region"))
    short = n.where("n_nationkey % 3 = 0").select((F.col("n_nationkey") + 100).alias("n_nationkey"), F.regexp_replace("name", " West", "").alias("name"), F.lit(-1).alias("region"))
    o = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    o = o.select("o_orderkey", F.col("c_nationkey").alias("a"), ((F.col("c_nationkey") + 1 + F.col("o_orderkey") % 7) % 25).alias("b"), ((F.col("c_nationkey") + 9) % 25).alias("c"))
    for k in "abc":
        o = o.join(n.select(F.col("n_nationkey").alias(k), F.col("name").alias(f"p{k}")), k)
    key, ship = F.col("o_orderkey") % 5, F.concat(F.lit("SEA STAR "), _text("o_orderkey"))
    head = F.lit("VESSEL   PORT OF LOADING   PORT OF DISCHARGE   DELIVERY\n")
    t = (
        F.when(key == 0, F.concat(F.lit("cargo in "), "pc", F.lit("\nPort of Loading: "), "pa", F.lit("  Port of discharge - "), "pb"))
        .when(key == 1, F.concat(head, F.lit("* * *\n"), ship, F.lit("  "), "pa", F.lit(", "), "pb", F.lit(" "), "pc", F.lit("\nMARKS AND NOS")))
        .when(key == 2, F.concat(head, ship, F.lit(" "), F.upper("pa"), F.lit(" "), F.upper("pb"), F.lit(" ***\n"), "pc"))
        .when(key == 3, F.concat(head, F.lit("one\ntwo\nthree\nfour\n"), "pa", F.lit("\n"), "pb", F.lit("\nend")))
        .otherwise(F.concat(F.lit("between "), "pa", F.lit(" "), "pb"))
    )
    texts = o.select(F.col("o_orderkey").alias("doc"), t.alias("text")).repartition(4 * spark.sparkContext.defaultParallelism)
    found = dictionary.routes(texts, n.unionByName(short).select("name", "region"))
    port = lambda c: F.upper(F.col(f"{c}.name")).alias(c)
    return found.where("origin is not null").select(F.col("id").alias("o_orderkey"), port("origin"), port("destination"), port("delivery"), "vessel", F.col("origin.region").alias("origin_region"))


# ---- matching ladder ---------------------------------------------------------------------------------------------


@query("""
WITH u AS (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS l_returnflag, min(l_quantity) AS l_quantity, min(l_extendedprice) AS l_extendedprice, min(l_shipdate) AS l_shipdate FROM lineitem GROUP BY 1, 2),
n AS (SELECT l_orderkey * 100 + l_linenumber AS new_id, l_orderkey AS op, l_returnflag AS name, CASE WHEN l_linenumber % 3 = 0 THEN 'Invoice line ' || l_orderkey || '/' || l_linenumber END AS source_key, round(l_quantity, 2) AS q, round_even(l_extendedprice / l_quantity, 3) AS p FROM u),
e AS (SELECT l_orderkey * 100 + l_linenumber + 1000000000 AS old_id, l_orderkey AS op, l_returnflag AS name, CASE WHEN l_linenumber % 3 = 0 THEN 'Invoice line ' || l_orderkey || '/' || l_linenumber WHEN l_linenumber % 3 = 1 THEN 'Invoice line other' END AS comments, round(l_quantity, 2) AS q,
  round_even(l_extendedprice / l_quantity, 3) AS p, l_shipdate AS day FROM u WHERE l_linenumber <> 4),
r1 AS (SELECT new_id, old_id, 'source_key' AS rule FROM (SELECT *, row_number() OVER (PARTITION BY op, name, source_key ORDER BY new_id) AS k FROM n WHERE source_key IS NOT NULL) a
  JOIN (SELECT *, regexp_extract(comments, '^(Invoice line [^ ]+)', 1) AS ek, row_number() OVER (PARTITION BY op, name, comments ORDER BY day, old_id) AS k FROM e WHERE comments IS NOT NULL) b ON a.op = b.op AND a.name = b.name AND a.source_key = b.ek AND a.k = b.k),
n2 AS (SELECT * FROM n WHERE new_id NOT IN (SELECT new_id FROM r1)), e2 AS (SELECT * FROM e WHERE old_id NOT IN (SELECT old_id FROM r1)),
r2 AS (SELECT new_id, old_id, 'unkeyed' AS rule FROM (SELECT *, row_number() OVER (PARTITION BY op, name ORDER BY new_id) AS k FROM n2) a
  JOIN (SELECT *, row_number() OVER (PARTITION BY op, name ORDER BY day, old_id) AS k FROM e2 WHERE comments IS NULL) b ON a.op = b.op AND a.name = b.name AND a.k = b.k),
n3 AS (SELECT * FROM n2 WHERE new_id NOT IN (SELECT new_id FROM r2)), e3 AS (SELECT * FROM e2 WHERE old_id NOT IN (SELECT old_id FROM r2)),
r3 AS (SELECT new_id, old_id, 'rounded' AS rule FROM (SELECT *, row_number() OVER (PARTITION BY op, name, q, p ORDER BY new_id) AS k FROM n3) a
  JOIN (SELECT *, row_number() OVER (PARTITION BY op, name, q, p ORDER BY day, old_id) AS k FROM e3) b ON a.op = b.op AND a.name = b.name AND a.q = b.q AND a.p = b.p AND a.k = b.k)
SELECT * FROM r1 UNION ALL SELECT * FROM r2 UNION ALL SELECT * FROM r3""")
def posting_matches(spark, sf_dir):
    """[JN-21] Invoice lines and the cost lines that an earlier posting left of them, some without source key and one in each
    order lost: one to one, the strongest rule first."""
    each = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*[F.min(c).alias(c) for c in ("l_returnflag", "l_quantity", "l_extendedprice", "l_shipdate")])
    line = each.select(
        "l_orderkey", "l_linenumber", "l_shipdate", F.col("l_orderkey").alias("op"), F.col("l_returnflag").alias("name"), F.col("l_quantity").alias("quantity"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"),
        F.concat(F.lit("Invoice line "), _text("l_orderkey"), F.lit("/"), _text("l_linenumber")).alias("own"),
    )
    third = F.col("l_linenumber") % 3
    new = line.select((F.col("op") * 100 + F.col("l_linenumber")).alias("new_id"), "op", "name", "quantity", "unit_price", F.when(third == 0, F.col("own")).alias("source_key"))
    old = line.where("l_linenumber <> 4").select((F.col("op") * 100 + F.col("l_linenumber") + 1_000_000_000).alias("old_id"), "op", "name", "quantity", "unit_price", "l_shipdate", F.when(third == 0, F.col("own")).when(third == 1, "Invoice line other").alias("comments"))
    return posting.match_lines(new, old, ["op", "name"], posting.posting_rules(), new_id="new_id", old_id="old_id", oldest=["l_shipdate"])


# ---- tables on pages ---------------------------------------------------------------------------------------------


@query("""
SELECT p_partkey // 4 AS doc, 'PK' || lpad(p_partkey::VARCHAR, 6, '0') AS number, CASE WHEN p_partkey % 7 <> 0 THEN p_size::DOUBLE END AS packages, CASE WHEN p_partkey % 5 <> 0 THEN p_retailprice END AS gross_kg, (p_partkey % 50 + 0.5)::DOUBLE AS volume_cbm FROM part""")
def package_grid(spark, sf_dir):
    """[RGX-14] Grids of four numbers a page, by places of words: cells are missing, so values must not slide to the left."""
    p = read(spark, sf_dir, "part").select((F.floor(F.col("p_partkey") / 4)).alias("doc"), F.lit(1).alias("page"), "p_partkey", "p_size", "p_retailprice", (100 + 90 * (F.col("p_partkey") % 4)).cast("double").alias("x"))
    word = lambda x, y, text, wide: F.struct(x.alias("x0"), (x + wide).alias("x1"), F.lit(float(y)).alias("y"), text.alias("word"))
    price = F.concat_ws("", F.format_number(F.floor("p_retailprice"), 0), F.substring(F.format_number("p_retailprice", 2), -3, 3))
    cells = F.array_compact(F.array(
        word(F.col("x"), 40, F.concat(F.lit("PK"), F.lpad(_text("p_partkey"), 6, "0")), 60.0),
        F.when(F.col("p_partkey") % 7 != 0, word(F.col("x") + 45, 52, _text("p_size"), 10.0)),
        F.when(F.col("p_partkey") % 5 != 0, word(F.col("x") - 4, 64, price, 40.0)),
        word(F.col("x") + 20, 77, F.concat(_text("p_partkey") % 50, F.lit("")).cast("string"), 20.0),
    ))
    volume = F.format_number(F.col("p_partkey") % 50 + 0.5, 1)
    cells = F.transform(cells, lambda c: c.withField("word", F.when(c["y"] == 77.0, volume).otherwise(c["word"])))
    words = p.select("doc", "page", F.explode(cells).alias("w")).select("doc", "page", "w.*")
    labels = p.select("doc", "page").distinct().select("doc", "page", F.explode(F.array(*[word(F.lit(5.0), y, F.lit(t), 60.0) for y, t in ((53, "PACKAGES"), (65, "GROSS"), (78, "VOLUME"), (20, "MANIFEST"))])).alias("w")).select("doc", "page", "w.*")
    return tables.package_grid(words.unionByName(labels), "PK[0-9]{6}", {"packages": "^PACKAGES", "gross_kg": "^GROSS", "volume_cbm": "^VOLUME"}).drop("page")


@query("""
WITH l AS (SELECT l_orderkey AS doc, l_linenumber AS n, 'HBL' || lpad(l_partkey::VARCHAR, 6, '0') AS number, l_quantity AS quantity, l_discount AS kgs, l_tax AS cbm, l_extendedprice AS debit, l_returnflag AS flag, l_suppkey AS s FROM lineitem)
SELECT DISTINCT doc, number, kgs, cbm, CASE WHEN n % 2 = 0 THEN 'CHARGE ABOVE ' || s || ' ' ELSE '' END || 'HANDLING ' || flag || CASE WHEN n % 3 = 0 THEN ' AND BELOW ' || s || ' IT' ELSE '' END AS description, 'BL' AS unit, quantity, 12.5::DOUBLE AS unit_price, 'USD' AS currency, debit, 0.0::DOUBLE AS credit FROM l""")
def charge_ledger(spark, sf_dir):
    """[WIN-17] Charge tables with descriptions that go on above a row, below it, and both; each row stands twice, and rows
    outside of the table are none."""
    l = read(spark, sf_dir, "lineitem")  # noqa: E741
    row = F.concat_ws(" ", F.concat(F.lit("HBL"), F.lpad(_text("l_partkey"), 6, "0")), _text("l_discount"), _text("l_tax"), F.lit("handling"), "l_returnflag", F.lit("BL"), _text("l_quantity"), F.lit("12.5 USD"), _text("l_extendedprice"), F.lit("0"))
    n = F.col("l_linenumber")
    text = F.concat(F.when(n % 2 == 0, F.concat(F.lit("charge  above "), _text("l_suppkey"), F.lit("\n"))).otherwise(""), row, F.when(n % 3 == 0, F.concat(F.lit("\nand below "), _text("l_suppkey"), F.lit("\n it"))).otherwise(""), F.lit("\nwww.example.org\n"))
    each = F.struct(n.alias("n"), text.alias("t"), row.alias("r"))
    rows = F.transform(F.array_sort(F.collect_list(each)), lambda x: x["t"])
    docs = l.groupBy(F.col("l_orderkey").alias("doc")).agg(F.array_join(rows, "").alias("t"), F.min("l_partkey").alias("p"))
    outside = F.concat(F.lit("HBL"), F.lpad(_text("p"), 6, "0"), F.lit(" 1 1 outside of it BL 1 1 USD 1 0\n"))
    whole = F.concat(outside, F.lit("HBL/CNT KGS CBM DESCRIPTION UNIT QTY PRICE CUR DEBIT CREDIT\n"), "t", "t", F.lit("SUB TOTAL 1\nremarks\n"), outside)
    return tables.charge_ledger(docs.select("doc", whole.alias("text"))).drop("place")


@query("""
SELECT l_orderkey AS doc, (l_linenumber - 1) // 2 AS house_no, 'Supplier ' || l_suppkey AS shipper, l_quantity::INT AS packages, l_extendedprice AS gross_kg, CASE WHEN l_linenumber % 2 = 1 THEN 2 ELSE 1 END AS n_pages, true AS agrees FROM lineitem""")
def attached_cargo(spark, sf_dir):
    """[RGX-16] Cargo rows of attached lists, every second of which ends on the next page, under houses by their stated totals."""
    l = read(spark, sf_dir, "lineitem")  # noqa: E741
    n = F.col("l_linenumber")
    cut = F.when(n % 2 == 1, F.concat(F.lit("carried forward\n\n--- PAGE "), (n + 1).cast("string"), F.lit(" ---\nATTACHED LIST\n"))).otherwise("")
    weight = F.format_number("l_extendedprice", 2)
    text = F.concat(F.lit("S/ Supplier "), _text("l_suppkey"), F.lit("\n"), F.col("l_quantity").cast("int").cast("string"), F.lit(" PALLETS widgets\n"), cut, F.lit("GW: "), weight, F.lit(" KGS\n"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct(n.alias("n"), text.alias("t")))), lambda x: x["t"])
    docs = l.groupBy(F.col("l_orderkey").alias("doc")).agg(F.concat(F.lit("--- PAGE 0 ---\nS/ nobody\n1 PALLETS\n--- PAGE 1 ---\nATTACHED LIST\n"), F.array_join(rows, ""), F.lit("TOTAL : 9 PALLETS\n7 PALLETS")).alias("text"))
    houses = l.groupBy(F.col("l_orderkey").alias("doc"), F.floor((n - 1) / 2).alias("house_no")).agg(F.sum("l_quantity").alias("packages"))
    found = tables.by_running_total(tables.attached_cargo(docs), houses)
    return found.select("doc", F.col("house_no").cast("int").alias("house_no"), "shipper", "packages", "gross_kg", (F.col("last_page") - F.col("first_page") + 1).cast("int").alias("n_pages"), "agrees")


# ---- graphs and writes -------------------------------------------------------------------------------------------


def graph_levels() -> list[graph.Level]:
    return [
        graph.Level("master", ["order_no"], None, (), ["status"], ["customer"]),
        graph.Level("house", ["order_no", "line_no"], "master", ["order_no"], ["quantity"], ["supplier"]),
        graph.Level("container", ["order_no", "line_no", "part_no"], "house", ["order_no", "line_no"], [], ["brand"]),
    ]


_ID = "substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12)"


@query(f"""
WITH m AS (SELECT o_orderkey AS k, {_ID} AS id FROM (SELECT *, sha256('master::' || length(o_orderkey::VARCHAR) || ':' || o_orderkey) AS h FROM orders)),
h AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS n, m.id AS parent_id, sha256('house:' || m.id || ':' || length(l_linenumber::VARCHAR) || ':' || l_linenumber) AS h FROM lineitem JOIN m ON l_orderkey = m.k),
hh AS (SELECT *, {_ID} AS id FROM h),
c AS (SELECT DISTINCT k, n, l_partkey AS p, id AS parent_id, sha256('container:' || id || ':' || length(l_partkey::VARCHAR) || ':' || l_partkey) AS h FROM hh JOIN lineitem ON k = l_orderkey AND n = l_linenumber)
SELECT 'master' AS entity, k::VARCHAR AS key, id, NULL AS parent_id, CASE WHEN k % 4 = 0 THEN 'created' WHEN k % 4 = 1 THEN 'updated' ELSE 'same' END AS first_run, 'same' AS second_run FROM m
UNION ALL SELECT 'house', k || '/' || n, id, parent_id, CASE WHEN k % 4 = 0 THEN 'created' ELSE 'same' END, 'same' FROM hh
UNION ALL SELECT 'container', k || '/' || n || '/' || p, {_ID}, parent_id, 'created', 'same' FROM c""")
def entity_graph(spark, sf_dir):
    """[SNK-01, SNK-03] Masters, houses and containers found or created under the ids of their parents, on a store that holds
    three quarters of the masters and their houses; the second run of the same input changes nothing."""
    o, l, p = (read(spark, sf_dir, t) for t in ("orders", "lineitem", "part"))  # noqa: E741
    master = o.select(F.col("o_orderkey").alias("order_no"), F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("customer"))
    house = l.select(F.col("l_orderkey").alias("order_no"), F.col("l_linenumber").alias("line_no"), F.col("l_quantity").alias("quantity"), F.col("l_suppkey").alias("supplier"))
    brand = p.select("p_partkey", F.col("p_brand").alias("brand"))
    container = l.join(brand, F.col("l_partkey") == F.col("p_partkey"), "left").select(F.col("l_orderkey").alias("order_no"), F.col("l_linenumber").alias("line_no"), F.col("l_partkey").alias("part_no"), "brand")
    levels, incoming = graph_levels(), {"master": master, "house": house, "container": container}
    stale = master.where("order_no % 4 <> 0").withColumn("status", F.when(F.col("order_no") % 4 == 1, "?").otherwise(F.col("status")))
    # what the input leaves open does not empty what is stored
    sent = incoming | {"master": master.withColumn("customer", F.when(F.col("order_no") % 3 != 0, F.col("customer")))}
    frame = graph.together(levels, [{"master": stale, "house": house.where("order_no % 4 <> 0")}, sent], {})
    frame = graph.write(levels, graph.write(levels[:2], frame, 0), 1).withColumn("first_run", F.col("action"))
    frame = graph.write(levels, frame, 1).where("_run is null")
    keys = [c for c in frame.columns if c.startswith("_k_")]
    return frame.select(F.col("_entity").alias("entity"), F.concat_ws("/", *keys).alias("key"), "id", "parent_id", "first_run", F.col("action").alias("second_run"))


@query("""
SELECT * FROM (VALUES ('region', 0, false), ('nation', 1, false), ('customer', 2, false), ('supplier', 2, false), ('part', 0, false), ('orders', 3, false), ('lineitem', 4, false), ('loop_a', NULL, true), ('loop_b', NULL, true), ('above', NULL, true)) AS t(entity, level, cyclic)
WHERE entity NOT IN ('customer', 'orders') OR (SELECT count(*) FROM orders JOIN customer ON o_custkey = c_custkey) > 0""")
def load_levels(spark, sf_dir):
    """[SRC-14] The order in which the tables can be loaded, from the foreign keys that their rows bear out, and a cycle."""
    names = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey"}
    links = [("nation", "n_regionkey", "region"), ("customer", "c_nationkey", "nation"), ("supplier", "s_nationkey", "nation"), ("orders", "o_custkey", "customer"), ("lineitem", "l_orderkey", "orders"), ("lineitem", "l_partkey", "part"), ("lineitem", "l_suppkey", "supplier")]
    edges = None
    for child, column, parent in links:
        keys = read(spark, sf_dir, parent).select(F.col(names[parent]).alias("_k"))
        row = read(spark, sf_dir, child).join(keys, F.col(column) == F.col("_k"), "left_semi").agg(F.count(F.lit(1)).alias("n")).where("n > 0").select(F.lit(child).alias("child"), F.lit(parent).alias("parent"))
        edges = row if edges is None else edges.unionByName(row)
    more = spark.createDataFrame([("loop_a", "loop_b"), ("loop_b", "loop_a"), ("above", "loop_a"), ("part", "part"), ("part", "unknown")], "child string, parent string")
    entities = spark.createDataFrame([(e,) for e in (*names, "lineitem", "loop_a", "loop_b", "above")], "entity string")
    return graph.load_order(entities, edges.unionByName(more))


@query("""
SELECT o_orderkey, left('order of ' || o_orderpriority, 15) AS note, CASE WHEN o_orderkey % 6 <> 0 THEN o_custkey END AS customer, round(o_totalprice, 2)::VARCHAR AS total, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderstatus END AS status,
  concat_ws(',', CASE WHEN length('order of ' || o_orderpriority) > 15 THEN 'note:cut' END, CASE WHEN o_orderkey % 6 = 0 THEN 'customer:dropped' END) AS repaired, CASE WHEN o_orderkey % 6 = 0 THEN 'no ' || o_custkey END AS rejected, o_orderkey % 4 <> 0 AS accepted FROM orders""")
def repaired_writes(spark, sf_dir):
    """[SNK-02] Rows mended against the constraints of a store: long texts cut, values of the wrong kind dropped and returned,
    rows without a required value refused."""
    o = read(spark, sf_dir, "orders").select(
        "o_orderkey", F.concat(F.lit("order of "), "o_orderpriority").alias("note"), F.when(F.col("o_orderkey") % 6 != 0, _text("o_custkey")).otherwise(F.concat(F.lit("no "), _text("o_custkey"))).alias("customer"),
        F.bround("o_totalprice", 2).cast("string").alias("total"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderstatus")).alias("status"),
    )
    out = graph.self_repair(o, "o_orderkey", {"note": ("string", 15, False), "customer": ("bigint", None, False), "total": ("double", None, False), "status": ("string", 1, True)})
    w = lambda k: F.try_element_at("written", F.lit(k))
    return out.select(
        "o_orderkey", w("note").alias("note"), w("customer").cast("long").alias("customer"), w("total").alias("total"), w("status").alias("status"), F.array_join(F.transform("repaired", lambda r: F.concat_ws(":", r["field"], r["step"])), ",").alias("repaired"),
        F.get("rejects", F.lit(0))["value"].alias("rejected"), "accepted",
    )


@query("""
WITH e AS (SELECT event_id, (props->>'$.k')::BIGINT AS k, event_type AS t FROM events),
l AS (
  SELECT event_id, 'props.k' AS path, k::VARCHAR AS sent, CASE WHEN event_id % 3 = 0 THEN NULL ELSE (k + event_id % 2)::VARCHAR END AS saved FROM e
  UNION ALL SELECT event_id, 'deep.list[0].a.b', t, t FROM e
  UNION ALL SELECT event_id, 'deep.list[1]', '2.5', CASE WHEN event_id % 5 = 0 THEN NULL ELSE '2.5' END FROM e
  UNION ALL SELECT event_id, 'deep.none', NULL, 'now' FROM e
  UNION ALL SELECT event_id, 'deep.empty', '{}', '{}' FROM e)
SELECT event_id, path, sent, saved, CASE WHEN saved IS NULL THEN 'not_saved' WHEN sent IS NULL THEN 'extra' WHEN sent = saved THEN 'saved' ELSE 'different' END AS status FROM l WHERE sent IS NOT NULL OR saved IS NOT NULL""")
def json_differences(spark, sf_dir):
    """[PRJ-04, DQ-03] Two JSON documents an event without a common shape, compared leaf by leaf."""
    # texts are parsed row by row: dealt to all cores
    e = read(spark, sf_dir, "events").repartition(4 * spark.sparkContext.defaultParallelism).select("event_id", "props", F.get_json_object("props", "$.k").cast("long").alias("k"), "event_type")
    odd, text = F.col("event_id") % 2, lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    name = F.concat(F.lit('"'), "event_type", F.lit('"'))
    sent = text('{"props":', F.col("props"), ', "deep": {"list": [{"a": {"b": ', name, '}}, 2.50], "none": null, "empty": {}}}')
    saved = text("{", F.when(F.col("event_id") % 3 != 0, text('"props": {"k": ', (F.col("k") + odd).cast("string"), "},")).otherwise(""), '"deep": {"empty": {}, "none": "now", "list": [{"a": {"b": ', name, "}}", F.when(F.col("event_id") % 5 != 0, ", 2.5").otherwise(""), "]}}")
    both = e.select("event_id", sent.alias("sent"), saved.alias("saved"))
    return diff.field_diff(diff.json_leaves(both, "event_id", "sent"), diff.json_leaves(both, "event_id", "saved"), ["event_id"]).select("event_id", "path", "sent", "saved", "status")


# ---- payloads, totals and loads ----------------------------------------------------------------------------------


@query("""
WITH o AS (SELECT o_orderkey AS id, o_orderkey % 6 AS k, o_custkey AS c, o_orderdate AS d, o_totalprice AS p, o_orderpriority AS w FROM orders),
n AS (SELECT n_nationkey, n_name, row_number() OVER (PARTITION BY n_nationkey % 5) AS x FROM nation)
SELECT id, 'Customer@odata.bind' AS raw, CASE WHEN k = 0 THEN 'Customer@odata.bind' END AS key, CASE WHEN k = 0 THEN '/accounts(1)' END AS value, 'sent' AS outcome FROM o WHERE k = 0
UNION ALL SELECT id, 'customer', NULL, NULL, 'bound' FROM o WHERE k = 0
UNION ALL SELECT id, 'nation', CASE WHEN k < 4 THEN 'Nation@odata.bind' END, CASE WHEN k < 4 THEN '/nations(' || c % 25 || ')' END, CASE WHEN k < 4 THEN 'bound_to' WHEN k = 4 THEN 'unresolved' ELSE 'ambiguous' END FROM o
UNION ALL SELECT id, '_inner', NULL, NULL, 'not_sent' FROM o
UNION ALL SELECT id, 'owner', NULL, NULL, 'read_only' FROM o
UNION ALL SELECT id, 'sailed', CASE WHEN k <> 1 THEN 'sailing_date' END, CASE WHEN k <> 1 THEN strftime(d, '%Y-%m-%d') END, CASE WHEN k <> 1 THEN 'sent' ELSE 'no_date' END FROM o
UNION ALL SELECT id, 'weight', CASE WHEN k <> 2 THEN 'gross' END, CASE WHEN k <> 2 THEN (c * 1000 + 1)::VARCHAR END, CASE WHEN k <> 2 THEN 'sent' ELSE 'repeated' END FROM o
UNION ALL SELECT id, 'gross', 'gross', '7.5', 'sent' FROM o WHERE k = 2
UNION ALL SELECT id, 'urgency', CASE WHEN w NOT LIKE '5%' THEN 'urgency' END, CASE WHEN w NOT LIKE '5%' THEN left(w, 1) END, CASE WHEN w NOT LIKE '5%' THEN 'sent' ELSE 'no_option' END FROM o
UNION ALL SELECT id, 'note', 'note', left('note of ' || w, 12), CASE WHEN length('note of ' || w) > 12 THEN 'cut' ELSE 'sent' END FROM o""")
def prepared_payloads(spark, sf_dir):
    """[PRJ-07] Payloads of orders by a catalog: bound fields, aliases, read-only fields, lookups with and without their one row,
    dates, decimals, options and long texts, each field with what became of it."""
    o = read(spark, sf_dir, "orders")
    k, c = F.col("o_orderkey") % 6, F.col("o_custkey")
    lit = lambda v: F.lit(v)
    nation = F.when(k < 4, F.concat(lit("nation "), (c % 25).cast("string"))).when(k == 4, "nowhere").otherwise("Twice")
    fields = F.map_filter(F.create_map(
        lit("Customer@odata.bind"), F.when(k == 0, "/accounts(1)"), lit("customer"), F.when(k == 0, "ACME"), lit("nation"), nation, lit("_inner"), lit("x"), lit("owner"), lit("me"),
        lit("sailed"), F.when(k != 1, F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise("soon"), lit("weight"), F.concat(F.format_number(c * 1000 + 1, 0), lit(".0 KGS")), lit("gross"), F.when(k == 2, "7,5"),
        lit("urgency"), F.substring("o_orderpriority", 3, 20), lit("note"), F.concat(lit("note of "), "o_orderpriority"),
    ), lambda _, v: v.isNotNull())
    catalog = spark.createDataFrame(
        [("customer", None, "lookup", "accounts", "Customer", None, True), ("nation", None, "lookup", "nations", "Nation", None, True), ("owner", None, "text", None, None, None, False), ("sailing_date", ["sailed"], "date", None, None, None, True),
         ("gross", ["weight"], "decimal", None, None, None, True), ("urgency", None, "option", None, None, None, True), ("note", None, "text", None, None, 12, True)],
        "field string, aliases array<string>, kind string, target string, bind_as string, most int, writable boolean",
    )
    n = read(spark, sf_dir, "nation")
    labels = n.select(F.lit("nations").alias("target"), F.col("n_nationkey").alias("id"), F.regexp_replace("n_name", "_", " - ").alias("label")).unionByName(n.where("n_nationkey < 2").select(F.lit("nations").alias("target"), F.col("n_nationkey").alias("id"), F.lit("twice").alias("label")))
    options = o.where("o_orderpriority not like '5%'").select(F.lit("urgency").alias("field"), F.substring("o_orderpriority", 3, 20).alias("label"), F.substring("o_orderpriority", 1, 1).cast("int").alias("code")).distinct()
    return payload.prepare(o.select(F.col("o_orderkey").alias("id"), fields.alias("fields")), catalog, labels, options)


@query("""
WITH r AS (SELECT o_custkey AS doc, o_orderkey AS k, CASE WHEN o_orderkey % 3 <> 0 THEN (o_orderkey % 50)::DOUBLE END AS packages FROM orders),
n AS (SELECT doc, count(*) AS n FROM r GROUP BY 1),
c AS (SELECT doc, k, unnest([1, 2]) AS i FROM r)
SELECT r.doc, CASE WHEN any_value(n.n) = 1 THEN coalesce(sum(packages), sum(r.k % 9 + 0.5)) ELSE sum(packages) END::DOUBLE AS packages, any_value(t.teu) AS teu, count(*) AS n_records
FROM r JOIN n ON r.doc = n.doc JOIN (SELECT doc, count(DISTINCT 'AB' || (k + i) % 7) AS teu FROM c GROUP BY 1) t ON t.doc = r.doc GROUP BY r.doc""")
def record_totals(spark, sf_dir):
    """[AGG-03] Totals of documents by their records, containers counted once; a lone record without a count takes that of its
    first container that has one."""
    k = F.col("o_orderkey")
    box = lambda i, n: F.struct(F.concat(F.lit("ab-"), ((k + i) % 7).cast("string")).alias("number"), n.alias("packages"))
    rows = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), F.when(k % 3 != 0, (k % 50).cast("double")).alias("packages"), F.array(box(1, F.lit(None).cast("double")), box(2, k % 9 + 0.5)).alias("containers"))
    return rollup.record_totals(rows, "doc", {"packages": "packages"})


@query("""
WITH d AS (SELECT doc_id, doc_id % 5 AS k, coalesce(upper(text), '') AS u FROM documents)
SELECT doc_id, CASE WHEN k = 0 THEN 300000000 WHEN k IN (1, 2) THEN 300000001 WHEN regexp_matches(u, 'LCL|CFS-CFS| CFS |CONSOLIDATION|LESS THAN CONTAINER|GROUPAGE|CARGO MANIFEST|CONSOLIDATED CARGO') THEN 300000001
  WHEN contains(u, 'FCL') OR contains(u, 'FULL CONTAINER LOAD') THEN 300000000 WHEN k = 4 AND NOT contains(u, 'CFS') THEN 300000000 END::INT AS load FROM d""")
def loads_by_record(spark, sf_dir):
    """[RUL-04] Loads of documents' texts: a given code, cargo by house, the way of extraction, marks, containers alone."""
    k = F.col("doc_id") % 5
    no, none = F.lit(False), F.lit(None).cast("string")
    load = rules.load_type_by_record(F.when(k == 0, "300000000"), F.col("text"), none, none, none, no, F.when(k == 4, 2).otherwise(0), F.when(k == 1, "pdf_Cargo_Manifest_direct").otherwise("native"), k == 2)
    return read(spark, sf_dir, "documents").select("doc_id", load.cast("int").alias("load"))


# ---- live status -------------------------------------------------------------------------------------------------


@query("""
WITH e AS (SELECT user_id::VARCHAR AS key, ts AS "at", min(event_type) AS status FROM events GROUP BY 1, 2),
m AS (SELECT *, lag(status) OVER (PARTITION BY key ORDER BY "at") AS before FROM e)
SELECT key, "at", status, before, row_number() OVER (PARTITION BY key ORDER BY "at") AS n FROM m WHERE before IS NULL OR before <> status""")
def status_changes(spark, sf_dir):
    """[STM-01] Every change of status of each key of a log."""
    return live.changes(read(spark, sf_dir, "events"), key="user_id", at="ts", status="event_type")


@query("""
WITH e AS (SELECT user_id::VARCHAR AS key, ts AS "at", min(event_type) AS status FROM events GROUP BY 1, 2),
m AS (SELECT *, lag(status) OVER (PARTITION BY key ORDER BY "at") AS before FROM e),
c AS (SELECT key, "at", status, row_number() OVER (PARTITION BY key ORDER BY "at") AS n FROM m WHERE before IS NULL OR before <> status)
SELECT * FROM (SELECT key, max("at") AS "at", arg_max(status, "at") AS status, max(n) AS n FROM c GROUP BY key) ORDER BY "at" DESC, key LIMIT 50""")
def live_snapshot(spark, sf_dir):
    """[STM-01] The newest fifty keys of a log by their last change: what a viewer is sent first."""
    return live.snapshot(live.changes(read(spark, sf_dir, "events"), key="user_id", at="ts", status="event_type"))
