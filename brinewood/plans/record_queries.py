"""Registered queries of the operators on records, grids, pages and documents.

The driver's tables stand for records: orders for parents, line items for children, parts for spreadsheet rows. Page texts
are put together from columns; the SQL gives what has to be read out of them, from the columns alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brinewood.functions import parties
from brinewood.operators import dedup, diff, grid, layouts, link, lookup, pages, quality, reconcile, records, rollup, rules, shape, validate
from brinewood.plans.field_queries import bills
from brinewood.plans.registry import query, read
from brinewood.sources import readers, sinks
from brinewood.streaming import audit


def _none() -> Column:
    return F.lit(None)


def _text(c: str) -> Column:
    return F.col(c).cast("string")


# ---- grids: the parts of each brand as a sheet -------------------------------------------------------------------


def part_cells(spark, sf_dir) -> DataFrame:
    """A sheet a brand: two context rows, headers in row 5, the parts from row 10 on, and a total."""
    part = read(spark, sf_dir, "part")
    cell = lambda row, col, value: F.struct(row.alias("row"), F.lit(col).alias("col"), value.alias("value"))
    body = part.select(F.col("p_brand").alias("doc"), F.explode(F.array(*[cell((F.col("p_partkey") + 10).cast("int"), i, _text(c)) for i, c in enumerate(("p_partkey", "p_name", "p_type", "p_size"))])).alias("x"))
    fixed = [(1, 0, F.lit("Brand")), (1, 1, F.col("doc")), (3, 1, F.lit("Parts in stock")), *[(5, i, F.lit(h)) for i, h in enumerate(("Part No.", "Name", "Type", "Size"))], (2_000_000, 0, F.lit("Grand total")), (2_000_000, 3, F.lit("99"))]
    rest = part.select(F.col("p_brand").alias("doc")).distinct().select("doc", F.explode(F.array(*[cell(F.lit(r), c, v) for r, c, v in fixed])).alias("x"))
    return body.unionByName(rest).select("doc", F.lit("s").alias("sheet"), "x.row", "x.col", "x.value")


@query("SELECT p_brand AS doc, (p_partkey + 10)::INT AS \"row\", 5 AS header_row, p_partkey || '~' || p_name || '~' || p_type || '~' || p_size AS vals FROM part")
def grid_sections(spark, sf_dir):
    """[WIN-14, AGG-20, FLT-06] Data rows under the latest header row; totals and context are no data."""
    found = grid.sections(part_cells(spark, sf_dir), ["part", "name", "type", "size"])
    return found.select("doc", "row", "header_row", F.array_join("values", "~").alias("vals"))


@query("SELECT p_brand AS doc, p_partkey::VARCHAR AS number, p_name AS name, p_size::VARCHAR AS size FROM part")
def grid_records(spark, sf_dir):
    """[PRJ-15, SRC-08] Rows as records by header synonyms."""
    found = grid.records(grid.sections(part_cells(spark, sf_dir), ["part", "name", "type", "size"]))
    r = F.col("record")
    return found.select("doc", grid.field(r, "number", "part no").alias("number"), grid.field(r, "NAME").alias("name"), grid.field(r, "weight", "size").alias("size"))


@query("SELECT p_brand AS doc, unnest(['Brand | ' || p_brand, 'Parts in stock']) AS text FROM (SELECT DISTINCT p_brand FROM part)")
def context_lines(spark, sf_dir):
    """[WIN-16] What stands above the headers."""
    return grid.context_lines(part_cells(spark, sf_dir), 5).select("doc", "text")


@query("""
SELECT p_brand AS doc, count(*) AS n_rows, 3 AS first_row, 5 AS second_row FROM (SELECT DISTINCT p_brand FROM part) GROUP BY 1""")
def marked_sheets(spark, sf_dir):
    """[FLT-08, WIN-12, WIN-13] Sheets with two marks, and the rows between them."""
    cells = part_cells(spark, sf_dir)
    bounds = grid.marked_sheets(cells, "in stock", "part no")
    return grid.section_range(cells, bounds, skip=0).join(bounds, ["doc", "sheet"]).groupBy("doc").agg(F.count_distinct("row").alias("n_rows"), F.min("first_row").alias("first_row"), F.min("second_row").alias("second_row"))


@query("SELECT o_orderkey AS doc, o_orderpriority AS value FROM orders WHERE o_orderkey % 3 <> 0")
def values_below(spark, sf_dir):
    """[PRJ-16] The value under a label."""
    at = F.when(F.col("o_orderkey") % 3 == 0, 3).otherwise(2)
    cells = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc"), F.explode(F.array(F.struct(F.lit(1).alias("row"), F.lit("Priority:").alias("value")), F.struct(at.alias("row"), F.col("o_orderpriority").alias("value")))).alias("x"))
    return grid.value_below(cells.select("doc", F.lit("s").alias("sheet"), "x.row", F.lit(4).alias("col"), "x.value"), "^Priority").select("doc", "value")


@query("""
SELECT l_orderkey AS doc, arg_max(l_quantity, (l_linenumber, l_quantity)) FILTER (l_returnflag = 'A') AS debit, arg_max(l_quantity, (l_linenumber, l_quantity)) FILTER (l_returnflag = 'R') AS credit FROM lineitem GROUP BY 1""")
def labelled_totals(spark, sf_dir):
    """[AGG-06] The last stated total of each label."""
    label = F.when(F.col("l_returnflag") == "A", "Debit total").when(F.col("l_returnflag") == "R", "credit  x").otherwise("net")
    cells = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.lit("s").alias("sheet"), F.struct("l_linenumber", "l_quantity").alias("row"), label.alias("label"), F.col("l_quantity").alias("value"))
    return rollup.labelled_totals(cells, {"debit": "debit", "credit": "credit"}).drop("sheet")


# ---- pages -------------------------------------------------------------------------------------------------------


def order_pages(spark, sf_dir, least: int = 0) -> DataFrame:
    """pages(doc, page, text): a document a customer, a page an order with its number and measures."""
    orders = read(spark, sf_dir, "orders")
    body = F.concat(F.lit("B/L No: ORD"), F.lpad(_text("o_orderkey"), 8, "0"), F.lit("\n"), (F.col("o_orderkey") % 90 + 1).cast("string"), F.lit(" PALLETS\nGROSS WEIGHT: "), (F.col("o_orderkey") % 1000 + 1).cast("string"), F.lit(".50 KGS\nMEASUREMENT: 2.25 CBM"))
    return orders.select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").cast("int").alias("page"), body.alias("text"))


@query("""
SELECT o_custkey AS doc, o_orderkey::INT AS page, 'ORD' || lpad(o_orderkey::VARCHAR, 8, '0') AS number, (o_orderkey % 90 + 1)::DOUBLE AS packages, o_orderkey % 1000 + 1.5::DOUBLE AS gross_kg, 2.25::DOUBLE AS volume_cbm
FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) >= 2)""")
def page_records(spark, sf_dir):
    """[RGX-11, SET-12] A record a page, for documents of two numbers or more."""
    return pages.page_records(order_pages(spark, sf_dir))


@query("""
SELECT o_custkey AS doc, count(*) AS n_children, sum(o_orderkey % 90 + 1)::DOUBLE AS packages, round(sum(o_orderkey % 1000 + 1.5), 3)::DOUBLE AS gross_kg, round(count(*) * 2.25, 3)::DOUBLE AS volume_cbm FROM orders GROUP BY 1 HAVING count(*) >= 2""")
def consolidated_masters(spark, sf_dir):
    """[RGX-13, AGG-10, AGG-12] Masters that sum up their page records."""
    return pages.consolidated(order_pages(spark, sf_dir))[0]


@query("SELECT o_custkey AS doc, count(*) AS n_pages, count(*) AS n_numbers FROM orders GROUP BY 1 HAVING count(*) >= 2")
def multi_record_docs(spark, sf_dir):
    """[RGX-10] Documents of several numbered pages."""
    return pages.multi_record_docs(order_pages(spark, sf_dir))


_HOUSE_ROWS = """(SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)"""


def house_texts(spark, sf_dir) -> DataFrame:
    """docs(doc, text): a manifest an order, a block `HBL:` a line number, some blocks without consignee and repeated below."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    k = F.col("l_linenumber")
    block = F.concat(
        F.lit("HBL: H"), _text("l_orderkey"), F.lit("-"), k.cast("string"), F.lit("\n"), F.when(k % 2 == 0, F.concat(F.lit("CNEE: Buyer "), k.cast("string"), F.lit("\n"))).otherwise(""),
        F.lit("STC: goods "), k.cast("string"), F.lit("\n"), (k + 1).cast("string"), F.lit(" CARTONS\n"), (k * 10).cast("string"), F.lit(".5 KGS\n"),
    )
    again = F.when(k % 3 == 0, F.concat(F.lit("HBL: H"), _text("l_orderkey"), F.lit("-"), k.cast("string"), F.lit("\nCNEE: Late "), k.cast("string"), F.lit("\n1.5 CBM\n"))).otherwise("")
    blocks = lines.groupBy(F.col("l_orderkey").alias("doc")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", block.alias("b"), again.alias("a")))).alias("x"))
    return blocks.select("doc", F.concat(F.lit("MANIFEST\n"), F.array_join(F.transform("x", lambda b: b["b"]), ""), F.array_join(F.transform("x", lambda b: b["a"]), "")).alias("text"))


@query(f"""
SELECT l_orderkey AS doc, 'H' || l_orderkey || '-' || k AS number, CASE WHEN k % 2 = 0 THEN 'Buyer ' || k WHEN k % 3 = 0 THEN 'Late ' || k END AS consignee, 'goods ' || k AS description, (k + 1)::DOUBLE AS packages, k * 10 + 0.5::DOUBLE AS gross_kg,
  CASE WHEN k % 3 = 0 THEN 1.5::DOUBLE END AS volume_cbm FROM (SELECT l_orderkey, l_linenumber AS k FROM {_HOUSE_ROWS})""")
def house_blocks(spark, sf_dir):
    """[RGX-12, SET-09] Children of manifests by blocks; the fullest block of a number, its gaps filled from the others."""
    return pages.house_blocks(house_texts(spark, sf_dir), "doc", "text").drop("first_block")


@query(f"""
SELECT l_orderkey AS doc, 'HB' || lpad(l_orderkey::VARCHAR, 5, '0') || 'X' || k AS number, 'Seller ' || k AS shipper, CASE WHEN k % 2 = 0 THEN 'Buyer ' || k END AS consignee, CASE WHEN k % 3 = 0 THEN 'Agent' END AS notify FROM (SELECT l_orderkey, l_linenumber AS k FROM {_HOUSE_ROWS})""")
def manifest_rows(spark, sf_dir):
    """[RGX-15] Numbered rows of manifests with tagged party lines."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    k = F.col("l_linenumber")
    row = F.concat(k.cast("string"), F.lit(" HB"), F.lpad(_text("l_orderkey"), 5, "0"), F.lit("X"), k.cast("string"), F.lit(" 5 PKGS\nS/ Seller "), k.cast("string"), F.when(k % 2 == 0, F.concat(F.lit("\n C/ Buyer "), k.cast("string"))).otherwise(""), F.when(k % 3 == 0, "\nN/Agent\nN/ other").otherwise(""))
    docs = lines.groupBy(F.col("l_orderkey").alias("doc")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", row.alias("r")))), lambda x: x["r"]), "\n").alias("text"))
    return pages.manifest_rows(pages.split_lines(docs, "doc", "text")).drop("line_no")


@query(f"""
SELECT l_orderkey AS doc, (row_number() OVER (PARTITION BY l_orderkey ORDER BY k) - 1)::INT AS k, 'HB' || lpad(l_orderkey::VARCHAR, 5, '0') || 'X' || k AS number, (k * 10)::DOUBLE AS packages, CASE WHEN k > 0 THEN k + 0.5::DOUBLE END AS weight
FROM (SELECT l_orderkey, l_linenumber AS k FROM {_HOUSE_ROWS}) WHERE l_orderkey IN (SELECT l_orderkey FROM {_HOUSE_ROWS} GROUP BY 1 HAVING count(*) >= 2)""")
def column_grids(spark, sf_dir):
    """[RGX-14] Manifests by columns: the k-th id with the k-th number of each measure."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    joined = lambda x: F.array_join(F.transform("ks", x), "  ")
    docs = lines.groupBy(F.col("l_orderkey").alias("doc")).agg(F.array_sort(F.collect_list("l_linenumber")).alias("ks"))
    number = lambda k: F.concat(F.lit("HB"), F.lpad(_text("doc"), 5, "0"), F.lit("X"), k.cast("string"))
    text = F.concat(joined(number), F.lit("\nPACKAGES "), joined(lambda k: (k * 10).cast("string")), F.lit("\n Weight "), joined(lambda k: (k + F.lit(0.5)).cast("string")), F.lit("\nWEIGHT 1 2 3 4 5 6 7"))
    return layouts.column_grid(pages.split_lines(docs.select("doc", text.alias("text")), "doc", "text"), r"\b(HB[0-9]{5,}X[0-9])\b", {"packages": "PACKAGES", "weight": "WEIGHT"})


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
m AS (SELECT *, last_value(CASE WHEN length(line) <= 20 THEN i END IGNORE NULLS) OVER w AS label, last_value(CASE WHEN contains(line, 'License') AND length(line) > 20 THEN i END IGNORE NULLS) OVER w AS stop FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING)),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, label ORDER BY i) AS n FROM m WHERE label IS NOT NULL AND length(line) > 20 AND coalesce(stop, -1) < label AND trim(line) <> '')
SELECT doc_id AS doc, label::INT AS label_no, md5(string_agg(trim(line), chr(10) ORDER BY i)) AS lines FROM k WHERE n <= 5 GROUP BY 1, 2""")
def lines_until_stop(spark, sf_dir):
    """[WIN-18] Up to five lines below each short line, until one names a licence."""
    lines = pages.split_lines(read(spark, sf_dir, "documents"), "doc_id", "text")
    return pages.until_stop(lines, "^.{0,20}$", "License").select("doc", "label_no", F.md5(F.array_join("lines", "\n")).alias("lines"))


@query("""
SELECT doc_id, CASE WHEN length(text) >= 600 AND contains(upper(text), 'THE')::INT + contains(upper(text), 'AND')::INT + contains(upper(text), 'LICENSE')::INT >= 2 THEN 'native' ELSE 'native_sparse' END AS layer FROM documents""")
def native_or_sparse(spark, sf_dir):
    """[SRC-02] Whether a text layer is enough."""
    return read(spark, sf_dir, "documents").select("doc_id", pages.native_or_sparse(F.col("text"), ["the", "and", "license"], hits=2).alias("layer"))


@query("SELECT doc_id AS doc, CASE WHEN length(text) >= 2000 THEN 'long' WHEN contains(text, 'License') THEN 'licensed' ELSE 'any' END AS parser, CASE WHEN length(text) >= 2000 THEN 90 WHEN contains(text, 'License') THEN 90 ELSE 10 END AS confidence, length(text)::INT AS n FROM documents")
def parser_registry(spark, sf_dir):
    """[WIN-01, UDF-01] The surest parser of each document, the first of equals."""
    r = pages.Registry()
    n = F.struct(F.length("text").alias("n")).alias("record")
    r.add("long", lambda d: d.where(F.length("text") >= 2000).select("doc", F.lit(90).alias("confidence"), n))
    r.add("licensed", lambda d: d.where(F.contains("text", F.lit("License"))).select("doc", F.lit(90).alias("confidence"), n))
    r.add("any", lambda d: d.select("doc", F.lit(10).alias("confidence"), n))
    return r.best(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text")).select("doc", "parser", "confidence", "record.n")


@query("""
SELECT l_orderkey AS doc, 'Fee ' || l_returnflag || ' more' AS term, l_extendedprice AS amount FROM lineitem GROUP BY ALL""")
def charge_tables(spark, sf_dir):
    """[WIN-17] Charge lines inside tables, descriptions that go on, and repeated rows."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_extendedprice")
    row = F.concat(F.lit("Fee "), "l_returnflag", F.lit("\n more "), F.format_string("%.2f", F.col("l_extendedprice")), F.lit(" USD"))
    docs = lines.groupBy(F.col("l_orderkey").alias("doc")).agg(F.array_join(F.array_sort(F.collect_list(row)), "\n").alias("rows"))
    text = F.concat(F.lit("before 1.00\nDescription  Amount\n"), "rows", F.lit("\nTOTAL 9.00\nafter 2.00"))
    return layouts.charge_rows(docs.select("doc", text.alias("text"))).drop("line_no")


@query("""
SELECT o_orderkey, 'INV-' || o_orderkey AS number, strftime(o_orderdate, '%Y-%m-%d') AS day, CASE WHEN o_orderkey % 2 = 0 THEN 'USD' ELSE 'EUR' END AS currency, o_totalprice AS total FROM orders""")
def invoice_headers(spark, sf_dir):
    """[RGX-25] What invoices state of themselves."""
    text = F.concat(F.lit("Invoice No: INV-"), _text("o_orderkey"), F.lit("\nDate: "), F.date_format("o_orderdate", "dd/MM/yyyy"), F.lit("\nGrand Total: "), F.when(F.col("o_orderkey") % 2 == 0, "USD ").otherwise("EUR "), F.format_string("%.2f", F.col("o_totalprice")))
    h = layouts.invoice_header(text)
    return read(spark, sf_dir, "orders").select("o_orderkey", h["invoice_no"].alias("number"), h["invoice_date"].alias("day"), h["currency"].alias("currency"), h["stated_total"].alias("total"))


@query(f"""
SELECT l_orderkey AS doc, 'Seller ' || k AS shipper, (k + 1)::DOUBLE AS packages, CASE WHEN k % 2 = 0 THEN k * 10 + 0.5::DOUBLE END AS gross_kg, CASE WHEN k % 3 = 0 THEN 1.5::DOUBLE END AS volume_cbm FROM (SELECT l_orderkey, l_linenumber AS k FROM {_HOUSE_ROWS})""")
def groupage_lines(spark, sf_dir):
    """[RGX-21] Cargo lines per shipper, completed further down."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    k = F.col("l_linenumber")
    block = F.concat(F.lit("SHIPPER: Seller "), k.cast("string"), F.lit("\n"), (k + 1).cast("string"), F.lit(" PALLETS\n"), F.when(k % 2 == 0, F.concat((k * 10).cast("string"), F.lit(".5 KGS\n"))).otherwise(""))
    late = F.when(k % 3 == 0, F.concat(F.lit("SHIPPER: Seller "), k.cast("string"), F.lit("\n99 PALLETS\n1.5 CBM\n"))).otherwise("")
    docs = lines.groupBy(F.col("l_orderkey").alias("doc")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", block.alias("b"), late.alias("a")))).alias("x"))
    return layouts.groupage(docs.select("doc", F.concat(F.array_join(F.transform("x", lambda b: b["b"]), ""), F.array_join(F.transform("x", lambda b: b["a"]), "")).alias("text"))).drop("line_no")


# ---- shaping -----------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey::VARCHAR AS id, o_orderstatus AS status, NULL::VARCHAR AS note, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE 'none' END AS priority, 0::INT AS n FROM orders")
def template_columns(spark, sf_dir):
    """[PRJ-01, PRJ-11] Exactly a template's columns, blanks by default."""
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).otherwise("").alias("priority"), "o_custkey")
    return shape.to_template(rows, {"id": "string", "status": "string", "note": "string", "priority": "string", "n": "int"}, {"priority": "none", "n": 0})


@query("SELECT c_custkey, c_name AS name, '5 Palm Street' || chr(10) || c_mktsegment AS address FROM customer")
def party_blocks(spark, sf_dir):
    """[PRJ-09] Names and addresses of party blocks, up to contacts."""
    block = F.concat(F.lit("\n  "), "c_name", F.lit(" \r\n5 Palm Street\n"), "c_mktsegment", F.lit("\nTel: 012\nCairo"))
    name, address = shape.party(block)
    return read(spark, sf_dir, "customer").select("c_custkey", name.alias("name"), address.alias("address"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'derived' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE 'filled' END AS priority, 'run' AS mode, 'a' AS source FROM orders")
def derived_values(spark, sf_dir):
    """[PRJ-10, PRJ-18] Derived values that win or fill, and run settings."""
    rows = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).otherwise("").alias("priority"))
    made = shape.derive(rows, {"status": F.when(F.col("o_orderkey") % 2 == 0, "derived"), "priority": F.lit("filled")}, override=("status",))
    return shape.run_meta(made, {"mode": "test", "source": "a"}, {"mode": "run"})


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN c_mktsegment WHEN 2 THEN c_custkey::VARCHAR END AS owner FROM customer")
def annotated_fields(spark, sf_dir):
    """[SRC-12] Fields by their annotations, or raw."""
    k = F.col("c_custkey") % 4
    m = F.map_from_arrays(
        F.array(F.lit("owner@formatted"), F.lit("_owner_value@formatted"), F.lit("owner")),
        F.array(F.when(k == 0, F.col("c_name")).otherwise(" "), F.when(k == 1, F.concat(F.lit(" "), "c_mktsegment")), F.when(k != 3, _text("c_custkey"))),
    )
    return read(spark, sf_dir, "customer").select("c_custkey", shape.annotated(m, "owner").alias("owner"))


@query("SELECT event_id, (props::JSON ->> '$.k')::BIGINT AS k FROM events")
def unwrapped_payloads(spark, sf_dir):
    """[PRJ-08] Payloads inside data, inside value, or bare."""
    k = F.col("event_id") % 4
    wrapped = F.when(k == 0, F.concat(F.lit('{"data": {"data": '), "props", F.lit("}}"))).when(k == 1, F.concat(F.lit('{"data": '), "props", F.lit("}"))).when(k == 2, F.concat(F.lit('{"value": ['), "props", F.lit("]}"))).otherwise(F.col("props"))
    return read(spark, sf_dir, "events").select("event_id", F.get_json_object(shape.unwrap(wrapped), "$.k").try_cast("long").alias("k"))


@query("""
WITH c AS (SELECT l_orderkey, string_agg(l_linenumber || ':' || l_returnflag, ',' ORDER BY l_linenumber, l_returnflag) AS lines FROM lineitem GROUP BY 1) SELECT o_orderkey, coalesce(lines, '') AS lines FROM orders LEFT JOIN c ON o_orderkey = l_orderkey""")
def nested_children(spark, sf_dir):
    """[PRJ-12, PRJ-13] Parents with ordered arrays of children; none is an empty array."""
    children = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_returnflag")
    nested = shape.nest(read(spark, sf_dir, "orders").select("o_orderkey"), children, "o_orderkey", "lines", "l_linenumber")
    return nested.select("o_orderkey", F.array_join(F.transform("lines", lambda x: F.concat(x["l_linenumber"].cast("string"), F.lit(":"), x["l_returnflag"])), ",").alias("lines"))


@query("""
WITH d AS (SELECT o_orderkey, o_custkey, l_linenumber, l_quantity::INT AS q FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey, l_linenumber, l_quantity FROM lineitem) ON o_orderkey = l_orderkey)
SELECT o_orderkey::VARCHAR AS master_no, o_custkey::VARCHAR AS vessel, 'C1' AS container_no, CASE WHEN o_orderkey % 2 = 0 THEN 'S1' END AS seal_no, l_linenumber::VARCHAR AS house_no, q AS packages FROM d""")
def flattened_operations(spark, sf_dir):
    """[SRC-11] Nested documents as one row a child; the first container alone, a parent without children one row."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity").distinct()
    houses = lines.groupBy("l_orderkey").agg(F.collect_list(F.struct(_text("l_linenumber").alias("no"), _none().cast("string").alias("consignee"), F.col("l_quantity").cast("int").alias("packages"))).alias("houses"))
    seal = F.when(F.col("o_orderkey") % 2 == 0, "S1")
    boxes = F.array(F.struct(F.lit("C1").alias("no"), seal.alias("seal")), F.struct(F.lit("C2").alias("no"), F.lit("S2").alias("seal")))
    docs = read(spark, sf_dir, "orders").join(houses, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(_text("o_orderkey").alias("master_no"), _text("o_custkey").alias("vessel"), "houses", boxes.alias("containers"))
    return shape.flatten_operations(docs).drop("consignee")


@query("SELECT l_orderkey, l_linenumber, l_quantity::INT AS packages, l_extendedprice AS amount, l_shipdate::DATE AS day, CASE WHEN l_linenumber % 2 = 0 THEN l_partkey::INT END AS kind FROM lineitem")
def catalog_casts(spark, sf_dir):
    """[RUL-17, PRJ-07] Columns cast as a catalog says; what can't be written goes, what can't be read is null."""
    rows = read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_quantity").cast("int").cast("string").alias("packages"), F.format_string("%.2f", F.col("l_extendedprice")).alias("amount"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"),
        F.when(F.col("l_linenumber") % 2 == 0, _text("l_partkey")).otherwise("n/a").alias("kind"), F.lit("x").alias("locked"),
    )
    catalog = [("packages", "Integer", True), ("amount", "Money", True), ("day", "DateTime", True), ("kind", "Picklist", True), ("locked", "String", False)]
    return shape.by_catalog(rows, catalog).withColumn("amount", F.col("amount").cast("double"))


@query("""
WITH r AS (SELECT o_orderkey, unnest(list_filter(l, lambda x, i: list_position(l, x) = i)) AS reference, generate_subscripts(list_filter(l, lambda x, i: list_position(l, x) = i), 1) - 1 AS ref_no FROM (SELECT o_orderkey, ['R' || o_custkey, 'S' || o_orderkey, 'R' || o_custkey] AS l FROM orders))
SELECT o_orderkey, ref_no::INT AS ref_no, reference, CASE WHEN n = 1 THEN reference ELSE reference || '-' || n END AS slug FROM (SELECT *, row_number() OVER (PARTITION BY reference ORDER BY o_orderkey, ref_no) AS n FROM r)""")
def expanded_references(spark, sf_dir):
    """[RGX-22, JN-27] A child a distinct reference, and slugs numbered where they repeat."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", F.array(F.concat(F.lit("R"), _text("o_custkey")), F.concat(F.lit("S"), _text("o_orderkey")), F.concat(F.lit("R"), _text("o_custkey"))).alias("refs"))
    rows = shape.expand_references(orders, "refs", ["o_orderkey"])
    return rows.withColumn("slug", dedup.number_suffixes(rows, "reference", [], [F.col("o_orderkey"), F.col("ref_no")]))


@query("""
WITH d AS (SELECT doc_id, '{"doc_id":' || doc_id || ',"lang":"' || coalesce(lang, '') || '"}' AS b, text FROM documents) SELECT doc_id, substr(b, 1, 25) AS body, substr(text, 1, 100) AS preview, length(b) > 25 AS truncated FROM d""")
def capped_responses(spark, sf_dir):
    """[SNK-07, DQ-06] Rows as JSON, cut beyond a cap, with a preview of the text."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), "text")
    return shape.response(docs, "doc_id", "text", preview=100, cap=25)


@query("SELECT event_id, 'k=' || (props::JSON ->> '$.k') || CASE WHEN event_id % 3 = 0 THEN ',keep@x=1' ELSE '' END AS fields, CASE WHEN event_id % 2 = 0 THEN event_type END AS kind, CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END::INT AS n FROM events")
def pruned_values(spark, sf_dir):
    """[PRJ-02, PRJ-03, PRJ-05, PRJ-06] Maps without annotations and private keys, and nested values without what is empty."""
    even = F.col("event_id") % 2 == 0
    m = F.map_from_arrays(F.array(F.lit("k"), F.lit("_private"), F.lit("keep@x"), F.lit("k@note"), F.lit("blank")), F.array(F.get_json_object("props", "$.k"), F.lit("1"), F.when(F.col("event_id") % 3 == 0, "1"), F.lit("2"), F.lit("")))
    kept = diff.prune(m, allow=("keep@x",))
    listed = F.array_join(F.transform(F.array_sort(F.map_entries(kept)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    deep = F.struct(F.when(even, F.col("event_type")).otherwise("").alias("kind"), F.array(F.struct(F.lit("").alias("a")), F.struct(F.when(even, "x").alias("a"))).alias("list"))
    rows = diff.drop_empty(read(spark, sf_dir, "events").select("event_id", listed.alias("fields"), deep.alias("deep")), "event_id")
    return rows.select("event_id", F.regexp_replace("fields", "^(keep@x=1),(k=.*)$", "$2,$1").alias("fields"), F.col("deep.kind").alias("kind"), F.coalesce(F.size("deep.list"), F.lit(0)).alias("n")).withColumn("n", F.when(F.col("n") > 0, F.col("n")).otherwise(0))


@query("""
SELECT l_orderkey, path, value FROM (SELECT l_orderkey, 'lines[' || (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag) - 1) || '].' AS p, l_linenumber, l_returnflag FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag FROM lineitem)),
LATERAL (SELECT unnest([p || 'no', p || 'flags[0]', p || 'flags[1].f']) AS path, unnest([l_linenumber::VARCHAR, 'x', l_returnflag]) AS value) WHERE path NOT LIKE '%flags[0]'""")
def deep_leaves(spark, sf_dir):
    """[PRJ-04] Leaves of structs in arrays in structs."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag").distinct()
    item = F.struct(F.col("l_linenumber").alias("no"), F.col("l_returnflag").alias("flag"))
    docs = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(item)).alias("x"))
    flags = lambda x: F.array(F.struct(_none().cast("string").alias("f")), F.struct(x["flag"].alias("f")))
    docs = docs.select("l_orderkey", F.transform("x", lambda x: F.struct(x["no"].alias("no"), flags(x).alias("flags"))).alias("lines"))
    return diff.flatten(docs, "l_orderkey").where("value is not null")


# ---- records -----------------------------------------------------------------------------------------------------


@query("""
SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 886150002 WHEN 1 THEN 886150000 WHEN 4 THEN NULL ELSE 886150001 END::INT AS kind, CASE WHEN o_orderkey % 5 = 0 AND o_orderkey % 2 = 0 THEN 'house' ELSE 'master' END AS cargo_of,
  CASE WHEN o_orderkey % 4 = 0 THEN 'manifest_header' WHEN o_orderkey % 4 = 1 THEN 'manifest_house' WHEN o_orderkey % 4 = 2 THEN 'draft' ELSE 'plain' END AS record FROM orders""")
def record_kinds(spark, sf_dir):
    """[PRJ-14, FLT-05] Kinds of operations and of records."""
    k = F.col("o_orderkey") % 5
    name = F.when(k == 0, " HBL").when(k == 1, "direct").when(k == 2, "").when(k == 3, "886150001").otherwise("other")
    rows = read(spark, sf_dir, "orders").select("o_orderkey", records.kind_code(name).alias("kind"), F.when(F.col("o_orderkey") % 2 == 1, F.col("o_custkey")).alias("parent_id"), F.lit("master").alias("cargo_of"))
    m = F.col("o_orderkey") % 4
    return records.standalone_house(rows).select("o_orderkey", "kind", "cargo_of", records.record_kind(F.when(m == 2, "Draft parser").otherwise("x"), m == 0, m == 1).alias("record"))


@query("""
SELECT p_partkey, (p_partkey % 3 = 0) AS manifest, (p_partkey % 4 = 0 OR p_partkey % 5 < 2) AS model FROM part""")
def acceptance_tests(spark, sf_dir):
    """[FLT-13, FLT-14] Header rows of manifests, and workbooks for the external extractor."""
    k, n = F.col("p_partkey") % 3, F.col("p_partkey") % 5
    headers = F.when(k == 0, F.array(F.lit("H.B/L no"), F.lit("Shipper Name"))).when(k == 1, F.array(F.lit("hbl no"), F.col("p_name"))).otherwise(F.array(F.col("p_name")))
    rows = F.when(F.col("p_partkey") % 4 == 0, 3).otherwise(F.when(n == 1, 2).otherwise(1))
    text = F.when(n == 0, F.repeat(F.lit("ab"), F.lit(12_500))).when(n == 1, "a Cargo manifest").otherwise("cargo manifest")
    return read(spark, sf_dir, "part").select("p_partkey", records.is_manifest(headers, ["HBLNO"], ["shippername", "consignee"]).alias("manifest"), records.needs_model(rows, text, "cargo MANIFEST").alias("model"))


@query("SELECT event_id AS doc, CASE WHEN event_id % 3 > 0 THEN (props::JSON ->> '$.k')::BIGINT END AS k, (event_id % 3 = 0) AS broken FROM events")
def external_payloads(spark, sf_dir):
    """[SRC-13, UDF-02] Records that an external extractor left, broken ones told."""
    payload = F.when(F.col("event_id") % 3 == 0, F.substring("props", 1, 5)).otherwise(F.col("props"))
    found = records.external_records(read(spark, sf_dir, "events").select(F.col("event_id").alias("doc"), payload.alias("payload")), "k long")
    return found.select("doc", "record.k", "broken")


@query("""
WITH l AS (SELECT l_orderkey AS doc, l_linenumber % 2 AS chunk, l_partkey % 7 AS k, l_quantity FROM lineitem), f AS (SELECT doc, k, arg_min(chunk, (chunk, k)) AS chunk FROM l GROUP BY 1, 2)
SELECT doc, string_agg('P' || k, ',' ORDER BY chunk, k) AS recs, (SELECT sum(n) FROM (SELECT count(*) AS n FROM l b WHERE b.doc = f.doc)) ::BIGINT AS tokens, CASE WHEN count(*) FILTER (chunk = 1) > 0 OR EXISTS (SELECT 1 FROM l b WHERE b.doc = f.doc AND b.chunk = 1) THEN 'second' ELSE 'unknown' END AS layout FROM f GROUP BY doc""")
def chunk_results(spark, sf_dir):
    """[SET-03, AGG-16] Results of chunks merged: the first record of each key, the first known layout, tokens summed."""
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), (F.col("l_linenumber") % 2).alias("chunk"), (F.col("l_partkey") % 7).alias("k"))
    record = F.struct(F.concat(F.lit("P"), F.col("k").cast("string")).alias("parent_no"), F.lit("").alias("child_no"), F.col("k").alias("v"))
    chunks = lines.groupBy("doc", "chunk").agg(F.array_sort(F.collect_list(record)).alias("records"), F.count(F.lit(1)).alias("tokens"))
    chunks = chunks.select("doc", "chunk", "records", F.array(F.lit("w")).alias("warnings"), F.when(F.col("chunk") == 1, "second").otherwise("unknown").alias("layout"), "tokens")
    return records.merge_chunks(chunks).select("doc", F.array_join(F.transform("records", lambda r: r["parent_no"]), ",").alias("recs"), "tokens", "layout")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'page ' || o_orderpriority ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 3 = 0 THEN 'page' ELSE o_orderpriority END AS priority FROM orders")
def page_forced_values(spark, sf_dir):
    """[RUL-11] Values of a record's own page win."""
    orders = read(spark, sf_dir, "orders")
    rows = orders.select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("page"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    anchors = orders.where("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("page"), F.concat(F.lit("page "), "o_orderpriority").alias("status"), F.when(F.col("o_orderkey") % 2 == 0, "page").alias("priority"))
    return records.force_page_values(rows, anchors, ["status", "priority"]).select("id", "status", "priority")


@query("""
WITH e AS (SELECT c_custkey AS doc, CASE WHEN c_custkey % 2 = 0 THEN '' ELSE c_name END AS name FROM customer UNION ALL SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey % 5 = 0),
p AS (SELECT c_custkey AS doc, 'parsed ' || c_custkey AS name FROM customer WHERE c_custkey % 3 = 0), one AS (SELECT doc FROM e GROUP BY 1 HAVING count(*) = 1 INTERSECT SELECT doc FROM p)
SELECT e.doc, CASE WHEN e.doc IN (SELECT doc FROM one) THEN coalesce(nullif(e.name, ''), p.name) ELSE e.name END AS name FROM e LEFT JOIN p USING (doc)""")
def single_merges(spark, sf_dir):
    """[RUL-15] Documents with one record on each side are merged field by field, others stay."""
    c = read(spark, sf_dir, "customer")
    external = c.select(F.col("c_custkey").alias("doc"), F.when(F.col("c_custkey") % 2 == 0, "").otherwise(F.col("c_name")).alias("name")).unionByName(c.where("c_custkey % 5 = 0").select(F.col("c_custkey").alias("doc"), F.col("c_mktsegment").alias("name")))
    parsed = c.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("doc"), F.concat(F.lit("parsed "), _text("c_custkey")).alias("name"))
    return records.merge_single(external, parsed, ["name"])


@query("""
SELECT o_orderstatus AS kind, count(*) AS n, count(*) FILTER (c IS NULL) AS n_empty, coalesce(sum(c), 0)::BIGINT AS n_children FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS c FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON l_orderkey = o_orderkey GROUP BY 1""")
def operation_inventory(spark, sf_dir):
    """[AGG-18, AGG-17] Operations by kind, those without children, and their children."""
    operations = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("kind"))
    return records.inventory(operations, read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("operation_id")))


@query("""
WITH j AS (SELECT doc_id % 50 AS doc, count(*) AS n, round(avg(100 - 40 * toxic), 1) AS score, bool_and(toxic = 0) AS passed FROM labels GROUP BY 1)
SELECT d AS doc, CASE WHEN d % 7 <> 0 THEN 'p' || d % 3 END AS parser, CASE WHEN d % 7 = 0 THEN 0 ELSE n END AS n_records, CASE WHEN d % 7 = 0 THEN 0 ELSE score END::DOUBLE AS score, CASE WHEN d % 7 = 0 THEN false ELSE passed END AS passed, CASE WHEN d % 7 = 0 THEN 'unreadable' END AS error
FROM (SELECT DISTINCT doc_id % 50 AS d FROM documents) LEFT JOIN j ON doc = d""")
def file_reports(spark, sf_dir):
    """[DQ-04, DQ-05] One row a file: its parser, records, score and verdict, or its error."""
    files = read(spark, sf_dir, "documents").select((F.col("doc_id") % 50).alias("doc")).distinct()
    judged = read(spark, sf_dir, "labels").select((F.col("doc_id") % 50).alias("doc"), (100 - 40 * F.col("toxic")).alias("score"), (F.col("toxic") == 0).alias("passed"))
    parsed = files.where("doc % 7 <> 0").select("doc", F.concat(F.lit("p"), (F.col("doc") % 3).cast("string")).alias("parser"))
    return records.file_report(parsed, judged, files.where("doc % 7 = 0").select("doc", F.lit("unreadable").alias("error")))


@query("SELECT event_id, event_type, CASE WHEN event_type <> 'error' THEN length(event_type) END::INT AS event_type_id, (1 + (event_type IS NOT NULL)::INT)::INT AS n_filled FROM events")
def resolved_once(spark, sf_dir):
    """[STM-03, PRJ-17] Facts joined to names that were each resolved once, misses included; summaries count what is filled."""
    events = read(spark, sf_dir, "events").select("event_id", "event_type")
    names = events.select(F.col("event_type").alias("name")).distinct().select("name", F.when(F.col("name") != "error", F.length("name")).alias("id"))
    resolved = records.resolve_once(events, "event_type", names)
    return records.summary(events, ["event_id", "event_type"]).join(resolved, ["event_id", "event_type"]).select("event_id", "event_type", "event_type_id", "n_filled")


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at FROM events")
def stamped_rows(spark, sf_dir):
    """[NUM-12] Each event's own time as a stamp in UTC, to the second."""
    return records.stamped(read(spark, sf_dir, "events").select("event_id", "ts"), F.col("ts")).select("event_id", "at")


# ---- joins and links ---------------------------------------------------------------------------------------------


@query("""
WITH c AS (SELECT o_custkey AS doc, o_orderkey AS page FROM orders) SELECT doc, page, CASE WHEN page % 3 = 0 THEN 'number' ELSE 'page' END AS anchor, CASE WHEN page % 3 = 0 THEN page END AS found FROM c WHERE page % 3 < 2""")
def canonical_records(spark, sf_dir):
    """[JN-03] Canonical pages anchored by number, else by page, else dropped."""
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("page"))
    number = F.concat(F.lit("N-"), F.col("page").cast("string"), F.lit("/"))
    found = o.where("page % 3 = 0").select("doc", F.concat(F.lit("X"), F.col("page").cast("string")).alias("number"), F.col("page").alias("v"))
    found = found.unionByName(found.withColumn("number", F.concat("number", F.lit("-"))))
    joined = reconcile.canonical_join(o.withColumn("number", number), found, o.where("page % 3 = 1").withColumn("w", F.lit(1)))
    return joined.select("doc", "page", "anchor", F.col("by_number.v").alias("found"))


@query("""
SELECT o_custkey AS doc, o_orderkey AS id, CASE WHEN o_orderkey % 3 = 2 THEN NULL ELSE 'text of ' || o_orderkey || '.' END AS text FROM orders""")
def record_pages(spark, sf_dir):
    """[JN-04] Records with their page's text, by number, else by the page that names them."""
    o = read(spark, sf_dir, "orders")
    mark = lambda x: F.concat(F.lit("text of "), x.cast("string"), F.lit("."))
    paged = o.where("o_orderkey % 3 <> 2").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").cast("int").alias("page"), mark(F.col("o_orderkey")).alias("text"))
    rows = o.select(F.col("o_custkey").alias("doc"), F.concat(F.lit("OF "), _text("o_orderkey"), F.lit(".")).alias("id"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey").cast("int")).otherwise(-1).alias("page_no"))
    return reconcile.record_page(rows, paged).select("doc", F.regexp_extract("id", "([0-9]+)", 1).cast("long").alias("id"), "text")


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN coalesce(s_name, c_name) ELSE c_name END AS name, coalesce(c_name || ' trading', s_name) AS label, CASE WHEN s_suppkey IS NULL THEN 'A' || c_custkey ELSE 'A' || c_custkey || '|B' END AS codes,
  CASE WHEN s_suppkey IS NOT NULL THEN 'both' ELSE 'p' END AS codes_of FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey""")
def provenance_merge(spark, sf_dir):
    """[JN-02, RUL-13, RUL-14] Fields by policy with provenance: first side, cleaner name, union of codes."""
    c = read(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 1, F.col("c_name")).alias("name"), F.concat("c_name", F.lit(" trading")).alias("label"), F.concat(F.lit("A"), _text("c_custkey")).alias("codes"), "c_name").alias("p")
    s = read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("name"), F.concat("s_name", F.lit(" HS CODE 1 GROSS WEIGHT")).alias("label"), F.concat(F.lit("B, A"), _text("s_suppkey")).alias("codes")).alias("f")
    out = reconcile.reconcile_record(c.join(s, F.col("c_custkey") == F.col("s_suppkey"), "left"), {"name": "first", "label": "cleaner", "codes": "union"})
    return out.select("c_custkey", F.coalesce("name", "c_name").alias("name"), "label", "codes", F.col("provenance")["codes"].alias("codes_of"))


@query("""
SELECT o_orderkey, n_nationkey AS nation_id, CASE WHEN o_orderkey % 4 = 0 THEN 'missing' ELSE 'resolved' END AS nation_status, CASE WHEN c_nationkey IS NULL THEN NULL END::INT AS x, (o_orderkey % 4 <> 0) AS ready
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 0 THEN c_nationkey END AS k, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey) LEFT JOIN nation ON k = n_nationkey""")
def star_lookups(spark, sf_dir):
    """[JN-11] Facts with strict lookups, ready if no required one failed."""
    nation = read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    facts = read(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.when(F.col("o_orderkey") % 4 != 0, F.replace("n_name", F.lit("_"), F.lit(" "))).alias("land"), F.lit("nowhere").alias("port"))
    plan = lookup.mapping_plan(facts, "o_orderkey", {"nation": (nation, "land", "n_nationkey", ["n_name"], True), "port": (nation, "port", "n_nationkey", ["n_name"], False)})
    return plan.select("o_orderkey", "nation_id", "nation_status", F.col("port_id").cast("int").alias("x"), "ready")


@query("""
SELECT a.o_orderkey AS payload_id, b.o_orderkey AS operation_id FROM (SELECT * FROM orders WHERE o_orderstatus = 'P') a JOIN (SELECT * FROM orders WHERE o_orderstatus = 'F') b ON a.o_custkey = b.o_custkey AND a.o_orderpriority = b.o_orderpriority""")
def adopted_by_evidence(spark, sf_dir):
    """[JN-13, JN-18] Every orphan that a master's evidence reaches: a container and a date here."""
    empty = F.array().cast("array<string>")
    box = F.array(F.concat(_text("o_custkey"), F.lit("/"), "o_orderpriority"))
    side = lambda status: read(spark, sf_dir, "orders").where(F.col("o_orderstatus") == status).select(F.col("o_orderkey").alias("id"), F.lit("").alias("vessel"), F.lit("").alias("voyage"), F.lit("").alias("origin"), F.lit("").alias("destination"), box.alias("containers"), empty.alias("seals"), box.alias("dates"), empty.alias("references"))
    return link.adopt_by_evidence(side("P"), side("F")).select("payload_id", "operation_id")


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN array_to_string([c_name || ' Trading Co. (Nile Group)', c_name || ' Trading Co.', 'Nile Group', 'Hinted', c_name || ' Trading (Nile Group)', replace(c_name, '#', ' ') || ' Trading', replace(c_name, '#', ' ')], '|')
  ELSE array_to_string([c_name, replace(c_name, '#', ' ')], '|') END AS variants FROM customer""")
def name_variants(spark, sf_dir):
    """[JN-06] Alternates of names: brackets, hints, no legal forms, first words; each once."""
    name = F.when(F.col("c_custkey") % 2 == 0, F.concat("c_name", F.lit("  Trading Co. (Nile Group)"))).otherwise(F.col("c_name"))
    return read(spark, sf_dir, "customer").select("c_custkey", F.array_join(lookup.search_variants(name, {"nile group": ["Hinted"]}), "|").alias("variants"))


@query("""
WITH o AS (SELECT o_orderkey AS id, o_orderpriority || o_custkey % 50 AS number, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey % 3 END AS parent_id FROM orders), q AS (SELECT c_custkey AS q, '5-LOW' || c_custkey % 60 AS number, c_custkey % 3 AS master_id FROM customer)
SELECT q.q, arg_min(o.id, (o.parent_id IS NULL, o.id)) AS id FROM q LEFT JOIN o ON q.number = o.number AND (o.parent_id IS NULL OR o.parent_id = q.master_id) GROUP BY 1""")
def scoped_children(spark, sf_dir):
    """[FLT-17, JN-20] The child of a number under its master, else an orphan of that number."""
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.concat("o_orderpriority", (F.col("o_custkey") % 50).cast("string")).alias("number"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey") % 3).alias("parent_id"))
    q = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("q"), F.concat(F.lit("5-LOW"), (F.col("c_custkey") % 60).cast("string")).alias("number"), (F.col("c_custkey") % 3).alias("master_id"))
    return link.scoped_find(q, o)


@query("SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem WHERE l_returnflag = 'R'")
def invoice_scopes(spark, sf_dir):
    """[JN-22] The lines of a selected number."""
    return lookup.invoice_scope(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"), "l_returnflag", F.lit(" r-"))


@query("""
WITH o AS (SELECT o_orderkey AS id, o_orderkey % 5 AS k FROM orders) SELECT l_orderkey AS invoice, l_linenumber AS child, CASE WHEN l_orderkey % 2 = 0 THEN l_orderkey WHEN l_linenumber % 3 = 0 THEN l_partkey ELSE NULL END AS operation_id,
  CASE l_returnflag WHEN 'A' THEN 7 WHEN 'R' THEN 8 END::INT AS term_id, l_extendedprice AS base_price,
  CASE WHEN l_orderkey % 2 <> 0 AND l_linenumber % 3 <> 0 THEN 'no_operation' WHEN l_returnflag = 'N' THEN 'no_term' WHEN l_orderkey % 2 = 0 AND l_orderkey % 4 = 0 AND l_returnflag = 'A' THEN 'update' ELSE 'insert' END AS status FROM lineitem""")
def posting_lines(spark, sf_dir):
    """[SNK-10, JN-21] Invoice lines to postings: the operation, the base price, the term, insert or update."""
    lines = read(spark, sf_dir, "lineitem")
    child = F.when(F.col("l_orderkey") % 2 == 0, F.concat(F.lit("C"), _text("l_orderkey"))).otherwise("none")
    master = F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("M"), _text("l_partkey"))).otherwise("none")
    term = F.when(F.col("l_returnflag") == "A", "Ocean Freight").when(F.col("l_returnflag") == "R", "handling fee here").otherwise("zz")
    sent = lines.select(F.col("l_orderkey").alias("invoice"), child.alias("child"), master.alias("master"), term.alias("term"), (F.col("l_extendedprice") * 2).alias("unit_price"), F.lit(2.0).alias("rate"), "l_linenumber")
    ops = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("C"), _text("o_orderkey")).alias("number"))
    ops = ops.unionByName(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("M"), _text("p_partkey")).alias("number")))
    terms = spark.createDataFrame([(7, "ocean freight"), (8, "Handling Fee")], "term_id int, label string")
    done = read(spark, sf_dir, "orders").where("o_orderkey % 4 = 0").select(F.col("o_orderkey").alias("operation_id"), F.col("o_orderkey").alias("invoice"), F.lit(7).alias("term_id"))
    numbered = sent.withColumn("child", F.concat("child", F.lit("#"), F.col("l_linenumber").cast("string")))
    ops = ops.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(7)))).select("id", F.when(F.startswith("number", F.lit("C")), F.concat("number", F.lit("#"), F.col("n").cast("string"))).when(F.col("n") == 1, F.col("number")).alias("number")).where("number is not null")
    out = sinks.post_lines(numbered.drop("l_linenumber"), ops, done, terms)
    return out.select("invoice", F.regexp_extract("child", "#([0-9]+)$", 1).cast("int").alias("child"), "operation_id", "term_id", "base_price", "status")


@query("SELECT DISTINCT a.l_linenumber AS house_id, b.l_partkey AS container_id FROM lineitem a JOIN lineitem b USING (l_orderkey)")
def container_bridges(spark, sf_dir):
    """[SNK-04] Every container of a master with every house of it."""
    lines = read(spark, sf_dir, "lineitem")
    return sinks.bridge(lines.select("l_orderkey", F.col("l_linenumber").alias("house_id")).distinct(), lines.select("l_orderkey", F.col("l_partkey").alias("container_id")).distinct(), "l_orderkey")


@query("""
SELECT o_orderkey AS child, o_totalprice AS kg, CASE WHEN o_orderkey % 4 = 0 THEN 'insert' WHEN o_orderkey % 4 = 1 OR o_orderkey % 3 = 0 THEN 'update' ELSE 'conflict' END AS action FROM orders""")
def cargo_actions(spark, sf_dir):
    """[SNK-09] Expected against existing cargo: insert, update or conflict."""
    o = read(spark, sf_dir, "orders")
    existing = o.where("o_orderkey % 4 <> 0").select(F.col("o_orderkey").alias("child"), (F.col("o_totalprice") + F.when(F.col("o_orderkey") % 4 == 1, 0.005).otherwise(5.0)).alias("kg"), (F.col("o_orderkey") % 3 == 0).alias("tagged"))
    return sinks.invoice_cargo(o.select(F.col("o_orderkey").alias("child"), F.col("o_totalprice").alias("kg")), existing, ["kg"])


@query("""
SELECT l_orderkey AS file, l_linenumber::VARCHAR AS child, (row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_returnflag, l_extendedprice) - 1)::INT AS line_no, l_returnflag AS term, l_extendedprice AS amount FROM lineitem""")
def flat_costs(spark, sf_dir):
    """[SNK-08] Nested cost groups as flat lines."""
    groups = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.array_sort(F.collect_list(F.struct(F.col("l_returnflag").alias("term"), F.col("l_extendedprice").alias("amount")))).alias("lines"))
    docs = groups.groupBy(F.col("l_orderkey").alias("file")).agg(F.collect_list(F.struct(_text("l_linenumber").alias("child"), "lines")).alias("groups"))
    return sinks.cost_lines(docs)


# ---- sources and audit -------------------------------------------------------------------------------------------


@query("""
WITH s AS (SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN NULL ELSE 'scan ' || doc_id END AS scan FROM documents)
SELECT doc_id AS doc, CASE doc_id % 4 WHEN 0 THEN lang WHEN 1 THEN lang || chr(10) || scan WHEN 2 THEN scan ELSE lang END AS text, CASE doc_id % 4 WHEN 0 THEN 'native' WHEN 1 THEN 'hybrid' WHEN 2 THEN 'ocr' ELSE 'native_sparse' END AS method,
  CASE WHEN doc_id % 4 <> 3 THEN 3.0::DOUBLE END AS confidence, CASE WHEN doc_id % 4 <> 3 THEN 3 END::BIGINT AS words FROM documents JOIN s USING (doc_id) WHERE lang IS NOT NULL""")
def hybrid_texts(spark, sf_dir):
    """[SRC-05, SRC-06, AGG-15] Text layers with the best scan, where they are sparse."""
    docs = read(spark, sf_dir, "documents").where("lang is not null").select("doc_id", "lang")
    k = F.col("doc_id") % 4
    native = docs.select(F.col("doc_id").alias("doc"), F.when(k == 2, "").otherwise(F.col("lang")).alias("text"), F.when(k == 0, "native").otherwise("native_sparse").alias("method"))
    scans = docs.where(k != 3).select(F.col("doc_id").alias("doc"), F.explode(F.array(F.struct(F.concat(F.lit("scan "), _text("doc_id")).alias("text"), F.lit(5.0).alias("confidence"), F.lit(1).alias("words")), F.struct(F.lit("worse").alias("text"), F.lit(1.0).alias("confidence"), F.lit(2).alias("words")))).alias("x"))
    return readers.hybrid_text(native, scans.select("doc", "x.*"))


@query("""
SELECT doc_id AS doc, i::INT AS line_no, w || ' ' || w || '    x' AS text FROM (SELECT doc_id, unnest([0, 1]) AS i, source AS w FROM documents WHERE source IS NOT NULL)""")
def visual_lines(spark, sf_dir):
    """[SRC-03, SRC-04] Words by place on a page to lines."""
    docs = read(spark, sf_dir, "documents").where("source is not null").select(F.col("doc_id").cast("string").alias("doc"), F.col("source").alias("w"))
    n = F.length("w").cast("double") * 10
    word = lambda x0, x1, y, t: F.struct(x0.alias("x0"), x1.alias("x1"), y.alias("y"), t.alias("text"))
    row = lambda y: [word(F.lit(0.0), n, F.lit(y), F.col("w")), word(n + 10, n * 2 + 10, F.lit(y + 1.5), F.col("w")), word(n * 2 + 110, n * 2 + 120, F.lit(y), F.lit("x"))]
    words = docs.select("doc", F.lit(1).alias("page"), F.explode(F.array(*row(100.0), *row(150.0))).alias("x")).select("doc", "page", "x.*")
    return readers.visual_lines(words).select(F.col("doc").cast("long").alias("doc"), "line_no", "text")


@query("""
SELECT 'order' AS entity, 'status' AS field, o_orderstatus AS label, 1::INT AS code FROM orders GROUP BY 3 UNION ALL SELECT 'part', 'size', p_type, 2 FROM part GROUP BY 3""")
def option_sources(spark, sf_dir):
    """[SRC-15] Option sets by the source of the smallest rank that has the field."""
    kind = lambda df, entity, field, label, code: df.select(F.lit(entity).alias("entity"), F.lit(field).alias("field"), F.col(label).alias("label"), F.lit(code).alias("code")).distinct()
    live = kind(read(spark, sf_dir, "orders"), "order", "status", "o_orderstatus", 1)
    disk = kind(read(spark, sf_dir, "orders"), "order", "status", "o_orderpriority", 9).unionByName(kind(read(spark, sf_dir, "part"), "part", "size", "p_type", 2))
    return readers.options([(1, live), (2, disk)])


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 200000 AND o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def predicate_scans(spark, sf_dir):
    """[FLT-15, FLT-16, SRC-16] A pushed-down filter and projection, the first rows of an order."""
    scan = readers.predicate_scan(read(spark, sf_dir, "orders").withColumn("less", -F.col("o_totalprice")), "o_totalprice > 200000 AND o_orderstatus = 'F'", ["o_orderkey", "o_totalprice", "less"], ["less", "o_orderkey"], 25)
    return scan.drop("less")


@query("""
SELECT event_id AS audit_id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'processing' ELSE 'success' END AS status, CASE WHEN event_type = 'error' THEN 'boom' END AS error FROM events""")
def upload_log(spark, sf_dir):
    """[SNK-06, SRC-17, STM-01] Uploads begun and ended in an append-only log, and the last state of each."""
    files = read(spark, sf_dir, "events").select(F.col("event_id").alias("audit_id"), F.col("user_id").cast("string").alias("file_name"), F.when(F.col("event_type") == "error", "boom").alias("error"), "event_type")
    log = audit.started(files, F.lit(1)).unionByName(audit.finished(files.where("event_type <> 'view'"), F.lit(2)))
    return audit.latest_state(log, "audit_id", ["at"]).select("audit_id", "status", "error")


# ---- rules -------------------------------------------------------------------------------------------------------


@query("""
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 300000000 WHEN 1 THEN 300000001 WHEN 2 THEN 300000000 END::INT AS direction, CASE o_orderkey % 5 WHEN 0 THEN 300000001 WHEN 1 THEN 300000001 WHEN 2 THEN 300000000 WHEN 3 THEN 300000001 ELSE 300000000 END::INT AS by_evidence,
  CASE o_orderkey % 5 WHEN 0 THEN 300000000 WHEN 1 THEN 300000001 WHEN 2 THEN 300000000 WHEN 3 THEN 300000001 ELSE 300000000 END::INT AS by_record, CASE WHEN o_orderkey % 5 IN (1, 3) THEN 0 ELSE 2 END::INT AS teu FROM orders""")
def load_types(spark, sf_dir):
    """[RUL-02, RUL-03, RUL-04, RUL-06] Direction, load type by both precedences, and what children of shared loads carry."""
    d, k = F.col("o_orderkey") % 4, F.col("o_orderkey") % 5
    way = rules.direction(F.when(d == 1, "Port Said, Egypt").otherwise("Shanghai"), F.when((d == 0) | (d == 2), "ALEXANDRIA egypt").otherwise("Rotterdam"), ("EGYPT",))
    text = F.when(k == 0, "CY / CFS with H/BL").when(k == 1, "seen LCL/LCL").when(k == 2, "goods CY/CY FCL").when(k == 3, "groupage of boxes").otherwise("plain")
    existing = F.when(k == 0, "300000000")
    no, false = F.lit(None).cast("string"), F.lit(False)
    signal = rules.lcl_signal(text, F.lit("native"), false, no, no)
    by_record = rules.load_type_by_record(existing, text, no, no, no, false, F.lit(2))
    return read(spark, sf_dir, "orders").select("o_orderkey", way.alias("direction"), rules.load_type_by_evidence(existing, text, signal, F.lit(2)).alias("by_evidence"), by_record.alias("by_record"), rules.teus(by_record, F.lit(2), F.lit(True)).alias("teu"))


@query("""
SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 886150001 WHEN doc_id % 4 = 1 THEN 886150000 WHEN doc_id % 4 = 2 THEN 886150001 END::INT AS status FROM documents""")
def release_marks(spark, sf_dir):
    """[AGG-21] Votes on whole texts that carry marks: overlapping patterns, originals, a stated word, or nothing."""
    k = F.col("doc_id") % 4
    said = F.concat("text", F.when(k == 0, "\nNON-NEGOTIABLE SEA WAY BILL").when(k == 1, "\nSEA WAY BILL").otherwise(""))
    status = rules.release_status(F.when(k == 2, " Seaway "), said, F.when(k < 2, "3"), F.lit(False))
    return read(spark, sf_dir, "documents").select("doc_id", status.alias("status"))


@query("""
SELECT l_orderkey, l_linenumber, bool_or(l_returnflag = 'R') OVER (PARTITION BY l_orderkey) AS shipment_lcl FROM lineitem""")
def shipment_loads(spark, sf_dir):
    """[RUL-08] Any child's shared load lifts the whole shipment."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return rules.shipment_lcl(lines, "l_orderkey", F.col("l_returnflag") == "R").drop("l_returnflag")


@query("""
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 886150000 ELSE 886150001 END::INT AS booking_code, CASE WHEN o_orderstatus = 'F' THEN 'Origin' ELSE 'Destination' END AS payable_at, CASE WHEN o_orderkey % 2 = 0 THEN '300000001' ELSE '300000000' END AS load_type, CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE 3 END::INT AS teu, 3::INT AS teu_off FROM orders""")
def rule_packs(spark, sf_dir):
    """[RUL-07, UDF-03] The rule pack applied twice, and switched off."""
    o = read(spark, sf_dir, "orders")
    none = _none().cast("string")
    rows = o.select(
        "o_orderkey", F.when(F.col("o_orderstatus") == "F", "PREPAID").otherwise("CC").alias("freight_term"), none.alias("load_type"), F.when(F.col("o_orderkey") % 2 == 0, "LCL").otherwise("FULL CONTAINER LOAD").alias("text"), none.alias("description"),
        none.alias("parent_no"), none.alias("child_no"), F.lit(False).alias("consolidated"), F.lit(1).alias("n_containers"), F.lit(3).alias("teu"), _none().cast("int").alias("booking_code"), none.alias("payable_at"),
    )
    child = F.lit(True)
    done = rules.apply_pack(rules.apply_pack(rows, is_child=child), is_child=child)
    with rules.use_rules(False):
        off = rules.apply_pack(rows, is_child=child).select(F.col("o_orderkey").alias("k"), F.col("teu").alias("teu_off"))
    return done.join(off, F.col("o_orderkey") == F.col("k")).select("o_orderkey", "booking_code", "payable_at", "load_type", "teu", "teu_off")


@query("""
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name || chr(10) || 'UN 1993, CLASS 3' WHEN 1 THEN p_name || ' un 1993' || chr(10) || 'CLASS 3' ELSE p_name END AS description, CASE WHEN p_partkey % 2 = 0 THEN p_size::INT END AS packages, (p_partkey % 4 <> 0) AS accepted, CASE WHEN p_partkey % 4 = 0 THEN 'id' ELSE '' END || CASE WHEN p_partkey % 2 = 1 THEN 'b' ELSE '' END AS missing FROM part""")
def cargo_rules(spark, sf_dir):
    """[RUL-09, RUL-10, RUL-12] Hazards in cargo texts, counts in narrative, and what makes a record acceptable."""
    k = F.col("p_partkey") % 3
    un, cls = F.when(k < 2, "1993"), F.when(k < 2, "3")
    described = parties.hazard_description(F.when(k == 1, F.concat("p_name", F.lit(" un 1993"))).otherwise(F.col("p_name")), un, cls, F.lit(None).cast("string"))
    counted = rules.package_total(F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("in "), F.col("p_size").cast("int").cast("string"), F.lit(" ctns of "), "p_name")).otherwise("no cartons"))
    accepted, _, missing = rules.confidence({"id": F.when(F.col("p_partkey") % 4 != 0, F.col("p_name")), "a": F.col("p_name"), "b": F.when(F.col("p_partkey") % 2 == 0, "x"), "c": F.col("p_type")}, 2)
    return read(spark, sf_dir, "part").select("p_partkey", described.alias("description"), counted.alias("packages"), accepted.alias("accepted"), F.array_join(missing, "").alias("missing"))


@query("""
WITH o AS (SELECT o_custkey AS doc, o_orderkey AS k FROM orders)
SELECT doc, coalesce(string_agg('REF' || k || '0000', '|' ORDER BY k) FILTER (k % 2 = 1), '') AS rest, count(*) FILTER (k % 2 = 0) AS n_attached FROM o GROUP BY 1""")
def unattached_references(spark, sf_dir):
    """[SET-13] References on the face of documents that their attached lists don't name: read from the texts of both."""
    o = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    ref = F.concat(F.lit("ref"), _text("o_orderkey"), F.lit("0000"))
    face = F.concat(F.lit("REF: "), ref, F.lit(" / "), F.upper(ref), F.lit("\n"))
    listed = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("1 carton "), ref, F.lit(" 5 kg\n"))).otherwise("")
    own = F.array_sort(F.collect_list(F.struct("o_orderkey", face.alias("face"), listed.alias("listed"))))
    part = lambda name: F.array_join(F.transform("own", lambda x: x[name]), "")
    docs = o.groupBy(F.col("o_custkey").alias("doc")).agg(own.alias("own")).select("doc", F.concat(F.lit("--- PAGE 1 ---\n"), part("face"), F.lit("--- PAGE 2 ---\nAttached list\n"), part("listed"), F.lit("--- PAGE 3 ---\nREF99990000\n")).alias("text"))
    return layouts.face_references(docs).select("doc", F.array_join("references", "|").alias("rest"), F.size("attached").cast("long").alias("n_attached"))


@query("""
SELECT source AS doc, count(*) AS n_records, sum(CASE WHEN doc_id % 2 = 1 THEN 1 ELSE 0 END)::BIGINT AS n_odd FROM documents WHERE source IS NOT NULL GROUP BY 1""")
def issue_counts(spark, sf_dir):
    """[DQ-01] Records of each document, and how many have an issue."""
    docs = read(spark, sf_dir, "documents").where("source is not null").select("doc_id", F.col("source").alias("doc"))
    judged = quality.judge(docs, F.array_compact(F.array(quality.issue(F.col("doc_id") % 2 == 1, "info", "odd"))))
    return judged.groupBy("doc").agg(F.count(F.lit(1)).alias("n_records"), F.count_if(F.size("issues") > 0).alias("n_odd"))


# ---- layouts and the validator -----------------------------------------------------------------------------------


def layout_texts(spark, sf_dir) -> DataFrame:
    """docs(doc, kind, text): orders as one of five layouts."""
    o = read(spark, sf_dir, "orders")
    n = _text("o_orderkey")
    head = F.concat(F.lit("B/L NO: ORD"), F.lpad(n, 8, "0"), F.lit("\nSHIPPER\nBlue Nile Trading\n5 Palm Street\nCONSIGNEE\nDelta Imports\n9 Canal Road\nNOTIFY PARTY\nSame as consignee\n"))
    day = lambda k: F.date_format(F.date_add("o_orderdate", k), "dd/MM/yyyy")
    kind = F.col("o_orderkey") % 5
    text = (
        F.when(kind == 0, F.concat(F.lit("HOUSE BILL\nHBL NO: HB"), F.lpad(n, 7, "0"), F.lit("\n"), head, F.lit("FREIGHT COLLECT\nPORT OF DISCHARGE: Port Said\nsailed "), day(-9), F.lit(" on board "), day(0), F.lit("\nissued "), day(1)))
        .when(kind == 1, F.concat(F.lit("SEA WAYBILL of ARKAS\n"), head, F.lit("Booking No.\nBK"), n, F.lit("99999\nTOTAL : "), (F.col("o_orderkey") % 90 + 1).cast("string"), F.lit(" PALLETS 1,250.5 KGS\nIMPORTER TAX ID: 123456"), F.lpad(n, 6, "0")))
        .when(kind == 2, F.concat(F.lit("BILL OF LADING\n"), head, F.lit("VESSEL  PORT OF LOADING  PORT OF DISCHARGE  DELIVERY\nSEA "), n, F.lit("  Shanghai  Port Said  Cairo\nCFS / CFS\nFREIGHT PAYABLE AT: Cairo")))
        .when(kind == 3, F.concat(F.lit("FREIGHT DEBIT NOTE\nHOUSE NO: H-"), n, F.lit("1000\nMASTER NO: M-"), n, F.lit("1000\nSHIPMENT REF: S-"), n, F.lit("\nterms FOB\nPACKS: "), (F.col("o_orderkey") % 90 + 1).cast("string"), F.lit("\nREBATE")))
        .otherwise(F.concat(F.lit("DRAFT\nSHIPPER\nBlue Nile Trading\nMARKS: ISA"), F.lpad(n, 6, "0"), F.lit("\n"), (F.col("o_orderkey") % 90 + 1).cast("string"), F.lit(" ROLLS\n1,300.5 (KGS)\n2.25 (CBM)\nTHREE(3)\n***UNSTACKABLE***")))
    )
    return o.select(F.col("o_orderkey").alias("doc"), text.alias("text"))


@query("""
WITH o AS (SELECT *, o_orderkey % 5 AS k, o_orderkey % 90 + 1.0::DOUBLE AS n, 'ORD' || lpad(o_orderkey::VARCHAR, 8, '0') AS ord, 'ISA' || lpad(o_orderkey::VARCHAR, 6, '0') AS isa FROM orders)
SELECT o_orderkey AS doc, ['house', 'sea_waybill', 'master', 'debit_note', 'draft'][k + 1] AS parser, CASE k WHEN 3 THEN 'M-' || o_orderkey || '1000' WHEN 4 THEN isa ELSE ord END AS parent_no, CASE k WHEN 0 THEN 'HB' || lpad(o_orderkey::VARCHAR, 7, '0') WHEN 3 THEN 'H-' || o_orderkey || '1000' WHEN 4 THEN isa END AS child_no,
  CASE k WHEN 1 THEN 'BK' || o_orderkey || '99999' WHEN 2 THEN ord WHEN 3 THEN 'S-' || o_orderkey WHEN 4 THEN isa END AS booking_no, CASE k WHEN 0 THEN 300000001 WHEN 1 THEN 300000000 WHEN 2 THEN 300000001 WHEN 3 THEN 300000000 END::INT AS load_type, CASE k WHEN 0 THEN 'COLLECT' WHEN 1 THEN 'PREPAID' END AS freight_term,
  CASE WHEN k IN (1, 3, 4) THEN n END AS packages, CASE k WHEN 1 THEN 1250.5 WHEN 4 THEN 1300.5 END::DOUBLE AS gross_kg, CASE WHEN k = 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS on_board_date, CASE WHEN k = 0 THEN strftime(o_orderdate + INTERVAL 1 DAY, '%Y-%m-%d') END AS issue_date,
  CASE k WHEN 0 THEN 'PORT SAID' WHEN 2 THEN 'PORT SAID' END AS destination, CASE WHEN k = 2 THEN 'SEA ' || o_orderkey END AS vessel, CASE k WHEN 0 THEN 'PORT SAID' WHEN 2 THEN 'CAIRO' END AS delivery, CASE WHEN k = 1 THEN 'ARKAS DENIZCILIK VE NAKLIYAT A.S.' END AS carrier, CASE WHEN k = 1 THEN '123456' || lpad(o_orderkey::VARCHAR, 6, '0') END AS importer_tax,
  CASE WHEN k = 3 THEN 'FOB' END AS incoterm, CASE WHEN k = 3 THEN 'REBATE (debit note charge) | Shipment Ref: S-' || o_orderkey || ' | House H-' || o_orderkey || '1000 / Master M-' || o_orderkey || '1000' END AS description, CASE WHEN k = 4 THEN '3' END AS originals, CASE WHEN k = 4 THEN 'UNSTACKABLE' END AS notes,
  CASE WHEN k = 0 THEN '9 Canal Road' END AS notify_addr, CASE WHEN k = 2 THEN 'CAIRO' END AS payable_at, CASE WHEN k = 2 THEN 'CFS/CFS' END AS service FROM o""")
def layout_records(spark, sf_dir):
    """[WIN-01, RGX-16 to RGX-20, RGX-24] Five layouts told apart, each with its own columns."""
    # a text costs milliseconds: dealt to all cores
    texts = layout_texts(spark, sf_dir).repartition(4 * spark.sparkContext.defaultParallelism)
    best = layouts.best_layout(texts, ["Shanghai", "Port Said"])
    names = ("parent_no", "child_no", "booking_no", "load_type", "freight_term", "packages", "gross_kg", "on_board_date", "issue_date", "destination", "vessel", "delivery", "carrier", "importer_tax", "incoterm", "description", "originals", "notes", "notify_addr", "payable_at", "service")
    return best.select("doc", "parser", *[F.col(f"record.{c}").alias(c) for c in names])


@query("""
SELECT o_custkey AS doc, o_orderkey::INT AS page, 'ISA' || lpad(o_orderkey::VARCHAR, 6, '0') AS number, (o_orderkey % 90 + 1)::DOUBLE AS packages FROM orders WHERE o_orderkey % 5 = 4""")
def draft_pages(spark, sf_dir):
    """[RGX-19] A record a page of a draft, the first of those that repeat an id."""
    texts = layout_texts(spark, sf_dir).where("doc % 5 = 4").join(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("doc") == F.col("o_orderkey"))
    page = lambda n: F.concat(F.lit("--- PAGE "), n.cast("string"), F.lit(" ---\n"), "text", F.lit("\n"))
    docs = texts.groupBy(F.col("o_custkey").alias("d")).agg(F.array_join(F.array_sort(F.collect_list(F.concat(page(F.col("o_orderkey")), page(F.col("o_orderkey") + 50_000_000)))), "").alias("text"))
    return layouts.draft_records(docs.select(F.col("d").alias("doc"), "text")).select("doc", "page", "number", "packages")


@query("""
SELECT o_custkey AS doc, string_agg('REF' || o_orderkey || '0000', ',' ORDER BY o_orderkey) AS refs FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1""")
def attached_references(spark, sf_dir):
    """[RGX-22] References of the attached lists of documents, not of their other pages."""
    o = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    page = F.concat(F.lit("--- PAGE "), _text("o_orderkey"), F.lit(" ---\n"), F.when(F.col("o_orderkey") % 2 == 0, "Attached  list\n").otherwise("cargo\n"), F.lit("Ref"), _text("o_orderkey"), F.lit("0000, ref"), _text("o_orderkey"), F.lit("0000\n"))
    docs = o.groupBy(F.col("o_custkey").alias("doc")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", page.alias("p")))), lambda x: x["p"]), "").alias("text"))
    return layouts.attached_references(docs).select("doc", F.array_join("references", ",").alias("refs"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'Delta Imports' ELSE 'Nile Stores' END AS consignee, CASE WHEN o_orderkey % 3 = 0 THEN '9 Canal Road' ELSE '5 Palm Street' END AS consignee_addr, CASE WHEN o_orderkey % 2 = 0 THEN 'Blue Nile Trading' END AS shipper FROM orders""")
def repaired_parties(spark, sf_dir):
    """[RGX-20] Consignees that are form labels or have no address give way to the notify party."""
    k = F.col("o_orderkey") % 3
    rows = read(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(k == 0, "Delta Imports").when(k == 1, "CONSIGNEE:").otherwise("Delta Imports").alias("consignee"), F.when(k == 2, " ").otherwise("9 Canal Road").alias("consignee_addr"),
        F.lit("Nile Stores").alias("notify"), F.lit("5 Palm Street").alias("notify_addr"), F.when(F.col("o_orderkey") % 2 == 0, "Blue Nile Trading").otherwise("Notify party").alias("shipper"),
    )
    return layouts.repair_parties(rows).select("o_orderkey", "consignee", "consignee_addr", "shipper")


_BILL = """SELECT o_orderkey, 'ORD' || lpad(o_orderkey::VARCHAR, 8, '0') AS parent_no, 'HS' || o_custkey || '9000' AS child_no, lpad(o_orderkey::VARCHAR, 19, '7') AS customs_id, CASE WHEN lpad(o_orderkey::VARCHAR, 6, '8') = '392410' THEN '392410' ELSE lpad(o_orderkey::VARCHAR, 6, '8') || '|392410' END AS tariff_code,
  'V' || o_custkey || 'W' AS voyage, CASE WHEN o_orderstatus = 'F' THEN 'PREPAID' ELSE 'COLLECT' END AS freight_term, strftime(o_orderdate, '%Y-%m-%d') AS issue_date, o_orderkey % 3 = 0 AS given FROM orders"""


@query(f"""
WITH b AS ({_BILL}) SELECT o_orderkey, parent_no, child_no, customs_id, tariff_code, CASE WHEN given THEN 'GIVEN STAR' ELSE 'SEA STAR' END AS vessel, voyage, 'SHANGHAI' AS origin, CASE WHEN given THEN 'Cairo' ELSE 'PORT SAID' END AS destination, issue_date, '12 PALLET' AS packages, '1250.5' AS gross_kg,
  'SL' || lpad(o_orderkey::VARCHAR, 5, '0') AS seal_no, '40HC' AS container_type, '300000001' AS load_type, freight_term, 300000000::INT AS direction, 886150001 - (freight_term = 'PREPAID')::INT AS booking_code, 0::INT AS teu,
  CASE WHEN given THEN 6 ELSE 8 END AS n_warnings FROM b""")
def validated_records(spark, sf_dir):
    """[RUL-01, RGX-23] Records filled and corrected from their texts, with a warning for each change but those that
    enrichment makes, which is silent."""
    return _validated(spark, sf_dir, False)


@query(f"""
WITH b AS ({_BILL}) SELECT o_orderkey, parent_no, child_no, customs_id, tariff_code, CASE WHEN given THEN 'GIVEN STAR' ELSE 'SEA STAR' END AS vessel, voyage, 'SHANGHAI' AS origin, 'ANCHORED' AS destination, issue_date, '12 PALLET' AS packages, '1250.5' AS gross_kg,
  'SL' || lpad(o_orderkey::VARCHAR, 5, '0') AS seal_no, '40HC' AS container_type, '300000001' AS load_type, freight_term, 300000000::INT AS direction, 886150001 - (freight_term = 'PREPAID')::INT AS booking_code, 0::INT AS teu,
  CASE WHEN given THEN 6 ELSE 8 END AS n_warnings FROM b""")
def validated_by_page(spark, sf_dir):
    """[RUL-16] Records validated, corrected by their pages, and validated again: the second time adds no warning."""
    return _validated(spark, sf_dir, True)


def _validated(spark, sf_dir, twice: bool) -> DataFrame:
    given = F.col("o_orderkey") % 3 == 0
    rows = bills(spark, sf_dir).select(
        _text("o_orderkey").alias("doc"), F.lit(1).alias("page"), "text", F.when(given, " GIVEN STAR;").otherwise("ZERO").alias("vessel"), F.when(given, "Cairo").alias("destination"), F.when(given, "1250,50").alias("gross_kg"), F.lit("Alexandria").alias("origin"), F.lit(3).alias("teu"),
    )
    # a text costs milliseconds, so rows are dealt to all cores rather than left in the few splits that their bytes make
    rows = rows.repartition(4 * spark.sparkContext.defaultParallelism)
    options = {"ports": ["Shanghai", "Port Said"], "home": ("PORT SAID", "ALEXANDRIA", "CAIRO", "ANCHORED")}
    if twice:
        done = validate.validate_by_page(rows, rows.select("doc", "page", F.lit("ANCHORED").alias("destination")), ["destination"], **options)
    else:
        done = validate.validate(rows, **options)
    names = ("parent_no", "child_no", "customs_id", "tariff_code", "vessel", "voyage", "origin", "destination", "issue_date", "packages", "gross_kg", "seal_no", "container_type", "load_type", "freight_term", "direction", "booking_code", "teu")
    return done.select(F.col("doc").cast("long").alias("o_orderkey"), *names, F.size("warnings").alias("n_warnings"))
