"""Relational operators on literal rows."""

import random
import zipfile

from pyspark.sql import functions as F

from brinewood.operators import dedup, diff, grid, link, lookup, pages, quality, reconcile, rollup, rules, shape
from brinewood.sources import readers, sinks
from brinewood.streaming import audit, windows


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_dedup_keyless(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None)], "i int, k string")
    for keyless, kept in (("keep", [1, 3, 4]), ("drop", [1]), ("one", [1, 3])):
        found = dedup.keep_first(df, F.col("k"), [F.col("i")], keyless=keyless)
        assert [r.i for r in found.orderBy("i").collect()] == kept
        assert rows(dedup.keep_first(found, F.col("k"), [F.col("i")], keyless=keyless), "i") == rows(found, "i")
        assert rows(dedup.keep_first(df.repartition(3, "i"), F.col("k"), [F.col("i")], keyless=keyless), "i") == rows(found, "i")


def test_upsert_twice_is_once(spark):
    current = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "id int, s string, v double")
    changes = spark.createDataFrame([(2, None, 5.0), (3, "c", None)], "id int, s string, v double")
    once = dedup.upsert(current, changes, ["id"])
    assert rows(once, "id") == [(1, "a", 1.0), (2, "b", 5.0), (3, "c", None)]
    assert rows(dedup.upsert(once, changes, ["id"]), "id") == rows(once, "id")


def test_suffixes(spark):
    df = spark.createDataFrame([(1, "m", "x"), (2, "m", "x"), (3, "m", "y"), (4, "n", "x")], "i int, m string, slug string")
    assert [r.s for r in df.withColumn("s", dedup.number_suffixes(df, "slug", ["m"], [F.col("i")])).orderBy("i").collect()] == ["x", "x-2", "y", "x"]


def test_reconcile_lists(spark):
    p = spark.createDataFrame([("k1", 1, "a", None), ("k2", 2, "", "q"), (None, 3, "loose", None)], "key string, ord int, x string, y string")
    f = spark.createDataFrame([("k2", 1, "b", "z"), ("k3", 2, "c", "c"), (None, 3, "free", None)], "key string, ord int, x string, y string")
    out = reconcile.reconcile_lists(p, f, "key", "ord", ["x", "y"], prefer_fallback=("y",))
    assert set(rows(out, "key", "x")) == {("k1", "a", None, "primary"), ("k2", "b", "z", "both"), ("k3", "c", "c", "fallback"), (None, "loose", None, "primary"), (None, "free", None, "fallback")}


def test_reconcile_record_provenance(spark):
    p = spark.createDataFrame([(1, "  ", "long text", "1|2", "x")], "id int, a string, b string, c string, d string").alias("p")
    f = spark.createDataFrame([(1, "v", "short", "2,3", "y")], "id int, a string, b string, c string, d string").alias("f")
    out = reconcile.reconcile_record(p.join(f, F.col("p.id") == F.col("f.id")), {"a": "first", "b": "longer", "c": "union", "d": "second"}).first()
    assert (out.a, out.b, out.c, out.d) == ("v", "long text", "1|2|3", "y")
    assert out.provenance == {"a": "f", "b": "p", "c": "both", "d": "f"}


def test_canonical_and_page_joins(spark):
    canonical = spark.createDataFrame([("d", 1, "AB-1"), ("d", 2, "X9"), ("d", 3, "none")], "doc string, page int, number string")
    records = spark.createDataFrame([("d", "1", "one")], "doc string, number string, v string")
    paged = spark.createDataFrame([("d", 2, "two")], "doc string, page int, v string")
    assert [(r.page, r.anchor) for r in reconcile.canonical_join(canonical, records, paged).orderBy("page").collect()] == [(1, "number"), (2, "page")]
    texts = spark.createDataFrame([("d", 1, "has AB-1"), ("d", 2, "ab-1 too")], "doc string, page int, text string")
    asked = spark.createDataFrame([("d", "AB-1", None), ("d", "zz", None), ("d", "q", 2)], "doc string, id string, page_no int")
    assert {r.id: r.text for r in reconcile.record_page(asked, texts).collect()} == {"AB-1": "has AB-1", "zz": None, "q": "ab-1 too"}


def test_lookup_scores_ambiguity_and_plan(spark):
    pairs = spark.createDataFrame([("Acme", "acme."), ("Acme", "Acme Ltd"), ("Big Acme Co", "acme"), ("red blue green", "blue red pink"), ("", "x")], "a string, b string")
    assert [r.s for r in pairs.select(lookup.match_score(F.col("a"), F.col("b")).alias("s")).collect()] == [100, 90, 75, 40, 0]
    variants = spark.createDataFrame([("Foo Trading Co Ltd (Bar)",)], "x string").select(lookup.search_variants(F.col("x"), {"foo": ["FOO INTL"]}).alias("v")).first().v
    assert variants[:4] == ["Foo Trading Co Ltd (Bar)", "Foo Trading Co Ltd", "Bar", "FOO INTL"]
    dim = spark.createDataFrame([(1, "Alpha", "A"), (2, "Beta", "B"), (3, "Beta", "C")], "id int, name string, code string")
    q = spark.createDataFrame([(1, "alpha"), (2, "beta"), (3, "gamma"), (4, None), (5, "first")], "q int, n string")
    out = lookup.strict_lookup(q, dim, query_id="q", query_name="n", dim_id="id", labels=["name", "code"], aliases={"first": "Alpha"})
    assert rows(out, "q") == [(1, 1, "resolved"), (2, None, "ambiguous"), (3, None, "unresolved"), (4, None, "missing"), (5, 1, "resolved")]
    plan = lookup.mapping_plan(q, "q", {"party": (dim, "n", "id", ["name"], True)})
    assert {r.q: (r.ready, r.errors) for r in plan.collect()}[2] == (False, ["party:ambiguous"])
    fuzzy = lookup.fuzzy_lookup(spark.createDataFrame([(1, "alpha house"), (2, "zzz")], "q int, n string"), dim, query_id="q", query_name="n", dim_id="id", dim_name="name")
    assert rows(fuzzy, "q") == [(1, 1, 90), (2, None, 0)]


def test_options_and_scope(spark):
    df = spark.createDataFrame([("Prepaid",), ("100000001",), ("pre",), ("frei haus",), ("zz",), (None,)], "x string")
    codes = lookup.option_code(F.col("x"), {"Prepaid": 100000000, "Collect": 100000001}, {"frei haus": "Prepaid"})
    assert [r.c for r in df.select(codes.alias("c")).collect()] == [100000000, 100000001, 100000000, 100000000, None, None]
    lines = spark.createDataFrame([("A-1",), ("B2",)], "k string")
    assert lookup.invoice_scope(lines, "k", F.lit("a1")).count() == 1 and lookup.invoice_scope(lines, "k", F.lit("zz")).count() == 2


def side(spark, data):
    kind = "id int, vessel string, voyage string, origin string, destination string, containers array<string>, seals array<string>, dates array<string>, references array<string>"
    return spark.createDataFrame(data, kind)


def test_evidence(spark):
    payloads = side(spark, [(1, "Star", "12OW", "A", "B", [], [], ["d"], []), (2, "", "", "", "", ["C1"], ["S1"], [], []), (3, "", "", "", "", ["C2"], [], [], []), (4, "", "", "", "", ["C3"], [], ["d"], [])])
    operations = side(spark, [(10, "star", "120W", "", "", [], [], [], []), (11, "", "", "", "", ["C1"], ["S1"], [], []), (12, "", "", "", "", ["C2"], [], [], []), (13, "", "", "", "", ["C3"], [], ["d"], []), (14, "", "", "", "", ["C3"], [], ["d"], [])])
    scored = link.score(payloads, operations)
    assert {(r.payload_id, r.operation_id): r.score for r in scored.collect()} == {(1, 10): 5, (2, 11): 8, (3, 12): 4, (4, 13): 6, (4, 14): 6}
    assert [r.payload_id for r in link.best_link(scored).collect()] == [2]  # 1 and 3 score too little, 4 is tied
    assert {r.payload_id for r in link.best_link(scored, reject_ties=False).collect()} == {2, 4}
    assert link.adopt_by_evidence(payloads, operations).count() == 3


def random_side(spark, rng, n, start):
    some = lambda kind, k, most: [f"{kind}{rng.randrange(k)}" for _ in range(rng.randrange(most + 1))]
    voyage = lambda: rng.choice(["", None, "V" * 22 + str(rng.randrange(1000))] + [rng.choice(["", "V", "0"]) + str(rng.randrange(10 ** rng.randrange(1, 7))) + rng.choice("WO") for _ in range(5)])
    return side(spark, [(start + i, rng.choice(["", "Star", "sun"]), voyage(), rng.choice(["", "A", "AB", None]), rng.choice(["", "B"]), some("C", 4, 3), some("S", 9, 2) or None, some("d", 5, 2), some("R", 3, 1)) for i in range(n)])


def test_best_by_evidence(spark, monkeypatch):
    """The same links as by scoring every pair, with lists of one cell and of many."""
    for seed, cell in ((1, link.CELL), (2, 7)):
        rng = random.Random(seed)
        monkeypatch.setattr(link, "CELL", cell)
        payloads, operations = random_side(spark, rng, 150, 0), random_side(spark, rng, 200, 1000)
        scored = link.score(payloads, operations).cache()
        for reject in (True, False):
            want, got = (sorted(map(tuple, df.select("payload_id", "operation_id", "score", "reasons", "strong", "ties").collect())) for df in (link.best_link(scored, reject_ties=reject), link.best_by_evidence(payloads, operations, reject_ties=reject)))
            assert want == got and len(got) > 20


def test_evidence_link_meets_all_orders_of_a_day(spark):
    """Every order of a day is a candidate, whatever its customer."""
    from brinewood.plans import catalog

    folder = "/root/testdata/sf0.001"
    orders = spark.read.parquet(f"{folder}/orders.parquet").collect()
    by_day = {}
    for r in orders:
        if r.o_orderstatus == "F":
            by_day.setdefault(r.o_orderdate.date(), []).append(r)
    want = {(r.o_orderkey, met[0].o_orderkey) for r in orders if r.o_orderstatus == "P" and len(met := by_day.get(r.o_orderdate.date(), [])) == 1}
    got = {(r.payload_id, r.operation_id) for r in catalog.evidence_link(spark, folder).collect()}
    assert want and want <= got


def test_scoped_find(spark):
    q = spark.createDataFrame([(1, "N", 7), (2, "N", 8), (3, "Z", 7)], "q int, number string, master_id int")
    ops = spark.createDataFrame([(100, "N", 7), (101, "N", None), (102, "N", 9)], "id int, number string, parent_id int")
    assert rows(link.scoped_find(q, ops), "q") == [(1, 100), (2, 101), (3, None)]


def test_rollups(spark):
    parents = spark.createDataFrame([(1, 9.0), (2, 9.0), (3, 9.0)], "p int, kg double")
    children = spark.createDataFrame([(1, 1.0), (1, 2.0), (2, 5.0), (1, 600000.0)], "p int, kg double")
    totals = rollup.child_totals(children, "p", ["kg"], {"kg": "weight"})
    out = rollup.overwrite_totals(parents, totals, "p", ["kg"])
    assert rows(out.select("p", "kg", "n_children", "kg_difference"), "p") == [(1, 3.0, 3, 6.0), (2, 9.0, 1, None), (3, 9.0, 0, None)]
    cells = spark.createDataFrame([("d", "s", 1, "Total debit", 5.0), ("d", "s", 9, "TOTAL DEBIT (final)", 7.0), ("d", "s", 3, "other", 1.0)], "doc string, sheet string, row int, label string, value double")
    assert rollup.labelled_totals(cells, {"debit": "total debit"}).first().debit == 7.0


def test_diff_and_prune(spark):
    df = spark.createDataFrame([(1, ("x", [("q", 1)]), ["a", "b"], {"m": "v"})], "id int, s struct<n:string,l:array<struct<k:string,v:int>>>, t array<string>, m map<string,string>")
    assert {(r.path, r.value) for r in diff.flatten(df, "id").collect()} == {("s.n", "x"), ("s.l[0].k", "q"), ("s.l[0].v", "1"), ("t[0]", "a"), ("t[1]", "b"), ("m.m", "v")}
    m = spark.createDataFrame([({"a": "1", "_b": "2", "c@x": "3", "d": "", "_keep": "4"},)], "m map<string,string>")
    assert m.select(diff.prune(F.col("m"), ("_keep",)).alias("m")).first().m == {"a": "1", "_keep": "4"}


RECORD = "parent_no string, consignee string, shipper string, origin string, destination string, customs_id string, packages string, gross_kg string, tariff_code string, error string, warnings array<string>, page_text string"


def test_quality_codes(spark):
    good = ("ABCD1234567", "c", "s", "o", "d", None, "5", "10", None, None, [], "")
    cases = {
        (): good,
        ("missing_master_bl",): (None, *good[1:]),
        ("invalid_master_bl",): ("01234567", *good[1:]),
        ("missing_consignee",): (good[0], None, *good[2:]),
        ("consignee_looks_like_agent",): (good[0], "Delivery agent X", *good[2:]),
        ("missing_origin", "missing_destination"): (*good[:3], None, "", *good[5:]),
        ("missing_acid",): (*good[:4], "Port Said", *good[5:]),
        ("packages_ocr_garbled",): (*good[:6], "allets", *good[7:]),
        ("hscode_equals_bl", "record_processing_error", "validator_warning"): (*good[:8], "1234567", "boom", ["w"], ""),
        ("missing_packages", "missing_gross_weight"): (*good[:6], None, None, *good[8:]),
    }
    df = spark.createDataFrame(list(cases.values()), RECORD)
    for r, codes in zip(quality.judge(df, quality.record_issues()).collect(), cases, strict=True):
        assert tuple(i.code for i in r.issues) == codes
        assert r.score == max(0, 100 - sum(quality.RECORD_COST[i.level] for i in r.issues))
        assert r.passed == (r.score >= 60 and all(i.level != "critical" for i in r.issues))


def test_document_report(spark):
    records = spark.createDataFrame([("a", "k", 100, True), ("a", "k", 80, True), ("b", "", 90, True)], "doc string, key string, score int, passed boolean")
    expected = spark.createDataFrame([("a", 2), ("b", 2), ("c", 1)], "doc string, n_expected long")
    out = {r.doc: (r.score, r.passed, [i.code for i in r.issues]) for r in quality.document_report(records, expected).collect()}
    assert out["a"] == (90, True, ["duplicate_keys"])
    assert out["b"] == (84, False, ["under_extraction", "count_mismatch"])
    assert out["c"][1] is False and "no_records" in out["c"][2]
    legacy = {r.doc: [i.code for i in r.issues] for r in quality.document_report(records, expected, legacy_duplicates=True).collect()}
    assert "duplicate_keys" in legacy["b"]


DOC = "--- PAGE 1 ---\nB/L NO: AAAA11111112\n3 PALLETS 10 KGS 1 CBM\n--- PAGE 2 ---\nB/L NO: BBBB22222223\n2,360 KGS 30 CBM\n--- PAGE 3 ---\nB/L NO: AAAA11111112"


def test_pages(spark):
    docs = spark.createDataFrame([("d", DOC), ("e", "no marks")], "doc string, text string")
    paged = pages.split_pages(docs, "doc", "text")
    assert [(r.doc, r.page) for r in paged.orderBy("doc", "page").collect()] == [("d", 1), ("d", 2), ("d", 3), ("e", 1)]
    assert [r.doc for r in pages.multi_record_docs(paged).collect()] == ["d"]
    found = [(r.page, r.number, r.packages, r.gross_kg, r.volume_cbm) for r in pages.page_records(paged).orderBy("page").collect()]
    assert found == [(1, "AAAA11111112", 3, 10, 1), (2, "BBBB22222223", None, 2360, 30)]
    masters, children = pages.consolidated(paged)
    assert masters.first().n_children == 2 and masters.first().gross_kg == 2370


def test_manifests(spark):
    text = "head\nHBL: HB1 \nCNEE: One\n5 PALLETS 10 KGM\nHBL: HB2\nCNEE: Two\nSTC: goods\nHBL: HB1\nCNEE:\nSTC: a longer description\n5 PALLETS 10 KGM 2 CBM"
    docs = spark.createDataFrame([("d", text)], "doc string, text string")
    out = {r.number: r for r in pages.house_blocks(docs, "doc", "text").collect()}
    assert (out["HB1"].consignee, out["HB1"].description, out["HB1"].volume_cbm) == ("One", "a longer description", 2)
    assert (out["HB2"].consignee, out["HB2"].packages) == ("Two", None)
    lines = pages.split_lines(spark.createDataFrame([("m", "1 ABC12345 x\nS/ Ship\nC/ Con\nC/ other\n2 ABC99999\nN/ Note")], "doc string, text string"), "doc", "text")
    assert [(r.number, r.shipper, r.consignee, r.notify) for r in pages.manifest_rows(lines).orderBy("line_no").collect()] == [("ABC12345", "Ship", "Con", None), ("ABC99999", None, None, "Note")]
    party = pages.split_lines(spark.createDataFrame([("p", "SHIPPER\n a\n\nb\nCONSIGNEE\nc")], "doc string, text string"), "doc", "text")
    assert [r.lines for r in pages.until_stop(party, "^SHIPPER", "^CONSIGNEE").collect()] == [["a", "b"]]


def test_registry(spark):
    registry = pages.Registry()
    registry.add("low", lambda d: d.select("doc", F.lit(50).alias("confidence"), F.struct(F.lit("l").alias("v")).alias("record")))
    registry.add("high", lambda d: d.where("doc = 'x'").select("doc", F.lit(90).alias("confidence"), F.struct(F.lit("h").alias("v")).alias("record")))
    registry.add("tied", lambda d: d.where("doc = 'x'").select("doc", F.lit(90).alias("confidence"), F.struct(F.lit("t").alias("v")).alias("record")))
    docs = spark.createDataFrame([("x", ""), ("y", "")], "doc string, text string")
    assert [(r.doc, r.parser) for r in registry.best(docs).orderBy("doc").collect()] == [("x", "high"), ("y", "low")]


def cells_of(spark, table):
    return spark.createDataFrame([("d", "s", i, j, v) for i, r in enumerate(table) for j, v in enumerate(r)], "doc string, sheet string, row int, col int, value string")


def test_grid(spark):
    table = [["Title", "", "", ""], ["HBL No", "Shipper", "Weight", "CBM"], ["H1", "A", "1", "2"], ["", "", "", ""], ["Total", "", "1", "2"], ["HBL No", "Shipper", "Weight", "Marks"], ["H2", "B", "3", "m"]]
    cells = cells_of(spark, table)
    found = grid.records(grid.sections(cells, ["hbl", "shipper", "weight"])).orderBy("row").collect()
    assert [(r.row, r.header_row, r.record["HBLNO"]) for r in found] == [(2, 1, "H1"), (6, 5, "H2")]
    assert [r.w for r in grid.records(grid.sections(cells, ["hbl", "shipper", "weight"]), most=1).select(grid.field(F.col("record"), "Gross", "Weight").alias("w")).collect()] == ["1"]
    kv = cells_of(spark, [["Port:", "", "SHA"], ["x", "", ""], ["BRE", "", ""]])
    assert grid.key_values(kv, "Port").first()["values"] == ["SHA", "x", "BRE"]
    assert grid.value_below(kv, "Port").first()["value"] == "x"
    assert grid.context_lines(cells, 1).first().text == "Title"
    marks = grid.marked_sheets(cells, "title", "total")
    assert [r.row for r in grid.section_range(cells, marks, skip=2).where("col = 0").orderBy("row").collect()] == [2, 3]


def test_rules(spark):
    df = spark.createDataFrame(
        [("PP", None, "cargo by LCL", None, "M", "M", False, 0, 2.0, None, None), ("Collect", "FCL", "x", None, "M", "H", False, 1, 2.0, None, None), (None, None, "x", None, "M", "H", False, 0, 2.0, 7, "p")],
        "freight_term string, load_type string, text string, description string, parent_no string, child_no string, consolidated boolean, n_containers int, teu double, booking_code int, payable_at string",
    )
    once = rules.apply_pack(df, is_child=F.lit(True))
    assert [(r.booking_code, r.payable_at, r.load_type, r.teu) for r in once.collect()] == [(rules.FREEHAND, "Origin", str(rules.LCL), 0), (rules.NOMINATION, "Destination", str(rules.FCL), 2), (7, "p", str(rules.LCL), 0)]
    assert rules.apply_pack(once, is_child=F.lit(True)).collect() == once.collect()
    with rules.use_rules(False):
        assert rules.apply_pack(df, is_child=F.lit(True)) is df
    r = spark.createDataFrame([("Shanghai", "Alexandria"), ("Alexandria", "Oslo"), ("a", "b")], "o string, d string")
    assert [x.v for x in r.select(rules.direction(F.col("o"), F.col("d"), ("ALEXANDRIA",)).alias("v")).collect()] == [rules.IMPORT, rules.EXPORT, None]
    votes = spark.createDataFrame([(None, "telex release", None, False), (None, "telex release THREE (3) ORIGINAL", "3", False), ("express", "", "3", False), (None, "", "0", True), (None, "", None, False)], "s string, t string, o string, f boolean")
    got = [x.v for x in votes.select(rules.release_status(F.col("s"), F.col("t"), F.col("o"), F.col("f")).alias("v")).collect()]
    assert got == [rules.TELEX, rules.ORIGINAL, rules.TELEX, rules.TELEX, None]


def test_shape(spark):
    df = spark.createDataFrame([(1, "ACME LTD\n Street 1\nTel: 5\nmore", "")], "id int, party string, term string")
    out = shape.to_template(df, {"id": "bigint", "term": "string", "missing": "double"}, {"term": "x"}).first()
    assert tuple(out) == (1, "x", None)
    name, address = shape.party(F.col("party"))
    assert tuple(df.select(name, address).first()) == ("ACME LTD", "Street 1")
    masters = spark.createDataFrame([(1,), (2,)], "m int")
    kids = spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "m int, n int, v string")
    nested = shape.nest(masters, kids, "m", "kids", "n").orderBy("m").collect()
    assert [[(k.n, k.v) for k in r.kids] for r in nested] == [[(1, "a"), (2, "b")], []]
    cast = shape.by_catalog(spark.createDataFrame([("1.5", "bad", "x", "keep")], "a string, b string, c string, d string"), [("a", "Decimal", True), ("b", "Integer", True), ("c", "String", False)]).first()
    assert (float(cast.a), cast.b, cast.d) == (1.5, None, "keep") and "c" not in cast.asDict()
    assert spark.createDataFrame([('{"data": {"a": 1}}',), ('{"value": [{"b": 2}]}',), ('{"c": 3}',)], "p string").select(shape.unwrap(F.col("p")).alias("u")).collect()[1].u == '{"b":2}'
    body = shape.response(spark.createDataFrame([(1, "x" * 9000)], "id int, raw string"), "id", "raw").first()
    assert len(body.preview) == 5000 and not body.truncated


def test_sources(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_bytes("\ufeffx,y\n,\n1,\"two\nlines\"\n".encode())
    cells = readers.delimited_cells(spark, str(tmp_path / "in" / "a.csv"))
    assert [(r.row, r.col, r.value) for r in cells.orderBy("row", "col").collect()] == [(0, 0, "x"), (0, 1, "y"), (1, 0, "1"), (1, 1, "two lines")]
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    with zipfile.ZipFile(tmp_path / "in" / "b.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S1" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>head</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="AB1"><v>3.0</v></c></row><row r="5"><c r="B5" t="inlineStr"><is><t>in</t></is></c></row></sheetData></worksheet>')
    book = readers.workbook_cells(spark, str(tmp_path / "in" / "b.xlsx"))
    assert [(r.sheet, r.row, r.col, r.value) for r in book.orderBy("row", "col").collect()] == [("S1", 0, 0, "head"), ("S1", 0, 27, "3"), ("S1", 4, 1, "in")]
    assert readers.workbook_cells(spark, str(tmp_path / "in" / "b.xlsx"), most_rows=1, most_cols=5).count() == 1
    (tmp_path / "in" / "c.bin").write_bytes(b"x")
    assert {r.kind for r in readers.route_files(spark, str(tmp_path / "in")).collect()} == {".csv", ".xlsx", "unsupported"}
    (tmp_path / "meta.ts").write_text('export const x = { name: { attributeType: "String" }, total: { attributeType: "Decimal", isValidForUpdate: false } }')
    assert [(r.name, r.kind, r.writable) for r in readers.catalog_fields(spark, str(tmp_path / "meta.ts")).orderBy("name").collect()] == [("name", "String", True), ("total", "Decimal", False)]


def test_visual_lines_and_hybrid(spark):
    words = spark.createDataFrame([("d", 1, 0.0, 10.0, 100.0, "ab"), ("d", 1, 12.0, 22.0, 101.0, "cd"), ("d", 1, 90.0, 99.0, 100.5, "ef"), ("d", 1, 0.0, 9.0, 120.0, "gh")], "doc string, page int, x0 double, x1 double, y double, text string")
    assert [r.text for r in readers.visual_lines(words).orderBy("line_no").collect()] == ["ab cd    ef", "gh"]
    native = spark.createDataFrame([("a", "full", "native"), ("b", "part", "native_sparse"), ("c", "", "native_sparse")], "doc string, text string, method string")
    scans = spark.createDataFrame([("a", "s", 9.0, 1), ("b", "low", 1.0, 1), ("b", "high", 2.0, 1), ("c", "only", 1.0, 1)], "doc string, text string, confidence double, words int")
    assert [(r.doc, r.text, r.method) for r in readers.hybrid_text(native, scans).orderBy("doc").collect()] == [("a", "full", "native"), ("b", "part\nhigh", "hybrid"), ("c", "only", "ocr")]


def test_upsert_takes_null_keys_and_repeated_changes(spark):
    kind = "a int, b string, v string, w int"
    current = spark.createDataFrame([(1, None, "old", 5), (None, "x", "n", 6), (2, "y", "keep", 7)], kind)
    changes = spark.createDataFrame([(1, None, "new", None), (None, "x", "m", 8), (3, None, "add", None), (3, None, "add", None)], kind)
    once = upsert = dedup.upsert(current, changes, ["a", "b"])
    for _ in range(2):
        assert sorted(map(tuple, once.collect()), key=str) == sorted([(1, None, "new", 5), (None, "x", "m", 8), (2, "y", "keep", 7), (3, None, "add", None)], key=str)
        once = dedup.upsert(upsert, changes, ["a", "b"])


def test_keep_first_of_hot_and_missing_keys(spark):
    df = spark.createDataFrame([("k", 2, "b"), ("k", 1, "a"), (None, 3, "c"), (None, 4, "d"), ("z", None, "n"), ("z", 0, "y")], "key string, at int, v string")
    kept = lambda how: sorted(r.v for r in dedup.keep_first(df, F.col("key"), [F.col("at")], keyless=how).collect())
    assert (kept("keep"), kept("drop"), kept("one")) == (["a", "c", "d", "n"], ["a", "n"], ["a", "c", "n"])


def test_load_types_and_release_votes(spark):
    texts = [("HBL list", None, None, None, 0), ("FOLLCLX", None, None, None, 2), ("CY/CFS", "300000000", None, None, 2), ("CY/CY", None, None, None, 0), ("none", "300000001", None, None, 2), ("xCFSx", None, "A", "B", 0), ("", None, None, None, 1)]
    df = spark.createDataFrame(texts, "text string, existing string, p string, c string, n int")
    signal = rules.lcl_signal(F.col("text"), F.lit("native"), F.lit(False), F.col("p"), F.col("c"))
    load = rules.load_type_by_evidence(F.col("existing"), F.col("text"), signal, F.col("n"))
    assert [r[0] for r in df.select(load).collect()] == [rules.LCL, rules.FCL, rules.LCL, rules.FCL, rules.LCL, rules.LCL, rules.FCL]
    votes = spark.createDataFrame([("NON-NEGOTIABLE SEA WAY BILL", "3"), ("SEA WAY BILL", "3"), ("DESTINATION O/EXPRESS", "1"), ("WITHOUT PRESENTATION OF ORIGINAL", None)], "text string, n string")
    status = rules.release_status(F.lit(None).cast("string"), F.col("text"), F.col("n"), F.lit(False))
    assert [r[0] for r in votes.select(status).collect()] == [rules.TELEX, rules.ORIGINAL, rules.TELEX, rules.ORIGINAL]


def test_sinks(spark, tmp_path):
    current = {"op": spark.createDataFrame([(1, "a")], "id int, s string")}
    changes = {"op": spark.createDataFrame([(2, "b")], "id int, s string"), "cargo": spark.createDataFrame([(7, 1)], "id int, op int")}
    for _ in range(2):
        sinks.write_graph(current, changes, {"op": ["id"], "cargo": ["id"]}, str(tmp_path))
        assert sinks.read_graph(spark, str(tmp_path), "op").count() == 2
        current = {n: sinks.read_graph(spark, str(tmp_path), n) for n in changes}  # the next run reads what this one wrote
    rec = spark.createDataFrame([(1, {"b": "1", "z": "2"}), (2, {"a": "3"})], "k int, m map<string,string>")
    assert sinks.wide_csv(rec, "k", "m", ["z"], str(tmp_path / "csv")) == ["k", "z", "a", "b"]
    h, c = spark.createDataFrame([(1, 10), (1, 11)], "m int, house_id int"), spark.createDataFrame([(1, 5)], "m int, container_id int")
    assert sinks.bridge(h, c, "m").count() == 2
    expected = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0), ("d", 4.0)], "child string, kg double")
    existing = spark.createDataFrame([("b", 2.005, False), ("c", 9.0, False), ("d", 9.0, True)], "child string, kg double, tagged boolean")
    assert [r.action for r in sinks.invoice_cargo(expected, existing, ["kg"]).orderBy("child").collect()] == ["insert", "update", "conflict", "update"]
    lines = spark.createDataFrame([("i", "c1", "m1", "Ocean freight", 10.0, 2.0), ("i", "c9", "m1", "Handling fee", 5.0, None), ("i", "c9", "m9", "zz", 1.0, 1.0)], "invoice string, child string, master string, term string, unit_price double, rate double")
    ops = spark.createDataFrame([(1, "c1"), (2, "m1")], "id int, number string")
    terms = spark.createDataFrame([(7, "Ocean Freight"), (8, "handling")], "term_id int, label string")
    done = spark.createDataFrame([(1, "i", 7)], "operation_id int, invoice string, term_id int")
    out = {r.term: (r.operation_id, r.term_id, r.base_price, r.status) for r in sinks.post_lines(lines, ops, done, terms).collect()}
    assert out == {"Ocean freight": (1, 7, 5.0, "update"), "Handling fee": (2, 8, 5.0, "insert"), "zz": (None, None, 1.0, "no_operation")}


def test_audit_stream_pushes_each_event_once(spark, tmp_path):
    files = spark.createDataFrame([("u1", "f1", None), ("u2", "f2", "boom")], "audit_id string, file_name string, error string")
    begun, ended = audit.started(files, F.lit("t1")), audit.finished(files, F.lit("t2"))
    begun.write.parquet(f"{tmp_path}/log")
    seen = []
    push = lambda df, n: seen.extend(r.audit_id + r.status for r in df.collect())
    for batch in (None, ended):
        if batch is not None:
            batch.write.mode("append").parquet(f"{tmp_path}/log")
        audit.watch(spark, f"{tmp_path}/log", begun.schema, push, f"{tmp_path}/cp").awaitTermination()
    assert sorted(seen) == ["u1processing", "u1success", "u2failed", "u2processing"]
    assert {r.audit_id: r.status for r in audit.latest_state(spark.read.parquet(f"{tmp_path}/log"), "audit_id", ["at"]).collect()} == {"u1": "success", "u2": "failed"}


def test_watermarked_windows(spark, tmp_path):
    events = spark.sql("select timestamp'2024-01-01 00:10:00' ts, 'a' k, 1.0D value union all select timestamp'2024-01-01 00:20:00', 'a', 2.0D union all select timestamp'2024-01-01 02:00:00', 'a', 4.0D")
    events.write.parquet(f"{tmp_path}/e")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/e")
    q = windows.tumbling(stream, "ts", "1 hour", ["k"], late="10 minutes").writeStream.format("memory").queryName("tumbled").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.n, r.total) for r in spark.table("tumbled").collect()] == [(2, 3.0)]
    assert sorted(r.n for r in windows.sessions(events, "ts", "30 minutes", "k").collect()) == [1, 2]
