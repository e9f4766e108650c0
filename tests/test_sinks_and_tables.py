"""Dictionaries, ladders, graphs, grids, lists and schemaless differences on rows of their own."""

import pytest
from pyspark.sql import functions as F

from brinewood.operators import dictionary, diff, graph, payload, posting, rollup, tables
from brinewood.sources import sinks


def test_longest_names_win_from_the_left(spark):
    docs = spark.createDataFrame([(1, "to PORT SAID west-side, Port\nSaid. port said"), (2, None), (3, ""), (4, "new york new jersey")], "doc long, text string")
    names = spark.createDataFrame([("Port Said", 1), ("port said WEST", 2), ("Said", 3), ("PORT-SAID", 9), ("york new", 4), ("New York", 5), ("new jersey", 6), ("...", 7), (None, 8)], "name string, n int")
    got = sorted((r.id, r.line_no, r.at, r.n, r.phrase, r.entry.n) for r in dictionary.annotate(docs, names).collect())
    assert got == [(1, 0, 1, 3, "PORT SAID WEST", 2), (1, 1, 6, 1, "SAID", 3), (1, 1, 7, 2, "PORT SAID", 9), (4, 0, 0, 2, "NEW YORK", 5), (4, 0, 2, 2, "NEW JERSEY", 6)]
    assert dictionary.annotate(docs, names.where("n < 0")).count() == 0


def test_routes_by_labels_lines_and_loose(spark):
    head = "VESSEL PORT OF LOADING PORT OF DISCHARGE\n"
    texts = ["POL: Oslo POD: Rome", head + "STAR Oslo Rome Paris", head + "Oslo\nRome", "Oslo Rome", head + "STAR Oslo, in Rome", None, head + "a\nb\nc\nSTAR Oslo Rome"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc int, text string")
    ports = spark.createDataFrame([("Oslo",), ("Rome",), ("Paris",)], "name string")
    name = lambda x: x and x.name
    got = {r.id: (name(r.origin), name(r.destination), name(r.delivery), r.vessel) for r in dictionary.routes(docs, ports).collect()}
    assert got[0] == ("Oslo", "Rome", "Rome", None) and got[1] == ("Oslo", "Rome", "Paris", "STAR") and got[2] == ("Oslo", "Rome", "Rome", None)
    assert got[6] == ("Oslo", "Rome", "Rome", None) and got[3][:2] == (None, None) and got[4][:2] == (None, None) and 5 not in got


def test_no_line_is_matched_twice(spark):
    kind = "id int, k string, source_key string, comments string, quantity double, unit_price double, day int"
    new = spark.createDataFrame([(1, "a", "Invoice line 7", None, 1.0, 2.0, 0), (2, "a", "Invoice line 7", None, 1.0, 2.0, 0), (3, "a", None, None, 1.0, 2.0, 0), (4, "a", None, None, 5.0, 2.0004, 0), (5, None, None, None, 1.0, 1.0, 0)], kind)
    old = spark.createDataFrame([(10, "a", None, None, 9.0, 9.0, 5), (11, "a", None, "Invoice line 7 x", 1.0, 2.0, 3), (12, "a", None, "Invoice line 8", 5.0, 2.0, 1), (13, "a", None, "Invoice line 9", 5.0, 2.0, 2), (14, None, None, None, 1.0, 1.0, 0)], kind)
    got = {r.id: (r.old, r.rule) for r in posting.match_lines(new, old.withColumnRenamed("id", "old"), ["k"], posting.posting_rules(), new_id="id", old_id="old", oldest=["day"]).collect()}
    assert got == {1: (11, "source_key"), 2: (10, "unkeyed"), 4: (12, "rounded")}


LEVELS = [graph.Level("m", ["a"], None, (), ["s"], ["l"]), graph.Level("h", ["a", "b"], "m", ["a"], ["q"])]


def test_graph_finds_creates_and_keeps(spark):
    m = spark.createDataFrame([("1", "x", None), ("2", "y", "L"), ("2", "y", None), (None, "z", None)], "a string, s string, l string")
    h = spark.createDataFrame([("1", "p", 1), ("2", "p", 2), ("9", "p", 3), ("1", None, 4)], "a string, b string, q int")
    stored = {"m": spark.createDataFrame([("own", None, "1", "old", "KEPT"), ("gone", None, "3", "s", None)], "id string, parent_id string, a string, s string, l string")}
    out = graph.resolve(LEVELS, {"m": m, "h": h}, stored)
    got = {r.a: (r.id, r.s, r.l, r.action) for r in out["m"].collect()}
    assert got["1"] == ("own", "x", "KEPT", "updated") and got["3"] == ("gone", "s", None, "kept") and got["2"][1:] == ("y", "L", "created") and len(got) == 3
    houses = {(r.a, r.b): r for r in out["h"].collect()}
    assert set(houses) == {("1", "p"), ("2", "p")} and houses["1", "p"].parent_id == "own" and houses["2", "p"].parent_id == got["2"][0]
    assert sorted(r.q for r in graph.orphans(LEVELS, "h", h, out).collect()) == [3, 4]
    again = graph.resolve(LEVELS, {"m": m, "h": h}, {k: v.drop("action") for k, v in out.items()})
    assert {r.action for e in again.values() for r in e.collect()} == {"same", "kept"}


def test_load_order_reports_cycles_and_rules_writes(spark, tmp_path):
    e = spark.createDataFrame([(x,) for x in "abcdef"], "entity string")
    r = spark.createDataFrame([("b", "a"), ("c", "b"), ("c", "a"), ("d", "e"), ("e", "d"), ("f", "e"), ("a", "a"), ("a", "zz")], "child string, parent string")
    assert {x.entity: (x.level, x.cyclic) for x in graph.load_order(e, r).collect()} == {"a": (0, False), "b": (1, False), "c": (2, False), "d": (None, True), "e": (None, True), "f": (None, True)}
    one = spark.createDataFrame([(1, 2)], "k int, v int")
    out = sinks.write_graph({}, {"child": one, "parent": one}, {}, str(tmp_path), spark.createDataFrame([("child", "parent")], "child string, parent string"))
    assert list(out) == ["parent", "child"]
    with pytest.raises(ValueError, match="cycle"):
        sinks.write_graph({}, {"d": one, "e": one}, {}, str(tmp_path), r)


def test_writes_mend_themselves(spark):
    rows = spark.createDataFrame([(1, "abcdef", "7", "x"), (2, None, "seven", None), (3, "abc", "123456", "y")], "id int, t string, n string, r string")
    got = {r.id: r for r in graph.self_repair(rows, "id", {"t": ("string", 3, False), "n": ("int", 5, False), "r": ("string", None, True)}).collect()}
    assert got[1].written == {"t": "abc", "n": "7", "r": "x"} and [(x.field, x.step, x.was) for x in got[1].repaired] == [("t", "cut", "abcdef")] and got[1].accepted
    assert got[2].written == {} and [(x.field, x.value) for x in got[2].rejects] == [("n", "seven")] and not got[2].accepted
    assert [(x.field, x.step) for x in got[3].repaired] == [("n", "dropped")] and got[3].accepted


def test_leaves_of_any_json(spark):
    rows = [(1, '{"a":{"b":[1,{"c":null}],"e":{}},"x y":"t\\"{","f":[]}'), (2, "[1,[[2]]]"), (3, "bad {"), (4, '"5"'), (5, None), (6, '{"a":1.50}')]
    got = sorted((r.k, r.path, r.value) for r in diff.json_leaves(spark.createDataFrame(rows, "k int, j string"), "k", "j").collect() if r.value is not None)
    assert got == [(1, "a.b[0]", "1"), (1, "a.e", "{}"), (1, "f", "[]"), (1, "x y", 't"{'), (2, "[0]", "1"), (2, "[1][0][0]", "2"), (4, "", "5"), (6, "a", "1.5")]
    with pytest.raises(ValueError, match="depth"):
        diff.json_leaves(spark.createDataFrame([(1, "[" * 5 + "]" * 5)], "k int, j string"), "k", "j", most=4)


def test_missing_cells_move_no_other(spark):
    words = [("A1111", 100.0, 150.0, 10.0), ("A2222", 200.0, 250.0, 11.0), ("A3333", 300.0, 350.0, 10.0), ("7", 240.0, 270.0, 30.0), ("8", 320.0, 330.0, 31.0), ("Total", 1.0, 40.0, 30.5), ("9", 500.0, 510.0, 30.0), ("above", 1.0, 9.0, 1.0)]
    df = spark.createDataFrame([(1, 1, *w) for w in words], "doc int, page int, word string, x0 double, x1 double, y double")
    assert sorted((r.label, r.number, r.value) for r in tables.visual_grid(df, "A[0-9]{4}").collect()) == [("Total", "A2222", "7"), ("Total", "A3333", "8")]
    assert tables.visual_grid(df.where("x0 > 250"), "A[0-9]{4}").count() == 0


def test_charges_and_lists(spark):
    text = "HBL/CNT .. DEBIT\nup one\nABC12345 1 2 mid BL 1 2 USD 3 0\ndown\nABC12345 1 2 mid BL 1 2 USD 3 0\n[x]\nnext up\nABC99999 1 2 BL 1 2 EUR 4 0\nTOTAL: 7\nABC12345 1 2 out BL 1 2 USD 3 0"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc int, text string")
    assert sorted((r.doc, r.number, r.description, r.debit) for r in tables.charge_ledger(docs).collect()) == [(1, "ABC12345", "MID", 3.0), (1, "ABC12345", "UP ONE MID DOWN", 3.0), (1, "ABC99999", "NEXT UP", 4.0)]
    pages = "--- PAGE 1 ---\nS/ none\n1 PALLETS\n--- PAGE 2 ---\nS/ One\n2 boxes of x\n--- PAGE 3 ---\nAttached list\nGW: 1,000.5 - KGS\nS/ Two\nnothing\nS/ Three\n3 CARTONS\nTOTAL : 5\n9 PALLETS"
    rows = tables.attached_cargo(spark.createDataFrame([(1, pages), (2, None)], "doc int, text string"))
    assert sorted((r.shipper, r.packages, r.unit, r.gross_kg, r.first_page, r.last_page) for r in rows.collect()) == [("One", 2, "BOXES", 1000.5, 2, 3), ("Three", 3, "CARTONS", None, 3, 3)]
    houses = spark.createDataFrame([(1, 1, 2.0), (1, 2, 4.0)], "doc int, house_no int, packages double")
    got = {r.shipper: (r.house_no, r.agrees) for r in tables.by_running_total(rows, houses).collect()}
    assert got == {"One": (1, True), "Three": (2, False)}
    assert rows.where(F.col("doc") == 2).count() == 0


def test_payload_fields_and_hard_cases(spark):
    rows = spark.createDataFrame([(1, {"a": "One", "b": "x", "A@odata.bind": None, "c": "2,5", "d": "31/02/2025", "t": "abcdef", "@x": "1", "z": ""}), (2, None), (3, {}), (4, {"old": "7", "c": "9", "a": "Two", "Z@odata.bind": "/z(1)", "z": "q", "o": "9"})], "id int, fields map<string,string>")
    catalog = spark.createDataFrame([("a", None, "lookup", "t", "A", None, True), ("c", ["old"], "decimal", None, None, None, True), ("d", None, "date", None, None, None, True), ("t", None, "text", None, None, 3, True), ("b", None, "text", None, None, None, False), ("o", None, "option", None, None, None, True)], "field string, aliases array<string>, kind string, target string, bind_as string, most int, writable boolean")
    labels = spark.createDataFrame([("t", 5, "one"), ("t", 6, "two"), ("t", 7, "TWO")], "target string, id int, label string")
    options = spark.createDataFrame([("o", "nine", 9)], "field string, label string, code int")
    out = payload.prepare(rows, catalog, labels, options)
    assert {(r.id, r.raw): (r.key, r.value, r.outcome) for r in out.collect()} == {
        (1, "a"): ("A@odata.bind", "/t(5)", "bound_to"), (1, "b"): (None, None, "read_only"), (1, "c"): ("c", "2.5", "sent"), (1, "d"): (None, None, "no_date"), (1, "t"): ("t", "abc", "cut"), (1, "@x"): (None, None, "not_sent"), (1, "z"): ("z", "", "sent"),
        (4, "old"): (None, None, "repeated"), (4, "c"): ("c", "9", "sent"), (4, "a"): (None, None, "ambiguous"), (4, "Z@odata.bind"): ("Z@odata.bind", "/z(1)", "sent"), (4, "z"): (None, None, "bound"), (4, "o"): ("o", "9", "sent"),
    }
    assert {r.id: r.fields for r in payload.payload_maps(out).collect()}[4] == {"c": "9", "Z@odata.bind": "/z(1)", "o": "9"}


def test_containers_stand_in_for_a_lone_record(spark):
    kind = "d string, p double, containers array<struct<number:string,packages:double>>"
    rows = spark.createDataFrame([("one", None, [("a-1", None), ("A1", 4.0)]), ("two", None, [("b1", 9.0)]), ("two", 2.0, [("b1", 9.0), (None, 1.0)]), ("none", None, None)], kind)
    got = {r.d: (r.p, r.teu, r.n_records) for r in rollup.record_totals(rows, "d", {"p": "packages"}).collect()}
    assert got == {"one": (4.0, 1, 1), "two": (2.0, 1, 2), "none": (None, None, 1)}
