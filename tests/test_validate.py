"""The record validator on records of each role, and what it leaves alone."""

from brinewood.operators import validate

OPTIONS = {"ports": ["Shanghai", "Port Said", "Alexandria"], "home": ("PORT SAID", "ALEXANDRIA"), "noise": ("as agreed",)}
TEXT = """B/L NO: ABCDE123456
CONSIGNEE
To the order of a bank
NOTIFY PARTY
Delta Imports
9 Canal Road
VESSEL: SEA STAR  VOYAGE NO: 12W
PORT OF LOADING: Shanghai  PORT OF DISCHARGE: Port Said
ACID NO: 1234567890123456789
HS CODE: 392410
UN NO: 1993 CLASS 3
MSCU1234567 SEAL: SL12345 40HC
12 PALLETS GROSS WEIGHT: 1,250.50 KGS
FREIGHT COLLECT
TELEX RELEASE
PLACE OF DELIVERY: cairo  cairo
"""
ROWS = [
    # doc, role, method, text, parent_no, child_no, consignee_addr, vessel, voyage, notes, packages
    ("plain", "plain", "native", TEXT, "FORM 7654321", "ABCD-123 4567", "5 Bank Street, Tel: 1", "ZERO", "OLD1", "one\nAs Agreed\none", None),
    ("debit", "plain", "debit_note_direct", TEXT, None, None, None, None, "OLD1", None, None),
    ("draft", "draft", "native", TEXT + "IST123456789\n", "OWN1234", "OWN1234", None, None, "OLD1", None, "7"),
    ("house", "manifest_house", "native", TEXT, "P12345", "C12345", None, None, "OLD1", None, "3 ROLLS"),
    ("page", "plain", "native", TEXT + "IST123456789\n", None, None, None, None, None, None, "5 CARTONS"),
    ("form", "plain", "native", "FORM NO: 7654321 AND NOTHING ELSE", "7654321", None, None, None, None, None, None),
    ("null", None, None, None, None, None, None, None, None, None, None),
]
KIND = "doc string, role string, method string, text string, parent_no string, child_no string, consignee_addr string, vessel string, voyage string, notes string, packages string"


def test_roles_and_rules(spark):
    rows = spark.createDataFrame([(*r, i) for i, r in enumerate(ROWS)], f"{KIND}, `extra col` int")
    out = validate.validate(rows, **OPTIONS)
    assert out.columns == [*validate.RECORD, "extra col"]
    got = {r["doc"]: r for r in out.collect()}
    assert [got[r[0]]["extra col"] for r in ROWS] == list(range(len(ROWS)))

    p = got["plain"]
    assert (p.parent_no, p.child_no, p.vessel, p.voyage, p.notes) == ("FORM 7654321", "ABCD-123 4567", "SEA STAR", "12W", "one")
    assert (p.consignee, p.consignee_addr, p.notify, p.delivery) == ("To the order of a bank", None, "Delta Imports", "CAIRO")
    assert (p.customs_id, p.tariff_code, p.gross_kg, p.un_number, p.hazard_class) == ("1234567890123456789", "392410", "1250.5", "1993", "3")
    assert (p.container_no, p.seal_no, p.telex, p.release_status, p.direction, p.freight_term) == ("MSCU1234567", "SL12345", True, "886150001", 300000000, "COLLECT")
    assert "vessel dropped: no name" in p.warnings and not any("voyage" in w or "freight" in w for w in p.warnings)

    d = got["debit"]  # not enriched: only the steps before and after fill it, and they say so
    assert (d.voyage, d.notify, d.vessel) == ("OLD1", None, "SEA STAR") and "vessel filled from the text" in d.warnings
    assert (got["draft"].parent_no, got["draft"].child_no, got["draft"].customs_id, got["draft"].voyage) == ("OWN1234", None, None, "OLD1")
    assert (got["house"].packages, got["house"].voyage, got["house"].customs_id) == ("3 ROLLS", "OLD1", None)
    assert (got["page"].parent_no, got["page"].booking_no, got["page"].packages) == ("IST123456789", "IST123456789", "5 CARTON")
    assert got["form"].parent_no is None and got["form"].warnings == ["parent_no dropped: a form's or register's number"]
    assert got["null"].warnings == [] and got["null"].transport == validate.SEA


def test_twice_is_once_and_pages_win(spark):
    rows = spark.createDataFrame(ROWS, KIND)
    first = {r["doc"]: r for r in validate.validate(rows, **OPTIONS).collect()}
    again = {r["doc"]: r for r in validate.validate(validate.validate(rows, **OPTIONS), **OPTIONS).collect()}
    assert first == again
    paged = rows.selectExpr("*", "1 AS page")
    pages = spark.createDataFrame([("page", 1, "ANCHORED")], "doc string, page int, destination string")
    won = {r["doc"]: r for r in validate.validate_by_page(paged, pages, ["destination"], **OPTIONS).collect()}
    assert won["page"].destination == "ANCHORED" and won["plain"].destination == "PORT SAID"
    assert won["page"].warnings == first["page"].warnings


def test_empty_table(spark):
    assert validate.validate(spark.createDataFrame([], KIND), **OPTIONS).count() == 0
