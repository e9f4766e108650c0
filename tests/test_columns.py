"""String, number, date, identifier and field columns on literal rows."""

import pytest
from pyspark.sql import functions as F

from brinewood.functions import dates, fields, ids, numbers, text


def values(spark, column, rows, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r.y for r in df.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


def test_cleaning(spark):
    assert values(spark, text.normalize_text, ["  a \t b \n\n\n\n\n c\f", None, ""]) == ["a b\n\n\nc", None, ""]
    assert values(spark, text.clean_value, [" ,a  b;- ", ";;", None]) == ["a b", None, None]
    assert values(spark, text.digits, ["a1 2-3", "x", None]) == ["123", None, None]
    assert values(spark, text.alnum_upper, ["a-b ß1", ""]) == ["AB1", ""]
    assert values(spark, text.match_text, [" a--b  c "]) == ["A B C"]
    assert values(spark, text.safe_name, ["C:\\x\\a b?.pdf", "/", "ok.csv"]) == ["a_b_.pdf", "upload", "ok.csv"]


@pytest.mark.parametrize("n", [59, 60, 61])
def test_truncate_at_the_boundary(spark, n):
    x = "a" * n + ". " + "b" * 200
    cut = values(spark, lambda c: text.smart_truncate(c, 100), [x])[0]
    assert cut == ("a" * n if n >= 60 else x[:100])
    strict = values(spark, lambda c: text.truncate_strict(c, 100), [x])[0]
    assert strict == ("a" * n if n > 60 else x[:100])


def test_caps_are_idempotent(spark):
    rows = ["line one\nline two, and more; " * 9, "short", None]
    once = values(spark, lambda c: text.smart_truncate(c, 50), rows)
    assert values(spark, lambda c: text.smart_truncate(c, 50), once) == once


def test_spill(spark):
    df = spark.createDataFrame([("x" * 30, "n"), ("short", None), ("y" * 30, "has " + "y" * 30)], "h string, notes string")
    capped, notes = text.spill(F.col("h"), F.col("notes"), 20, 100)
    rows = df.select(capped.alias("h"), notes.alias("notes")).collect()
    assert [tuple(r) for r in rows] == [("x" * 20, "n\n" + "x" * 30), ("short", None), ("y" * 20, "has " + "y" * 30)]


def test_prefix_incoterm_country(spark):
    once = values(spark, text.with_prefix, ["goods", "S.T.C goods", "s.t.c: goods", " ", None])
    assert once == ["S.T.C\ngoods"] * 3 + [None, None]
    assert values(spark, text.with_prefix, once) == once
    assert values(spark, text.incoterm, ["cif alexandria", "as agreed", ""]) == ["CIF", "as agreed", None]
    assert values(spark, text.country, ["Cairo, Egypt", "Pune, IN", "Izmir, TR", "Oslo", None]) == ["Egypt", "India", "Turkey", None, None]


def test_cells(spark):
    assert values(spark, text.cell_text, ["3.0", "3.50", " a \n b ", "x" * 600]) == ["3", "3.50", "a b", "x" * 500 + "..."]
    assert values(spark, text.column_index, ["A1", "Z9", "AA10", "BC12"]) == [1, 26, 27, 55]
    assert values(spark, text.column_name, [1, 26, 27, 55, 703], "int") == ["A", "Z", "AA", "BC", "AAA"]


def test_unions_and_merges(spark):
    assert values(spark, lambda c: text.union_codes(c, F.lit("12,34")), ["56|12", None]) == ["56|12|34", "12|34"]
    assert values(spark, lambda c: text.merge_notes(c, F.lit("beta gamma\nx")), ["Alpha Beta Gamma\nzz"]) == ["Alpha Beta Gamma\nzz\nx"]
    assert values(spark, lambda c: text.merge_descriptions(c, F.lit("b a")), ["a b c", "z", None]) == ["a b c", "z\nb a", "b a"]
    assert values(spark, lambda c: text.longer(c, F.lit("abc")), ["xyz", "ab", None]) == ["xyz", "abc", "abc"]


def test_chunks(spark):
    df = spark.createDataFrame([(["aa", "bb", "cccccccc", "d"],), ([],)], "u array<string>")
    assert [r.c for r in df.select(text.chunk_pack(F.col("u"), 5).alias("c")).collect()] == [["aa\nbb", "ccccc", "ccc\nd"], []]


ROWS = ["1,234", "1.234,56", "1,234.56", "-5", "7 PALLETS", "", None, "1,234,567", "12,5"]


@pytest.mark.parametrize(
    ("profile", "expected"),
    [
        ("plain", [1234, 1.23456, 1234.56, 5, 7, None, None, 1234567, 125]),
        ("signed", [1234, 1.23456, 1234.56, None, 7, None, None, 1234567, 125]),
        ("decimal_comma", [1.234, 1.23456, 1234.56, 5, 7, None, None, 1234.567, 12.5]),
        ("european", [1.234, 1234.56, 1.23456, 5, 7, None, None, 1.234, 12.5]),
        ("auto", [1234, 1234.56, 1234.56, 5, 7, None, None, 1234567, 12.5]),
    ],
)
def test_number_profiles(spark, profile, expected):
    assert values(spark, lambda c: numbers.parse_number(c, profile), ROWS) == expected


def test_caps_money_rates(spark):
    assert values(spark, lambda c: numbers.capped(c, "weight"), [5.0, 500001.0, -1.0, None], "double") == [5.0, None, None, None]
    assert values(spark, numbers.money, ["$1,234.5", "(12.345)", "n/a"]) == [1234.5, -12.34, None]
    assert values(spark, lambda c: numbers.recovered_rate(c, F.lit(3.0), [10.0, 20.0]), [60.01, 61.0], "double") == [20.0, None]
    assert values(spark, numbers.original_count, ["0/ZERO", "THREE (3)", "zero", None]) == [0, 3, 0, None]


def test_cost_values_keep_the_amount(spark):
    df = spark.createDataFrame([(30.0, 3.0, 10.0, False), (10.0, 3.0, 3.3333, False), (20.0, 2.0, 10.0, True)], "a double, q double, p double, c boolean")
    q, p = numbers.cost_values(F.col("a"), F.col("q"), F.col("p"), F.col("c"))
    assert [(float(r.q), float(r.p)) for r in df.select(q.alias("q"), p.alias("p")).collect()] == [(3, 10), (1, 10), (-2, 10)]


def test_dates(spark):
    rows = ["2025-12-17T10:00", "17-DEC-2025", "DEC 17 2025", "17/12/2025", "12/17/2025", "17.12.25", "2025/12/17", "31/02/2025", "soon", None]
    assert values(spark, dates.normalize_date, rows) == ["2025-12-17"] * 7 + [None, None, None]
    assert values(spark, lambda c: dates.normalize_date(c, strict=False), ["31/02/2025"]) == ["2025-02-31"]
    assert [str(v) if v else None for v in values(spark, dates.strict_date, ["17/12/2025", "17-DEC-2025", "31/02/2025"])] == ["2025-12-17", "2025-12-17", None]
    assert values(spark, dates.serial_date, ["45000", "12", "45000.5", "x"]) == ["2023-03-15", "12", "2023-03-15", "x"]


def test_containers(spark):
    assert values(spark, ids.iso6346_valid, ["CSQU3054383", "CSQU 305438-3", "CSQU3054384", "CSQ3054383", None]) == [True, True, False, False, False]
    assert values(spark, ids.is_container, ["ABCD 123456-7", "ABC1234567", None]) == [True, False, False]
    assert values(spark, ids.format_container, ["abcd123456 / 7", "ab, "]) == ["ABCD123456/7", "ab"]
    legacy = values(spark, ids.legacy_check_digit, [f"MSCU123456{d}" for d in range(10)])

    def by_rule(t):
        total = sum((int(c) if c.isdigit() else 10 + ord(c) - 65) * 2**i for i, c in enumerate(t))
        return total % 11 % 10 == int(t[-1])

    assert legacy == [by_rule(f"MSCU123456{d}") for d in range(10)]


def test_plausible_ids(spark):
    rows = ["ABCD12345", "12345", "1234", "ORIGINAL", "MSCU1234567", "0123456", "1" * 19, "1" * 21, "ABCDEF", None]
    assert values(spark, ids.likely_number, rows) == [True, True, False, False, False, False, False, False, False, False]
    assert values(spark, ids.likely_voyage, ["123W", "VESSEL", "ABCD", "12", None]) == [True, False, False, False, False]
    assert values(spark, ids.billing_number, ["AB12345", "A12345", "AB123"]) == [True, False, False]
    df = spark.createDataFrame([("0123456", ""), ("7654321", "FORM NO: 7654321"), ("12345", "FMC NO 12345"), ("ABCD1234", "x"), ("BLOCKED", "")], "x string, page string")
    assert [r.y for r in df.select(ids.form_serial(F.col("x"), F.col("page"), ("BLOCKED",)).alias("y")).collect()] == [True, True, True, False, True]


def test_voyages_and_keys(spark):
    assert "12W" in values(spark, ids.voyage_variants, ["120W"])[0] and "12OW" in values(spark, ids.voyage_variants, ["120W"])[0]
    df = spark.createDataFrame([("01234W", "O1234W"), ("123", "456"), ("12", "13")], "a string, b string")
    assert [r.y for r in df.select(ids.voyage_match(F.col("a"), F.col("b")).alias("y")).collect()] == [True, False, False]
    keyed = spark.createDataFrame([(" ab-1 ", "p 2"), ("", "p 2"), (None, None)], "c string, p string")
    for profile, expected in {"alnum": ["AB1", "P2", None], "spaceless": ["AB-1", "P2", None], "digits": ["2", "2", None], "trimmed": ["AB-1", None, None]}.items():
        assert [r.k for r in keyed.select(ids.record_key(F.col("c"), F.col("p"), profile).alias("k")).collect()] == expected
    assert values(spark, ids.reference_tokens, ["ref ABCD123456 and XY12"]) == [["ABCD123456"]]
    assert values(spark, lambda c: ids.equipment(c, "upload"), ["45G1", "22G1", "zz"]) == ["40HC", "20DC", None]


def test_fields(spark):
    page = "B/L NO: ABCDE123456\nACID NO: 1234567890123456789\nHS CODE: 12345678/12345678/87654321\nGROSS WEIGHT: 2,360 KGS  30 CBM 12 PALLETS\nVOY: 123W\nPORT OF LOADING: SHANGHAI\nPOD: PORT SAID"
    one = spark.createDataFrame([(page,), ("nothing here",), (None,)], "x string")
    x = F.col("x")
    origin, target = fields.route(x, ["Shanghai", "Port Said", "Port"])
    rows = one.select(
        fields.document_number(x).alias("n"), fields.customs_id(x).alias("a"), fields.tariff_codes(x).alias("h"), fields.measures(x).alias("m"), fields.voyage(x).alias("v"), origin.alias("o"), target.alias("d")
    ).collect()
    assert (rows[0].n, rows[0].a, rows[0].h, rows[0].v, rows[0].o, rows[0].d) == ("ABCDE123456", "1234567890123456789", "12345678|87654321", "123W", "SHANGHAI", "PORT SAID")
    assert (rows[0].m.packages, rows[0].m.gross_kg, rows[0].m.volume_cbm) == (12, 2360, 30)
    assert all(v is None for v in (rows[1].n, rows[1].a, rows[1].h, rows[1].v, rows[1].o, rows[2].n))


def test_containers_in_text(spark):
    found = values(spark, fields.containers, ["MSCU1234567 SEAL: AB1234 40'HC and again MSCU 123456-7; TCLU7654321 SN X9999"])[0]
    assert [(c.seal, c.type) for c in found] == [("AB1234", "40HC"), ("X9999", None)]


def test_hazard_and_sheets(spark):
    found = values(spark, fields.hazard, ["UN NO: 1993 CLASS 3 FLASH POINT: 23 C", "IMO CLASS: 8", "first CLASS 3 ticket", "none"])
    assert (found[0].un_number, found[0].hazard_class, found[0].flash_point) == ("1993", "3", "23 C")
    assert found[1].hazard_class == "8" and found[2] is None and found[3] is None
    df = spark.createDataFrame([("PRODUCT NAME: Paint\nPACKING GROUP II\nCAS 64-17-5\nREPORT NO: R-12345678", "f_999999999.pdf")], "t string, f string")
    r = df.select(fields.safety_sheet(F.col("t"), F.col("f")).alias("s")).first().s
    assert (r.product, r.packing_group, r.cas_number, r.reference) == ("Paint", "II", "64-17-5", "12345678")


def test_json_object(spark):
    assert values(spark, fields.json_object, ['```json\n{"a": 1}\n```', 'so {"b": [1]} it is', "{broken", None]) == ['{"a": 1}', '{"b": [1]}', None, None]
