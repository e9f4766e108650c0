"""Operators that have to do the whole job: rows that tie, names that only variants or containment meet."""

import re
from pathlib import Path

from brinewood.operators import lookup, rollup


def test_charge_groups_keep_lines_that_repeat_a_number(spark):
    data = [(1, 1, "A", 7.0, 7.0, None), (1, 1, "A", 2.0, 2.0, 4.0), (1, 1, "A", 2.0, 2.0, 3.0), (1, 2, "B", 1.0, None, None)]
    for given in (data, data[::-1]):
        lines = spark.createDataFrame(given, "p int, n int, term string, amount double, cbm double, kgs double").coalesce(1)
        r = rollup.charge_groups(lines, "p", "n").first()
        assert (r.first_line, r.cbm, r.kgs) == (1, 2.0, 3.0)
        assert [(x.n, x.term, x.amount) for x in r.lines] == [(1, "A", 2.0), (1, "A", 2.0), (1, "A", 7.0), (2, "B", 1.0)]


def test_fuzzy_lookup_meets_names_inside_others_and_variants(spark):
    dim = spark.createDataFrame([(1, "Portsaid"), (2, "ABC Co"), (3, "Zeta Trading"), (4, "x9"), (5, None), (6, "--")], "id int, name string")
    names = [(1, "SAID"), (2, "AB"), (3, "Foo Group"), (4, "Qx9q"), (5, None), (6, "nobody"), (7, "PORT SAID EAST"), (8, "."), (9, "Nobody (Zeta Trading)")]
    q = spark.createDataFrame(names, "q int, n string")
    names = {"query_id": "q", "query_name": "n", "dim_id": "id", "dim_name": "name"}
    got = {r.q: (r.id, r.score) for r in lookup.fuzzy_lookup(q, dim, **names, hints={"foo": ["ZETA TRADING"]}).collect()}
    assert got == {1: (1, 75), 2: (2, 90), 3: (3, 100), 4: (4, 75), 5: (None, 0), 6: (None, 0), 7: (1, 90), 8: (None, 0), 9: (3, 75)}
    got = {r.q: r.id for r in lookup.fuzzy_lookup(q, dim, **names, variants=False).collect()}
    assert (got[1], got[2], got[3]) == (1, 2, None)
    pairs = q.crossJoin(dim).select("q", "id", lookup.match_score("n", "name").alias("s")).where("s > 0").groupBy("q").agg({"s": "max"}).collect()
    got = {r.q: r.score for r in lookup.fuzzy_lookup(q, dim, **names, variants=False, least=1).where("score > 0").collect()}
    assert got == {p[0]: p[1] for p in pairs}


def test_docstrings_claim_no_survey_id_that_is_not_built():
    root = Path(__file__).parent.parent
    claimed = " ".join(re.findall(r"\[([A-Z]{2,3}-\d\d[^\]]*)\]", "".join(p.read_text() for p in root.glob("brinewood/**/*.py"))))
    for first, last in re.findall(r"([A-Z]{3}-\d\d) to ([A-Z]{3}-\d\d)", claimed):
        claimed += "".join(f" {first[:4]}{i:02}" for i in range(int(first[4:]), int(last[4:]) + 1))
    missing = ["JN-15", "STM-04"]
    assert not [x for x in missing if x in claimed]
