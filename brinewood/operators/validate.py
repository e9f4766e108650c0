"""The record validator: what a text says is read once, into a struct of probes; then stages of column rules, each of which
says in `warnings` what it filled or dropped.

No rule looks at a text: regular expressions run in `probe` alone, once a row, and those that could only fill a column run
only where it is empty. A stage computes its new values and its warnings in one step and rules of a stage read what the
stage before left, so that the plan is as long as the stages, not as the rules.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brinewood.functions import fields, ids, parties, scored
from brinewood.functions.ids import format_container
from brinewood.functions.numbers import parse_number
from brinewood.functions.text import alnum_upper, blank_to_null, clean_value, digits, once, truncate_strict
from brinewood.operators import rules
from brinewood.operators.layouts import FILL, LOCKED_KINDS, OVERWRITE, PARTIES, after_label, common_fields, enrichment
from brinewood.operators.shape import computed, to_template

CONTAINER = "struct<number:string,seal:string,type:string,packages:string,gross_kg:double,volume_cbm:double>"
#: Columns of a record and their types; what a table lacks is null.
RECORD = {
    "doc": "string", "role": "string", "method": "string", "text": "string", "parent_no": "string", "child_no": "string", "booking_no": "string", "customs_id": "string", "tariff_code": "string",
    "shipper": "string", "shipper_addr": "string", "consignee": "string", "consignee_addr": "string", "notify": "string", "notify_addr": "string", "agent": "string",
    "vessel": "string", "voyage": "string", "origin": "string", "destination": "string", "delivery": "string", "issue_place": "string", "issue_date": "string", "packages": "string", "gross_kg": "string", "volume_cbm": "string",
    "containers": f"array<{CONTAINER}>", "container_no": "string", "seal_no": "string", "container_type": "string", "load_type": "string", "freight_term": "string", "telex": "boolean", "release_status": "string",
    "originals": "string", "service": "string", "importer_tax": "string", "exporter_id": "string", "transport": "int", "direction": "int", "description": "string", "notes": "string", "consolidated": "boolean",
    "un_number": "string", "hazard_class": "string", "flash_point": "string", "booking_code": "int", "payable_at": "string", "teu": "int", "warnings": "array<string>",
}
#: Words that no vessel's name starts with, the transport by sea, units that keep a count of packages a text,
#: consignees that have no address, and marks of a release by telex.
NO_VESSEL = r"^(ZERO|FCL|LCL|FREE|NON-NEG|EXPORT LCL)|MANIFEST"
SEA = 300000000
PACKAGE_TEXT = r"(?i)PALLETS|PACKAGES|ROLLS|CARTONS?|UNSTACKABLE"
TO_ORDER = r"(?i)^TO\s+(THE\s+)?(ORDER|HOLDER)\b"
TELEX_MARKS = r"TELEX RELEASE|EXPRESS RELEASE|EXPRESS BILL OF LADING"
#: Probes that only fill their column.
ONLY_FILL = tuple(c for c in FILL if c not in ("vessel", "origin")) + ("child_no",)


def probe(records: DataFrame, ports: list[str]) -> DataFrame:
    """records with `_f`, a struct of all that the rules want to know of a record's text."""
    lines, wanted = probes(tuple(ports))
    base = computed(records, lines)
    names = list(wanted)
    half = len(names) // 2
    for part in (names[:half], names[half:]):
        base = computed(base, {f"_f_{c}": wanted[c] for c in part})
    packed = ", ".join(f"'{c}', _f_{c}" for c in names)
    return base.selectExpr(*[f"`{c}`" for c in records.columns], f"named_struct({packed}) AS _f")


@functools.cache
def probes(ports: tuple[str, ...]) -> tuple[dict[str, Column], dict[str, Column]]:
    """(lines below party labels and the text in upper case, what is wanted of a text)"""
    text, upper = F.col("text"), F.col("_upper")
    lines = {f"_{w}_lines": F.lit(None).cast("array<string>") if w == "shipper" else after_label(text, f"{w.upper()}(?: PARTY)?") for w in PARTIES}
    said = common_fields(text, list(ports))
    wanted = {c: said[c] for c in dict.fromkeys((*OVERWRITE, *FILL, "parent_no", "containers"))} | {"child_no": said["child_no"]}
    wanted |= {c: F.when(F.col(c).isNull(), wanted[c]) for c in ONLY_FILL}
    wanted["containers"] = F.when(F.size(F.coalesce("containers", F.array().cast(f"array<{CONTAINER}>"))) == 0, said["containers"])
    wanted["gross_kg"] = F.when(F.col("gross_kg").isNull(), scored.gross_weight(text).cast("string"))
    wanted |= {
        "page_no": fields.page_number_id(text), "hazard": fields.hazard(text), "packages": scored.page_packages(text), "forms": ids.form_marks(text), "load": rules.load_marks(text), "release": rules.release_votes(text),
        "telex": upper.rlike(TELEX_MARKS),
    }
    return {"_upper": F.upper(text), **lines}, wanted


class Stage:
    """New values of columns, and warnings, of the same rows."""

    def __init__(self) -> None:
        self.values: dict[str, Column] = {}
        self.said: list[Column] = []

    def put(self, column: str, value: Column, when: Column | None = None, warning: str | None = None) -> Column:
        """Where `when` holds, the column takes the value and the warning is added. Rules for one column follow each other."""
        now = self.values.get(column, F.col(column))
        when = F.lit(True) if when is None else F.coalesce(when, F.lit(False))
        self.values[column] = F.when(when, value).otherwise(now)
        if warning:
            self.said.append(F.when(when, warning))
        return self.values[column]

    def fill(self, column: str, value: Column, when: Column | None = None, warning: str | None = None) -> Column:
        """A value for a column that has none."""
        empty = self.values.get(column, F.col(column)).isNull() & value.isNotNull()
        return self.put(column, value, empty if when is None else empty & when, warning or f"{column} filled from the text")

    def drop(self, column: str, when: Column, warning: str) -> Column:
        now = self.values.get(column, F.col(column))
        return self.put(column, F.lit(None), now.isNotNull() & when, warning)

    def applied(self, df: DataFrame) -> DataFrame:
        names = {c: f"_n{i}" for i, c in enumerate(self.values)}
        said = F.array_compact(F.array(*self.said)) if self.said else F.array().cast("array<string>")
        out = computed(df, {**{names[c]: v.cast(RECORD[c]) for c, v in self.values.items()}, "_said": said})
        taken = {**names, "warnings": "warnings || _said"}
        return out.selectExpr(*[f"{taken[c]} AS {c}" if c in taken else f"`{c}`" for c in df.columns])


def container_type(x: Column) -> Column:
    """A type without the count before it: `1 x 40HC` is 40HC."""
    return blank_to_null(F.regexp_replace(F.upper(F.trim(x)), r"^[0-9]+\s*X\s*", ""))


def number_text(x: Column) -> Column:
    """A number as text without trailing zeros."""
    return F.regexp_replace(parse_number(x, "decimal_comma").cast("decimal(20,3)").cast("string"), r"\.?0+$", "")


@functools.cache
def stages(home: tuple[str, ...], noise: tuple[str, ...]) -> list[Stage]:
    """The rules in order, stage by stage, over records with `_f`; put together once a process, as columns belong to no
    table."""
    return list(_stages(home, noise))


def _stages(home: tuple[str, ...], noise: tuple[str, ...]) -> Iterator[Stage]:
    f = lambda name: F.col(f"_f.{name}")
    role = F.coalesce("role", F.lit("plain"))
    house, draft, header = role == "manifest_house", role == "draft", role == "manifest_header"
    plain = ~house & ~draft

    # numbers of the document, packages and weight of the page
    s = Stage()
    s.fill("customs_id", f("customs_id"), plain)
    s.put("parent_no", f("page_no"), f("page_no").isNotNull() & ~draft)
    s.put("booking_no", f("page_no"), f("page_no").isNotNull() & ~draft)
    s.drop("parent_no", ids.marked_serial(F.col("parent_no"), f("forms")) & (f("page_no").isNull() | draft), "parent_no dropped: a form's or register's number")
    s.put("packages", scored.packages_of(F.col("packages"), f("packages")), plain & ~header & (F.col("packages").isNotNull() | f("packages.count").isNotNull()))
    s.put("gross_kg", f("gross_kg"), F.col("gross_kg").isNull() & ~draft)
    s.put("notes", parties.clean_notes(F.col("notes"), noise), F.col("notes").isNotNull() & ~draft)
    yield s
    s = Stage()
    s.fill("parent_no", f("parent_no"), ~ids.marked_serial(f("parent_no"), f("forms")))
    s.fill("child_no", f("child_no"))
    s.fill("tariff_code", f("tariff_code"), plain)
    before = F.col("un_number").isNotNull() | F.col("hazard_class").isNotNull()
    s.put("un_number", f("hazard.un_number"), ~before & f("hazard").isNotNull(), "hazard filled from the text")
    s.fill("hazard_class", f("hazard.hazard_class"), f("hazard").isNotNull(), "hazard_class filled from the text")
    s.fill("flash_point", f("hazard.flash_point"), f("hazard").isNotNull(), "flash_point filled from the text")
    yield s

    # enrichment writes silently, so what follows finds only what it left
    s = Stage()
    s.drop("child_no", alnum_upper(F.col("child_no")) == alnum_upper(F.col("parent_no")), "child_no dropped: the parent's number")
    locked = role.isin(*LOCKED_KINDS) | F.coalesce(F.col("method").rlike("(?i)debit_note|safety_sheet|sea_waybill"), F.lit(False))
    for c, value in enrichment([c for c in (*OVERWRITE, *FILL) if c != "customs_id"], f, locked).items():
        s.put(c, value)
    yield s
    s = Stage()
    s.drop("tariff_code", digits(F.col("tariff_code")) == digits(F.col("parent_no")), "tariff_code dropped: the parent's number")
    s.drop("vessel", F.upper("vessel").rlike(NO_VESSEL), "vessel dropped: no name")
    for name in ("vessel", "voyage"):
        s.fill(name, f(name))
    at_home = lambda x: rules._any(F.upper(x), home)
    s.put("origin", f("origin"), f("origin").isNotNull() & (F.col("origin").isNull() | (at_home(F.col("origin")) & ~at_home(f("origin")))), "origin filled from the text")
    for name in ("destination", "issue_place", "issue_date"):
        s.fill(name, f(name))
    nothing = F.size(F.coalesce("containers", F.array().cast(f"array<{CONTAINER}>"))) == 0
    listed = F.transform(f("containers"), lambda x: F.struct(x["number"].alias("number"), x["seal"].alias("seal"), x["type"].alias("type"), F.lit(None).cast("string").alias("packages"), F.lit(None).cast("double").alias("gross_kg"), F.lit(None).cast("double").alias("volume_cbm")))
    s.put("containers", listed, nothing & (F.size(f("containers")) > 0), "containers filled from the text")
    own = digits(F.col("customs_id"))
    s.put("customs_id", F.when(F.length(own) >= 10, own))
    yield s

    # numbers and containers in their forms
    s = Stage()
    same = digits(F.col("parent_no")) == F.col("customs_id")
    other = F.when(digits(f("parent_no")) != F.col("customs_id"), f("parent_no"))
    s.put("parent_no", F.coalesce(other, F.col("parent_no")), same, "parent_no was the customs id")
    for name in ("gross_kg", "volume_cbm"):
        s.put(name, number_text(F.col(name)))
    s.put("packages", number_text(F.col("packages")), ~house & ~F.col("packages").rlike(PACKAGE_TEXT) & ~F.col("packages").rlike("[A-Za-z]$"))

    def cleaned(x: Column) -> Column:
        return F.struct(format_container(x["number"]).alias("number"), clean_value(x["seal"]).alias("seal"), container_type(x["type"]).alias("type"), clean_value(x["packages"]).alias("packages"), x["gross_kg"].alias("gross_kg"), x["volume_cbm"].alias("volume_cbm"))

    some = lambda x: F.coalesce(x["number"], x["seal"], x["type"], x["packages"], x["gross_kg"].cast("string"), x["volume_cbm"].cast("string")).isNotNull()
    s.put("containers", once(F.transform("containers", cleaned), lambda a: F.filter(a, some)))
    s.put("container_type", container_type(F.col("container_type")))
    for name in ("consignee_addr", "notify_addr"):
        s.put(name, parties.address(F.col(name)))
    s.put("delivery", parties.place(F.col("delivery")))
    yield s
    s = Stage()
    first = F.get("containers", F.lit(0))
    s.put("container_no", format_container(F.coalesce(first["number"], F.col("container_no"))), first.isNotNull())
    s.put("seal_no", F.coalesce("seal_no", first["seal"]), first.isNotNull())
    s.fill("container_type", first["type"], F.lit(True), " ")
    s.said.clear()
    s.put("consignee_addr", F.lit(None), F.col("consignee").rlike(TO_ORDER))

    # load, freight, release and direction
    s.put("transport", F.lit(SEA), F.col("transport").isNull())
    signal = rules.marked_lcl(f("load"), F.col("method"), F.coalesce("consolidated", F.lit(False)), F.col("parent_no"), F.col("child_no"))
    s.put("load_type", rules.marked_load_type(F.col("load_type"), f("load"), signal, F.coalesce(F.size("containers"), F.lit(0))).cast("string"))
    s.put("freight_term", f("freight_term"), F.col("freight_term").isNull())
    telex = F.coalesce("telex", F.lit(False)) | F.coalesce(f("telex"), F.lit(False))
    status = once(rules.voted_release(F.col("release_status"), f("release"), F.col("originals"), telex), lambda v: F.coalesce(v.cast("string"), F.col("release_status")))
    s.put("telex", F.lit(True), telex)
    s.put("release_status", status)
    way = rules.direction(F.col("origin"), F.col("destination"), home)
    s.put("direction", once(way, lambda w: F.coalesce(w, F.col("direction"))))
    s.put("description", truncate_strict(F.col("description"), 1500), F.col("description").isNotNull())
    yield s
    s = Stage()
    s.put("telex", F.col("release_status") == str(rules.TELEX), F.col("release_status").isNotNull())
    yield s


def correct(probed: DataFrame, home: tuple[str, ...], noise: tuple[str, ...]) -> DataFrame:
    """records with `_f` through all stages and the rule pack."""
    df = probed
    for s in stages(tuple(home), tuple(noise)):
        df = s.applied(df)
    child = F.coalesce(F.col("child_no").isNotNull() & (F.col("parent_no").isNull() | (F.upper("child_no") != F.upper("parent_no"))), F.lit(False))
    packed = df.withColumns({"n_containers": F.coalesce(F.size("containers"), F.lit(0)), "consolidated": F.coalesce("consolidated", F.lit(False))})
    return rules.apply_pack(packed, is_child=child).select(*probed.columns)


def prepared(records: DataFrame, ports: list[str]) -> DataFrame:
    """records in the columns of RECORD, other columns behind them, with clean texts and `_f`."""
    extra = {c: records.schema[c].dataType.simpleString() for c in records.columns if c not in RECORD}
    base = to_template(records, {**RECORD, **extra})
    clean = [c for c, kind in RECORD.items() if kind == "string" and c not in ("doc", "text", "notes")]
    cleaned = {c: f"nullif(btrim(regexp_replace(`{c}`, '\\\\s+', ' '), ' ,;:-'), '')" for c in clean}  # clean_value in SQL
    cleaned["warnings"] = "coalesce(warnings, cast(array() AS array<string>))"
    return probe(base.selectExpr(*[f"{cleaned[c]} AS `{c}`" if c in cleaned else f"`{c}`" for c in base.columns]), ports)


def validate(records: DataFrame, *, ports: list[str], home: tuple[str, ...], noise: tuple[str, ...] = ()) -> DataFrame:
    """[RUL-01, RGX-23] records with the columns of RECORD, or some of them, corrected in this order: clean texts, ids,
    packages, weight and notes of the page, hazard, enrichment from the text, tariff, vessel and route, issue, containers,
    numbers, load, freight and release, direction, length, rule pack.

    role tells headers, house rows and drafts of manifests from plain records; some rules leave them alone. Applying it
    again changes nothing but adds no warning either, since every warning belongs to a change. A null text fills nothing;
    columns that are not of RECORD come back as they were.
    """
    return correct(prepared(records, ports), home, noise).drop("_f")


def validate_by_page(records: DataFrame, pages: DataFrame, anchors: list[str], *, ports: list[str], home: tuple[str, ...], noise: tuple[str, ...] = ()) -> DataFrame:
    """[RUL-16] records(doc, page, ...) validated, corrected by their pages' own values pages(doc, page, anchors), and
    validated again; what their texts say is read once."""
    from brinewood.operators.records import force_page_values

    once_ = correct(prepared(records, ports), home, noise)
    return correct(force_page_values(once_, pages, anchors), home, noise).drop("_f")
