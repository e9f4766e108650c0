"""Field extraction from document text by ordered patterns. No match is null, never the empty string."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from brinewood.functions.ids import format_container, likely_number
from brinewood.functions.text import blank_to_null, digits, once


def first_match(x: Column, *patterns: str, group: int = 1, keep=None) -> Column:
    """The first pattern whose first match is accepted."""
    found = [F.trim(F.regexp_extract(x, p, group)) for p in patterns]
    return F.coalesce(*[once(f, lambda v: F.when((v != "") & keep(v), v)) if keep else blank_to_null(f) for f in found])


def document_number(text: Column, customs_id: Column | None = None) -> Column:
    """[RGX-01] A labelled number that is plausible, else the first plausible one in the first 2000 characters."""
    u = F.upper(text)
    patterns = (
        r"\b(?:MASTER\s+)?B\s*/?\s*L\s*(?:NO|NUMBER|#)?\.?\s*[:#\-]?\s*([A-Z0-9][A-Z0-9\-]{4,24})\b",
        r"\bBILL\s+OF\s+LADING\s*(?:NO|NUMBER|#)?\.?\s*[:#\-]?\s*([A-Z0-9][A-Z0-9\-]{4,24})\b",
        r"\bWAYBILL\s*(?:NO|NUMBER|#)?\.?\s*[:#\-]?\s*([A-Z0-9][A-Z0-9\-]{4,24})\b",
    )
    keep = lambda c: likely_number(c, customs_id)
    head = F.filter(F.regexp_extract_all(F.substring(u, 1, 2000), F.lit(r"\b([A-Z]{3,4}[A-Z0-9]*[0-9]{5,}[A-Z0-9]*)\b"), F.lit(1)), keep)
    return F.coalesce(first_match(u, *patterns, keep=keep), F.get(head, F.lit(0)))


def child_number(text: Column) -> Column:
    """[RGX-01] A number labelled as a child document's."""
    return first_match(F.upper(text), r"\b(?:HOUSE\s+B\s*/?\s*L|HBL|HB/L)\s*(?:NO|NUMBER)?\.?\s*[:#\-]?\s*([A-Z0-9][A-Z0-9\-/]{4,24})\b", keep=likely_number)


#: Labels of customs ids and tariff codes, and how their digits may be grouped.
CUSTOMS_LABEL = r"\bACID(?:\s+(?:NO|NUMBER))?\s{0,3}[.:#\-]?\s{0,3}"
GROUPED_DIGITS = r"((?:[0-9][ \t\-]{0,2}){9,18}[0-9])(?![0-9])"
TARIFF_LABEL = r"\bH\W{0,2}S\W{0,3}CODES?\W{0,4}"


def customs_id(text: Column) -> Column:
    """[RGX-02] 10 to 19 labelled digits, else any 19 digits by themselves."""
    u = F.upper(text)
    return F.coalesce(digits(F.regexp_extract(u, CUSTOMS_LABEL + GROUPED_DIGITS, 1)), first_match(u, r"\b([0-9]{19})\b"))


def tariff_codes(text: Column) -> Column:
    """[RGX-03] Distinct codes of 6 to 10 digits after the label, joined by bars."""
    listed = F.regexp_extract(F.upper(text), TARIFF_LABEL + r"((?:[0-9]+(?:\s{0,2}[/|,.\-]\s{0,2}|\s{1,2}|$)?){1,20})", 1)
    return blank_to_null(F.array_join(F.array_distinct(F.regexp_extract_all(listed, F.lit(r"\b([0-9]{6,10})\b"), F.lit(1))), "|"))


def containers(text: Column, window: int = 80) -> Column:
    """[RGX-04] Array of (number, seal, type): each container number, with what the next characters say of it."""
    return once(F.upper(text), lambda u: _containers(u, window))


#: What the characters behind a container's number say: its seal, and that it is a high one.
SEAL = r"\bS(?:EAL|N)[\s:#]*([A-Z0-9]{4,20})\b"
HIGH = r"40\s*'?HC"


def _containers(u: Column, window: int) -> Column:
    pattern = r"(\b[A-Z]{4}\s?[0-9]{6}\s*[-/]?\s*[0-9]\b)"
    found = F.array_distinct(F.regexp_extract_all(u, F.lit(pattern), F.lit(1)))

    def item(c: Column) -> Column:
        return once(F.substring(u, F.instr(u, c) + F.length(c), F.lit(window)), lambda tail: described(c, tail))

    def described(c: Column, tail: Column) -> Column:
        seal = blank_to_null(F.regexp_extract(tail, SEAL, 1))
        return F.struct(format_container(c).alias("number"), seal.alias("seal"), F.when(tail.rlike(HIGH), "40HC").alias("type"))

    def distinct(items: Column) -> Column:
        return once(F.transform(items, lambda i: i["number"]), lambda keys: F.filter(items, lambda i, at: F.array_position(keys, i["number"]) == at + 1))

    return once(F.transform(found, item), distinct)


def route(text: Column, ports: list[str]) -> tuple[Column, Column]:
    """[RGX-05] (origin, destination): the ports after their labels, longest names first."""
    u, names = F.upper(text), "|".join(sorted((p.upper() for p in ports), key=lambda p: (-len(p), p)))
    origin = first_match(u, rf"(?:PORT\s+OF\s+LOADING|POL)\s*[:\-]?\s*({names})\b")
    target = first_match(u, rf"(?:PORT\s+OF\s+DISCHARGE|POD|DESTINATION)\s*[:\-]?\s*({names})\b")
    return origin, target


def voyage(text: Column) -> Column:
    """[RGX-05]"""
    from brinewood.functions.ids import likely_voyage

    return first_match(F.upper(text), r"\bVOY(?:AGE)?\.?\s*(?:NO)?\.?\s*[:#\-]?\s*([A-Z0-9\-]{3,15})\b", keep=likely_voyage)


def hazard(text: Column) -> Column:
    """[RGX-07] Struct of UN number, class, flash point and pollutant flag; null unless a UN number, or a class in context."""
    u = F.upper(text)
    un = first_match(u, r"\bUN\s*(?:NO|NUMBER)?\.?\s*[:#\-]?\s*([0-9]{4})\b")
    cls = first_match(u, r"\b(?:IMO|IMDG|HAZ(?:ARD)?)?\s*CLASS\s*[:#\-]?\s*([1-9](?:\.[1-6])?)\b")
    flash = first_match(u, r"FLASH\s*POINT\s*[:\-]?\s*(-?[0-9]+(?:\.[0-9]+)?\s*°?\s*[CF]?)")
    context = u.rlike(r"\b(IMO|IMDG|DANGEROUS|HAZARD)")
    return F.when(un.isNotNull() | (cls.isNotNull() & context), F.struct(un.alias("un_number"), cls.alias("hazard_class"), flash.alias("flash_point"), u.rlike(r"MARINE\s+POLLUTANT\s*[:\-]?\s*(YES|Y\b)").alias("pollutant")))


def safety_sheet(text: Column, filename: Column) -> Column:
    """[RGX-08] Struct of a safety data sheet: product, packing group, CAS number, reference (longest digit run)."""
    def longest(x: Column) -> Column:
        runs = F.regexp_extract_all(x, F.lit("([0-9]{6,15})"), F.lit(1))
        ranked = F.array_sort(F.transform(runs, lambda r, i: F.struct((-F.length(r)).alias("n"), i.alias("i"), r.alias("r"))))
        return F.get(ranked, F.lit(0))["r"]

    label = F.regexp_extract(text, r"(?i)(?:REPORT|REFERENCE)\s*(?:NO|NUMBER)?\.?\s*[:#]?\s*(\S+)", 1)
    return F.struct(
        first_match(text, r"(?im)PRODUCT\s*NAME\s*[:\-]\s*([^\n]+)").alias("product"),
        first_match(F.upper(text), r"PACKING\s+GROUP\s*[:\-]?\s*(III|II|I)\b").alias("packing_group"),
        first_match(text, r"\b([0-9]{2,7}-[0-9]{2}-[0-9])\b").alias("cas_number"),
        F.coalesce(longest(label), longest(filename)).alias("reference"),
    )


def measures(text: Column) -> Column:
    """[SRC-07, RGX-11] Struct of the first packages, gross weight in kg and volume in cbm."""
    u = F.upper(text)
    from brinewood.functions.numbers import capped, parse_number

    number = r"([0-9][0-9,.]*)"
    return F.struct(
        capped(parse_number(first_match(u, number + r"\s*(?:PACKAGES|PKGS|PKG|CARTONS|PALLETS|BAGS|DRUMS|PIECES|PCS)\b")), "packages").alias("packages"),
        capped(parse_number(first_match(u, r"GROSS\s*(?:WEIGHT|WT)\.?\s*[:\-]?\s*" + number, number + r"\s*(?:KGS|KGM|KG)\b")), "weight").alias("gross_kg"),
        capped(parse_number(first_match(u, r"(?:VOLUME|MEASUREMENT)\s*[:\-]?\s*" + number, number + r"\s*(?:CBM|M3)\b")), "volume").alias("volume_cbm"),
    )


#: Fixed patterns of a weight in kg: with two decimals, whole, and after the unit.
PROBES = (r"(?i)\b([0-9]{3,4}[.,][0-9]{2})\s*KGS?\b", r"(?i)\b([0-9]{3,4})\s*KGS?\b", r"(?i)KGS?\s*[:\-]?\s*([0-9]{3,4}[.,][0-9]{2})\b")


def weight_probe(text: Column) -> Column:
    """[SRC-07] The first of three weight patterns that a page has, as text with a decimal point."""
    return F.translate(first_match(text, *PROBES), ",", ".")


#: Fixed pattern of carriers' own numbers.
CARRIER_NUMBER = r"\b(IST[0-9]{9,12}|NSA[0-9]{9,12}|ARK[A-Z]?[0-9]{8,12})\b"


def organization_numbers(text: Column) -> Column:
    """[RGX-06] Digits of regulators' organisation numbers, with and without leading zeros: never a document number."""
    found = F.regexp_extract_all(F.upper(text), F.lit(r"FMCG?\s+ORGANIZATION\s+NO\.?\s*([0-9]{5,8})\b"), F.lit(1))
    return F.array_distinct(F.concat(found, F.transform(found, lambda n: F.ltrim(n, F.lit("0")))))


def glued_number(text: Column) -> Column:
    """[RGX-06] A number `NN NNN` that recognition glued to the end of a street line in a header that labels a number: the
    line before ends in a street number, the next line starts with a postal code and a town."""
    head = F.substring(text, 1, 3000)
    street = r"(?i)[A-Z][A-Z \t]{4,40}[ \t]+[0-9]{1,5}[ \t]+([0-9]{2,3})[ \t]+([0-9]{2,4})[ \t]*\n\s*[0-9]{2,3}[ \t]+[0-9]{2,4}[ \t]+[A-Z]{3,}"
    a, b = F.regexp_extract(head, street, 1), F.regexp_extract(head, street, 2)
    taken = F.array_contains(organization_numbers(text), F.concat(a, b))
    return F.when(head.rlike(r"(?i)\bB/?\s*L\s*NO\b") & (a != "") & ~taken, F.concat(a, F.lit(" "), b))


def page_number_id(text: Column) -> Column:
    """[RGX-06] The document number that a page's header states: a carrier's own number, a glued one, or 9 to 12 digits at
    the end of the line below the exporter and number labels."""
    below = F.regexp_extract(text, r"(?i)SHIPPER[^\n]*BILL\s+OF\s+LADING\s+NO\.?[^\n]*\n[^\n]*?\b([0-9]{9,12})[ \t]*(?:\n|$)", 1)
    own = F.when((below != "") & ~F.array_contains(organization_numbers(text), below), below)
    return F.coalesce(F.upper(first_match(text, "(?i)" + CARRIER_NUMBER)), glued_number(text), own)


def json_object(text: Column) -> Column:
    """[RGX-26] The JSON object in a text, out of a code fence or between its first and last brace; null if it doesn't parse."""
    fenced = blank_to_null(F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*\})\s*```", 1))
    bare = blank_to_null(F.regexp_extract(text, r"(?s)(\{.*\})", 1))
    found = F.coalesce(fenced, bare)
    return F.when(F.try_parse_json(found).isNotNull(), found)
