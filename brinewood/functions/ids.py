"""Identifier columns: container numbers and check digits, plausible document numbers, voyages, record keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from brinewood.functions.text import alnum_upper, blank_to_null, clean_value, digits, once

#: Words that are never a document number, and words that are never a voyage.
NOT_NUMBERS = ("ORIGINAL", "NUMBER", "COPY", "DRAFT", "BLNO", "BILL", "LADING", "PREPAID", "COLLECT", "SHIPPER", "CONSIGNEE", "CARRIER", "FREIGHT")
NOT_VOYAGES = (*NOT_NUMBERS, "NOTIFY", "WEIGHT", "MEASUREMENT", "CONTAINER", "PACKAGES", "DELIVERY", "RECEIPT", "DESTINATION", "DESCRIPTION", "DOCUMENTS", "GOODS", "PLACE", "PORT", "VESSEL", "VOYAGE", "ORIGIN", "TOTAL", "PAGE", "DATE")


CONTAINER = "^[A-Z]{4}[0-9]{7}$"


def compact(x: Column) -> Column:
    """Upper case without blanks, dashes and slashes."""
    return F.upper(F.regexp_replace(x, r"[\s\-/]", ""))


def is_container(x: Column) -> Column:
    """[FLT-02] Four letters and seven digits."""
    return F.coalesce(compact(x).rlike(CONTAINER), F.lit(False))


def _places(t: Column, skip: int) -> Column:
    """Sum of the first ten characters' values times powers of 2; a letter counts from 10 up, `skip` says whether
    multiples of 11 are left out."""
    def value(i: int) -> Column:
        code = F.ascii(F.substring(t, i, 1))
        letter = code - 55
        return F.when(code < 65, code - 48).otherwise(letter + F.floor((letter - 1) / 10).cast("int") if skip else letter)

    return sum((value(i) * (1 << (i - 1)) for i in range(1, 11)), F.lit(0))


def _last_digit(t: Column) -> Column:
    return F.ascii(F.substring(t, 11, 1)) - 48


def iso6346_valid(x: Column) -> Column:
    """The standard check digit: letters from 10 up without multiples of 11, weights of powers of 2, mod 11, mod 10."""
    return once(compact(x), lambda t: F.when(t.rlike(CONTAINER), _places(t, True) % 11 % 10 == _last_digit(t)).otherwise(False))


def _legacy(t: Column) -> Column:
    return F.when(t.rlike(CONTAINER), (_places(t, False) + _last_digit(t) * 1024) % 11 % 10 == _last_digit(t)).otherwise(False)


def legacy_check_digit(x: Column) -> Column:
    """[STR-08] The rule that sums all eleven characters and skips no letter value."""
    return once(compact(x), _legacy)


def format_container(x: Column) -> Column:
    """[STR-08] With slash if it came so, with a dash before a digit that checks, else compact; other texts cleaned."""
    slash = r"\b([A-Z]{4})([0-9]{6})\s*/\s*([0-9])\b"
    slashed = F.regexp_extract(F.upper(x), slash, 0)

    def checked(t: Column) -> Column:
        return F.when(_legacy(t), F.concat(F.substring(t, 1, 10), F.lit("-"), F.substring(t, 11, 1))).when(t.rlike(CONTAINER), t).otherwise(clean_value(x))

    return F.when(slashed != "", F.regexp_replace(slashed, "\\s", "")).otherwise(once(compact(x), checked))


def likely_number(x: Column, customs_id: Column | None = None) -> Column:
    """[FLT-01] Whether a text may be a document number."""

    def test(c: Column) -> Column:
        numeric = c.rlike("^[0-9]+$")
        ok = F.length(c).between(5, 25) & ~c.isin(*NOT_NUMBERS) & ~c.rlike(CONTAINER) & ~c.rlike("^(?:[0-9]{19}|0[0-9]{6,8})$")
        if customs_id is not None:
            ok = ok & ~F.coalesce(c == digits(customs_id), F.lit(False))
        return ok & F.when(numeric, F.length(c) <= 20).otherwise(c.rlike("[A-Z]") & c.rlike("[0-9]"))

    return F.coalesce(once(F.upper(F.regexp_replace(F.trim(x), r"[\s\-]", "")), test), F.lit(False))


def likely_voyage(x: Column) -> Column:
    """[FLT-03] 3 to 15 characters with a digit, not a word of the form."""
    u = F.upper(F.trim(x))
    return F.coalesce(F.length(u).between(3, 15) & u.rlike("[0-9]") & ~u.isin(*NOT_VOYAGES), F.lit(False))


def form_marks(page: Column) -> Column:
    """Struct of what a page names as an organisation's number and as a form's or serial number: (orgs, forms)."""
    orgs = F.regexp_extract_all(F.upper(page), F.lit(r"(?:FMC|ORG(?:ANI[SZ]ATION)?)\.?\s*(?:NO|NUMBER)?\.?\s*[:#]?\s*([0-9]{4,9})"), F.lit(1))
    forms = F.regexp_extract_all(F.upper(page), F.lit(r"(?:FORM|SERIAL)\s*(?:NO|NUMBER)?\.?\s*[:#]?\s*([0-9]{7,})"), F.lit(1))
    return F.struct(F.coalesce(orgs, F.array().cast("array<string>")).alias("orgs"), F.coalesce(forms, F.array().cast("array<string>")).alias("forms"))


def marked_serial(x: Column, marks: Column, blocked: tuple[str, ...] = ()) -> Column:
    """form_serial of a number, by the form_marks of its page."""

    def test(d: Column) -> Column:
        hit = F.trim(x).isin(*blocked) if blocked else F.lit(False)
        named = d.rlike("^[0-9]{7}$") & F.exists(marks["forms"], lambda f: F.startswith(f, d))
        return F.coalesce(hit | F.trim(x).rlike("^0[0-9]{6,8}$") | named | ((d != "") & F.array_contains(marks["orgs"], d)), F.lit(False))

    return F.coalesce(once(F.regexp_replace(x, "[^0-9]", ""), test), F.lit(False))


def form_serial(x: Column, page: Column, blocked: tuple[str, ...] = ()) -> Column:
    """[FLT-04] Numbers of forms and registers: blocked ones, 0 and six to eight digits, seven digits named as a form
    number in the page, and numbers that the page names as an organisation's."""
    return once(form_marks(page), lambda marks: marked_serial(x, marks, blocked))


def billing_number(x: Column) -> Column:
    """[FLT-07] Two or more letters, then at least four digits somewhere."""
    return F.coalesce(x.rlike("^[A-Z]{2,}[A-Z0-9]*[0-9]{4,}[A-Z0-9]*$"), F.lit(False))


def voyage_variants(x: Column) -> Column:
    """[JN-16] The spellings that misread O, 0 and W give: the blocking key of voyage joins. An O or 0 before W may be a
    smudge, and any O may be a 0 and the other way round."""
    swap = lambda c, a, b: F.replace(c, F.lit(a), F.lit(b))

    def spelled(v: Column) -> Column:
        smudges = F.array(v, swap(v, "OW", "W"), swap(v, "0W", "W"), swap(swap(v, "O", "0"), "0W", "W"))
        return F.flatten(F.transform(smudges, lambda s: F.array(s, swap(s, "O", "0"), swap(s, "0", "O"))))

    return F.when(F.trim(x) != "", F.array_sort(F.array_distinct(once(F.upper(F.trim(x)), spelled))))


def voyage_match(a: Column, b: Column) -> Column:
    """[JN-17] Equal, or at most two edits and fewer than three in ten characters."""
    d = F.levenshtein(a, b)
    return (a == b) | ((d <= 2) & (d / F.greatest(F.length(a), F.length(b)) < 0.3))


def record_key(child: Column, parent: Column, profile: str = "alnum") -> Column:
    """The key of a record. alnum: letters and digits of child or parent; spaceless: without white space, upper case;
    digits: digits of the parent; trimmed: trimmed upper case of the child."""
    either = F.coalesce(blank_to_null(F.trim(child)), blank_to_null(F.trim(parent)))
    if profile == "alnum":
        return blank_to_null(alnum_upper(either))
    if profile == "spaceless":
        return blank_to_null(F.upper(F.regexp_replace(either, "\\s+", "")))
    if profile == "digits":
        return digits(parent)
    return blank_to_null(F.upper(F.trim(child)))


def reference_tokens(*texts: Column) -> Column:
    """[JN-19] Distinct reference-like words of eight or more characters."""
    every = F.flatten(F.array(*[F.regexp_extract_all(F.upper(F.coalesce(t, F.lit(""))), F.lit(r"(\b[A-Z]{2,}[0-9]{4,}[A-Z0-9-]*\b|\b[A-Z0-9]{8,}\b)"), F.lit(1)) for t in texts]))
    return F.array_distinct(F.filter(F.transform(every, lambda t: F.btrim(t, F.lit("-"))), lambda t: F.length(t) >= 8))


#: Size and type codes of equipment, by the three mappings that disagree.
EQUIPMENT = {
    "upload": (("22G", "20DC"), ("42G", "40DC"), ("45G", "40HC"), ("45R", "40RF"), ("22R", "20RF")),
    "invoice": (("20", "20DC"), ("40HC", "40HC"), ("40HQ", "40HC"), ("40", "40DC"), ("45", "45HC")),
    "options": (("HC", "40HC"), ("HQ", "40HC"), ("RF", "40RF"), ("20", "20DC"), ("40", "40DC")),
}


def equipment(x: Column, mapping: str) -> Column:
    """[NUM-14, NUM-15] The equipment code of a text, by one of the mappings; first match wins."""
    t, out = alnum_upper(x), F.lit(None).cast("string")
    for key, code in reversed(EQUIPMENT[mapping]):
        hit = F.startswith(t, F.lit(key)) if mapping != "options" else F.contains(t, F.lit(key))
        out = F.when(hit, code).otherwise(out)
    return out
