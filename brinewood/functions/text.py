
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank_to_null(x: Column) -> Column:
    return F.when(x != "", x)


def once(x: Column, f) -> Column:
    """f(x) with x computed once, however often f uses it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def is_blank(x: Column, profile: str = "plain") -> Column:
    """Null or empty; profile `trimmed` counts white space as blank too."""
    return x.isNull() | ((F.trim(x) if profile == "trimmed" else x) == "")


def normalize_text(x: Column) -> Column:
    """[STR-01] NUL to blank, form feed to newline, blanks collapsed, line edges trimmed, three newlines at most."""
    x = F.translate(x, "\0\f\r", " \n\n")
    x = F.regexp_replace(x, "[ \\t]+", " ")
    x = F.regexp_replace(x, " ?\\n ?", "\n")
    return F.btrim(F.regexp_replace(x, "\\n{4,}", "\n\n\n"), F.lit(" \n"))


def clean_value(x: Column) -> Column:
    """[STR-02] White space collapsed, punctuation stripped from the ends, null if nothing is left."""
    return blank_to_null(F.btrim(F.regexp_replace(x, "\\s+", " "), F.lit(" ,;:-")))


def digits(x: Column) -> Column:
    """[STR-03]"""
    return blank_to_null(F.regexp_replace(x, "[^0-9]", ""))


def alnum_upper(x: Column) -> Column:
    """[STR-04, STR-06, STR-18] ASCII letters and digits alone, upper case."""
    return F.translate(F.regexp_replace(x, "[^A-Za-z0-9]+", ""), "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def match_text(x: Column) -> Column:
    """[STR-05] Runs of other characters to one blank, upper case, trimmed."""
    upper = F.translate(x, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    return F.trim(F.regexp_replace(upper, "[^A-Z0-9]+", " "))


def compact_upper(x: Column) -> Column:
    """[STR-07] White space removed, upper case; dashes and slashes stay."""
    return F.upper(F.regexp_replace(x, "\\s+", ""))


def last_index(x: Column, sep: str) -> Column:
    """0-based place of the last occurrence, -1 if there is none."""
    back = F.instr(F.reverse(x), sep[::-1])
    return F.when(back > 0, F.length(x) - back - len(sep) + 1).otherwise(-1)


def smart_truncate(x: Column, limit: int) -> Column:
    """[STR-09] Cut to `limit`, at the last newline, else sentence, semicolon or comma that lies in the last 40 per cent."""
    head = F.substring(x, 1, limit)
    cut = F.rtrim(head)
    for sep in (", ", "; ", ". ", "\n"):
        at = last_index(head, sep)
        cut = F.when(at >= int(limit * 0.6), F.regexp_replace(F.substring(head, F.lit(1), at), "[ .,;\\n]+$", "")).otherwise(cut)
    return F.when(F.length(x) <= limit, x).otherwise(cut)


def truncate_strict(x: Column, limit: int) -> Column:
    """[STR-12] The variant that takes the farthest of three separators and asks for more than 60 per cent."""
    head = F.substring(x, 1, limit)
    at = F.greatest(*[last_index(head, s) for s in ("\n", ". ", "; ")])
    cut = F.when(at > limit * 0.6, F.regexp_replace(F.substring(head, F.lit(1), at), "[ .,;\\n]+$", "")).otherwise(head)
    return F.when(F.length(x) <= limit, x).otherwise(F.rtrim(cut))


def spill(x: Column, notes: Column, limit: int, notes_limit: int) -> tuple[Column, Column]:
    """[STR-11] (capped, notes): what a capped column loses is added to the notes, unless they hold it already."""
    full, base = F.trim(x), F.trim(F.coalesce(notes, F.lit("")))
    over = F.length(full) > limit
    merged = F.when(base == "", full).otherwise(F.concat(base, F.lit("\n"), full))
    keep = F.coalesce(over, F.lit(False)) & ~F.contains(base, full)
    return F.when(over, smart_truncate(full, limit)).otherwise(x), F.when(keep, smart_truncate(merged, notes_limit)).otherwise(notes)


def with_prefix(x: Column, prefix: str = "S.T.C") -> Column:
    """[STR-13] The prefix on a line of its own, once, however often this is applied."""
    rest = F.trim(F.regexp_replace(F.trim(x), r"(?i)^\s*S\.?\s*T\.?\s*C\.?\s*[:\-]?\s*", ""))
    return F.when(F.trim(x) != "", F.when(rest == "", F.lit(prefix)).otherwise(F.concat(F.lit(prefix + "\n"), rest)))


#: Delivery terms.
INCOTERMS = ("EXW", "FCA", "FAS", "FOB", "CFR", "CIF", "CPT", "CIP", "DAP", "DPU", "DDP", "DAT", "DAF", "DES", "DEQ", "DDU")


def incoterm(x: Column) -> Column:
    """[STR-14] The first delivery term as a word, else the trimmed text."""
    code = F.regexp_extract(F.upper(x), rf"\b({'|'.join(INCOTERMS)})\b", 1)
    return F.when(code != "", code).otherwise(blank_to_null(F.trim(x)))


#: Marks of a country in an address, first match wins.
COUNTRY_MARKS = (("Egypt", ("EGYPT", "EG ", ", EG")), ("India", ("INDIA", ", IN", " U.P)")), ("China", ("CHINA", ", CN")), ("Turkey", ("TURKEY", ", TR")))


def country(x: Column, marks=COUNTRY_MARKS) -> Column:
    """[STR-15]"""
    text, out = F.upper(x), F.lit(None).cast("string")
    for name, words in reversed(marks):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(text, F.lit(w))
        out = F.when(hit, name).otherwise(out)
    return out


def cell_text(x: Column, limit: int = 500) -> Column:
    """[STR-16] A cell as text: whole floats without fraction, white space collapsed, capped with an ellipsis."""
    number = F.when(x.rlike(r"^-?[0-9]+\.0+$"), F.regexp_replace(x, r"\.0+$", "")).otherwise(x)
    flat = F.trim(F.regexp_replace(number, "\\s+", " "))
    return F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit), F.lit("..."))).otherwise(flat)


def column_index(ref: Column) -> Column:
    """[STR-17] 1-based column of a cell reference such as BC12."""
    letters = F.split(F.regexp_extract(F.upper(ref), "^([A-Z]+)", 1), "")
    places = F.filter(letters, lambda c: c != "")
    return F.aggregate(places, F.lit(0), lambda acc, c: acc * 26 + F.ascii(c) - 64)


def column_name(index: Column, width: int = 7) -> Column:
    """[STR-17] The letters of a 1-based column."""
    step = F.aggregate(
        F.sequence(F.lit(1), F.lit(width)),
        F.struct(index.cast("int").alias("n"), F.lit("").alias("out")),
        lambda acc, _: F.struct(
            F.floor((acc["n"] - 1) / 26).cast("int").alias("n"),
            F.when(acc["n"] > 0, F.concat(F.char(((acc["n"] - 1) % 26 + 65).cast("long")), acc["out"])).otherwise(acc["out"]).alias("out"),
        ),
    )
    return step["out"]


def union_codes(*values: Column, out: str = "|", keep: str | None = None) -> Column:
    """[SET-04] Distinct codes of delimited lists in order of appearance; `keep` is a pattern that codes have to match."""
    codes = F.flatten(F.array(*[F.split(F.coalesce(v, F.lit("")), r"[\s,;|/]+") for v in values]))
    codes = F.filter(codes, lambda c: (c != "") & (c.rlike(keep) if keep else F.lit(True)))
    return blank_to_null(F.array_join(F.array_distinct(codes), out))


def merge_notes(existing: Column, additions: Column) -> Column:
    """[SET-05] Lines of both, longest first, without those that a kept line contains; compared by letters and digits."""
    lines = F.filter(F.concat(F.split(F.coalesce(existing, F.lit("")), "\n"), F.split(F.coalesce(additions, F.lit("")), "\n")), lambda x: F.trim(x) != "")
    keyed = F.transform(lines, lambda x, i: F.struct((-F.length(alnum_upper(x))).alias("n"), i.alias("i"), alnum_upper(x).alias("k"), F.trim(x).alias("line")))
    kind = "array<struct<n:int,i:int,k:string,line:string>>"
    kept = F.aggregate(
        F.array_sort(keyed),
        F.array().cast(kind),
        lambda acc, x: F.when(F.exists(acc, lambda y: F.contains(y["k"], x["k"])), acc).otherwise(F.concat(acc, F.array(x)).cast(kind)),
    )
    back = F.array_sort(F.transform(kept, lambda y: F.struct(y["i"].alias("i"), y["line"].alias("line"))))
    return blank_to_null(F.array_join(F.transform(back, lambda y: y["line"]), "\n"))


def merge_descriptions(existing: Column, other: Column) -> Column:
    """[SET-06] The text whose words contain all of the other's; if neither does, both, without repeated lines."""
    words = lambda x: F.array_distinct(F.filter(F.split(match_text(F.coalesce(x, F.lit(""))), " "), lambda w: w != ""))
    both = F.array_join(F.array_distinct(F.concat(F.split(existing, "\n"), F.split(other, "\n"))), "\n")
    return (
        F.when(is_blank(existing, "trimmed"), other)
        .when(is_blank(other, "trimmed"), existing)
        .when(F.size(F.array_except(words(other), words(existing))) == 0, existing)
        .when(F.size(F.array_except(words(existing), words(other))) == 0, other)
        .otherwise(both)
    )


def longer(*values: Column) -> Column:
    """[WIN-05] The longest of the values, the first of several."""
    ranked = F.array(*[F.struct(F.length(F.coalesce(v, F.lit(""))).alias("n"), F.lit(-i).alias("i"), v.alias("v")) for i, v in enumerate(values)])
    return F.array_max(ranked)["v"]


def safe_name(x: Column, limit: int = 140) -> Column:
    """[STR-25] A file name of letters, digits, dot, dash and underscore."""
    base = F.regexp_replace(F.regexp_extract(x, r"([^/\\]*)$", 1), "[^A-Za-z0-9._-]+", "_")
    return F.when(base == "", "upload").otherwise(F.substring(base, 1, limit))


def file_stem_reference(x: Column) -> Column:
    """[STR-24] The first run of letters and digits with at least four digits in a file name, without its extension."""
    stem = F.regexp_replace(F.regexp_extract(x, r"([^/\\]*)$", 1), r"\.[^.]*$", "")
    return blank_to_null(F.regexp_extract(F.upper(stem), r"([A-Z]*[0-9]{4,}[A-Z0-9]*)", 1))


def chunk_pack(units: Column, limit: int) -> Column:
    """[STR-23] Array of chunks: units are packed in order while a chunk stays within `limit`; a longer unit is sliced."""
    pieces = F.flatten(F.transform(units, lambda u: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length(u) - 1) / limit).cast("int"))), lambda i: F.substring(u, i * limit + 1, F.lit(limit)))))
    done = F.aggregate(
        pieces,
        F.struct(F.array().cast("array<string>").alias("out"), F.lit(None).cast("string").alias("open")),
        lambda acc, p: F.when(
            acc["open"].isNotNull() & (F.length(acc["open"]) + 1 + F.length(p) <= limit),
            F.struct(acc["out"].alias("out"), F.concat(acc["open"], F.lit("\n"), p).alias("open")),
        ).otherwise(F.struct(F.when(acc["open"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["open"]))).alias("out"), p.alias("open"))),
    )
    return F.when(done["open"].isNull(), done["out"]).otherwise(F.concat(done["out"], F.array(done["open"])))


def token_overlap(a: Column, b: Column) -> Column:
    """Shared words of three or more characters over the larger word count; 0 if either has none."""
    words = lambda x: F.array_distinct(F.regexp_extract_all(match_text(x), F.lit("([A-Z0-9]{3,})"), F.lit(1)))
    most = F.greatest(F.size(words(a)), F.size(words(b)))
    return F.when(most > 0, F.size(F.array_intersect(words(a), words(b))) / most).otherwise(0.0)
