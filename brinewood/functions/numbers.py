"""Number columns. One parser with named profiles stands for the parsers that disagree on separators, signs and caps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from brinewood.functions.text import match_text, once

#: Greatest weight in kg, packages and volume in cbm.
CAPS = {"weight": 500_000.0, "packages": 1_000_000.0, "volume": 100_000.0, "any": 100_000_000_000.0}

PROFILES = ("decimal_comma", "plain", "signed", "european", "auto")


def parse_number(x: Column, profile: str = "plain") -> Column:
    """[NUM-01 to NUM-05] The first number in a text as double, null if there is none.

    plain: commas group, a sign is ignored ('-5' is 5). signed: as plain, but negative numbers are null.
    decimal_comma: without a point a comma is decimal; of several commas only the last, if three digits follow it.
    european: points group, the comma is decimal. auto: the last of comma and point is decimal; a lone separator that
    three digits follow groups.
    """
    if profile not in PROFILES:
        raise ValueError(f"no number profile {profile!r}; there are {', '.join(PROFILES)}")
    return once(F.regexp_replace(F.trim(x), " ", ""), lambda t: _read(t, profile))


def _read(t: Column, profile: str) -> Column:
    if profile in ("plain", "signed"):
        n = F.regexp_extract(F.regexp_replace(t, ",", ""), r"(-?[0-9]+(?:\.[0-9]+)?)", 1)
        return once(n.try_cast("double"), lambda v: F.when(v >= 0, v)) if profile == "signed" else F.abs(n.try_cast("double"))
    if profile == "decimal_comma":
        three = t.rlike(",[^,]{3}$")
        last = F.concat(F.regexp_replace(F.regexp_extract(t, "^(.*),[^,]*$", 1), ",", ""), F.lit("."), F.regexp_extract(t, ",([^,]*)$", 1))
        t = F.when(F.contains(t, F.lit(",")) & ~F.contains(t, F.lit(".")), F.when(three, last).otherwise(F.regexp_replace(t, ",", "."))).otherwise(F.regexp_replace(t, ",", ""))
    elif profile == "european":
        t = F.translate(F.regexp_replace(t, r"\.", ""), ",", ".")
    elif profile == "auto":
        comma, point = F.contains(t, F.lit(",")), F.contains(t, F.lit("."))
        comma_last = F.instr(F.reverse(t), ",") < F.instr(F.reverse(t), ".")
        eu, us = F.translate(F.regexp_replace(t, r"\.", ""), ",", "."), F.regexp_replace(t, ",", "")
        lone_group = t.rlike(r"^[^,.]*[0-9]{1,3}(?:[,.][0-9]{3})+(?![0-9])[^,.]*$")
        t = F.when(comma & point, F.when(comma_last, eu).otherwise(us)).when(lone_group, F.regexp_replace(t, "[,.]", "")).when(comma, eu).otherwise(t)
    return F.regexp_extract(t, r"([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")


def capped(x: Column, measure: str = "any") -> Column:
    """[NUM-02, NUM-03] The number if it lies between 0 and the measure's cap."""
    return once(x, lambda v: F.when(v.between(0.0, CAPS[measure]), v))


def tidy(x: Column, places: int = 3) -> Column:
    """[NUM-04] Rounded half to even, as the parsers this stands for do."""
    return F.bround(x, places)


def money(x: Column) -> Column:
    """[NUM-06] An amount of money, without currency marks and group commas, to cents; parentheses make it negative."""
    t = F.regexp_replace(x, r"[^0-9.\-()]", "")
    n = F.regexp_extract(t, r"(-?[0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")
    return F.bround(F.when(t.rlike(r"^\("), -F.abs(n)).otherwise(n), 2)


def cost_values(amount: Column, quantity: Column, price: Column, is_credit: Column) -> tuple[Column, Column]:
    """[NUM-07] (quantity, unit price) in exact decimals: a credit has negative quantity and positive price; where
    rounding to 3 and 2 places would change the amount, the line becomes one unit of the amount."""
    dec = lambda c: c.cast("decimal(24,8)")
    q, p, a = dec(quantity), dec(price), F.abs(dec(amount))
    q2, p2 = F.bround(F.abs(q), 3), F.bround(F.abs(p), 2)
    exact = (q2 == F.abs(q)) & (p2 == F.abs(p)) & (F.bround(q2 * p2, 2) == F.bround(a, 2))
    keep = F.coalesce(exact, F.lit(False))
    sign = F.when(is_credit, -1).otherwise(1)
    return (F.when(keep, q2).otherwise(F.lit(1)) * sign).cast("decimal(24,3)"), F.when(keep, p2).otherwise(F.bround(a, 2)).cast("decimal(24,2)")


def cost_signature(*parts: Column) -> Column:
    """[NUM-08] The identity of a cost line."""
    return F.concat_ws("|", *[F.coalesce(F.upper(F.trim(p.cast("string"))), F.lit("")) for p in parts])


def quantity_signature(description: Column, packages: Column, gross: Column, volume: Column) -> Column:
    """[SET-07] The identity of a cargo row: its measures if it has any, else the start of its description."""
    some = packages.isNotNull() | gross.isNotNull() | volume.isNotNull()
    part = lambda x: F.coalesce(F.bround(x, 3).cast("decimal(20,3)").cast("string"), F.lit(""))
    return F.when(some, F.concat_ws("|", F.lit("Q"), part(packages), part(gross), part(volume))).otherwise(F.concat(F.lit("D|"), F.substring(match_text(F.coalesce(description, F.lit(""))), 1, 120)))


def original_count(x: Column) -> Column:
    """[NUM-13] The stated number of originals."""
    t = F.upper(F.trim(x))
    return F.when(t.isin("0", "0/ZERO", "ZERO", "ZERO (0)"), 0).otherwise(F.regexp_extract(t, r"\b([0-9]+)\b", 1).try_cast("int"))


def recovered_rate(amount: Column, quantity: Column, rates: list[float], tolerance: float = 0.02) -> Column:
    """[AGG-07] The first known rate that gives the amount within tolerance, else null."""
    out = F.lit(None).cast("double")
    for r in reversed(rates):
        out = F.when(F.abs(amount - quantity * r) <= tolerance, r).otherwise(out)
    return out
