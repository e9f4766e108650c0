"""Matching of new lines with lines that exist, one to one, by a ladder of rules."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@dataclass(frozen=True)
class Rule:
    """A step of the ladder: lines match if the columns of `new` equal those of `old`, one by one, and `old_if` holds. A null
    matches nothing."""

    name: str
    new: Sequence[Column] = field(default_factory=tuple)
    old: Sequence[Column] = field(default_factory=tuple)
    old_if: Column | None = None


def match_lines(new: DataFrame, old: DataFrame, keys: Sequence[str], rules: Sequence[Rule], *, new_id: str, old_id: str, oldest: Sequence[str | Column]) -> DataFrame:
    """[JN-21] (new_id, old_id, rule): every new line with at most one old line and the other way round.

    All matches need equal `keys`. The rules are tried in order, the strongest first, on what the ones before left; within
    a rule and key the k-th new line (by new_id) takes the k-th oldest line, so no line is consumed twice and all that can
    match do. Lines with a null key, and lines left over, are in no row. Ids name lines and are unique.
    """
    out = None
    fresh = new.where(_all(F.col(k).isNotNull() for k in keys))
    kept = old.where(_all(F.col(k).isNotNull() for k in keys))
    for rule in rules:
        names = [f"_k{i}" for i in range(len(keys) + len(rule.new))]

        def numbered(df: DataFrame, own: Sequence[Column], line: str, order: list, names=names) -> DataFrame:
            keyed = df.select(F.col(line), *[F.col(k).alias(n) for k, n in zip(keys, names, strict=False)], *[c.alias(n) for c, n in zip(own, names[len(keys) :], strict=True)], *[c.alias(f"_o{i}") for i, c in enumerate(order)])
            keyed = keyed.where(_all(F.col(n).isNotNull() for n in names))
            place = Window.partitionBy(*names).orderBy(*[f"_o{i}" for i in range(len(order))], line)
            return keyed.select(line, *names, F.row_number().over(place).alias("_nth"))

        a = numbered(fresh, rule.new, new_id, [])
        order = [F.col(c) if isinstance(c, str) else c for c in oldest]
        b = numbered(kept if rule.old_if is None else kept.where(rule.old_if), rule.old, old_id, order)
        found = a.join(b, [*names, "_nth"]).select(new_id, old_id, F.lit(rule.name).alias("rule"))
        out = found if out is None else out.unionByName(found)
        fresh, kept = fresh.join(found, new_id, "left_anti"), kept.join(found, old_id, "left_anti")
    return out


def _all(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def posting_rules() -> list[Rule]:
    """The ladder of cost lines: a line's own source key in the comments; lines from before source keys, the oldest first;
    quantity to 2 and unit price to 3 places."""
    two, three = (lambda c: F.bround(F.col(c).cast("double"), 2)), (lambda c: F.bround(F.col(c).cast("double"), 3))
    return [
        Rule("source_key", [F.col("source_key")], [F.regexp_extract("comments", r"^(Invoice line \S+)", 1)], F.col("comments").rlike(r"^Invoice line \S")),
        Rule("unkeyed", (), (), ~F.coalesce(F.startswith("comments", F.lit("Invoice line ")), F.lit(False))),
        Rule("rounded", [two("quantity"), three("unit_price")], [two("quantity"), three("unit_price")]),
    ]
