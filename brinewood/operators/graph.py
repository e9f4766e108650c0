"""Entity graphs: find or create with surrogate keys that follow from natural ones, load order from relationships, and
writes that mend themselves within bounds."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@dataclass(frozen=True)
class Level:
    """An entity: its natural key, which begins with its parent's (`parent_key`, in the order of the parent's own key), and
    what else it writes: scalars, and lookups whose null leaves what is stored as it is."""

    entity: str
    key: Sequence[str]
    parent: str | None = None
    parent_key: Sequence[str] = ()
    scalars: Sequence[str] = ()
    lookups: Sequence[str] = ()


def surrogate(entity: str, parent_id: Column, key: Sequence[Column]) -> Column:
    """An id that follows from the entity, the parent's id and the natural key, so that a second writer makes the same one."""
    parts = [F.lit(entity), F.coalesce(parent_id, F.lit(""))]
    for k in key:
        text = k.cast("string")
        parts += [F.length(text).cast("string"), text]
    h = F.sha2(F.concat_ws(":", *parts), 256)
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def _names(levels: Sequence[Level]) -> dict[str, dict[str, str]]:
    """For each entity its key columns by the names they have in a graph's frame: a child's begin with its parent's."""
    out: dict[str, dict[str, str]] = {}
    keys = {level.entity: level.key for level in levels}
    for level in levels:
        above = out.get(level.parent, {})
        own = dict(zip(level.parent_key, (above[k] for k in keys.get(level.parent, ())), strict=True))
        out[level.entity] = own | {k: f"_k_{level.entity}_{k}" for k in level.key if k not in own}
    return out


def _value(level: Level, column: str) -> str:
    return f"_v_{level.entity}_{column}"


def together(levels: Sequence[Level], inputs: Sequence[dict[str, DataFrame]], stored: dict[str, DataFrame]) -> DataFrame:
    """One frame of a graph: rows of the inputs, numbered from 0 as `_run`, and of what is stored (`_run` is null), for `write`.

    Levels have one root. Rows are dealt by the root's key and sorted by all keys once; all that `write` does keeps that
    place and order, so any number of writes moves no row again. Rows without a key part are left out of the inputs.
    """
    names, parts = _names(levels), []
    for level in levels:
        values = [*level.scalars, *level.lookups]
        named = [F.col(k).alias(n) for k, n in names[level.entity].items()]
        held = [F.col(c).alias(_value(level, c)) for c in values]
        for run, rows in enumerate(inputs):
            if level.entity in rows:
                whole = rows[level.entity].dropna(subset=list(names[level.entity]))
                parts.append(whole.select(F.lit(level.entity).alias("_entity"), F.lit(run).alias("_run"), *named, *held))
        if level.entity in stored:
            there = stored[level.entity]
            more = [c for c in there.columns if c not in ("id", "parent_id", "action", *names[level.entity], *values)]
            parts.append(there.select(F.lit(level.entity).alias("_entity"), *named, *held, "id", "parent_id", *more))
    frame = parts[0]
    for part in parts[1:]:
        frame = frame.unionByName(part, allowMissingColumns=True)
    lacking = {"_run": "int", "id": "string", "parent_id": "string"} | {_value(level, c): "string" for level in levels for c in (*level.scalars, *level.lookups)}
    frame = frame.withColumns({c: F.lit(None).cast(kind) for c, kind in lacking.items() if c not in frame.columns} | {"action": F.lit(None).cast("string")})
    keys = list(dict.fromkeys(n for level in levels for n in names[level.entity].values()))
    spark = frame.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return frame.repartition(n, keys[0]).withColumn("_row", F.monotonically_increasing_id()).sortWithinPartitions(*keys)


def write(levels: Sequence[Level], frame: DataFrame, run: int = 0) -> DataFrame:
    """The frame after one of its inputs has been written: see `resolve`. Stored rows have `action`; the inputs stay as they are."""
    names = _names(levels)
    more = [c for c in frame.columns if not c.startswith("_") and c not in ("id", "parent_id", "action")]
    for level in levels:
        keys, mine = names[level.entity], F.col("_entity") == level.entity
        coming, old = mine & F.coalesce(F.col("_run") == run, F.lit(False)), mine & F.col("_run").isNull()
        above, columns = F.coalesce("parent_id", F.lit("")), frame.columns
        if level.parent is None:
            frame = frame.withColumn("_to", F.array(F.lit("")))
        else:
            parent = (F.col("_entity") == level.parent) & F.col("_run").isNull()
            frame = frame.withColumn("_to", F.collect_list(F.when(parent, F.col("id"))).over(Window.partitionBy(*[keys[k] for k in level.parent_key])))
        same = Window.partitionBy(*keys.values())
        values = {c: _value(level, c) for c in (*level.scalars, *level.lookups)}
        merged = {f"_m{v}": F.min(F.when(coming, F.col(v))).over(same) for v in values.values()}
        frame = frame.withColumns({"_first": F.min(F.when(coming, F.col("_row"))).over(same), "_olds": F.collect_set(F.when(old, above)).over(same), **merged})
        alone = F.array(F.lit(None).cast("string"))
        frame = frame.withColumn("_new", F.explode(F.when(coming & (F.col("_row") == F.col("_first")), F.concat(alone, F.array_except("_to", "_olds"))).otherwise(alone)))
        frame = frame.sortWithinPartitions(*[c for c in columns if c.startswith("_k_")])  # an order that explode has lost to the planner
        new = F.col("_new").isNotNull()
        found = ~new & old & F.col("_first").isNotNull() & F.array_contains("_to", above)
        unnamed = new | (old & F.col("id").isNull())
        out, changed = {}, F.lit(False)
        for c, v in values.items():
            kept = F.coalesce(f"_m{v}", v) if c in level.lookups else F.col(f"_m{v}")
            changed = changed | ~kept.eqNullSafe(F.col(v))
            out[v] = F.when(new, F.col(f"_m{v}")).when(found, kept).otherwise(F.col(v))
        under = F.when(new, F.nullif("_new", F.lit(""))).otherwise(F.col("parent_id"))
        out |= {
            "id": F.when(unnamed, surrogate(level.entity, under, [F.col(keys[k]) for k in level.key if k not in level.parent_key])).otherwise(F.col("id")),
            "parent_id": under,
            "action": F.when(unnamed, "created").when(found, F.when(changed, "updated").otherwise("same")).when(old, "kept").otherwise(F.col("action")),
            "_run": F.when(~new, F.col("_run")),
            **{c: F.when(~new, F.col(c)) for c in more},
        }
        frame = frame.select(*[out[c].alias(c) if c in out else F.col(c) for c in columns])
    return frame


def rows_of(levels: Sequence[Level], frame: DataFrame, entity: str) -> DataFrame:
    """(id, parent_id, key..., scalars..., lookups..., action, ...) of an entity's stored rows in a frame."""
    level = next(x for x in levels if x.entity == entity)
    more = [c for c in frame.columns if not c.startswith("_") and c not in ("id", "parent_id", "action")]
    rows = frame.where((F.col("_entity") == entity) & F.col("_run").isNull())
    names = _names(levels)[entity]
    return rows.select("id", "parent_id", *[F.col(names[k]).alias(k) for k in level.key], *[F.col(_value(level, c)).alias(c) for c in (*level.scalars, *level.lookups)], "action", *more)


def resolve(levels: Sequence[Level], incoming: dict[str, DataFrame], stored: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """[SNK-01, SNK-03] For each entity the rows (id, parent_id, key..., scalars..., lookups..., action) that a write leaves it:
    parents first, each child under the id that its parent has, found or new.

    stored(id, parent_id, key..., scalars..., lookups...) is what is there: a row with the same parent and natural key is
    found, however it came by its id, and keeps it; others are created. Rows of one key are one row, first values in the
    order of the columns that aren't null. action: created, updated (a value differs), same, or kept (not in the input).
    Rows without a key part or without a known parent are orphans and written nowhere; see `orphans`. A second run of the
    same input creates and updates nothing. To write more than once, keep the frame (`together`, `write`): it is moved once.
    """
    own = {level.entity: {c for c in ("id", "parent_id", *level.key, *level.scalars, *level.lookups)} for level in levels}
    there = {k: v.select(*[c for c in v.columns if c in own[k]]) for k, v in stored.items() if k in own}
    out: dict[str, DataFrame] = {}
    for root in [level for level in levels if level.parent is None]:
        under, tree = {root.entity}, []
        for level in levels:
            if level is root or level.parent in under:
                under.add(level.entity)
                tree.append(level)
        frame = write(tree, together(tree, [{k: v for k, v in incoming.items() if k in under}], {k: v for k, v in there.items() if k in under}))
        out |= {level.entity: rows_of(tree, frame, level.entity) for level in tree}
    return out


def _placed(level: Level, rows: DataFrame, done: dict[str, DataFrame], by_name: dict[str, Level]) -> DataFrame:
    """rows with the parent's id and `_ok`, whether they can be written."""
    complete = F.lit(True)
    for k in level.key:
        complete = complete & F.col(k).isNotNull()
    if level.parent is None:
        return rows.withColumn("parent_id", F.lit(None).cast("string")).withColumn("_ok", complete)
    natural = by_name[level.parent].key
    parents = done[level.parent].select(F.col("id").alias("parent_id"), *[F.col(c).alias(f"_p{i}") for i, c in enumerate(natural)])
    on = F.lit(True)
    for i, c in enumerate(level.parent_key):
        on = on & (F.col(c) == F.col(f"_p{i}"))
    joined = rows.join(parents, on, "left").drop(*[f"_p{i}" for i in range(len(natural))])
    return joined.withColumn("_ok", complete & F.col("parent_id").isNotNull())


def orphans(levels: Sequence[Level], entity: str, rows: DataFrame, done: dict[str, DataFrame]) -> DataFrame:
    """The rows of an entity that `resolve` wrote nowhere: without a key part, or under no known parent."""
    by_name = {level.entity: level for level in levels}
    return _placed(by_name[entity], rows, done, by_name).where(~F.coalesce("_ok", F.lit(False))).drop("_ok")


def load_order(entities: DataFrame, relations: DataFrame, most: int = 100) -> DataFrame:
    """[SRC-14] (entity, level, cyclic): level 0 has no parents, every other entity is one above its highest parent; an
    entity in a cycle, or above one, has no level and is cyclic.

    entities(entity), relations(child, parent). A relation of an entity to itself or to an unknown one doesn't count. Each
    round places the entities whose parents all are placed; rounds end when none is, or after `most`. The catalog is a
    table of names, so only its levels and a count per round come to the driver.
    """
    known = entities.select("entity").distinct()
    edges = relations.where("child <> parent").join(known, F.col("parent") == F.col("entity"), "left_semi").select("child", "parent").distinct()
    edges, placed = edges.cache(), None
    done = known.join(edges, F.col("entity") == F.col("child"), "left_anti").select("entity", F.lit(0).alias("level"))
    n = -1
    for level in range(1, most + 1):
        # the catalog's levels so far are written down as rows, which cuts the plan
        rows = done.collect()
        if len(rows) == n:
            break
        n = len(rows)
        placed = entities.sparkSession.createDataFrame(rows, "entity string, level int")
        waiting = known.join(placed, "entity", "left_anti")
        open_ = edges.join(placed, F.col("parent") == placed["entity"], "left_anti").select(F.col("child").alias("_c")).distinct()
        ready = waiting.join(open_, F.col("entity") == F.col("_c"), "left_anti").select("entity", F.lit(level).alias("level"))
        done = placed.unionByName(ready)
    return known.join(placed, "entity", "left").select("entity", "level", F.col("level").isNull().alias("cyclic"))


def self_repair(rows: DataFrame, key: str, rules: dict[str, tuple[str, int | None, bool]]) -> DataFrame:
    """[SNK-02] (key, written, repaired, rejects, accepted) of rows against the constraints of a store: for each column its
    kind, longest text and whether it is required.

    As a store would refuse one column after another, so each is mended in at most two steps: a text that is too long is
    cut, a value that the kind can't take is dropped. `repaired` lists (field, step, was), `rejects` the dropped values; a
    row whose required column is missing or was dropped is not accepted, and is returned all the same. written is a map of
    the columns' texts. Columns without a rule are written as they are.
    """
    steps, rejects, written, needed = [], [], [], []
    for c in [c for c in rows.columns if c != key]:
        kind, most, required = rules.get(c, ("string", None, False))
        text = F.col(c).cast("string")
        fits = text if kind == "string" else text.try_cast(kind).cast("string")
        cut = F.substring(fits, 1, most) if most else fits
        too_long = F.coalesce(F.length(fits) > most, F.lit(False)) if most and kind == "string" else F.lit(False)
        value = cut if kind == "string" else F.when(F.length(fits) <= most, fits) if most else fits
        dropped = text.isNotNull() & value.isNull()
        steps.append(F.when(too_long, F.struct(F.lit(c).alias("field"), F.lit("cut").alias("step"), text.alias("was"))).when(dropped, F.struct(F.lit(c).alias("field"), F.lit("dropped").alias("step"), text.alias("was"))))
        rejects.append(F.when(dropped, F.struct(F.lit(c).alias("field"), text.alias("value"))))
        written += [F.lit(c), value]
        if required:
            needed.append(value.isNotNull())
    accepted = F.lit(True)
    for n in needed:
        accepted = accepted & n
    return rows.select(key, F.map_filter(F.create_map(*written), lambda _, v: v.isNotNull()).alias("written"), F.array_compact(F.array(*steps)).alias("repaired"), F.array_compact(F.array(*rejects)).alias("rejects"), accepted.alias("accepted"))
