"""Conversation structure repair by weighted finite-state composition.

Three machines: an acceptor of a conversation's rows (one symbol a row: role initial and fault), a transducer of edits
(keep, rerole, delete, insert, with costs), and an acceptor of role grammars, (s?(ua)+)?. Their composition is walked
lazily, state by state from the start, and is acyclic: a state is (row, insertions since the last row, grammar state),
and no more than two insertions in one gap can be on a cheapest path, as a third would come back to a grammar state. One
pass against the topological order gives the path of least weight (cost, edit initials), compared lexicographically.

A conversation may hold any share of the rows. Rows are dealt by ranges of (conversation, turn) and cut into blocks; of
a block of a longer conversation, the best paths between all pairs of grammar states are found, and these matrices are
chained. Only what is one value by contract, a conversation's audit, is as long as the conversation; the digest of its
repaired text is taken block by block.

Cases: null roles and texts count as one space, and a null conversation or turn as one space where damage is dealt; rows
without conversation are one conversation; rows of a null turn come first, rows of one turn by role, then text, so that
repeated rows are neighbours and duplicates; empty texts are blank; very long texts make smaller blocks; ties of cost go
to the least string; other columns of the table are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from brinewood.llm.common import materialize, process_cache, small_batches, table

SPACE = " \t\n\x0b\x0c\r"
ROLES = {"u": "user", "a": "assistant"}
#: Grammar states: before all, after s, after u, after a.
GRAMMAR = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ACCEPTS = (True, False, False, True)
KEEP, REROLE, DELETE, INSERT = "KRDI"
COST = {KEEP: 0, REROLE: 3, DELETE: 4, INSERT: 3}
TRUNCATED_COST = 3
#: Insertions in one gap that a cheapest path can hold.
MOST_INSERTS = 2
#: Rows and characters of a block.
BLOCK, BLOCK_CHARS = 1024, 4_000_000
#: A row that has to be deleted. Other symbols: role initial (s, u, a, else o), in upper case if the row is truncated.
GONE = "x"
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
FOUND = "struct<gaps:bigint,blank:bigint,duplicate:bigint,truncated:bigint,illegal:bigint,cost:bigint,audit:string>"


# --- the machines


def edits(symbol: str) -> tuple[tuple[str, str, int], ...]:
    """The transducer's arcs (edit, output or none, cost) for a row."""
    if symbol == GONE:
        return ((DELETE, "", COST[DELETE]),)
    more = TRUNCATED_COST if symbol.isupper() else 0
    return ((DELETE, "", COST[DELETE]), (KEEP, symbol.lower(), COST[KEEP] + more), *((REROLE, r, COST[REROLE] + more) for r in ROLES))


ARCS = {s: edits(s) for s in "suaoSUAO" + GONE}
INSERTS = tuple((INSERT, r, COST[INSERT]) for r in ROLES)


class Composition:
    """The composed machine over some rows, from a grammar state; `end` is a grammar state to stop in right after the last
    row, or None to stop in any accepting state, with insertions after the last row."""

    def __init__(self, symbols: str, end: int | None = None) -> None:
        self.symbols, self.end = symbols, end

    def final(self, state: tuple[int, int, int]) -> bool:
        row, inserted, q = state
        if row < len(self.symbols):
            return False
        return ACCEPTS[q] if self.end is None else q == self.end and not inserted

    def arcs(self, state: tuple[int, int, int]) -> Iterator[tuple[str, int, tuple[int, int, int]]]:
        row, inserted, q = state
        more = row < len(self.symbols)
        if inserted < MOST_INSERTS and (more or self.end is None):
            for label, out, cost in INSERTS:
                if out in GRAMMAR[q]:
                    yield label, cost, (row, inserted + 1, GRAMMAR[q][out])
        if more:
            for label, out, cost in ARCS[self.symbols[row]]:
                if not out:
                    yield label, cost, (row + 1, 0, q)
                elif out in GRAMMAR[q]:
                    yield label, cost, (row + 1, 0, GRAMMAR[q][out])

    def best(self, starts: list[int]) -> list[tuple[int, str] | None]:
        """(cost, edit initials) of the least path from each start.

        Strings are never built on the way: states of one layer (row, insertions) carry the rank of their best string
        within it, and equal first labels lead to one layer, so (cost, label, rank of the next) orders all choices.
        """
        layers: dict[tuple[int, int], dict[int, list]] = {(0, 0): {q: [] for q in starts}}
        order = []
        for row in range(len(self.symbols) + 1):
            for inserted in range(MOST_INSERTS + 1):
                layer = layers.get((row, inserted))
                if layer is None:
                    continue
                order.append((row, inserted))
                for q, out in layer.items():
                    for arc in self.arcs((row, inserted, q)):
                        out.append(arc)
                        layers.setdefault(arc[2][:2], {}).setdefault(arc[2][2], [])
        done: dict[tuple[int, int, int], tuple[int, int, str, tuple | None]] = {}
        for at in reversed(order):
            chosen = {}
            for q, out in layers[at].items():
                ways = [(cost + done[to][0], label, done[to][1], to) for label, cost, to in out if to in done]
                if self.final((*at, q)):
                    ways.append((0, "", 0, None))
                if ways:
                    chosen[q] = min(ways, key=lambda w: w[:3])
            ranks = {key: i for i, key in enumerate(sorted({w[1:3] for w in chosen.values()}))}
            for q, (cost, label, rank, to) in chosen.items():
                done[(*at, q)] = (cost, ranks[label, rank], label, to)
        return [self._read(done, (0, 0, q)) for q in starts]

    @staticmethod
    def _read(done: dict, state: tuple | None) -> tuple[int, str] | None:
        if state not in done:
            return None
        cost, labels = done[state][0], []
        while state is not None:
            _, _, label, state = done[state]
            labels.append(label)
        return cost, "".join(labels)


def least(symbols: str) -> tuple[int, str]:
    """(cost, audit) of a whole conversation; the worker keeps what it has found for short ones."""
    kept = process_cache("repairs")
    if symbols not in kept:
        found = Composition(symbols).best([0])[0]
        if len(symbols) > 32:
            return found
        if len(kept) >= 100_000:
            kept.clear()
        kept[symbols] = found
    return kept[symbols]


def matrix(symbols: str) -> list[tuple[int, str] | None]:
    """Least paths between all grammar states (from, to), row by row."""
    by_end = [Composition(symbols, q).best(list(range(len(GRAMMAR)))) for q in range(len(GRAMMAR))]
    return [by_end[to][q] for q in range(len(GRAMMAR)) for to in range(len(GRAMMAR))]


def chained(matrices: list[list[tuple[int, str] | None]]) -> tuple[int, list[tuple[int, str]]]:
    """Cost and (first grammar state, edits) of each block, and last of the insertions after all rows."""
    n = len(GRAMMAR)
    rest = Composition("").best(list(range(n)))
    picks = []
    for m in reversed(matrices):
        ways = [[(m[q * n + to][0] + rest[to][0], m[q * n + to][1] + rest[to][1], to) for to in range(n) if m[q * n + to] and rest[to]] for q in range(n)]
        best = [min(w) if w else None for w in ways]
        picks.append([(b[2], m[q * n + b[2]][1]) if b else None for q, b in enumerate(best)])
        rest = [b[:2] if b else None for b in best]
    q, out = 0, []
    for pick in reversed(picks):
        to, labels = pick[q]
        out.append((q, labels))
        q = to
    return rest[0][0], [*out, (q, Composition("").best([q])[0][1])]


def replay(labels: str, symbols: str, q: int, roles: list[str], texts: list[str]) -> tuple[list[str], list[str]]:
    """Roles and texts after the edits, from grammar state q. What rerole and insert write follows from the state."""
    rows = iter(zip(symbols, roles, texts, strict=True))
    out_roles, out_texts = [], []
    for label in labels:
        symbol, role, text = ("", "", "") if label == INSERT else next(rows)
        if label == DELETE:
            continue
        out = symbol.lower() if label == KEEP else next(r for r in ROLES if r in GRAMMAR[q])
        q = GRAMMAR[q][out]
        out_roles.append(role if label == KEEP else ROLES[out])
        out_texts.append(text)
    return out_roles, out_texts


# --- faults of rows in order


def key_of(role: str, text: str) -> bytes:
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()


def key_column(role: Column, text: Column) -> Column:
    return F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))


def symbols_of(roles: list[str], texts: list[str], seen: set[bytes]) -> tuple[str, int, int, int]:
    """(symbols, blank, duplicate, truncated) of rows in order; `seen` holds the keys of earlier rows and is added to."""
    out, blank, duplicate, truncated = [], 0, 0, 0
    for role, text in zip(roles, texts, strict=True):
        end = text.rstrip(SPACE)[-1:]
        if not end:
            blank += 1
            out.append(GONE)
            continue
        if (key := key_of(role, text)) in seen:
            duplicate += 1
            out.append(GONE)
            continue
        seen.add(key)
        symbol = role[:1] if role[:1] in ("s", "u", "a") else "o"
        if end not in ".!?":
            truncated += 1
            symbol = symbol.upper()
        out.append(symbol)
    return "".join(out), blank, duplicate, truncated


def illegal_pairs(initials: list[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))


def gaps_of(turns: list[int | None]) -> int:
    known = {t for t in turns if t is not None}
    return max(known) - min(known) + 1 - len(known) if known else 0


# --- Spark


def damage(conversations: DataFrame) -> DataFrame:
    """(conv, turn, role, text) after the dealt damage: by crc32 of `conv_id:turn` mod 20, 0 drops a row, 1 empties its
    text, 2 takes its marks of an end, 3 repeats it and 4 makes it the user's."""
    blank = lambda c: F.coalesce(c, F.lit(" "))
    at = F.concat(blank(F.col("conv_id").cast("string")), F.lit(":"), blank(F.col("turn").cast("string")))
    kind = F.crc32(at.cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(blank(F.col("text")), ".!?", "")).otherwise(blank(F.col("text")))
    role = F.when(kind == 4, "user").otherwise(blank(F.col("role")))
    times = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    rows = conversations.select(F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), times.alias("times"))
    return rows.where("times > 0").select("conv", "turn", "role", "text", F.explode(F.array_repeat(F.lit(0), F.col("times"))).alias("_")).drop("_")


def blocks_of(rows: DataFrame, block: int, block_chars: int) -> DataFrame:
    """rows(conv, turn, role, text) -> written (conv, bid, whole, turns, roles, texts): blocks of consecutive rows of one
    conversation, in the order of bid; whole: the block is its conversation."""
    spark = rows.sparkSession
    small_batches(spark)
    order = [F.asc_nulls_first("conv"), F.asc_nulls_first("turn"), "role", "text"]
    parts = max(1, -(-rows.count() // (4 * block)))
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(F.spark_partition_id().cast("long").alias("part"), "conv", "turn", "role", "text")
    conv_type = rows.schema["conv"].dataType
    names = ["conv", "bid", "whole", "turns", "roles", "texts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: list[tuple] = []
        conv, held, chars, first, split, number, kind = None, None, 0, True, False, 0, None

        def close(part: int, whole: bool) -> None:
            nonlocal held, chars, number
            turns, roles, texts = zip(*held, strict=True)
            ready.append((conv, (part << 32) + number, whole, turns, roles, texts))
            number, held, chars = number + 1, [], 0

        def given() -> pa.RecordBatch:
            types = (kind, pa.int64(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string()))
            columns = [pa.array(c, t) for c, t in zip(zip(*ready, strict=True), types, strict=True)]
            ready.clear()
            return pa.RecordBatch.from_arrays(columns, names)

        part = 0
        for batch in batches:
            kind = batch.column(1).type
            size = 0
            for part, c, turn, role, text in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if held is not None and c != conv:
                    close(part, not first and not split)
                    first, split, held = False, False, None
                if held is None:
                    conv, held = c, []
                elif len(held) >= block or chars >= block_chars:
                    close(part, False)
                    split = True
                held.append((turn, role, text))
                chars += len(text)
                size += len(text)
                if size >= 4 * block_chars and ready:
                    size = 0
                    yield given()
            if ready:
                yield given()
        if held:
            close(part, False)
            yield given()

    many = T.ArrayType(T.StringType())
    schema = T.StructType().add("conv", conv_type).add("bid", "long").add("whole", "boolean").add("turns", T.ArrayType(T.LongType())).add("roles", many).add("texts", many)
    return materialize(dealt.mapInArrow(run, schema), "turn-blocks")


def whole_repaired(blocks: DataFrame) -> DataFrame:
    """Blocks that are their conversations -> (conv, bid, roles, texts, found), repaired."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for turns, roles, texts in zip(*(batch.column(k).to_pylist() for k in ("turns", "roles", "texts")), strict=True):
                symbols, *faults = symbols_of(roles, texts, set())
                cost, audit = least(symbols)
                counts = (gaps_of(turns), *faults, illegal_pairs([r[:1] for r in roles]), cost)
                out.append((*replay(audit, symbols, 0, roles, texts), dict(zip(COUNTS, counts, strict=True)) | {"audit": audit}))
            yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("bid"), *_columns(out)], ["conv", "bid", "roles", "texts", "found"])

    return blocks.mapInArrow(run, _repaired_schema(blocks))


def _columns(out: list[tuple]) -> list[pa.Array]:
    kind = pa.struct([*((k, pa.int64()) for k in COUNTS), ("audit", pa.string())])
    types = (pa.list_(pa.string()), pa.list_(pa.string()), kind)
    return [pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 3, types, strict=True)]


def _repaired_schema(blocks: DataFrame) -> T.StructType:
    many = T.ArrayType(T.StringType())
    return T.StructType().add("conv", blocks.schema["conv"].dataType).add("bid", "long").add("roles", many).add("texts", many).add("found", T.StructType.fromDDL(f"x {FOUND}")["x"].dataType)


def parts_repaired(blocks: DataFrame) -> DataFrame:
    """Blocks that may be parts of conversations -> (conv, bid, roles, texts, found); found is in a conversation's last."""
    conv_type = blocks.schema["conv"].dataType
    # rows like an earlier one of another block: once a block and text, however often a block holds it
    keys = F.transform(F.arrays_zip("roles", "texts"), lambda x: key_column(x["roles"], x["texts"]))
    once = blocks.select("conv", "bid", F.explode(F.array_distinct(keys)).alias("key"))
    earlier = once.withColumn("from", F.min("bid").over(Window.partitionBy("conv", "key"))).where("bid > from")
    earlier = earlier.groupBy(F.col("bid").alias("b")).agg(F.collect_list("key").alias("seen"))
    told = blocks.join(earlier, F.col("bid") == F.col("b"), "left").drop("b")
    n = len(GRAMMAR)

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for turns, roles, texts, seen in zip(*(batch.column(k).to_pylist() for k in ("turns", "roles", "texts", "seen")), strict=True):
                symbols, *faults = symbols_of(roles, texts, set(seen or ()))
                known = [t for t in turns if t is not None]
                paths = matrix(symbols)
                out.append((symbols, *faults, illegal_pairs([r[:1] for r in roles]), roles[0][:1], roles[-1][:1], known[0] if known else None, known[-1] if known else None, len(set(known)), [p[0] if p else None for p in paths], [p[1] if p else None for p in paths]))
            types = (pa.string(), *[pa.int64()] * 4, pa.string(), pa.string(), *[pa.int64()] * 3, pa.list_(pa.int64()), pa.list_(pa.string()))
            names = ["symbols", "blank", "duplicate", "truncated", "illegal", "opens", "closes", "low", "high", "turns", "costs", "labels"]
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * len(types), types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("bid"), *columns], ["conv", "bid", *names])

    schema = T.StructType().add("conv", conv_type).add("bid", "long")
    for f in T.StructType.fromDDL("symbols string, blank long, duplicate long, truncated long, illegal long, opens string, closes string, low long, high long, turns long, costs array<long>, labels array<string>"):
        schema = schema.add(f)
    sums = told.mapInArrow(sum_up, schema)

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bid", ignore_index=True)
        paths = [[(int(c), x) if x is not None else None for c, x in zip(costs, labels, strict=True)] for costs, labels in zip(pdf["costs"], pdf["labels"], strict=True)]
        cost, picks = chained(paths)
        known = pdf[pdf["low"].notna()]
        low, high = known["low"].astype("int64").tolist(), known["high"].astype("int64").tolist()
        turns = int(known["turns"].sum()) - sum(a == b for a, b in zip(high, low[1:], strict=False))
        illegal = int(pdf["illegal"].sum()) + sum(illegal_pairs([a, b]) for a, b in zip(pdf["closes"], pdf["opens"][1:], strict=False))
        counts = (high[-1] - low[0] + 1 - turns if low else 0, *(int(pdf[k].sum()) for k in ("blank", "duplicate", "truncated")), illegal, cost)
        last = len(pdf) - 1
        picks[last] = (picks[last][0], picks[last][1] + picks[last + 1][1])
        found = dict(zip(COUNTS, counts, strict=True)) | {"audit": "".join(x for _, x in picks[:-1])}
        return pd.DataFrame({"b": pdf["bid"], "q": [q for q, _ in picks[:-1]], "symbols": pdf["symbols"], "labels": [x for _, x in picks[:-1]], "found": [None] * last + [found]})

    picked = materialize(sums.groupBy("conv").applyInPandas(chain, f"b long, q int, symbols string, labels string, found {FOUND}"), "turn-paths")
    ready = blocks.join(picked, F.col("bid") == F.col("b")).select("conv", "bid", "roles", "texts", "q", "symbols", "labels", "found")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(k).to_pylist() for k in ("labels", "symbols", "q", "roles", "texts", "found")), strict=True)
            out = [(*replay(labels, symbols, q, roles, texts), found) for labels, symbols, q, roles, texts, found in rows]
            yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("bid"), *_columns(out)], ["conv", "bid", "roles", "texts", "found"])

    return materialize(ready.mapInArrow(run, _repaired_schema(blocks)), "turn-repairs")


def repair(rows: DataFrame, *, block: int = BLOCK, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """rows(conv, turn, role, text) -> (conv, bid, roles, texts, found, whole): repaired conversations in blocks, in the
    order of bid; counts, cost and audit are in the last block of each."""
    blocks = blocks_of(rows, block, block_chars)
    # conversations at the ends of a range are chained even if they are whole, for no task can tell
    whole = whole_repaired(blocks.where("whole")).withColumn("whole", F.lit(True))
    return whole.unionByName(parts_repaired(blocks.where("not whole")).withColumn("whole", F.lit(False)))


def digests(parts: DataFrame) -> DataFrame:
    """(conv, repaired_sha256) of blocks(conv, bid, text); a digest reads its conversation in order, one block at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, begun = None, None, False
        for batch in batches:
            done = []
            for c, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if state is None or c != conv:
                    if state is not None:
                        done.append((conv, state.hexdigest()))
                    conv, state, begun = c, hashlib.sha256(), False
                if text is not None:
                    state.update((("\n" if begun else "") + text).encode())
                    begun = True
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], batch.column(0).type), pa.array([x[1] for x in done])], ["conv", "repaired_sha256"])
            kind = batch.column(0).type
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv], kind), pa.array([state.hexdigest()])], ["conv", "repaired_sha256"])

    schema = T.StructType().add("conv", parts.schema["conv"].dataType).add("repaired_sha256", "string")
    return parts.select("conv", "bid", "text").repartition("conv").sortWithinPartitions("conv", "bid").mapInArrow(run, schema)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, cost, audit and digest of every conversation, repaired after damage."""
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = repair(damage(conversations))
    line = F.transform(F.arrays_zip("roles", "texts"), lambda x: F.concat(x["roles"], F.lit(":"), x["texts"]))
    text = F.array_join(line, "\n")
    counts = [F.col(f"found.{k}").alias(k) for k in (*COUNTS[:-1], "cost", "audit")]
    short = found.where("whole").select("conv", *counts, F.sha2(text, 256).alias("repaired_sha256"))
    parts = found.where("not whole")
    # a block of which nothing is left adds no line
    hashed = digests(parts.select("conv", "bid", F.when(F.size("roles") > 0, text).alias("text"))).withColumnRenamed("conv", "c")
    long = parts.where(F.col("found").isNotNull()).select("conv", *counts).join(hashed, F.col("conv").eqNullSafe(F.col("c"))).drop("c")
    every = conversations.groupBy("conv_id").agg(F.lit(0).alias("_")).select("conv_id")
    out = every.join(short.unionByName(long), F.col("conv_id").eqNullSafe(F.col("conv")), "left")
    zeros = [F.coalesce(k, F.lit(0)).cast("long").alias(k) for k in COUNTS]
    return out.select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def _oracle() -> str:
    """The same in DuckDB SQL: weights are text, cost in ten digits and then edits, so that the least text is the least
    weight. Row symbols and two insertion steps after each are folded over the best weights of the four grammar states."""

    def plus(weight: str, cost: str, label: str) -> str:
        return f"lpad((substr({weight}, 1, 10)::bigint + {cost})::varchar, 10, '0') || substr({weight}, 11) || '{label}'"

    far = "'9000000000'"
    drops = [plus(f"acc[{q}]", "4", "D") for q in (1, 2, 3, 4)]
    after = {3: (1, 2, 4), 4: (3,)}
    late = "if(upper(x) = x, 3, 0)"

    def kept(q: int, initial: str) -> str:
        return f"if(lower(x) = '{initial}', least({', '.join(plus(f'acc[{p}]', late, 'K') for p in after.get(q, (1,)))}), {far})"

    def changed(q: int) -> str:
        return f"least({', '.join(plus(f'acc[{p}]', f'3 + {late}', 'R') for p in after[q])})"

    row = f"[{drops[0]}, least({drops[1]}, {kept(2, 's')}), least({drops[2]}, {kept(3, 'u')}, {changed(3)}), least({drops[3]}, {kept(4, 'a')}, {changed(4)})]"
    to_u = f"[acc[1], acc[2], least(acc[3], {', '.join(plus(f'acc[{p}]', '3', 'I') for p in after[3])}), acc[4]]"
    to_a = f"[acc[1], acc[2], acc[3], least(acc[4], {plus('acc[3]', '3', 'I')})]"
    step = f"case x when '+' then {to_u} when '-' then {to_a} when 'x' then [{', '.join(drops)}] else {row} end"
    return rf"""
with crc as (select list(list_reduce(range(8), lambda c, i: if(c & 1 = 1, xor(c >> 1, 3988292384), c >> 1), n) order by n) as t from range(256) as r(n)),
keyed as (
  select conv_id as conv, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as txt,
    xor(list_reduce(list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), lambda c: ascii(c)::bigint),
      lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]), 4294967295::bigint), 4294967295) % 20 as kind
  from conversations, crc
),
damaged as (
  select conv, turn, case when kind = 4 then 'user' else role end as role,
    case kind when 1 then '' when 2 then regexp_replace(txt, '[.!?]', '', 'g') else txt end as txt, unnest(range(if(kind = 3, 2, 1))) as again
  from keyed where kind <> 0
),
placed as (
  select *, row_number() over (partition by conv order by turn nulls first, role, txt, again) as rn, regexp_extract(txt, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) as fin
  from damaged
),
faulty as (
  select *, case when fin = '' then 'blank' when row_number() over (partition by conv, role, txt order by rn) > 1 then 'duplicate' when fin not in ('.', '!', '?') then 'truncated' else '' end as fault,
    substr(role, 1, 1) as initial, lag(substr(role, 1, 1)) over (partition by conv order by rn) as before
  from placed
),
symbols as (
  select *, case when fault in ('blank', 'duplicate') then 'x' when fault = 'truncated' then upper(if(initial in ('s', 'u', 'a'), initial, 'o')) else if(initial in ('s', 'u', 'a'), initial, 'o') end as symbol
  from faulty
),
sums as (
  select conv, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
    count(*) filter (fault = 'truncated') as truncated, count(*) filter (before is not null and before || initial not in ('su', 'ua', 'au')) as illegal, list(symbol order by rn) as own
  from symbols group by conv
),
solved as (
  select *, list_reduce(list_concat(['+', '-'], flatten(list_transform(own, lambda s: [s, '+', '-']))), lambda acc, x: {step}, ['0000000000', {far}, {far}, {far}]) as best
  from (select * from sums)
),
least_ as (select *, least(best[1], best[4]) as weight from solved),
audits as (select * exclude (own, best, weight), substr(weight, 1, 10)::bigint as cost, substr(weight, 11) as audit from least_),
labels as (select conv, audit, unnest(range(1, length(audit) + 1)) as i from audits),
walked as (
  select conv, i, substr(audit, i, 1) as label, length(replace(audit, 'D', '')) as n, i - length(replace(substr(audit, 1, i), 'I', '')) as put, length(replace(substr(audit, 1, i), 'D', '')) as j
  from labels
),
lines as (
  select w.conv, w.i, case when label = 'K' then s.role when (j - n % 2) % 2 = 1 then 'user' else 'assistant' end || ':' || if(label = 'I', '', s.txt) as line
  from walked w left join symbols s on s.conv is not distinct from w.conv and s.rn = w.i - w.put
  where label <> 'D'
),
texts as (select conv, string_agg(line, chr(10) order by i) as repaired from lines group by conv)
select c.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated,
  coalesce(illegal, 0)::bigint as illegal, coalesce(cost, 0)::bigint as cost, coalesce(audit, '') as audit, sha256(coalesce(repaired, '')) as repaired_sha256
from (select distinct conv_id from conversations) c
left join audits a on a.conv is not distinct from c.conv_id
left join texts t on t.conv is not distinct from c.conv_id
"""


ORACLE = _oracle()
