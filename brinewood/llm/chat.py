"""Chat transcripts: roles by a hidden Markov model over speaker-marker and line features, then canonical turns.

A transcript is read line by line. Hidden states are the roles. Each line emits a speaker marker, its length, whether it
asks and whether it is the first of a turn; where a turn begins (a marker, or a boundary that is given) the role moves by
the learned transitions, after an empty line it may, elsewhere it tends to stay. Counts are learned from labelled turns
over the whole table, and Viterbi finds the likeliest role of every line. One coding of lines, in columns, serves learning,
tables of turns and raw texts. Lines are dealt by range, so that a conversation may hold any share of them: each block of
a long one is summed up as a matrix of best scores from role to role, the matrices are chained, and each block is then
decoded between the roles found at its ends.

Cases: a null or empty text is one empty line; very long texts are so many lines, decoded in blocks; turns without conv_id
make one conversation; turns without number come first; turns of one number, and repeated turns, are turns of their own in
the order of rows; without labelled turns all roles are equally likely and the first in code order stays; only the named
columns are read, so others may have any name; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brinewood.llm.common import crc_share, materialize, small_batches, table

ROLES = ("assistant", "system", "tool", "user")
#: Speaker markers that open a line, by the role they speak for; in any case, with or without brackets, hashes or stars.
MARKERS = {
    "assistant": ("assistant", "ai", "bot", "model", "answer", "a"),
    "system": ("system", "instruction", "instructions"),
    "tool": ("tool", "function", "observation"),
    "user": ("user", "human", "customer", "question", "q"),
}
BLOCK = 4096  # lines of a conversation that one task decodes at a time
STAY = 0.98  # chance that a role stays at a line where no turn begins
MARKER_TRUST = 50.0  # pseudo-count of each marker with its own role
#: How a line may change the role: INSIDE a turn, MAY begin one (after an empty line), BEGINS one (a marker or a boundary).
INSIDE, MAY, BEGINS = range(3)


def _marker(words: tuple[str, ...]) -> str:
    return rf"(?i)^\s*[#*\[<|(]*\s*(?:{'|'.join(words)})\s*[\]>|)*]*\s*[:>\]|]"


def line_code(line: Column, first: Column) -> Column:
    """A line's features as one number: marker, length class, question, first of the turn."""
    marker = F.lit(0)
    for k, role in enumerate(ROLES):
        marker = F.when(line.rlike(_marker(MARKERS[role])), k + 1).otherwise(marker)
    size = F.least(F.floor(F.log2(F.length(line) + 1.0)), F.lit(11)).cast("int")
    asks = line.rlike(r"\?\s*$").cast("int")
    return ((marker * 12 + size) * 2 + asks) * 2 + first.cast("int")


CODES = 5 * 12 * 2 * 2


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def turn_lines(text: Column) -> Column:
    """Array of (line, kind, code) of a turn whose boundary is given."""
    return F.transform(lines_of(text), lambda line, i: F.struct(line.alias("line"), F.when(i == 0, BEGINS).otherwise(INSIDE).alias("kind"), line_code(line, i == 0).alias("code")))


def transcript_lines(text: Column) -> Column:
    """The same of a raw transcript: markers and the first line begin a turn, a line after an empty one may."""
    lines = lines_of(text)
    marked = lambda line: line.rlike("|".join(f"(?:{_marker(w)})" for w in MARKERS.values()))
    kind = lambda line, i: F.when((i == 0) | marked(line), BEGINS).when(F.trim(F.get(lines, i - 1)) == "", MAY).otherwise(INSIDE)
    kinds = F.transform(lines, lambda line, i: F.struct(line.alias("line"), kind(line, i).alias("kind")))
    return F.transform(kinds, lambda x: F.struct(x["line"].alias("line"), x["kind"].alias("kind"), line_code(x["line"], x["kind"] != INSIDE).alias("code")))


class Hmm:
    """Log probabilities: start (roles), move (roles x roles, where a turn begins), emit (roles x codes)."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> None:
        self.start, self.emit = start, emit
        n = len(start)
        keep = np.where(np.eye(n, dtype=bool), STAY, (1 - STAY) / (n - 1))
        self.moves = np.stack([np.log(keep), np.log((keep + np.exp(move)) / 2), move])  # by kind of line

    @classmethod
    def from_counts(cls, start, move, emit) -> Hmm:
        """From raw counts. Features of a line count as independent of each other given the role."""
        codes = np.arange(CODES)
        parts = [codes // 48, codes // 4 % 12, codes // 2 % 2, codes % 2]
        log = np.zeros((len(ROLES), CODES))
        for n, part in enumerate(parts):
            size = part.max() + 1
            seen = np.stack([np.bincount(part, emit[r], size) for r in range(len(ROLES))]) + 1.0
            if n == 0:
                seen[:, 1:] += np.eye(len(ROLES)) * MARKER_TRUST
            log += np.log(seen / seen.sum(1, keepdims=True))[:, part]
        return cls(np.log((start + 1.0) / (start + 1.0).sum()), np.log((move + 1.0) / (move + 1.0).sum(1, keepdims=True)), log)

    def viterbi(self, emit: np.ndarray, moves: np.ndarray, before: int | None, after: int | None) -> np.ndarray:
        """Likeliest roles of a run of emissions; `before` is the role ahead of it, `after` the role that it has to end in."""
        n = len(emit)
        back = np.zeros((n, emit.shape[1]), np.int64)
        score = emit[0] + (self.start if before is None else moves[0][before])
        for t in range(1, n):
            step = score[:, None] + moves[t]
            back[t] = step.argmax(0)
            score = step.max(0) + emit[t]
        out = np.empty(n, np.int64)
        out[-1] = score.argmax() if after is None else after
        for t in range(n - 1, 0, -1):
            out[t - 1] = back[t, out[t]]
        return out

    def matrix(self, emit: np.ndarray, moves: np.ndarray) -> np.ndarray:
        """Best score of a block of lines from the role before it to the role it ends in."""
        total = moves[0] + emit[0]
        for e, m in zip(emit[1:], moves[1:], strict=True):
            total = (total[:, :, None] + m[None]).max(1) + e
        return total

    def opening(self, emit: np.ndarray, moves: np.ndarray) -> np.ndarray:
        """Best score of the first block to the role it ends in."""
        score = emit[0] + self.start
        for e, m in zip(emit[1:], moves[1:], strict=True):
            score = (score[:, None] + m).max(0) + e
        return score


def learn(turns: DataFrame) -> Hmm:
    """turns(conv, turn, text, role): counts over all labelled rows; only sums reach the driver."""
    codes = {r: k for k, r in enumerate(ROLES)}
    rows = turns.where(F.col("role").isin(*ROLES))
    emit = np.zeros((len(ROLES), CODES))
    for r in rows.select("role", F.explode(F.transform(turn_lines(F.col("text")), lambda x: x["code"])).alias("code")).groupBy("role", "code").count().collect():
        emit[codes[r["role"]], r["code"]] = r["count"]
    start = np.zeros(len(ROLES))
    for r in rows.where("turn = 0").groupBy("role").count().collect():
        start[codes[r["role"]]] = r["count"]
    move = np.zeros((len(ROLES), len(ROLES)))
    one = rows.groupBy("conv", "turn").agg(F.min("role").alias("role"))
    two = one.select("conv", (F.col("turn") + 1).alias("turn"), F.col("role").alias("last"))
    for r in one.join(two, ["conv", "turn"]).groupBy("last", "role").count().collect():
        move[codes[r["last"]], codes[r["role"]]] = r["count"]
    return Hmm.from_counts(start, move, emit)


def decode(lines: DataFrame, model: Hmm) -> DataFrame:
    """lines(conv, turn, rid, at, kind, code) to (rid, at, role): the likeliest roles of each conversation's lines, ordered
    by turn, row number and place."""
    spark = lines.sparkSession
    small_batches(spark, 10_000)
    order = [F.asc_nulls_first("turn"), F.col("rid"), F.col("at")]
    parts = max(1, -(-lines.count() // (4 * BLOCK)))
    lines = lines.repartitionByRange(parts, F.asc_nulls_first("conv"), *order).withColumn("part", F.spark_partition_id())
    lines = materialize(lines, "ranges")  # ranges are sampled: written once, a line stays in its part
    inside = Window.partitionBy("conv", "part").orderBy(*order)
    lines = materialize(lines.withColumn("block", F.floor((F.row_number().over(inside) - 1) / BLOCK)), "lines")
    every = lines.select("conv", "part", "block").distinct()
    long = every.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("conv").alias("c"))
    cut = lines.join(materialize(long, "long"), F.col("conv").eqNullSafe(F.col("c")), "left_semi")

    def in_order(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.sort_values(["turn", "rid", "at"], na_position="first", ignore_index=True)

    def scores(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        return model.emit[:, pdf["code"].to_numpy()].T, model.moves[pdf["kind"].to_numpy()]

    def sum_up(pdf: pd.DataFrame) -> pd.DataFrame:
        emit, moves = scores(in_order(pdf))
        return pd.DataFrame({"conv": pdf["conv"].iloc[:1], "part": pdf["part"].iloc[:1], "block": pdf["block"].iloc[:1], "best": [model.matrix(emit, moves).ravel().tolist()], "opening": [model.opening(emit, moves).tolist()]})

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["part", "block"])
        n = len(ROLES)
        score = np.array(pdf["opening"].iloc[0])
        back = []
        for best in pdf["best"].iloc[1:]:
            step = score[:, None] + np.array(best).reshape(n, n)
            back.append(step.argmax(0))
            score = step.max(0)
        ends = [int(score.argmax())]
        for b in reversed(back):
            ends.append(int(b[ends[-1]]))
        ends = ends[::-1]
        return pd.DataFrame({"c": pdf["conv"].to_numpy(), "p": pdf["part"].to_numpy(), "b": pdf["block"].to_numpy(), "before": [-1, *ends[:-1]], "after": ends})

    kind = lines.schema["conv"].dataType.simpleString()
    sums = cut.groupBy("conv", "part", "block").applyInPandas(sum_up, f"conv {kind}, part int, block long, best array<double>, opening array<double>")
    ends = materialize(sums.groupBy("conv").applyInPandas(chain, f"c {kind}, p int, b long, before int, after int"), "ends")
    ready = lines.join(ends, F.col("conv").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")) & (F.col("block") == F.col("b")), "left")
    ready = ready.select("conv", "part", "block", "turn", "rid", "at", "kind", "code", F.coalesce("before", F.lit(-1)).alias("before"), F.coalesce("after", F.lit(-1)).alias("after"))
    ready = ready.repartition("conv", "part", "block").sortWithinPartitions(F.asc_nulls_first("conv"), "part", "block", *order)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None

        def key(pdf: pd.DataFrame) -> list:
            return list(zip(pdf["conv"].where(pdf["conv"].notna(), None), pdf["part"], pdf["block"], strict=True))

        def roles(pdf: pd.DataFrame) -> pd.DataFrame:
            emit, moves = scores(pdf)
            own = key(pdf)
            start = [i for i in range(len(own)) if i == 0 or own[i] != own[i - 1]]
            found = np.empty(len(pdf), np.int64)
            before, after = pdf["before"].to_numpy(), pdf["after"].to_numpy()
            for a, b in zip(start, [*start[1:], len(pdf)], strict=True):
                found[a:b] = model.viterbi(emit[a:b], moves[a:b], None if before[a] < 0 else before[a], None if after[a] < 0 else after[a])
            return pd.DataFrame({"rid": pdf["rid"], "at": pdf["at"], "role": [ROLES[k] for k in found]})

        for pdf in parts:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            if not len(pdf):
                continue
            # the last block may go on in the next batch
            own = key(pdf)
            first = next(i for i in range(len(own) - 1, -1, -1) if i == 0 or own[i - 1] != own[-1])
            held, done = pdf.iloc[first:], pdf.iloc[:first]
            if len(done):
                yield roles(done.reset_index(drop=True))
        if held is not None and len(held):
            yield roles(held.reset_index(drop=True))

    return ready.mapInPandas(run, "rid long, at int, role string")


def recover(turns: DataFrame, model: Hmm) -> DataFrame:
    """turns(conv, turn, text, rid) with role_pred: the likeliest role of each turn's first line, all lines of its
    conversation read."""
    lines = turns.select("conv", "turn", "rid", F.posexplode(turn_lines(F.col("text"))).alias("at", "x")).select("conv", "turn", "rid", "at", "x.kind", "x.code")
    found = decode(lines, model).where("at = 0").select(F.col("rid").alias("r"), F.col("role").alias("role_pred"))
    return turns.join(found, F.col("rid") == F.col("r")).drop("r")


def clean(text: Column) -> Column:
    """A turn's text without its speaker marker and without white space at its ends."""
    every = "|".join(_marker(w).removeprefix("(?i)^") for w in MARKERS.values())
    return F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), f"(?i)^(?:{every})", ""), F.lit(" \n\t"))


def render(role: Column, text: Column) -> Column:
    """A turn in canonical form: role mark, clean text, end mark."""
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), clean(text), F.lit("\n<|end|>"))


def parse_transcripts(docs: DataFrame, model: Hmm, *, id_col: str, text_col: str) -> DataFrame:
    """(id, turn, role, text, rendered) of whole raw transcripts, one text each: a turn ends where the role changes or the
    next one begins. Rows that share an id are transcripts of their own."""
    texts = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("rid"), F.col(text_col).alias("text"))
    rows = materialize(texts.select("id", "rid", F.posexplode(transcript_lines(F.col("text"))).alias("at", "x")), "transcripts")
    lines = rows.select(F.col("rid").alias("conv"), F.lit(0).cast("long").alias("turn"), "rid", "at", "x.kind", "x.code")
    found = decode(lines, model).select(F.col("rid").alias("r"), F.col("at").alias("a"), "role")
    every = rows.join(found, (F.col("rid") == F.col("r")) & (F.col("at") == F.col("a")))
    order = Window.partitionBy("rid").orderBy("at")
    new = (F.col("x.kind") == BEGINS) | F.coalesce(F.lag("role").over(order) != F.col("role"), F.lit(True))
    numbered = every.withColumn("new", new.cast("int")).withColumn("turn", (F.sum("new").over(order) - 1).cast("int"))
    turns = numbered.groupBy("rid", "turn").agg(F.first("id").alias("id"), F.first("role").alias("role"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "x.line"))), lambda x: x["line"]), "\n").alias("text"))
    return turns.select("id", "turn", "role", clean(F.col("text")).alias("text"), render(F.col("role"), F.col("text")).alias("rendered"))


def op10_chat_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles of all turns, learned from conversations whose crc32(conv_id as text) mod 3 is not 1, and canonical turns."""
    rows = table(spark, sf_dir, "conversations")
    rows = rows.select(F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), "text", "role")
    rows = materialize(rows.withColumn("held_out", crc_share(F.col("conv"), 3) == 1).withColumn("rid", F.monotonically_increasing_id()), "turns")
    model = learn(rows.where(~F.col("held_out")))
    found = recover(rows.select("conv", "turn", "text", "rid", "held_out"), model)
    return found.select(F.col("conv").alias("conv_id"), "turn", "held_out", "role_pred", render(F.col("role_pred"), F.col("text")).alias("rendered"))
