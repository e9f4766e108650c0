"""Exact Jaccard self-join of documents on word shingles, by a grouped prefix join.

1. Shingles that many documents share are counted over the whole corpus; the most frequent make an order, rarest first.
2. Two sets that reach the threshold share a token in their prefixes: the first tokens in that order, as many as the
   threshold allows to miss, plus one. Documents with the same prefix and size form one group.
3. Groups that share prefix tokens meet as groups: tokens that the same groups share are counted once, with a weight, and
   pairs of groups are filtered by size and by how many prefix tokens they share. Groups of long lists meet a few pivots
   first; only pairs that this leaves in different components are filtered after that, in cells of bounded size.
4. Pairs of groups that are left, and groups of several members with themselves, are expanded to their members. These are
   verified on whole sets, and links become components.

Equal sets are one member throughout, so copies cost nothing. No list is gathered in one task. The work on a list whose
groups are truly unrelated, though they share enough prefix tokens to pass the filter, grows with the square of its length.

Cases: null texts and texts without words have no set and are linked with nothing; fewer words than a shingle make
one shingle; very long texts are read whole; rows without doc_id take part, but a component is named by its smallest
doc_id that is not null; repeated rows are members of one component; only the named columns of docs are read, so others
may have any name; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brinewood.llm.common import discard, materialize, small_batches, spread_join, table

WORDS = 5
THRESHOLD = 75  # per cent
#: Tokens in the order by frequency; all others count as rarest. The order only steers cost, never results.
ORDERED = 1 << 17
#: A token at least so frequent is taken as shared without looking.
HOT = 1000
#: Tokens counted at once by a task.
COUNTED = 1 << 21
#: Groups of a list that are paired outright; longer lists meet pivots first, so many in so many rounds.
PAIRED, PIVOTS, PIVOT_ROUNDS = 32, 12, 2
#: Rows of a longer list that one cell of its pairs holds on either side.
CELL = 256
#: Rows up to which the small side of a join on a key that may be hot is broadcast, and parts of a key beyond.
SENT, SALTS = 1 << 13, 16
#: Bits of the filter that picks the texts to verify.
FILTER_BITS = 1 << 24
#: Bytes of text that are hashed at once, or one text if it is longer.
HASHED = 1 << 20


STEP = 0x5851F42D4C957F2D
SEPARATES = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(29))


BYTES = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all texts, in order, and the number of words of each text.

    A word's hash is a polynomial over its bytes, cut out of one running sum over all texts.
    """
    flat = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
    gap = SEPARATES[flat]
    start, stop = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1, np.flatnonzero(~gap[:-1] & gap[1:])
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(len(flat), STEP, np.uint64))
        total = np.cumsum(BYTES[flat] * power)
        back = np.cumprod(np.full(len(flat), pow(STEP, -1, 1 << 64), np.uint64))
        hashes = _mixed((total[stop] - total[start - 1]) * back[start] + (stop - start).astype(np.uint64))
    begin = np.cumsum([1, *(len(t) + 1 for t in texts)])
    return hashes, np.diff(np.searchsorted(start, begin))


def shingle_hashes(hashes: np.ndarray, words: int) -> np.ndarray:
    """Hashes of all runs of so many words."""
    n = len(hashes) - words + 1
    with np.errstate(over="ignore"):
        run = np.full(max(n, 0), words, np.uint64)
        for j in range(words):
            run = run * np.uint64(STEP) + hashes[j : n + j]
    return _mixed(run).view(np.int64)


def shingle_sets(texts: list[str | None], words: int) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of all its runs of so many words; of a shorter text, the one hash of all its words."""
    out: list[np.ndarray] = []
    lot: list[bytes] = []

    def flush() -> None:
        hashes, counts = word_hashes(lot)
        runs, at = shingle_hashes(hashes, words), 0
        for n in counts.tolist():
            own = runs[at : at + n - words + 1] if n >= words else shingle_hashes(hashes[at : at + n], n) if n else runs[:0]
            own = np.sort(own)
            out.append(own[np.r_[True, own[1:] != own[:-1]]] if len(own) else own)
            at += n
        lot.clear()

    held = 0
    for t in texts:
        lot.append((t or "").encode("utf-8", "surrogatepass").lower())
        held += len(lot[-1])
        if held > HASHED:
            flush()
            held = 0
    flush()
    return out


def _batches(batches: Iterator[pa.RecordBatch], text_at: int, words: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 200):
            some = batch.slice(lo, 200)
            yield some, shingle_sets(some.column(text_at).to_pylist(), words)


def frequent_tokens(docs: DataFrame, text_col: str, words: int, ordered: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles of the corpus (sorted) and their counts, at most `ordered`.

    Tasks count their documents' tokens in large lots and report those that repeat within a lot.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted(lot: list[np.ndarray]) -> pa.RecordBatch:
            every = np.sort(np.concatenate([np.zeros(0, np.int64), *lot]))
            first = np.flatnonzero(np.r_[True, every[1:] != every[:-1]]) if len(every) else np.zeros(0, np.int64)
            tokens, n = every[first], np.diff(np.r_[first, len(every)])
            return pa.RecordBatch.from_arrays([pa.array(tokens[n > 1]), pa.array(n[n > 1], pa.int64())], ["token", "n"])

        lot: list[np.ndarray] = []
        held = 0
        for _, sets in _batches(batches, 0, words):
            lot += sets
            held += sum(map(len, sets))
            if held >= COUNTED:
                yield counted(lot)
                lot, held = [], 0
        yield counted(lot)

    found = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "token long, n long")
    found = materialize(found.groupBy("token").agg(F.sum("n").alias("n")).withColumn("level", F.floor(F.log2("n") * 8)), "tokens")
    # whole levels of frequency from the top, as many as fit: no more than `ordered` rows reach the driver
    level, taken = None, 0
    for r in sorted(found.groupBy("level").count().collect(), key=lambda r: -r["level"]):
        if taken + r["count"] > ordered:
            break
        level, taken = r["level"], taken + r["count"]
    top = found.where(F.col("level") >= level).select("token", "n").collect() if taken else []
    tokens, n = np.array([r[0] for r in top], np.int64), np.array([r[1] for r in top], np.int64)
    order = np.argsort(tokens)
    return tokens[order], n[order]


def prefixes(docs: DataFrame, id_col: str, text_col: str, words: int, threshold: int, tokens, counts, key_col: str | None = None) -> DataFrame:
    """(doc_id, n, member, grp, prefix, hot): the size, the set's own hash, the group's, and the prefix tokens in order.

    `hot` holds the prefix tokens that are frequent beyond doubt. A task gives the tokens of a group once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, freq = tokens.value, counts.value
        done: set[bytes] = set()
        for batch, sets in _batches(batches, 1, words):
            member, group, prefix, hot = [], [], [], []
            for s in sets:
                n = len(s)
                if not n:
                    for x in (member, group, prefix, hot):
                        x.append(None)
                    continue
                p = n - -(-threshold * n // 100) + 1
                f = np.zeros(n, np.int64)
                if len(order):
                    at = np.minimum(np.searchsorted(order, s), len(order) - 1)
                    f = np.where(order[at] == s, freq[at], 0)
                rare = s[f == 0]
                if len(rare) >= p:
                    first, n_hot = rare[:p], 0
                else:
                    best = np.lexsort((s, f))[:p]
                    first, n_hot = s[best], int((f[best] >= HOT).sum())
                key = hashlib.blake2b(first.tobytes() + n.to_bytes(8, "little"), digest_size=8).digest()
                member.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                group.append(int.from_bytes(key, "little", signed=True))
                if key in done:
                    first, n_hot = first[:0], 0
                elif len(done) < 1_000_000:
                    done.add(key)
                prefix.append(first[: len(first) - n_hot])
                hot.append(first[len(first) - n_hot :])
            sizes = pa.array([len(s) for s in sets], pa.int64())
            longs = pa.list_(pa.int64())
            columns = [*(batch.column(i) for i in (0, *range(2, batch.num_columns))), sizes, pa.array(member, pa.binary()), pa.array(group, pa.int64()), pa.array(prefix, longs), pa.array(hot, longs)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *(["key"] if key_col else []), "n", "member", "grp", "prefix", "hot"])

    own = [F.col(key_col).cast("binary").alias("key")] if key_col else []
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *own)
    return rows.mapInArrow(run, f"doc_id long, {'key binary, ' if key_col else ''}n long, member binary, grp long, prefix array<long>, hot array<long>")


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by token and group, those whose token has two groups or more. Holds one token's rows at most."""
    held: pa.Table | None = None
    known = None  # a token that is known to be shared and whose rows still come
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows]).combine_chunks()
        if not rows.num_rows:
            continue
        token, grp = rows.column("token").to_numpy(), rows.column("grp").to_numpy()
        start = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
        stop = np.r_[start[1:], len(token)]
        many = (grp[start] != grp[stop - 1]) | (token[start] == known if known is not None else False)
        keep = np.repeat(many, stop - start)
        last = start[-1]
        if many[-1]:
            known, last = token[-1], len(token)
        held = rows.slice(last) if last < len(token) else None
        # rows of one group may still repeat by the million in a token; one of each is enough
        if held is not None and held.num_rows > 1:
            held = held.slice(0, 1)
        yield from rows.slice(0, last).filter(pa.array(keep[:last])).to_batches()


def components(links: DataFrame) -> DataFrame:
    """(member, root) of every member in links (a, b): the connected components, by contraction.

    Each round maps a member to its smallest neighbour and contracts the links; what is left shrinks by a factor.
    """
    links = materialize(links.where("a != b").distinct(), "links")
    roots = materialize(links.select(F.col("a").alias("member")).union(links.select("b")).distinct().withColumn("root", F.col("member")), "roots")
    while not links.isEmpty():
        both = links.union(links.select("b", "a"))
        parent = both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("u"))
        parent = materialize(parent.select("v", F.least("v", "u").alias("u")).where("u < v"), "parents")
        a, b = parent.toDF("av", "au"), parent.toDF("bv", "bu")
        moved = links.join(a, F.col("a") == F.col("av"), "left").join(b, F.col("b") == F.col("bv"), "left")
        moved = moved.select(F.coalesce("au", "a").alias("a"), F.coalesce("bu", "b").alias("b"))
        links = materialize(moved.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
        roots = materialize(roots.join(parent, F.col("root") == F.col("v"), "left").select("member", F.coalesce("u", "root").alias("root")), "roots")
    return roots


def _bound(n1, n2, threshold: int) -> Column:
    """Least number of shared prefix tokens of two sets of these sizes that reach the threshold.

    The prefix that ends first holds all shared tokens up to its end; beyond it one set has fewer than `threshold`
    per cent of its size left. What the overlap needs more than that must be shared prefix tokens.
    """
    overlap = F.ceil((F.col(n1) + F.col(n2)) * float(threshold) / float(100 + threshold) - 1e-9)
    beyond = F.ceil(F.greatest(F.col(n1), F.col(n2)) * threshold / 100.0 - 1e-9) - 1
    return F.greatest(overlap - beyond, F.lit(1).cast("long"))


def _like_size(n1: str, n2: str, threshold: int) -> Column:
    return (F.col(n1) * 100 >= F.col(n2) * threshold) & (F.col(n2) * 100 >= F.col(n1) * threshold)


def attach(rows: DataFrame, small: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """rows joined with a written table by a key that may hold any share of the rows: up to SENT rows it is broadcast, so
    that rows stay where they are; beyond, it is repeated SALTS times and the rows of a key are dealt among these."""
    if small.count() <= SENT:
        return rows.join(F.broadcast(small), on, how)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)))
    spread = small.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(spread, [*([on] if isinstance(on, str) else on), "_salt"], how).drop("_salt")


def place_of(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(doc_id.cast("long"), F.lit(-1))), F.lit(FILTER_BITS))


def whole_sets(wanted: DataFrame, docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(member, tokens) of the wanted (member, place), made anew from the texts.

    A filter of fixed size picks the texts, an exact join follows.
    """
    spark = docs.sparkSession
    bits = wanted.groupBy(F.bitmap_bucket_number(F.col("place") + 1).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("place") + 1)).alias("bits"))
    bitmap = np.zeros((FILTER_BITS // 32768, 4096), np.uint8)
    for r in bits.collect():
        bitmap[r["k"] - 1] = np.frombuffer(r["bits"], np.uint8)
    sent = spark.sparkContext.broadcast(bitmap.reshape(-1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bit, done = sent.value, set()
        for batch in batches:
            place = batch.column(0).to_numpy()
            batch = batch.filter(pa.array((bit[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1))
            for _, sets in _batches(iter([batch]), 1, words):
                found = {hashlib.blake2b(s.tobytes(), digest_size=16).digest(): s for s in sets if len(s)}
                found = {k: s for k, s in found.items() if k not in done}
                if len(done) < 1_000_000:
                    done.update(found)
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.list_(pa.int64()))], ["member", "tokens"])

    texts = docs.select(place_of(F.col(id_col)).alias("place"), F.col(text_col).alias("text"))
    found = texts.mapInArrow(run, "member binary, tokens array<long>").join(wanted.select("member"), "member", "left_semi")
    # texts whose doc_id falls on a filtered place may repeat a member
    return materialize(found.dropDuplicates(["member"]), "sets")


def verify(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Of the pairs (a, b) those whose whole sets reach the threshold."""
    both = pairs.select("a", "b").join(sets.toDF("a", "ta"), "a").join(sets.toDF("b", "tb"), "b")
    same = F.size(F.array_intersect("ta", "tb"))
    return both.where(same * 100 >= (F.size("ta") + F.size("tb") - same) * threshold).select("a", "b")


def group_lists(shared: DataFrame) -> DataFrame:
    """shared(token, grp, n) -> (lid, grp, n, w, k, large, small): tokens that the same groups share are one list of weight
    w with k groups. large and small: a group's weight in lists above PAIRED groups, and below.
    """
    lists = shared.groupBy("token").agg(F.expr("bit_xor(xxhash64(grp))").alias("x"), F.count(F.lit(1)).alias("k"))
    lists = lists.select("token", F.xxhash64("x", "k").alias("lid"), "k")
    rows = shared.join(lists, "token").groupBy("lid", "grp").agg(F.count(F.lit(1)).alias("w"), F.first("n").alias("n"), F.first("k").alias("k"))
    rows = materialize(rows, "lists")
    load = lambda test: F.sum(F.when(test, F.col("w")).otherwise(0))
    loads = rows.groupBy(F.col("grp").alias("g")).agg(load(F.col("k") > PAIRED).alias("large"), load(F.col("k") <= PAIRED).alias("small"))
    out = materialize(rows.join(loads, F.col("grp") == F.col("g")).drop("g"), "lists")
    discard(rows)
    return out


def pairs_of_small(rows: DataFrame, threshold: int) -> DataFrame:
    """Pairs (a, b) of groups of a list of up to PAIRED that may reach the threshold by the weight they share in such
    lists, plus at most what both have in longer ones."""
    names = ["grp", "n", "w", "large", "small"]
    a = rows.select("lid", *[F.col(c).alias(f"{c}_a") for c in names])
    b = rows.select("lid", *[F.col(c).alias(f"{c}_b") for c in names])
    most = F.least(F.col("large_a") + F.col("small_a"), F.col("large_b") + F.col("small_b"))
    test = (F.col("grp_a") < F.col("grp_b")) & _like_size("n_a", "n_b", threshold) & (most >= _bound("n_a", "n_b", threshold))
    both = a.join(b, "lid").where(test).groupBy(F.col("grp_a").alias("a"), F.col("grp_b").alias("b"))
    both = both.agg(F.sum("w_a").alias("w"), F.first("n_a").alias("na"), F.first("n_b").alias("nb"), F.first(F.least("large_a", "large_b")).alias("other"))
    return both.where(F.col("w") + F.col("other") >= _bound("na", "nb", threshold)).select("a", "b")


def cells(rows: DataFrame, key: str, node: str, names: list[str]) -> DataFrame:
    """All pairs of rows of one key, each once, with columns `names` as x_a and x_b: rows are dealt into blocks, and a cell
    holds the pairs of two blocks, so that no task holds a key. Pairs within a block come in the order of `node`. The sides
    are merged: their lists compress so well that Spark would take them for small enough to broadcast."""
    last = F.ceil(F.col("k") / CELL) - 1
    own = F.pmod(F.xxhash64(F.lit("cell"), node), last + 1)
    rows = rows.withColumn("_block", own.cast("long"))
    a = rows.select(key, F.col("_block").alias("i"), F.explode(F.sequence("_block", last.cast("long"))).alias("j"), *[F.col(c).alias(f"{c}_a") for c in names])
    b = rows.select(key, F.explode(F.sequence(F.lit(0).cast("long"), "_block")).alias("i"), F.col("_block").alias("j"), *[F.col(c).alias(f"{c}_b") for c in names])
    return a.join(b.hint("merge"), [key, "i", "j"]).where((F.col("i") < F.col("j")) | (F.col(f"{node}_a") < F.col(f"{node}_b")))


def pairs_of_large(rows: DataFrame, threshold: int) -> DataFrame:
    """The same for groups of longer lists that are not of one component.

    Groups of such lists share many of them. Each row carries all of its group's lists, so a pair is made once, in the
    first list that both have, and only if what both share there and elsewhere is enough.
    """
    own = rows.groupBy(F.col("grp").alias("g")).agg(F.array_sort(F.collect_list(F.struct("lid", "w"))).alias("own"))
    rows = rows.join(own.hint("merge"), F.col("grp") == F.col("g")).withColumn("ids", F.transform("own", lambda x: x["lid"]))
    both = cells(rows, "lid", "grp", ["grp", "n", "large", "small", "root", "own", "ids"])
    most = F.least(F.col("large_a") + F.col("small_a"), F.col("large_b") + F.col("small_b"))
    shared = F.aggregate(F.filter("own_a", lambda x: F.array_contains("ids_b", x["lid"])), F.least("small_a", "small_b"), lambda acc, x: acc + x["w"])
    test = ~F.col("root_a").eqNullSafe(F.col("root_b")) & _like_size("n_a", "n_b", threshold)
    test = test & (most >= _bound("n_a", "n_b", threshold)) & (F.array_min(F.array_intersect("ids_a", "ids_b")) == F.col("lid")) & (shared >= _bound("n_a", "n_b", threshold))
    return both.where(test).select(F.least("grp_a", "grp_b").alias("a"), F.greatest("grp_a", "grp_b").alias("b"))


def pivot_pairs(rows: DataFrame, seeds: range, threshold: int) -> DataFrame:
    """Pairs of each group with a few pivots of its list, chosen by hash within bands of size, if they are of different
    components and share at least half of what a link needs. They only find links early; missing one costs no result."""
    band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / threshold))).cast("int")
    rows = rows.withColumn("band", band)
    least = [F.min(F.struct(F.xxhash64(F.lit(s), "grp").alias("h"), "grp", "n", "root")).alias(f"p{s}") for s in seeds]
    pivots = rows.groupBy("lid", "band").agg(*least)
    pivots = pivots.select("lid", "band", F.explode(F.array_distinct(F.array(*[f"p{s}" for s in seeds]))).alias("p"))
    pivots = pivots.select("lid", F.explode(F.array("band", F.col("band") + 1)).alias("band"), F.col("p.grp").alias("pg"), F.col("p.n").alias("pn"), F.col("p.root").alias("pr"))
    met = attach(rows, materialize(pivots, "pivots"), ["lid", "band"])
    met = met.where((F.col("grp") != F.col("pg")) & ~F.col("root").eqNullSafe(F.col("pr")) & _like_size("n", "pn", threshold))
    met = met.groupBy(F.least("grp", "pg").alias("a"), F.greatest("grp", "pg").alias("b")).agg(F.sum("w").alias("w"), F.first("n").alias("na"), F.first("pn").alias("nb"))
    return met.where(F.col("w") * 2 >= _bound("na", "nb", threshold)).select("a", "b")


def rooted(members: DataFrame, known: DataFrame) -> DataFrame:
    """members with root, the component so far."""
    placed = members.join(known.select(F.col("member").alias("m"), "root"), F.col("member") == F.col("m"), "left").drop("m")
    return placed.withColumn("root", F.coalesce("root", "member"))


def still_open(rows: DataFrame, placed: DataFrame) -> DataFrame:
    """The rows of lists whose groups lie in several components, with root; a group that does so itself has none."""
    roots = placed.groupBy(F.col("grp").alias("g")).agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
    rows = rows.drop("root").join(roots.select("g", F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("root")), F.col("grp") == F.col("g")).drop("g")
    rows = materialize(rows, "rooted")
    ends = rows.groupBy("lid").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.max(F.col("root").isNull()).alias("several"))
    ends = materialize(ends.where(F.col("several") | (F.col("lo") != F.col("hi"))).select("lid"), "ends")
    return materialize(attach(rows, ends, "lid", "left_semi"), "open")


def expand(pairs: DataFrame, placed: DataFrame) -> DataFrame:
    """Pairs (a, b) of the members of pairs of groups that are of different components."""
    a = placed.select(F.col("grp").alias("a"), F.col("member").alias("ma"), F.col("root").alias("ra"))
    b = placed.select(F.col("grp").alias("b"), F.col("member").alias("mb"), F.col("root").alias("rb"))
    both = pairs.join(a, "a").join(b, "b").where("ra != rb")
    return both.select(F.col("ma").alias("a"), F.col("mb").alias("b"))


def pairs_within(several: DataFrame) -> DataFrame:
    """Pairs of members of one group that are of different components."""
    both = cells(several, "grp", "member", ["member", "root"]).where("root_a != root_b")
    return both.select(F.col("member_a").alias("a"), F.col("member_b").alias("b"))


def join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, threshold: int = THRESHOLD, ordered: int = ORDERED, key_col: str | None = None) -> DataFrame:
    """Per row of docs: doc_id, n_shingles and component_id, the smallest doc_id that links reach.

    With key_col, a binary column of docs, also `key`, that column, and `component`, one value for each component, null
    for rows without shingles.
    """
    spark = docs.sparkSession
    small_batches(spark)
    tokens, counts = (spark.sparkContext.broadcast(x) for x in frequent_tokens(docs, text_col, words, ordered))
    full = materialize(prefixes(docs, id_col, text_col, words, threshold, tokens, counts, key_col), "prefixes")
    rows = materialize(full.select("doc_id", *(["key"] if key_col else []), "n", "member", "grp"), "rows")
    members = rows.where("n > 0").groupBy("member").agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n"), F.min("grp").alias("grp"))
    members = materialize(members.withColumn("place", place_of(F.col("doc_id"))), "members")
    nodes = materialize(members.groupBy("grp").agg(F.count(F.lit(1)).alias("k"), F.min("member").alias("member"), F.min("n").alias("n")), "nodes")

    # tokens that two groups or more share
    listed = full.select("grp", F.explode("prefix").alias("token"))
    shared = listed.select("token", "grp").repartition("token").sortWithinPartitions("token", "grp").mapInArrow(_shared, "token long, grp long")
    hot = full.where(F.size("hot") > 0).select(F.explode("hot").alias("token"), "grp")
    shared = shared.unionByName(hot).distinct().join(nodes.select("grp", "n"), "grp").select("token", "grp", "n")
    shared = materialize(shared, "shared")
    discard(full)
    lists = group_lists(shared)
    discard(shared)
    pairs = materialize(pairs_of_small(lists.where(F.col("k") <= PAIRED), threshold), "pairs")
    large = materialize(lists.where(F.col("k") > PAIRED), "large")
    discard(lists)
    multiple = materialize(nodes.where("k > 1").select("grp", "k"), "multiple")
    several = materialize(attach(members.select("grp", "member"), multiple, "grp"), "several")

    met = pairs.select(F.col("a").alias("grp")).union(pairs.select("b")).union(large.select("grp")).union(multiple.select("grp")).distinct()
    met = materialize(met, "met")
    wanted = materialize(attach(members.select("member", "place", "grp"), met, "grp", "left_semi").select("member", "place"), "wanted")
    sets = whole_sets(wanted, docs, id_col, text_col, words)
    found: list[DataFrame] = []
    known = materialize(members.select("member", F.col("member").alias("root")).limit(0), "known")

    def link(candidates: DataFrame) -> int:
        """Verify pairs of members and join components; the number of new links."""
        nonlocal known
        more = materialize(verify(candidates, sets, threshold), "linked")
        if n := more.count():
            found.append(more)
            links = found[0]
            for x in found[1:]:
                links = links.union(x)
            known = components(links)
        return n

    one, every = nodes.select("grp", "member"), members.select("grp", "member")
    any_several = not multiple.isEmpty()

    def meet(pairs: DataFrame) -> int:
        """Pairs of groups: their first members, and then all members of the groups that have several."""
        n = link(expand(pairs, rooted(one, known)))
        if any_several:
            of = lambda c: multiple.select(F.col("grp").alias(c), F.lit(True).alias(f"{c}_several"))
            some = attach(attach(pairs, of("a"), "a", "left"), of("b"), "b", "left").where("a_several OR b_several").select("a", "b")
            n += link(expand(some, rooted(every, known)))
        return n

    # members of one group: each meets the group's first, and then those of other components meet
    if any_several:
        first = materialize(nodes.where("k > 1").select("grp", F.col("member").alias("b")), "firsts")
        link(attach(several.select("grp", F.col("member").alias("a")), first, "grp").where("a != b").select("a", "b"))
        link(pairs_within(rooted(several, known)))
    meet(pairs)

    # groups of long lists meet pivots, and then what is left of other components
    open_ = still_open(large, rooted(every, known))
    for k in range(PIVOT_ROUNDS):
        if open_.isEmpty():
            break
        n = link(expand(pivot_pairs(open_, range(k * PIVOTS, (k + 1) * PIVOTS), threshold), rooted(one, known)))
        if n:
            open_ = still_open(open_, rooted(every, known))
        if n * 20 < open_.count():
            break
    if not open_.isEmpty():
        meet(materialize(pairs_of_large(open_, threshold), "pairs"))
    discard(sets, large, pairs, several)

    named = rooted(members.select("member", "doc_id"), known)
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = named.join(least, "root").select("member", "component_id", F.col("root").alias("component"))
    # all copies of a text are rows of one member
    out = spread_join(rows, named, "member", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), *(["key", "component"] if key_col else []))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents").select("doc_id", "text"))
