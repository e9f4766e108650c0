"""Best-fit packing of tokenised documents into sequences, improved by swap-based local search.

Documents longer than a sequence are cut; whole-length pieces are sequences by themselves. All other pieces are
dealt into blocks of bounded size. A block is packed by best fit, longest first, and then its underfull bins trade:
single moves, one-for-one and two-for-one exchanges that raise the sum of squared fills, until none is left or a lower
bound on the bins is met.

Cases: a null text counts as empty and is one piece of the end id alone; repeated rows are packed one by one;
very long texts are cut into pieces; pieces of equal length are interchangeable and go in the order of their rows' numbers;
only the two named columns are read, so others may have any name; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brinewood.llm.common import materialize, process_cache, small_batches, table

LENGTH = 1024
END_ID = 2
#: Pieces that one packing task holds; each block wastes a part of a sequence at most.
BLOCK = 8192
#: Encoded runs or words that a worker keeps, and their characters.
CACHED_WORDS, CACHED_CHARS = 1_000_000, 16_000_000
#: The letters of texts that are cut into runs here: Latin and Cyrillic ones that are letters in every version of Unicode.
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏЀ-ҁҊ-ԓ"
#: The byte-level pre-tokenizer's own cut of a text, for texts of these letters, printable ASCII and line ends.
RUNS = re.compile(rf" ?[{LETTERS}]+|'(?:[stmd]|re|ve|ll)| ?[0-9]+| ?[^\s{LETTERS}0-9]+|\s+(?!\S)|\s+")
CUT_HERE = re.compile(rf"[ -~\n{LETTERS}]*")
SIGNS = [c for c in map(chr, range(33, 127)) if not c.isalpha()]


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Texts to packed 32-bit ids.

    A byte-level tokenizer cuts a text into runs of letters, digits, signs or white space and encodes each by itself. Texts of
    known letters are cut here in the same way, and each run is encoded once and kept. Other texts are split before each
    single space that a word follows, as the tokenizer does too, and the parts are kept; where their white space is doubled,
    the whole text is encoded instead.
    """

    def __init__(self, path: str, cached: int = CACHED_WORDS) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.cached, self.ids, self.chars = Tokenizer.from_file(path), cached, {}, 0
        self.line_end = self.tokenizer.encode("\n", add_special_tokens=False).ids[-1]
        self.lines = self._by_lines()

    def _by_lines(self):
        """The same model for texts whose lines are runs, which needn't be cut any more; none if the cut is another one."""
        from tokenizers import Tokenizer, pre_tokenizers

        own = json.loads(self.tokenizer.to_str())
        cut = own["pre_tokenizer"] or {}
        if own["normalizer"] or own["post_processor"] or (cut.get("type"), cut.get("add_prefix_space"), cut.get("use_regex")) != ("ByteLevel", False, True):
            return None
        if any("<|" not in t["content"] for t in own["added_tokens"]):
            return None
        out = Tokenizer.from_str(json.dumps(own | {"added_tokens": []}))
        out.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split("\n", "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        return out

    def _each_line(self, tokenizer, parts: list[str], at_once: int) -> dict[str, bytes]:
        """Ids of parts without line ends, many at a time, one a line: no token spans a line's end."""
        found: dict[str, bytes] = {}
        lines = [parts[i : i + at_once] for i in range(0, len(parts), at_once)]
        for own, e in zip(lines, tokenizer.encode_batch_fast(["\n".join(x) + "\n" for x in lines], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            ends = np.flatnonzero(ids == self.line_end).tolist()
            if len(ends) == len(own):
                data = ids.tobytes()
                found.update((p, data[4 * a : 4 * b]) for p, a, b in zip(own, [0, *(x + 1 for x in ends[:-1])], ends, strict=True))
        return found

    def _fresh(self, parts: list[str], tokenizer, at_once: int) -> list[bytes]:
        """Ids of each part. Parts of one word or run are encoded many at a time."""
        if tokenizer is self.lines:
            plain = [p for p in parts if p[-1:].isalpha()]
        else:
            plain = [p for p in parts if p[:1] == " " and p[1:].split() == [p[1:]] and "<|" not in p]
        found = self._each_line(tokenizer, plain, at_once)
        rest = [p for p in parts if p not in found]
        found.update(zip(rest, (np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)), strict=True))
        return [found[p] for p in parts]

    def _runs(self, text: str) -> list[str] | None:
        """The runs of a text; where it holds neither apostrophes nor doubled white space, digits and signs that meet stay together."""
        if self.lines is None or "<|" in text or not CUT_HERE.fullmatch(text):
            return None
        if "'" in text or "  " in text or "\n\n" in text or "\n " in text or " \n" in text:
            return RUNS.findall(text)
        for c in SIGNS:
            if c in text:
                text = text.replace(c, f"\1{c}\2")
        text = text.replace("\2\1", "").replace(" \1", " ")  # signs that meet stay together, and with the space before them
        return text.replace("\1", "\0").replace("\2", "\0").replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0")

    def _parts(self, text: str) -> list[str] | None:
        if "  " in text or "\0" in text:
            return None
        return text.replace(" ", "\0 ").split("\0")

    def encode(self, texts: list[str]) -> list[bytes]:
        runs = [self._runs(t) for t in texts]
        split = [self._parts(t) if r is None else None for t, r in zip(texts, runs, strict=True)]

        def new() -> tuple[list[str], list[str]]:
            """Runs and parts that aren't kept yet; either is what the tokenizer makes of it alone."""
            cut = set().union(*[r for r in runs if r]).difference(self.ids)
            return list(cut), list(set().union(*[p for p in split if p]).difference(self.ids, cut))

        cut, parts = new()
        if len(self.ids) + len(cut) + len(parts) > self.cached or self.chars > CACHED_CHARS:
            self.ids.clear()
            self.chars = 0
            cut, parts = new()
        self.chars += sum(map(len, cut)) + sum(map(len, parts))
        self.ids.update(zip(cut, self._fresh(cut, self.lines, 500), strict=True))
        self.ids.update(zip(parts, self._fresh(parts, self.tokenizer, 2000), strict=True))
        whole = iter(self._fresh([t for t, r, p in zip(texts, runs, split, strict=True) if r is None and p is None], self.tokenizer, 2000))
        get = self.ids.__getitem__
        return [next(whole) if r is None and p is None else b"".join(map(get, p if r is None else r)) for r, p in zip(runs, split, strict=True)]


def encoder(path: str) -> Encoder:
    """The worker's encoder, kept between tasks."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    kept = process_cache("encoders")
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


def pieces_of(path: str, length: int, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(rid, text) -> (rid, piece, start, length, ids_crc32)."""
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for batch in batches:
            rows = batch.column(0).to_pylist()
            texts = [t or "" for t in batch.column(1).to_pylist()]
            out: list[tuple[int, int, int, int, int]] = []
            for lo in range(0, len(rows), 100):
                for rid, ids in zip(rows[lo : lo + 100], encode(texts[lo : lo + 100]), strict=True):
                    data = ids + end
                    n = len(data) // 4
                    start, stop, piece = 0, (n - 1) % length + 1, 0
                    while start < n:
                        out.append((rid, piece, start, stop - start, zlib.crc32(data[4 * start : 4 * stop])))
                        start, stop, piece = stop, stop + length, piece + 1
            columns = list(zip(*out, strict=True)) or [()] * 5
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["rid", "piece", "start", "length", "ids_crc32"])

    return run


def pack_block(sizes: list[int], capacity: int = LENGTH) -> list[list[int]]:
    """Bins of indices into sizes: best fit, longest first, then local search."""
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins: list[list[int]] = []
    free_mask = 0  # bit f: some bin has f free
    for i in order:
        size = sizes[i]
        fits = free_mask >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            b = by_free[free].pop()
            if not by_free[free]:
                free_mask &= ~(1 << free)
        else:
            free, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        if free > size:
            by_free[free - size].append(b)
            free_mask |= 1 << free - size
    least = least_bins(sizes, capacity)
    if len(bins) > least:
        bins = improve(bins, sizes, capacity, least)
    return bins


def least_bins(sizes: list[int], capacity: int) -> int:
    """A lower bound: by the sum, and for each a by the pieces over half a bin and what those of at least a need beside them."""
    if not sizes:
        return 0
    n = np.bincount(sizes, minlength=capacity + 2).astype(np.int64)
    count, total = np.cumsum(n), np.cumsum(n * np.arange(len(n)))
    half = capacity // 2
    a = np.arange(half + 1)
    big = count[capacity - a] - count[half]  # over half, with room for a piece of a
    room = big * capacity - (total[capacity - a] - total[half])
    small = total[half] - np.where(a > 0, total[a - 1], 0)
    return int((count[capacity] - count[half] + np.maximum(0, -(-(small - room) // capacity))).max())


def improve(bins: list[list[int]], sizes: list[int], capacity: int, least: int = 0) -> list[list[int]]:
    """Trade between bins so that fuller ones fill up and the emptiest empty out, until no trade is left or `least` bins are.

    A trade moves one piece, or exchanges one for one, two for one or one for two, between two underfull bins, and raises
    the sum of squared fills. Givers are found by what they offer: for each total of one piece or two, a heap of the bins
    that have it, emptiest first; a bin's entries lapse when it changes. When no such trade is left, full bins open: two of
    a full bin's pieces change places with one piece of the same size of an underfull bin, which then has more to offer.
    That keeps all fills and moves a piece more into the underfull bins. Either raises (sum of squares, pieces in underfull
    bins), so the search ends.
    """
    bins = [list(b) for b in bins]
    fill = [sum(sizes[i] for i in b) for b in bins]
    version = [0] * len(bins)
    heaps: list[list[list[tuple[int, int, int]]]] = [[[] for _ in range(capacity + 1)] for _ in range(2)]
    masks = [0, 0]  # bit t: some underfull bin may offer a total of t, by one piece or by two
    closed: dict[int, list[tuple[int, int]]] = {}  # full bins by what two of their pieces make

    def totals(b: int) -> tuple[list[int], set[int]]:
        own = Counter(sizes[i] for i in bins[b])
        kinds = sorted(own)
        return kinds, {x + y for at, x in enumerate(kinds) for y in kinds[at:] if x != y or own[x] > 1}

    def offer(b: int) -> None:
        version[b] += 1
        if fill[b] == capacity:
            if len(bins[b]) > 2:
                for total in totals(b)[1]:
                    closed.setdefault(total, []).append((b, version[b]))
        elif fill[b]:
            for which, own in enumerate(totals(b)):
                for total in own:
                    heapq.heappush(heaps[which][total], (fill[b], b, version[b]))
                    masks[which] |= 1 << total

    def giver(which: int, total: int, taker: int, below: int) -> int | None:
        heap, own, found = heaps[which][total], None, None
        while heap:
            f, b, v = heap[0]
            if version[b] != v:
                heapq.heappop(heap)
            elif b == taker:
                own = heapq.heappop(heap)
            else:
                found = b if f < below else None
                break
        if own:
            heapq.heappush(heap, own)
        if not heap:
            masks[which] &= ~(1 << total)
        return found

    def best_trade(taker: int) -> tuple[int, int, int, int, int] | None:
        """(giver, one piece or two, total given, pieces taken, size taken) so that the taker gains most, up to its room."""
        best, found, room = 0, None, capacity - fill[taker]
        one, two = totals(taker)
        for which, number, takes in ((0, 0, [0]), (0, 1, one), (1, 1, one), (0, 2, sorted(two))):
            for size in takes:
                window = masks[which] & ((1 << min(size + room, capacity) + 1) - (1 << size + best + 1))
                while window > 0:
                    total = window.bit_length() - 1
                    b = giver(which, total, taker, fill[taker] + total - size)
                    if b is not None:
                        best, found = total - size, (b, which, total, number, size)
                        break
                    window ^= 1 << total
                if best == room:
                    return found
        return found

    def pick(b: int, number: int, total: int) -> list[int]:
        if number < 2:
            return [next(i for i in bins[b] if sizes[i] == total)] if number else []
        seen: dict[int, int] = {}
        for i in bins[b]:
            if total - sizes[i] in seen:
                return [seen[total - sizes[i]], i]
            seen[sizes[i]] = i
        raise AssertionError("an offer that its bin can't keep")

    def exchange(b: int, gives: list[int], taker: int, takes: list[int]) -> None:
        bins[b] = [i for i in bins[b] if i not in gives] + takes
        bins[taker] = [i for i in bins[taker] if i not in takes] + gives
        gain = sum(sizes[i] for i in gives) - sum(sizes[i] for i in takes)
        fill[b] -= gain
        fill[taker] += gain
        offer(b)
        offer(taker)

    def unlock() -> bool:
        """Pieces of full bins for one of an underfull bin, wherever two of them make its size."""
        any_ = False
        for taker in range(len(bins)):
            if 0 < fill[taker] < capacity:
                for i in list(bins[taker]):
                    found = closed.get(sizes[i], [])
                    while found and version[found[-1][0]] != found[-1][1]:
                        found.pop()
                    if found:
                        b, _ = found.pop()
                        exchange(b, pick(b, 2, sizes[i]), taker, [i])
                        any_ = True
        return any_

    for b in range(len(bins)):
        offer(b)
    n_open = len(bins)
    while n_open > least:
        changed = False
        for taker in sorted((b for b in range(len(bins)) if 0 < fill[b] < capacity), key=lambda b: -fill[b]):
            while 0 < fill[taker] < capacity and (trade := best_trade(taker)):
                b, which, total, number, size = trade
                exchange(b, pick(b, which + 1, total), taker, pick(taker, number, size))
                changed = True
                n_open -= not bins[b]
                if n_open <= least:
                    return [x for x in bins if x]
        if not changed and not unlock():
            break
    return [x for x in bins if x]


def pack(docs: DataFrame, *, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), path: str | None = None, length: int = LENGTH, end_id: int = END_ID, block: int = BLOCK) -> DataFrame:
    """Per piece: row (the columns `keep`), piece, start, length, ids_crc32, sequence_id and offset in the sequence.

    Texts are read and encoded once; only the lengths are dealt out, by a hash of a row number, so that neither
    copies nor a frequent length gather in one task.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.struct(*keep).alias("row"), F.col(text_col).alias("text"))
    run = pieces_of(path or tokenizer_path(), length, end_id)
    # the row's own columns ride along as one more column of the batch
    kind = rows.schema["row"].dataType

    def with_row(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = batch.column(1)
            for out in run(iter([pa.RecordBatch.from_arrays([pa.array(range(batch.num_rows), pa.int64()), batch.column(2)], ["rid", "text"])])):
                at = out.column(0)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), given.take(at), *out.columns[1:]], ["rid", "row", *out.schema.names[1:]])

    schema = f"rid long, row {kind.simpleString()}, piece int, start long, length long, ids_crc32 long"
    pieces = rows.mapInArrow(with_row, schema).withColumn("rid", F.monotonically_increasing_id())
    pieces = materialize(pieces, "pieces")
    short = pieces.where(F.col("length") < length).select("rid", "length")
    blocks = max(1, -(-short.count() // block))

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rid", ignore_index=True)
        rid, sizes = pdf["rid"].to_numpy(), pdf["length"].tolist()
        out = [(rid[i], rid[b[0]] * 2 + 1, sum(sizes[j] for j in b[:x])) for b in pack_block(sizes, length) for x, i in enumerate(b)]
        return pd.DataFrame(out, columns=["rid", "sequence_id", "offset"])

    dealt = short.withColumn("block", F.pmod(F.xxhash64("rid"), F.lit(blocks)))
    placed = dealt.groupBy("block").applyInPandas(place, "rid long, sequence_id long, offset long")
    full = pieces.where(F.col("length") == length).withColumns({"sequence_id": F.col("rid") * 2, "offset": F.lit(0).cast("long")})
    return pieces.where(F.col("length") < length).join(placed, "rid").unionByName(full).drop("rid")


def op4_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return packed.select(F.col("row.doc_id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def sequences(packed: DataFrame, docs: DataFrame, *, key: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """The sequences themselves: (sequence_id, ids), each piece's ids in the place that `packed` gives it.

    Needs keys that name one row each. A sequence gathers at most its own length in ids.
    """
    small_batches(docs.sparkSession)
    where = path or tokenizer_path()

    @F.pandas_udf("array<int>")
    def ids_of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder(where).encode
        for part in texts:
            yield pd.Series([[*np.frombuffer(x, "<u4").tolist(), end_id] for x in encode([t or "" for t in part])])

    cut: Column = F.slice("ids", (F.col("start") + 1).cast("int"), F.col("length").cast("int"))
    whole = docs.select(F.col(key).alias("_key"), ids_of(F.col(text_col)).alias("ids"))
    parts = packed.join(whole, F.col(f"row.{key}").eqNullSafe(F.col("_key"))).select("sequence_id", F.struct("offset", cut.alias("ids")).alias("part"))
    return parts.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list("part")), lambda p: p["ids"])).alias("ids"))
