"""Media columns with content-defined chunking.

A text becomes a payload, the payload the samples of an 8-bit wave file, and the file's bytes are cut where a rolling
gear hash of the last 32 bytes says so. Chunks that occur once stay in their document's row. Chunks that may occur
again go to a chunk store that Spark joins keep free of duplicates; documents list their chunks by digest, in order,
and are read back by joining the list to the store. What is read back has to have the digest of what was written.

Cases: a null text counts as empty; an empty text is 64 zero bytes; equal texts give equal values; repeated rows are
stored once and listed each; very long texts are whole files of many chunks; of equal chunks that several tasks give, the
one written first stays; only the two named columns are read, so others may have any name; an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brinewood.llm.common import materialize, small_batches, spread_join, table

UNIT = 64
SAMPLE_RATE = 8000
#: Bytes of a chunk: least and most, and how many leading bits of the hash have to be 0 at a cut.
LEAST, MOST, CUT_BITS = 512, 8192, 10
#: Bits of the filter that tells chunks that may occur again. More marks than bits only send more chunks to the store.
FILTER_BITS = 1 << 24
GEAR = np.random.default_rng(2654435769).integers(0, 1 << 32, 256, dtype=np.uint32)


def wave_file(payload: bytes, rate: int = SAMPLE_RATE) -> bytes:
    """One channel of 8-bit samples."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload)) + payload


def samples_of(media: bytes) -> bytes:
    """The samples of a wave file with 8-bit samples."""
    riff, size, wave, at = *struct.unpack_from("<4sI4s", media), 12
    if (riff, wave) != (b"RIFF", b"WAVE") or size + 8 != len(media):
        raise ValueError("not a whole wave file")
    while True:
        name, n = struct.unpack_from("<4sI", media, at)
        if name == b"data":
            return media[at + 8 : at + 8 + n]
        at += 8 + n + n % 2


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes, zeros up to a positive multiple of 64, and the length before."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data.ljust(max(UNIT, -(-len(data) // UNIT) * UNIT), b"\0"), len(data)


def cuts(files: list[bytes]) -> list[list[int]]:
    """The ends of each file's chunks."""
    data = np.frombuffer(b"".join(files), np.uint8)
    # h[i] = sum of GEAR[data[i - j]] << j over the last 32 bytes, by doubling the window
    h, width = GEAR[data], 1
    while width < 32:
        h[width:] += h[:-width] << np.uint32(width)
        width *= 2
    marks = (np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0) + 1).tolist()
    out, start = [], 0
    for f in files:
        end, at, own = start + len(f), start, []
        while end - at > LEAST:
            k = bisect_left(marks, at + LEAST)
            at = min(marks[k] if k < len(marks) else end, at + MOST, end)
            own.append(at - start)
        if at < end:
            own.append(len(f))
        out.append(own)
        start = end
    return out


def chunks(files: list[bytes]) -> list[list[bytes]]:
    return [[f[a:b] for a, b in zip([0, *ends], ends, strict=False)] for f, ends in zip(files, cuts(files), strict=True)]


def digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def place(found: bytes) -> int:
    return int.from_bytes(found[:8], "little") % FILTER_BITS


def _each(batches: Iterator[pa.RecordBatch], text_at: int):
    for batch in batches:
        for lo in range(0, batch.num_rows, 200):
            some = batch.slice(lo, 200)
            payloads = [payload_of(t) for t in some.column(text_at).to_pylist()]
            files = [wave_file(p) for p, _ in payloads]
            yield some, [n for _, n in payloads], files, chunks(files)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, _, _, parts in _each(batches, 0):
        found = [digest(c) for p in parts for c in p]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array([place(d) for d in found], pa.int64())], ["digest", "place"])


#: Kinds of rows in the store: a document that holds all its chunks, one that lists some by digest, a chunk.
WHOLE, LISTED, CHUNK = 0, 1, 2


def store(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents, chunks), both written: (rid, id, kind, n_bytes, media_sha256, digests, inline) and (digest, chunk)."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col(text_col).alias("text"))
    again = texts.mapInArrow(_digests, "digest binary, place long").groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("place")).where("n > 1")
    bits = again.groupBy(F.bitmap_bucket_number(F.col("place") + 1).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("place") + 1)).alias("bits"))
    marks = np.zeros((FILTER_BITS // 32768, 4096), np.uint8)
    for r in bits.collect():
        marks[r["k"] - 1] = np.frombuffer(r["bits"], np.uint8)
    sent = spark.sparkContext.broadcast(marks.reshape(-1).tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bit, given = sent.value, set()
        for batch, sizes, files, parts in _each(batches, 1):
            rows: list[tuple] = []
            extra: list[tuple] = []
            for i, (n, f, own) in enumerate(zip(sizes, files, parts, strict=True)):
                found = [digest(c) for c in own]
                shared = [bit[(p := place(d)) >> 3] >> (p & 7) & 1 for d in found]
                rows.append((i, LISTED if any(shared) else WHOLE, n, hashlib.sha256(f).hexdigest(), found, [None if s else c for s, c in zip(shared, own, strict=True)], None, None))
                for d, s, c in zip(found, shared, own, strict=True):
                    if s and d not in given:
                        extra.append((None, CHUNK, None, None, None, None, d, c))
                        if len(given) < 1_000_000:
                            given.add(d)
            at, *columns = zip(*rows, *extra, strict=True)
            many = pa.list_(pa.binary())
            types = (pa.int8(), pa.int64(), pa.string(), many, many, pa.binary(), pa.binary())
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            ids = batch.column(0).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *arrays], ["id", "kind", "n_bytes", "media_sha256", "digests", "inline", "digest", "chunk"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, kind byte, n_bytes long, media_sha256 string, digests array<binary>, inline array<binary>, digest binary, chunk binary"
    written = materialize(rows.mapInArrow(run, schema).withColumn("rid", F.monotonically_increasing_id()), "media")
    parts = written.where(F.col("kind") == CHUNK).select("rid", "digest", "chunk")
    # of equal chunks that several tasks gave, the one written first stays
    first = parts.groupBy("digest").agg(F.min("rid").alias("rid")).select("rid")
    stored = materialize(parts.join(first, "rid", "left_semi").select("digest", "chunk"), "chunks")
    return written.where(F.col("kind") != CHUNK).drop("digest", "chunk"), stored


def read_back(documents: DataFrame, stored: DataFrame) -> DataFrame:
    """(id, n_bytes, media_sha256, chunks): each document's chunks in order."""
    columns = ["id", "n_bytes", "media_sha256"]
    whole = documents.where(F.col("kind") == WHOLE).select(*columns, F.col("inline").alias("chunks"))
    listed = documents.where(F.col("kind") == LISTED)
    wanted = listed.select("rid", F.posexplode(F.arrays_zip("digests", F.transform("inline", lambda c: c.isNull()).alias("out"))).alias("pos", "x"))
    wanted = wanted.where("x.out").select("rid", "pos", F.col("x.digests").alias("digest"))
    fetched = spread_join(wanted, stored, "digest").groupBy("rid").agg(F.map_from_entries(F.collect_list(F.struct("pos", "chunk"))).alias("fetched"))
    joined = listed.join(fetched, "rid")
    full = F.transform("inline", lambda c, i: F.coalesce(c, F.try_element_at("fetched", i)))
    return whole.unionByName(joined.select(*columns, full.alias("chunks")))


def features_of(samples: bytes) -> str:
    """Level, loudness, sign changes and entropy of 8-bit samples."""
    x = np.frombuffer(samples, np.uint8)
    n = np.bincount(x, minlength=256)
    level = np.arange(256) - 128
    mean, power = float(n @ level) / len(x), float(n @ (level * level)) / len(x)
    up = x >= 128
    changes = int(np.count_nonzero(up[1:] != up[:-1]))
    p = n[n > 0] / len(x)
    return f"rate={SAMPLE_RATE};samples={len(x)};mean={mean:.4f};rms={power**0.5:.4f};crossings={changes};entropy={float(-(p * np.log2(p)).sum()):.4f}"


def describe(read: DataFrame) -> DataFrame:
    """Figures of the media that read_back gives; media that differ from what was written are an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for written, parts in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                media = b"".join(parts)
                found = hashlib.sha256(media).hexdigest()
                if found != written:
                    raise ValueError(f"media read back as {found}, written as {written}")
                payload = samples_of(media)
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), found, features_of(payload)))
            columns = list(zip(*out, strict=True)) or [()] * 6
            types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["id", "n_bytes", *names])

    kind = read.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return read.select("id", "n_bytes", "media_sha256", "chunks").mapInArrow(run, schema)


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, stored = store(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return describe(read_back(documents, stored)).withColumnRenamed("id", "doc_id")
