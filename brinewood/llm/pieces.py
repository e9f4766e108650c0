"""SentencePiece encoding and decoding through a table of distinct chunks.

With a model whose pieces never reach over a white space marker, a text's ids are those of its chunks (a run of markers
and what follows up to the next) put in a row. So texts become codes of a block's own dictionary; dictionaries are dealt
by a hash of the chunk into buckets, where each distinct chunk is segmented once by the library; the ids return to their
blocks and are put in the chunks' places, and the library decodes each row of ids.

A block is a part of one task's rows, at most block_chars characters and the document that reaches them. What is shuffled
are dictionaries and their ids, packed by block and bucket; codes stay where they were written, bucketed by block.
A chunk that every document holds is one entry of each block's dictionary.

Cases: a null or empty text has the end id alone and decodes to the empty text; very long texts are encoded whole, in a
block of their own if need be; repeated rows are encoded one by one, ties of merges are the library's; columns of docs
ride in the struct `row`, so their names can't clash; an empty table gives an empty result. A model of another kind, with
pieces that reach over a marker, without a leading marker or with white space removed, is an error.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brinewood.llm.common import process_cache, shared_dir, small_batches, table

MARK = "▁"
CHUNK = re.compile(f"{MARK}+[^{MARK}]*")
BLOCK_CHARS = 16_000_000
#: Bytes of text for which there is one bucket of chunks; its chunks are a part of that text.
BUCKET_BYTES = 1 << 25
DOCUMENT, ORDER, CHUNKS = 0, 1, 2
#: Files that one writing of blocks is dealt to at most; a file may hold any number of blocks.
MOST_FILES = 4096


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def processor(path: str):
    """The worker's model, kept between tasks; an error if chunks can't be segmented one by one."""
    kept = process_cache("pieces")
    if path not in kept:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (model.id_to_piece(i) for i in range(model.vocab_size()))
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces):
            raise ValueError(f"{path}: a piece reaches over a white space marker")
        if "".join(model.encode(" a  b ", out_type=str)) != f"{MARK}{MARK}a{MARK}{MARK}b{MARK}" or model.encode(""):
            raise ValueError(f"{path}: white space is not kept, or texts get no leading marker")
        kept[path] = model
    return kept[path]


def chunks_of(text: str) -> list[str]:
    """A text's chunks in order: joined, they are the marked text."""
    return CHUNK.findall(MARK + text.replace(" ", MARK)) if text else []


def segment(model, chunks: list[str]) -> list[list[int]]:
    """Ids of each chunk. The library puts a marker before a text, so a chunk goes in without its first."""
    alone = [model.piece_to_id(MARK)]
    return [found or alone for found in model.encode([c[1:] for c in chunks], num_threads=1)]


def planes(values: np.ndarray) -> bytes:
    """Unsigned 32-bit values as four planes of bytes, which compress well where values are small."""
    return values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def bucket_of(chunk: str, buckets: int) -> int:
    return zlib.crc32(chunk.encode()) % buckets


def pack(chunks: list[str]) -> bytes:
    """Chunks end with the marker they begin with, so these part them; runs of markers are kept by a count."""
    runs = np.array([len(c) - len(c.lstrip(MARK)) for c in chunks], np.uint32)
    rest = "".join(c.lstrip(MARK) + MARK for c in chunks)
    return zlib.compress(len(chunks).to_bytes(4, "little") + planes(runs) + rest.encode())


def unpack(data: bytes) -> list[str]:
    data = zlib.decompress(data)
    n = int.from_bytes(data[:4], "little")
    runs = from_planes(data[4 : 4 + 4 * n]).tolist()
    return [MARK * k + rest for k, rest in zip(runs, data[4 + 4 * n :].decode().split(MARK)[:-1], strict=True)]


def pack_ids(ids: list[list[int]]) -> bytes:
    sizes = np.array([len(x) for x in ids], np.uint32)
    return zlib.compress(len(ids).to_bytes(4, "little") + planes(sizes) + planes(np.array([i for x in ids for i in x], np.uint32)))


def unpack_ids(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, ids)"""
    data = zlib.decompress(data)
    n = int.from_bytes(data[:4], "little")
    return from_planes(data[4 : 4 + 4 * n]).astype(np.int64), from_planes(data[4 + 4 * n :]).astype(np.int32)


def coded(rows: DataFrame, buckets: int, block_chars: int) -> DataFrame:
    """rows(task, row, text) -> (block, kind, bucket, row, data): each document as codes of its block's dictionary, the
    bucket of each of its entries (ORDER), and the entries of each bucket (CHUNKS), in the order of their codes."""
    row_type = rows.schema["row"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[str, int] = {}
        block, number, chars = None, 0, 0
        names = ["block", "kind", "bucket", "row", "data"]

        def documents(batch: pa.RecordBatch, at: int, made: list[bytes], blocks: list[int]) -> pa.RecordBatch:
            n = len(made)
            columns = [pa.array(blocks, pa.int64()), pa.array([DOCUMENT] * n, pa.int8()), pa.nulls(n, pa.int64()), batch.column(1).slice(at, n), pa.array(made, pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names)

        def closed(kind: pa.DataType) -> pa.RecordBatch:
            of: list[list[str]] = [[] for _ in range(buckets)]
            order = np.empty(len(codes), np.uint32)
            for i, c in enumerate(codes):
                order[i] = b = bucket_of(c, buckets)
                of[b].append(c)
            out = [(ORDER, None, zlib.compress(planes(order))), *((CHUNKS, b, pack(own)) for b, own in enumerate(of) if own)]
            kinds, places, data = zip(*out, strict=True)
            n = len(out)
            columns = [pa.array([block] * n, pa.int64()), pa.array(kinds, pa.int8()), pa.array(places, pa.int64()), pa.nulls(n, kind), pa.array(data, pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            row_kind = batch.column(1).type
            task = batch.column(0)[0].as_py() if batch.num_rows else None
            made, blocks, at = [], [], 0
            for text in batch.column(2).to_pylist():
                if block is None:
                    block, number = (task << 32) + number, number + 1
                own = np.array([codes.setdefault(c, len(codes)) for c in chunks_of(text or "")], np.uint32)
                made.append(planes(own))
                blocks.append(block)
                chars += len(text or "")
                if chars >= block_chars:
                    yield documents(batch, at, made, blocks)
                    yield closed(row_kind)
                    at, made, blocks, block, chars = at + len(made), [], [], None, 0
                    codes.clear()
            if made:
                yield documents(batch, at, made, blocks)
        if block is not None:
            yield closed(row_kind)

    schema = T.StructType().add("block", "long").add("kind", "byte").add("bucket", "long").add("row", row_type).add("data", "binary")
    return rows.mapInArrow(run, schema)


def segmented(dictionaries: DataFrame, path: str) -> DataFrame:
    """(block, bucket, data) of chunks -> the same of ids; a task meets all entries of a chunk and segments it once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known, now = processor(path), {}, None
        for batch in batches:
            out = []
            for bucket, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if bucket != now:
                    now, known = bucket, {}
                chunks = unpack(data)
                new = [c for c in chunks if c not in known]
                known.update(zip(new, segment(model, new), strict=True))
                out.append(pack_ids([known[c] for c in chunks]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["block", "bucket", "ids"])

    dealt = dictionaries.select("block", "bucket", "data").repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, "block long, bucket long, ids binary")


def joined(order: np.ndarray, parts: dict[int, tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ids) of a block's dictionary in the order of its codes; starts has one more than there are codes."""
    sizes = np.zeros(len(order), np.int64)
    places = {b: np.flatnonzero(order == b) for b in parts}
    for b, (own, _) in parts.items():
        sizes[places[b]] = own
    starts = np.concatenate([[0], np.cumsum(sizes)])
    ids = np.empty(starts[-1], np.int32)
    for b, (own, values) in parts.items():
        ids[spread(starts[places[b]], own)] = values
    return starts, ids


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each run, one run after the other."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


def encode_decode(docs: DataFrame, *, text_col: str = "text", path: str | None = None, end: bool = True, block_chars: int = BLOCK_CHARS, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Rows (row, ids, decoded): the other columns of docs, the ids of the whole text with the end id, and what the library
    decodes them to."""
    path = path or model_path()
    spark = docs.sparkSession
    end_id = [processor(path).eos_id()] if end else []
    small_batches(spark)
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    row = F.struct(*[c for c in docs.columns if c != text_col])
    rows = docs.select(F.spark_partition_id().cast("long").alias("task"), row.alias("row"), F.col(text_col).alias("text"))
    name = f"brinewood_pieces_{uuid.uuid4().hex}"
    files = min(MOST_FILES, max(8, 4 * size // block_chars))
    where = f"{shared_dir(spark)}/brinewood/{spark.sparkContext.applicationId}/{name}"
    writer = coded(rows, max(1, size // bucket_bytes), block_chars).write.bucketBy(files, "block").option("compression", "zstd").option("path", where)
    writer.format("parquet").saveAsTable(name)
    written = spark.table(name)
    ids = segmented(written.where(F.col("kind") == CHUNKS), path)

    def put(blocks: pa.Table, found: pa.Table) -> pa.Table:
        model = processor(path)
        kinds = blocks.column("kind").to_numpy()
        at = int(np.flatnonzero(kinds == ORDER)[0])
        order = from_planes(zlib.decompress(blocks.column("data")[at].as_py()))
        parts = {b: unpack_ids(data) for b, data in zip(found.column("bucket").to_pylist(), found.column("ids").to_pylist(), strict=True)}
        starts, values = joined(order, parts)
        own = blocks.filter(pa.array(kinds == DOCUMENT))
        every, texts = [], []
        for data in own.column("data"):
            codes = from_planes(data.as_py())
            ids = np.append(values[spread(starts[codes], starts[codes + 1] - starts[codes])], np.array(end_id, np.int32))
            every.append(ids)
            texts.append(model.decode(ids.tolist()))
        flat = pa.array(np.concatenate(every).astype(np.int32) if every else [], pa.int32())
        offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in every])]), pa.int32())
        return pa.table([own.column("row").combine_chunks(), pa.ListArray.from_arrays(offsets, flat), pa.array(texts, pa.string())], names=["row", "ids", "decoded"])

    schema = T.StructType().add("row", written.schema["row"].dataType).add("ids", T.ArrayType(T.IntegerType())).add("decoded", "string")
    documents = written.where(F.col("kind") != CHUNKS).select("block", "kind", "row", "data")
    return documents.groupBy("block").cogroup(ids.groupBy("block")).applyInArrow(put, schema)


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every whole text of documents."""
    found = encode_decode(table(spark, sf_dir, "documents").select("doc_id", "text"))
    ids = F.concat_ws(" ", F.transform("ids", lambda i: i.cast("string")))
    return found.select("row.doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
