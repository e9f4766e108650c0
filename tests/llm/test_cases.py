"""Hard cases for every corpus operator and pipeline stage: nulls, empty and long texts, ties, repeated rows, empty
tables, and further columns with clashing names."""

import hashlib
import zlib

import pytest
from pyspark.sql import types as T

import corpus_pipeline
from brinewood.llm import queries

LONG = "word " * 30_000 + "end"
PROSE = {"en": "the quick brown fox jumps over the lazy dog while it rains and the wind blows", "fr": "le renard brun saute par dessus le chien paresseux pendant que la pluie tombe encore"}

DOCS = [
    (0, PROSE["en"], "en", "a", 5),
    (1, PROSE["en"].upper(), "en", "a", 5),
    (2, None, "en", "a", None),
    (3, "", None, None, 0),
    (4, " \t\n", "en", "b", 3),
    (5, "12345 !!! 678", "en", "b", 3),
    (6, LONG, "en", "b", len(LONG)),
    (7, PROSE["fr"], "fr", None, 9),
    (7, PROSE["fr"], "fr", None, 9),
    (None, PROSE["fr"], "fr", "c", 9),
    (None, None, None, None, None),
    (8, 'my password = "hunter22hunter" and AKIA' + "A1" * 10 + " or " + "0123456789abcdef" * 3, "en", "c", 1),
    (9, "password: token: abcdefgh secret=abc", "en", "c", 1),
    (10, "one two", "en", "c", 7),
    (11, "one  two", "en", "d", 7),
    (12, "<|endoftext|> a  b   c    é\U0001f600 ſecret", "en", "d", 7),
    (13, "x" * 5000, "en", "d", 5000),
]
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
EXTRA = T.StructType([*SCHEMA.fields, *[T.StructField(c, T.StringType()) for c in ("rid", "row", "spans", "shard", "member", "_hash", "size", "score", "lang_pred", "held_out")]])
TURNS = "conv_id long, turn long, role string, text string, rid string"
TURN_ROWS = [(1, 0, "user", "hi?", "x"), (1, 1, "assistant", "hello there\nhow are you", "x"), (1, 1, "assistant", "hello there\nhow are you", "x"), (2, None, None, None, None), (None, 0, "user", "", "x"), (None, 5000, "assistant", LONG, "x"), (None, 9000, "user", "bye", "x")]
VECTORS = [(i, [float(i % 7), float(i % 5), 1.0]) for i in range(1, 60)]
VECTORS += [(100, None), (120, [0.0, 0.0, 0.0]), (140, [1.0, None, 2.0]), (160, [float("nan"), 1.0, 1.0]), (180, [float("inf"), 1.0, 1.0]), (200, [1.0, 2.0]), (20, [6.0, 0.0, 1.0]), (None, [1.0, 1.0, 1.0])]


def write(spark, path, rows):
    docs = [(*r, *["clash"] * 10) for r in DOCS] if rows else []
    frames = {
        "documents": spark.createDataFrame(docs, EXTRA),
        "labels": spark.createDataFrame([(0, 1, 0), (1, 0, 0), (6, 1, None), (7, None, 1), (None, 1, 1), (99, 1, 0)] if rows else [], "doc_id long, quality int, toxic int"),
        "embeddings": spark.createDataFrame(VECTORS if rows else [], "vec_id long, embedding array<float>"),
        "conversations": spark.createDataFrame(TURN_ROWS if rows else [], TURNS),
    }
    for name, df in frames.items():
        df.repartition(3).write.parquet(f"{path}/{name}.parquet")
    return str(path)


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("small"), True)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("empty"), False)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables_give_empty_results(spark, empty, name):
    assert queries.QUERIES[name](spark, empty).collect() == []


def by_id(rows):
    out = {}
    for r in rows:
        out.setdefault(r["doc_id"], []).append(r)
    return out


def expected_base(text):
    import re

    text, spans = text or "", []
    keyword = "|".join(["password", "passwd", "secret", "token", "api_?key"])
    pattern = re.compile(rf"""((?ai:{keyword}))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    spans += [(m.start(), 0, m.end()) for m in pattern.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(spans)]


def test_op1(spark, small):
    rows = by_id(queries.QUERIES["op1_secret_scan"](spark, small).collect())
    assert sum(map(len, rows.values())) == len(DOCS)
    texts = {d: t for d, t, *_ in DOCS if d is not None}
    for d, t in texts.items():
        base = expected_base(t)
        for r in rows[d]:
            assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
            assert set(base) <= set(r.spans.split(",")) | {""}
    assert rows[8][0].n_assign == rows[8][0].n_access == rows[8][0].n_hex == 1
    assert rows[9][0].n_assign == 0  # the value "token" is too short, and matching goes on after it


def test_op2(spark, small):
    rows = queries.QUERIES["op2_mix_sources"](spark, small).collect()
    assert len(rows) == len(DOCS)
    assert all(r.taken <= 3 * r["size"] and (r["size"] == 0) <= (r.taken == 0) for r in rows)
    total = sum(r["size"] for r in rows)
    sizes = {(r.source_size, r.target) for r in rows}
    assert sum(t for _, t in sizes) == pytest.approx(total)
    again = queries.QUERIES["op2_mix_sources"](spark, small).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_op3(spark, small):
    rows = queries.QUERIES["op3_shard_documents"](spark, small).collect()
    assert len(rows) == len(DOCS)
    shards = {}
    for r in rows:
        assert 0 <= r.shard < 24 and r.grown_shard in (r.shard, 24)
        shards.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())
    text = {d: t for d, t, *_ in DOCS}
    for r in rows:
        if r.doc_id is not None:
            data = (text[r.doc_id] or "").encode()
            assert (r["size"], r.text_crc32) == (len(data) + 8, zlib.crc32(data))


def test_op4(spark, small):
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = queries.QUERIES["op4_pack_sequences"](spark, small).collect()
    text = {d: t for d, t, *_ in DOCS}
    for d, pieces in by_id(rows).items():
        if d in (None, 7):
            continue
        ids = np.array([*tokenizer.encode(text[d] or "", add_special_tokens=False).ids, 2], "<u4")
        pieces.sort(key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(len(pieces))) and sum(r.length for r in pieces) == len(ids)
        at = 0
        for r in pieces:
            assert (r.start, r.ids_crc32) == (at, zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert all(r.length == 1024 for r in pieces[1:])
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in places.values():
        p.sort()
        assert [o for o, _ in p] == [sum(n for _, n in p[:k]) for k in range(len(p))] and sum(n for _, n in p) <= 1024


def test_op5(spark, small):
    rows = by_id(queries.QUERIES["op5_language_id"](spark, small).collect())
    assert sum(map(len, rows.values())) == len(DOCS)
    for d in (2, 3, 4, 5):
        assert rows[d][0].lang_pred == "und" and rows[d][0].score == 0
    assert rows[0][0].lang_pred in ("en", "fr") and 0 <= rows[0][0].score <= 1
    assert len({(r.lang_pred, r.score) for r in rows[7]}) == 1
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) for d, rs in rows.items() if d is not None for r in rs)


def test_op6(spark, small):
    rows = queries.QUERIES["op6_media_columns"](spark, small).collect()
    assert len(rows) == len(DOCS)
    text = {d: t for d, t, *_ in DOCS}
    seen = {}
    for r in rows:
        if r.doc_id is None:
            continue
        data = (text[r.doc_id] or "").encode()
        payload = data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(data), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r.tail_crc32, r.media_bytes) == (zlib.crc32(payload[-64:]), len(payload) + 44)
        assert seen.setdefault(data, (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)


def test_op7(spark, small):
    rows = by_id(queries.QUERIES["op7_quality"](spark, small).collect())
    assert sum(map(len, rows.values())) == len(DOCS)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for rs in rows.values() for r in rs)
    assert len({r.score for d in (2, 3, 4) for r in rows[d]}) == 1


def test_op8(spark, small):
    rows = by_id(queries.QUERIES["op8_ngram_join"](spark, small).collect())
    assert sum(map(len, rows.values())) == len(DOCS)
    assert rows[1][0].component_id == 0 and rows[0][0].component_id == 0
    assert [r.component_id for r in rows[7]] == [7, 7]
    assert rows[10][0].n_shingles == 1 and rows[11][0].component_id == 10
    for d in (2, 3, 4):
        assert (rows[d][0].n_shingles, rows[d][0].component_id) == (0, d)
    assert {r.component_id for r in rows[None]} == {7, None}
    assert rows[6][0].n_shingles == 2  # one word over and over, and the end


def test_op9(spark, small):
    rows = queries.QUERIES["op9_nearest"](spark, small).collect()
    assert {r.query_id for r in rows} == {20, 40}
    vectors = dict(v for v in VECTORS[:59])
    for q in (40,):
        mine = sorted((r for r in rows if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, 21))
        assert all(r.vec_id != q for r in mine)
        assert [(-r.score, r.vec_id) for r in mine] == sorted((-r.score, r.vec_id) for r in mine)
        best = max(sum(x * y for x, y in zip(vectors[q], v, strict=True)) for i, v in vectors.items() if i != q)
        assert mine[0].score == best


def test_op10(spark, small):
    rows = queries.QUERIES["op10_chat_roles"](spark, small).collect()
    assert len(rows) == len(TURN_ROWS)
    assert all(r.role_pred in ("assistant", "system", "tool", "user") and r.rendered.startswith(f"<|{r.role_pred}|>\n") and r.rendered.endswith("\n<|end|>") for r in rows)


def test_stages(spark, small, empty):
    for sf_dir in (small, empty):
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf_dir)
            assert out.columns == list(corpus_pipeline.COLUMNS), name
            out.collect()
    docs = spark.read.parquet(f"{small}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = [r.doc_id for r in stages["language_id"](spark, docs, small).collect()]
    assert sorted(str(k) for k in kept) == sorted(str(d) for d, t, *_ in DOCS if t and any(c.isalpha() for c in t))
    kept = [r.doc_id for r in stages["near_duplicates"](spark, docs, small).collect()]
    assert kept.count(7) == 1 and 1 not in kept and 11 not in kept and kept.count(None) == 2
    texts = {r.doc_id: r.text for r in stages["secret_scan"](spark, docs, small).collect()}
    assert texts[8].startswith("my <secret:assign>") and "0123456789abcdef" not in texts[8]
    assert texts[9] == DOCS[12][1] and texts[2] is None


def test_pipeline_runs(spark, small):
    rows = corpus_pipeline.run(spark, small).collect()
    assert rows and {"doc_id", "sequence_id", "offset"} <= set(rows[0].asDict())
