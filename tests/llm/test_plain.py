"""Queries and stages against plain versions of the same rules: jump hash, embeddings, the pipeline's stages, recall."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from brinewood.llm import ann, packing, quality, secrets, sharding
from brinewood.llm.queries import QUERIES
from tests_llm_shared import components_of

SF = "/root/testdata/sf0.001"


def jump(key, shards):
    """One key at a time, in whole numbers."""
    shard, ahead = -1, 0
    while ahead < shards:
        shard = ahead
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        ahead = int((shard + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return shard


def test_shards_are_those_of_one_key_at_a_time(spark):
    keys = np.random.default_rng(1).integers(0, 1 << 64, 3000, dtype=np.uint64)
    for n in (1, 2, 24, 1000):
        assert sharding.jump_hash(keys, n).tolist() == [jump(int(k), n) for k in keys]
    hashes = {r[0]: r[1] % (1 << 64) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.xxhash64("doc_id")).collect()}
    for r in QUERIES["op3_shard_documents"](spark, SF).collect():
        assert (r.shard, r.grown_shard) == (jump(hashes[r.doc_id], 24), jump(hashes[r.doc_id], 25))


def test_scores_are_those_of_a_plain_forward_pass(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.train(docs, labels)
    own = model.labels.index(1)
    for r in quality.predict(docs.select("doc_id", "text"), model, 1).collect():
        at, share = model.features(r.text, {})
        logit = (model.vectors[at] * share[:, None]).sum(0) @ model.out + model.bias
        p = np.exp(logit - logit.max())
        assert r.score == pytest.approx(p[own] / p.sum(), abs=2e-4)


def test_stages_against_plain_versions(spark):
    """Each stage on the whole small table, judged on its own input."""
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.collect()

    kept = stages["language_id"](spark, docs, SF).collect()
    assert sorted(r.doc_id for r in kept) == sorted(r.doc_id for r in rows if any(map(str.isalpha, r.text or "")))

    expected, sizes = components_of([r.text for r in rows])
    first = {}
    for i, c in enumerate(expected):
        if sizes[i]:
            first[c] = min(first.get(c, rows[i].doc_id), rows[i].doc_id)
    plain = sorted([*first.values(), *(r.doc_id for i, r in enumerate(rows) if not sizes[i])])
    assert sorted(r.doc_id for r in stages["near_duplicates"](spark, docs, SF).collect()) == plain

    spans = {r.row.doc_id: r.spans for r in secrets.scan(docs).collect()}
    for r, old in zip(sorted(stages["secret_scan"](spark, docs, SF).collect(), key=lambda r: r.doc_id), sorted(rows, key=lambda r: r.doc_id), strict=True):
        text, at = "", 0
        for s in spans[r.doc_id]:
            if s.start >= at:
                text += old.text[at : s.start] + ("<secret:" if s.live else "<example:") + secrets.KINDS[s.kind] + ">"
            at = max(at, s.end)
        assert r.text == text + (old.text or "")[at:] and r.n_chars == (len(r.text) if spans[r.doc_id] else old.n_chars)

    mixed = stages["mix_sources"](spark, docs, SF).collect()
    words = lambda r: len((r.text or "").encode().split())
    copies = {}
    for r in mixed:
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert max(copies.values()) <= 3 and not {r.doc_id for r in rows if not words(r)} & set(copies)
    assert sum(words(r) for r in mixed) == pytest.approx(sum(map(words, rows)), rel=0.002)  # a source of ten documents can be a few words off

    packed = stages["pack_sequences"](spark, docs, SF).collect()
    lengths = {}
    for r in packed:
        lengths[r.doc_id] = lengths.get(r.doc_id, 0) + r.length
    encode = packing.Encoder(packing.tokenizer_path()).encode
    assert lengths == {r.doc_id: len(encode([r.text or ""])[0]) // 4 + 1 for r in rows}
    fills = {}
    for r in packed:
        fills[r.sequence_id] = fills.get(r.sequence_id, 0) + r.length
    assert max(fills.values()) <= 1024


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_recall_on_the_tables(spark, sf):
    path = f"/root/testdata/sf{sf}"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{path}/embeddings.parquet").select("vec_id", "embedding").collect() if r.embedding is not None]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float64)
    found = {}
    for r in QUERIES["op9_nearest"](spark, path).collect():
        found.setdefault(r.query_id, {})[r.vec_id] = r.score
    hits = []
    for q in found:
        s = x @ x[ids == q][0]
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:20]
        hits.append(len(set(ids[order].tolist()) & set(found[q])) / len(order))
        assert len(found[q]) == len(order)
    assert len(found) == (ids % 20 == 0).sum() and np.mean(hits) >= 0.95


def test_shards_grow_with_the_table():
    assert [ann.shard_count(n) for n in (0, 1, 8192, 8193, 51_282, 500_000, 1_048_576, 10_000_000)] == [1, 1, 1, 2, 7, 8, 8, 77]


def test_chat_roles_held_out(spark):
    path = "/root/testdata/sf0.1"
    roles = spark.read.parquet(f"{path}/conversations.parquet").select("conv_id", "turn", "role")
    out = QUERIES["op10_chat_roles"](spark, path).where("held_out").join(roles, ["conv_id", "turn"]).collect()
    assert len(out) > 1000 and np.mean([r.role == r.role_pred for r in out]) >= 0.96


def test_quality_held_out_on_the_table(spark):
    path = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{path}/labels.parquet").select("doc_id", "quality")
    out = QUERIES["op7_quality"](spark, path).where("held_out").join(labels, "doc_id").collect()
    good, bad = ([r.score for r in out if r.quality == k] for k in (1, 0))
    assert len(out) > 500 and np.mean(np.array(good)[:, None] > np.array(bad)[None]) >= 0.98


def test_payload_digests_of_the_table(spark):
    for r in QUERIES["op6_media_columns"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), "doc_id").collect():
        data = (r.text or "").encode()
        assert r.payload_sha256 == hashlib.sha256(data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")).hexdigest()
