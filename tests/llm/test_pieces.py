"""SentencePiece ids by distinct chunks against the library on whole texts."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from brinewood.llm import pieces

SF = "/root/testdata/sf0.001"


def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())


@settings(max_examples=200, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" ▁\n\tab."), st.characters(codec="utf-8")), max_size=60))
def test_chunks_segment_like_whole_texts(text):
    model = pieces.processor(pieces.model_path())
    assert [i for ids in pieces.segment(model, pieces.chunks_of(text)) for i in ids] == model.encode(text)


@given(st.lists(st.text(min_size=1).map(lambda x: pieces.MARK + x.replace(pieces.MARK, "").replace(" ", "")) | st.sampled_from(["▁", "▁▁▁", "▁▁a"])))
def test_chunks_and_ids_come_back_from_their_packing(chunks):
    assert pieces.unpack(pieces.pack(chunks)) == chunks
    ids = [list(range(len(c))) for c in chunks]
    sizes, values = pieces.unpack_ids(pieces.pack_ids(ids))
    assert sizes.tolist() == [len(x) for x in ids] and values.tolist() == [i for x in ids for i in x]


def test_query_gives_what_the_library_gives(spark):
    model = library()
    want = []
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        ids = model.encode(r["text"] or "", add_eos=True)
        want.append((r["doc_id"], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(model.decode(ids).encode()).hexdigest()))
    assert sorted(map(tuple, pieces.op11_sentencepiece(spark, SF).collect())) == sorted(want)


def test_hard_cases_in_small_blocks(spark):
    texts = [None, "", " ", "a  b ", "▁", "\0é①", "same text twice", "same text twice", "the " * 50, "x" * 5000, "tab\tand\nline"]
    rows = [(i if i else None, t, f"row {i}", i) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id long, text string, ids string, `block` int").repartition(3)
    model = library()
    got = {r["row"]["block"]: (r["row"]["ids"], r["ids"], r["decoded"]) for r in pieces.encode_decode(df, block_chars=40, bucket_bytes=100).collect()}
    for i, t in enumerate(texts):
        ids = model.encode(t or "", add_eos=True)
        assert got[i] == (f"row {i}", ids, model.decode(ids))
    assert len(got) == len(texts)


def test_a_word_that_every_document_holds_and_empty_tables(spark):
    df = spark.range(400).selectExpr("id", "if(id % 2 = 0, 'common', concat('common w', id)) as text").repartition(8)
    model = library()
    for r in pieces.encode_decode(df, end=False).collect():
        i = r["row"]["id"]
        assert r["ids"] == model.encode("common" if i % 2 == 0 else f"common w{i}")
    assert pieces.encode_decode(df.where("id < 0")).count() == 0


def test_models_whose_pieces_reach_over_markers_are_refused(monkeypatch, tmp_path):
    class Model:
        def __init__(self, model_file):
            pass

        vocab_size = staticmethod(lambda: 1)
        id_to_piece = staticmethod(lambda i: "a▁b")

    import sentencepiece

    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", Model)
    with pytest.raises(ValueError, match="reaches over"):
        pieces.processor(str(tmp_path / "other.model"))
