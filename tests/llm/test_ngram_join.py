"""The grouped prefix join where groups have many members, and its hashing of words."""

import random

import pytest

from brinewood.llm import ngram_join
from tests_llm_shared import components_of


def families_with_common_ends(seed):
    """Texts of a family share their rare words and end in one of a few passages that all families use: many distinct sets
    of one size with one prefix, some near enough to be linked and some not."""
    rng = random.Random(seed)
    passages = {n: [[f"p{n}.{i}.{j}" for j in range(n)] for i in range(9)] for n in (6, 14, 40)}
    out = []
    for f in range(5):
        own = [f"f{f}.{j}" for j in range(60)]
        for n, some in passages.items():
            out += [" ".join(own + p) for p in some]
    for n, some in passages.items():
        out += [" ".join(p) for p in some] * 2
    rng.shuffle(out)
    return out


@pytest.mark.parametrize(("paired", "cell", "sent"), [(32, 256, 1 << 16), (2, 3, 0)])
def test_groups_of_many_members(spark, monkeypatch, paired, cell, sent):
    for name, value in (("PAIRED", paired), ("CELL", cell), ("SENT", sent)):
        monkeypatch.setattr(ngram_join, name, value)
    texts = families_with_common_ends(1)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = {r.doc_id: r for r in ngram_join.join(docs).collect()}
    expected, sizes = components_of(texts)
    assert [rows[i].component_id for i in range(len(texts))] == expected
    assert [rows[i].n_shingles for i in range(len(texts))] == sizes


def test_shingles_are_those_of_the_words():
    rng = random.Random(2)
    texts = ["".join(rng.choice("aAbé \t\n\x0b\x1c ") for _ in range(rng.randint(0, 40))) for _ in range(300)]
    texts += [None, "", " ", "a", "a b c d e", "a b c d e f", "x" * 3000, "ab " * 2000]
    for words in (1, 2, 5):
        found = ngram_join.shingle_sets(texts, words)
        known = {}
        for t, s in zip(texts, found, strict=True):
            w = (t or "").encode().lower().split()
            mine = {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()
            assert len(s) == len(mine) and (s[1:] > s[:-1]).all()
            known.setdefault(frozenset(mine), s.tobytes())
            assert known[frozenset(mine)] == s.tobytes()
        assert len(set(known.values())) == len(known)


def test_long_texts_hash_like_short_ones(monkeypatch):
    texts = ["one two three four five six seven", "zwei", "a b c " * 50]
    whole = [s.tolist() for s in ngram_join.shingle_sets(texts, 5)]
    monkeypatch.setattr(ngram_join, "HASHED", 1)
    assert [s.tolist() for s in ngram_join.shingle_sets(texts, 5)] == whole
