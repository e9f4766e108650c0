"""The local search of the packing: what it frees beyond best fit, and that no trade is left where it ends."""

import random
from itertools import combinations

import numpy as np
import pytest

from brinewood.llm import packing


def best_fit(sizes, capacity, monkeypatch):
    with monkeypatch.context() as m:
        m.setattr(packing, "improve", lambda bins, *_: bins)
        return packing.pack_block(sizes, capacity)


def sound(bins, sizes, capacity):
    return sorted(i for b in bins for i in b) == list(range(len(sizes))) and all(sum(sizes[i] for i in b) <= capacity for b in bins)


def trade_left(bins, sizes, capacity):
    """A move, or a trade of one for one, two for one or one for two between two bins, that raises the sum of squared fills."""
    fills = [sum(sizes[i] for i in b) for b in bins]
    offers = [{0} | {sizes[i] for i in b} for b in bins]
    pairs = [{sizes[i] + sizes[j] for i, j in combinations(b, 2)} for b in bins]
    for a, b in combinations(range(len(bins)), 2):
        for some, others in ((offers[a], offers[b]), (pairs[a], offers[b] - {0}), (offers[a] - {0}, pairs[b])):
            for x in some:
                for y in others:
                    p, q = fills[a] - x + y, fills[b] - y + x
                    if max(p, q) <= capacity and p * p + q * q > fills[a] ** 2 + fills[b] ** 2:
                        return a, b, x, y
    return None


def perfect(rng, bins, parts, capacity, least):
    """Sizes of bins that are full, each cut into so many parts of a least size: the least number of bins is known."""
    out = []
    while len(out) < bins * parts:
        cuts = sorted(rng.sample(range(1, capacity), parts - 1))
        own = [b - a for a, b in zip([0, *cuts], [*cuts, capacity], strict=True)]
        out += own if min(own) >= least else []
    rng.shuffle(out)
    return out


@pytest.mark.parametrize(("parts", "least"), [(3, 200), (3, 250), (4, 100), (4, 200), (5, 150)])
def test_search_frees_most_of_what_best_fit_wastes(monkeypatch, parts, least):
    for seed in range(3):
        sizes = perfect(random.Random(seed), 200, parts, 1024, least)
        before, after = best_fit(sizes, 1024, monkeypatch), packing.pack_block(sizes)
        assert sound(before, sizes, 1024) and sound(after, sizes, 1024)
        assert len(after) - 200 <= (len(before) - 200) / 3


@pytest.mark.parametrize("seed", range(6))
def test_no_trade_is_left(seed):
    rng = random.Random(seed)
    capacity = rng.choice([30, 100, 1024])
    sizes = [rng.randint(1, capacity - 1) for _ in range(120)]
    bins = packing.improve([[i] for i in range(len(sizes))], sizes, capacity)
    assert sound(bins, sizes, capacity) and trade_left(bins, sizes, capacity) is None


def test_full_bins_open(monkeypatch):
    """Two pieces of a full bin for one of an underfull bin, so that one of the two can fill a gap elsewhere."""
    sizes = [60, 25, 15, 40, 45, 85]
    bins = packing.improve([[0, 1, 2], [3, 4], [5]], sizes, 100)
    assert sound(bins, sizes, 100) and sorted(sum(sizes[i] for i in b) for b in bins) == [70, 100, 100]


def test_real_lengths(spark, monkeypatch):
    """Piece lengths of the given table: never more bins than best fit, and no trade left."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    sizes = [r.length for r in packing.pack(docs).where("length < 1024").collect()]
    before, after = best_fit(sizes, 1024, monkeypatch), packing.pack_block(sizes)
    assert sound(after, sizes, 1024) and packing.least_bins(sizes, 1024) <= len(after) <= len(before)
    assert len(after) == packing.least_bins(sizes, 1024) or trade_left(after, sizes, 1024) is None


def test_words_are_encoded_once_whatever_signs_follow():
    own = packing.Encoder(packing.tokenizer_path())
    words = ["ab" + chr(97 + i % 26) + chr(97 + i // 26) for i in range(200)]
    own.encode([" ".join(w + sign for w in words) for sign in (".", ",", "!!", ".\nSo", "")])
    assert len(own.ids) <= len(words) + 20


def test_runs_are_the_tokenizers():
    """Texts of known letters, signs, digits, line ends and apostrophes, and such that hold others: the same ids as of the whole text."""
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    own, whole = packing.Encoder(path), Tokenizer.from_file(path)
    rng = random.Random(5)
    some = ["ab", "Zé", "ñ", "ж", "ß", " ", " ", " ", "  ", "\n", ".", "!!", "(", "42", "7", "'", "'s", "'ll", "_", "|", "<", "\t", "\u00a0", "\u0301", "\u4e2d", "²", "ª", "\x01", "\x02", "\0"]
    for kinds in (some[:8] + some[9:15], some[:21], some):
        texts = ["".join(rng.choice(kinds) for _ in range(rng.randint(0, 25))) for _ in range(3000)]
        texts += [" .", ". ", "a .\n(b) c", "\n", " a", "a ", "1.5", "x1 2y", "-- a--b --", "<|endoftext|>", "a<|endoftext|>.b"]
        for lo in range(0, len(texts), 500):
            part = texts[lo : lo + 500]
            assert own.encode(part) == [np.array(e.ids, "<u4").tobytes() for e in whole.encode_batch(part, add_special_tokens=False)]
