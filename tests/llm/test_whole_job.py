"""Corpus operators that have to do the whole job: full blocks, rows that share an id."""

import random
from itertools import combinations

import corpus_pipeline
from brinewood.llm import packing


def test_packing_trades_until_none_is_left_in_a_full_block():
    rng = random.Random(6)
    for draw, most in ((lambda: rng.choice([300, 400, 500, 520]), 1.05), (lambda: rng.randint(180, 300), 1.01)):
        sizes = [draw() for _ in range(packing.BLOCK)]
        bins = packing.pack_block(sizes)
        assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
        fill = [sum(sizes[i] for i in b) for b in bins]
        least = packing.least_bins(sizes, packing.LENGTH)
        assert max(fill) <= packing.LENGTH and least <= len(bins) <= least * most
        if len(bins) == least:
            continue
        under = [(fill[b], sorted(sizes[i] for i in bins[b])) for b in range(len(bins)) if fill[b] < packing.LENGTH]
        shapes = {(f, tuple(x)) for f, x in under}
        for f, own in shapes:
            for g, other in shapes:
                if g < f:
                    room = packing.LENGTH - f
                    one = [x - y for x in other for y in (0, *own)]
                    two = [sum(x) - y for x in combinations(other, 2) for y in own]
                    assert not any(0 < gain <= room for gain in one + two)


def test_near_duplicates_judges_rows_not_ids(spark):
    one, two, three = (" ".join(f"{w}{i}" for i in range(40)) for w in ("amber", "basil", "cedar"))
    # 2 has a copy of 1 and a text of its own, 3 two texts of its own, 4 one row twice
    given = [(1, one), (2, one), (2, two), (3, three), (3, three.upper() + " " + two.upper().replace("BASIL", "DUNE")), (4, "zinc yarrow"), (4, "zinc yarrow"), (5, ""), (5, None)]
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in given], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    assert sorted(kept, key=str) == sorted({x for x in given if x != (2, one)}, key=str)
