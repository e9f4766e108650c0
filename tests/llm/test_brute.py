"""Corpus operators against brute force, exact round trips and held-out accuracy on small inputs."""

import itertools
import random
import zlib

import numpy as np
import pytest

from tests_llm_shared import components_of

from brinewood.llm import ann, chat, media, mixing, ngram_join, packing, quality, secrets, sharding


def near_copies(seed, families, size, edits):
    """Families of texts that drift from a common base by so many random edits each."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    out = []
    for _ in range(families):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(30, 90))]
        for _ in range(size):
            t = list(base)
            for _ in range(rng.randint(0, edits)):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            out.append(" ".join(t[: rng.randint(len(t) - 4, len(t))]))
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    out += [f"{passage} {' '.join(rng.choice(vocabulary) for _ in range(rng.randint(2, 60)))}" for _ in range(60)]
    out += ["a b", "A  b", "a b c d e", "", None, "x"]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize(("families", "size", "edits", "paired"), [(12, 8, 3, 32), (2, 90, 4, 8), (1, 150, 6, 4)])
def test_ngram_join_finds_all_components(spark, monkeypatch, families, size, edits, paired):
    monkeypatch.setattr(ngram_join, "PAIRED", paired)
    texts = near_copies(families * size, families, size, edits)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    rows = {r.doc_id: r for r in ngram_join.join(docs).collect()}
    expected, sizes = components_of(texts)
    assert [rows[i].component_id for i in range(len(texts))] == expected
    assert [rows[i].n_shingles for i in range(len(texts))] == sizes


@pytest.mark.parametrize("ordered", [1, 50])
def test_order_of_tokens_changes_no_result(spark, ordered):
    texts = near_copies(5, 4, 20, 3)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r.component_id for r in ngram_join.join(docs, ordered=ordered).collect()}
    assert [rows[i] for i in range(len(texts))] == components_of(texts)[0]


def test_components_of_paths_and_stars(spark):
    rng = random.Random(1)
    names = [bytes([rng.randrange(256) for _ in range(16)]) for _ in range(300)]
    links = [(names[i], names[i + 1]) for i in range(0, 199)] + [(names[200], names[i]) for i in range(201, 300)]
    found = {bytes(r.member): bytes(r.root) for r in ngram_join.components(spark.createDataFrame(links, "a binary, b binary")).collect()}
    assert len({found[n] for n in names[:200]}) == 1 and len({found[n] for n in names[200:]}) == 1 and len(set(found.values())) == 2


def test_knapsack_is_exact_where_exact_is_possible():
    rng = random.Random(3)
    for _ in range(200):
        lengths = np.array(sorted(rng.sample(range(1, 60), rng.randint(1, 12))))
        counts = np.array([rng.randint(1, 5) for _ in lengths])
        total = int((lengths * counts).sum())
        budget = rng.randint(0, total)
        take = mixing.fit(lengths, counts, budget, seed=rng.randint(0, 9))
        assert ((take >= 0) & (take <= counts)).all()
        base = np.array([int(c) * budget // total for c in counts])
        sums = {0}
        for length, spare in zip(lengths, counts - base, strict=True):
            sums = {s + length * k for s in sums for k in range(spare + 1)}
        rest = budget - int((base * lengths).sum())
        assert abs(int((take * lengths).sum()) - budget) == min(abs(s - rest) for s in sums)


def water_filled(sizes, weights, most):
    """Shares by weight in code point order (null last), the excess reshared until none is above most times its size."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full = set()
    while True:
        left = sum(sizes.values()) - sum(most * sizes[s] for s in full)
        share = left / sum(weight[s] for s in order if s not in full) if len(full) < len(order) else 0
        more = {s for s in order if s not in full and share * weight[s] >= most * sizes[s]}
        if not more:
            return {s: most * sizes[s] if s in full else share * weight[s] for s in order}
        full |= more


@pytest.mark.parametrize("seed", range(4))
def test_targets_share_and_stop(spark, monkeypatch, seed):
    monkeypatch.setattr(mixing, "RANK_ROWS", 3)  # several ranges
    rng = random.Random(seed)
    names = ["a", "B", "é", "\U0001f600", "\uffff", "", "z"][: rng.randint(1, 7)] + [None]
    sizes = {n: rng.choice([0, 1, 10, 100, 1000]) for n in names}
    out = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, words long")).collect()}
    assert out == pytest.approx(water_filled(sizes, (5, 2, 1), 3))
    assert sum(out.values()) == pytest.approx(sum(sizes.values()))


def test_mix_takes_near_the_targets(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.randint(0, 40)), rng.choice(["s1", "s1", "s1", "s2", "s3", None])) for i in range(3000)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    by = {}
    for r in out:
        by.setdefault(r.source_size, [r.target, 0])[1] += r["size"] * r.copies
    assert len(out) == 3000 and all(abs(t - k) <= 1 for t, k in by.values())


def test_jump_hash_moves_only_to_the_new_shard():
    keys = np.random.default_rng(0).integers(0, 1 << 63, 20_000, dtype=np.uint64)
    last = sharding.jump_hash(keys, 1)
    assert (last == 0).all()
    for n in range(2, 40):
        now = sharding.jump_hash(keys, n)
        moved = now != last
        assert (now[moved] == n - 1).all() and abs(moved.mean() - 1 / n) < 0.02
        last = now


def test_packing_is_close_to_the_bound_and_loses_nothing():
    rng = random.Random(6)
    for draw in (lambda: rng.randint(1, 1024), lambda: rng.choice([300, 400, 500, 520]), lambda: rng.randint(500, 1024), lambda: 1):
        sizes = [draw() for _ in range(800)]
        bins = packing.pack_block(sizes)
        assert sorted(i for b in bins for i in b) == list(range(800))
        assert all(sum(sizes[i] for i in b) <= 1024 for b in bins)
        assert packing.least_bins(sizes, 1024) <= len(bins) <= packing.least_bins(sizes, 1024) * 1.12 + 1


def test_swaps_empty_bins():
    sizes = [6, 5, 5, 4, 7, 3]
    bins = packing.improve([[0], [1, 3], [2], [4], [5]], sizes, 10, 3)
    assert len(bins) == 3 and sorted(i for b in bins for i in b) == list(range(6))


def test_encoder_agrees_with_the_tokenizer():
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    own, whole = packing.Encoder(path), Tokenizer.from_file(path)
    rng = random.Random(8)
    alphabet = "ab é\n\t    Z9,.!'s\U0001f600\0-"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    texts += ["<|endoftext|> x <|endoftext|>y", " ", "", "  a", "a  ", "don't  we'll"]
    assert own.encode(texts) == [np.array(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def made_up(rng, endings, n):
    return " ".join(rng.choice("bdfgklmn") + rng.choice("aeiou") + rng.choice(endings) for _ in range(n))


def test_quality_held_out(spark):
    rng = random.Random(12)

    def text(label):
        words = made_up(rng, ["tion", "ing"], rng.randint(20, 60)).split()
        if label:
            return " ".join(words)
        return " ".join(w + rng.choice(["***", "###"]) for w in words) if rng.random() < 0.5 else " ".join([words[0]] * 50)

    rows = [(i, text(i % 4 > 0), int(i % 4 > 0)) for i in range(600)]
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows[:400]], "doc_id long, quality int")
    out = {r.doc_id: r.score for r in quality.predict(docs, quality.train(docs, labels), 1).collect()}
    assert np.mean([(out[i] >= 0.7) == bool(y) for i, _, y in rows[400:]]) >= 0.97


def test_chunks_are_cut_by_content_and_join_to_the_whole():
    rng = np.random.default_rng(13)
    files = [rng.integers(0, 256, n, dtype=np.uint8).tobytes() for n in (0, 1, 511, 512, 513, 9000, 100_000)] + [b"\0" * 50_000]
    parts = media.chunks(files)
    for f, p in zip(files, parts, strict=True):
        assert b"".join(p) == f and all(len(c) <= media.MOST for c in p) and all(len(c) >= media.LEAST for c in p[:-1])
    moved = media.chunks([b"some bytes before" + files[6]])[0]
    assert len(set(moved) & set(parts[6])) > 0.8 * len(parts[6])


def test_shared_chunks_are_stored_once_and_read_back(spark):
    rng = random.Random(14)
    passage = " ".join(str(rng.random()) for _ in range(600))
    rows = [(i, f"{i} {passage} {rng.random()}" if i % 2 else passage) for i in range(40)]
    documents, stored = media.store(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert stored.count() == stored.select("digest").distinct().count()
    assert sum(len(r.chunk) for r in stored.collect()) < 3 * len(passage)
    out = {r.id: b"".join(r.chunks) for r in media.read_back(documents, stored).collect()}
    for i, t in rows:
        assert media.samples_of(out[i]).rstrip(b"\0") == t.encode()


def test_search_recall():
    rng = np.random.default_rng(15)
    x = rng.normal(size=(3000, 24)) * rng.uniform(0.5, 2, (3000, 1))
    levels = ann.build(x)
    q = rng.normal(size=(100, 24))
    exact = np.argsort(-(q @ x.T), 1)[:, :20]
    found = ann.find(x, levels, q, 20)
    assert np.mean([len(set(a) & set(b)) / 20 for a, b in zip(exact, found, strict=True)]) >= 0.9


def test_shards_are_merged(spark):
    rng = np.random.default_rng(16)
    x = rng.normal(size=(900, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    rows = ann.search(df, df.where("vec_id % 20 = 0"), 20, shard_size=200, block=10).collect()
    hits = 0
    for i in range(0, 900, 20):
        s = x @ x[i]
        s[i] = -np.inf
        mine = [r.vec_id for r in sorted((r for r in rows if r.query_id == i), key=lambda r: r.rank)]
        assert len(mine) == 20
        hits += len(set(mine) & set(np.argsort(-s)[:20].tolist()))
    assert hits / (45 * 20) >= 0.9


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(17)
    k = len(chat.ROLES)
    model = chat.Hmm.from_counts(rng.random(k) * 5, rng.random((k, k)) * 5, rng.random((k, chat.CODES)) * 3)
    for n in (1, 2, 5):
        emit = rng.normal(size=(n, k))
        moves = model.moves[rng.integers(0, 3, n)]
        best = max(itertools.product(range(k), repeat=n), key=lambda p: model.start[p[0]] + sum(emit[t, p[t]] for t in range(n)) + sum(moves[t][p[t - 1], p[t]] for t in range(1, n)))
        assert tuple(model.viterbi(emit, moves, None, None)) == best


def test_blocks_of_a_long_conversation_decode_like_the_whole(spark, monkeypatch):
    rng = random.Random(18)
    turns = [(1, i, "user" if i % 2 == 0 else "assistant", "why is it?" if i % 2 == 0 else "because " * rng.randint(3, 40)) for i in range(60)]
    df = spark.createDataFrame([(*t, n) for n, t in enumerate(turns)], "conv long, turn long, role string, text string, rid long")
    model = chat.learn(df)
    whole = [r.role_pred for r in chat.recover(df.drop("role"), model).orderBy("turn").collect()]
    monkeypatch.setattr(chat, "BLOCK", 7)
    assert [r.role_pred for r in chat.recover(df.drop("role"), model).orderBy("turn").collect()] == whole
    assert np.mean([a == t[2] for a, t in zip(whole, turns, strict=True)]) > 0.95


def test_one_hot_conversation_decodes_like_the_whole(spark, monkeypatch):
    """Turns without number, in rows' order, cut into many blocks, against one Viterbi run over all their lines."""
    rng = random.Random(21)
    rows = [(None, None, rng.choice(["why?", "no\nyes, it is so", "", "User: hm"]), i) for i in range(80)] + [("c", 0, "why?", 900)]
    df = spark.createDataFrame(rows, "conv string, turn long, text string, rid long")
    train = spark.createDataFrame([(str(i), t, "user" if t % 2 == 0 else "assistant", "why?" if t % 2 == 0 else "so\nit is") for i in range(9) for t in range(4)], "conv string, turn long, role string, text string")
    model = chat.learn(train)
    lines = df.where("conv is null").select("rid", "text", chat.turn_lines(df["text"]).alias("x")).orderBy("rid").collect()
    codes, kinds, first = [], [], []
    for r in lines:
        for i, x in enumerate(r.x):
            first += [len(codes)] if i == 0 else []
            codes.append(x.code)
            kinds.append(x.kind)
    whole = model.viterbi(model.emit[:, codes].T, model.moves[kinds], None, None)
    monkeypatch.setattr(chat, "BLOCK", 5)
    found = [r.role_pred for r in chat.recover(df, model).where("conv is null").orderBy("rid").collect()]
    assert found == [chat.ROLES[whole[i]] for i in first]


def test_marked_transcripts_are_parsed(spark):
    df = spark.createDataFrame([(1, i, "user" if i % 2 == 0 else "assistant", "why?" if i % 2 == 0 else "since it is so", i) for i in range(20)], "conv long, turn long, role string, text string, rid long")
    model = chat.learn(df)
    text = "User: why is it\nso late?\n### Assistant: it is\nmidnight\n[HUMAN]: thanks"
    out = chat.parse_transcripts(spark.createDataFrame([(5, text)], "id long, text string"), model, id_col="id", text_col="text").orderBy("turn").collect()
    assert [(r.role, r.text) for r in out] == [("user", "why is it\nso late?"), ("assistant", "it is\nmidnight"), ("user", "thanks")]
    assert out[0].rendered == "<|user|>\nwhy is it\nso late?\n<|end|>"


def test_ownership_tells_examples_from_live_keys(spark):
    key, live = 'token = "abcDEF123456abcDEF123456"', "Zz9" * 8
    rows = [(i, f"see {key} here", f"s{i}") for i in range(5)] + [(9, f"mine {live} only", "s9"), (10, f"token = {live}", "s9")]
    out = {r.row.doc_id: r.spans for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert [s.live for s in out[0]] == [False]  # five owners hold it, so the mixed run inside adds nothing
    assert [(s.kind, s.live) for s in out[9]] == [(3, True)]
    assert [(s.kind, s.live) for s in out[10]] == [(0, True)]
    assert (out[0][0].owners, out[0][0].repos, out[10][0].owners, out[10][0].repos) == (5, 5, 1, 2)
    # two owners, but in very many repositories
    rows = [(i, "token = abcdef123", f"s{i % 2}") for i in range(120)]
    assert not any(s.live for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect() for s in r.spans)


def test_sequences_hold_the_documents(spark):
    docs = spark.createDataFrame([(i, f"text number {i} " * (i * 40)) for i in range(1, 12)], "doc_id long, text string")
    packed = packing.pack(docs).cache()
    made = {r.sequence_id: r.ids for r in packing.sequences(packed, docs).collect()}
    for r in packed.collect():
        part = made[r.sequence_id][r.offset : r.offset + r.length]
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32
    assert all(len(x) <= 1024 for x in made.values())
