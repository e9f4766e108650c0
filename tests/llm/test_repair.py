"""Conversation repair against all edit strings, one row after another, and blocks against whole conversations."""

import hashlib
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from brinewood.llm import repair

SF = "/root/testdata/sf0.001"
ACCEPTED = re.compile(r"(s?(ua)+)?")


def every_way(symbols):
    """(cost, audit, roles) of all edits with at most three insertions a gap."""
    ways = {(0, "", "")}
    for i in range(len(symbols) + 1):
        for _ in range(3):
            ways |= {(c + 3, a + "I", r + x) for c, a, r in ways for x in "ua" if len(r) <= len(symbols) + 2}
        if i < len(symbols):
            s = symbols[i]
            more = 3 if s.isupper() else 0
            new = {(c + 4, a + "D", r) for c, a, r in ways}
            if s != "x":
                new |= {(c + more, a + "K", r + s.lower()) for c, a, r in ways}
                new |= {(c + 3 + more, a + "R", r + x) for c, a, r in ways for x in "ua"}
            ways = new
    return min(w for w in ways if ACCEPTED.fullmatch(w[2]))


@pytest.mark.parametrize("seed", range(40))
def test_least_edits_of_short_conversations(seed):
    symbols = "".join(random.Random(seed).choices("suaoSUAx", k=seed % 4 + (seed > 20)))
    cost, audit, roles = every_way(symbols)
    assert repair.least(symbols) == (cost, audit)
    kept, _ = repair.replay(audit, symbols, 0, list(symbols.lower()), [""] * len(symbols))
    assert "".join(r[0] for r in kept) == roles


def forward(symbols):
    """Least (cost, audit) with whole strings, row by row."""
    def settle(ways, cost, audit, q):
        if q not in ways or (cost, audit) < ways[q]:
            ways[q] = (cost, audit)

    def insert(ways):
        for _ in range(3):
            for q, (c, a) in list(ways.items()):
                for to in repair.GRAMMAR[q].items():
                    if to[0] != "s":
                        settle(ways, c + 3, a + "I", to[1])
        return ways

    ways = insert({0: (0, "")})
    for s in symbols:
        new = {}
        for q, (c, a) in ways.items():
            for label, out, cost in repair.edits(s):
                if not out:
                    settle(new, c + cost, a + label, q)
                elif out in repair.GRAMMAR[q]:
                    settle(new, c + cost, a + label, repair.GRAMMAR[q][out])
        ways = insert(new)
    return min(w for q, w in ways.items() if repair.ACCEPTS[q])


@settings(max_examples=300, deadline=None)
@given(st.text("suaoSUAOx", max_size=60), st.integers(1, 9))
def test_blocks_chain_to_the_whole(symbols, size):
    want = forward(symbols)
    assert repair.least(symbols) == want
    parts = [symbols[i : i + size] for i in range(0, len(symbols), size)]
    cost, picks = repair.chained([repair.matrix(p) for p in parts])
    assert (cost, "".join(x for _, x in picks)) == want


def test_closed_gaps_need_two_insertions():
    assert repair.Composition("").best([0, 1, 2, 3]) == [(0, ""), (6, "II"), (3, "I"), (0, "")]


def plain(rows):
    """The contract, conversation by conversation."""
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    out, by = [], {}
    for conv, turn, role, text in rows:
        own = by.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    for conv, own in by.items():
        if not own:
            out.append((conv, 0, 0, 0, 0, 0, 0, "", sha("")))
            continue
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        symbols, seen, blank, dup, cut = "", set(), 0, 0, 0
        for _, role, text in own:
            end = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
            if not end:
                blank, symbols = blank + 1, symbols + "x"
            elif (role, text) in seen:
                dup, symbols = dup + 1, symbols + "x"
            else:
                seen.add((role, text))
                s = role[:1] if role[:1] and role[:1] in "sua" else "o"
                if end[0] not in ".!?":
                    cut, s = cut + 1, s.upper()
                symbols += s
        turns = [t for t, _, _ in own if t is not None]
        initials = [r[:1] for _, r, _ in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        cost, audit = forward(symbols)
        roles, texts = repair.replay(audit, symbols, 0, [r for _, r, _ in own], [t for _, _, t in own])
        assert ACCEPTED.fullmatch("".join(r[0] for r in roles))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((conv, gaps, blank, dup, cut, illegal, cost, audit, sha("\n".join(f"{r}:{t}" for r, t in zip(roles, texts, strict=True)))))
    return sorted(out, key=str)


def run(spark, rows, tmp_path, block=None, monkeypatch=None):
    path = str(tmp_path / f"t{len(rows)}-{block}")
    spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, found string").repartition(5).write.parquet(f"{path}/conversations.parquet")
    if block:
        monkeypatch.setattr(repair.repair, "__kwdefaults__", {"block": block, "block_chars": 10_000})
    return sorted(map(tuple, repair.op13_conversation_repair(spark, path).collect()), key=str)


def test_query_on_the_driver_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, repair.op13_conversation_repair(spark, SF).collect()), key=str) == plain(rows)


def test_one_conversation_in_most_rows_and_hard_cases(spark, tmp_path, monkeypatch):
    r = random.Random(5)
    words = ["Yes.", "No!", "Why", "", " \n", None, "Long " * 3000 + ".", "x:y\nuser:z?", "ü。"]
    rows = [(1 if i % 3 else r.choice([2, 3, 4, None, 50 + i]), r.choice([i // 2, i, None]), r.choice(["user", "assistant", "system", "tool", "", None, "ubuntu"]), r.choice([*words, f"text {i}.", f"text {i}"])) for i in range(400)]
    rows += rows[:30]
    want = plain(rows)
    assert run(spark, rows, tmp_path) == want
    assert run(spark, rows, tmp_path, 7, monkeypatch) == want


def test_empty_table(spark, tmp_path):
    assert run(spark, [], tmp_path) == []
