"""The filter audit against one document after another, order after order."""

import itertools
import re
from collections import Counter

from brinewood.llm import filters

LETTERS = "ABCDE"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def plain(docs, labels):
    good, toxic = ({i for i, *x in labels if i is not None and x[k] == 1} for k in (0, 1))
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    out = {}
    for i, t, part in docs:
        t, part = t or "", part or ""
        w = WORDS.findall(t)
        fails = {
            "A": len(w) < 200,
            "B": 100 * len(set(w)) < 50 * len(w),
            "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            "D": bool(set(t) & set("#$%&*|")),
            "E": i is not None and i > least[t],
        }
        for order in map("".join, itertools.permutations(LETTERS)):
            gone = False
            for step, f in enumerate(order, 1):
                c = out.setdefault((part, order, step), Counter())
                c["unique"] += fails[f] and sum(fails.values()) == 1
                if fails[f] and gone:
                    c["redundant"] += 1
                elif fails[f]:
                    c["removed"] += 1
                    c["good"] += i in good
                    c["toxic"] += i in toxic
                    gone = True
                elif not gone:
                    c["kept"] += 1
    total = Counter()
    for (part, order, step), c in out.items():
        total[part, order[step - 1]] += c["removed"]
    return sorted((*k, c["kept"], c["removed"], c["redundant"], c["unique"], c["good"], c["toxic"], total[k[0], k[1][k[2] - 1]]) for k, c in out.items())


def found(docs, labels):
    return sorted(map(tuple, filters.audit(filters.cells(docs, labels, LETTERS), LETTERS).collect()))


def test_hard_cases(spark):
    long = " ".join(f"w{i}" for i in range(250))
    docs = [
        (1, long, "a"), (2, long, "b"), (3, long, "a"), (3, long, "a"), (None, long, "a"), (None, long, None), (0, long + " #", "a"),
        (4, "same " * 300, "a"), (5, None, "a"), (6, "", None), (7, "A b", ""), (7, "B c", "a"), (8, "word\x00　x " * 9000, "c"), (9, "SHOUT| " * 250, "c"),
    ]
    labels = [(1, 1, 0), (3, 0, 1), (3, 1, 0), (7, 1, 1), (None, 1, 1), (99, 1, 1), (5, None, 1)]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, source string, mask string, n int")
    ls = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert found(df, ls) == plain(docs, labels)
    assert found(df.where("doc_id < 0"), ls) == []


def test_one_text_in_most_rows(spark):
    docs = [(i, "copy" if i % 3 else f"own text {i}", f"s{i % 2}") for i in range(600)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(7)
    ls = spark.createDataFrame([(i, i % 2, i % 5 == 0 and 1 or 0) for i in range(0, 600, 4)], "doc_id long, quality int, toxic int")
    assert found(df, ls) == plain(docs, [tuple(r) for r in ls.collect()])
