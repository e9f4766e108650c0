"""What tests of the corpus operators share."""

import itertools


def components_of(texts, threshold=75, words=5):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        x, y = sets[a], sets[b]
        if x and y and min(len(x), len(y)) * 100 >= threshold * max(len(x), len(y)):
            n = len(x & y)
            if n * 100 >= threshold * (len(x) + len(y) - n):
                i, j = find(a), find(b)
                root[max(i, j)] = min(i, j)
    return [find(i) for i in range(len(texts))], [len(s) for s in sets]
