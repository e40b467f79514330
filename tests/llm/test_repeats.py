"""Maximal repeats, the order of suffixes, and results whatever the groups' size."""

import numpy as np
import pytest
from test_llm import prose

from marginalia.llm import suffix_dedup


def test_suffix_order():
    draw = np.random.default_rng(1)
    lengths = [0, 3, 40, 1, 90]
    words = draw.integers(0, 3, sum(lengths)).astype(np.uint64)
    words[50:80] = words[5:35]
    end = np.repeat(np.cumsum(lengths), lengths)
    order, ranks = suffix_dedup.suffix_order(words, end, 50)
    suffixes = [tuple(words[i : min(e, i + 64)].tolist()) for i, e in enumerate(end.tolist())]
    assert [suffixes[i] for i in order] == sorted(suffixes)
    depth = suffix_dedup.common_prefixes(order, end, ranks)

    def shared(a, b):
        n = 0
        while a + n < end[a] and b + n < end[b] and words[a + n] == words[b + n]:
            n += 1
        return n

    assert all(min(d, 64) == min(shared(a, b), 64) for d, a, b in zip(depth.tolist(), order, order[1:], strict=False))


@pytest.mark.parametrize("size", [1 << 18, 1500, 0])
def test_maximal_repeats(spark, monkeypatch, size):
    monkeypatch.setattr(suffix_dedup, "GROUP_BYTES", size)
    one, two = prose(1, 70), prose(2, 55)
    some = [
        (1, f"{prose(10, 30)} {one} {prose(11, 20)}", "x"), (2, f"{prose(12, 5)} {two}", "x"), (3, f"{one} {prose(13, 8)} {two} {prose(14, 9)} {one}", "x"),
        (4, prose(15, 60), "x"), (None, " ".join(one.split()[5:65]), "x"), (5, prose(15, 60), "x"), (6, None, "x"), (7, "", "x"),
    ]
    some += [(20 + i, f"{prose(100 + i, 12)} {two} {prose(200 + i, 12)}", "x") for i in range(30)]
    got = suffix_dedup.maximal_repeats(spark.createDataFrame(some, "doc_id long, text string, n string")).collect()
    split = [(i if i is not None else -1, (t or "").split()) for i, t, _ in some]
    by = dict(split)
    first = {}
    for i, w in sorted(split):
        for j in range(len(w) - 49):
            first.setdefault(tuple(w[j : j + 50]), (i, j))
    want = set()
    for i, w in split:
        at = {j: first[tuple(w[j : j + 50])] for j in range(len(w) - 49)}
        for j, (doc, there) in at.items():
            before = at.get(j - 1)
            if doc < i and before != (doc, there - 1):
                n = 0
                while at.get(j + n) == (doc, there + n):
                    n += 1
                want.add((i, j, n + 49, doc, there))
    back = lambda x: -1 if x is None else x
    assert {(back(r.doc_id), r.start, r.n_words, back(r["first"]), r.there) for r in got} == want
    assert all(by[i][a : a + n] == by[d][b : b + n] for i, a, n, d, b in want) and (3, 78, 55, 2, 5) in want and (5, 0, 60, 4, 0) in want
