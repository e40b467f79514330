"""Hard negatives against a plain search of all pairs."""

import math
from collections import Counter

import numpy as np
import pytest

from marginalia.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, row string, block int"


def expected(given, every=50, k=5, n=3):
    part = []
    for i, v, label, *_ in given:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if i is not None and i % 7 == 0 else label
        part.append((i, label, [math.floor(256 * float(np.float32(x))) for x in v]))
    out = Counter()
    big = 2**63
    for a, (i, label, v) in enumerate(part):
        if i is None or i % every:
            continue
        scores = [(-sum(x * y for x, y in zip(v, w)), big if j is None else j, lab) for b, (j, lab, w) in enumerate(part) if b != a]
        for s, j, _ in sorted(x for x in scores if x[2] == label)[:k]:
            fits = sorted(x for x in scores if x[2] != label and 50 * -s <= 100 * -x[0] <= 95 * -s)[:n]
            for rank, (t, m, _) in enumerate(fits, 1):
                out[i, None if j == big else j, rank, None if m == big else m, -s, -t] += 1
    return out


def rows(n=600, width=6):
    draw = np.random.default_rng(11)
    centres = draw.normal(size=(12, width))
    out = []
    for i in range(n):
        c = i % 12
        v = centres[c] + draw.normal(size=width) * (0.02 if c < 6 else 0.6)
        out.append((i, v.tolist(), int(draw.integers(0, 10)) if i % 5 else c % 10))
    hot = centres[0].tolist()
    out += [(10_000 + 10 * i, hot, 3) for i in range(150)]  # one vector in many rows
    out += [(700, hot, 1), (700, hot, 1), (None, hot, 1), (None, centres[1].tolist(), 2), (None, hot, 4), (750, [0.0] * width, 2), (751, [0.0] * width, 2), (752, [0.0] * width, 5)]
    out += [(800, None, 1), (850, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (900, [float("nan")] * width, 2), (950, [float("inf")] + [0.0] * 5, 3), (1000, hot, None), (1050, [-x for x in hot], 7), (1100, [], 1), (1101, [], 1), (1150, hot[:3], 6)]
    return [(*r, "clash", 1) for r in out]


@pytest.mark.parametrize("size", [4096, 8])
def test_mine(spark, size):
    given = rows()
    got = negatives.mine(spark.createDataFrame(given, SCHEMA).repartition(3), block_anchors=size, block_rows=30 * size)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert Counter(map(tuple, got.collect())) == expected(given)


def test_large_components(spark):
    draw = np.random.default_rng(3)
    given = [(i, (draw.integers(-9, 9, 4) * 40_000.0).tolist(), int(i % 3), "", 0) for i in range(120)]
    assert Counter(map(tuple, negatives.mine(spark.createDataFrame(given, SCHEMA)).collect())) == expected(given)
    huge = [(i, [float(np.float32(x)) for x in draw.normal(size=2) * 1e5], int(i % 3), "", 0) for i in range(150)]
    assert Counter(map(tuple, negatives.mine(spark.createDataFrame(huge, SCHEMA)).collect())) == expected(huge)


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert negatives.mine(none).count() == 0
    assert negatives.mine(spark.createDataFrame([(50, [1.0], 1, "", 0)], SCHEMA)).count() == 0


def test_tree_and_bounds():
    draw = np.random.default_rng(4)
    points = np.floor(256 * (draw.normal(size=(8, 5))[draw.integers(0, 8, 60)] + 0.02 * draw.normal(size=(60, 5))))
    order, parent = negatives.spanning_tree(points)
    assert sorted(order.tolist()) == list(range(60))
    place = {int(x): k for k, x in enumerate(order)}
    assert all(parent[x] < 0 or place[int(parent[x])] < place[int(x)] for x in order)
    # no tree is shorter: Kruskal's has the same length
    length = sum(((points[x] - points[parent[x]]) ** 2).sum() ** 0.5 for x in order if parent[x] >= 0)
    edges, root = sorted((((points[i] - points[j]) ** 2).sum() ** 0.5, i, j) for i in range(60) for j in range(i)), list(range(60))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    least = 0.0
    for d, i, j in edges:
        if top(i) != top(j):
            root[top(i)] = top(j)
            least += d
    assert abs(length - least) < 1e-6
    rows_ = np.floor(256 * draw.normal(size=(500, 5)))
    up = np.array([-1 if parent[x] < 0 else place[int(parent[x])] for x in order])
    search = negatives.Search(points[order], up, rows_)
    for i in range(60):
        true = rows_ @ points[order][i]
        low, high = search.bounds(i)
        assert (low <= true).all() and (true <= high).all()
        at, scores = search.best(i, np.arange(0, 500, 2), 5) if up[i] < 0 else (None, None)
        if up[i] >= 0:
            search.exact(i, np.arange(0, 500, 3), low, high)
            search.done(i, low, high)
    assert search.rescored < 60 * 500
