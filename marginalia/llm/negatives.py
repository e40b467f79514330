"""Hard-negative mining with anchor spanning-tree bounds.

Anchors are dealt into blocks, and each block's anchors hang in a minimum spanning
tree by distance. Going down the tree, the score of a candidate at an anchor lies
within its score, or its bounds, at the parent, plus or minus the edge's length
times the candidate's norm. An anchor scores exactly only those candidates whose
bounds reach what is asked for: the best of its own label first, which gives the
windows; then those of other labels that overlap a window and may be among its first.
What is exact at an anchor gives its children narrow bounds again.

Every block of anchors meets every block of rows, as each anchor is searched against
all rows: a stated query set in blocks. Both sides of a cell are bounded, a cell gives
a few rows for each anchor, and these are merged by rank. Blocks of anchors are taken a
few at a time, so that the copies of the rows stay a fixed multiple of the table.

Scores are integers and exact; bounds are rounded outwards. Rows with a null label, a
null vector, or a null or non-finite component take no part. A null vec_id is no
anchor, and stands behind all others among equal scores. Repeated rows are rows of
their own: each is an anchor, a positive or a negative, and only the anchor's own row
is not "other". Vectors of several lengths: missing components count as zero. Scores
beyond a long are not defined. Further columns play no
part; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.llm.shared import dropped, settled

#: Anchors and rows in a block, in the mean.
BLOCK_ANCHORS, BLOCK_ROWS = 4096, 4096
#: Blocks of anchors that the rows are copied for at once.
AT_ONCE = 2
#: Where a null vec_id stands.
LAST_ID = 2**63 - 1
#: Products of whole numbers below this are exact as doubles.
EXACT = 2.0**52


def whole(vectors: pa.Array, width: int) -> np.ndarray:
    """Components as the integers floor(256 * x), in doubles."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    at = vectors.offsets.to_numpy()
    flat = vectors.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]].astype(np.float64)
    at = at - at[0]
    out = np.zeros((len(at) - 1, width))
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    out[row, np.arange(len(flat)) - at[row]] = np.floor(256 * flat)
    return out


def spanning_tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A minimum spanning tree of points by distance: an order in which parents come first, and each one's parent (the first has -1).

    An anchor's largest branch comes last, so that few anchors wait for children at any time."""
    n = len(points)
    norms = (points * points).sum(1)
    near, parent, left = np.full(n, np.inf), np.full(n, -1), np.ones(n, dtype=bool)
    joined, at = [0], 0
    left[0] = False
    for _ in range(n - 1):
        far = norms + norms[at] - 2 * np.einsum("ij,j->i", points, points[at])
        closer = left & (far < near)
        near[closer], parent[closer] = far[closer], at
        at = int(np.where(left, near, np.inf).argmin())
        left[at] = False
        joined.append(at)
    size = np.ones(n, dtype=np.int64)
    for i in reversed(joined[1:]):
        size[parent[i]] += size[i]
    below: list[list[int]] = [[] for _ in range(n)]
    for i in joined[1:]:
        below[parent[i]].append(i)
    order, stack = [], [0] if n else []
    while stack:
        i = stack.pop()
        order.append(i)
        stack += sorted(below[i], key=lambda j: -size[j])
    return np.array(order, dtype=np.int64), parent


def first(scores: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Of candidates in the order of their ids, the positions ``at`` of the k best scores; ties by order."""
    if len(at) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        more, ties = at[scores > least], at[scores == least]
        chosen = np.concatenate([more, ties[: k - len(more)]])
        some = np.concatenate([scores[scores > least], np.full(k - len(more), least)])
    else:
        chosen, some = at, scores
    return chosen[np.lexsort((chosen, -some))]


class Search:
    """Anchors of a block, parents first, against candidates in the order of their ids."""

    def __init__(self, anchors: np.ndarray, parents: np.ndarray, rows: np.ndarray):
        self.anchors, self.parents, self.rows = anchors, parents, rows
        self.norms = np.sqrt((rows * rows).sum(1)) * (1 + 1e-9)
        self.waiting = np.bincount(parents[parents >= 0], minlength=len(anchors))
        self.known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.small = np.abs(rows).max(initial=0) * np.abs(anchors).max(initial=0) * rows.shape[1] < EXACT
        self.rescored = 0

    def products(self, i: int, at: np.ndarray) -> np.ndarray:
        """Exact scores of the rows ``at``."""
        self.rescored += len(at)
        if not self.small:
            return (self.rows[at].astype(np.int64) * self.anchors[i].astype(np.int64)).sum(1)
        if 2 * len(at) > len(self.rows):
            return np.einsum("ij,j->i", self.rows, self.anchors[i]).astype(np.int64)[at]
        return np.einsum("ij,j->i", self.rows[at], self.anchors[i]).astype(np.int64)

    def around(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of known scores: themselves, where doubles can hold them."""
        x = scores.astype(np.float64)
        return (x, x.copy()) if self.small else (np.nextafter(x, -np.inf), np.nextafter(x, np.inf))

    def bounds(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of all scores at an anchor, from its parent's."""
        p = int(self.parents[i])
        if p < 0:
            return self.around(self.products(i, np.arange(len(self.rows))))
        low, high = self.known[p]
        edge = float(np.sqrt(((self.anchors[i] - self.anchors[p]) ** 2).sum())) * (1 + 1e-9)
        # doubles of this size are off by less than a part in 2**50; an edge of no length leaves the scores as they are
        reach = edge * self.norms
        reach = reach * (1 + 1e-9) + (np.maximum(np.abs(low), np.abs(high)) * 1e-15 + 1e-6) * (edge > 0)
        self.waiting[p] -= 1
        if not self.waiting[p]:
            del self.known[p]
        return low - reach, high + reach

    def exact(self, i: int, at: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Scores of candidates; those that the bounds give already are not computed."""
        scores, loose = low[at].astype(np.int64), low[at] < high[at]
        scores[loose] = self.products(i, at[loose])
        low[at[loose]], high[at[loose]] = self.around(scores[loose])
        return scores

    def done(self, i: int, low: np.ndarray, high: np.ndarray) -> None:
        if self.waiting[i]:
            self.known[i] = low, high

    def best(self, i: int, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and scores of the k best among the positions ``own``."""
        low, high = self.bounds(i)
        if len(own) > k:
            least = np.partition(low[own], len(own) - k)[len(own) - k]
            own = own[high[own] >= least]
        scores = self.exact(i, own, low, high)
        self.done(i, low, high)
        chosen = first(scores, own, k)
        return chosen, scores[np.searchsorted(own, chosen)]

    def inside(self, i: int, other: np.ndarray, windows: list[tuple[int, int]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each window of scores the positions and scores of its k best among the positions ``other``."""
        low, high = self.bounds(i)
        lows, highs = low[other], high[other]
        wanted = np.zeros(len(other), dtype=bool)
        for least, most in windows:
            if least > most:
                continue
            overlap = (highs >= least) & (lows <= most)
            sure = lows[overlap & (lows >= least) & (highs <= most)]
            if len(sure) > k:
                overlap &= highs >= np.partition(sure, len(sure) - k)[len(sure) - k]
            wanted |= overlap
        at = other[wanted]
        scores = self.exact(i, at, low, high)
        self.done(i, low, high)
        out = []
        for least, most in windows:
            fits = (scores >= least) & (scores <= most)
            chosen = first(scores[fits], at[fits], k)
            out.append((chosen, scores[np.searchsorted(at, chosen)]))
        return out


def taking_part(vectors: DataFrame) -> DataFrame:
    """(row, id, label, vector) of the rows that take part; ``row`` tells them apart."""
    x = F.col("vector")
    ok = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    rows = vectors.select(vectors["vec_id"].cast("long").alias("id"), vectors["label"].cast("long").alias("label"), vectors["embedding"].alias("vector"))
    rows = rows.where(F.col("label").isNotNull() & x.isNotNull() & F.coalesce(ok, F.lit(False)))
    label = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.select(F.monotonically_increasing_id().alias("row"), F.coalesce("id", F.lit(LAST_ID)).alias("id"), label.alias("label"), "vector")
    return settled(rows)  # from here on a row's number stays


def dealt(row: str, n: int) -> Column:
    return F.pmod(F.xxhash64(row), F.lit(n)).cast("int")


TREE = "block int, place int, parent int, row long, id long, label long, vector array<double>"


def hung(anchors: DataFrame) -> DataFrame:
    """Anchors of a block in the order of their tree, each with its parent's place."""

    def run(key: tuple, block: pa.Table) -> pa.Table:
        points = whole(block.column("vector"), int(pc.max(pc.list_value_length(block.column("vector"))).as_py()))
        order, parent = spanning_tree(points)
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        up = np.where(parent[order] < 0, -1, place[parent[order]])
        out = block.take(pa.array(order))
        out = out.append_column("place", pa.array(np.arange(len(order)), pa.int32())).append_column("parent", pa.array(up, pa.int32()))
        return out.select([c.split()[0] for c in TREE.split(", ")])

    return anchors.select("block", "row", "id", "label", F.col("vector").cast("array<double>").alias("vector")).groupBy("block").applyInArrow(run, TREE)


def cell(anchors: pa.Table, rows: pa.Table) -> tuple[Search, pa.Table, pa.Table, dict[int, np.ndarray]]:
    """A search over one cell, its anchors and rows in order, and the rows' positions by label."""
    anchors, rows = anchors.sort_by("place"), rows.sort_by([("id", "ascending"), ("row", "ascending")])
    width = max([0, *(int(pc.max(pc.list_value_length(t.column("vector"))).as_py() or 0) for t in (anchors, rows) if t.num_rows)])
    search = Search(whole(anchors.column("vector"), width), anchors.column("parent").to_numpy(), whole(rows.column("vector"), width))
    labels = rows.column("label").to_numpy()
    return search, anchors, rows, {int(x): np.flatnonzero(labels == x) for x in np.unique(labels)}


def made(schema: str, columns: list[list]) -> pa.Table:
    """Lists of ints, or of lists of them, as a table of a schema of longs."""
    fields = [c.split() for c in schema.split(", ")]
    return pa.table([pa.array(v, pa.list_(pa.int64()) if "array" in kind else pa.int64()) for v, (_, kind) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def paired(anchors: DataFrame, rows: DataFrame, cells: int, n_blocks: int, kernel, schema: str) -> DataFrame:
    """``kernel`` on every pair of a block of ``anchors`` and a block of ``rows``, a few blocks of anchors at a time."""
    out = None
    for low in range(0, n_blocks, AT_ONCE):
        high = min(low + AT_ONCE, n_blocks)
        some = anchors.where(F.col("block").between(low, high - 1)).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))))
        copies = rows.withColumn("part", dealt("row", cells)).withColumn("of", F.explode(F.sequence(F.lit(low), F.lit(high - 1))))
        done = some.groupBy("block", "part").cogroup(copies.groupBy("of", "part")).applyInArrow(kernel, schema)
        done = settled(done)
        out = done if out is None else out.unionByName(done)
    return out


def mine(vectors: DataFrame, every: int = 50, n_positives: int = 5, n_negatives: int = 3, window: tuple[int, int] = (50, 95), block_anchors: int = BLOCK_ANCHORS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows whose vec_id is divisible by ``every``; negatives score within ``window`` percent of the positive."""
    rows = taking_part(vectors)
    anchors = rows.where((F.col("id") % every == 0) & (F.col("id") != LAST_ID))
    n_blocks, cells = max(1, -(-anchors.count() // block_anchors)), max(1, -(-rows.count() // block_rows))
    tree = settled(hung(anchors.withColumn("block", dealt("row", n_blocks))))
    spec = "anchor long, row long, id long, score long"

    def positives(a: pa.Table, r: pa.Table) -> pa.Table:
        search, a, r, by_label = cell(a, r)
        out: list[list] = [[], [], [], []]
        ids, numbers = r.column("id").to_numpy(), r.column("row").to_numpy()
        for i, (row, label) in enumerate(zip(a.column("row").to_pylist(), a.column("label").to_pylist(), strict=True)):
            own = by_label.get(label, np.zeros(0, dtype=np.int64))
            at, scores = search.best(i, own[numbers[own] != row], n_positives)
            out[0] += [row] * len(at)
            for column, values in zip(out[1:], (numbers[at], ids[at], scores), strict=True):
                column += values.tolist()
        return made(spec, out)

    found = paired(tree, rows, cells, n_blocks, positives, spec)
    order = Window.partitionBy("anchor").orderBy(F.col("score").desc(), "id", "row")
    top = found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= n_positives)
    listed = F.array_sort(F.collect_list(F.struct("nth", "id", "score")))
    top = top.groupBy("anchor").agg(listed.alias("p")).select(F.col("anchor").alias("row"), F.col("p.id").alias("ids"), F.col("p.score").alias("scores"))
    asked = settled(tree.join(top, "row", "left"))
    low, high = window
    answer = "anchor long, anchor_id long, nth long, positive long, positive_score long, negative long, negative_score long"

    def negatives(a: pa.Table, r: pa.Table) -> pa.Table:
        search, a, r, by_label = cell(a, r)
        out: list[list] = [[] for _ in answer.split(", ")]
        ids = r.column("id").to_numpy()
        labels = r.column("label").to_numpy()
        others = {x: np.flatnonzero(labels != x) for x in set(a.column("label").to_pylist())}
        for i, (row, anchor, label, positive, scores) in enumerate(zip(*(a.column(c).to_pylist() for c in ("row", "id", "label", "ids", "scores")), strict=True)):
            # low * positive <= 100 * score <= high * positive, in whole numbers
            windows = [(-(-low * s // 100), high * s // 100) for s in scores or []]
            for n, (at, got) in enumerate(search.inside(i, others[label], windows, n_negatives)):
                fixed = (row, anchor, n, positive[n], scores[n])
                for column, value in zip(out[:5], fixed, strict=True):
                    column += [value] * len(at)
                out[5] += ids[at].tolist()
                out[6] += got.tolist()
        return made(answer, out)

    met = paired(asked, rows, cells, n_blocks, negatives, answer)
    dropped(rows)
    order = Window.partitionBy("anchor", "nth").orderBy(F.col("negative_score").desc(), "negative")
    kept = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n_negatives)
    own = lambda c: F.nullif(F.col(c), F.lit(LAST_ID))
    return kept.select(F.col("anchor_id"), own("positive").alias("positive_id"), "rank", own("negative").alias("negative_id"), "positive_score", "negative_score")


def op11_anchor_tree_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
