"""Approximate nearest neighbours by a forest of random-projection trees.

A node of a tree splits its vectors at the median of their projections on a direction between two of them. A query walks all trees at
once: one queue holds the branches that were left aside in any of them, nearest first, by the sum of squared distances to the planes that
lie between. Each leaf that comes out of the queue is searched exactly, until as many vectors have been met as the budget says.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import tiles
from tessella.llm.common import cut, ship, shuffle_width

#: Trees, vectors that they are fitted to (at most about as many), vectors of the fit in a leaf, and the budget of a query: vectors met, as a
#: share of all (one met in several trees counts as often).
TREES, SAMPLE, LEAF, BUDGET = 4, 16384, 32, 1.5
#: Bytes of the vectors of a tile, queries of a block, and neighbours more than asked for that a tile keeps before exact scores are known.
TILE_BYTES, BLOCK, SPARE = 32 << 20, 256, 5


class Forest:
    """The planes of all trees: a node has a direction, a threshold and two children, negative ones being leaves."""

    def __init__(self, sample: np.ndarray, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.direction: list[np.ndarray] = []
        self.threshold: list[float] = []
        self.child: list[list[int]] = []
        self.leaves: list[int] = []  # the tree of each leaf
        self.roots = [self._grow(sample, np.arange(len(sample)), t, rng) for t in range(TREES)]
        self.direction = np.array(self.direction).reshape(len(self.child), sample.shape[1])
        self.threshold, self.child = np.array(self.threshold), np.array(self.child, np.int64).reshape(-1, 2)

    def _grow(self, x: np.ndarray, own: np.ndarray, tree: int, rng: np.random.Generator) -> int:
        root = [0]
        todo = [(own, root, 0)]
        while todo:
            own, slot, side = todo.pop()
            split = self._plane(x[own], rng) if len(own) > LEAF else None
            if split is None:
                slot[side] = -1 - len(self.leaves)
                self.leaves.append(tree)
                continue
            direction, threshold, above = split
            slot[side] = len(self.child)
            self.direction.append(direction)
            self.threshold.append(threshold)
            self.child.append([0, 0])
            todo += [(own[above], self.child[-1], 1), (own[~above], self.child[-1], 0)]
        return root[0]

    @staticmethod
    def _plane(x: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, float, np.ndarray] | None:
        """A plane with vectors on both sides; None if several attempts find none."""
        for _ in range(8):
            a, b = rng.choice(len(x), 2, replace=False)
            direction = x[a] - x[b]
            size = np.linalg.norm(direction)
            if size > 0:
                at = x @ (direction / size)
                threshold = float(np.median(at))
                above = at > threshold
                if above.any() and not above.all():
                    return direction / size, threshold, above
        return None

    def places(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree."""
        out = np.empty((len(x), len(self.roots)), np.int64)
        for t, root in enumerate(self.roots):
            node = np.full(len(x), root)
            while (inside := np.flatnonzero(node >= 0)).size:
                at = node[inside]
                above = np.einsum("ij,ij->i", x[inside], self.direction[at]) > self.threshold[at]
                node[inside] = self.child[at, above.astype(int)]
            out[:, t] = -1 - node
        return out

    def search(self, x: np.ndarray, held: list[int], budget: float, least: int) -> list[list[int]]:
        """The leaves that each query looks through; held: vectors of each leaf; at least so many vectors of one tree, if there are."""
        margins = (x @ self.direction.T - self.threshold).tolist()
        child = self.child.tolist()
        return [self._walk(m, child, held, budget, least * len(self.roots)) for m in margins]

    def _walk(self, margin: list[float], child: list[list[int]], held: list[int], budget: float, least: int) -> list[int]:
        queue = [(0.0, root) for root in self.roots]
        met, out = 0, []
        while queue and (met < budget or met < least):
            far, node = heapq.heappop(queue)
            while node >= 0:
                m = margin[node]
                low, high = child[node]
                node, other = (high, low) if m > 0 else (low, high)
                heapq.heappush(queue, (far + m * m, other))
            out.append(-1 - node)
            met += held[-1 - node]
        return out


def neighbours(embeddings: DataFrame, queries: str, most: int = 20, budget: float = BUDGET) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: the ``most`` rows with the largest inner product that the search finds for each query.

    ``embeddings`` has vec_id and embedding; no other column is read. ``queries`` is a condition on vec_id; every row but the query's own is a
    candidate, and every row is in the index. Nearest first, ties to the smaller vec_id. A score is the inner product of the vectors
    as they are, added up in doubles from the first component to the last, so it does not depend on how rows are dealt out.

    Rows with a null vec_id, a null vector, a null or non-finite component, or nothing but zeros take no part. Of rows that share a vec_id the
    one with the least vector takes part. Vectors may differ in length (a short one goes on with zeros) and in norm: trees are grown on
    vectors with one more component, which makes all equally long, so that the largest product is the nearest. Copies of a vector
    are one entry of the index with its smallest ``most`` + 1 ids, no more of which can be asked for; a product that is no number counts
    as the least. No queries or no rows give no rows.

    Trees are fitted to a sample of at most about SAMPLE vectors, chosen by hash. Each vector goes, once for each tree, to a tile of
    its leaf's neighbours; a leaf of more vectors than a tile may have is dealt out over several. Queries go to the tiles of their leaves.
    """
    spark = embeddings.sparkSession
    ship(spark)
    schema = "query_id long, rank int, vec_id long, score double"
    usable = embeddings.select("vec_id", F.col("embedding").alias("x")).where(tiles.finite("embedding") & F.exists("embedding", lambda c: c != 0))
    rows = cut(tiles.one_a_name(usable, "vec_id", "x"))
    copies = F.expr(f"row_number() OVER (PARTITION BY x ORDER BY vec_id) <= {most + 1}")
    kinds = cut(rows.select("vec_id", "x", copies.alias("kept")).where("kept").groupBy("x").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    size = F.transform("x", lambda c: F.abs(c.cast("double")))
    seen = kinds.agg(F.count(F.lit(1)), F.max(F.size("x")), F.max(F.array_max(size))).first()
    if not seen[0]:
        return spark.createDataFrame([], schema)
    total, dims, scale = seen
    scaled = F.aggregate(F.transform("x", lambda c: c.cast("double") / scale), F.lit(0.0), lambda a, c: a + c * c)
    longest = kinds.agg(F.max(scaled)).first()[0]

    def lifted(x: np.ndarray, query: bool = False) -> np.ndarray:
        """Vectors in a common scale, with the component that makes all equally long; a query's is 0, and its own length does not matter."""
        x = x / scale
        square = np.einsum("ij,ij->i", x, x)
        if query:
            return np.c_[x / np.sqrt(np.maximum(square, 1e-300))[:, None] * np.sqrt(longest), np.zeros(len(x))]
        return np.c_[x, np.sqrt(np.maximum(longest - square, 0.0))]

    dice = F.pmod(F.xxhash64("x"), F.lit(1 << 31))
    chosen = kinds.where(dice < int(min(1.0, SAMPLE / total) * (1 << 31))).select(F.xxhash64("x").alias("h"), F.col("x").cast("array<double>").alias("x")).limit(2 * SAMPLE)
    sample = chosen.toArrow().to_batches()
    points = np.concatenate([tiles.matrix(b.column(1), dims) for b in sample])
    order = np.lexsort((points[:, 0], np.concatenate([b.column(0).to_numpy() for b in sample])))
    grown = spark.sparkContext.broadcast(Forest(lifted(points[order])))
    leaves = len(grown.value.leaves)

    def index(batches):
        for batch in batches:
            place = grown.value.places(lifted(tiles.matrix(batch.column(2), dims)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(place.tolist(), pa.list_(pa.int32()))], ["x", "ids", "leaves"])

    kind = dict(kinds.dtypes)["x"]
    indexed = cut(kinds.select("x", "ids", F.col("x").cast("array<double>").alias("y")).mapInArrow(index, f"x {kind}, ids array<long>, leaves array<int>"))
    held = [0] * leaves
    for leaf, n in indexed.select(F.explode("leaves").alias("leaf")).groupBy("leaf").count().collect():  # one row a leaf
        held[leaf] = n
    # a tile: leaves of one tree with so many vectors, or a part of one leaf
    room = max(64, min(TILE_BYTES // (8 * dims), -(-total * TREES // shuffle_width(spark))))
    first, parts, count, filled, tree = [0] * leaves, [1] * leaves, 0, room, None
    for leaf, n in enumerate(held):
        if filled + n > room or grown.value.leaves[leaf] != tree:
            count, filled, tree = count + 1, 0, grown.value.leaves[leaf]
        first[leaf], parts[leaf] = count - 1, max(1, -(-n // room))
        count, filled = count + parts[leaf] - 1, filled + n
    at, of = np.array(first), np.array(parts)
    in_tile = [np.flatnonzero((at <= t) & (t < at + of)) for t in range(count)]

    def dealt(batches):
        for batch in batches:
            x, ids = tiles.matrix(batch.column(0), dims), batch.column(1).to_pylist()
            place = tiles.matrix(batch.column(2), TREES).astype(np.int64)
            dice = batch.column(3).to_numpy()
            for t in range(TREES):
                goal = at[place[:, t]] + dice % of[place[:, t]]
                by = np.argsort(goal, kind="stable")
                for own in np.split(by, np.flatnonzero(np.diff(goal[by])) + 1):
                    if len(own):
                        body = (place[own, t], x[own].astype(np.float32) if kind == "array<float>" else x[own], [ids[i] for i in own])
                        yield tiles.row(int(goal[own[0]]), tiles.ROWS, body)

    def asked(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                name, x = part.column(0).to_numpy(), tiles.matrix(part.column(1), dims)
                visits = np.zeros((len(x), leaves), bool)
                for i, own in enumerate(grown.value.search(lifted(x, True), held, budget * total, most + 1)):
                    visits[i, own] = True
                for t in range(count):
                    here = visits[:, in_tile[t]]
                    if (who := here.any(axis=1)).any():
                        yield tiles.row(t, tiles.QUERIES, (t, name[who], x[who], here[who]))

    def hold(blocks):
        leaf = np.concatenate([b[0] for b in blocks])
        by = np.argsort(leaf, kind="stable")
        x = np.concatenate([b[1] for b in blocks])[by].astype(np.float64)
        ids = [i for b in blocks for i in b[2]]
        ends = np.flatnonzero(np.r_[True, np.diff(leaf[by]) > 0, True])
        return leaf[by][ends[:-1]], ends, x, [ids[i] for i in by]

    def meet(rows, block):
        own, ends, x, ids = rows
        tile, name, q, visits = block
        best = tiles.Best(len(name), most + SPARE)
        for k, column in enumerate(np.searchsorted(in_tile[tile], own)):
            who = np.flatnonzero(visits[:, column])
            for start in range(ends[k], ends[k + 1], 8192) if len(who) else ():
                stop = min(start + 8192, ends[k + 1])
                best.add((q[who] / scale) @ (x[start:stop] / scale).T, True, np.arange(start, stop), who)
        exact = np.zeros(len(best.row))
        with np.errstate(over="ignore", invalid="ignore"):
            for d in range(dims):
                exact += q[best.row, d] * x[best.name, d]
        exact[np.isnan(exact)] = -np.inf
        n = np.array([len(ids[i]) for i in best.name], int)
        row, score = np.repeat(best.row, n), np.repeat(exact, n)
        other = np.array([v for i in best.name for v in ids[i]], np.int64)
        keep = other != name[row]
        row, score, other = row[keep], score[keep], other[keep]
        keep = tiles.best_first(row, score, other, most)
        yield tiles.lists([name[row[keep]], other[keep], score[keep]], row[keep], 1)

    spread = indexed.select(F.col("x").cast("array<double>").alias("x"), "ids", F.col("leaves").cast("array<double>").alias("leaves"), F.pmod(F.xxhash64("x", F.lit(1)), F.lit(1 << 31)).alias("dice"))
    wanted = rows.where(F.expr(queries)).select("vec_id", F.col("x").cast("array<double>").alias("x"))
    found = tiles.meeting(spread.mapInArrow(dealt, tiles.BLOCK), wanted.mapInArrow(asked, tiles.BLOCK), count, meet, "query_id long, names array<long>, scores array<double>", hold)
    out = tiles.merged(found, ["query_id"], most)
    each = out.select("query_id", F.posexplode(F.arrays_zip("names", "scores")).alias("at", "n"))
    return each.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("n.names").alias("vec_id"), F.col("n.scores").alias("score"))
