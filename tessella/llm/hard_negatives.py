"""Hard negatives: rows of another label that score high for an anchor, but not as high as its positives.

Scores are exact integer inner products. Several candidates share one wide integer: their components, biased to be positive, lie in
separated fields of it, so one product with an anchor's component multiplies them all, and the sum over the components holds the
candidates' scores side by side (Kronecker packing). How wide a field must be follows from the largest component and the largest sum of
an anchor's components, so fields never run into each other; where 63 bits do not hold one field, integers of any length do.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import tiles
from tessella.llm.common import cut, ship, shuffle_width

#: Candidates of a pack, anchors of a block, and packs of a tile that a task holds.
PACK, BLOCK, TILE = 1536, 128, 32
#: Bits of the wide integer, and fields of one that is as long as it needs to be.
BITS, LONG_FIELDS = 63, 4


class Fields:
    """How candidates lie in wide integers: components up to ``most`` in size, anchors whose components' sizes add up to ``total`` at most."""

    def __init__(self, most: int, total: int):
        self.bias = most
        self.width = max(1, (2 * most * total).bit_length())
        self.long = self.width > BITS
        self.number = LONG_FIELDS if self.long else BITS // self.width

    def integers(self, x: np.ndarray) -> np.ndarray:
        """floor(256 x), as 64-bit integers or as ones of any length."""
        whole = np.floor(256.0 * x) if np.abs(x).max(initial=0.0) < 1e300 else None
        if self.long:
            flat = [int(v) for v in whole.ravel()] if whole is not None else [int(v) * 256 for v in x.ravel()]  # so large a double is whole
            return np.array(flat, object).reshape(x.shape)
        return whole.astype(np.int64)

    def packed(self, c: np.ndarray) -> np.ndarray:
        """Rows of components, ``number`` candidates in each; the last row is filled up."""
        fill = -len(c) % self.number
        lifted = np.concatenate([c + self.bias, np.zeros((fill, c.shape[1]), c.dtype)])
        own = lifted.reshape(-1, self.number, c.shape[1])
        out = own[:, 0].copy()
        for j in range(1, self.number):
            out += own[:, j] << self._at(j)
        return out

    def products(self, anchors: np.ndarray, packed: np.ndarray, n: int) -> np.ndarray:
        """Scores of all anchors (down) with the n candidates (across) of packed rows."""
        least = np.where(anchors < 0, -anchors, 0).sum(axis=1) * (2 * self.bias)  # lifts the least field to 0
        total = anchors @ packed.T  # modulo 2^64; the lifted fields fit into 63 bits
        for j in range(self.number):
            total = total + (least << self._at(j))[:, None]
        own = least + self.bias * anchors.sum(axis=1)
        mask = (1 << self.width) - 1
        out = np.empty((len(anchors), packed.shape[0], self.number), total.dtype)
        for j in range(self.number):
            out[:, :, j] = ((total >> self._at(j)) & mask) - own[:, None]
        return out.reshape(len(anchors), -1)[:, :n]

    def _at(self, j: int) -> int:
        return self.width * j


def mined(embeddings: DataFrame, anchors: str, positives: int = 5, negatives: int = 10, band: tuple[int, int] = (30, 90)) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score (longs, rank an int).

    ``embeddings`` has vec_id, embedding and label; no other column is read. ``anchors`` is a condition on vec_id. A row's score for an
    anchor is the inner product of the vectors floor(256 x); higher scores come first, ties by smaller vec_id. An anchor's positives are its
    first rows of the same label, itself excluded; the negatives for each are the first rows of another label whose score is between
    the band's per cents of the positive's score, both ends included. All rows are candidates, none is left out.

    Rows with a null vec_id, label or vector, or with a null or non-finite component, take no part. Of rows that share a vec_id one takes part,
    the least by label and vector, so a repeated row counts once. Vectors may differ in length: a short one goes on with zeros, and an empty
    one scores 0. Copies of a vector are candidates each. No anchors, or no rows, give no rows. A returned score beyond 64 bits is an error;
    those that are compared may have any length.

    Every anchor meets every row (that is what is asked for); packs of candidates are dealt out in tiles of at most about 50 000, each of
    which sees all anchors pass by in blocks, so the memory of a task does not grow with the table.
    """
    spark = embeddings.sparkSession
    ship(spark)
    low, high = band
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    usable = embeddings.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x")).where(F.col("label").isNotNull() & tiles.finite("embedding"))
    rows = cut(tiles.one_a_name(usable, "vec_id", "label", "x"))
    size = F.transform("x", F.abs)
    own = F.expr(anchors)
    seen = rows.agg(F.max(F.size("x")), F.max(F.array_max(size)), F.max(F.when(own, F.aggregate(size, F.lit(0.0), lambda a, b: a + b))), F.count_if(own)).first()
    if not seen[3]:
        return spark.createDataFrame([], schema)
    dims = max(1, seen[0])
    ceiling = lambda v: int(v or 0.0) * 256 + 256  # noqa: E731  no less than floor(256 v) and its like below 0
    most = ceiling(seen[1]) if seen[1] is None or seen[1] > 1e15 else int(256 * seen[1]) + 1
    total = min(dims * most, int((seen[2] or 0.0) * 1.000001 * 256) + dims + 1) if (seen[2] or 0.0) < 1e15 else dims * most
    fields = Fields(most, total)

    def columns(batch):
        return batch.column(0).to_numpy(), batch.column(1).to_numpy(), fields.integers(tiles.matrix(batch.column(2), dims))

    def candidates(batches):
        def made(batch):
            ids, labels, x = columns(batch)
            return ids, labels, fields.packed(x)

        yield from tiles.blocks(batches, tiles.ROWS, PACK, made)

    packs = cut(rows.select("vec_id", F.col("label").cast("long").alias("label"), "x").mapInArrow(candidates, tiles.BLOCK).withColumn("key", F.xxhash64(F.spark_partition_id(), "tile")))
    number = packs.count()
    count = max(1, min(number, max(shuffle_width(spark), -(-number // TILE))))
    dealt = packs.withColumn("tile", F.pmod("key", F.lit(count)).cast("int"))

    def everywhere(blocks: DataFrame) -> DataFrame:
        return blocks.select(F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("tile"), "kind", "body")

    def anchor_blocks(batches):
        yield from tiles.blocks(batches, tiles.QUERIES, BLOCK, lambda b: (*columns(b), [c.to_pylist() for c in b.columns[3:]]))

    chosen = rows.where(own).select("vec_id", F.col("label").cast("long").alias("label"), "x")

    def nearest(held, block):
        ids, labels, x, _ = block
        best = tiles.Best(len(ids), positives)
        for names, kinds, packed in held:
            score = fields.products(x, packed, len(names))
            best.add(score, (labels[:, None] == kinds[None, :]) & (ids[:, None] != names[None, :]), names)
        at, names, scores = best.found()
        yield pa.RecordBatch.from_arrays([pa.array(ids[at]), names, scores], ["anchor_id", "names", "scores"])

    found = tiles.meeting(dealt, everywhere(cut(chosen.mapInArrow(anchor_blocks, tiles.BLOCK))), count, nearest, "anchor_id long, names array<long>, scores array<long>")
    near = tiles.merged(found, ["anchor_id"], positives).withColumnRenamed("anchor_id", "vec_id")
    known = cut(chosen.join(near, "vec_id").select("vec_id", "label", "x", "names", "scores"))

    def hard(held, block):
        ids, labels, x, (names_, scores_) = block
        of = np.repeat(np.arange(len(ids)), [len(n) for n in names_])
        positive, score_of = [n for ns in names_ for n in ns], [s for ss in scores_ for s in ss]
        kind = x.dtype
        least, greatest = (np.array(v, object).astype(kind)[:, None] for v in ([-(-low * s // 100) for s in score_of], [high * s // 100 for s in score_of]))
        best = tiles.Best(len(of), negatives)
        for names, kinds, packed in held:
            score = fields.products(x, packed, len(names))[of]
            best.add(score, (score >= least) & (score <= greatest) & (labels[of][:, None] != kinds[None, :]), names)
        at, names, scores = best.found()
        yield pa.RecordBatch.from_arrays([pa.array(ids[of][at]), pa.array(np.array(positive, np.int64)[at]), pa.array(np.array(score_of, np.int64)[at]), names, scores], ["anchor_id", "positive_id", "positive_score", "names", "scores"])

    blocks = cut(known.mapInArrow(anchor_blocks, tiles.BLOCK))
    negative = tiles.meeting(dealt, everywhere(blocks), count, hard, "anchor_id long, positive_id long, positive_score long, names array<long>, scores array<long>")
    out = tiles.merged(negative, ["anchor_id", "positive_id", "positive_score"], negatives)
    each = out.select("anchor_id", "positive_id", "positive_score", F.posexplode(F.arrays_zip("names", "scores")).alias("at", "n"))
    return each.select("anchor_id", "positive_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("n.names").alias("negative_id"), "positive_score", F.col("n.scores").alias("negative_score"))


#: DuckDB SQL for the query op11_hard_negatives.
ORACLE_SQL = """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, CAST(list_sum(list_transform(range(1, len(a.e) + 1), lambda i: a.e[i] * r.e[i])) AS BIGINT) AS score FROM v a JOIN v r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 10"""
