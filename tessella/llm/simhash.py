"""SimHash fingerprints of word shingles, and their links at a small Hamming distance, by the generalised pigeonhole."""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tessella.llm.bloom import filter_of
from tessella.llm.common import ascii_lower, cut, let, ship, shuffle_width, words
from tessella.llm.components import components, forest

BITS = 64
#: Rows of one key that one task compares in one piece; larger keys are dealt out as pairs of tiles.
TILE = 8192
#: Cost of a probed row and of a compared pair, in the same unit; only their ratio matters.
ROW_COST, PAIR_COST = 200.0, 1.0


def shingle_hashes(text, size: int):
    """XXH64 (seed 42) of each run of so many words, repeats included; of the whole sequence if it is shorter."""

    def of(w):
        n = F.size(w)
        whole = F.when(n > 0, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(F.array().cast("array<bigint>"))
        runs = F.transform(F.sequence(F.lit(0), n - size), lambda i: F.xxhash64(F.concat_ws(" ", *(F.get(w, i + k) for k in range(size)))))
        return F.when(n < size, whole).otherwise(runs)

    return let(words(ascii_lower(text)), of)


def fingerprints(docs: DataFrame, size: int = 3, also: str = "doc_id") -> DataFrame:
    """(``also``, fp) of each row: a bit is set if more than half of the shingle hashes have it; no words give 0."""
    ship(docs.sparkSession)
    bits = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
    lanes = np.arange(8) * 256

    def vote(batches):
        for batch in batches:
            hashes = batch.column(1)
            flat = hashes.flatten().to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(hashes.value_lengths().to_numpy(zero_copy_only=False))])
            out = np.zeros(batch.num_rows, np.uint64)
            for k in range(batch.num_rows):
                own = flat[ends[k] : ends[k + 1]]
                if len(own):
                    seen = np.zeros(8 * 256, np.int64)
                    for at in range(0, len(own), 1 << 20):
                        seen += np.bincount((own[at : at + (1 << 20)].view(np.uint8).reshape(-1, 8) + lanes).ravel(), minlength=8 * 256)
                    count = (seen.reshape(8, 256) @ bits).ravel()
                    out[k] = np.packbits(2 * count > len(own), bitorder="little").view("<u8")[0]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], [also, "fp"])

    schema = StructType([docs.schema[also], StructField("fp", LongType())])
    return docs.select(also, shingle_hashes(F.col("text"), size).alias("h")).mapInArrow(vote, schema)


def bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and how many have both bits i and j: 4096 sums, whatever the size of the table."""

    def count(batches):
        both, n = np.zeros((BITS, BITS), np.int64), 0
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint8).reshape(-1, 8)
            for at in range(0, len(values), 1 << 16):
                x = np.unpackbits(values[at : at + (1 << 16)], axis=1, bitorder="little").astype(np.float32)
                both += (x.T @ x).astype(np.int64)
                n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS + 1)), pa.array(np.append(both.ravel(), n))], ["k", "n"])

    found = np.zeros(BITS * BITS + 1, np.int64)
    for k, n in fps.select("fp").mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n")).collect():
        found[k] = n
    return int(found[-1]), found[:-1].reshape(BITS, BITS)


def correlated_groups(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Bits dealt into parts of nearly equal width; each goes where the bits correlate most with it."""
    p = both.diagonal() / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(corr, 0)
    room = [len(x) for x in np.array_split(np.arange(BITS), parts)]
    order = list(np.argsort(-corr.sum(0), kind="stable"))
    groups: list[list[int]] = [[] for _ in range(parts)]
    for bit in order:
        best = max((g for g in range(parts) if len(groups[g]) < room[g]), key=lambda g: (corr[bit, groups[g]].mean() if groups[g] else 0.0, -g))
        groups[best].append(int(bit))
    return [sorted(g) for g in groups]


def plan(n: int, both: np.ndarray, distance: int = 3) -> list[tuple[list[int], int]]:
    """(bits, threshold) of the parts to probe.

    If two fingerprints differ in at most ``distance`` bits, then for thresholds t with sum(t + 1) = distance + 1 they differ
    in at most t bits inside some part. For each number of parts, dynamic programming shares the distance + 1 units out among
    them so that the estimated cost (probed rows, and pairs that agree by how often the bits, and neighbours among them, occur
    together) is least.
    """
    first = both.diagonal()
    # how often two bits are (1, 1), (1, 0), (0, 1), (0, 0); squares summed: the chance that two rows agree in both
    cells = np.stack([both, first[:, None] - both, first[None, :] - both, n - first[:, None] - first[None, :] + both]) / max(n, 1)
    agree = (cells**2).sum(0)
    same = agree.diagonal() / 1.0

    def differing(bits: list[int], most: int) -> np.ndarray:
        """The chance that two rows differ in 0 to ``most`` of these bits: a chain, in which each bit depends on the one before it,
        the most alike of those that are left."""
        rest, last = bits[1:], bits[0]
        ways = np.zeros((most + 1, 2))  # bits that differ; whether the last one agrees
        ways[0, 1] = same[last]
        if most:
            ways[1, 0] = 1 - same[last]
        while rest:
            b = max(rest, key=lambda x: (agree[last, x] - same[last] * same[x], -x))
            rest = [x for x in rest if x != b]
            both_same = agree[last, b] / max(same[last], 1e-9)  # given that the last one agrees, and that it differs
            only_new = (same[b] - agree[last, b]) / max(1 - same[last], 1e-9)
            new = np.zeros_like(ways)
            new[:, 1] = ways[:, 1] * both_same + ways[:, 0] * only_new
            new[1:, 0] = ways[:-1, 1] * (1 - both_same) + ways[:-1, 0] * (1 - only_new)
            ways, last = new, b
        return ways.sum(1)

    def cost(bits: list[int], units: int) -> float:
        if not units:
            return 0.0
        if units > min(3, len(bits)):
            return float("inf")
        k, t = len(bits), units - 1
        # a pair that differs in d bits meets under each mask that frees those d
        pairs = n / 2 * sum(p * comb(k - d, t - d) for d, p in enumerate(differing(bits, t)))
        return n * (comb(k, t) * ROW_COST + pairs * PAIR_COST)

    best = (float("inf"), [])
    for parts in range(2, distance + 2):
        groups = correlated_groups(n, both, parts)
        table = {0: (0.0, [])}
        for bits in groups:
            new: dict[int, tuple[float, list]] = {}
            for used, (so_far, chosen) in table.items():
                for units in range(distance + 2 - used):
                    total = so_far + cost(bits, units)
                    if used + units not in new or total < new[used + units][0]:
                        new[used + units] = (total, [*chosen, (bits, units - 1)])
            table = new
        if distance + 1 in table and table[distance + 1][0] < best[0]:
            best = table[distance + 1]
    return [(bits, t) for bits, t in best[1] if t >= 0]


def _masks(parts: list[tuple[list[int], int]]) -> list[int]:
    """The bits to compare, as signed 64-bit masks: one for each choice of the bits of a part that may differ."""
    out = []
    for bits, t in parts:
        for free in combinations(bits, t):
            mask = sum(1 << b for b in bits if b not in free)
            out.append(mask - (1 << 64) if mask >> 63 else mask)
    return out


def _near(keys: np.ndarray, fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the pairs with one key that differ in so few bits; rows are in order of their keys."""
    a, b, at, step = [], [], np.arange(len(keys)), 1
    while len(at := at[at + step < len(keys)]) and len(at := at[keys[at] == keys[at + step]]):
        hit = at[np.bitwise_count(fps[at] ^ fps[at + step]) <= distance]
        if len(hit):
            a.append(fps[hit])
            b.append(fps[hit + step])
        if sum(map(len, a)) > 1 << 20:
            x, y = forest(np.concatenate(a), np.concatenate(b))
            a, b = [x], [y]
        step += 1
    return forest(np.concatenate(a), np.concatenate(b)) if a else (fps[:0], fps[:0])


def _rows(kind: int, x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(x), kind, np.int32)), pa.array(x), pa.array(y)], ["kind", "a", "b"])


def link(fps: DataFrame, distance: int = 3) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that join exactly those reachable through links of ``distance`` bits.

    ``fps`` has distinct values in fp. Every fingerprint is written once for each mask; rows with one key meet in a task,
    which compares them in blocks and passes on a spanning forest, never all pairs. A key of more than TILE rows is passed
    on, cut into tiles, and each pair of tiles is compared by a task of its own.
    """
    spark = fps.sparkSession
    ship(spark)
    n, both = bit_counts(fps)
    if n < 2:
        return spark.createDataFrame([], "a long, b long")
    masks = _masks(plan(n, both, distance))
    key = F.explode(F.array(*(F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(m).cast("long"))) for k, m in enumerate(masks))))
    width = max(shuffle_width(spark), n * len(masks) // 2_000_000)

    def small(batches):
        keys, values = np.empty(0, np.int64), np.empty(0, np.int64)
        large = None

        def done(keys, values):
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
            sizes = np.diff(np.r_[starts, len(keys)])
            wide = np.repeat(sizes > TILE, sizes)
            out = [_rows(1, keys[wide], values[wide])] if wide.any() else []
            x, y = _near(keys[~wide], values[~wide], distance)
            return [*out, _rows(0, x, y)] if len(x) else out

        for batch in batches:
            keys = np.concatenate([keys, batch.column(0).to_numpy(zero_copy_only=False)])
            values = np.concatenate([values, batch.column(1).to_numpy(zero_copy_only=False)])
            if large is not None:  # the rest of a key that is known to be large
                end = int(np.searchsorted(keys != large, True))
                yield _rows(1, keys[:end], values[:end])
                keys, values = keys[end:], values[end:]
                if not len(keys):
                    continue
                large = None
            last = int(np.flatnonzero(keys == keys[-1])[0]) if len(keys) else 0
            if len(keys) - last > TILE:
                large, end = keys[-1], last
                yield from done(keys[:last], values[:last])
                yield _rows(1, keys[last:], values[last:])
                keys, values = keys[:0], values[:0]
            elif last > 1 << 16:
                yield from done(keys[:last], values[:last])
                keys, values = keys[last:], values[last:]
        yield from done(keys, values)

    found = cut(fps.select(key.alias("k"), "fp").repartition(width, "k").sortWithinPartitions("k").mapInArrow(small, "kind int, a long, b long"))
    edges = found.where("kind = 0").select("a", "b")
    wide = found.where("kind = 1").select(F.col("a").alias("k"), F.col("b").alias("fp"))
    if not wide.isEmpty():
        tiles = wide.groupBy("k").agg(F.ceil(2 * F.count(F.lit(1)) / TILE).cast("long").alias("t"))
        own = wide.join(tiles, "k").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("t")))
        meets = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("t") - 1)))
        pair = F.xxhash64("k", F.least("own", "other"), F.greatest("own", "other")).alias("k")

        def tile(batches):
            keys, values = np.empty(0, np.int64), np.empty(0, np.int64)
            for batch in batches:
                keys = np.concatenate([keys, batch.column(0).to_numpy(zero_copy_only=False)])
                values = np.concatenate([values, batch.column(1).to_numpy(zero_copy_only=False)])
                last = int(np.flatnonzero(keys == keys[-1])[0]) if len(keys) else 0
                if last > 1 << 14:
                    x, y = _near(keys[:last], values[:last], distance)
                    yield _rows(0, x, y)
                    keys, values = keys[last:], values[last:]
            x, y = _near(keys, values, distance)
            yield _rows(0, x, y)

        more = meets.select(pair, "fp").repartition(width, "k").sortWithinPartitions("k").mapInArrow(tile, "kind int, a long, b long")
        edges = edges.union(more.select("a", "b"))
    return edges


def _least(prints: DataFrame, value: str, distance: int) -> DataFrame:
    """(fp, least), written: for each fingerprint the least value in its component. Written, so that the join of all rows with it has
    plain sides, which Spark can split where a fingerprint has very many rows."""
    nodes = cut(prints.groupBy("fp").agg(F.min(value).alias("own")))
    reach = components(link(nodes, distance)).withColumnRenamed("node", "fp").join(nodes, "fp")
    linked = reach.join(reach.groupBy("root").agg(F.min("own").alias("least")), "root").select("fp", "least")
    return cut(nodes.join(linked, "fp", "left").select("fp", F.coalesce("least", "own").alias("least")))


def near_duplicates(docs: DataFrame, size: int = 3, distance: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the least doc_id reachable through links.

    One row a row of ``docs``; only doc_id and text are read. Null and empty texts have the fingerprint 0, linked like any
    other. Equal fingerprints are one node, so exact copies cost nothing. A null doc_id never becomes a component_id unless
    its whole component has none. An empty table gives no rows.
    """
    prints = cut(fingerprints(docs, size))
    named = prints.join(_least(prints, "doc_id", distance), "fp")
    return named.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("least").alias("component_id"))


def first_of_each(docs: DataFrame, size: int = 3, distance: int = 3) -> DataFrame:
    """The rows of ``docs``, with all their columns, of which one of each component of near duplicates stays.

    Rows are told apart by doc_id and text, so rows that share a doc_id but not their text are judged each on its own. The row
    with the least doc_id stays; of equal ones that with the least hash of its text, and of rows that are equal in both one, the
    first by its other columns. A null doc_id comes last, and stays if its component has no other. Null and empty texts have the
    fingerprint 0 and are one component with whatever is near it. Column names may be any. An empty table stays empty.
    """
    text = F.coalesce("text", F.lit(""))
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64(text).alias("h"), F.crc32(text.cast("binary")).alias("c"), F.char_length(text).alias("n"))
    prints = cut(fingerprints(docs.select(key.alias("key"), "text"), size, "key"))
    gone = cut(prints.join(_least(prints, "key", distance), "fp").where("key <> least").select("key").distinct())
    again = cut(prints.groupBy("key").count().where("count > 1").select("key"))
    # no text is shuffled but those of rows that go, of equal rows, and of the few others that a filter of their keys lets through
    special = docs.sparkSession.sparkContext.broadcast(filter_of(gone.union(again).select(F.xxhash64("key").alias("h")), ["h"]))

    @F.pandas_udf("boolean")
    def may_be(h: pd.Series) -> pd.Series:
        return pd.Series(special.value.has(h.to_numpy().view(np.uint64)))

    rows = docs.select(F.struct("*").alias("own"), key.alias("key")).withColumn("hit", may_be(F.xxhash64("key")))
    looked_at = rows.where("hit").join(gone, "key", "left_anti")
    # of equal rows one stays; Spark keeps one a task before it shuffles them
    first = Window.partitionBy("key").orderBy(F.to_json("own"))
    one = looked_at.withColumn("place", F.row_number().over(first)).where("place = 1")
    return rows.where("not hit").select("own.*").union(one.select("own.*"))
