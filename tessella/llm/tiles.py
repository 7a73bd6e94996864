"""Searches of a stated set of queries against all rows of a table of vectors, in blocks.

The rows lie in tiles of a bounded size. Every query goes to the tiles that it is to meet, where it comes after the rows, so a task holds
one tile and lets queries pass by; what a tile has found for a query is a short list, and the lists of a query are merged in a stream.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS, QUERIES = 0, 1
BLOCK = "tile int, kind int, body binary"


def one_a_name(rows: DataFrame, name: str, *rest: str) -> DataFrame:
    """Of the rows that share a name the least by the other columns; rows with a null name go."""
    least = rows.where(F.col(name).isNotNull()).groupBy(name).agg(F.min(F.struct(*rest)).alias("least"))
    return least.select(name, "least.*")


def finite(vector: str) -> F.Column:
    """Whether a column of vectors has one whose components are all there and finite."""
    x = F.col(vector).cast("array<double>")
    return x.isNotNull() & F.coalesce(F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """The vectors of a list column as rows of doubles, with zeros where they are short."""
    flat, lengths = column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False)
    if (lengths == width).all():
        return flat.reshape(len(column), width)
    out = np.zeros((len(column), width))
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def blocks(batches: Iterator[pa.RecordBatch], kind: int, most: int, made: Callable) -> Iterator[pa.RecordBatch]:
    """Rows of up to ``most`` input rows each, with what ``made`` makes of a batch of them; their numbers (as tile) count up in a task."""
    number = 0
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            yield row(number, kind, made(batch.slice(at, most)))
            number += 1


def row(tile: int, kind: int, body: object) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([tile], pa.int32()), pa.array([kind], pa.int32()), pa.array([pickle.dumps(body, 5)], pa.binary())], ["tile", "kind", "body"])


def meeting(rows: DataFrame, queries: DataFrame, tiles: int, meet: Callable, schema: str, hold: Callable = list) -> DataFrame:
    """``meet(rows, query block)`` for every block of queries and every tile, with ``hold`` of the tile's blocks of rows; both tables have the
    columns of BLOCK. A tile is one partition, in which the rows come first."""

    def each(batches):
        tile, held, ready = None, [], None
        for batch in batches:
            for t, kind, body in zip(*(batch.column(c).to_pylist() for c in ("tile", "kind", "body")), strict=True):
                if t != tile:
                    tile, held, ready = t, [], None
                if kind == ROWS:
                    held.append(pickle.loads(body))
                elif held or ready:
                    if ready is None:
                        ready, held = hold(held), []
                    yield from meet(ready, pickle.loads(body))

    both = rows.select("tile", "kind", "body").unionByName(queries.select("tile", "kind", "body"))
    return both.repartitionById(tiles, "tile").sortWithinPartitions("tile", "kind").mapInArrow(each, schema)


def _ranks(score: np.ndarray) -> np.ndarray:
    return np.unique(score, return_inverse=True)[1] if score.dtype == object else score


def best_first(row: np.ndarray, score: np.ndarray, name: np.ndarray, most: int) -> np.ndarray:
    """Places of the ``most`` highest scores of each row, ties to the smaller name, each name once; in order of row and rank."""
    order = np.lexsort((name, -_ranks(score), row))
    r, n = row[order], name[order]
    again = np.zeros(len(r), bool)
    again[1:] = (r[1:] == r[:-1]) & (n[1:] == n[:-1])  # a name has one score in a row, so its repeats lie side by side
    order, r = order[~again], r[~again]
    first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]]) if len(r) else np.zeros(0, int)
    rank = np.arange(len(r)) - np.repeat(first, np.diff(np.r_[first, len(r)]))
    return order[rank < most]


class Best:
    """The highest scores so far of a number of rows."""

    def __init__(self, rows: int, most: int):
        self.most = most
        self.row, self.score, self.name = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.least: np.ndarray | None = None
        self.full = np.zeros(rows, bool)

    def add(self, score: np.ndarray, usable: np.ndarray | bool, names: np.ndarray, rows: np.ndarray | None = None) -> None:
        """Scores of rows (down; all of them, or those given) with some names (across)."""
        rows = np.arange(len(self.full)) if rows is None else rows
        if self.least is not None:
            usable = usable & (~self.full[rows, None] | (score >= self.least[rows, None]))
        elif usable is True and score.shape[1] > 4 * self.most:
            usable = score >= np.partition(score, -self.most, axis=1)[:, -self.most, None]
        row, at = np.nonzero(np.broadcast_to(usable, score.shape))
        if not len(row):
            return
        self.row = np.concatenate([self.row, rows[row]])
        self.score = np.concatenate([self.score, score[row, at]]) if len(self.score) else score[row, at]
        self.name = np.concatenate([self.name, names[at]])
        keep = best_first(self.row, self.score, self.name, self.most)
        self.row, self.score, self.name = self.row[keep], self.score[keep], self.name[keep]
        last = np.flatnonzero(np.r_[self.row[1:] != self.row[:-1], True])
        if self.least is None:
            self.least = np.zeros(len(self.full), self.score.dtype)
        self.least[self.row[last]] = self.score[last]
        self.full = np.bincount(self.row, minlength=len(self.full)) == self.most

    def found(self) -> tuple[np.ndarray, pa.Array, pa.Array]:
        """Rows that have anything, their names and their scores, best first."""
        rows, n = np.unique(self.row, return_counts=True)
        ends = np.r_[0, np.cumsum(n)].astype(np.int32)
        return rows, pa.ListArray.from_arrays(ends, pa.array(self.name)), pa.ListArray.from_arrays(ends, pa.array(self.score.tolist() if self.score.dtype == object else self.score))


def merged(found: DataFrame, keys: list[str], most: int) -> DataFrame:
    """Lists (names, scores) of the same keys (longs) merged into the best ``most``. Rows pass in order of their keys; no more is held than
    one batch and the best of the key before."""
    kinds = dict(found.dtypes)

    def each(batches):
        held = None
        for batch in batches:
            names = batch.column(len(keys))
            n = names.value_lengths().to_numpy(zero_copy_only=False)
            own = [np.repeat(batch.column(k).to_numpy(zero_copy_only=False), n) for k in range(len(keys))]
            rows = [*own, names.flatten().to_numpy(zero_copy_only=False), batch.column(len(keys) + 1).flatten().to_numpy(zero_copy_only=False)]
            rows = [np.concatenate(x) for x in zip(held, rows, strict=True)] if held else rows
            if not len(rows[0]):
                continue
            group = np.cumsum(np.r_[False, np.logical_or.reduce([k[1:] != k[:-1] for k in rows[: len(keys)]])])
            keep = best_first(group, rows[-1], rows[-2], most)
            rows, group = [x[keep] for x in rows], group[keep]
            last = group == group[-1]
            held = [x[last] for x in rows]
            yield lists([x[~last] for x in rows], group[~last], len(keys))
        if held:
            yield lists(held, np.zeros(len(held[0]), int), len(keys))

    dealt = found.select(*keys, "names", "scores").repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(each, ", ".join([*(f"{k} long" for k in keys), "names array<long>", f"scores {kinds['scores']}"]))


def lists(rows: list[np.ndarray], group: np.ndarray, keys: int) -> pa.RecordBatch:
    """One row a group: its keys, and the lists of its names and scores."""
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, int)
    ends = np.r_[first, len(group)].astype(np.int32)
    columns = [pa.array(x[first]) for x in rows[:keys]] + [pa.ListArray.from_arrays(ends, pa.array(x)) for x in rows[keys:]]
    return pa.RecordBatch.from_arrays(columns, [*(f"k{i}" for i in range(keys)), "names", "scores"])
