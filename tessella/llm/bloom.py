"""Bloom filters of keys that may be any number, in a broadcast of a bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Bits of a filter at most (16 MB). A filter that is too small for its keys lets more others through; it never keeps a key back.
FILTER_BITS = 1 << 27
ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that makes every bit depend on all."""
    h = (h ^ (h >> np.uint64(32))) * ODD
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mixed(a * np.uint64(3) + mixed(b))


class Filter:
    """A Bloom filter of keys."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.mask = np.uint64(len(bits) * 8 - 1)

    @staticmethod
    def places(h: np.ndarray, mask: np.uint64) -> Iterator[np.ndarray]:
        step = mixed(h) | np.uint64(1)
        for k in range(4):
            yield (h + np.uint64(k) * step) & mask

    def has(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        for at in self.places(h, self.mask):
            out &= (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & np.uint8(1)).astype(bool)
        return out


def filter_of(keys: DataFrame, columns: list[str]) -> Filter:
    """A filter of the keys of a table (one column of hashes, or two that are joined). Its bits are set in tasks, by ranges of them, so what
    comes to the driver is the filter itself, of FILTER_BITS at most."""
    bits = 1 << max(13, min(FILTER_BITS.bit_length() - 1, (16 * keys.count()).bit_length()))
    mask, span = np.uint64(bits - 1), 13

    def spread(batches):
        for batch in batches:
            h = [c.to_numpy().view(np.uint64) for c in batch.columns]
            at = np.unique(np.concatenate([*Filter.places(h[0] if len(h) == 1 else joined(*h), mask)]))
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(span)).astype(np.int32)), pa.array((at & np.uint64((1 << span) - 1)).astype(np.int16))], ["range", "bit"])

    def filled(batches):
        now, bits_ = None, np.zeros(1 << span, bool)
        for batch in batches:
            range_, bit = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = np.r_[0, np.flatnonzero(np.diff(range_)) + 1, len(range_)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a < b:
                    if range_[a] != now and now is not None:
                        yield packed(now, bits_)
                        bits_[:] = False
                    now = int(range_[a])
                    bits_[bit[a:b]] = True
        if now is not None:
            yield packed(now, bits_)

    def packed(now, bits_):
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(bits_, bitorder="little").tobytes()])], ["range", "body"])

    set_ = keys.select(*columns).mapInArrow(spread, "range int, bit short").repartition("range").sortWithinPartitions("range").mapInArrow(filled, "range int, body binary")
    out = np.zeros(bits // 8, np.uint8)
    for r in set_.collect():
        out[r[0] << span - 3 : (r[0] + 1) << span - 3] = np.frombuffer(r[1], np.uint8)
    return Filter(out)
