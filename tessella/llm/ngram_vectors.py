"""Hashed byte n-gram vectors of whole texts, and the corpus counts that weight them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes, pairs and triples have ranges of their own in a vector, and two places count repeats.
PAIRS, TRIPLES, EXTRA = 1024, 2808, 2
SIZE = 256 + PAIRS + TRIPLES + EXTRA
BLOCK = 1 << 20

_TWO = ((np.arange(1 << 16, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % PAIRS + 256


def _three(code: np.ndarray) -> np.ndarray:
    """The places of triples of bytes, from their 24 bits."""
    mixed = (code.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(30)
    return (mixed.astype(np.uint32) % np.uint32(TRIPLES)).astype(np.int64) + (256 + PAIRS)


def frequencies(raw: bytes) -> np.ndarray:
    """How often each n-gram occurs; the last places count lines and runs of three words that occurred before in the text."""
    out = np.zeros(SIZE, np.int64)
    b = np.frombuffer(raw, np.uint8)
    for at in range(0, len(b), BLOCK):
        x = b[at : at + BLOCK + 2].astype(np.int64)
        n = min(BLOCK, len(b) - at)
        out[:256] += np.bincount(b[at : at + BLOCK], minlength=256)
        two = x[:-1] | (x[1:] << 8)
        out += np.bincount(_TWO[two[:n]], minlength=SIZE)
        out += np.bincount(_three(two[: max(0, len(x) - 2)][:n] | (x[2:][:n] << 16)), minlength=SIZE)
    if len(b) > 64:
        lines, w = raw.split(b"\n"), raw.split()
        out[-1] = 4 * (len(lines) - len(set(lines)))
        out[-2] = max(0, len(w) - 2) - len(set(zip(w, w[1:], w[2:], strict=False)))
    return out


def vectors(texts: list[bytes], idf: np.ndarray | None) -> np.ndarray:
    """Rows of unit length (zero for an empty text): 1 + log of the frequency, times idf."""
    out = np.zeros((len(texts), SIZE), np.float32)
    for k, raw in enumerate(texts):
        out[k] = frequencies(raw)
    np.log1p(out, out=out)
    if idf is not None:
        out *= idf
        out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)
    return out


_LETTERS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def encoded(column: pa.Array, lower: bool) -> list[bytes]:
    """UTF-8 texts; with ``lower`` only their letters, in lower case, runs of anything else in ASCII as one space."""
    if lower:
        return [b" ".join(t.lower().encode().translate(_LETTERS).split()) if t else b"" for t in column.to_pylist()]
    return [t.encode() if t else b"" for t in column.to_pylist()]


def blocks(batch: pa.RecordBatch, text: int, lower: bool, size: int = 256) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for at in range(0, batch.num_rows, size):
        part = batch.slice(at, size)
        yield part, encoded(part.column(text), lower)


def inverse_document_frequency(docs: DataFrame, lower: bool) -> np.ndarray:
    """log((1 + n) / (1 + df)) + 1 over every row of ``docs``; SIZE sums reach the driver, whatever the size of the table."""

    def count(batches):
        df = np.zeros(SIZE + 1, np.int64)
        for batch in batches:
            for _, texts in blocks(batch, 0, lower):
                for raw in texts:
                    df[:-1] += frequencies(raw) > 0
                df[-1] += len(texts)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(SIZE + 1)), pa.array(df)], ["k", "n"])

    df = np.zeros(SIZE + 1)
    for k, n in docs.select("text").mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n")).collect():
        df[k] = n
    return (np.log((1 + df[-1]) / (1 + df[:-1])) + 1).astype(np.float32)


def gathered(docs: DataFrame, value: str, idf: np.ndarray, lower: bool) -> tuple[list, np.ndarray]:
    """A column's values and the vectors of a bounded sample of rows, on the driver, in order of doc_id."""

    def each(batches):
        for batch in batches:
            for part, texts in blocks(batch, 2, lower):
                rows = vectors(texts, idf).astype(np.float16)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([r.tobytes() for r in rows])], ["doc_id", "value", "v"])

    kind = dict(docs.dtypes)[value]
    rows = docs.select("doc_id", value, "text").mapInArrow(each, f"doc_id long, value {kind}, v binary").orderBy("doc_id", "v").collect()
    return [r[1] for r in rows], np.array([np.frombuffer(r[2], np.float16) for r in rows], np.float32).reshape(len(rows), SIZE)


def sampled(rows: DataFrame, n: int, most: int) -> DataFrame:
    """About ``most`` of n rows with different doc_ids, by a hash of doc_id alone; all of them if there are no more. The sample never
    exceeds twice that."""
    return rows if n <= most else rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * most / n)).limit(2 * most)
