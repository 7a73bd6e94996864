"""Benchmark decontamination: the q-gram lemma in diagonal bands, then banded alignment.

Texts and items are compared as UTF-8 bytes with A-Z lower-cased. An item of m bytes may differ by a budget of
``rate`` * m byte edits, less where the lemma would allow nothing else to be seen: k edits leave at least
m - q + 1 - k q of its q-grams, and the path of an alignment with k edits keeps to k + 1 neighbouring diagonals. Shared
q-grams are counted by item and band of 2 (k + 1) diagonals, bands overlapping by half; bands with enough are aligned, all
those of a stretch of text at once. The whole item must be found: a document that quotes a part of one is no leak.
"""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import ship
from tessella.llm.parsing import words8

Q, RATE = 8, 0.1
#: Bytes of items that are sent to the executors at once; more items are taken in several rounds over the documents. An index takes some
#: 60 times as much, and each Python worker keeps one.
ITEM_BLOCK = 2 << 20
#: Bytes of text that are looked at in one go, shared q-grams that are counted in one go, and cells of alignments in one go.
TEXT_BLOCK, PAIRS, CELLS = 1 << 19, 1 << 21, 1 << 21
#: A q-gram that an item has at more places than this is counted once a text place and band, whatever the number of places.
MOST_PLACES = 8
#: Steps of an alignment after which those that are beyond their budget are given up.
LOOK = 8

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_MIX, _BITS = np.uint64(0x9E3779B97F4A7C15), 22
_FAR = 1 << 28


def budget(m: int, q: int = Q, rate: float = RATE) -> int:
    return max(0, min(int(rate * m), (m - q) // q))


def _joined(parts: list[np.ndarray], gap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes with a gap after each part, where each part begins, and their lengths."""
    size = np.array([len(p) for p in parts], np.int64)
    base = np.cumsum(size + gap) - (size + gap)
    none = np.zeros(gap, np.uint8)
    return np.concatenate([x for p in parts for x in (p, none)]) if parts else none[:0], base, size


def _added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


class Items:
    """The q-grams of the items, to be looked up by many texts."""

    def __init__(self, items: list[tuple], q: int = Q, rate: float = RATE):
        self.q = q
        items = [(i, t) for i, t in items if len(t) >= q]
        self.ids, self.raw = [i for i, _ in items], [t for _, t in items]
        texts = [np.frombuffer(t, np.uint8) for t in self.raw]
        self.data, self.base, self.size = _joined(texts, 8)
        self.edits = np.array([budget(int(m), q, rate) for m in self.size], np.int64)
        self.need = self.size - q + 1 - self.edits * q
        self.longest = int(self.size.max(initial=0) + self.edits.max(initial=0) + q)
        self.mask = np.uint64((1 << (8 * q)) - 1) if q < 8 else np.uint64(0xFFFFFFFFFFFFFFFF)
        n = self.size - q + 1
        item = np.repeat(np.arange(len(n), dtype=np.int32), n)
        place = np.arange(n.sum(), dtype=np.int32) - np.repeat((np.cumsum(n) - n).astype(np.int32), n)
        gram = words8(np.append(self.data, np.zeros(7, np.uint8)))[self.base[item] + place] & self.mask if len(item) else np.empty(0, np.uint64)
        item, place, gram = self._thinned(item, place, gram)
        self.item, self.place = item, place
        first = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]][: len(gram)])  # entries lie in order of their q-grams
        self.gram, self.first, self.count = gram[first], first.astype(np.int32), np.diff(np.r_[first, len(gram)]).astype(np.int32)
        self.seen = np.zeros(1 << _BITS, bool)
        self.seen[self._slot(self.gram)] = True

    def _thinned(self, item: np.ndarray, place: np.ndarray, gram: np.ndarray):
        """Entries in order of their q-grams. Where an item has one at many places, a text place p lies in cells p // stride - c for
        few different c: those stand for the places, as multiples of the stride."""
        order = np.lexsort((item, gram))
        item, place, gram = item[order], place[order], gram[order]
        first = np.flatnonzero(np.r_[True, (gram[1:] != gram[:-1]) | (item[1:] != item[:-1])][: len(gram)])
        n = np.diff(np.r_[first, len(gram)])
        many = np.repeat(n > MOST_PLACES, n)
        stride = self.edits[item[many]] + 1
        block = place[many] // stride
        rows = np.stack([np.r_[gram[many], gram[many]], np.r_[item[many], item[many]].astype(np.uint64), np.r_[block, block + 1].astype(np.uint64)])
        rows = np.unique(rows, axis=1)
        item = np.r_[item[~many], rows[1].astype(np.int32)]
        place = np.r_[place[~many], (rows[2].astype(np.int64) * (self.edits[rows[1].astype(np.int64)] + 1)).astype(np.int32)]
        gram = np.r_[gram[~many], rows[0]]
        order = np.argsort(gram, kind="stable")
        return item[order], place[order], gram[order]

    @staticmethod
    def _slot(gram: np.ndarray) -> np.ndarray:
        return (gram * _MIX) >> np.uint64(64 - _BITS)

    def _shared(self, data: np.ndarray, base: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The q-grams of texts that items have: text number, place, and which q-gram."""
        gram = words8(data) & self.mask
        at = np.flatnonzero(self.seen[self._slot(gram)])
        k = np.searchsorted(self.gram, gram[at])
        k[k == len(self.gram)] = 0
        real = self.gram[k] == gram[at]
        at, k = at[real], k[real]
        text = np.searchsorted(base, at, "right") - 1
        at = at - base[text]
        inside = at + self.q <= size[text]
        return text[inside], at[inside], k[inside]

    def find(self, texts: list[bytes]) -> dict[tuple[int, int], int]:
        """(text number, item number) to least edits, of every item that some part of a text matches within its budget."""
        if not self.ids or not texts:
            return {}
        data, base, size = _joined([np.frombuffer(t, np.uint8) for t in texts], 8)
        text, at, k = self._shared(data, base, size)
        n = self.count[k].astype(np.int64)
        total = np.cumsum(n)
        if len(n) and total[-1] > 4 * PAIRS and (len(texts) > 1 or size[0] > 4 * self.longest):
            return self._halves(texts)
        keys, hits, edges = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [0]
        while edges[-1] < len(n):
            a = edges[-1]
            edges.append(max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + PAIRS, "right"))))
            own = slice(a, edges[-1])
            entry = np.repeat(self.first[k[own]] - (total[own] - n[own]), n[own]) + np.arange(total[a] - n[a], total[edges[-1] - 1])
            item = self.item[entry]
            cell = (np.repeat(at[own], n[own]) - self.place[entry]) // (self.edits[item] + 1) + (1 << 27)
            key, hit = np.unique(((np.repeat(text[own], n[own]) * len(self.ids) + item) << 28) | cell, return_counts=True)
            keys.append(key)
            hits.append(hit)
            if sum(map(len, keys)) > PAIRS:
                key, hit = _added(np.concatenate(keys), np.concatenate(hits))
                keys, hits = [key], [hit]
        return self._verified(texts, data, base, size, *_added(np.concatenate(keys), np.concatenate(hits)))

    def _halves(self, texts: list[bytes]) -> dict[tuple[int, int], int]:
        """The same in two parts: half of the texts each, or overlapping halves of a text, where too many q-grams are shared."""
        if len(texts) > 1:
            half = len(texts) // 2
            return self.find(texts[:half]) | {(t + half, i): e for (t, i), e in self.find(texts[half:]).items()}
        half = len(texts[0]) // 2
        found = self.find([texts[0][: half + self.longest]])
        for own, e in self.find([texts[0][half:]]).items():
            found[own] = min(e, found.get(own, e))
        return found

    def _verified(self, texts, data, base, size, key, hits) -> dict[tuple[int, int], int]:
        """Bands with enough shared q-grams, confirmed: first by a plain search around the band, then by alignment."""
        both = hits.copy()
        both[:-1] += np.where(key[1:] == key[:-1] + 1, hits[1:], 0)
        need = self.need[(key >> 28) % len(self.ids)]
        starts = np.unique(np.concatenate([key[both >= need], key[hits >= need] - 1]))
        text, item = np.divmod(starts >> 28, len(self.ids))
        low = ((starts & ((1 << 28) - 1)) - (1 << 27)) * (self.edits[item] + 1)
        best: dict[tuple[int, int], int] = {}
        left = np.ones(len(starts), bool)
        for j, (t, i, d) in enumerate(zip(text.tolist(), item.tolist(), low.tolist(), strict=True)):
            if (t, i) in best or texts[t].find(self.raw[i], max(0, d), d + 2 * int(self.edits[i] + 1) + len(self.raw[i])) >= 0:
                best[t, i], left[j] = 0, False
        at = np.flatnonzero(left)
        at = at[[(t, i) not in best for t, i in zip(text[at].tolist(), item[at].tolist(), strict=True)]] if len(at) else at
        at = at[np.argsort(-self.size[item[at]], kind="stable")]
        while len(at):
            span = int(self.size[item[at[0]]] + 2 * (self.edits[item[at]].max() + 1))
            now, at = np.split(at, [max(1, CELLS // span)])
            for j, e in zip(now, self._aligned(data, base[text[now]], size[text[now]], item[now], low[now]), strict=True):
                if e <= self.edits[item[j]]:
                    own = int(text[j]), int(item[j])
                    best[own] = min(int(e), best.get(own, int(e)))
        return best

    def _aligned(self, data, base, length, item, low) -> np.ndarray:
        """For each band (item by item, the longest first): the least edits between its item and any part of its text, with the path
        near its diagonals; far more for those that are given up."""
        m, edits = self.size[item], self.edits[item]
        width, longest = 2 * int(edits.max() + 1), int(m[0])
        steps = np.arange(width)
        there = low[:, None] + np.arange(longest + width)
        around = np.where((there >= 0) & (there < length[:, None]), data[np.clip(base[:, None] + there, 0, len(data) - 1)], 256).astype(np.int16)
        wanted = self.data[np.minimum(self.base[item][:, None] + np.arange(longest), len(self.data) - 1)].astype(np.int16)
        # a path may not start or end outside the text
        row = np.where((there[:, :width] < 0) | (there[:, :width] > length[:, None]), _FAR, 0).astype(np.int32)
        out, own = np.full(len(item), _FAR), np.arange(len(item))
        for k in range(longest):
            cost = row + (around[:, k : k + width] != wanted[:, k : k + 1])
            np.minimum(cost[:, :-1], row[:, 1:] + 1, out=cost[:, :-1])
            cost -= steps
            row = np.minimum.accumulate(cost, axis=1) + steps
            ended = int(np.searchsorted(-m, -(k + 1), "left"))  # those from here on have k + 1 bytes
            if ended < len(m):
                ends = low[ended:, None] + steps + (k + 1)
                out[own[ended:]] = np.where((ends >= 0) & (ends <= length[ended:, None]), row[ended:], _FAR).min(1)
            if ended < len(m) or k % LOOK == LOOK - 1:
                stay = np.flatnonzero(row[:ended].min(1, initial=_FAR) <= edits[:ended])
                if not len(stay):
                    break
                if len(stay) < len(row):
                    m, edits, low, length, own, row, around, wanted = (x[stay] for x in (m, edits, low, length, own, row, around, wanted))
        return out


class Matcher:
    """The items by the length of q-gram that suits them: short ones (under ten times q) are found by half of q."""

    def __init__(self, items: list[tuple], q: int = Q, rate: float = RATE):
        items = [(i, (t or "").encode().translate(_LOWER)) for i, t in items]
        short = max(1, q // 2)
        parts = [([x for x in items if len(x[1]) >= 10 * q], q), ([x for x in items if len(x[1]) < 10 * q], short)]
        self.parts = [Items(own, size, rate) for own, size in parts if any(len(t) >= size for _, t in own)]
        self.longest = max((p.longest for p in self.parts), default=0)

    def find_all(self, texts: list[str | None]) -> list[tuple[int, object, int]]:
        """(text number, item id, least edits) for texts of any number and length: short ones together, long ones in pieces that
        overlap by an item."""
        best: dict[tuple[int, int, int], int] = {}
        pieces: list[tuple[int, bytes]] = []
        size = 0

        def flush() -> None:
            nonlocal size
            for p, items in enumerate(self.parts):
                for (t, i), e in items.find([d for _, d in pieces]).items():
                    own = (pieces[t][0], p, i)
                    best[own] = min(e, best.get(own, e))
            pieces.clear()
            size = 0

        for k, text in enumerate(texts):
            data = (text or "").encode().translate(_LOWER)
            for a in range(0, max(1, len(data)), TEXT_BLOCK):
                piece = data[a : a + TEXT_BLOCK + self.longest]
                if size + len(piece) > TEXT_BLOCK:
                    flush()
                pieces.append((k, piece))
                size += len(piece)
        flush()
        return [(t, self.parts[p].ids[i], e) for (t, p, i), e in sorted(best.items())]


_KEPT: dict[str, Matcher] = {}


def _matcher(name: str, items: list[tuple], q: int, rate: float) -> Matcher:
    """The index of a block of items; a worker keeps that of the block it has searched last, for its next tasks."""
    if name not in _KEPT:
        _KEPT.clear()
        _KEPT[name] = Matcher(items, q, rate)
    return _KEPT[name]


def _blocks(benchmark: DataFrame) -> list[DataFrame]:
    """The items in parts of about ITEM_BLOCK bytes, by a hash of their ids."""
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = size // ITEM_BLOCK + 1
    if n == 1:
        return [benchmark]
    return [benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) for k in range(n)]


def leaks(docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = RATE) -> DataFrame:
    """(doc_id, item_id, edits): the items that a part of a document matches within their budget, with the least edits.

    One row for each row of ``docs`` and item, so repeated rows and items are found as often as they occur. Null and empty texts
    match nothing; nor do items of fewer than q / 2 bytes, a word of which would be no evidence. Ids are whole numbers of up to 64 bits; null ones are kept. Other columns
    are not read, whatever their names. An empty table gives no rows. Items go to the executors in blocks of bounded size, each
    against all rows; texts of any length are searched in pieces.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select("doc_id", "text")
    found = []
    for block in _blocks(benchmark):
        held = spark.sparkContext.broadcast([tuple(r) for r in block.select("item_id", "text").collect()])

        def search(batches, held=held, name=uuid.uuid4().hex):
            items = _matcher(name, held.value, q, rate)
            for batch in batches:
                ids = batch.column(0).to_pylist()
                hits = items.find_all(batch.column(1).to_pylist())
                columns = ([ids[t] for t, _, _ in hits], [i for _, i, _ in hits], [e for _, _, e in hits])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32()), strict=True)], ["doc_id", "item_id", "edits"])

        found.append(rows.mapInArrow(search, "doc_id long, item_id long, edits int"))
    return reduce(DataFrame.union, found)


def without_leaks(docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = RATE) -> DataFrame:
    """The rows of ``docs`` in which no item is found (see ``leaks``), with all their columns, whatever their names.

    Rows are judged one by one: repeated rows stay or go together, and rows with a null id or an empty or null text stay as
    they are. An empty table, or an empty benchmark, changes nothing.
    """
    spark = docs.sparkSession
    ship(spark)
    for block in _blocks(benchmark):
        held = spark.sparkContext.broadcast([tuple(r) for r in block.select("item_id", "text").collect()])
        place = docs.columns.index("text")

        def clean(batches, held=held, place=place, name=uuid.uuid4().hex):
            items = _matcher(name, held.value, q, rate)
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[t for t, _, _ in items.find_all(batch.column(place).to_pylist())]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
