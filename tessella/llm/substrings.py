"""Removal of byte strings that an earlier document has already, by a prefix-free parse and sorted phrase suffixes.

1. Every text is parsed (``parsing``): rolling-hash triggers cut it into overlapping phrases. Equal windows of ``span`` bytes
   choose the same trigger, so they lie at the same place in phrases of the same trigger.
2. The parse: phrases meet by their trigger. Of equal phrases, all but those of the least document are removed whole; this
   settles long repeats without looking at bytes. Equal phrases of one batch have been merged before the shuffle, so a
   passage that very many documents share sends one phrase a batch.
3. The dictionary: where one trigger has several phrases (at the ends of a repeat), the least document's phrase of each kind
   is fetched from its text, and the suffixes of these phrases are sorted by their first ``span`` bytes (a suffix array to
   that depth). Neighbours that are equal are the windows that different phrases share.
4. The spans of both steps are joined to the texts.
"""

from __future__ import annotations

import hashlib
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tessella.llm.common import cut, ship, shuffle_width
from tessella.llm.parsing import mixed, parse

#: Phrases that one task of step 2 gathers, about; bytes of text in one partition of steps 3 and 4, and in one go of step 1.
PHRASES_A_TASK, BYTES_A_TASK, BYTES_AT_A_TIME = 400_000, 48 << 20, 4 << 20
#: Different phrases of one trigger that one task sorts; more are divided into windows.
MOST_KINDS = 8_000
#: Windows of divided phrases that are held at a time, about, and phrases of whole triggers that are sorted together, unless one has more.
WINDOWS_AT_A_TIME, SORTED_TOGETHER = 200_000, 5_000

_FLAT = "kind int, rid long, k long, s int, n int"


def _flat(kind: int, rid, k, s, n) -> pa.RecordBatch:
    columns = [np.full(len(rid), kind, np.int32), rid, k, s.astype(np.int32), n.astype(np.int32)]
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], ["kind", "rid", "k", "s", "n"])


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of half-open spans, as spans that neither overlap nor touch."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.r_[True, start[1:] > end[:-1]]
    return start[new], end[np.r_[np.flatnonzero(new)[1:] - 1, len(end) - 1]]


def _heads(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys begins."""
    new = np.zeros(len(keys[0]), bool)
    if len(new):
        new[0] = True
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
    return new


def _ranges(keys: np.ndarray) -> list[tuple[int, int]]:
    """The runs of equal keys."""
    edges = [*np.flatnonzero(_heads(keys)).tolist(), len(keys)]
    return list(pairwise(edges))


def _least(new: np.ndarray, value: np.ndarray) -> np.ndarray:
    """For each row the least value of its run."""
    return np.minimum.reduceat(value, np.flatnonzero(new))[np.cumsum(new) - 1] if len(value) else value


def _packed(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of each number, all first bytes first: what neighbours share then compresses well."""
    return np.ascontiguousarray(values.astype("<i8" if values.dtype.kind == "i" else "<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _unpacked(column: pa.Array, width: int) -> np.ndarray:
    parts = []
    for raw in column.to_pylist():
        out = np.zeros((len(raw) // width, 8), np.uint8)
        out[:, :width] = np.frombuffer(raw, np.uint8).reshape(width, -1).T
        parts.append(out.view("<i8").ravel())
    return np.concatenate(parts) if parts else np.empty(0, np.int64)


_PHRASES = ["k", "rid", "doc", "s", "n", "phrase"]


def _windows(phrases: list[bytes], n: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of phrases with n windows each: bytes, phrase and place in it."""
    data = np.frombuffer(b"".join(phrases), np.uint8)
    n = n.astype(np.int64)
    base = np.cumsum(n + span - 1) - (n + span - 1)
    row = np.repeat(np.arange(len(n)), n)
    within = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    found = np.lib.stride_tricks.sliding_window_view(data, span)[base[row] + within]
    return np.ascontiguousarray(found).view(f"S{span}").ravel(), row, within


def _runs(rid: np.ndarray, row: np.ndarray, at: np.ndarray, span: int) -> list[pa.Array]:
    """Windows that go, by phrase and place in the text, as spans: rid, start, length."""
    order = np.lexsort((at, row))
    row, at = row[order], at[order]
    new = _heads(row) | np.r_[True, at[1:] != at[:-1] + 1][: len(at)]
    first = np.flatnonzero(new)
    length = np.diff(np.r_[first, len(at)]) + span - 1
    return [pa.array(rid[row[first]]), pa.array(at[first].astype(np.int32)), pa.array(length.astype(np.int32))]


def _divided(rid, doc, s, n, phrases: list[bytes], span: int):
    """Phrases as windows that are keyed by their bytes; a window that a smaller document has here too is a span that goes, without bytes."""
    text, row, within = _windows(phrases, n, span)
    order = np.argsort(text, kind="stable")
    text, row, within = text[order], row[order], within[order]
    new = _heads(text)
    later = doc[row] > _least(new, doc[row])
    gone = row[later]
    arrays = _runs(rid, gone, s[gone] + within[later], span)
    none = len(arrays[0])
    yield pa.RecordBatch.from_arrays([arrays[0], arrays[0], pa.array(np.zeros(none, np.int64)), *arrays[1:], pa.nulls(none, pa.binary())], _PHRASES)
    text, row, at = text[~later], row[~later], (s[row] + within)[~later]
    wide = -(-span // 8) * 8
    columns = np.zeros((len(text), wide), np.uint8)
    columns[:, :span] = text.view(np.uint8).reshape(-1, span)
    key = np.zeros(len(text), np.uint64)
    for column in columns.view("<u8").T:
        key = (key ^ column) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    raw = columns[:, :span].tobytes()
    yield pa.RecordBatch.from_arrays(
        [pa.array(key.view(np.int64)), pa.array(rid[row]), pa.array(doc[row]), pa.array(at.astype(np.int32)), pa.array(np.ones(len(row), np.int32)), pa.array([raw[i : i + span] for i in range(0, len(raw), span)], pa.binary())], _PHRASES
    )


#: Bytes kept of each column of a parsed phrase: trigger, phrase, row of the batch, place, windows; and of a row: doc_id, key.
#: Triggers that agree in their kept bytes by chance are told apart by their texts later.
_WIDTH = {"k": 6, "c": 5, "i": 4, "s": 4, "n": 1, "d": 8, "r": 8}


def _portions(batches, text: int, most: int = BYTES_AT_A_TIME):
    """Batches in slices of about so many bytes of text, so that the arrays of a slice stay small; a row is never divided."""
    for batch in batches:
        total = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
            yield batch.slice(at, end - at)
            at = end
            pa.default_memory_pool().release_unused()


def repeated_spans(docs: DataFrame, span: int) -> tuple[DataFrame, DataFrame]:
    """``docs`` with a key rid, dealt out by it, and (rid, spans): the (s, n) with n bytes from s that are to go, some overlapping."""
    spark = docs.sparkSession
    ship(spark)
    # doc_id is the key of a row, unless two rows share one or a row has none: then rows are numbered, and written, so that the numbers
    # stay. The key is never null, so that both joins below deal the texts out in the same way and Spark does it once
    alone = docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty()
    rows = docs.withColumn("rid", F.coalesce("doc_id", F.lit(0))) if alone else cut(docs.withColumn("rid", F.monotonically_increasing_id()))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(shuffle_width(spark), size // 15 // PHRASES_A_TASK)
    texts = rows.repartition(max(shuffle_width(spark), size // BYTES_A_TASK), "rid")
    payload = list(_WIDTH)
    whole = pa.schema([("kind", pa.int32()), ("b", pa.int32()), *((c, pa.binary()) for c in payload)])

    def parsed(batches):
        for batch in _portions(batches, 2):
            ids = batch.column(1).to_numpy(zero_copy_only=False)
            order = np.argsort(ids, kind="stable")
            rids, ids = batch.column(0).to_numpy(zero_copy_only=False)[order], ids[order]
            raw = batch.column(2).cast(pa.binary()).to_pylist()
            p = parse([raw[k] or b"" for k in order], span)
            both = mixed(p.trigger.copy(), p.phrase)
            by = np.argsort(both, kind="stable")
            doc = ids[p.text[by]]
            # equal phrases of the batch: 128 bits of hashes are equal, those of trigger and text together and those of the text
            later = doc > _least(_heads(both[by], p.phrase[by]), doc)
            out = by[later]
            row, s, n = p.text[out], p.start[out], p.count[out]
            at = np.lexsort((s, row))
            row, s, e = row[at], s[at], (s + n)[at] + span - 1
            new = _heads(row) | (s > np.r_[0, e[:-1]])
            last = np.r_[np.flatnonzero(new)[1:] - 1, len(s) - 1] if len(s) else np.empty(0, int)
            arrays = [[], [], *([] for _ in payload)]

            def put(kind, b, arrays=arrays, **values):
                arrays[0].append(kind)
                arrays[1].append(b)
                for a, c in zip(arrays[2:], payload, strict=True):
                    a.append(_packed(values[c], _WIDTH[c]) if c in values else b"")

            if len(s):  # spans: i has their lengths
                put(1, int(rids[0] % buckets), s=s[new], i=e[last] - s[new], r=rids[row[new]])
            left = by[~later]
            bucket = (p.trigger[left] >> np.uint64(20)) % np.uint64(buckets)
            at = np.argsort(bucket, kind="stable")
            left, bucket = left[at], bucket[at]
            for a, z in _ranges(bucket):
                own = left[a:z]
                used, index = np.unique(p.text[own], return_inverse=True)
                more = {} if alone else {"r": rids[used]}
                put(0, int(bucket[a]), k=p.trigger[own], c=p.phrase[own], i=index, s=p.start[own], n=p.count[own], d=ids[used], **more)
            yield pa.RecordBatch.from_arrays([pa.array(a, f.type) for a, f in zip(arrays, whole, strict=True)], schema=whole)

    def settled(part: pa.Table):
        """Step 2 of one bucket."""
        k, c, row, s, n, ids = (_unpacked(part.column(x), _WIDTH[x]) for x in ("k", "c", "i", "s", "n", "d"))
        sizes = np.array([len(x) // 8 for x in part.column("d").to_pylist()])
        counts = np.array([len(x) for x in part.column("n").to_pylist()])
        row = row + np.repeat(np.cumsum(sizes) - sizes, counts)
        rids = ids if alone else _unpacked(part.column("r"), 8)
        order = np.lexsort((c, k))
        k, c, row, s, n = k[order], c[order], row[order], s[order], n[order]
        doc = ids[row]
        kinds, triggers = _heads(k, c), _heads(k)
        later = doc > _least(kinds, doc)
        held = np.add.reduceat(kinds.astype(np.int64), np.flatnonzero(triggers))[np.cumsum(triggers) - 1] if len(k) else np.zeros(0, np.int64)
        ask, wide = (held > 1) & ~later, held > MOST_KINDS
        yield _flat(1, rids[row[later]], np.zeros(int(later.sum()), np.int64), s[later], n[later] + span - 1)
        for kind, own in ((2, ask & ~wide), (3, ask & wide)):
            yield _flat(kind, rids[row[own]], k[own], s[own], n[own])

    def matched(batches):
        waiting: list[pa.RecordBatch] = []

        def done():
            if waiting:
                yield from settled(pa.Table.from_batches(waiting).combine_chunks())
                waiting.clear()

        own = None
        for batch in batches:
            spans = batch.filter(pa.compute.equal(batch.column("kind"), 1))
            if spans.num_rows:
                rid, s, n = (_unpacked(spans.column(c), _WIDTH[c]) for c in ("r", "s", "i"))
                yield _flat(1, rid, np.zeros(len(rid), np.int64), s, n)
            rest = batch.filter(pa.compute.equal(batch.column("kind"), 0))
            b = rest.column("b").to_numpy(zero_copy_only=False)
            for a, z in _ranges(b):
                if own != b[a]:
                    yield from done()
                    own = b[a]
                waiting.append(rest.slice(a, z - a))
        yield from done()

    first = rows.where("doc_id is not null").select("rid", "doc_id", "text").mapInArrow(parsed, "kind int, b int, " + ", ".join(f"{c} binary" for c in payload))
    flat = cut(first.repartitionById(buckets, "b").sortWithinPartitions("b").mapInArrow(matched, _FLAT))

    asked = flat.where("kind > 1").groupBy("rid").agg(F.collect_list(F.struct("k", "s", "n", "kind")).alias("ask"))

    def fetched(batches):
        for batch in _portions(batches, batches_text):
            asks = batch.column("ask")
            flatten = asks.flatten()
            counts = asks.value_lengths().to_numpy(zero_copy_only=False)
            k, s, n, kind = (flatten.field(c).to_numpy(zero_copy_only=False) for c in ("k", "s", "n", "kind"))
            rid, doc = (np.repeat(batch.column(c).to_numpy(zero_copy_only=False), counts) for c in ("rid", "doc_id"))
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            row = np.repeat(np.arange(len(texts)), counts)
            phrase = lambda own, row=row, s=s, n=n, texts=texts: [texts[r][a : a + m + span - 1] for r, a, m in zip(row[own].tolist(), s[own].tolist(), n[own].tolist(), strict=True)]
            own = np.flatnonzero(kind == 2)
            yield pa.RecordBatch.from_arrays([pa.array(x[own]) for x in (k, rid, doc, s, n)] + [pa.array(phrase(own), pa.binary())], _PHRASES)
            own = np.flatnonzero(kind == 3)
            total = np.cumsum(n[own], dtype=np.int64)
            for part in np.split(own, np.searchsorted(total, np.arange(WINDOWS_AT_A_TIME, total[-1], WINDOWS_AT_A_TIME))) if len(own) else []:
                if len(part):
                    yield from _divided(rid[part], doc[part], s[part], n[part], phrase(part), span)

    def windows(part: pa.Table):
        """Step 3 of whole triggers: the suffixes of their phrases, in order of trigger and first bytes."""
        k, rid, doc, s, n = (part.column(c).to_numpy() for c in ("k", "rid", "doc", "s", "n"))
        text, row, within = _windows(part.column("phrase").to_pylist(), n, span)
        order = np.argsort(text, kind="stable")
        text, row, within = text[order], row[order], within[order]
        later = doc[row] > _least(_heads(text), doc[row])
        row = row[later]
        return pa.RecordBatch.from_arrays(_runs(rid, row, s[row] + within[later], span), ["rid", "s", "n"])

    def sorted_(batches):
        held = None
        for batch in batches:
            gone = pa.compute.is_null(batch.column("phrase"))
            yield batch.filter(gone).select(["rid", "s", "n"])
            batch = batch.filter(pa.compute.invert(gone))
            if not batch.num_rows:
                continue
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            keys = held.column("k").to_numpy()
            end = int(np.searchsorted(keys, keys[-1]))  # the last trigger may go on
            if end > SORTED_TOGETHER:
                for a, z in _pieces(keys[:end], SORTED_TOGETHER):
                    yield windows(held.slice(a, z - a))
                held = held.slice(end)
        if held is not None and held.num_rows:
            for a, z in _pieces(held.column("k").to_numpy(), SORTED_TOGETHER):
                yield windows(held.slice(a, z - a))

    # all columns, here and where the spans are applied: then both joins read one and the same shuffle of the texts
    joined = texts.join(asked, "rid")
    batches_text = joined.columns.index("text")
    second = joined.mapInArrow(fetched, "k long, rid long, doc long, s int, n int, phrase binary")
    ends = second.repartition(buckets, "k").sortWithinPartitions("k").mapInArrow(sorted_, "rid long, s int, n int")
    spans = flat.where("kind = 1").select("rid", "s", "n").union(ends)
    return texts, spans.groupBy("rid").agg(F.collect_list(F.struct("s", "n")).alias("spans"))


def _pieces(keys: np.ndarray, most: int):
    """Ranges of about so many rows that do not divide a key."""
    at = 0
    while at < len(keys):
        end = min(len(keys), at + most)
        if end < len(keys):
            end = int(np.searchsorted(keys, keys[end - 1], "right"))
        yield at, end
        at = end


def _kept(texts: pa.Array, spans: pa.Array):
    """For each text (null: None): its bytes, the parts that stay, and the starts and ends of what goes."""
    flat = spans.flatten()
    s, n = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("s", "n"))
    ends = np.cumsum(pa.compute.fill_null(pa.compute.list_value_length(spans), 0).to_numpy(zero_copy_only=False))
    at = 0
    for text, end in zip(texts, ends.tolist(), strict=True):
        raw = None if not text.is_valid else text.as_py().encode()
        start, stop = merged(s[at:end], s[at:end] + n[at:end])
        edges = [0, *np.stack([start, stop], 1).ravel().tolist(), len(raw or b"")]
        yield raw, [(raw or b"")[edges[k] : edges[k + 1]] for k in range(0, len(edges), 2)], start, stop
        at = end


def removed_bytes(docs: DataFrame, span: int = 50) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each row of ``docs``.

    A byte goes if a string of ``span`` bytes that covers it starts in a document with a smaller doc_id too. Null texts are
    empty. Rows that share a doc_id never remove each other's bytes; a row without doc_id stays whole and removes nothing.
    doc_id is a whole number of up to 64 bits. Other columns are not read. An empty table gives no rows.
    """

    def digest(batches):
        for batch in batches:
            out = []
            for raw, parts, start, end in _kept(batch.column(1), batch.column(2)):
                sha = hashlib.sha256()
                for p in parts:
                    sha.update(p)
                out.append((len(raw or b""), int((end - start).sum()), len(start), sha.hexdigest()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string())))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    texts, spans = repeated_spans(docs.select("doc_id", "text"), span)
    return texts.join(spans, "rid", "left").select("doc_id", "text", "spans").mapInArrow(digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, span: int = 50) -> DataFrame:
    """``docs`` with the bytes that ``removed_bytes`` counts out of text, and n_chars (if there is one) to match; bytes left of a character
    that was cut are dropped.

    One row a row of ``docs``, with all its columns, whatever their names. Null texts stay null, empty ones empty; a row without doc_id
    stays whole and removes nothing, and rows that share a doc_id leave each other alone. An empty table stays empty.
    """
    cast = {f.name: f.dataType for f in docs.schema.fields}

    def keep(batches):
        for batch in batches:
            texts = []
            for raw, parts, _, _ in _kept(batch.column(1), batch.column(2)):
                texts.append(None if raw is None else b"".join(parts).decode("utf-8", "ignore"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["own", "text"])

    others = [c for c in docs.columns if c not in ("text", "n_chars")]
    rows, found = repeated_spans(docs.select(F.struct(*others).alias("own"), "doc_id", "text"), span)
    packed = rows.join(found, "rid", "left").select("own", "text", "spans", "doc_id")
    schema = packed.schema["own"].dataType

    out = packed.mapInArrow(keep, StructType([StructField("own", schema), StructField("text", StringType())]))
    columns = [F.col("text") if c == "text" else F.char_length("text").cast(cast[c]).alias(c) if c == "n_chars" else F.col(f"own.{c}") for c in docs.columns]
    return out.select(*columns)

