"""Cross-entropy difference between a target and a background n-gram model of the same corpus and vocabulary.

1. Every word and every pair of neighbours has a key of 64 bits. Documents are packed in batches of about 1.5 million tokens. A
   batch sends each bucket of keys one packed row: its distinct keys there and how often it has them. A word or pair that is
   everywhere is one entry a batch, and what is sent grows with the corpus.
2. A bucket adds up all batches, which gives every word and pair of the corpus its own exact counts, and answers each batch.
3. A batch meets the answers of all buckets and its documents are scored, each without what it has itself put into a model: a
   document that was counted would else look familiar to the model that counted it. The driver has only the totals of tokens.

The models are matched: one vocabulary, the same pairs and words, and the same shares for unseen words and for pairs, whatever
the sizes of the two. The background is every document that is not in the target; it is not cut down to the target's size.
"""

from __future__ import annotations

import uuid
from itertools import groupby, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import ascii_lower, cut, let, ship, shuffle_width, words

#: Both models share one vocabulary: the words of the corpus, and at least so many; no word is unknown.
WORDS = 1 << 19
#: Weight of pair statistics against single words, and of an even chance for each word of the vocabulary against counts.
PAIR_WEIGHT, EVEN = 0.5, 0.01
#: Up to so many ids of target documents are broadcast (8 bytes each); more are joined by a shuffle.
MOST_BROADCAST = 2_000_000
#: Tokens of a batch, about; tokens of the corpus for each bucket of keys; tokens whose chances are worked out at a time.
TOKENS_A_BATCH, TOKENS_A_BUCKET, TOKENS_AT_A_TIME = 1_500_000, 1_500_000, 200_000
#: Bytes of packed rows that go back to Spark at a time, about.
BYTES_A_SLICE = 8 << 20


def _hashes(text):
    return let(words(ascii_lower(text)), lambda w: F.transform(w, lambda x: F.xxhash64(x)))


def _pair_keys(word: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Odd keys of the pairs of neighbours, and the places of their second words; ``starts``: where texts begin."""
    second = np.ones(len(word), bool)
    second[starts] = False
    second = np.flatnonzero(second)
    mix = word[second] ^ np.uint64(0x9E3779B97F4A7C15)
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        mix = (mix ^ (mix >> np.uint64(33))) * np.uint64(factor)
    mix += word[second - 1]
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        mix = (mix ^ (mix >> np.uint64(33))) * np.uint64(factor)
    return (mix ^ (mix >> np.uint64(33))) | np.uint64(1), second


def _tokens(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The even keys of all words, and how many words each text has."""
    lists = column.combine_chunks()
    flat = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64) & ~np.uint64(1)
    return flat, lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)


def _starts(lengths: np.ndarray) -> np.ndarray:
    """Where the texts that have words begin."""
    return (np.cumsum(lengths) - lengths)[lengths > 0]


def _gathered(batches, most: int):
    """Tables of about so many tokens (lists in the last column); a text is never divided."""
    waiting, held = [], 0
    for batch in batches:
        total = np.cumsum(batch.column(batch.num_columns - 1).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = int(total[at - 1]) if at else 0
            end = max(at + 1, int(np.searchsorted(total, before + most - held, "right")))
            waiting.append(batch.slice(at, end - at))
            held += int(total[end - 1]) - before
            at = end
            if held >= most or at < batch.num_rows:
                yield pa.Table.from_batches(waiting)
                waiting, held = [], 0
    if waiting:
        yield pa.Table.from_batches(waiting)


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers as few bytes each as the largest needs, all last bytes first, compressed where that helps."""
    if not len(values):
        return b""
    width = max(1, (int(values.max()).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()
    small = pa.compress(planes, "zstd", asbytes=True) if len(planes) > 64 else planes
    return bytes([width]) + planes if len(small) + 8 >= len(planes) else bytes([width | 16]) + len(planes).to_bytes(8, "little") + small


def _unpacked(raw: bytes) -> np.ndarray:
    if not raw:
        return np.empty(0, np.uint64)
    planes = pa.decompress(raw[9:], int.from_bytes(raw[1:9], "little"), "zstd", asbytes=True) if raw[0] & 16 else raw[1:]
    width = raw[0] & 15
    out = np.zeros((len(planes) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(planes, np.uint8).reshape(width, -1).T
    return out.view("<u8").ravel()


def _base(b: int, buckets: int) -> np.uint64:
    """The least key of a bucket; buckets are ranges of keys."""
    return np.uint64(-(-(b << 32) // buckets) << 32)


def _dealt(keys: np.ndarray, buckets: int):
    """(bucket, from, to, packed keys) of all buckets, for ascending keys."""
    edges = [*np.searchsorted(keys, np.array([_base(b, buckets) for b in range(buckets)], np.uint64)).tolist(), len(keys)]
    for b, (at, end) in enumerate(pairwise(edges)):
        yield b, at, end, _packed(np.diff(keys[at:end], prepend=_base(b, buckets)))


def _keys_of(raw: bytes, b: int, buckets: int) -> np.ndarray:
    return _base(b, buckets) + np.cumsum(_unpacked(raw), dtype=np.uint64)


def _summed(keys: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, ascending; the sums of their counts; and which of them each key is."""
    if not len(keys):
        return keys, *counts, np.empty(0, np.int64)
    order = np.argsort(keys)
    keys = keys[order]
    new = np.r_[True, keys[1:] != keys[:-1]]
    first = np.flatnonzero(new)
    which = np.empty(len(keys), np.int64)
    which[order] = np.cumsum(new) - 1
    return keys[first], *(np.add.reduceat(c[order], first) for c in counts), which


def _sent(rows, schema: pa.Schema):
    """Tuples as batches of about BYTES_A_SLICE."""
    waiting, held = [], 0
    for row in rows:
        waiting.append(row)
        held += sum(len(x) for x in row if isinstance(x, bytes))
        if held >= BYTES_A_SLICE:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*waiting, strict=True), schema, strict=True)], schema=schema)
            waiting, held = [], 0
            pa.default_memory_pool().release_unused()
    if waiting:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*waiting, strict=True), schema, strict=True)], schema=schema)


def _rows(batches):
    """Rows of batches as dictionaries, one at a time."""
    for batch in batches:
        for at in range(batch.num_rows):
            yield {name: batch.column(k)[at].as_py() for k, name in enumerate(batch.schema.names)}


def _schema(**types) -> tuple[pa.Schema, str]:
    names = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(k, names[v]) for k, v in types.items()]), ", ".join(f"{k} {v}" for k, v in types.items())


def with_target(docs: DataFrame, target: DataFrame) -> DataFrame:
    """``docs`` (doc_id and text) with a column is_target: whether doc_id is in ``target``; a null id is not."""
    ids = target.select("doc_id").where("doc_id is not null").distinct().withColumn("is_target", F.lit(True))
    small = ids.count() <= MOST_BROADCAST
    return docs.join(F.broadcast(ids) if small else ids, "doc_id", "left").withColumn("is_target", F.coalesce("is_target", F.lit(False)))


_TEXTS, _TEXTS_DDL = _schema(batch="long", ids="array<long>", lengths="binary", vocabulary="binary", token="binary", chosen="binary", tokens="long", target_tokens="long")
_ASKS, _ASKS_DDL = _schema(b="int", batch="long", answered="boolean", k="binary", n="binary", t="binary")
_ANSWERS, _ANSWERS_DDL = _schema(b="int", batch="long", n="binary", t="binary", known="long")


def _batches(docs: DataFrame, target: DataFrame | None) -> DataFrame:
    """Documents in packed batches of about TOKENS_A_BATCH, written: ids, words a text, distinct words, and which of them each token is."""

    def pack(batches):
        def rows():
            for table in _gathered(batches, TOKENS_A_BATCH):
                word, lengths = _tokens(table.column("h"))
                vocabulary, token = np.unique(word, return_inverse=True)
                chosen = table.column("is_target").to_numpy().astype(np.int64)
                yield uuid.uuid4().int >> 65, table.column("doc_id").to_pylist(), _packed(lengths), _packed(np.diff(vocabulary, prepend=np.uint64(0))), _packed(token), _packed(chosen), len(word), int((lengths * chosen).sum())

        yield from _sent(rows(), _TEXTS)

    ship(docs.sparkSession)
    texts = docs.select("doc_id", "text")
    marked = texts.withColumn("is_target", F.lit(False)) if target is None else with_target(texts, target)
    return cut(marked.select("doc_id", "is_target", _hashes(F.col("text")).alias("h")).mapInArrow(pack, _TEXTS_DDL))


def _opened(row: dict):
    """Words a text, distinct words, which of them each token is, keys of the pairs, and the places of their second words."""
    lengths, vocabulary = _unpacked(row["lengths"]).astype(np.int64), np.cumsum(_unpacked(row["vocabulary"]), dtype=np.uint64)
    token = _unpacked(row["token"]).astype(np.int64)
    return lengths, vocabulary, token, *_pair_keys(vocabulary[token], _starts(lengths))


def fit(docs: DataFrame, target: DataFrame) -> dict:
    """The corpus whose counts make the two models, in written batches, and the tokens of the target documents and of all others.

    Of ``docs`` only doc_id (a whole number of up to 64 bits) and text are read, of ``target`` only doc_id, where nulls and repeats mean nothing; ids that ``docs`` lacks
    neither. Each row of ``docs`` counts, repeats as often as they occur. An empty table of either is a model without counts."""
    texts = _batches(docs, target)
    tokens, chosen = (x or 0 for x in texts.agg(F.sum("tokens"), F.sum("target_tokens")).first())
    buckets = max(shuffle_width(docs.sparkSession), tokens // TOKENS_A_BUCKET)
    return {"docs": docs, "texts": texts, "buckets": buckets, "target_count": np.int64(chosen), "background_count": np.int64(tokens - chosen)}


def counted(texts: DataFrame, buckets: int) -> DataFrame:
    """For each bucket of keys and each batch that is ``answered``: the counts, over the batches that are ``counted``, of the batch's keys
    in order, in all documents (n) and in the target (t); and how many words of the bucket have been counted (known)."""

    def ask(batches):
        def rows():
            for row in _rows(batches):
                lengths, vocabulary, token, pair, second = _opened(row)
                chosen = np.repeat(_unpacked(row["chosen"]).astype(np.int64), lengths)
                distinct, n, t, _ = _summed(pair, np.ones(len(pair), np.int64), chosen[second])
                n = np.concatenate([np.bincount(token, minlength=len(vocabulary)), n])
                t = np.concatenate([np.bincount(token[chosen > 0], minlength=len(vocabulary)), t])
                k = np.concatenate([vocabulary, distinct])
                order = np.argsort(k)
                k, n, t = k[order], n[order] * row["counted"], t[order] * row["counted"]
                for b, at, end, raw in _dealt(k, buckets):
                    yield b, row["batch"], row["answered"], raw, _packed(n[at:end]), _packed(t[at:end])

        yield from _sent(rows(), _ASKS)

    def settle(batches):
        def rows():
            for b, parts in groupby(_rows(batches), lambda r: r["b"]):
                parts = list(parts)
                keys = [_keys_of(p["k"], b, buckets) for p in parts]
                edges = np.cumsum([0, *map(len, keys)])
                n, t = (np.concatenate([_unpacked(p[c]) for p in parts]).astype(np.int64) for c in ("n", "t"))
                keys, n, t, which = _summed(np.concatenate(keys), n, t)
                known = int((((keys & np.uint64(1)) == 0) & (n > 0)).sum())
                for p, at, end in zip(parts, edges[:-1], edges[1:], strict=True):
                    if p["answered"]:
                        own = which[at:end]
                        yield b, p["batch"], _packed(n[own]), _packed(t[own]), known

        yield from _sent(rows(), _ANSWERS)

    return texts.mapInArrow(ask, _ASKS_DDL).repartition(buckets, "b").sortWithinPartitions("b").mapInArrow(settle, _ANSWERS_DDL)


def losses(single: np.ndarray, pair: np.ndarray, second: np.ndarray, total: np.ndarray | int, size: int) -> np.ndarray:
    """Negative log-probability of each token: pairs seen in the model, interpolated with single words and an even chance.

    ``single`` has each token's count; ``pair`` the count of each pair, whose second words are at ``second``; ``total`` the tokens of
    the model. What the pairs of a word lack of all its occurrences is the chance that the text ends after it."""
    p = (1 - EVEN) * single / np.maximum(total, 1) + EVEN / size
    seen = single[second - 1]
    known = seen > 0
    at = second[known]
    p[at] = PAIR_WEIGHT * pair[known] / seen[known] + (1 - PAIR_WEIGHT) * p[at]
    return -np.log(p)


def _own(doc: np.ndarray, which: np.ndarray) -> np.ndarray:
    """For each token (or pair) how often its document has it."""
    _, inverse, n = np.unique(doc * (int(which.max(initial=0)) + 1) + which, return_inverse=True, return_counts=True)
    return n[inverse]


def scored(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss and score (their difference, a token; lower is more like the target).

    Every row of ``docs`` is scored whole; a text without words, or a null one, has no tokens, and null losses and score. If ``docs``
    is what the model was fitted to, each row is scored by what the other rows have put into the models; a copy of a row is another
    row. Repeats get equal scores, and null ids are kept. Of ``docs`` only doc_id and text are read. An empty table gives no rows.
    """
    totals = {name: int(model[f"{name}_count"]) for name in ("target", "background")}
    corpus = model["texts"].withColumn("counted", F.lit(True))
    counted_too = docs.sameSemantics(model["docs"])
    if counted_too:  # what is counted is also what asks
        texts, asking = model["texts"], corpus.withColumn("answered", F.lit(True))
    else:
        texts = _batches(docs, None)
        asking = corpus.withColumn("answered", F.lit(False)).unionByName(texts.withColumns({"counted": F.lit(False), "answered": F.lit(True)}))

    def finish(batches):
        for _, rows in groupby(_rows(batches), lambda r: r["batch"]):
            row = next(rows)
            found = [(_unpacked(r["n"]), _unpacked(r["t"]), r["known"]) for r in rows]
            lengths, vocabulary, token, pair, second = _opened(row)
            none = lengths == 0
            out = {name: np.zeros(len(lengths)) for name in totals}
            if len(token):
                n, t = (np.concatenate(x).astype(np.int64) for x in list(zip(*found, strict=True))[:2])
                size = max(WORDS, sum(x[2] for x in found))
                distinct, which = np.unique(pair, return_inverse=True)
                keys = np.sort(np.concatenate([vocabulary, distinct]))
                single, double = np.searchsorted(keys, vocabulary), np.searchsorted(keys, distinct)
                marks = _unpacked(row["chosen"]) > 0
                # a stretch of documents at a time, so that the arrays of single tokens stay small
                ends, first_pair = np.cumsum(lengths), np.concatenate([[0], np.cumsum(np.maximum(lengths - 1, 0))])
                docs_at = 0
                while docs_at < len(lengths):
                    begin = int(ends[docs_at - 1]) if docs_at else 0
                    docs_end = max(docs_at + 1, int(np.searchsorted(ends, begin + TOKENS_AT_A_TIME, "right")))
                    some, own_lengths = slice(docs_at, docs_end), lengths[docs_at:docs_end]
                    tokens, pairs = slice(begin, int(ends[docs_end - 1])), slice(int(first_pair[docs_at]), int(first_pair[docs_end]))
                    after = second[pairs] - begin
                    doc = np.repeat(np.arange(len(own_lengths)), own_lengths)
                    chosen = np.repeat(marks[some], own_lengths)
                    one, two = single[token[tokens]], double[which[pairs]]
                    own = (_own(doc, token[tokens]), _own(doc[after], which[pairs])) if counted_too else (0, 0)
                    for name, c, mine in (("target", t, chosen), ("background", n - t, ~chosen)) if len(doc) else ():
                        total = totals[name] - (mine * own_lengths[doc] if counted_too else 0)
                        loss = losses(c[one] - mine * own[0], c[two] - mine[after] * own[1], after, total, size)
                        out[name][some][own_lengths > 0] = np.add.reduceat(loss, _starts(own_lengths)) / own_lengths[own_lengths > 0]
                    docs_at = docs_end
            a, b = out["target"], out["background"]
            yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(lengths), *(pa.array(x, mask=none) for x in (a, b, a - b))], ["doc_id", "n_tokens", "target_loss", "background_loss", "score"])

    own = texts.select("batch", F.lit(-1).alias("b"), "ids", "lengths", "vocabulary", "token", "chosen")
    joined = own.unionByName(counted(asking, model["buckets"]), allowMissingColumns=True)
    dealt = joined.repartition(max(shuffle_width(docs.sparkSession), texts.count()), "batch").sortWithinPartitions("batch", "b")
    return dealt.mapInArrow(finish, "doc_id long, n_tokens long, target_loss double, background_loss double, score double")
