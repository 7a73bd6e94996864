"""Phrases whose words keep company, by vertical partitioning of the corpus's suffixes.

The suffixes of the corpus, cut off after a few words, are a forest: a tree for every first word. It is built in parts that fit a budget.
Words are counted first; those that are too rare to begin a phrase have no tree. Prefixes of two words are counted next, dealt out in groups
whose occurrences fit the budget, and only those that are frequent enough stay active. Their occurrences then bring the words that
follow them, as far as these may still belong to a frequent phrase, and each group of prefixes has its subtree built on its own: sorted
suffixes, whose common beginnings are the inner nodes and whose totals are the leaves'. A prefix of more occurrences than the budget is
extended, so that no group is larger than its prefixes allow.

Words are known by 64-bit hashes of language and word, drawn anew until no two words of the corpus share one. What tells active prefixes from
others on the way through the texts is a Bloom filter of a bounded size: one that errs lets an occurrence through that is dropped when it is
counted, so counts are exact however full the filter is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.bloom import ODD, filter_of, joined, mixed
from tessella.llm.common import cut, dropped, ship, shuffle_width

#: Words of a phrase at most, and occurrences of a phrase at least.
LONGEST, LEAST = 5, 100
#: Occurrences of a group of prefixes (the memory budget), and bits of the numbers by which prefixes are dealt out.
BUDGET, PLACES = 2_000_000, 22
#: Bytes that are taken apart at once, and entries that a task counts before it passes them on.
CHUNK, HELD = 1 << 20, 3_000_000
_KIND = np.zeros(256, np.uint8)  # 0: of a word, 1: between words, 2: between pieces
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


class Words:
    """Takes texts apart into words, a chunk of bytes at a time."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.base = int(rng.integers(1 << 62, dtype=np.int64)) * 2 + 1
        back = pow(self.base, -1, 1 << 64)
        self.power, self.back = (self._powers(b, CHUNK) for b in (self.base, back))

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    def of(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, tuple]]:
        """(hashes, whether each begins a piece, language of each, where the words lie) of stretches of text that end between two words."""
        for batch in batches:
            texts, langs = batch.column(0).cast(pa.large_binary()), batch.column(1).dictionary_encode()
            salt = np.array([self._salt(v.encode()) for v in langs.dictionary.to_pylist()], np.uint64)
            lang = langs.indices.to_numpy()
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
            at, end = int(offsets[0]), int(offsets[-1])
            apart = True  # whether the next word begins a piece whatever stands before it in its chunk
            while at < end:
                stop = self._stop(data, offsets, at, end)
                found, apart = self._chunk(data[at:stop], at, offsets, lang, salt, langs.dictionary, apart)
                yield from found
                at = stop

    @staticmethod
    def _stop(data: np.ndarray, offsets: np.ndarray, at: int, end: int) -> int:
        """Where a chunk ends: after a byte that is between words, or with a text; a longer word is one chunk."""
        if end - at <= CHUNK:
            return end
        last = np.flatnonzero(_KIND[data[at : at + CHUNK]])
        text = int(offsets[np.searchsorted(offsets, at + CHUNK, "right") - 1])
        best = max(at + int(last[-1]) + 1 if len(last) else at, text)
        if best > at:
            return best
        stop = at + CHUNK
        while stop < end and not _KIND[data[stop - 1]] and stop not in offsets:
            stop += 1
        return stop

    def _salt(self, raw: bytes) -> int:
        h = len(raw)
        for b in raw:
            h = (h * self.base + b + 1) & (1 << 64) - 1
        return h

    def _chunk(self, raw, at, offsets, lang, salt, names, apart):
        n = len(raw)
        if n > len(self.power):
            self.power, self.back = (self._powers(b, n) for b in (self.base, pow(self.base, -1, 1 << 64)))
        low, kind = _LOWER[raw], _KIND[raw]
        inside = kind == 0
        begins = np.zeros(n + 1, bool)  # of a text
        first = np.searchsorted(offsets, at, "left")
        own = offsets[first:] - at
        begins[own[own <= n]] = True
        before = np.r_[False, inside] & ~begins
        start = np.flatnonzero(inside & ~before[:n])
        end = np.flatnonzero(np.r_[False, inside] & (begins | ~np.r_[inside, False]))
        mark = (kind == 2) | begins[:n]
        if not len(start):
            return [], apart or bool(mark.any())
        total = np.r_[np.uint64(0), np.cumsum((low.astype(np.uint64) + np.uint64(1)) * self.power[:n])]
        text = np.searchsorted(offsets, start + at, "right") - 1
        # a polynomial's value, brought to the word's own beginning; the length parts words that end alike
        h = mixed((total[end] - total[start]) * self.back[start] + salt[lang[text]] * ODD + (end - start).astype(np.uint64))
        piece = np.cumsum(mark)[start]
        new = np.r_[apart or piece[0] > 0, piece[1:] != piece[:-1]]
        return [(h, new, lang[text], (low, inside, start, end, names))], bool(mark[end[-1] :].any())


def _counted(columns: list[np.ndarray], n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Rows of equal columns added up, in order of the columns."""
    if not len(n):
        return columns, n
    order = np.lexsort(columns[::-1])
    columns, n = [c[order] for c in columns], n[order]
    first = np.flatnonzero(np.r_[True, np.logical_or.reduce([c[1:] != c[:-1] for c in columns])])
    return [c[first] for c in columns], np.add.reduceat(n, first)


def _lang_and_word(picked: np.ndarray, where: tuple, lang: np.ndarray) -> tuple[pa.Array, pa.Array]:
    low, inside, start, end, names = where
    ends = np.r_[0, np.cumsum(end - start)].astype(np.int64)
    all_words = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(low[inside])))
    return names.take(pa.array(lang[picked])), all_words.take(pa.array(picked)).cast(pa.string())


def vocabulary(texts: DataFrame, seed: int) -> DataFrame:
    """h, lang, word and n of every word of the corpus."""

    def each(batches):
        h_, n_, rows = [], [], 0
        texts_: list[pa.Table] = []

        def out():
            keys, n = np.concatenate(h_), np.concatenate(n_)
            uniq, first, at = np.unique(keys, return_index=True, return_inverse=True)
            table = pa.concat_tables(texts_).take(pa.array(first))
            return pa.table({"h": pa.array(uniq.view(np.int64)), "lang": table["lang"].cast(pa.string()), "word": table["word"], "n": pa.array(np.bincount(at, n).astype(np.int64))})

        for h, _, lang, where in Words(seed).of(batches):
            uniq, first, n = np.unique(h, return_index=True, return_counts=True)
            names, words = _lang_and_word(first, where, lang)
            h_.append(uniq)
            n_.append(n)
            texts_.append(pa.table({"lang": names.cast(pa.string()), "word": words}))
            rows += len(uniq)
            if rows > HELD // 3:
                yield from out().to_batches(max_chunksize=100_000)
                h_, n_, texts_, rows = [], [], [], 0
        if h_:
            yield from out().to_batches(max_chunksize=100_000)

    found = texts.mapInArrow(each, "h long, lang string, word string, n long")
    return found.repartition(shuffle_width(texts.sparkSession), "h").groupBy("h", "lang", "word").agg(F.sum("n").alias("n"))


class Groups:
    """Prefixes dealt out by the first bits of their hashes, in ranges whose occurrences fit the budget; and those that exceed it alone."""

    def __init__(self, prefixes: DataFrame, key: Column, n: str):
        """``key``: the prefix's hash as a long. At most 2^PLACES sums and as many prefixes as budgets fit into the corpus come to the driver."""
        total = prefixes.agg(F.sum(n)).first()[0] or 0
        self.budget = max(BUDGET, total >> (PLACES - 2))
        bits = max(4, min(PLACES, (total // self.budget).bit_length() + 4))
        self.shift = np.uint64(64 - bits)
        place = F.shiftrightunsigned(key, 64 - bits)
        load = np.zeros(1 << bits, np.int64)
        large = F.col(n) > self.budget
        loads = prefixes.groupBy(place.cast("int").alias("place")).agg(F.sum(F.when(large, 0).otherwise(F.col(n))).alias("n")).toArrow()
        load[loads["place"].to_numpy()] = loads["n"].to_numpy()
        # the occurrences of large prefixes are spread over all groups, so each has less room for the others
        room = max(1, self.budget * int(load.sum()) // max(1, total))
        self.large = np.array(sorted(r[0] for r in prefixes.where(large).select(key.alias("k")).collect()), np.int64).view(np.uint64)
        self.large.sort()
        self.number, used, of = 1, 0, np.zeros(1 << bits, np.int32)
        for k, v in enumerate(load.tolist()):
            if used + v > room and used:
                self.number, used = self.number + 1, 0
            of[k], used = self.number - 1, used + v
        self.of_place = of

    def of(self, key: np.ndarray) -> np.ndarray:
        return self.of_place[key >> self.shift]

    def too_large(self, key: np.ndarray) -> np.ndarray:
        return self.large[np.minimum(np.searchsorted(self.large, key), len(self.large) - 1)] == key if len(self.large) else np.zeros(len(key), bool)


def _dealt(group: np.ndarray, columns: list[np.ndarray], n: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row for each group: its entries, columns one after the other."""
    by = np.argsort(group, kind="stable")
    edges = np.r_[np.flatnonzero(np.r_[True, np.diff(group[by]) != 0]), len(by)] if len(by) else [0]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        own = by[a:b]
        body = b"".join([*(c[own].tobytes() for c in columns), n[own].astype(np.int64).tobytes()])
        yield pa.RecordBatch.from_arrays([pa.array([int(group[own[0]])], pa.int32()), pa.array([body])], ["grp", "body"])


def _group_by_group(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[int, list[np.ndarray], np.ndarray]]:
    """The entries of each group, equal ones added up; rows come in order of their groups."""
    now, held = None, []

    def out():
        parts = [np.frombuffer(b, np.uint64).reshape(width + 1, -1) for b in held]
        both = np.concatenate(parts, axis=1)
        return _counted(list(both[:width]), both[width].view(np.int64))

    size = 0
    for batch in batches:
        for group, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if group != now and held:
                yield now, *out()
                held, size = [], 0
            now, size = group, size + len(body)
            held.append(body)
            if size > (width + 1) * 8 * HELD and len(held) > 1:  # equal entries of many tasks
                columns, n = out()
                held = [b"".join([*(c.tobytes() for c in columns), n.tobytes()])]
                size = len(held[0]) // 2
    if held:
        yield now, *out()


def _streamed(batches, seed: int, ahead: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes, whether each begins a piece), each stretch with the ``ahead`` words that follow it, which begin the next one."""
    h, new = np.zeros(0, np.uint64), np.zeros(0, bool)
    first = True
    for more, begins, _, _ in Words(seed).of(batches):
        if first:
            begins[0], first = True, False
        h, new = np.concatenate([h, more]), np.concatenate([new, begins])
        if len(h) > ahead:
            yield h, new
            h, new = h[-ahead:], new[-ahead:]
    yield np.concatenate([h, np.zeros(ahead, np.uint64)]), np.concatenate([new, np.ones(ahead, bool)])


def _pass_on(rows: Iterator[tuple[np.ndarray, list[np.ndarray], np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Entries (group, columns, n), counted in the task and passed on by group."""
    held: list[tuple[np.ndarray, list[np.ndarray], np.ndarray]] = []
    size = 0

    def counted():
        group = np.concatenate([g for g, _, _ in held]).astype(np.uint64)
        columns = [np.concatenate(c) for c in zip(*(c for _, c, _ in held), strict=True)]
        (group, *columns), n = _counted([group, *columns], np.concatenate([n for _, _, n in held]))
        return group.astype(np.int32), columns, n

    for entry in rows:
        held.append(entry)
        size += len(entry[0])
        if size > HELD:
            held = [counted()]
            size = len(held[0][0])
            if size > HELD // 2:
                yield from _dealt(*held[0])
                held, size = [], 0
    if held:
        yield from _dealt(*counted())


def frequent_phrases(texts: DataFrame, words: DataFrame, seed: int, least: int, longest: int) -> DataFrame:
    """p (the hashes of a phrase's words) and f, of every phrase of 2 to ``longest`` words with ``least`` occurrences; ``words`` has those
    words (h, n) that are as frequent."""
    spark, width = texts.sparkSession, shuffle_width(texts.sparkSession)
    known = spark.sparkContext.broadcast(filter_of(words, ["h"]))
    first = spark.sparkContext.broadcast(Groups(words, F.col("h"), "n"))

    def pairs(batches):
        def entries():
            for h, new in _streamed(batches, seed, 1):
                frequent = known.value.has(h)
                at = np.flatnonzero(frequent[:-1] & frequent[1:] & ~new[1:])
                (a, b), n = _counted([h[at], h[at + 1]], np.ones(len(at), np.int64))
                # a word of more occurrences than the budget is extended by its successor
                yield first.value.of(np.where(first.value.too_large(a), joined(a, b), a)), [a, b], n

        yield from _pass_on(entries())

    def pair_counts(batches):
        for _, (a, b), n in _group_by_group(batches, 2):
            keep = n >= least
            yield pa.RecordBatch.from_arrays([pa.array(a[keep].view(np.int64)), pa.array(b[keep].view(np.int64)), pa.array(joined(a[keep], b[keep]).view(np.int64)), pa.array(n[keep])], ["a", "b", "k", "n"])

    def subtrees(df, f, schema):
        return cut(df.repartition(width, "grp").sortWithinPartitions("grp").mapInArrow(f, schema))

    two = subtrees(texts.mapInArrow(pairs, "grp int, body binary"), pair_counts, "a long, b long, k long, n long")
    out = two.select(F.array("a", "b").alias("p"), F.col("n").alias("f"))
    if longest < 3:
        return out
    active = spark.sparkContext.broadcast(filter_of(two, ["a", "b"]))
    second = spark.sparkContext.broadcast(Groups(two, F.col("k"), "n"))

    def suffixes(batches):
        def entries():
            ahead = longest - 1
            for h, new in _streamed(batches, seed, ahead):
                m = len(h) - ahead
                on = np.zeros(len(h), bool)  # a word and the next may be a frequent pair
                at = np.flatnonzero(~new[1:])
                on[at] = active.value.has(joined(h[at], h[at + 1]))
                start = np.flatnonzero(on[:m] & on[1 : m + 1])
                columns, alive = [h[start], h[start + 1]], np.ones(len(start), bool)
                for k in range(2, longest):
                    alive = alive & on[start + k - 1]
                    columns.append(np.where(alive, h[start + k], np.uint64(0)))
                columns, n = _counted(columns, np.ones(len(start), np.int64))
                key = joined(columns[0], columns[1])
                large = second.value.too_large(key)
                yield second.value.of(key[~large]), [c[~large] for c in columns], n[~large]
                # a prefix beyond the budget is extended as far as phrases go: each of its phrases is a leaf of its own
                for k in range(3, longest + 1) if large.any() else ():
                    own = large & (columns[k - 1] != 0)
                    leaf = [c[own] if j < k else np.zeros(own.sum(), np.uint64) for j, c in enumerate(columns)]
                    whole = leaf[0]
                    for c in leaf[1:k]:
                        whole = joined(whole, c)
                    yield second.value.number + second.value.of(whole), leaf, n[own]

        yield from _pass_on(entries())

    def subtree_counts(batches):
        for group, columns, n in _group_by_group(batches, longest):
            for k in range(3, longest + 1):
                own = columns[k - 1] != 0
                if group >= second.value.number and k < longest:  # leaves alone: a phrase of k words has nothing after them
                    own &= columns[k] == 0
                node, total = _nodes([c[own] for c in columns[:k]], n[own])
                keep = total >= least
                p = np.stack([c[keep] for c in node], axis=1).view(np.int64) if keep.any() else np.zeros((0, k), np.int64)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(np.arange(0, p.size + 1, k, dtype=np.int32), pa.array(p.ravel())), pa.array(total[keep])], ["p", "f"])

    more = subtrees(texts.mapInArrow(suffixes, "grp int, body binary"), subtree_counts, "p array<long>, f long")
    return out.unionByName(more)


def _nodes(columns: list[np.ndarray], n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The nodes at one depth of a subtree: suffixes lie in order, so those below a node are a run, and its count is their total."""
    if not len(n):
        return columns, n
    first = np.flatnonzero(np.r_[True, np.logical_or.reduce([c[1:] != c[:-1] for c in columns])])
    return [c[first] for c in columns], np.add.reduceat(n, first)


def mined(docs: DataFrame, top: int = 2000, least: int = LEAST, longest: int = LONGEST, share: int = 100) -> DataFrame:
    """lang, rank (from 1), phrase, a, l, r, n and score (longs) of each language's ``top`` phrases.

    ``docs`` has text and lang; no other column is read. Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line ends and into
    words at blanks and tabs; a null text is empty, a null lang is ``und``. Repeated rows count as often as they come. n is a language's number
    of words, a the occurrences of a phrase of 2 to ``longest`` words, at least ``least``; l and r are those of its two parts at the cut with the
    lowest score floor(1000 a n / (l r)), ties to the first cut. A phrase goes if a longer one with it inside has ``share`` per cent of its
    occurrences or more. Higher scores come first, then higher a, then the phrase in order of its bytes. An empty table gives no rows.

    Counts are exact and cover all texts, whole. Arithmetic is in decimals of 38 digits.
    """
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("und")).alias("lang"))
    for seed in range(1, 100):
        every = cut(vocabulary(texts, seed))
        if every.groupBy("h").count().where("count > 1 or h = 0").isEmpty():
            break
        dropped(every)  # two words share a hash, or one has the 0 that stands for no word
    sizes = every.groupBy("lang").agg(F.sum("n").alias("n"))
    words = cut(every.where(F.col("n") >= least))
    phrases = cut(frequent_phrases(texts, words, seed, least, longest))
    counts = phrases.unionByName(words.select(F.array("h").alias("p"), F.col("n").alias("f")))

    inside = phrases.where(F.size("p") > 2).select("f", F.explode(F.expr("flatten(transform(sequence(2, size(p) - 1), k -> transform(sequence(1, size(p) - k + 1), i -> slice(p, i, k))))")).alias("p"))
    longer = inside.groupBy("p").agg(F.max("f").alias("longer"))
    free = phrases.join(longer, "p", "left").where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("f"))).select("p", F.col("f").alias("a"))

    cuts = free.select("p", "a", F.explode(F.sequence(F.lit(1), F.size("p") - 1)).alias("k")).withColumns({"left": F.expr("slice(p, 1, k)"), "right": F.expr("slice(p, k + 1, size(p))")})
    lang_of = words.select(F.array("h").alias("head"), "lang").join(sizes, "lang")
    cuts = cuts.join(counts.select(F.col("p").alias("left"), F.col("f").alias("l")), "left").join(counts.select(F.col("p").alias("right"), F.col("f").alias("r")), "right")
    cuts = cuts.withColumn("head", F.expr("slice(p, 1, 1)")).join(lang_of, "head")
    wide = lambda c: f"CAST({c} AS DECIMAL(38, 0))"
    score = F.expr(f"{wide('1000')} * {wide('a')} * {wide('n')} div ({wide('l')} * {wide('r')})")
    lowest = cuts.groupBy("p", "lang", "n", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("m")).select("p", "lang", "n", "a", "m.*")
    best = cut(lowest.withColumn("__r", F.expr("rank() OVER (PARTITION BY lang ORDER BY score DESC, a DESC)")).where(F.col("__r") <= top))

    spelt = best.select("p", F.posexplode("p").alias("at", "h")).join(words.select("h", "word"), "h")
    text = spelt.groupBy("p").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda w: w["word"]), " ").alias("phrase"))
    ranked = best.join(text, "p").withColumn("rank", F.expr("row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)")).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


#: DuckDB SQL for the query op13_collocations.
ORACLE_SQL = r"""WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
ws AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
grams AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: w[i:i + k - 1])) AS p FROM ws, (VALUES (1), (2), (3), (4), (5)) t(k) WHERE len(w) >= k),
f AS (SELECT lang, k, p, count(*) AS f FROM grams GROUP BY ALL),
sizes AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE k > 1 AND f >= 100),
inside AS (SELECT lang, unnest(flatten(list_transform(range(2, k), lambda m: list_transform(range(1, k - m + 2), lambda i: p[i:i + m - 1])))) AS p, f FROM c WHERE k > 2),
longer AS (SELECT lang, p, max(f) AS most FROM inside GROUP BY ALL),
free AS (SELECT c.lang, c.k, c.p, c.f FROM c LEFT JOIN longer USING (lang, p) WHERE most IS NULL OR 100 * most < 100 * c.f),
cuts AS (SELECT lang, p, f AS a, unnest(range(1, k)) AS m FROM free),
s AS (SELECT cuts.lang, cuts.p, a, m, x.f AS l, y.f AS r, n, CAST(CAST(1000 AS HUGEINT) * a * n // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.p = cuts.p[1:m] JOIN f y ON y.lang = cuts.lang AND y.p = cuts.p[m + 1:] JOIN sizes ON sizes.lang = cuts.lang),
low AS (SELECT lang, array_to_string(p, ' ') AS phrase, a, l, r, n, score FROM s QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, m) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM low QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000"""
