"""Collocations against a plain count."""

import random
import re
from collections import Counter

from tests.llm import fixtures as fx
from tessella.llm import collocations


def plain(rows, top, least, longest=5):
    n, f = Counter(), Counter()
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", fx.lower(text or "")):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f.update((lang, *w[i : i + k]) for i in range(len(w) - k + 1))
    candidates = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    gone = {(p[0], *p[i:j]) for p, a in candidates.items() for i in range(1, len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) - 1 and a >= f[(p[0], *p[i:j])]}
    out = {}
    for p, a in candidates.items():
        if p not in gone:
            cuts = [(1000 * a * n[p[0]] // (f[p[: k + 1]] * f[(p[0], *p[k + 1 :])]), k, f[p[: k + 1]], f[(p[0], *p[k + 1 :])]) for k in range(1, len(p) - 1)]
            score, _, left, right = min(cuts)
            out.setdefault(p[0], []).append((-score, -a, " ".join(p[1:]).encode(), left, right))
    return {(lang, rank, phrase.decode(), -a, left, right, n[lang], -score) for lang, own in out.items() for rank, (score, a, phrase, left, right) in enumerate(sorted(own)[:top], 1)}


def corpus(seed=4, n=300):
    rng = random.Random(seed)
    vocab = ["The", "of", "a", "é", "中文", "x|y", "in", "(b)", "\x07", "wo-rd"]
    vocab += [f"w{i}" for i in range(40)]
    fixed = "free of any charge in the world"
    rows = []
    for _ in range(n):
        words = [rng.choice(vocab[:10] if rng.random() < 0.6 else vocab) for _ in range(rng.choice([0, 1, 3, 20, 60]))]
        if rng.random() < 0.4:
            words[len(words) // 2 : len(words) // 2] = [fixed]
        text = "".join(w + rng.choice([" ", " ", " ", "\t ", ". ", ",", "\n", "\x0b", "\r\n"]) for w in words)
        rows.append((text, rng.choice(["en", "de", None])))
    return [*rows, (None, "en"), ("", "fr"), ("...", None), (" \t", "de"), ("one", "xx"), rows[0], rows[0]]


def got(spark, rows, **how):
    schema = "text string, lang string, h long, n int, p string, word string, rank int"
    docs = spark.createDataFrame([(*r, 1, 2, "p", "w", 3) for r in rows], schema).repartition(3)
    found = [tuple(r) for r in collocations.mined(docs, **how).collect()]
    assert len(found) == len(set(found))
    return set(found)


def test_phrases(spark):
    rows = corpus()
    want = plain(rows, 2000, 5)
    assert got(spark, rows, least=5) == want and len(want) > 50
    assert got(spark, rows, least=5, top=3) == plain(rows, 3, 5)


def test_prefixes_beyond_the_budget(spark, monkeypatch):
    """Groups of a few occurrences: frequent words and pairs are extended."""
    monkeypatch.setattr(collocations, "BUDGET", 40)
    rows = corpus(seed=8)
    assert got(spark, rows, least=5) == plain(rows, 2000, 5)


def test_long_texts(spark):
    """Texts of several stretches, one of them without any mark, and a word longer than a stretch."""
    rng = random.Random(2)
    vocab = [f"long{i}word" for i in range(12)]
    rows = [(" ".join(rng.choice(vocab) for _ in range(250_000)), "en"), (", ".join(" ".join(rng.choice(vocab) for _ in range(50)) for _ in range(2000)), "en"), ("y" * 2_500_000 + " " + " ".join(vocab * 3), "en")]
    assert got(spark, rows, least=100, top=500) == plain(rows, 500, 100)


def test_shorter_phrases_and_empty_tables(spark):
    rows = corpus(seed=9, n=60)
    assert got(spark, rows, least=4, longest=2) == plain(rows, 2000, 4, longest=2)
    assert got(spark, rows, least=4, longest=3) == plain(rows, 2000, 4, longest=3)
    assert got(spark, [], least=4) == set() and got(spark, [("a b", "en")], least=4) == set()


def test_words_that_share_a_hash_are_told_apart(spark, monkeypatch):
    """A first seed under which all words collide is given up for the next one."""
    own = collocations.vocabulary
    tried = []

    def clashing(texts, seed):
        tried.append(seed)
        found = own(texts, seed)
        return found.selectExpr("1L AS h", "lang", "word", "n") if len(tried) == 1 else found

    monkeypatch.setattr(collocations, "vocabulary", clashing)
    rows = corpus(seed=10, n=80)
    assert got(spark, rows, least=4) == plain(rows, 2000, 4) and tried == [1, 2]


def test_stretches_and_flushes_of_any_size(monkeypatch):
    """Texts taken apart in stretches of 64 bytes, entries passed on every 50: the same counts as in one go, in one process."""
    import numpy as np
    import pyarrow as pa

    rows = corpus(seed=11, n=120)
    rows[3] = ("y" * 300 + " x " + "z" * 200, "en")
    batches = [pa.RecordBatch.from_arrays([pa.array([t or "" for t, _ in part]), pa.array([g or "und" for _, g in part])], ["text", "lang"]) for part in (rows[:50], rows[50:51], rows[51:])]

    def pairs():
        def entries():
            for h, new in collocations._streamed(iter(batches), 1, 1):
                at = np.flatnonzero(~new[1:])
                columns, n = collocations._counted([h[at], h[at + 1]], np.ones(len(at), np.int64))
                yield (columns[0] >> np.uint64(62)).astype(np.int32), columns, n

        sent = sorted((b.column(0)[0].as_py(), b.column(1)[0].as_py()) for b in collocations._pass_on(entries()))
        merged = iter([pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), pa.array([body])], ["grp", "body"]) for g, body in sent])
        return len(sent), {(int(a), int(b)): int(n) for _, (x, y), c in collocations._group_by_group(merged, 2) for a, b, n in zip(x, y, c, strict=True)}

    few, whole = pairs()
    monkeypatch.setattr(collocations, "CHUNK", 64)
    monkeypatch.setattr(collocations, "HELD", 50)
    many, apart = pairs()
    assert whole == apart and many > few and sum(whole.values()) == sum(max(0, len(re.findall(r"[^\x20\x09]+", p)) - 1) for t, _ in rows for p in re.split(r"[.,;:!?\x0A-\x0D]", t or ""))
