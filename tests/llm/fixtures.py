"""Small documents with everything that can go wrong, and plain versions of the operators to compare with."""

import random
import re

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rid string, own int, spans int, k string, row string, fp string"


def documents(spark, seed=1, n=60):
    """Rows with nulls in every column, empty and repeated texts, near copies, shared passages, a long text, and columns whose
    names the operators use themselves."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(200)]
    passage = " ".join(rng.choice(vocab) for _ in range(60))
    rows = []
    for i in range(n):
        words = [rng.choice(vocab) for _ in range(rng.choice([0, 1, 2, 5, 30, 80, 200]))]
        if rng.random() < 0.3:
            words[len(words) // 2 : len(words) // 2] = [passage]
        text = " ".join(words)
        if rows and rng.random() < 0.25:
            text = rng.choice(rows)[1] or ""
            if rng.random() < 0.5 and text:
                at = rng.randrange(len(text))
                text = text[:at] + "x" + text[at + 1 :]
        if rng.random() < 0.1:
            text += "\n" + "same line\n" * 3 + "\t \x0b"
        rows.append((i * 3 + 1, text))
    rows.append((2, passage * 30))
    rows += [(500, None), (501, ""), (502, " \t\n"), (503, "one"), (504, "Two Words"), (505, "ÀÉ ß 中文 x")]
    full = [(i, t, rng.choice(["en", "de", None]), rng.choice(["a", "b", None]), None if t is None else len(t), "rid", 1, None, "k", "row", None) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(text):
    return text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def fingerprint(text, size=3):
    w = WORD.findall(lower(text or ""))
    s = [" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def covered(texts, span=50):
    """Spans of bytes that go, for texts in order of doc_id."""
    seen, out = set(), []
    for raw in texts:
        grams = [raw[i : i + span] for i in range(len(raw) - span + 1)]
        mark = [False] * len(raw)
        for i, g in enumerate(grams):
            if g in seen:
                mark[i : i + span] = [True] * span
        seen.update(grams)
        out.append(mark)
    return out


def edits(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)
