"""Registered queries whose SQL is missing, or is the same text on another engine, against plain versions written on their own."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm import fixtures as fx
from tests.llm.test_rows import repeats
from tessella.llm import lm_scoring, neighbour_votes, ngram_vectors, quality_rules
from tessella.llm.queries import QUERIES


def test_lm_scoring(spark, sf_dir):
    """Every document by counts of all others, word by word."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    good = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").collect()}
    words = [fx.WORD.findall(fx.lower(r.text or "")) for r in docs]
    counts, totals = {True: Counter(), False: Counter()}, {True: 0, False: 0}
    for r, w in zip(docs, words, strict=True):
        counts[r.doc_id in good].update([*w, *zip(w, w[1:], strict=False)])
        totals[r.doc_id in good] += len(w)
    size = max(lm_scoring.WORDS, len({k for c in counts.values() for k in c if isinstance(k, str)}))
    got = {r.doc_id: r for r in QUERIES["op1_lm_scoring"](spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for r, w in zip(docs, words, strict=True):
        own = Counter([*w, *zip(w, w[1:], strict=False)])
        for side, name in ((True, "target_loss"), (False, "background_loss")):
            mine = (r.doc_id in good) == side
            n = lambda k: counts[side][k] - (own[k] if mine else 0)  # noqa: B023, E731
            total, loss = totals[side] - (len(w) if mine else 0), 0.0
            for i, x in enumerate(w):
                p = 0.99 * n(x) / max(total, 1) + 0.01 / size
                if i and n(w[i - 1]):
                    p = 0.5 * n((w[i - 1], x)) / n(w[i - 1]) + 0.5 * p
                loss -= math.log(p)
            assert got[r.doc_id][name] == (pytest.approx(loss / len(w), rel=1e-6) if w else None)
        assert got[r.doc_id].n_tokens == len(w) and (not w or got[r.doc_id].score == pytest.approx(got[r.doc_id].target_loss - got[r.doc_id].background_loss))


def test_neighbour_votes(spark, sf_dir):
    """The projection by a singular value decomposition, cosines and votes one document at a time."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect() if fold(r.doc_id)}
    tf = np.log1p(np.array([ngram_vectors.frequencies((r.text or "").encode()) for r in docs], float))
    idf = np.log((1 + len(docs)) / (1 + (tf > 0).sum(0))) + 1
    x = tf * idf
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    own = [k for k, r in enumerate(docs) if r.doc_id in label]
    y = np.array([label[docs[k].doc_id] for k in own])
    points = x[own].astype(np.float16).astype(float)  # points are kept in half precision
    right = np.linalg.svd(points, full_matrices=False)[2][: neighbour_votes.DIMENSIONS]
    points = points @ right.T
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    got = {r.doc_id: r for r in QUERIES["op3_neighbour_votes"](spark, sf_dir).collect()}
    assert len(got) == len(docs)
    far = []
    for r, v in zip(docs, x @ right.T, strict=True):
        cosine = points @ v / max(float(np.linalg.norm(v)), 1e-12)
        near = np.argsort(-cosine, kind="stable")[: neighbour_votes.NEIGHBOURS]
        w = np.maximum(cosine[near], 0) ** 4 / np.where(y[near] == 1, y.mean(), 1 - y.mean())
        score = (w * y[near]).sum() / w.sum() if w.sum() > 1e-9 else y.mean()
        far.append(abs(score - got[r.doc_id].score))
        assert got[r.doc_id].held_out == (fold(r.doc_id) == 0) and got[r.doc_id].predicted == int(got[r.doc_id].score >= 0.3)
    # where two points are as near to within rounding, another may vote
    assert np.mean(np.array(far) < 1e-3) > 0.97 and max(far) < 0.1


def covariance(x):
    return np.cov(x.T, bias=True) + np.diag(quality_rules.FLOOR)


def distances(x, half):
    off = x - half.mean(0)
    return np.einsum("ij,ij->i", off, np.linalg.solve(covariance(half), off.T).T)


def least_determinant(x, rng, starts=60, steps=20):
    """Squared distances under the covariance of least determinant of a half that random starts and many steps find."""
    h = (len(x) + x.shape[1] + 1) // 2
    best = None
    for _ in range(starts):
        half = x[rng.choice(len(x), x.shape[1] + 1, replace=False)]
        for _ in range(steps):
            half = x[np.argsort(distances(x, half))[:h]]
        size = np.linalg.slogdet(covariance(half))[1]
        if best is None or size < best[0]:
            best = size, distances(x, half)
    return best[1]


def test_quality_rules(spark, sf_dir):
    """Counts by hand, and an estimate of least determinant from many random starts, for each language and source."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got = {r.doc_id: r for r in QUERIES["op2_quality_rules"](spark, sf_dir).collect()}
    rows, sizes = [], Counter()
    for r in docs:
        text = r.text or ""
        w, lines = fx.WORD.findall(text), [s for s in text.split("\n") if fx.WORD.search(s)]
        again, chars = repeats(w), sum(map(len, w))
        failed = len(w) < 20 or 100 * again > 30 * len(w)
        assert got[r.doc_id].base_failed == failed and got[r.doc_id].n_repeat_words == again
        if not failed:
            symbols, upper, marks = (sum(c in s for c in text) for s in (quality_rules.SYMBOLS, quality_rules.UPPER, quality_rules.MARKS))
            v = [math.log(chars / len(w)), *(math.sqrt(a / b) for a, b in ((symbols, len(w)), (upper, chars), (len(lines) - len(set(lines)), len(lines)), (again, len(w)), (marks, len(w))))]
            rows.append((r.doc_id, (r.lang or "?", r.source or "?"), v))
            sizes[r.lang or "?", r.source or "?"] += 1
    rest = Counter()
    for (lang, _), n in sizes.items():
        if n < quality_rules.LEAST_GROUP:
            rest[lang] += n
    group = lambda own: own if sizes[own] >= quality_rules.LEAST_GROUP else own[0] if rest[own[0]] >= quality_rules.LEAST_GROUP else "*"
    rng = np.random.default_rng(0)
    for g in {group(own) for _, own, _ in rows}:
        ids = [i for i, own, _ in rows if group(own) == g]
        x = np.array([v for _, own, v in rows if group(own) == g])
        if len(x) < quality_rules.LEAST_GROUP:
            assert all(got[i].kept for i in ids)
            continue
        d = least_determinant(x, rng)
        limit = quality_rules.CUTOFF * max(np.median(d) / quality_rules.CHI2_MEDIAN, 1.0)
        for i, own in zip(ids, d, strict=True):
            if not limit / 1.6 < own < limit * 1.6:  # the query's orders are in steps, and its half need not be the very best
                assert got[i].kept == (own <= limit)
