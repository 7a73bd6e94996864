import hashlib

import numpy as np
import pytest

from tests.llm import fixtures as fx
from tessella.llm import parsing, simhash, substrings
from tessella.llm.components import components, forest
from tessella.llm.queries import QUERIES


def component_ids(ids, prints):
    f = np.array(prints, np.uint64)
    comp = np.array(ids)
    while True:
        new = np.array([comp[np.bitwise_count(f ^ x) <= 3].min() for x in f])
        if (new == comp).all():
            return comp.tolist()
        comp = new


def simhash_rows(df):
    return {r.doc_id: (r.fingerprint, r.component_id) for r in df.collect()}


def test_simhash(spark):
    docs = fx.documents(spark)
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    prints = [fx.fingerprint(t) for _, t in rows]
    want = {i: (f"{p:016x}", c) for (i, _), p, c in zip(rows, prints, component_ids([i for i, _ in rows], prints), strict=True)}
    assert simhash_rows(simhash.near_duplicates(docs)) == want


def test_simhash_query(spark, sf_dir):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    prints = [fx.fingerprint(t) for _, t in rows]
    want = {i: (f"{p:016x}", c) for (i, _), p, c in zip(rows, prints, component_ids([i for i, _ in rows], prints), strict=True)}
    assert simhash_rows(QUERIES["op5_simhash_near_dedup"](spark, sf_dir)) == want


def test_simhash_empty_and_repeated(spark):
    assert simhash.near_duplicates(fx.empty(spark)).count() == 0
    twice = fx.documents(spark, n=5)
    assert simhash.near_duplicates(twice.union(twice)).count() == 2 * twice.count()
    kept = simhash.first_of_each(twice.union(twice))
    assert kept.columns == twice.columns and kept.count() == kept.select("doc_id").distinct().count() > 0


def test_one_row_of_each_component_stays(spark):
    """Rows that share a doc_id are judged by their texts, and no text without a near copy is lost."""
    docs = fx.documents(spark, seed=9)
    a, b, c = ("".join(f" {w}{i}" for i in range(40)) for w in "abc")
    more = [(1000, a), (1005, a), (1005, b), (1005, c), (1005, c), (None, c), (None, "alone " + b + c), (None, "alone " + b + c), (None, None), (1006, None)]
    docs = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    component = component_ids(list(range(len(rows))), [fx.fingerprint(t) for _, t in rows])
    want = {}
    for (i, _), k in zip(rows, component, strict=True):
        want[k] = min(want.get(k, (True, 0)), (i is None, i or 0))
    kept = simhash.first_of_each(docs)
    assert kept.dtypes == docs.dtypes
    own = [rows.index((r.doc_id, r.text)) for r in kept.collect()]
    assert sorted((component[k], rows[k][0]) for k in own) == sorted((k, None if none else i) for k, (none, i) in want.items())
    assert (1005, b) in [rows[k] for k in own] and (1005, c) in [rows[k] for k in own] and (1005, a) not in [rows[k] for k in own]
    assert simhash.first_of_each(docs.limit(0)).count() == 0


@pytest.mark.parametrize("n", [50, 3000])
def test_links_within_large_keys(spark, n, monkeypatch):
    """Many fingerprints near one another: tiles give the same components as all pairs."""
    monkeypatch.setattr(simhash, "TILE", 64)
    rng = np.random.default_rng(n)
    base = int(rng.integers(1 << 62))
    values = {base}
    while len(values) < n:
        v = base
        for b in rng.choice(64, rng.integers(1, 9), replace=False):
            v ^= 1 << int(b)
        values.add(v)
    values = np.array(sorted(values), np.uint64).view(np.int64)
    fps = spark.createDataFrame([(int(v),) for v in values], "fp long")
    got = {r.node: r.root for r in components(simhash.link(fps)).collect()}
    a, b = [], []
    for k, v in enumerate(values):
        near = np.flatnonzero(np.bitwise_count(values ^ v) <= 3)
        near = near[near > k]
        a.append(np.full(len(near), v))
        b.append(values[near])
    nodes, roots = forest(np.concatenate(a), np.concatenate(b))
    want = dict(zip(nodes.tolist(), roots.tolist(), strict=True))
    assert {k: v for k, v in got.items() if k != v} == want


def test_thresholds_meet_the_pigeonhole():
    rng = np.random.default_rng(0)
    x = (rng.random((5000, 64)) < rng.random(64)).astype(np.int64)
    for n in (10, 10**5, 10**9, 10**13):
        parts = simhash.plan(n, x.T @ x * n // 5000)
        assert sum(t + 1 for _, t in parts) == 4
        assert len({b for bits, _ in parts for b in bits}) == sum(len(bits) for bits, _ in parts)


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_removed_bytes(spark):
    docs = fx.documents(spark, seed=3)
    rows = sorted((r.doc_id, (r.text or "").encode()) for r in docs.select("doc_id", "text").collect())
    want = {}
    for (i, raw), mark in zip(rows, fx.covered([t for _, t in rows]), strict=True):
        kept = bytes(c for c, m in zip(raw, mark, strict=True) if not m)
        spans = sum(m and not before for m, before in zip(mark, [False, *mark], strict=False))
        want[i] = (len(raw), sum(mark), spans, hashlib.sha256(kept).hexdigest())
    assert sum(w[1] for w in want.values()) > 0
    assert {r[0]: tuple(r)[1:] for r in substrings.removed_bytes(docs).collect()} == want


@pytest.mark.parametrize("held", [200, 400_000])
def test_removed_bytes_of_divided_triggers(spark, monkeypatch, held):
    """A string with other surroundings everywhere, among them shared ones: dealt out by window, the same bytes go."""
    monkeypatch.setattr(substrings, "MOST_KINDS", 2)
    monkeypatch.setattr(substrings, "WINDOWS_AT_A_TIME", held)
    rng = np.random.default_rng(7)
    word = lambda n: rng.integers(97, 123, n).astype(np.uint8).tobytes().decode()
    sides = [word(40) for _ in range(6)]
    rows = [(i, word(30) + sides[rng.integers(6)][rng.integers(30) :] + "the common string of all" + sides[rng.integers(6)][: rng.integers(10, 41)] + word(30)) for i in range(150)]
    want = {i: sum(m) for (i, _), m in zip(rows, fx.covered([t.encode() for _, t in rows]), strict=True)}
    got = substrings.removed_bytes(spark.createDataFrame(rows[::-1], "doc_id long, text string").repartition(5))
    assert sum(want.values()) > 0 and {r.doc_id: r.n_removed for r in got.collect()} == want


def test_windows_of_divided_phrases_are_spread_by_their_bytes():
    n, phrases = np.array([11, 11, 1]), [b"a" * 20 + b"b" * 40, b"a" * 20 + b"c" * 40, b"a" * 20 + b"b" * 30]
    gone, sent = substrings._divided(np.array([5, 6, 7]), np.array([1, 2, 3]), np.array([0, 100, 200]), n, phrases, 50)
    assert gone.select(["rid", "s", "n"]).to_pylist() == [{"rid": 7, "s": 200, "n": 50}]
    assert sent.num_rows == 22 and len(set(sent.column("k").to_pylist())) == 22


def test_removed_bytes_query(spark, sf_dir):
    rows = sorted((r.doc_id, (r.text or "").encode()) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    want = {i: (len(raw), sum(mark)) for (i, raw), mark in zip(rows, fx.covered([t for _, t in rows]), strict=True)}
    assert {r.doc_id: (r.n_bytes, r.n_removed) for r in QUERIES["op9_suffix_array_dedup"](spark, sf_dir).collect()} == want


def test_removed_bytes_edges(spark):
    assert substrings.removed_bytes(fx.empty(spark)).count() == 0
    text = "abcdefghij" * 12
    rows = [(1, "q" * 40), (2, text), (2, text), (2, "other " + text), (3, text), (None, text), (4, None)]
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in substrings.removed_bytes(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, 120, 0), (1, 40, 0), (2, 120, 0), (2, 120, 0), (2, 126, 0), (3, 120, 120), (4, 0, 0)]


def test_without_repeats_keeps_other_columns(spark):
    docs = fx.documents(spark, seed=4)
    out = substrings.without_repeats(docs)
    assert out.dtypes == docs.dtypes
    assert sorted(map(str, out.drop("text", "n_chars").collect())) == sorted(map(str, docs.drop("text", "n_chars").collect()))
    assert out.where("n_chars <> char_length(text)").count() == 0


def test_blocks_of_a_long_text_give_the_same_windows(monkeypatch):
    rng = np.random.default_rng(5)
    raw = rng.integers(97, 101, 5000).astype(np.uint8).tobytes()
    whole = parsing.parse([raw, b"short"], 50)
    monkeypatch.setattr(parsing, "BLOCK", 600)
    parts = parsing.parse([raw], 50)
    for p in (whole, parts):
        windows = np.concatenate([np.arange(s, s + n) for s, n in zip(p.start, p.count, strict=True)])
        assert sorted(windows.tolist()) == list(range(len(raw) - 49))
