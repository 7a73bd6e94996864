import zlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import fixtures as fx
from tessella.llm import decontam, quality_rules
from tessella.llm.queries import _tokenizer_path


def test_stages(spark, sf_dir):
    """Each stage's decisions, recomputed plainly from its own input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    steps = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_near_dedup", "suffix_array_dedup", "benchmark_decontamination", "packing"]
    one = steps["quality_rules"](spark, docs, sf_dir).cache()
    assert one.dtypes == docs.dtypes and 0 < one.count() < docs.count()
    two = steps["simhash_near_dedup"](spark, one, sf_dir).cache()
    prints = {r.doc_id: fx.fingerprint(r.text) for r in one.collect()}
    comp = {i: i for i in prints}
    changed = True
    while changed:
        new = {i: min(comp[j] for j in prints if (prints[i] ^ prints[j]).bit_count() <= 3) for i in prints}
        changed, comp = new != comp, new
    assert {r.doc_id for r in two.collect()} == {i for i in comp if comp[i] == i}
    three = steps["suffix_array_dedup"](spark, two, sf_dir).cache()
    rows = sorted((r.doc_id, r.text.encode()) for r in two.collect())
    marks = fx.covered([t for _, t in rows])
    want = {i: bytes(c for c, m in zip(t, mark, strict=True) if not m).decode("utf-8", "ignore") for (i, t), mark in zip(rows, marks, strict=True)}
    assert {r.doc_id: r.text for r in three.collect()} == want and three.where(F.col("n_chars") != F.char_length("text")).count() == 0
    four = steps["benchmark_decontamination"](spark, three, sf_dir).cache()
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    exact = {i for i, t in want.items() if any(x.lower() in t.lower() for x in items)}
    left = {r.doc_id for r in four.collect()}
    assert not left & exact and four.dtypes == docs.dtypes
    leaked = {r.doc_id for r in decontam.leaks(three, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
    assert left == set(want) - leaked
    last = steps["packing"](spark, four, sf_dir)
    assert {r.doc_id for r in last.select("doc_id").distinct().collect()} == left


def plain(spark, docs, items):
    """doc_id to text after the four stages that decide on texts, by brute force; of the first only its own verdicts are taken."""
    kept = {r.doc_id for r in quality_rules.judged(docs).where("kept").collect()}
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id in kept}
    prints, comp = {i: fx.fingerprint(t) for i, t in texts.items()}, {i: i for i in texts}
    while True:
        new = {i: min(comp[j] for j in prints if (prints[i] ^ prints[j]).bit_count() <= 3) for i in prints}
        if new == comp:
            break
        comp = new
    rows = sorted((i, t.encode()) for i, t in texts.items() if comp[i] == i)
    left = {i: bytes(c for c, m in zip(t, mark, strict=True) if not m).decode("utf-8", "ignore") for (i, t), mark in zip(rows, fx.covered([t for _, t in rows]), strict=True)}
    found = decontam.Matcher(items).find_all(list(left.values()))
    return {i: t for k, (i, t) in enumerate(left.items()) if k not in {f[0] for f in found}}


def test_run(spark, sf_dir):
    """Every token of every text that the stages leave, in pieces that join, and nothing else."""
    from tokenizers import Tokenizer

    assert corpus_pipeline.ORACLE_SQL is None
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = plain(spark, docs, [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()])
    whole = Tokenizer.from_file(_tokenizer_path())
    whole.encode_special_tokens = True
    pieces = {}
    for r in corpus_pipeline.run(spark, sf_dir).collect():
        pieces.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    assert pieces.keys() == want.keys()
    for doc, own in pieces.items():
        ids = np.array([*whole.encode(want[doc], add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for start, length, crc, total in sorted(own):
            assert (start, total) == (at, len(ids)) and crc == zlib.crc32(ids[start : start + length].tobytes())
            at += length
        assert at == len(ids)


def test_run_of_empty_tables(spark, tmp_path):
    fx.empty(spark).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_on_rows_with_everything_wrong(spark, sf_dir):
    """Nulls, repeats, repeated ids with other texts, clashing columns, a text of very many words."""
    docs = fx.documents(spark, seed=21)
    long = " ".join(f"word{i % 977} and{i % 1009}" for i in range(60_000)) + "."
    more = spark.createDataFrame([(1, long, None), (1, long, None), (None, long[50_000:] + " other", "x"), (None, None, None)], "doc_id long, text string, fp string")
    docs = docs.unionByName(more, allowMissingColumns=True)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.dtypes == docs.dtypes and 0 < out.count() <= docs.count(), name
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
    rows = corpus_pipeline.packed(spark, docs, sf_dir).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in docs.collect()}


def test_tables_on_the_way_are_removed_when_nothing_reads_them(spark, tmp_path):
    """Each stage leaves what it has written on its way to the next, which removes it, but not what its own input still reads."""
    from pathlib import Path

    docs, left = fx.documents(spark, seed=21), lambda: [t._cut_at for t in corpus_pipeline._LEFT.get("here", [])]
    there = lambda path: Path(path.removeprefix("file:")).exists()
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality_rules"](spark, docs, "here")
    first = left()
    assert first and all(map(there, first))
    lazy = stages["simhash_near_dedup"](spark, kept, "here")  # kept has not been written, so what it reads stays
    assert any(map(there, first)) and lazy.count() <= kept.count()
    second = left()
    lazy.write.parquet(f"{tmp_path}/written")
    stages["suffix_array_dedup"](spark, spark.read.parquet(f"{tmp_path}/written"), "here").count()
    assert not any(map(there, second))
