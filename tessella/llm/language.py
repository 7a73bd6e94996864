"""Language by the nearest of several centroids for each language, in a space of weighted n-grams."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import ship
from tessella.llm.ngram_vectors import blocks, inverse_document_frequency, vectors

#: Rows a language that are learnt from (a bound on the fit alone), and languages that a model may have; more are an error.
MOST_A_LANGUAGE, MOST_LANGUAGES = 300, 4000
#: Centroids a language, and rounds of k-means.
CENTROIDS, ROUNDS = 4, 12
#: A document is marked as rejected below this part of the cosine that the centroid's own members have at least.
SLACK = 0.7

_WORD_SIGN = re.compile(r"[^\W\d_]")


def has_letter(text: str | None) -> bool:
    """Whether a character of the text is a letter; the pattern takes numerals such as ½ for one too."""
    return any(m[0].isalpha() for m in _WORD_SIGN.finditer(text or ""))


def centroids(x: np.ndarray, most: int = CENTROIDS) -> tuple[np.ndarray, np.ndarray]:
    """Unit centroids of unit vectors by spherical k-means from far-apart rows, and the least cosine of each one's members."""
    chosen = [x.sum(0) / max(np.linalg.norm(x.sum(0)), 1e-12)]
    while len(chosen) < min(most, len(x)):
        chosen.append(x[int(np.argmin((x @ np.array(chosen).T).max(1)))])
    c = np.array(chosen)
    for _ in range(ROUNDS):
        own = np.argmax(x @ c.T, 1)
        for k in range(len(c)):
            if (own == k).any():
                total = x[own == k].sum(0)
                c[k] = total / max(np.linalg.norm(total), 1e-12)
    cosine = x @ c.T
    own = np.argmax(cosine, 1)
    least = np.array([np.quantile(cosine[own == k, k], 0.01) if (own == k).any() else 1.0 for k in range(len(c))])
    return c, least


def chosen_rows(learn: DataFrame) -> DataFrame:
    """(doc_id, lang, text): about as many rows of each language, in one pass, by a hash of doc_id and text."""
    sizes = learn.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    if (n := sizes.count()) > MOST_LANGUAGES:
        raise ValueError(f"{n} languages; a model has {MOST_LANGUAGES} at most")
    mark = F.xxhash64("doc_id", "text")
    rows = learn.join(F.broadcast(sizes), "lang").where(F.pmod(mark, F.lit(1 << 30)) < F.lit((1 << 30) * MOST_A_LANGUAGE) / F.col("n"))
    # equal rows have equal hashes: whatever the table holds, no more than twice the share comes through
    first = Window.partitionBy("lang").orderBy(mark)
    return rows.withColumn("place", F.row_number().over(first)).where(F.col("place") <= 2 * MOST_A_LANGUAGE).select("doc_id", "lang", "text")


def fit(learn: DataFrame) -> dict:
    """idf over every row of ``learn`` (doc_id, text, lang), centroids from bounded samples of each language.

    Only these three columns are read; doc_id is a whole number of up to 64 bits. Rows with a null lang or text are not learnt from; an empty text is one like any other. An empty
    table gives a model that knows no language. Every language there is gets its centroids, each in a task of its own; more languages
    than MOST_LANGUAGES are an error, since the model (64 KB each) goes to every worker.
    """
    ship(learn.sparkSession)
    learn = learn.select("doc_id", "text", "lang").where("lang is not null and text is not null")
    idf = inverse_document_frequency(learn, lower=True)

    def shaped(batches):
        for batch in batches:
            for part, texts in blocks(batch, 2, lower=True):
                rows = vectors(texts, idf).astype(np.float16)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([r.tobytes() for r in rows])], ["doc_id", "lang", "v"])

    def clustered(table: pa.Table) -> pa.Table:
        rows = table.sort_by([("doc_id", "ascending"), ("v", "ascending")])
        c, least = centroids(np.array([np.frombuffer(v, np.float16) for v in rows["v"].to_pylist()], np.float32))
        return pa.table({"lang": [rows["lang"][0].as_py()] * len(c), "k": pa.array(range(len(c)), pa.int32()), "c": [r.astype(np.float32).tobytes() for r in c], "least": least.astype(np.float64)})

    rows = chosen_rows(learn).select("doc_id", "lang", "text").mapInArrow(shaped, "doc_id long, lang string, v binary")
    found = rows.groupBy("lang").applyInArrow(clustered, "lang string, k int, c binary, least double").orderBy("lang", "k").collect()
    c = np.array([np.frombuffer(r.c, np.float32) for r in found], np.float32).reshape(len(found), len(idf))
    return {"idf": idf, "langs": [r.lang for r in found], "centroids": c, "least": np.array([r.least for r in found])}


def predicted(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, lang_pred, score (cosine to the nearest centroid, 0 to 1) and rejected of every row of ``docs``.

    lang_pred is ``und`` with score 0 if the text is null or has no letter, or if nothing was learnt. A text farther from
    every centroid than that one's members are keeps its nearest language and is marked as rejected. Ties go to the
    language that is first in order. Rows are judged one by one, whole, so repeats get equal results, and null ids are kept. Only doc_id
    and text are read. An empty table gives no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def each(batches):
        names = np.array([*held.value["langs"], "und"])
        for batch in batches:
            for part, texts in blocks(batch, 1, lower=True):
                none = np.array([not has_letter(t) for t in part.column(1).to_pylist()], bool)
                best, score, rejected = np.full(len(texts), len(names) - 1), np.zeros(len(texts)), np.ones(len(texts), bool)
                if len(names) > 1:
                    cosine = vectors(texts, held.value["idf"]) @ held.value["centroids"].T
                    near = np.argmax(cosine, 1)
                    high = cosine[np.arange(len(texts)), near].astype(np.float64)
                    best = np.where(none, best, near)
                    score = np.where(none, 0.0, np.clip(high, 0.0, 1.0))
                    rejected = none | (high < SLACK * held.value["least"][near])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names[best].tolist(), pa.string()), pa.array(score), pa.array(rejected)], ["doc_id", "lang_pred", "score", "rejected"])

    return docs.select("doc_id", "text").mapInArrow(each, "doc_id long, lang_pred string, score double, rejected boolean")
