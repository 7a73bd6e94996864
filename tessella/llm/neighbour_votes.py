"""Quality by votes of the nearest labelled documents in a latent-semantic space."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import ship
from tessella.llm.ngram_vectors import blocks, gathered, inverse_document_frequency, sampled, vectors

#: Labelled rows that are learnt from (a bound on the fit alone), latent dimensions, and neighbours that vote.
MOST_LABELLED, DIMENSIONS, NEIGHBOURS, SHARPNESS = 2000, 64, 15, 4.0


def fit(docs: DataFrame, labelled: DataFrame, most: int = MOST_LABELLED) -> dict:
    """idf over all of ``docs``; projection and labelled points from at most about ``most`` ids of ``labelled`` (doc_id, label).

    Of ``docs`` only doc_id (a whole number of up to 64 bits) and text are read, of ``labelled`` only doc_id and label. An id that is labelled several times alike counts
    once; one with different labels, a null id and a null label are not learnt from. Each row of ``docs`` with a chosen id is a point;
    null texts are empty. Without points (an empty table of either) every score is 0.5.
    """
    ship(docs.sparkSession)
    idf = inverse_document_frequency(docs, lower=False)
    named = labelled.where("doc_id is not null and label is not null").select("doc_id", F.col("label").cast("int").alias("label"))
    known = named.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("most")).where("label = most").drop("most")
    chosen = sampled(known, known.count(), most)
    # the sample is bounded by a parameter, so it is safe to broadcast; of very many rows with its ids as many are points
    points = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").limit(4 * most)
    label, x = gathered(points, "label", idf, lower=False)
    if not label:
        return {"idf": idf, "project": np.zeros((len(idf), 1), np.float32), "points": np.zeros((0, 1), np.float32), "label": np.zeros(0, np.float32), "weight": np.zeros(0), "prior": 0.5}
    label = np.array(label, np.float32)
    values, left = np.linalg.eigh((x @ x.T).astype(np.float64))
    k = min(DIMENSIONS, len(values))
    values, left = values[::-1][:k], left[:, ::-1][:, :k]
    project = (x.T @ (left / np.sqrt(np.maximum(values, 1e-9)))).astype(np.float32)
    points = x @ project
    points /= np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-12)
    # the rarer label's points count for more, so that both have the same weight in all
    weight = np.where(label > 0, 0.5 / max(label.mean(), 1e-9), 0.5 / max(1 - label.mean(), 1e-9))
    return {"idf": idf, "project": project, "points": points, "label": label, "weight": weight, "prior": float(label.mean())}


def votes(x: np.ndarray, model: dict) -> np.ndarray:
    """Share of label 1 among the nearest points, each weighted by a power of its cosine; the prior where nothing is alike.

    Points that are as near as the last of them share the places that are left, so the order of the points means nothing."""
    points, label = model["points"], model["label"]
    latent = x @ model["project"]
    norm = np.linalg.norm(latent, axis=1)
    score = np.full(len(x), model["prior"])
    if len(points):
        cosine = (latent / np.maximum(norm, 1e-12)[:, None]) @ points.T
        k = min(NEIGHBOURS, len(points))
        last = np.partition(cosine, -k, axis=1)[:, -k]
        row, near = np.nonzero(cosine >= last[:, None])
        own = cosine[row, near]
        above = np.bincount(row, own > last[row], minlength=len(x))
        ties = np.bincount(row, own == last[row], minlength=len(x))
        place = np.where(own > last[row], 1.0, ((k - above) / ties)[row])
        weight = np.maximum(own, 0).astype(np.float64) ** SHARPNESS * model["weight"][near] * place
        total, good = (np.bincount(row, w, minlength=len(x)) for w in (weight, weight * label[near]))
        some = (total > 1e-9) & (norm > 1e-9)
        score[some] = good[some] / total[some]
    return np.clip(score, 0.0, 1.0)


def scored(docs: DataFrame, model: dict, threshold: float = 0.3) -> DataFrame:
    """doc_id, score (0 to 1) and predicted of every row of ``docs``.

    The model has a fixed size (projection and at most MOST_LABELLED points of DIMENSIONS numbers) and is broadcast; each
    block of documents is multiplied with all points. A null or empty text, or a model without labels, gives the prior
    (0.5 without labels). Rows are judged one by one, whole, so repeats get equal scores, and null ids are kept. Only doc_id and text
    are read. An empty table gives no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def each(batches):
        for batch in batches:
            for part, texts in blocks(batch, 1, lower=False):
                score = votes(vectors(texts, held.value["idf"]), held.value)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(each, "doc_id long, score double, predicted int")
