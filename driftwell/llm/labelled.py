"""Folds of labelled rows, bounded training samples and logistic calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .infra import cut

#: Rows with this remainder of crc32(id as text) modulo FOLDS are held out: nothing is learnt from them.
FOLDS, HELD_OUT = 3, 1


def fold(id_col: str) -> Column:
    """crc32 of the id as text, modulo FOLDS; a null id has fold 0 (and, with no label, teaches nothing)."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % FOLDS, F.lit(0))


def training_sample(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id", text_col: str = "text", most: int = 2000) -> DataFrame:
    """(text, y, f): text, label and fold of at most `most` rows of each class outside the held-out fold, in a table of the shared folder.

    The sample is the only bounded thing about a classifier: the rows with the smallest
    hash of their id, with their whole texts.  Rows with null id or label teach nothing, nor
    do empty texts; an id labelled twice counts with its larger label, and of rows with one
    id the smallest text teaches.
    """
    known = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("y")).dropna().groupBy("id").agg(F.max("y").alias("y"))
    known = known.where(fold("id") != HELD_OUT)
    chosen = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(most)
        chosen = part if chosen is None else chosen.union(part)
    ids = docs.sparkSession.createDataFrame(chosen.collect(), chosen.schema)  # at most 2 * most rows
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).where(F.length("text") > 0)
    one = texts.join(F.broadcast(ids), "id").groupBy("id", "y").agg(F.min("text").alias("text"))
    return cut(one.select("text", "y", fold("id").cast("int").alias("f")), "sample")


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weights with the intercept last, means, scales) of a ridge logistic regression by Newton steps, classes weighted by their true shares."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    penalty = np.r_[np.full(x.shape[1], ridge), 1e-6]
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -35, 35)))
        g = z.T @ (p - y) + penalty * w
        h = (z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty)
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w, mean, scale


def probability(model: tuple[np.ndarray, np.ndarray, np.ndarray], x: np.ndarray) -> np.ndarray:
    w, mean, scale = model
    return 1 / (1 + np.exp(-np.clip(np.c_[(x - mean) / scale, np.ones(len(x))] @ w, -35, 35)))
