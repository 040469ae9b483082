"""Compression classifier for quality.

Two zstandard dictionaries are built from labelled texts, good and bad.  A text is
compressed in blocks with each; the difference of the sizes, divided by the size without
a dictionary, says which it resembles.  With it go the compression ratios, and a logistic
curve fitted on labelled texts that no dictionary was built from makes them a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .infra import ship, slices
from .labelled import logistic, probability, training_sample

BLOCK, LEVEL = 1024, 3


@dataclass(frozen=True)
class QualityModel:
    good: bytes
    bad: bytes
    curve: tuple[np.ndarray, np.ndarray, np.ndarray]


@lru_cache(maxsize=8)
def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    options = {"level": LEVEL, "write_checksum": False, "write_content_size": False, "write_dict_id": False}
    if not dictionary:
        return zstandard.ZstdCompressor(**options)
    d = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_AUTO)
    d.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=d, **options)


def _sizes(text: bytes, good: bytes, bad: bytes) -> np.ndarray:
    """By block of the text: its length and its compressed sizes with the good, the bad and no dictionary."""
    blocks = [text[a : a + BLOCK] for a in range(0, len(text), BLOCK)]
    if len(blocks) > 1 and len(blocks[-1]) < BLOCK // 2:  # no block too short to tell anything
        blocks[-2:] = [blocks[-2] + blocks[-1]]
    return np.array([[len(x) for x in blocks], *([len(x) for x in map(_compressor(d).compress, blocks)] for d in (good, bad, b""))], float)


def features(texts: list[bytes], good: bytes, bad: bytes) -> np.ndarray:
    """Normalised size differences (over all, of the worst and of the best block) and ratios of each text."""
    out = np.zeros((len(texts), 7))
    for i, t in enumerate(texts):
        if t:
            n, g, b, none = _sizes(t, good, bad)
            d = (b - g) / none
            r = none / n
            out[i] = ((b - g).sum() / none.sum(), d.min(), d.max(), none.sum() / n.sum(), r.min(), r.max(), (g / n).max())
    return out


#: Bytes of a block that dictionaries are trained on, and blocks a class that the driver trains on: 8 MiB at most.
TRAIN_BLOCK, TRAIN_BLOCKS = 2048, 4096


def _dictionary(blocks: list[bytes], size: int) -> bytes:
    """A dictionary of about `size` bytes: segments of as many texts as possible, by turns."""
    if len(blocks) >= 8 and sum(map(len, blocks)) > 4 * size:
        try:
            return zstandard.train_dictionary(size, blocks).as_bytes()
        except zstandard.ZstdError:  # too uniform to train on: raw text serves as well
            pass
    return b"".join(blocks)[-size:]


def _blocks(sample: DataFrame, y: int, most: int) -> list[bytes]:
    """Blocks of the texts of a class in fold 0, those with the smallest hashes, at most `most`; cut in tasks, so no text reaches the driver whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            for t in b.column(0).cast(pa.binary()).to_pylist():
                for at in range(0, len(t), TRAIN_BLOCK << 10):  # a long text in parts
                    part = t[at : at + (TRAIN_BLOCK << 10)]
                    yield pa.RecordBatch.from_arrays([pa.array([part[i : i + TRAIN_BLOCK] for i in range(0, len(part), TRAIN_BLOCK)], pa.binary())], names=["block"])

    cut_up = sample.where((F.col("y") == y) & (F.col("f") == 0)).select("text").mapInArrow(run, "block binary")
    return [bytes(r["block"]) for r in cut_up.orderBy(F.xxhash64("block"), "block").limit(most).collect()]


def _measured(sample: DataFrame, good: bytes, bad: bytes) -> list[tuple[float, ...]]:
    """(label, features) of the texts outside fold 0, in order of their numbers; measured in tasks."""
    held = sample.sparkSession.sparkContext.broadcast((good, bad))  # of fixed size
    names = ["y", *(f"x{i}" for i in range(7))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            x = features(b.column(0).cast(pa.binary()).to_pylist(), *held.value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64()) for c in (b.column(1).to_numpy().astype(float), *x.T)], names=names)

    rows = sample.where("f <> 0").select("text", "y").mapInArrow(run, ", ".join(f"{c} double" for c in names))
    return sorted(map(tuple, rows.collect()))  # eight numbers a sampled row


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = 2000, size: int = 112_640, blocks: int = TRAIN_BLOCKS) -> QualityModel:
    """Dictionaries from fold 0 and a curve from fold 2 of a sample of at most `most` rows a class; dictionaries see at most `blocks` blocks a class.

    Texts are cut and measured in tasks: blocks and numbers reach the driver, whole texts
    don't.  With no labelled rows of a class, every score is one half."""
    ship(docs.sparkSession)
    sample = training_sample(docs, labels, label_col, id_col, text_col, most)
    good, bad = (_dictionary(_blocks(sample, k, blocks), size) for k in (1, 0))
    fit = np.array(_measured(sample, good, bad) if good and bad else [], float).reshape(-1, 8)
    y = fit[:, 0]
    if not 0 < y.sum() < len(y):
        return QualityModel(good, bad, (np.zeros(8), np.zeros(7), np.ones(7)))
    return QualityModel(good, bad, logistic(fit[:, 1:], y))


def score(docs: DataFrame, model: QualityModel, text_col: str = "text", out: str = "score", threshold: float = 0.5) -> DataFrame:
    """docs with `out` (0 to 1, higher: good likelier) and predicted (1 from threshold on).

    Whole texts, however long, in blocks.  A null or empty text has the score of no
    evidence.  Columns named as the new ones are replaced; rows are scored one by one, so
    repeated rows get equal scores; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(model)  # two dictionaries of fixed size
    keep = [c for c in docs.columns if c not in (out, "predicted")]
    place = keep.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            texts = [x or b"" for x in b.column(place).cast(pa.binary()).to_pylist()]
            p = probability(m.curve, features(texts, m.good, m.bad)) if texts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=[*keep, out, "predicted"])

    thin = docs.select(*[f"`{c}`" for c in keep])
    return thin.mapInArrow(run, thin.select(*[f"`{c}`" for c in keep]).schema.add(out, "double").add("predicted", "integer"))
