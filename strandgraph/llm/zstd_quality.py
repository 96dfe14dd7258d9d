"""Quality by compression: Zstandard dictionaries of good and of bad labelled text.

A text is compressed with each dictionary, all of it, in pieces of PIECE bytes: a compressor soon learns a long text from
itself, after which no dictionary matters. Its feature is the size difference (bad less good) over its bytes plus
SMOOTHING; a logistic curve, fitted on labelled texts that neither dictionary has seen, turns it into the probability of
label 1. The fit uses a bounded sample of labelled rows (LABELLED a class, by a hash of doc_id; of these, every fourth
calibrates). What reaches the driver has one size at any corpus and any length of text: one stretch of EXTRACT bytes of each
text that trains, and one number, the size difference over the whole text, of each that calibrates; both are made in
executors. Texts are scored by a narrow pass.

Labels of the held-out fold, crc32(doc_id as text) mod 3 = 1, are never read; doc_id, lang and source are no features.

Defined results: null text is the empty text, which gets the score of a zero difference; a null doc_id is in no fold that
trains or is held out (held_out false); labels other than 0 and 1, null labels and labels without a document are left
out; without labelled text of both classes every score is the share of label 1 among what there is, 0.5 if none.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_names, map_arrow, map_rows, stage

LABELLED = 4000
#: Bytes of a labelled text that a dictionary sees: one stretch at a place given by the text's hash.
EXTRACT = 1000
PIECE = 4_096
DICTIONARY_BYTES = 112_640
LEVEL = 3
SMOOTHING = 500.0
FOLDS, HELD_OUT = 3, 1


@dataclass(frozen=True)
class Model:
    bad: bytes
    good: bytes
    slope: float
    intercept: float


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    kind = zstandard.DICT_TYPE_FULLDICT if dictionary[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
    held = zstandard.ZstdCompressionDict(dictionary, dict_type=kind)
    held.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False)


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.pair = (_compressor(model.bad), _compressor(model.good)) if model.bad and model.good else None

    def difference(self, text: bytes) -> float:
        if not self.pair or not text:
            return 0.0
        bad, good = self.pair
        pieces = [text[i : i + PIECE] for i in range(0, len(text), PIECE)]
        return sum(len(bad.compress(p)) - len(good.compress(p)) for p in pieces) / (len(text) + SMOOTHING)

    def score(self, text: bytes) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.model.slope * self.difference(text) + self.model.intercept, -500, 500))))


def extract(text: bytes) -> bytes:
    room = len(text) - EXTRACT
    at = zlib.crc32(text) % (room + 1) if room > 0 else 0
    return text[at : at + EXTRACT]


def dictionary(samples: list[bytes]) -> bytes:
    """A dictionary of samples (extracts), or, where they are too few or too alike to train on, samples themselves up to a dictionary's size."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(samples)[:DICTIONARY_BYTES]


def calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Weighted logistic fit by Newton steps, with a small ridge and the usual smoothing of labels."""
    ones = y.sum()
    target = np.where(y > 0, (ones + 1) / (ones + 2), 1 / (len(y) - ones + 2))
    scale = float(x.std()) or 1.0
    design, w = np.c_[x / scale, np.ones(len(x))], np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ w))
        step = np.linalg.solve((design * (weight * p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2), design.T @ (weight * (target - p)) - 1e-3 * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def fold(doc_id) -> F.Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(FOLDS))


def picked_rows(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = LABELLED) -> tuple[DataFrame, dict[int, int]]:
    """At most `most` labelled texts of each class outside the held-out fold (doc_id, text, label, calibrates), written, and how
    many labels each class has there."""
    open_ = labels.select("doc_id", F.col(label).alias("label")).where((fold("doc_id") != HELD_OUT) & F.col("label").isin(0, 1)).distinct()
    picked = None
    for c in (0, 1):
        part = open_.where(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        picked = part if picked is None else picked.unionByName(part)
    # The picked labels are at most 2 * most rows, so they may be broadcast.
    texts = docs.select("doc_id", "text").where(F.octet_length("text") > 0).join(F.broadcast(picked), "doc_id")
    found = texts.groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    part = F.floor(F.crc32(F.col("doc_id").cast("string").cast("binary")) / FOLDS) % 4
    counts = {r["label"]: r["n"] for r in open_.groupBy("label").agg(F.count("*").alias("n")).collect()}
    return stage(found.withColumn("calibrates", part == 0), "labelled"), counts


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = LABELLED) -> Model:
    """The model of labelled texts. The calibration weighs the sample's classes as they are among all labels."""
    rows, counts = picked_rows(docs, labels, label, most)
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = sizes.get(1, 0) / sum(sizes.values()) if sizes else 0.5
    if sizes and sum(counts.values()):
        share = counts.get(1, 0) / sum(counts.values())
    prior = float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))

    def extracts(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.int32()), pa.array([extract(t.as_py().encode()) for t in batch.column(2)], pa.binary())], names=["id", "label", "extract"])

    slim = rows.select(F.col("doc_id").cast("string").alias("id"), F.col("label").cast("int").alias("label"), "text", "calibrates")
    seen = sorted((r["id"], r["label"], bytes(r["extract"])) for r in map_arrow(slim.where("NOT calibrates").drop("calibrates"), extracts, "id string, label int, extract binary").collect())
    classes = [[e for _, c, e in seen if c == label] for label in (0, 1)]
    if not all(classes):
        return Model(b"", b"", 0.0, prior)
    bare = Model(*map(dictionary, classes), 0.0, 0.0)
    held = sorted((r["id"], r["label"], r["difference"]) for r in differences(slim.where("calibrates").drop("calibrates"), bare).collect())
    if len({c for _, c, _ in held}) < 2:
        return Model(b"", b"", 0.0, prior)
    y = np.array([c for _, c, _ in held])
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    return Model(bare.bad, bare.good, *calibrate(np.array([d for *_, d in held]), y, weight))


def differences(rows: DataFrame, model: Model) -> DataFrame:
    """id, label and difference of rows (id, label, text), over whole texts."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def make():
        scorer = Scorer(shared.value)
        return lambda batch: [pa.array([scorer.difference(t.as_py().encode()) for t in batch.column(2)], pa.float64())]

    return map_rows(rows, ["id", "label"], T.StructType([T.StructField("difference", T.DoubleType())]), make)


def score(docs: DataFrame, model: Model, *, text: str = "text", keep: list[str] | None = None, name: str | None = None) -> DataFrame:
    """keep (all columns by default) and the score, over whole texts, under name (score by default, with underscores before
    it if keep has that name)."""
    keep = docs.columns if keep is None else keep
    (name,) = free_names(keep, "score") if name is None else (name,)
    place = docs.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        scorer = Scorer(shared.value)
        return lambda batch: [pa.array([scorer.score((t.as_py() or "").encode()) for t in batch.column(place)], pa.float64())]

    return map_rows(docs, keep, T.StructType([T.StructField(name, T.DoubleType())]), make)


def digest(scored: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    return scored.select("doc_id", F.coalesce(fold("doc_id") == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
