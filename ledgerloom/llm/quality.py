"""Quality scores by a byte-level convolutional network.

A document is cut into overlapping chunks that cover all of it. Filters over bytes (and over the
padding of the last chunk, by which short texts are known) are max-pooled in each chunk; the mean and the maximum over the chunks go into one logistic unit. The network
is fitted in numpy on a bounded sample of labelled rows; the odds are set back to those of all
labelled rows of the training folds.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytecnn import ByteCnn, grouped, outputs, trained
from .common import mapped, table
from .sampling import fold, thinned, windowed

CHUNK, STRIDE = 256, 192
WIDTHS = {3: 8, 6: 16}
#: Bounds of the sample: documents of each label, chunks of each document.
EACH, MOST_CHUNKS = 2000, 12
THRESHOLD = 0.3


def _spread(pooled: np.ndarray, owner: np.ndarray):
    starts = np.flatnonzero(np.diff(owner, prepend=-1))
    counts = np.diff(np.append(starts, len(owner)))
    mean, most = np.add.reduceat(pooled, starts) / counts[:, None], np.maximum.reduceat(pooled, starts)
    f = pooled.shape[1]

    def back(g: np.ndarray) -> np.ndarray:
        is_most = pooled == most[owner]
        return (g[:, :f] / counts[:, None])[owner] + g[:, f:][owner] * is_most / np.add.reduceat(is_most, starts)[owner]

    return np.concatenate([mean, most], 1), back


@dataclass
class Quality:
    net: ByteCnn | None
    shift: float  # added to the log odds of label 1

    def scores(self, texts) -> np.ndarray:
        if self.net is None:
            return np.full(len(texts), 0.5 if self.shift == 0 else 1 / (1 + np.exp(-self.shift)))
        f = len(self.net.bias)
        total, most, count = np.zeros((len(texts), f)), np.zeros((len(texts), f)), np.zeros(len(texts))  # rectified: nothing is below 0
        for numbers, x, starts in grouped([(t or "").encode("utf-8", "surrogatepass") for t in texts], CHUNK, STRIDE):
            pooled = self.net.pooled(x).astype(np.float64)
            total[numbers] += np.add.reduceat(pooled, starts)
            most[numbers] = np.maximum(most[numbers], np.maximum.reduceat(pooled, starts))
            count[numbers] += np.diff([*starts, len(x)])
        z = outputs(np.concatenate([total / np.maximum(count, 1)[:, None], most], 1), self.net.dense, self.net.dense_bias)
        return 1 / (1 + np.exp(-np.clip(z[:, 1] - z[:, 0] + self.shift, -60, 60)))


def fit(docs: DataFrame, labels: DataFrame, each: int = EACH) -> Quality:
    """A model from docs (doc_id, text) and labels (doc_id, quality: 0 or 1).

    A document marked twice counts with its lowest mark; null marks and ids are left out. Without
    labels every score is 0.5; with labels of one kind only it is 0.02 or 0.98.
    """
    marks = labels.where("quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    some, counts = thinned(marks, "quality", each)
    if len(counts) < 2:
        return Quality(None, 0.0 if not counts else (4.0 if 1 in counts else -4.0))
    # about `each` rows of two labels: a side of bounded size
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")
    samples, y = windowed(rows, "quality", CHUNK, STRIDE, MOST_CHUNKS)
    y = np.array(y, int)
    if len(set(y)) < 2:
        return Quality(None, 0.0)
    net = ByteCnn(WIDTHS, 2, 2 * sum(WIDTHS.values()), seed=11, sees_padding=True)
    epochs = int(np.clip(20_000 // max(1, len(y)), 6, 40))
    trained(net, samples, y, _spread, epochs, batch=32, seed=12)
    return Quality(net, float(np.log(counts[1] / counts[0]) - np.log((y == 1).sum() / (y == 0).sum())))


def scored(docs: DataFrame, model: Quality) -> DataFrame:
    """doc_id and score (0 to 1) of each row of docs (doc_id, text; other columns are not read).

    A null text counts as empty; an empty text is one chunk of padding. Equal texts score alike, repeated rows stay, no rows give no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size

    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id"], ["text"], {"score": "double"}, lambda texts: [shared.value.scores(texts)])


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the whole documents table; labels whose crc32(doc_id) mod 5 is 0 are held out."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels").where(fold(5) != 0))
    return scored(docs, model).select(
        "doc_id", F.coalesce(fold(5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
