"""Language identification by a byte-level convolutional network.

Texts are cut into fixed-length windows that cover all of them. Filters of several widths are
max-pooled over a window and a softmax gives its languages; a document's answer is the mean over
its windows, weighted by their bytes. Fitted in numpy on a bounded sample of labelled rows.

One more output stands for text in none of the languages. It learns from made-up windows: letters
of other scripts, random bytes, and the sample's own windows with their letters shuffled. A document
is foreign if that output's share of it is nine tenths, and beyond what any document of the sample has.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytecnn import ByteCnn, grouped, outputs, softmax, trained
from .common import mapped, table
from .sampling import fold, thinned, windowed

LENGTH = 128
WIDTHS = {2: 12, 3: 12, 4: 12}
#: Bounds of the sample: documents of each language, windows of each document.
EACH, MOST_WINDOWS = 800, 12
UNKNOWN = "und"
#: Made-up windows for each window of the sample, and the least share of a document that may be called foreign.
MADE_SHARE, LEAST_FOREIGN = 0.2, 0.9
#: First and last code points of letters of other scripts, from the public code charts (fixed values).
SCRIPTS = [(0x0391, 0x03C9), (0x0410, 0x044F), (0x05D0, 0x05EA), (0x0621, 0x064A), (0x0905, 0x0939), (0x0E01, 0x0E2E), (0x3041, 0x3096), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3)]


def made_up(samples: np.ndarray, seed: int) -> np.ndarray:
    """Windows in no language, as many as MADE_SHARE of the given ones: a third each of other scripts, random bytes and shuffled letters."""
    rng = np.random.default_rng(seed)
    out = []
    for i in range(int(len(samples) * MADE_SHARE)):
        if i % 3 == 0:
            low, high = SCRIPTS[rng.integers(len(SCRIPTS))]
            text = "".join(chr(c) if rng.random() > 0.15 else " " for c in rng.integers(low, high + 1, LENGTH)).encode()[:LENGTH]
            row = np.frombuffer(text, np.uint8)
        elif i % 3 == 1:
            row = rng.integers(1, 256, LENGTH).astype(np.uint8)
        else:
            row = samples[rng.integers(len(samples))].copy()
            letters = (row | 32 >= 97) & (row | 32 <= 122) & (row < 128)
            row[letters] = rng.integers(97, 123, letters.sum()).astype(np.uint8)
        out.append(row)
    return np.array(out, np.uint8).reshape(-1, LENGTH)


def _each_window(pooled: np.ndarray, owner: np.ndarray):
    return pooled, lambda g: g


@dataclass
class Languages:
    net: ByteCnn | None
    names: list[str] = field(default_factory=list)
    bound: float = 1.0  # what a foreign text's share is above

    def shares(self, texts) -> np.ndarray:
        """What share of each text is in each language, and in none."""
        total, weight = np.zeros((len(texts), len(self.names) + 1)), np.zeros(len(texts))
        for numbers, x, starts in grouped([t.encode("utf-8", "surrogatepass") for t in texts], LENGTH, LENGTH):
            used = (x != 0).sum(1).astype(np.float64)
            p = softmax(outputs(self.net.pooled(x), self.net.dense, self.net.dense_bias)) * used[:, None]
            total[numbers] += np.add.reduceat(p, starts)
            weight[numbers] += np.add.reduceat(used, starts)
        return total / np.maximum(weight, 1)[:, None]

    def predict(self, texts, has_letter) -> tuple[list, list, list]:
        """The likeliest language, its share of what is in any, and whether the text is in none; `und` and 0 without letters."""
        names, scores, foreign = [UNKNOWN] * len(texts), [0.0] * len(texts), [True] * len(texts)
        some = [i for i, x in enumerate(has_letter) if x and self.names]
        shares = self.shares([texts[i] for i in some]) if self.net is not None else np.tile([1.0, 0.0], (len(some), 1))
        for i, row in zip(some, shares, strict=True):
            best = int(row[:-1].argmax())
            names[i], scores[i], foreign[i] = self.names[best], float(min(1.0, row[best] / max(1e-12, row[:-1].sum()))), bool(row[-1] > self.bound)
        return names, scores, foreign


def fit(rows: DataFrame, each: int = EACH) -> Languages:
    """rows: doc_id, text, lang; those without text or lang are left out."""
    some, counts = thinned(rows.where("text IS NOT NULL AND lang IS NOT NULL").select("doc_id", "text", "lang"), "lang", each)
    names = sorted(counts)
    if len(names) < 2:
        return Languages(None, names)
    samples, langs = windowed(some, "lang", LENGTH, LENGTH, MOST_WINDOWS)
    place = {k: i for i, k in enumerate(names)}
    y = np.array([place[x] for x in langs])
    net = ByteCnn(WIDTHS, len(names) + 1, sum(WIDTHS.values()), seed=21)
    owner = np.repeat(np.arange(len(y)), [len(s) for s in samples])
    every = np.concatenate(samples)
    none = made_up(every, seed=23)
    x, labels = np.concatenate([every, none]), np.concatenate([y[owner], np.full(len(none), len(names))])
    epochs = int(np.clip(60_000 // max(1, len(every)), 3, 30))
    trained(net, list(x[:, None, :]), labels, _each_window, epochs, batch=128, seed=22)
    # no document of the sample is foreign, and the bound lies halfway between them and a text that is foreign all through
    p = softmax(outputs(net.pooled(every), net.dense, net.dense_bias))[:, -1]
    of_document = np.bincount(owner, p) / np.bincount(owner)
    return Languages(net, names, max(LEAST_FOREIGN, (1 + float(of_document.max())) / 2))


def identified(docs: DataFrame, model: Languages, keep: list[str] = ["doc_id"], prefix: str = "") -> DataFrame:  # noqa: B006
    """The columns of `keep`, lang_pred, score and foreign (behind the prefix) of each row of docs; `und`, 0 and foreign if text is null or has no letter.

    foreign: the text is in none of the languages; lang_pred then is the one it is least unlike.
    Other columns are not read. A model without languages says `und`, one of a single language says
    that. Equal texts get equal answers, repeated rows stay, no rows give no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("__letter")
    docs = docs.select(*dict.fromkeys([*keep, "text"]), letter)
    return mapped(docs, keep, ["text", "__letter"], {f"{prefix}lang_pred": "string", f"{prefix}score": "double", f"{prefix}foreign": "boolean"}, lambda texts, letters: shared.value.predict(texts, letters))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of the whole documents table; rows whose crc32(doc_id) mod 4 is 2 are held out."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(fold(4) != 2))
    return identified(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model).select(
        "doc_id", F.coalesce(fold(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "foreign")
