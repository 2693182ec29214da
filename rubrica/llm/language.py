"""Language identification from averaged hashed subword embeddings and a linear softmax.

A text is lower-cased; its subwords are the runs of 1 to 4 bytes within words (with a mark on either
side of a word). Each run falls into one of DIM_BUCKETS rows of an embedding table; the average of
the rows goes through a linear softmax. Table and softmax are trained by stochastic gradient descent
in numpy. As everything up to the softmax is linear, a trained model is folded into one table of
class scores per bucket, and scoring is a count of buckets times that table.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rubrica.llm.common import held_out

DIM_BUCKETS = 1 << 14
#: Most documents that a model learns from: of each language, and in all (each language then gets an
#: equal share).
MOST_DOCS, MOST_DOCS_IN_ALL = 600, 24_000
#: Languages whose counts are broadcast, at most; more are joined by shuffle.
MOST_BROADCAST = 100_000
LETTER = re.compile(r"[^\W\d_]")
_NOISE = re.compile(rb"[\x00-\x40\x5b-\x60\x7b-\x7f]+")


def buckets(text: str) -> np.ndarray:
    """The bucket of each subword of one whole text, with repeats."""
    raw = _NOISE.sub(b" ", b" " + text.lower().encode("utf-8", "replace") + b" ")
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    out = []
    h = b + np.uint32(1)
    for n in range(1, 5):
        if n > 1:
            if len(b) < n:
                break
            h = h[:-1] * np.uint32(0x01000193) ^ b[n - 1 :]
        mixed = h * np.uint32(0x9E3779B1) + np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)
        mixed ^= mixed >> np.uint32(15)
        out.append(mixed & np.uint32(DIM_BUCKETS - 1))
    return np.concatenate(out)


def bucket_counts(text: str) -> np.ndarray:
    return np.bincount(buckets(text), minlength=DIM_BUCKETS)


@dataclass
class LanguageModel:
    names: list[str]
    table: np.ndarray  # (DIM_BUCKETS, classes): embeddings times the softmax weights
    bias: np.ndarray
    heat: float  # calibration: logits are divided by it
    reject_below: float  # a calibrated score below it is a rejection

    def scores(self, text: str) -> np.ndarray:
        at = buckets(text)
        if len(at) < DIM_BUCKETS:
            z = self.table.take(at, axis=0).sum(0)
        else:
            z = np.bincount(at, minlength=DIM_BUCKETS) @ self.table
        z = (z / max(1, len(at)) + self.bias) / self.heat
        e = np.exp(z - z.max())
        return e / e.sum()

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Name, score and whether the score is too low to rely on; 'und' without a letter."""
        if not text or not self.names or not LETTER.search(text):
            return "und", 0.0, True
        p = self.scores(text)
        k = int(p.argmax())
        return self.names[k], float(p[k]), bool(p[k] < self.reject_below)


class Counts:
    """Bucket counts of documents, sparse: of document i columns at[i] with shares share[i]."""

    def __init__(self, at: list[np.ndarray], n: list[np.ndarray]):
        self.at = at
        self.share = [x.astype(np.float32) / max(1, x.sum()) for x in n]

    def __len__(self) -> int:
        return len(self.at)

    def rows(self, which) -> tuple[np.ndarray, np.ndarray]:
        """The columns that some documents have, and their shares of these as a dense matrix."""
        cols, where = np.unique(np.concatenate([self.at[i] for i in which]), return_inverse=True)
        x, k = np.zeros((len(which), len(cols)), np.float32), 0
        for r, i in enumerate(which):
            x[r, where[k : k + len(self.at[i])]] = self.share[i]
            k += len(self.at[i])
        return cols, x


def fit(counts: Counts, y: np.ndarray, names: list[str], *, dim: int = 16, epochs: int = 12, rate: float = 0.5, batch: int = 32, seed: int = 7) -> LanguageModel:
    """SGD over documents' bucket counts. The last fifth of the shuffled documents is kept for calibration."""
    rng = np.random.default_rng(seed)
    classes = len(names)
    if not classes or not len(y):
        return LanguageModel([], np.zeros((DIM_BUCKETS, 0)), np.zeros(0), 1.0, 0.0)
    order = rng.permutation(len(y))
    held = order[: len(order) // 5] if len(order) >= 50 else order[:0]
    learn = order[len(held) :]
    emb = rng.normal(0, 0.1, (DIM_BUCKETS, dim)).astype(np.float32)
    weights, bias = rng.normal(0, 0.1, (dim, classes)).astype(np.float32), np.zeros(classes, np.float32)
    share = np.bincount(y[learn], minlength=classes)
    weight = (len(learn) / np.maximum(1, classes * share)).astype(np.float32)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        rng.shuffle(learn)
        for at in range(0, len(learn), batch):
            i = learn[at : at + batch]
            cols, xs = counts.rows(i)
            hidden = xs @ emb[cols]
            z = hidden @ weights + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(i)), y[i]] -= 1
            p *= weight[y[i]][:, None] / len(i)
            back = p @ weights.T
            weights -= step * (hidden.T @ p)
            bias -= step * p.sum(0)
            emb[cols] -= step * 40 * (xs.T @ back)  # inputs are averages, so rows see small gradients
    table = (emb @ weights).astype(np.float64)
    model = LanguageModel(names, table, bias.astype(np.float64), 1.0, 0.0)
    if len(held):
        z = np.stack([counts.share[i] @ table[counts.at[i]] for i in held]) + model.bias
        best = np.inf
        for heat in np.geomspace(0.05, 4, 40):
            e = np.exp((z - z.max(1, keepdims=True)) / heat)
            p = e / e.sum(1, keepdims=True)
            loss = -np.log(np.maximum(p[np.arange(len(held)), y[held]], 1e-12)).mean()
            if loss < best - 1e-9:
                best, model.heat = loss, float(heat)
                model.reject_below = float(np.clip(np.quantile(p.max(1), 0.005), 1 / classes, 0.6))
    return model


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most_docs: int = MOST_DOCS, most_in_all: int = MOST_DOCS_IN_ALL) -> LanguageModel:
    """Learns from texts with a language, of rows whose crc32(id as text) mod 3 is not 1.

    Of each language some documents are taken by hashes of their ids, each whole: `most_docs`, or
    fewer where the languages are so many that these were over `most_in_all`, but one of each. The
    ids that are broadcast and the bucket counts that the driver gets, which stay sparse, are bounded
    by that. Without rows every prediction is 'und'.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    rows = rows.select(F.col(id_col).alias("__id"), F.col(lang_col).alias("__lang"), F.xxhash64(id_col).alias("__h"), F.col(text_col).alias("__text"))
    # a hash share that leaves about twice as many rows of each language comes first, so that none of
    # them is ranked whole; the counts are a row for each language
    counts = rows.groupBy("__lang").agg(F.count(F.lit(1)).alias("__n"))
    languages = max(1, counts.count())
    each = max(1, min(most_docs, most_in_all // languages))
    few = rows.select("__id", "__lang", "__h").join(F.broadcast(counts) if languages <= MOST_BROADCAST else counts, "__lang")
    few = few.where(F.pmod(F.xxhash64(F.lit(11), "__id"), F.lit(1 << 40)).cast("double") * F.col("__n") <= F.lit(max(2.0 * each, each + 20.0) * (1 << 40)))
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("__lang").orderBy("__h", "__id")))
    chosen = ranked.where(F.col("rank") <= each).select("__id", "__lang").distinct()

    @F.pandas_udf("at binary, n binary")
    def counted(texts: pd.Series) -> pd.DataFrame:
        made = [bucket_counts(t) for t in texts]
        at = [np.flatnonzero(c) for c in made]
        return pd.DataFrame({"at": [a.astype(np.int32).tobytes() for a in at], "n": [c[a].astype(np.int32).tobytes() for c, a in zip(made, at, strict=True)]})

    found = rows.join(F.broadcast(chosen), ["__id", "__lang"], "left_semi").select("__id", F.col("__h").alias("h"), F.col("__lang").alias("lang"), F.xxhash64("__text").alias("t"), counted("__text").alias("c"))
    found = found.groupBy("__id", "lang", "h").agg(F.min_by("c", "t").alias("c"))  # of rows that share an id one teaches
    got = found.select("h", "lang", "c.at", "c.n").toPandas()
    got = got.sort_values(["lang", "h"], kind="stable")
    names = sorted(set(got["lang"]))
    made = Counts([np.frombuffer(a, np.int32) for a in got["at"]], [np.frombuffer(n, np.int32) for n in got["n"]])
    place = {v: i for i, v in enumerate(names)}
    return fit(made, np.array([place[v] for v in got["lang"]], int), names)


def predict(docs: DataFrame, model: LanguageModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, rejected) for every row of docs, from its whole text alone.

    Null texts and those without a letter are 'und' with score 0. Rows that repeat an id each have
    a row, null ids too. Other columns are not read. An empty table gives an empty result.
    """

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def named(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([model.predict(t) for t in texts], columns=["lang_pred", "score", "rejected"])

    made = docs.select(F.col(id_col).alias("__id"), named(F.col(text_col)).alias("p"))
    return made.select(F.col("__id").alias(id_col), "p.lang_pred", "p.score", "p.rejected")
