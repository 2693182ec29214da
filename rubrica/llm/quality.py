"""Quality scores from a generalised additive model with pairwise terms.

Each feature has a lookup table over its bins, learned by cyclic boosting of shallow trees on the
log-odds; the strongest pairs get tables of their own afterwards. A score is the logistic of a sum of
table entries, so scoring is a few vectorised lookups per batch of documents.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rubrica.llm.common import held_out

FEATURES = (
    "log_bytes", "log_words", "mean_word", "upper", "digits", "signs", "bangs", "bars", "stops", "lines",
    "non_ascii", "distinct_words", "stutter", "top_word", "longest_line", "byte_entropy", "title_words",
)
#: Most labelled rows that a model learns from; they are chosen by the hash of their id.
MOST_ROWS = 20_000


def text_features(text: str | None) -> list[float]:
    """FEATURES of one whole text; null and empty texts have zeros."""
    raw = (text or "").encode("utf-8", "replace")
    if not raw:
        return [0.0] * len(FEATURES)
    n = len(raw)
    c = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    p = c[c > 0] / n
    words = raw.split()
    m = max(1, len(words))
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = raw.split(b"\n")
    letters = max(1, int(c[65:91].sum() + c[97:123].sum()))
    of = lambda s: float(sum(c[b] for b in s)) / n
    return [
        np.log1p(n), np.log1p(len(words)), n / m, float(c[65:91].sum()) / letters, float(c[48:58].sum()) / n,
        of(b"#$%&*@^~_<>{}[]\\"), of(b"!?"), of(b"|"), of(b".,;:"), len(lines) / m, float(c[128:].sum()) / n,
        len(counts) / m, sum(a == b for a, b in zip(words, words[1:], strict=False)) / m, max(counts.values(), default=0) / m,
        np.log1p(max(map(len, lines))), float(-(p * np.log2(p)).sum()), sum(w[:1].isupper() for w in words) / m,
    ]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, l2: float, least: float) -> np.ndarray:
    """Step of each bin by a tree of at most `leaves` leaves over ordered bins, best gain first."""
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    worth = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + l2)
    parts = [(0, len(g))]
    for _ in range(leaves - 1):
        best = (1e-9, None)
        for a, b in parts:
            if b - a > 1:
                k = np.arange(a + 1, b)
                gain = worth(a, k) + worth(k, b) - worth(a, b)
                gain = np.where((ch[k] - ch[a] >= least) & (ch[b] - ch[k] >= least), gain, 0)
                if (top := int(gain.argmax())) >= 0 and gain[top] > best[0]:
                    best = (gain[top], (a, int(k[top]), b))
        if best[1] is None:
            break
        a, k, b = best[1]
        parts.remove((a, b))
        parts += [(a, k), (k, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + l2)
    return out


@dataclass
class AdditiveModel:
    """Bins and lookup tables; `score` is all that the executors need."""

    edges: list[np.ndarray]
    base: float = 0.0
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], 1)

    def margin(self, bins: np.ndarray) -> np.ndarray:
        z = np.full(len(bins), self.base)
        for j, t in enumerate(self.tables):
            z += t[bins[:, j]]
        for (a, b), t in zip(self.pairs, self.pair_tables, strict=True):
            z += t[bins[:, a], bins[:, b]]
        return z

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.margin(self.bins(x))) if len(x) else np.empty(0)


def fit(x: np.ndarray, y: np.ndarray, *, n_bins: int = 48, rounds: int = 160, pair_rounds: int = 40, n_pairs: int = 6, leaves: int = 4, rate: float = 0.15, l2: float = 1.0, least: float = 3.0) -> AdditiveModel:
    """Main effects first, in cycles over all features; then the pairs whose tables still gain most.

    Without rows, or with one class only, the model is the constant rate (0.5 without rows).
    """
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, n_bins + 1)[1:-1])) if len(x) else np.empty(0) for j in range(x.shape[1])]
    model = AdditiveModel(edges)
    rate_1 = (y.sum() + 0.5) / (len(y) + 1)
    model.base = float(np.log(rate_1 / (1 - rate_1)))
    bins = model.bins(x) if len(x) else np.zeros((0, x.shape[1]), int)
    sizes = [len(e) + 1 for e in edges]
    model.tables = [np.zeros(s) for s in sizes]
    if not len(x) or y.min() == y.max():
        return model
    z = model.margin(bins)
    for _ in range(rounds):
        for j, s in enumerate(sizes):
            p = _sigmoid(z)
            step = rate * _tree(np.bincount(bins[:, j], y - p, s), np.bincount(bins[:, j], p * (1 - p), s), leaves, l2, least)
            model.tables[j] += step
            z += step[bins[:, j]]
    p = _sigmoid(z)
    g, h, gains = y - p, p * (1 - p), []
    coarse = [np.minimum(bins[:, j] * 8 // s, 7) for j, s in enumerate(sizes)]
    for a, b in combinations(range(len(sizes)), 2):
        cell = coarse[a] * 8 + coarse[b]
        gg, hh = np.bincount(cell, g, 64), np.bincount(cell, h, 64)
        gains.append(((gg**2 / (hh + 5 * l2)).sum(), a, b))
    for _, a, b in sorted(gains, reverse=True)[:n_pairs]:
        table = np.zeros((sizes[a], sizes[b]))
        for k in range(pair_rounds):
            # a shallow tree: one axis is cut first, then each side along the other axis
            p = _sigmoid(z)
            g, h = y - p, p * (1 - p)
            u, v = (a, b) if k % 2 == 0 else (b, a)
            side = _tree(np.bincount(bins[:, u], g, sizes[u]), np.bincount(bins[:, u], h, sizes[u]), 2, l2, least)
            step = np.zeros((sizes[u], sizes[v]))
            for value in np.unique(side):
                rows = side[bins[:, u]] == value
                step[side == value] = rate * _tree(np.bincount(bins[rows, v], g[rows], sizes[v]), np.bincount(bins[rows, v], h[rows], sizes[v]), 2, l2, least)
            table += step if u == a else step.T
            z += step[bins[:, u], bins[:, v]]
        model.pairs.append((a, b))
        model.pair_tables.append(table)
    return model


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def features(texts: pd.Series) -> pd.Series:
    """FEATURES of each text, as a column."""
    return pd.Series([text_features(t) for t in texts], dtype=object)


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most_rows: int = MOST_ROWS) -> AdditiveModel:
    """A model of labels.quality from labelled rows whose crc32(id as text) mod 3 is not 1.

    Of these rows at most `most_rows` are taken, by the order of a hash of their ids; that bound is
    what may be broadcast and what the driver gets (17 numbers a row). Null labels and ids, and
    labels other than 0 and 1, teach nothing; of labels that repeat an id the least counts, and of
    documents that do one teaches.
    """
    rows = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col))
    rows = rows.groupBy(F.col(id_col).alias("__id")).agg(F.min(label_col).alias("__y")).withColumn("__h", F.xxhash64("__id"))
    # a hash share that leaves about twice as many comes first, so that no task sorts more than its part of these
    count = max(1, rows.count())
    rows = rows.where(F.pmod(F.xxhash64(F.lit(11), "__id"), F.lit(1 << 40)).cast("double") * count <= 2.0 * most_rows * (1 << 40))
    chosen = rows.orderBy("__h", "__id").limit(most_rows).drop("__h")
    found = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(chosen), "__id")
    # of rows that share an id one teaches, so that the driver gets no more rows than were chosen
    made = found.select("__id", "__y", F.xxhash64("__text").alias("__h"), features("__text").alias("x")).groupBy("__id", "__y").agg(F.min_by("x", "__h").alias("x"))
    got = made.toPandas().sort_values("__id", kind="stable")
    x = np.array(got["x"].tolist(), float).reshape(-1, len(FEATURES))
    return fit(x, got["__y"].to_numpy(float))


def with_score(docs: DataFrame, model: AdditiveModel, *, text_col: str = "text", name: str = "score") -> DataFrame:
    """docs and a column of scores, each from a whole text alone; null counts as empty.

    All rows stay, with repeated or null ids too; a column that already has the name is replaced. An
    empty table gives an empty result.
    """

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array([text_features(t) for t in texts], float).reshape(-1, len(FEATURES))))

    return docs.withColumn(name, scored(F.col(text_col)))
