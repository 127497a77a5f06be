"""Document quality by a factorisation machine.

A document is a sparse vector: its hashed words, plus structure statistics and size metadata that
are cut into quantile bins, each bin a feature. The machine gives every feature a weight and a
short vector; the sum over all pairs of features is 0.5 * sum_f((sum_i v_if x_i)^2 - sum_i (v_if
x_i)^2), so scoring is linear in the number of features.

Defined results: a null text is the empty text and is scored like it; repeated rows get equal
scores; with no labelled row of one class the score is that of the other class (1.0 with no
labels: nothing is rejected without evidence); an empty table gives an empty result. Extra columns
of the inputs are ignored. Whole texts are read, however long.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideflow.llm.common import class_rates, extended, fold, sigmoid, text_of, training_rows

TOKEN = re.compile(r"\S+")
PUNCTUATION = str.maketrans("", "", ".,;:!?\"'()")
SYMBOLS = "*#$%&|!@^~=+<>{}[]\\/_"


@dataclass(frozen=True)
class Settings:
    """most: labelled rows of each class that are fitted on."""

    word_buckets: int = 1 << 14
    bins: int = 12
    rank: int = 6
    most: int = 3000
    epochs: int = 12
    least_steps: int = 1500
    batch: int = 64
    rate: float = 0.08
    ridge: float = 2e-4
    threshold: float = 0.3


class Buckets(dict):
    """word -> bucket; forgets all at a million words, so long partitions stay small."""

    def __init__(self, count: int):
        super().__init__()
        self.count = count

    def __missing__(self, word: str) -> int:
        if len(self) >= 1_000_000:
            self.clear()
        bucket = self[word] = zlib.crc32(word.encode()) % self.count
        return bucket


def structure(text: str, tokens: list[str]) -> list[float]:
    """Structure statistics and size metadata of one text."""
    n, size = len(tokens), len(text)
    if not n:
        return [0.0] * 14
    lines = [x.strip() for x in text.split("\n") if x.strip()]
    letters = sum(map(len, tokens))
    symbols = sum(map(text.count, SYMBOLS))
    pairs = list(zip(tokens, tokens[1:]))
    return [
        float(np.log1p(size)),
        float(np.log1p(n)),
        letters / n,
        len(set(tokens)) / n,
        len(set(pairs)) / max(1, len(pairs)),
        1 - len(set(lines)) / len(lines),
        float(np.log1p(n / len(lines))),
        symbols / size,
        text.count("!") / n,
        text.count("|") / n,
        (text.count(".") + text.count("?")) / n,
        sum(map(text.count, "0123456789")) / size,
        sum(map(str.isupper, tokens)) / n,
        sum(a == b for a, b in pairs) / n,
    ]


def vectors(texts: list[str], settings: Settings, buckets: Buckets) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashed words as (index, value, row start) and structure statistics."""
    index, value, start, stats = [], [], [0], []
    for text in texts:
        tokens = TOKEN.findall(text)
        words = [buckets[w] for w in text.lower().translate(PUNCTUATION).split()]
        got, count = np.unique(np.array(words, dtype=np.int64), return_counts=True)
        weight = np.log1p(count)
        norm = np.sqrt((weight**2).sum()) or 1.0
        index.append(got)
        value.append(weight / norm)
        start.append(start[-1] + len(got))
        stats.append(structure(text, tokens))
    return np.concatenate([*index, np.zeros(0, np.int64)]), np.concatenate([*value, np.zeros(0)]), np.array(start), np.array(stats).reshape(len(texts), 14)


def summed(rows: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of rows, each on its own, so that they do not depend on the rows around; empty runs are 0."""
    out, filled = np.zeros((len(start) - 1, rows.shape[1])), np.diff(start) > 0
    if filled.any():
        out[filled] = np.add.reduceat(rows, start[:-1][filled], axis=0)
    return out


@dataclass(frozen=True)
class Model:
    settings: Settings
    edges: np.ndarray | None = None  # (statistics, bins - 1)
    bias: float = 0.0
    linear: np.ndarray | None = None
    factors: np.ndarray | None = None
    constant: float | None = None

    def design(self, texts: list[str], buckets: Buckets):
        """Index, value and row start with the statistics' bins appended to the words."""
        index, value, start, stats = vectors(texts, self.settings, buckets)
        extra = binned(stats, self.edges, self.settings)
        return merged(index, value, start, extra, self.edges.shape[0])

    def margin(self, index, value, start) -> np.ndarray:
        weighted = self.factors[index] * value[:, None]
        both = summed(np.c_[self.linear[index] * value, weighted, weighted**2], start)
        k = self.settings.rank
        return self.bias + both[:, 0] + 0.5 * (both[:, 1 : 1 + k] ** 2 - both[:, 1 + k :]).sum(1)

    def score(self, texts: list[str], buckets: Buckets) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        # rounded, so that a row's score does not depend on the batch that it is in
        return np.round(sigmoid(self.margin(*self.design(texts, buckets))), 9)


def binned(stats: np.ndarray, edges: np.ndarray, settings: Settings) -> np.ndarray:
    columns = [settings.word_buckets + j * settings.bins + np.searchsorted(edges[j], stats[:, j], side="right") for j in range(edges.shape[0])]
    return np.stack(columns, axis=1) if columns else np.zeros((len(stats), 0), np.int64)


def merged(index, value, start, extra, width: int):
    lengths = np.diff(start)
    place = np.repeat(np.arange(len(lengths)) * width, lengths) + np.arange(len(index))
    total = len(index) + extra.size
    out_index, out_value, own = np.empty(total, np.int64), np.full(total, 1.0 / np.sqrt(max(1, width))), np.zeros(total, bool)
    own[place] = True
    out_index[place], out_value[place] = index, value
    out_index[~own] = extra.ravel()
    return out_index, out_value, start + np.arange(len(start)) * width


def fit(rows: pd.DataFrame, settings: Settings) -> Model:
    """Minibatch Adagrad on the log loss; classes weigh the same, then the bias returns to the prior of all training rows that the sample stands for."""
    rows = rows.sort_values("id")
    y = rows.label.to_numpy(float)
    if not len(y) or y.min() == y.max():
        return Model(settings, constant=float(y[0]) if len(y) else 1.0)
    index, value, start, stats = vectors(rows.text.tolist(), settings, Buckets(settings.word_buckets))
    quantiles = np.linspace(0, 1, settings.bins + 1)[1:-1]
    edges = np.stack([np.quantile(stats[:, j], quantiles) for j in range(stats.shape[1])])
    index, value, start = merged(index, value, start, binned(stats, edges, settings), edges.shape[0])
    size, k = settings.word_buckets + edges.size + edges.shape[0], settings.rank
    rng = np.random.default_rng(0)
    linear, factors, bias = np.zeros(size), rng.normal(0, 0.05, (size, k)), 0.0
    seen_linear, seen_factors = np.full(size, 1e-3), np.full((size, k), 1e-3)
    balance = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    for _ in range(max(settings.epochs, -(-settings.least_steps * settings.batch // len(y)))):
        order = rng.permutation(len(y))
        for at in range(0, len(order), settings.batch):
            part = order[at : at + settings.batch]
            spans = [np.arange(start[i], start[i + 1]) for i in part]
            take = np.concatenate(spans)
            local = np.r_[0, np.cumsum([len(s) for s in spans])]
            i, v = index[take], value[take]
            model = Model(settings, edges, bias, linear, factors)
            error = balance[part] * (sigmoid(model.margin(i, v, local)) - y[part]) / len(part)
            row = np.repeat(np.arange(len(part)), np.diff(local))
            weighted = factors[i] * v[:, None]
            sums = summed(weighted, local)
            g_linear = np.bincount(i, error[row] * v, size)
            each = (error[row] * v)[:, None] * (sums[row] - weighted)
            touched, back = np.unique(i, return_inverse=True)
            g_factors = np.stack([np.bincount(back, each[:, f], len(touched)) for f in range(k)], axis=1) + settings.ridge * factors[touched]
            g_linear = g_linear[touched] + settings.ridge * linear[touched]
            seen_linear[touched] += g_linear**2
            seen_factors[touched] += g_factors**2
            linear[touched] -= settings.rate * g_linear / np.sqrt(seen_linear[touched])
            factors[touched] -= settings.rate * g_factors / np.sqrt(seen_factors[touched])
            bias -= settings.rate * float(error.sum())
    low, high = class_rates(rows)
    return Model(settings, edges, bias + float(np.log(high * y.mean() / (low * (1 - y.mean())))), linear, factors)


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Fitted on the driver from at most 2 x settings.most labelled documents."""
    rows = training_rows(docs, labels, "quality", settings.most).toPandas()
    return fit(rows, settings)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; the model is about 1 MB."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "text")
    return scored(rows, model).drop("text")


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score and predicted appended; columns of docs that have those names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model, buckets = shared.value, Buckets(shared.value.settings.word_buckets)

        def work(part):
            value = model.score(part.column("__text").to_pylist(), buckets)
            return [value, (value >= model.settings.threshold).astype("int32")]

        return work

    return extended(docs.drop("score", "predicted").withColumn("__text", text_of("text")), "score double, predicted int", make)


def kept(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that the classifier accepts, with docs' own columns; no row is matched by an id."""
    renamed = docs.select(*[F.col(f"`{n}`").alias(f"__own_{n}") for n in docs.columns], F.col("text"))
    return scored(renamed, model).where(F.col("predicted") == 1).select(*[F.col(f"`__own_{n}`").alias(n) for n in docs.columns])
