"""Toxicity by compression distance.

A document is cut into windows of several words. Two zstandard dictionaries, trained on whole windows
of ordinary and of toxic text, compress each window, and the mean difference of the lengths is a feature.
A toxic text is mostly ordinary words, so that this alone tells little (the README has figures). Therefore a second pair looks at windows of one word: the
ordinary dictionary against the same one followed by a dictionary of the parts of toxic text that recur
there and are rare in ordinary text. The bytes that this saves, in all windows and in those that it
covers whole (their compressed length is that of most of its own words), are counted at several
thresholds over the whole text. All features are calibrated to a probability on labelled rows that no
dictionary has seen.

Defined results: a null text is the empty text and is scored like it; repeated rows get equal
scores; with no labelled row of one class the score is that of the other class (0 or 1 for a
table with one class, 0.0 with no labels); an empty table gives an empty result. Extra columns of
the inputs are ignored. Windows are taken over the whole text, however long it is.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, replace
from itertools import chain

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideflow.llm.common import class_rates, extended, fold, logistic, logistic_score, text_of, training_rows

WORD = re.compile(r"\w+")
GAINS = (2, 3, 4, 5, 6, 7)
#: Stands before every scored window and in both dictionaries: its match pays for a block's fixed
#: bytes, so that even one word's savings show in the compressed length.
LEAD = bytes(range(1, 32)) + bytes(range(224, 255))
#: Stands after every scored window: the matcher starts no match in a block's last eight bytes.
TAIL = bytes(range(128, 137))


@dataclass(frozen=True)
class Settings:
    """most: labelled rows of each class that are fitted on. toxic_weight: a toxic row's weight in the calibration.
    most_share: shares of a text's windows count up to this, so that very short texts are not off the scale.
    class_bytes: size of each of the two dictionaries for windows of ordinary_window_words words.
    toxic_bytes: least size of the toxic dictionary, which grows with its words. most_samples: windows of the bounded
    training rows that the ordinary dictionary is trained on, drawn at random from all of them."""

    window_words: int = 1
    ordinary_window_words: int = 8
    ordinary_bytes: int = 16384
    class_bytes: int = 16384
    toxic_bytes: int = 4096
    level: int = 13
    least_contexts: int = 3
    least_ratio: float = 20.0
    most: int = 2000
    most_samples: int = 30000
    toxic_weight: float = 2.0
    ridge: float = 3.0
    most_share: float = 0.05
    threshold: float = 0.5


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def phrases(words: list[str], size: int) -> list[str]:
    return words if size == 1 else [" ".join(words[i : i + size]) for i in range(0, len(words), size)]


def windows(words: list[str], size: int, lead: bytes = b"", tail: bytes = b"") -> list[bytes]:
    return [lead + f" {x} ".encode() + tail for x in phrases(words, size)]


def surroundings(texts: list[str]) -> Counter:
    """In how many different pairs of neighbours each word stands; copies of a text add nothing."""
    around = set()
    for text in texts:
        words = ["", *words_of(text), ""]
        around.update(zip(words, words[1:], words[2:]))
    return Counter(w for _, w, _ in around)


def compressor(content: bytes, level: int, kind: int = zstandard.DICT_TYPE_RAWCONTENT):
    """Compresses one window with a dictionary; no header bytes that all windows share."""
    parameters = zstandard.ZstdCompressionParameters.from_level(level, write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
    if not content:
        return zstandard.ZstdCompressor(compression_params=parameters).compress
    dictionary = zstandard.ZstdCompressionDict(content, dict_type=kind)
    dictionary.precompute_compress(compression_params=parameters)
    return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=parameters).compress


class Gains(dict):
    """A window, or the phrase in it -> (bytes that the toxic dictionary saves, compressed length with it); forgets all
    at half a million windows."""

    def __init__(self, plain, marked, of_class):
        super().__init__()
        self.plain, self.marked, self.of_class = plain, marked, of_class

    def leaning(self, cut: list[bytes]) -> float:
        """How much shorter the toxic class's dictionary makes a window of several words, the mean."""
        ordinary, toxic = self.of_class
        return (sum(map(len, map(ordinary, cut))) - sum(map(len, map(toxic, cut)))) / len(cut)

    def __missing__(self, key: bytes | str) -> tuple[int, int]:
        if len(self) >= 500_000:
            self.clear()
        window = key if isinstance(key, bytes) else windows([key], 1, LEAD, TAIL)[0]
        length = len(self.marked(window))
        self[key] = value = (len(self.plain(window)) - length, length)
        return value

    def of(self, distinct: Counter) -> np.ndarray:
        """Gains and lengths of the phrases, in their order."""
        return np.fromiter(chain.from_iterable(map(self.__getitem__, distinct)), np.int64, 2 * len(distinct)).reshape(-1, 2).T


def trained(samples: list[bytes], size: int, level: int) -> bytes:
    """A zstandard dictionary; too few samples for the trainer: the samples themselves."""
    try:
        return zstandard.train_dictionary(size, samples, level=level).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[-size:]


@dataclass(frozen=True)
class Model:
    settings: Settings
    ordinary: bytes = b""
    toxic: bytes = b""
    classes: tuple[bytes, bytes] = (b"", b"")  # trained on windows of several words, ordinary and toxic
    whole: int = 0  # compressed length of a window that the toxic dictionary covers
    calibration: tuple | None = None
    constant: float | None = None

    def gains(self) -> Gains:
        level, kind = self.settings.level, zstandard.DICT_TYPE_AUTO
        of_class = [compressor(x, level, kind) for x in self.classes]
        return Gains(compressor(self.ordinary, level), compressor(self.ordinary + self.toxic, level), of_class)

    def features(self, texts: list[str], gains: Gains) -> np.ndarray:
        """Each distinct window of a text is looked up once, and counts as often as it stands there."""
        n, least = len(GAINS), np.array(GAINS)[:, None]
        rows = np.zeros((len(texts), 6 + 4 * n))
        for k, text in enumerate(texts):
            words = words_of(text)
            distinct = Counter(phrases(words, self.settings.window_words))
            if not distinct:
                continue
            rows[k, -1] = gains.leaning(windows(words, self.settings.ordinary_window_words))
            gain, length = gains.of(distinct)
            times = np.fromiter(distinct.values(), np.int64, len(distinct))
            covered, total = np.where(length <= self.whole, gain, 0), times.sum()
            top = np.sort(np.repeat(covered, np.minimum(times, 2)))[::-1][:2]
            rows[k, :3] = np.log1p(total), gain @ times / total, covered @ times / total
            rows[k, 3 : 3 + len(top)] = top
            counts = np.concatenate([(x >= least) @ times for x in (gain, covered)])
            rows[k, 5 : 5 + 2 * n] = np.log1p(counts)
            rows[k, 5 + 2 * n : 5 + 4 * n] = np.minimum(counts / total, self.settings.most_share)
        return rows

    def score(self, texts: list[str], gains: Gains) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        return logistic_score(self.calibration, self.features(texts, gains))


def fit(rows: pd.DataFrame, settings: Settings) -> Model:
    """rows: text, label, id, and stands_for if they are a sample. Even rows of each class train the dictionaries, odd ones the calibration."""
    classes = [rows[rows.label == k].sort_values("id").text.tolist() for k in (0, 1)]
    if min(map(len, classes)) < 2:
        return Model(settings, constant=float(len(classes[1]) > 0 and len(classes[0]) == 0))
    (ordinary, clean), (toxic, bad) = ((c[::2], c[1::2]) for c in classes)
    samples = []
    for texts in (ordinary, toxic):
        cut = [w for text in texts for w in windows(words_of(text), settings.ordinary_window_words)]
        samples.append([cut[i] for i in np.random.default_rng(0).permutation(len(cut))[: settings.most_samples]])
    least = min(map(len, samples))  # as much text of either class, so that neither dictionary knows more words
    of_class = tuple(trained(x[:least], settings.class_bytes, settings.level) for x in samples)
    base = LEAD + trained(samples[0], settings.ordinary_bytes, settings.level)
    seen = [surroundings(texts) for texts in (ordinary, toxic)]
    total = [max(1, sum(s.values())) for s in seen]
    least = max(2, min(settings.least_contexts, len(toxic) // 4))
    recurring = [(w, n) for w, n in sorted(seen[1].items()) if n >= least and n / total[1] >= settings.least_ratio * (seen[0][w] + 0.25) / total[0]]
    marks = [f" {w} ".encode() for w, n in recurring for _ in range(n)]
    if marks:
        size = max(settings.toxic_bytes, 2 * sum(map(len, dict.fromkeys(marks))))  # room for every word
        copies = marks * (1 + 4 * size // sum(map(len, marks)))
        learned = trained(copies, size, settings.level)
        # the trainer leaves out words that lie close to others; they stand before what it chose
        model = Model(settings, base, b"".join(x for x in dict.fromkeys(marks) if x not in learned) + learned, of_class)
        lengths = Counter(length for _, length in map(model.gains().__getitem__, (LEAD + x + TAIL for x in dict.fromkeys(marks))))
        model = replace(model, whole=lengths.most_common(1)[0][0])
    else:
        model = Model(settings, base, b"", of_class)
    x = model.features(clean + bad, model.gains())
    y = np.r_[np.zeros(len(clean)), np.ones(len(bad))]
    plain, marked = class_rates(rows)
    return replace(model, calibration=logistic(x, y, settings.toxic_weight * marked / plain, settings.ridge))


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Fitted on the driver from at most 2 x settings.most labelled documents."""
    rows = training_rows(docs, labels, "toxic", settings.most).toPandas()
    return fit(rows, settings)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; the model is some 60 KB."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = shared.value
        gains = model.gains()

        def work(part):
            value = model.score(part.column("__text").to_pylist(), gains)
            return [value, (value >= model.settings.threshold).astype("int32")]

        return work

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), text_of("text").alias("__text"))
    return extended(rows, "score double, predicted int", make)
