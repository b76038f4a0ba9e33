"""Toxicity by compression distance.

One zstandard dictionary is trained on ordinary text; another holds the stretches of toxic text whose
byte six-grams are significantly more frequent in toxic texts than in ordinary ones, as the rest of a
toxic text is ordinary too.
Every window of a text is compressed with the ordinary dictionary alone and with the toxic one
beside it: the difference in length says how much the window looks like what only toxic texts hold.

Calibration, on each fold of the labelled documents with dictionaries of the other folds: how much likelier each difference is
in toxic than in ordinary documents, then a logistic curve over the mean and the best run of these
log ratios.  Labels come from a bounded sample, dictionaries from a stretch of each of its texts; the
curve sees its texts whole, in the tasks, and every text is scored whole, where it is read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrytrace.llm.common import chunks, ids_and_text

WINDOW = 96
LEVEL = 9
GRAM = 6
ORDINARY_DICTIONARY = 16384
# The labelled sample: documents of each class (about), and code points of each document at most.
DOCS_PER_CLASS = 8000
SAMPLE_CHARS = 6000
# A six-gram marks toxic text when it is so many times as frequent there as in ordinary texts, and the
# difference is larger than chance gives any of the six-grams that were tested.
ENRICHED = 3
# Each fold is calibrated with dictionaries of the others.
FOLDS = 4
LOWEST, HIGHEST = -6, 24

_FACTOR, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def windows(data: bytes) -> list[bytes]:
    return [data[i : i + WINDOW] for i in range(0, len(data), WINDOW)]


def _grams(data: bytes) -> np.ndarray:
    """24-bit hashes of all six-grams."""
    values = np.frombuffer(data, np.uint8).astype(np.uint64)
    found = np.zeros(max(len(values) - GRAM + 1, 0), np.uint64)
    for i in range(GRAM if len(found) else 0):
        found = found * _FACTOR + values[i : i + len(found)]
    return (((found ^ (found >> np.uint64(29))) * _MIX) >> np.uint64(40)).astype(np.int64)


def gram_counts(texts: list[bytes]) -> np.ndarray:
    """In how many of the texts each six-gram occurs."""
    counts = np.zeros(1 << 24, np.uint16)
    for text in texts:
        counts[np.unique(_grams(text))] += 1
    return counts


def marked_stretches(data: bytes, marks: np.ndarray) -> list[bytes]:
    """The stretches of a text whose six-grams are marked."""
    inside = marks[_grams(data)]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    return [data[a : b + GRAM - 1] for a, b in zip(edges[::2], edges[1::2], strict=True)]


def toxic_marks(marked: np.ndarray, plain: np.ndarray, toxic: int, ordinary: int) -> np.ndarray:
    """Which six-grams mark toxic text, by the likelihood ratio of their counts in so many toxic and
    ordinary texts (a Bonferroni bound: by chance less than one is found)."""
    marks = np.zeros(len(marked), bool)
    at = np.flatnonzero(marked)
    m, p = marked[at].astype(float), plain[at].astype(float)
    expected = (m + p) * toxic / max(toxic + ordinary, 1)
    ratio = 2 * (m * np.log(m / expected) + p * np.log(np.maximum(p, 1e-9) / np.maximum(m + p - expected, 1e-9)))
    marks[at] = (ratio > 2 * np.log(max(len(at), 2))) & (m * ordinary > ENRICHED * p * toxic)
    return marks


def toxic_dictionary(texts: list[bytes], marks: np.ndarray) -> bytes:
    """Marked stretches of the texts, the most frequent first, until every mark is in."""
    found = Counter(s for t in texts for s in marked_stretches(t, marks))
    left, kept = marks.copy(), []
    for stretch, _ in sorted(found.items(), key=lambda x: (-x[1], x[0])):
        grams = _grams(stretch)
        if left[grams].any():
            left[grams] = False
            kept.append(stretch)
    return b"".join(kept)


def without_marks(data: bytes, marks: np.ndarray) -> bytes:
    """The text without its marked stretches."""
    hit = np.flatnonzero(marks[_grams(data)])
    if not len(hit):
        return data
    keep = np.ones(len(data), bool)
    for i in range(GRAM):
        keep[hit + i] = False
    return np.frombuffer(data, np.uint8)[keep].tobytes()


def ordinary_dictionary(texts: list[bytes], marks: np.ndarray) -> bytes:
    """A trained dictionary of the texts without marks, as those of long ordinary words would hide
    what the toxic dictionary saves; of too few samples, simply their end."""
    kept = [without_marks(t, marks) for t in texts]
    samples = [t[i : i + 400] for t in kept for i in range(0, len(t), 400)]
    try:
        return zstandard.train_dictionary(ORDINARY_DICTIONARY, samples, k=48, d=6).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-ORDINARY_DICTIONARY:]


@dataclass
class ToxicModel:
    """Two dictionaries, the log ratio of each length difference, and the logistic curve."""

    ordinary: bytes
    toxic: bytes
    ratios: np.ndarray = field(default_factory=lambda: np.zeros(HIGHEST - LOWEST + 1))
    curve: np.ndarray = field(default_factory=lambda: np.zeros(4))  # weights of the summary, and the constant
    scale: np.ndarray = field(default_factory=lambda: np.ones(3))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "compressors"}

    @cached_property
    def compressors(self) -> list[zstandard.ZstdCompressor]:
        made = []
        for content in (self.ordinary, self.toxic + self.ordinary):
            if not content:
                made.append(zstandard.ZstdCompressor(level=LEVEL, write_content_size=False))
                continue
            shared = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            shared.precompute_compress(level=LEVEL)
            made.append(
                zstandard.ZstdCompressor(
                    level=LEVEL, dict_data=shared, write_content_size=False, write_dict_id=False, write_checksum=False
                )
            )
        return made

    def differences(self, data: bytes) -> np.ndarray:
        """By window: bytes saved by the toxic dictionary."""
        plain, toxic = (c.compress for c in self.compressors)
        found = [len(plain(w)) - len(toxic(w)) for w in windows(data)]
        return np.clip(np.array(found, int), LOWEST, HIGHEST) - LOWEST

    def summary(self, differences: np.ndarray) -> np.ndarray:
        """Mean log ratio, the best run of windows (which no length dilutes), and the number of windows
        as a logarithm, as longer texts have better runs by chance."""
        if not len(differences):
            return np.zeros(3)
        values = self.ratios[differences]
        sums = np.concatenate([[0], values.cumsum()])
        best = (sums - np.minimum.accumulate(sums)).max()
        return np.array([values.mean(), best, np.log1p(len(values))])

    def features(self, data: bytes) -> np.ndarray:
        return self.summary(self.differences(data))

    def score(self, data: bytes) -> float:
        x = np.append(self.features(data) / self.scale, 1.0) @ self.curve
        return float(1 / (1 + np.exp(-np.clip(x, -500, 500))))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Newton steps with a small ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + 1e-3 * w
        curvature = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(w))
        step = np.linalg.solve(curvature, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def dictionaries(texts: list[bytes], labels: list[int], folds: list[int]) -> list[ToxicModel]:
    """Models without calibration: for each fold of the others' texts, and last of all texts."""
    parts = [(fold, value) for fold in range(FOLDS) for value in (0, 1)]
    of = {p: [t for t, y, f in zip(texts, labels, folds, strict=True) if (f, y) == p] for p in parts}
    total = [gram_counts([t for f, v in parts if v == value for t in of[f, v]]) for value in (0, 1)]
    models = []
    for left_out in (*range(FOLDS), None):
        plain, marked = (
            total[v] if left_out is None else total[v] - gram_counts(of[left_out, v]) for v in (0, 1)
        )
        ordinary, toxic = ([t for f, v in parts if v == value and f != left_out for t in of[f, v]] for value in (0, 1))
        marks = toxic_marks(marked, plain, len(toxic), len(ordinary))
        models.append(ToxicModel(ordinary_dictionary(ordinary, marks), toxic_dictionary(toxic, marks)))
    return models


def calibrate(model: ToxicModel, found: list[np.ndarray], labels: list[int], share: list[float]) -> ToxicModel:
    """``found`` has the differences of each text by dictionaries that never saw it; ``share`` is how
    many documents each text stands for."""
    y = np.array(labels, int)
    counts = np.full((2, HIGHEST - LOWEST + 1), 0.5)
    for value, values in zip(y, found, strict=True):
        counts[value] += np.bincount(values, minlength=counts.shape[1])
    model.ratios = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    x = np.array([model.summary(v) for v in found])
    model.scale = np.maximum(np.abs(x).mean(0), 1e-6) if len(x) else model.scale
    weight = np.array(share, float)
    design = np.column_stack([x / model.scale, np.ones(len(x))])
    model.curve = _logistic(design, y.astype(float), weight / max(weight.mean(), 1e-9))
    return model


def sampled_labels(labels: DataFrame, per_class: int = DOCS_PER_CLASS) -> tuple[DataFrame, dict[int, int]]:
    """Labels of about ``per_class`` documents of each class, chosen by a hash of the id, three times
    ``per_class`` at most; and how many labels there are of each class."""
    rows = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").select("doc_id", F.col("toxic").cast("int"))
    counts = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    draw = F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(1 << 30)).cast("double") / (1 << 30)
    share = F.when(F.col("toxic") == 1, F.lit(counts.get(1, 0))).otherwise(F.lit(counts.get(0, 0)))
    chosen = rows.withColumn("draw", draw).where(F.col("draw") * share < per_class)
    return chosen.orderBy("draw", "doc_id", "toxic").limit(3 * per_class), counts


def sampled_texts(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """``draw``, ``toxic``, ``text``, ``same`` (a hash of the text) and ``fold`` of the chosen documents,
    where they are read: only labels are sent out."""
    texts = docs.where("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    same = F.xxhash64("text", F.lit(9))
    return texts.select(
        "draw", "toxic", "text", same.alias("same"), F.pmod(same, F.lit(FOLDS)).cast("int").alias("fold")
    )


def stretches(texts: DataFrame) -> list[tuple]:
    """(text, toxic, fold) of the sample, in an order of its own, equal texts once; of a long text a
    stretch of ``SAMPLE_CHARS`` code points at a place chosen by a hash."""
    place = F.pmod(F.xxhash64("text"), F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(0)) + 1) + 1
    piece = F.substr("text", place.cast("int"), F.lit(SAMPLE_CHARS))
    rows = texts.select("draw", "toxic", "same", "fold", piece.alias("piece")).collect()
    found = {(r["same"], r["toxic"]): (r["piece"].encode(), r["toxic"], r["fold"]) for r in rows}
    return sorted(found.values())


def differences_by_fold(texts: DataFrame, models: list[ToxicModel]) -> DataFrame:
    """``same``, ``toxic`` and ``found``, a byte for each window of the whole text, by the model of the
    text's fold."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            pairs = zip(chunk.column("text").to_pylist(), chunk.column("fold").to_pylist(), strict=True)
            found = [models[fold].differences(text.encode()).astype(np.uint8).tobytes() for text, fold in pairs]
            yield pa.RecordBatch.from_arrays(
                [chunk.column("same"), chunk.column("toxic"), pa.array(found, pa.binary())],
                ["same", "toxic", "found"],
            )

    narrow = texts.select("same", "toxic", "fold", "text")
    return narrow.mapInArrow(work, "same long, toxic int, found binary")


def learn(docs: DataFrame, labels: DataFrame) -> ToxicModel | None:
    """The model for documents (doc_id, text) and labels (doc_id, toxic); None unless both classes
    occur often enough to calibrate.  Null labels, and labels without a document, count for nothing."""
    chosen, counts = sampled_labels(labels)
    texts = sampled_texts(docs, chosen)
    pieces = stretches(texts)
    marks = [toxic for _, toxic, _ in pieces]
    if min(sum(marks), len(marks) - sum(marks)) < 2:
        return None
    models = dictionaries([text for text, _, _ in pieces], marks, [fold for _, _, fold in pieces])
    rows = differences_by_fold(texts, models[:FOLDS]).collect()
    found = {(r["same"], r["toxic"]): np.frombuffer(r["found"], np.uint8) for r in rows}
    marks = [toxic for _, toxic in sorted(found)]
    share = [counts[toxic] / marks.count(toxic) for toxic in (0, 1)]
    return calibrate(models[-1], [found[k] for k in sorted(found)], marks, [share[toxic] for toxic in marks])


def score_texts(
    docs: DataFrame, model: ToxicModel | None, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id`` and ``score`` of every row.  Null texts count as empty and get the score of a text
    without windows.  Without a model all scores are 0.  Repeated rows stay; other columns are
    ignored; an empty table gives none."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            texts = chunk.column("text").to_pylist()
            scores = [model.score((t or "").encode()) if model else 0.0 for t in texts]
            yield pa.RecordBatch.from_arrays(
                [chunk.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"]
            )

    narrow = ids_and_text(docs, key, text)
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(work, f"doc_id {kind}, score double")
