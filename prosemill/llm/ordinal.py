"""Quality classifier: ordinal cumulative-link regression on graded ratings.

With grades 0 to K - 1, P(grade <= k) = sigmoid(threshold[k] - score). The score is one sum of hashed-text weights that all
grades share; the thresholds ascend (each step is an exponential). So a document has one place on one scale, an expected
grade, and the probability of the best grade, by which it is selected.

Features of a text (lower-cased A to Z, words between blanks): each word, its beginnings, its last three bytes, whether it
repeats the word before, and whether it is in capitals, hashed to SPACE places. A place that comes up k times in n words
has the value sqrt(k) / (3 + log n): a word counts in a long text nearly as much as in a short one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosemill.llm.textarrays import BYTE_SYMBOLS, U64, Fingerprints, chunks, lowered, mixed, text_bytes, words

SPACE = 1 << 18
#: Bytes of a word's beginnings.
BEGINNINGS = (4, 5, 6, 7)
#: Rated documents that the model is fitted on, the least by a hash of their id. This bounds the driver's memory.
SAMPLE = 6000


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts end to end: (text, place, value), sorted by text and place."""
    small = lowered(data)
    starts, ends, bounds = words(small, offsets)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    text, size = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds)), ends - starts
    prints = Fingerprints(BYTE_SYMBOLS[small], 0)
    whole = mixed(prints.ranges(starts, ends) + size.astype(U64))
    tail = mixed(sum((small[np.maximum(ends - k, starts)].astype(U64) << U64(8 * k)) for k in (1, 2, 3)) + U64(1 << 40))
    repeats = np.r_[False, (whole[1:] == whole[:-1]) & (text[1:] == text[:-1])]
    inner = ends - 1 - (size > 2)
    capital = (data[starts] != small[starts]) & (data[inner] != small[inner]) & (size > 1)
    shape = mixed(repeats.astype(U64) + capital.astype(U64) * U64(2) + U64(1 << 41))
    places, texts = [whole, tail, shape], [text] * 3
    for n in BEGINNINGS:
        longer = size > n
        places.append(mixed(prints.ranges(starts[longer], starts[longer] + n) + U64(n << 50)))
        texts.append(text[longer])
    key, times = np.unique(np.concatenate(texts).astype(U64) * U64(SPACE) + np.concatenate(places) % U64(SPACE), return_counts=True)
    text = (key // U64(SPACE)).astype(np.int64)
    return text, (key % U64(SPACE)).astype(np.int64), np.sqrt(times) / (3 + np.log(np.diff(bounds)[text]))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray

    def probabilities(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k but the last."""
        return sigmoid(score[:, None] - self.thresholds[None, :])

    def score(self, text: np.ndarray, place: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(text, self.weights[place] * value, n) if len(text) else np.zeros(n)


def fit(text: np.ndarray, place: np.ndarray, value: np.ndarray, grade: np.ndarray, grades: int, rounds: int = 200, rate: float = 0.3, ridge: float = 2e-5) -> OrdinalModel:
    """Maximum likelihood with a ridge, by Adam over the whole sample. The order of the sample's rows does not matter much:
    sums run in the order of rows, which the caller fixes."""
    n = len(grade)
    weights, steps = np.zeros(SPACE), np.r_[-1.0, np.zeros(grades - 2)]
    moments = [np.zeros(SPACE), np.zeros(SPACE), np.zeros(grades - 1), np.zeros(grades - 1)]
    for t in range(1, rounds + 1):
        thresholds = np.cumsum(np.r_[steps[0], np.exp(steps[1:])])
        score = np.bincount(text, weights[place] * value, n)
        bounds = np.r_[-np.inf, thresholds, np.inf]
        low, high = (np.where(np.isinf(b), np.where(b > 0, 1.0, 0.0), sigmoid(np.nan_to_num(b, posinf=0, neginf=0) - score)) for b in (bounds[grade], bounds[grade + 1]))
        share = np.maximum(high - low, 1e-12)
        low_slope, high_slope = low * (1 - low) / share, high * (1 - high) / share
        by_score = high_slope - low_slope  # of minus the logarithm of the likelihood
        slope = np.bincount(place, by_score[text] * value, SPACE) / n + ridge * weights
        by_threshold = np.array([low_slope[grade == k + 1].sum() - high_slope[grade == k].sum() for k in range(grades - 1)]) / n
        by_step = np.cumsum(by_threshold[::-1])[::-1] * np.r_[1.0, np.exp(steps[1:])]
        for x, g, m, v in ((weights, slope, *moments[:2]), (steps, by_step, *moments[2:])):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return OrdinalModel(weights.astype(np.float32), np.cumsum(np.r_[steps[0], np.exp(steps[1:])]))


def feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        for a, b in chunks(offsets):
            text, place, value = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            sizes = pa.array(np.r_[0, np.cumsum(np.bincount(text, minlength=b - a))].astype(np.int32))
            places, values = (pa.ListArray.from_arrays(sizes, pa.array(x)) for x in (place.astype(np.int32), value.astype(np.float32)))
            yield pa.RecordBatch.from_arrays([batch.column("grade").slice(a, b - a), places, values], names=["grade", "places", "values"])


def train(docs: DataFrame, ratings: DataFrame, grades: int, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> OrdinalModel:
    """ratings: id_col and grade, of which rows with a null are passed over and of an id's grades the least counts."""
    picked = (
        ratings.where(F.col("grade").isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min("grade").cast("int").alias("grade"))
        .withColumn("order", F.xxhash64("_id")).orderBy("order", "_id").limit(sample)
    )
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "_id")
    rows = texts.select("grade", "order", "_id", "text").mapInArrow(feature_rows_ordered, "order long, grade int, places array<int>, values array<float>").toArrow()
    if not rows.num_rows:
        return OrdinalModel(np.zeros(SPACE, np.float32), np.arange(grades - 1) - (grades - 1) - 3.0)  # nothing rated: all selected
    rows = rows.sort_by("order").combine_chunks()
    lists = rows.column("places").combine_chunks()
    text = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
    return fit(text, lists.flatten().to_numpy(), rows.column("values").combine_chunks().flatten().to_numpy().astype(np.float64), rows.column("grade").to_numpy(), grades)


def feature_rows_ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        done = list(feature_rows(iter([batch])))
        at = 0
        for part in done:
            yield pa.RecordBatch.from_arrays([batch.column("order").slice(at, part.num_rows), *part.columns], names=["order", *part.schema.names])
            at += part.num_rows


def rate(docs: DataFrame, model: OrdinalModel, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """A row for each row: id_col, the columns in carry, expected_grade, tail_probability (of the best grade), and selected.

    A null text counts as empty; a text without words has score 0. A null id is carried, equal rows get equal results, no
    rows give no rows; columns not named are left out, so no name can clash. The model, a megabyte whatever the corpus, is
    broadcast.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    inner = docs.select(F.col(id_col), *carry, F.col(text_col).alias("_rated_text"))
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in inner.schema.fields if f.name != "_rated_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch in batches:
            data, offsets = text_bytes(batch.column("_rated_text"))
            above = [own.probabilities(own.score(*features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]), b - a)) for a, b in chunks(offsets)]
            p = np.concatenate(above) if above else np.zeros((0, len(own.thresholds)))
            names = [n for n in batch.schema.names if n != "_rated_text"]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [pa.array(p.sum(1)), pa.array(p[:, -1]), pa.array(p[:, -1] >= threshold)], names=[*names, "expected_grade", "tail_probability", "selected"])

    return inner.mapInArrow(run, f"{kind}, expected_grade double, tail_probability double, selected boolean")
