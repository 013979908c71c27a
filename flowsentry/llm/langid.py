"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Text is lower-cased, everything but letters becomes a space, and the n-grams of one to three code points
of each whole text are hashed to a fixed number of dimensions. A feature is the n-gram's share of the
text's n-grams times its inverse document frequency. Weights are trained by follow-the-regularised-leader
with elastic-net penalties, so most stay zero; the logits are then divided by a temperature fitted on
rows kept out of the training.

The model (weights, document frequencies, temperature) is fitted on a bounded sample: at most
``per_language`` labelled rows of each of the ``max_languages`` most frequent languages (None: of every language),
chosen by a hash of the text. Feature counts of those rows are made on the executors; the training itself is one task over them.

A text that is null, empty or without a letter is ``und`` with score 0. Long texts are read whole, in
stretches. Equal texts get equal answers. An empty table gives an empty result; without labelled rows
``fit`` raises ValueError, and ``fit_if_labelled`` gives a model that answers ``und``. Other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowsentry.llm.common import settle, short_batches, utf8, worker_cache

BITS = 15
DIMENSIONS = 1 << BITS
ORDERS = 3
# Code points whose n-grams are held at once.
STRETCH = 1 << 20
UNDETERMINED = "und"


def _letters() -> np.ndarray:
    """The lower-case form of each code point of the first plane; 32 for everything but letters."""
    cache = worker_cache()
    if "letters" not in cache:
        table = np.full(1 << 16, 32, np.uint32)
        for point in range(1 << 16):
            character = chr(point)
            if character.isalpha():
                low = character.lower()
                table[point] = ord(low[0])
        cache["letters"] = table
    return cache["letters"]


def _points(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    table = _letters()
    if len(points) and points.max() >= len(table):
        wide = points >= len(table)
        letter = np.array([chr(p).isalpha() for p in points[wide]])
        out = table[np.where(wide, 32, points)]
        out[wide] = np.where(letter, points[wide], 32)
        return out
    return table[points]


def has_letter(points: np.ndarray) -> bool:
    return bool((points != 32).any())


def ngram_ids(points: np.ndarray, order: int) -> np.ndarray:
    """Hashed ids of the n-grams of ``order`` code points; those that are all spaces are left out."""
    count = len(points) - order + 1
    if count <= 0:
        return np.zeros(0, np.int32)
    h = np.full(count, order * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
    blank = np.ones(count, bool)
    for i in range(order):
        part = points[i : i + count]
        h = (h ^ part) * np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(15)
        blank &= part == 32
    h *= np.uint32(0xC2B2AE35)
    return (h[~blank] >> np.uint32(32 - BITS)).astype(np.int32)


def _stretches(points: np.ndarray) -> Iterator[np.ndarray]:
    """The text with a space before and after, in stretches that together hold each n-gram once per order."""
    padded = np.concatenate([[32], points, [32]]).astype(np.uint32)
    for start in range(0, len(padded), STRETCH):
        yield padded[start : start + STRETCH + ORDERS - 1]


def _all_ids(points: np.ndarray) -> Iterator[np.ndarray]:
    for stretch in _stretches(points):
        for order in range(1, ORDERS + 1):
            # Each stretch overlaps the next by ORDERS - 1 points; an n-gram belongs where it starts.
            yield ngram_ids(stretch[: min(len(stretch), STRETCH + order - 1)], order)


def counts(text: str) -> np.ndarray:
    """How often each hashed n-gram occurs in the text."""
    out = np.zeros(DIMENSIONS, np.int64)
    for ids in _all_ids(_points(text)):
        out += np.bincount(ids, minlength=DIMENSIONS)
    return out


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # inverse document frequency times weight, dimension x language
    bias: np.ndarray
    temperature: float

    def logits(self, text: str) -> np.ndarray | None:
        points = _points(text)
        if not has_letter(points):
            return None
        total, n = np.zeros(len(self.languages)), 0
        for ids in _all_ids(points):
            total += self.table[ids].sum(axis=0, dtype=np.float64)
            n += len(ids)
        return total / n + self.bias

    def answer(self, text: str | None) -> tuple[str, float]:
        logits = self.logits(text or "")
        if logits is None or not self.languages:
            return UNDETERMINED, 0.0
        logits = logits / self.temperature
        p = np.exp(logits - logits.max())
        best = int(logits.argmax())
        return self.languages[best], float(p[best] / p.sum())


def train(
    rows: list[tuple[np.ndarray, np.ndarray, int]],
    idf: np.ndarray,
    languages: int,
    alpha: float,
    beta: float,
    l1: float,
    l2: float,
    epochs: int,
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases by follow-the-regularised-leader, one row (ids, counts, language) at a time."""
    z, n = np.zeros((DIMENSIONS + 1, languages)), np.zeros((DIMENSIONS + 1, languages))

    def weights(at):
        big = np.abs(z[at]) > l1
        return np.where(big, (np.sign(z[at]) * l1 - z[at]) / ((beta + np.sqrt(n[at])) / alpha + l2), 0.0)

    for epoch in range(epochs):
        for i in np.random.default_rng(epoch).permutation(len(rows)):
            ids, number, language = rows[i]
            at = np.append(ids, DIMENSIONS)  # the last one is the bias
            x = np.append(number * idf[ids] / number.sum(), 1.0)
            w = weights(at)
            logits = x @ w
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[language] -= 1
            gradient = x[:, None] * p
            squares = gradient * gradient
            z[at] += gradient - (np.sqrt(n[at] + squares) - np.sqrt(n[at])) / alpha * w
            n[at] += squares
    everything = weights(np.arange(DIMENSIONS + 1))
    return everything[:-1], everything[-1]


def temperature_of(logits: np.ndarray, answers: np.ndarray) -> float:
    """The divisor of the logits with the best log likelihood, by golden-section search on its logarithm."""

    def loss(log_t):
        scaled = logits / np.exp(log_t)
        top = scaled.max(axis=1)
        norm = top + np.log(np.exp(scaled - top[:, None]).sum(axis=1))
        return (norm - scaled[np.arange(len(answers)), answers]).mean()

    low, high, golden = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - golden * (high - low), low + golden * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


class NoLabels(ValueError):
    """There is nothing to learn from."""


def _sample(labelled: DataFrame, text: str, lang: str, per_language: int, max_languages: int | None) -> DataFrame:
    """At most ``per_language`` different texts of each frequent language: those with the smallest hashes."""
    hashed = labelled.withColumn("_h", F.xxhash64(F.lit(7), F.col(text)))
    if max_languages is not None:
        frequent = labelled.groupBy(lang).count().orderBy(F.desc("count"), lang).limit(max_languages).select(lang)
        hashed = hashed.join(F.broadcast(frequent), lang, "left_semi")
    # Ranked on hashes alone; of each language no task sends on more than that many.
    smallest = Window.partitionBy(lang).orderBy("_h")
    drawn = hashed.select(lang, "_h").distinct().withColumn("_n", F.row_number().over(smallest)).where(F.col("_n") <= per_language)
    return hashed.join(F.broadcast(drawn.drop("_n")), [lang, "_h"], "left_semi").dropDuplicates([lang, "_h"]).select(text, lang)


def fit(
    df: DataFrame,
    text: str = "text",
    lang: str = "lang",
    per_language: int = 1500,
    max_languages: int | None = 100,
    alpha: float = 1.0,
    beta: float = 1.0,
    l1: float = 0.002,
    l2: float = 0.001,
    epochs: int = 3,
    held: float = 0.2,
) -> Model:
    """Learn from the rows with a language and a letter."""
    import pyarrow as pa

    short_batches(df.sparkSession)
    if lang not in df.columns:
        raise NoLabels("no labelled rows to learn from")
    labelled = df.where(F.col(lang).isNotNull()).select(utf8(df[text]).alias("text"), F.col(lang).cast("string").alias("lang"))
    sample = _sample(labelled, "text", "lang", per_language, max_languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value in batch.column(0):
                number = counts(value.as_py())
                ids = np.flatnonzero(number)
                out.append((ids.astype(np.int32).tobytes(), number[ids].astype(np.float32).tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([a for a, _ in out], pa.binary()), pa.array([b for _, b in out], pa.binary()), batch.column(1)],
                ["ids", "counts", "lang"],
            )

    features = settle(sample.mapInArrow(run, "ids binary, counts binary, lang string"), "ngrams")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            for ids, number, language in zip(*[column.to_pylist() for column in batch.columns]):
                if ids:
                    rows.append((np.frombuffer(ids, np.int32), np.frombuffer(number, np.float32), language))
        if not rows:
            return
        rows.sort(key=lambda row: (row[2], row[0].tobytes(), row[1].tobytes()))
        languages = sorted({row[2] for row in rows})
        place = {language: k for k, language in enumerate(languages)}
        order = np.random.default_rng(0).permutation(len(rows))
        kept_out = set(order[: int(len(rows) * held)].tolist()) if len(rows) >= 50 else set()
        numbered = [(ids, number, place[language]) for ids, number, language in rows]
        used = [row for i, row in enumerate(numbered) if i not in kept_out]
        frequency = np.zeros(DIMENSIONS)
        for ids, _, _ in used:
            frequency[ids] += 1
        idf = np.log((1 + len(used)) / (1 + frequency)) + 1
        w, bias = train(used, idf, len(languages), alpha, beta, l1, l2, epochs)
        table = idf[:, None] * w
        temperature = 1.0
        if kept_out:
            check = [numbered[i] for i in sorted(kept_out)]
            logits = np.array([(number / number.sum()) @ table[ids] + bias for ids, number, _ in check])
            temperature = temperature_of(logits, np.array([k for _, _, k in check]))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(["\0".join(languages)]),
                pa.array([table.astype(np.float32).tobytes()], pa.binary()),
                pa.array([bias.tobytes()], pa.binary()),
                pa.array([temperature]),
            ],
            ["languages", "weights", "bias", "temperature"],
        )

    # One task over the bounded sample.
    fitted = features.coalesce(1).mapInArrow(learn, "languages string, weights binary, bias binary, temperature double").collect()
    if not fitted:
        raise NoLabels("no labelled rows to learn from")
    languages = fitted[0]["languages"].split("\0")
    table = np.frombuffer(fitted[0]["weights"], np.float32).reshape(DIMENSIONS, len(languages))
    return Model(languages, table, np.frombuffer(fitted[0]["bias"]), fitted[0]["temperature"])


def fit_if_labelled(df: DataFrame, **options) -> Model:
    """``fit``; without labelled rows a model without languages."""
    try:
        return fit(df, **options)
    except NoLabels:
        return Model([], np.zeros((DIMENSIONS, 0), np.float32), np.zeros(0), 1.0)


def predict(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``df`` with ``lang_pred`` and ``lang_score``."""
    import pyarrow as pa
    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    short_batches(df.sparkSession)
    place = df.columns.index(text)
    sent = df.sparkSession.sparkContext.broadcast((model.languages, model.table, model.bias, model.temperature))
    schema = StructType([*df.schema.fields, StructField("lang_pred", StringType()), StructField("lang_score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*sent.value)
        for batch in batches:
            made = [own.answer(value.as_py()) for value in batch.column(place)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([a for a, _ in made], pa.string()), pa.array([b for _, b in made], pa.float64())],
                [*batch.schema.names, "lang_pred", "lang_score"],
            )

    return df.mapInArrow(run, schema)


def bucket(doc_id: Column, parts: int) -> Column:
    """crc32 of the id's decimal text, modulo ``parts``; a null id counts as empty."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(parts))
