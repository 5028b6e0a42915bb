"""Quality rules: a calibrated logistic regression over hashed word and character n-grams, beside counted base rules.

A text's features are its hashed words, word pairs and byte n-grams, as square roots of their counts, scaled to length
one. The regression learns from a bounded sample of labelled rows: about ``TRAIN_ROWS`` of them, chosen by a hash of
their ids, three quarters for the weights and one quarter for the calibration, which turns the raw score into a
probability (Platt's method). Scoring reads whole texts in Arrow batches against the fixed ``THRESHOLD``.

Features of the sample are counted in tasks and fitted on the driver; their size is bounded by TRAIN_ROWS x BUCKETS.

Defined results: null or empty texts have no words and fail the base rules; without labelled rows of both kinds every
probability is 1, so that only the base rules decide; repeated labels of a document count once, with the worst
quality; null labels teach nothing; repeated documents each get their own row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import broadcast_if_small
from .data import only, query, ship_package, store, table
from .words import SPACED, WHITE, Words, mix, words

TRAIN_ROWS = 3000
BITS = 17
BUCKETS = 1 << BITS
CHARS = 4
ROUNDS, RATE, DECAY = 150, 0.5, 1e-5
#: A document needs at least this probability of being good.
THRESHOLD = 0.3
#: The base rules: fewest words, and the largest share of words in repeated windows, in percent.
FEWEST, REPEATED = 10, 20
WINDOW = 5
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True


def features(found: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features of some texts: bounds by text, buckets, values (each text of length one)."""
    single = found.hashes()
    rows = np.repeat(np.arange(len(found.first) - 1), found.counts)
    at, pairs = found.windows(2, single)
    data, bounds = found.data, found.bounds
    n = max(0, len(data) - CHARS + 1)
    gram = np.zeros(n, np.uint64)
    for k in range(CHARS):
        gram |= data[k : k + n].astype(np.uint64) << np.uint64(8 * k)
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    whole = owner[:n] == owner[CHARS - 1 :] if n else np.empty(0, bool)
    hashed = np.concatenate((mix(single ^ np.uint64(1)), mix(pairs ^ np.uint64(2)), mix(gram[whole] ^ np.uint64(3))))
    key = (np.concatenate((rows, rows[at], owner[:n][whole])) << BITS) | (hashed >> np.uint64(64 - BITS)).astype(np.int64)
    key.sort()
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
    value = np.sqrt(np.diff(np.append(first, len(key))))
    key = key[first]
    row = key >> BITS
    size = np.sqrt(np.bincount(row, value * value, len(bounds) - 1))
    return np.searchsorted(row, np.arange(len(bounds))), key & (BUCKETS - 1), value / size[row], row


@dataclass
class Model:
    """Weights by bucket, the bias, and the calibration: probability = 1 / (1 + exp(-(slope x score + shift)))."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def chances(self, found: Words) -> np.ndarray:
        _, bucket, value, row = features(found)
        score = np.bincount(row, self.weights[bucket] * value, len(found.first) - 1) + self.bias
        return _sigmoid(self.slope * score + self.shift)


#: What holds without labels: everything is good.
NO_MODEL = Model(np.zeros(BUCKETS), 0.0, 0.0, np.inf)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _measure(batches):
    for batch in batches:
        buckets, values = [], []
        for _, _, found in words(batch.column(1), SPACED):
            bounds, bucket, value, _ = features(found)
            for a, b in zip(bounds[:-1], bounds[1:]):
                buckets.append(bucket[a:b].astype(np.int32).tobytes())
                values.append(value[a:b].astype(np.float32).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(buckets, pa.binary()), pa.array(values, pa.binary())],
                                         names=["doc_id", "quality", "buckets", "values"])


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Learn from about ``rows`` labelled documents (doc_id, text; doc_id, quality 0 or 1)."""
    ship_package(docs.sparkSession)
    marked = only(labels, "doc_id", "quality").where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    count = marked.count()
    draw = F.pmod(F.xxhash64(F.lit("quality"), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = store(marked.where(draw < min(1.0, rows / max(1, count))))
    sample = only(docs, "doc_id", "text").join(broadcast_if_small(chosen), "doc_id").select("doc_id", "text", F.col("quality").cast("long").alias("quality"))
    found = sample.mapInArrow(_measure, "doc_id long, quality long, buckets binary, values binary").orderBy("doc_id").collect()
    if len({r.quality > 0 for r in found}) < 2:
        return NO_MODEL
    hold = np.array([int(mix(np.array([r.doc_id], np.int64).view(np.uint64))[0] & np.uint64(3)) == 0 for r in found])
    good = np.array([r.quality > 0 for r in found], float)
    sizes = np.array([len(r.buckets) // 4 for r in found])
    bucket = np.concatenate([np.frombuffer(r.buckets, np.int32) for r in found])
    value = np.concatenate([np.frombuffer(r["values"], np.float32) for r in found])
    row = np.repeat(np.arange(len(found)), sizes)
    if len(set(good[hold])) < 2 or len(set(good[~hold])) < 2:
        hold = np.zeros(len(found), bool)  # too few rows to calibrate apart
    weights, bias = np.zeros(BUCKETS), 0.0
    square, own = np.full(BUCKETS, 1e-8), 1e-8
    rate = good[~hold].mean()
    balance = np.where(good > 0, 0.5 / rate, 0.5 / (1 - rate)) * ~hold / (~hold).sum()
    for _ in range(ROUNDS):
        chance = _sigmoid(np.bincount(row, weights[bucket] * value, len(found)) + bias)
        slope = balance * (chance - good)
        step = np.bincount(bucket, slope[row] * value, BUCKETS) + DECAY * weights
        square += step * step
        own += slope.sum() ** 2
        weights -= RATE * step / np.sqrt(square)
        bias -= RATE * slope.sum() / np.sqrt(own)
    score = np.bincount(row, weights[bucket] * value, len(found)) + bias
    part = hold if hold.any() else ~hold
    return Model(weights.astype(np.float32), bias, *_platt(score[part], good[part]))


def _platt(score: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and shift by Newton's method, with targets drawn in a little from 0 and 1."""
    yes, no = good.sum(), len(good) - good.sum()
    target = np.where(good > 0, (yes + 1) / (yes + 2), 1 / (no + 2))
    slope, shift = 1.0, 0.0
    for _ in range(100):
        chance = _sigmoid(slope * score + shift)
        error, weight = chance - target, chance * (1 - chance) + 1e-9
        step = np.array([(error * score).sum(), error.sum()])
        curve = np.array([[(weight * score * score).sum(), (weight * score).sum()], [(weight * score).sum(), weight.sum()]]) + 1e-6 * np.eye(2)
        move = np.clip(np.linalg.solve(curve, step), -2, 2)
        slope, shift = slope - move[0], shift - move[1]
        if abs(move).max() < 1e-9:
            break
    return float(slope), float(shift)


def counts_of(found: Words) -> dict[str, np.ndarray]:
    """The base counts of some texts."""
    data, bounds = found.data, found.bounds
    inside = np.concatenate(([0], np.cumsum(SPACED[data] & ((data & 0xC0) != 0x80))))
    symbols = np.concatenate(([0], np.cumsum(_SYMBOLS[data])))
    at, hashes = found.windows(WINDOW, found.hashes())
    owner = np.searchsorted(found.first, at, "right") - 1
    _, where, often = np.unique(mix(hashes + mix(owner.astype(np.uint64))), return_inverse=True, return_counts=True)
    edge = np.zeros(len(found.starts) + WINDOW + 1, np.int64)
    repeated = at[often[where] > 1]
    np.add.at(edge, repeated, 1)
    np.add.at(edge, repeated + WINDOW, -1)
    covered = np.concatenate(([0], np.cumsum(np.cumsum(edge)[: len(found.starts)] > 0)))
    doubled = np.zeros(len(bounds) - 1, np.int64)
    for k in range(len(bounds) - 1):
        lines = found.text(k).split(b"\n")
        if len(lines) > 1:
            own = [line for line in lines if line.strip(WHITE)]
            doubled[k] = len(own) - len(set(own))
    return {"n_words": found.counts, "word_chars": np.diff(inside[bounds]), "n_symbols": np.diff(symbols[bounds]), "n_dup_lines": doubled,
            "n_repeat_words": np.diff(covered[found.first])}


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Documents with the base counts, ``base_failed``, ``chance`` (calibrated) and ``kept``; all other columns stay."""
    spark = docs.sparkSession
    ship_package(spark)
    plain = docs.drop(*_COUNTS, "base_failed", "chance", "kept")
    place = plain.columns.index("text")
    shared = spark.sparkContext.broadcast(model)

    def score(batches):
        model = shared.value
        for batch in batches:
            counts = {name: np.zeros(batch.num_rows, np.int64) for name in _COUNTS}
            chances = np.ones(batch.num_rows)
            for row, end, found in words(batch.column(place), SPACED):
                for name, value in counts_of(found).items():
                    counts[name][row:end] = value
                chances[row:end] = model.chances(found)
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, counts.values()), pa.array(chances)],
                                             names=[*batch.schema.names, *_COUNTS, "chance"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields)
    scored = plain.mapInArrow(score, f"{kinds}, {', '.join(f'{c} long' for c in _COUNTS)}, chance double")
    failed = F.expr(f"n_words < {FEWEST} OR 100 * n_repeat_words > {REPEATED} * n_words")
    return scored.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("chance") >= threshold))


@query()
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = only(table(spark, sf_dir, "documents"), "doc_id", "text")
    judged = judge(docs, fit(docs, table(spark, sf_dir, "labels")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                         F.round("chance", 6).alias("chance"))
