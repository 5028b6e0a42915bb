"""Toxicity: a counterfactual-regularised classifier.

A text's features are the words, word beginnings of 3 to 7 bytes and neighbouring word pairs it holds (64-bit hashes, A-Z
folded, present or not), so that one insult weighs the same in a line and in a book, and its inflections count as well. Those whose presence depends on the label are screened by a likelihood
ratio test; a ridge logistic regression over them is fitted by Newton's method with one more penalty: in every sentence
of the labelled texts that names a group, the name is swapped for each other name of its kind and for a neutral word, and
the squared change of the score is charged. A group's name thus gets no weight of its own from the company it keeps in
the labelled texts, and neutral mentions are not flagged. A quarter of the sample calibrates the score (Platt's method).

Fitting takes a bounded sample of about ``TRAIN_ROWS`` labelled texts, half of them toxic where there are enough,
weighted back to their shares, and chosen by a hash of their ids. Features, screening and swaps are counted in tasks; the
driver holds TRAIN_ROWS x FEATURES bits and a FEATURES x FEATURES matrix, whatever the corpus. Scoring reads whole texts
in Arrow batches.

Defined results: null and empty texts hold no feature and get the score of the intercept; without labels every score is 0,
with labels of one kind it is that kind's share; repeated labels of a document count once, with the worst; null labels
teach nothing; of repeated documents one text is learned and each row scored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import broadcast_if_small
from .data import only, query, ship_package, store, table
from .langid import held_out
from .quality import _platt, _sigmoid
from .words import ALNUM, LOWER, Words, mix, words

TRAIN_ROWS = 8000
FEATURES = 1024
#: Fewest sampled texts that hold a feature, and the smallest likelihood ratio (beyond what chance gives one of millions).
LEAST, SCREEN = 4, 27.0
STEMS = (3, 4, 5, 6, 7)
RIDGE, SWAP = 1e-5, 1.0
ROUNDS = 40
THRESHOLD = 0.3

#: Names of groups by kind, each with neutral words first; a parameter of ``fit``.
IDENTITIES: tuple[tuple[str, ...], ...] = (
    ("people", "women", "men", "girls", "boys", "females", "males"),
    ("person", "woman", "man", "girl", "boy", "female", "male"),
    ("people", "gay", "lesbian", "bisexual", "straight", "queer", "transgender", "homosexual", "heterosexual"),
    ("people", "muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics", "protestants", "sikhs"),
    ("person", "muslim", "christian", "jew", "jewish", "hindu", "buddhist", "atheist", "catholic", "protestant", "sikh"),
    ("people", "black", "white", "asian", "african", "european", "american", "latino", "hispanic", "arab", "indigenous"),
    ("people", "immigrants", "refugees", "foreigners", "natives", "migrants"),
    ("people", "blind", "deaf", "disabled", "autistic", "old", "young", "elderly"),
    ("menschen", "frauen", "männer", "muslime", "christen", "juden", "ausländer", "flüchtlinge", "schwule", "lesben"),
    ("gens", "femmes", "hommes", "musulmans", "chrétiens", "juifs", "étrangers", "réfugiés", "homosexuels", "lesbiennes"),
    ("personas", "mujeres", "hombres", "musulmanes", "cristianos", "judíos", "extranjeros", "refugiados", "homosexuales", "lesbianas"),
)
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_CAPITALS = {k: k + 32 for k in range(0x41, 0x5B)}
_ENDS = np.zeros(256, bool)
_ENDS[list(b".!?\n")] = True
_U = np.uint64
_FOLD = np.frombuffer(bytes(range(256)).translate(LOWER), np.uint8)


def word_hash(word: str) -> int:
    return int(_read(word).hashes()[0])


def _single(h: np.ndarray) -> np.ndarray:
    return mix(h ^ _U(0x51))


def _pair(h: np.ndarray) -> np.ndarray:
    return mix(h[:-1] + mix(h[1:] ^ _U(0x52)))


def _starts(found: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length the words that are at least as long, and the hash of their first bytes."""
    data = np.concatenate((_FOLD[found.data], np.zeros(STEMS[-1], np.uint8)))
    size = found.ends - found.starts
    packed = np.zeros(len(size), np.uint64)
    for k in range(STEMS[-1]):
        packed |= data[found.starts + k].astype(np.uint64) << _U(8 * k)
        if k + 1 in STEMS:
            long = np.flatnonzero(size > k)
            yield long, mix(packed[long] ^ _U((k + 1) << 60))


def features(found: Words) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each word, word beginning and pair of some texts."""
    h = found.hashes()
    row = np.repeat(np.arange(len(found.first) - 1), found.counts)
    same = row[1:] == row[:-1]
    rows, hashes = [row, row[1:][same]], [_single(h), _pair(h)[same] if len(h) else h]
    for at, start in _starts(found):
        rows.append(row[at])
        hashes.append(start)
    return np.concatenate(rows), np.concatenate(hashes)


@dataclass
class Model:
    """Hashes of the screened features in order, their weights, the intercept, and the calibration."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def present(self, found: Words) -> tuple[np.ndarray, np.ndarray]:
        """Row and place of each screened feature that a text holds, once each."""
        return _present(self.keys, *features(found))

    def scores(self, found: Words) -> np.ndarray:
        n = len(found.first) - 1
        row, at = self.present(found)
        return np.round(_sigmoid(self.slope * (np.bincount(row, self.weights[at], n) + self.bias) + self.shift), 12)


def _present(keys: np.ndarray, row: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys) or not len(hashes):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
    hit = keys[at] == hashes
    code = np.unique(row[hit] * len(keys) + at[hit])
    return code // len(keys), code % len(keys)


def constant(share: float) -> Model:
    """The same score for every text."""
    none = np.empty(0, np.uint64)
    return Model(none, np.empty(0), 0.0, 0.0, float(np.log(share / (1 - share))) if 0 < share < 1 else np.inf if share else -np.inf)


def _sample(docs: DataFrame, labels: DataFrame, rows: int) -> tuple[DataFrame | None, float, tuple[float, float]]:
    """Texts with their label and whether they calibrate, the share of toxic labels, and the weights of both kinds."""
    marked = only(labels, "doc_id", "toxic").where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(
        F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    bad, every = marked.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count(F.lit(1))).first()
    if not 0 < bad < every:
        return None, float(bad > 0), (1.0, 1.0)
    half = [max(1, rows - min(n, rows // 2)) for n in (bad, every - bad)]  # what one kind lacks the other may use
    rates = min(1.0, half[0] / (every - bad)), min(1.0, half[1] / bad)

    def draw(name: str):
        return F.pmod(F.xxhash64(F.lit(name), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))

    chosen = store(marked.where(draw("toxic") < F.when(F.col("toxic") > 0, rates[1]).otherwise(rates[0])))
    texts = only(docs, "doc_id", "text").join(broadcast_if_small(chosen), "doc_id").groupBy("doc_id").agg(
        F.min(F.coalesce("text", F.lit(""))).alias("text"), F.first("toxic").alias("toxic"))
    return store(texts.select("doc_id", "text", F.col("toxic").cast("long").alias("toxic"), (draw("calibrate") < 0.25).alias("apart"))), bad / every, (1 / rates[0], 1 / rates[1])


def _count(batches):
    for batch in batches:
        toxic = batch.column(1).to_numpy(zero_copy_only=False)
        for start, end, found in words(batch.column(0), ALNUM, True):
            row, key = features(found)
            order = np.lexsort((row, key))
            row, key = row[order], key[order]
            new = np.concatenate(([True], (key[1:] != key[:-1]) | (row[1:] != row[:-1]))) if len(key) else np.empty(0, bool)
            row, key = row[new], key[new]
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
            bad = np.add.reduceat(toxic[start:end][row], first) if len(first) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key[first].view(np.int64)), pa.array(bad.astype(np.int64)), pa.array(np.diff(np.append(first, len(key))))],
                                             names=["key", "bad", "texts"])


def screen(sample: DataFrame, limit: int = FEATURES) -> np.ndarray:
    """The features whose presence tells most about the label, at most ``limit`` of them, in order of their hash."""
    bad, every = sample.agg(F.sum("toxic"), F.count(F.lit(1))).first()
    counts = sample.select("text", "toxic").mapInArrow(_count, "key long, bad long, texts long").groupBy("key").agg(
        F.sum("bad").alias("bad"), F.sum("texts").alias("texts")).where(F.col("texts") >= LEAST)

    def part(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    b, n = F.col("bad").cast("double"), F.col("texts").cast("double")
    share, rest = bad / every, 1 - bad / every
    ratio = 2 * (part(b, n * share) + part(n - b, n * rest) + part(bad - b, (every - n) * share) + part(every - bad - n + b, (every - n) * rest))
    kept = counts.withColumn("ratio", ratio).where(F.col("ratio") >= SCREEN).orderBy(F.desc("ratio"), "key").limit(limit)
    return np.sort(np.array([r.key for r in kept.select("key").collect()], np.int64).view(np.uint64))


def _read(text: str) -> Words:
    data = np.frombuffer(text.encode(), np.uint8)
    return Words(data, np.array([0, len(data)]), ALNUM, True)


def swaps(sentence: str, keys: np.ndarray, names: dict[str, list[str]]) -> Iterator[tuple[tuple[int, ...], tuple[int, ...]]]:
    """Screened features that a sentence gains and loses when one name is swapped for another."""
    own = _WORD.findall(sentence.translate(_CAPITALS))

    def held(text):
        return set(_present(keys, *features(_read(" ".join(text))))[1].tolist())

    before = held(own)
    for name in sorted({w for w in own if w in names}):
        for other in names[name]:
            after = held([other if w == name else w for w in own])
            yield tuple(sorted(after - before)), tuple(sorted(before - after))


def _names(identities) -> dict[str, list[str]]:
    """For each name those it is swapped for; neutral words, the first of each kind, are never swapped away."""
    out: dict[str, list[str]] = {}
    for kind in identities:
        for own in kind[1:]:
            out[own] = sorted({*out.get(own, ()), *(c for c in kind if c != own)})
    return out


def _matrix(sample: DataFrame, keys: np.ndarray, identities) -> tuple[list, list]:
    """Labels and packed features of the sampled texts, and the distinct changes by swaps with how often they occur."""
    size = len(keys)
    shared = sample.sparkSession.sparkContext.broadcast((keys, _names(identities)))

    def pack(batches):
        keys, _ = shared.value
        for batch in batches:
            packed = []
            for start, end, found in words(batch.column(1), ALNUM, True):
                row, at = _present(keys, *features(found))
                bits = np.zeros((end - start, size), bool)
                bits[row, at] = True
                packed += [b.tobytes() for b in np.packbits(bits, axis=1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(packed, pa.binary())],
                                             names=["doc_id", "toxic", "apart", "bits"])

    def change(batches):
        keys, names = shared.value
        coded = np.array(sorted(map(word_hash, names)), np.uint64)
        for batch in batches:
            seen: dict[tuple, int] = {}
            for _, _, found in words(batch.column(0), ALNUM, True):
                h = found.hashes()
                ends = np.concatenate(([0], np.cumsum(_ENDS[found.data])))
                owner = np.repeat(np.arange(len(found.first) - 1), found.counts)
                sentence = ends[found.starts] + owner  # a new text is a new sentence as well
                bounds = np.flatnonzero(np.concatenate(([True], sentence[1:] != sentence[:-1], [True]))) if len(h) else np.empty(0, np.int64)
                hit = np.flatnonzero(np.isin(h, coded))
                for k in np.unique(np.searchsorted(bounds, hit, "right") - 1):
                    words_of = found.data[found.starts[bounds[k]] : found.ends[bounds[k + 1] - 1]].tobytes().decode(errors="replace")
                    for diff in swaps(words_of, keys, names):
                        seen[diff] = seen.get(diff, 0) + 1
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([list(d[0]) for d in seen], pa.list_(pa.int32())), pa.array([list(d[1]) for d in seen], pa.list_(pa.int32())),
                                                  pa.array(list(seen.values()), pa.int64())], names=["gained", "lost", "n"])

    rows = sample.select("doc_id", "text", "toxic", "apart").mapInArrow(pack, "doc_id long, toxic long, apart boolean, bits binary").orderBy("doc_id").collect()
    changed = sample.select("text").mapInArrow(change, "gained array<int>, lost array<int>, n long").groupBy("gained", "lost").agg(F.sum("n").alias("n"))
    return rows, changed.orderBy("gained", "lost").collect()


def _newton(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and intercept of the penalised regression; ``penalty`` is a quadratic form of the weights."""
    size = x.shape[1]
    w, bias = np.zeros(size), float(np.log(weight[y > 0].sum() / weight[y <= 0].sum()))
    for _ in range(ROUNDS):
        chance = _sigmoid(x @ w + bias)
        error, curve = weight * (chance - y), weight * np.maximum(chance * (1 - chance), 1e-9)
        grown = (x * curve[:, None].astype(x.dtype)).T
        matrix = np.empty((size + 1, size + 1))
        matrix[:size, :size] = grown @ x + penalty
        matrix[:size, size] = matrix[size, :size] = grown.sum(axis=1)
        matrix[size, size] = curve.sum()
        step = np.linalg.solve(matrix, np.append(x.T @ error + penalty @ w, error.sum()))
        step *= min(1.0, 4.0 / max(1e-12, abs(step).max()))
        w, bias = w - step[:size], bias - step[size]
        if abs(step).max() < 1e-8:
            break
    return w, float(bias)


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, swap: float = SWAP, identities=IDENTITIES) -> Model:
    """Learn from about ``rows`` labelled documents (doc_id, text; doc_id, toxic 0 or 1)."""
    ship_package(docs.sparkSession)
    sample, share, weights = _sample(docs, labels, rows)
    if sample is None:
        return constant(share)
    kinds = {r[0] for r in sample.select("toxic").distinct().collect()}
    keys = screen(sample) if kinds == {0, 1} else np.empty(0, np.uint64)
    if not len(keys):
        return constant(share)
    found, changes = _matrix(sample, keys, identities)
    x = np.unpackbits(np.frombuffer(b"".join(r.bits for r in found), np.uint8).reshape(len(found), -1), axis=1)[:, : len(keys)].astype(np.float32)
    y = np.array([r.toxic for r in found], float)
    apart = np.array([r.apart for r in found])
    if len(set(y[apart])) < 2 or len(set(y[~apart])) < 2:
        apart = np.zeros(len(y), bool)  # too few rows to calibrate apart
    weight = np.where(y > 0, weights[1], weights[0])
    weight = weight / weight[~apart].sum()
    penalty = RIDGE * np.eye(len(keys)) + _charge(changes, len(keys), swap)
    w, bias = _newton(x[~apart], y[~apart], weight[~apart], penalty)
    # the sample holds more toxic texts than the corpus, so it is dealt back before calibrating
    part = apart if apart.any() else ~apart
    slope, shift = _calibrate(x[part] @ w + bias, y[part], weight[part])
    return Model(keys, w, bias, slope, shift)


def _charge(changes: list, size: int, swap: float) -> np.ndarray:
    """The quadratic form of the mean squared change of the score by a swap."""
    total = max(1, sum(r.n for r in changes))
    out = np.zeros((size, size))
    for r in changes:
        d = np.zeros(size)
        d[r.gained], d[r.lost] = 1.0, -1.0
        at = np.flatnonzero(d)
        out[np.ix_(at, at)] += swap * r.n / total * np.outer(d[at], d[at])
    return out


def _calibrate(score: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Platt's slope and shift on the sample, the shift moved to the corpus' shares; the slope never turns the order round."""
    slope, shift = _platt(score, y)
    ratio = weight[y > 0].mean() / weight[y <= 0].mean()
    return (slope, shift + float(np.log(ratio))) if slope > 0 else (1.0, 0.0)


def judge(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Documents with ``score`` and ``predicted``; all their other columns stay."""
    spark = docs.sparkSession
    ship_package(spark)
    plain = docs.drop("score", "predicted")
    place = plain.columns.index("text")
    shared = spark.sparkContext.broadcast(model)

    def score(batches):
        model = shared.value
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for start, end, found in words(batch.column(place), ALNUM, True):
                out[start:end] = model.scores(found)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*batch.schema.names, "score"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields)
    return plain.mapInArrow(score, f"{kinds}, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


@query()
def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = only(table(spark, sf_dir, "documents"), "doc_id", "text")
    labels = table(spark, sf_dir, "labels")
    model = fit(docs.where(~held_out()), labels.where(~held_out()))
    return judge(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
