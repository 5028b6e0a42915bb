"""Language identification by multilingual mixture inference.

Each learned language is a distribution over hashed byte n-grams of lower-cased letters (all else counts as a
space). A document's n-grams are taken as a draw from a mixture of languages: expectation-maximisation estimates the
proportions, and the set of languages is the one with the best penalised likelihood, log L / OVERLAP minus PENALTY x
log(n-grams) for each language beyond the first, among the best single language, the two and three largest of the
mixture, and so on. The prediction is the largest language of that set and its score the proportion.

Learning takes a bounded sample: about ``TRAIN_ROWS`` documents of each language, chosen by a hash of their ids among
those whose crc32(doc_id) mod 4 is not ``HELD_OUT``. Only text and language are used. Scoring reads whole texts in
Arrow batches; memory is bounded by a piece of about 1 MB or one text, and by the model, which has ``BUCKETS`` numbers a
language.

Defined results: null texts, empty texts and texts without a letter are ``und`` with score 0, and so is everything
when no labelled row exists; null languages teach nothing; repeated rows each get their own row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .data import only, query, ship_package, table
from .words import texts

UNKNOWN = "und"
HELD_OUT = 2
TRAIN_ROWS = 2000
SIZE = 4
BITS = 16
BUCKETS = 1 << BITS
SMOOTHING = 0.25
STEPS = 8
#: Neighbouring n-grams share all letters but one, so their likelihood counts only once in so many.
OVERLAP = SIZE
PENALTY = 3.0
#: A document needs a language with at least this proportion to pass.
DOMINANT = 0.5


def _letters() -> np.ndarray:
    out = np.full(256, 0x20, np.uint8)
    out[0x61:0x7B] = out[0x41:0x5B] = np.arange(0x61, 0x7B)
    out[0x80:] = np.arange(0x80, 0x100)
    return out


_LETTERS = _letters()


def grams(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashed n-grams of each text: row, bucket, count; sorted by row."""
    n = len(data) - SIZE + 1
    if n <= 0:
        return (np.empty(0, np.int64),) * 3
    code = _LETTERS[data]
    gram = code[:n].astype(np.uint32)
    for k in range(1, SIZE):
        gram |= code[k : k + n].astype(np.uint32) << np.uint32(8 * k)
    middle = code[1 : n + 1] != 0x20
    middle &= code[2 : n + 2] != 0x20
    ends = bounds[1:-1]
    for k in range(1, SIZE):  # windows over the end of a text
        cut = ends - k
        middle[cut[(cut >= 0) & (cut < n)]] = False
    at = np.flatnonzero(middle)
    bucket = (gram[at] * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
    rows = np.repeat(np.arange(len(bounds) - 1, dtype=np.int64), np.diff(bounds))[at]
    key = (rows << BITS) | bucket
    key.sort()
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
    counts = np.diff(np.append(first, len(key)))
    key = key[first]
    return key >> BITS, key & (BUCKETS - 1), counts


@dataclass
class Model:
    """Languages, their probabilities by bucket (buckets x languages), and the place of the most common one."""

    languages: list[str]
    chances: np.ndarray
    common: int = 0


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", rows: int = TRAIN_ROWS, key: Column | None = None) -> Model:
    """Learn from about ``rows`` documents of each language, chosen by the hash of ``key`` (the text if none)."""
    ship_package(docs.sparkSession)
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    draw = F.pmod(F.xxhash64(F.lit("langid"), F.col(text) if key is None else key), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sizes = {r[0]: r[1] for r in known.groupBy(lang).count().collect()}  # one row for each language
    if not sizes:
        return Model([], np.empty((BUCKETS, 0), np.float32))
    share = F.create_map(*[F.lit(x) for name, n in sizes.items() for x in (name, min(1.0, rows / n))])
    chosen = known.where(draw < F.element_at(share, F.col(lang))).select(F.col(lang).alias("lang"), F.col(text).alias("text"))

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            names = np.array(batch.column(0).to_pylist(), object)
            for row, end, data, bounds in texts(batch.column(1)):
                at, bucket, counts = grams(data, bounds)
                owner = names[row:end][at]
                for name in set(names[row:end]):
                    mine = owner == name
                    sums.setdefault(name, np.zeros(BUCKETS))
                    sums[name] += np.bincount(bucket[mine], counts[mine], BUCKETS)
        if sums:
            yield pa.RecordBatch.from_pydict({"lang": list(sums), "sums": [s.tobytes() for s in sums.values()]})

    def add(part: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py()) for x in part.column("sums"))
        return pa.table({"lang": [part.column("lang")[0].as_py()], "sums": [total.tobytes()]})

    # at most one row a task and language, each of the same fixed size
    summed = chosen.mapInArrow(count, "lang string, sums binary").groupBy("lang").applyInArrow(add, "lang string, sums binary")
    found = sorted(summed.collect())
    sums = np.array([np.frombuffer(r.sums) for r in found]).reshape(len(found), BUCKETS)
    chances = (sums + SMOOTHING) / (sums.sum(axis=1, keepdims=True) + SMOOTHING * BUCKETS)
    names = [r.lang for r in found]
    common = max(range(len(names)), key=lambda k: (sizes[names[k]], names[k]), default=0)
    return Model(names, np.ascontiguousarray(chances.T.astype(np.float32)), common)


def _mixture(chances: np.ndarray, counts: np.ndarray, rows: np.ndarray, first: np.ndarray, n: np.ndarray, allowed: np.ndarray):
    """Proportions and log-likelihood of each text under the allowed languages (texts x languages)."""
    share = allowed / allowed.sum(axis=1, keepdims=True)
    weight = counts.astype(np.float32)
    for step in range(STEPS + 1):
        joint = chances * share.astype(np.float32)[rows]
        total = joint.sum(axis=1)
        if step == STEPS:
            return share, np.add.reduceat(weight * np.log(total), first, dtype=np.float64)
        joint *= (weight / total)[:, None]
        share = np.add.reduceat(joint, first, axis=0, dtype=np.float64) / n[:, None]


def infer(model: Model, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text: index of its language (-1 if it has none), its proportion, and the number of languages found."""
    size = len(bounds) - 1
    best, score, found = np.full(size, -1), np.zeros(size), np.zeros(size, np.int64)
    rows, bucket, counts = grams(data, bounds)
    if not len(rows) or not model.languages:
        return best, score, found
    first = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
    own = rows[first]
    local = np.repeat(np.arange(len(own)), np.diff(np.append(first, len(rows))))
    n = np.add.reduceat(counts, first).astype(np.float64)
    chances = model.chances[bucket]
    single = np.add.reduceat(counts[:, None].astype(np.float32) * np.log(chances), first, axis=0, dtype=np.float64) / OVERLAP
    many = len(model.languages)
    share, full = _mixture(chances, counts, local, first, n, np.ones((len(own), many)))
    top = single.argmax(axis=1)
    value = single[np.arange(len(own)), top]
    part, chosen = np.ones(len(own)), np.ones(len(own), np.int64)
    cost = PENALTY * np.log(n + 1)
    order = np.argsort(-share, axis=1, kind="stable")
    for k in range(2, many + 1):
        # the mixture of all languages bounds what any set of k can reach
        open_ = np.flatnonzero(full / OVERLAP - cost * (k - 1) > value)
        if not len(open_):
            break
        allowed = np.zeros((len(open_), many))
        np.put_along_axis(allowed, order[open_, :k], 1.0, axis=1)
        pick = np.isin(local, open_)
        sub = local[pick]
        start = np.flatnonzero(np.concatenate(([True], sub[1:] != sub[:-1])))
        place = np.repeat(np.arange(len(open_)), np.diff(np.append(start, len(sub))))
        shares, logs = _mixture(chances[pick], counts[pick], place, start, n[open_], allowed)
        logs = logs / OVERLAP - cost[open_] * (k - 1)
        better = logs > value[open_]
        at = open_[better]
        value[at], chosen[at] = logs[better], k
        top[at], part[at] = shares[better].argmax(axis=1), shares[better].max(axis=1)
    best[own], score[own], found[own] = top, part, chosen
    return best, score, found


def _has_letter(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    low = data | 0x20
    sums = np.concatenate(([0], np.cumsum((low >= 0x61) & (low <= 0x7A) & (data < 0x80))))
    out = np.diff(sums[bounds]) > 0
    for k in np.flatnonzero(~out & (np.diff(bounds) > 0)):
        out[k] = any(map(str.isalpha, data[bounds[k] : bounds[k + 1]].tobytes().decode(errors="replace")))
    return out


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Documents with ``lang_pred``, ``score`` and ``n_languages``; all their other columns stay.

    A text with a letter but without a whole n-gram (a letter or two) gets the most common language of the labelled
    rows, with an even share as its score.
    """
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)
    plain = docs.drop("lang_pred", "score", "n_languages")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields)
    place = plain.columns.index(text)

    def score(batches):
        model = shared.value
        names = np.array([*model.languages, UNKNOWN], object)
        for batch in batches:
            pred = np.full(batch.num_rows, UNKNOWN, object)
            part, many = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for row, end, data, bounds in texts(batch.column(place)):
                best, share, found = infer(model, data, bounds)
                letters = _has_letter(data, bounds)
                if model.languages:
                    short = letters & (best < 0)
                    best[short], share[short], found[short] = model.common, 1.0 / len(model.languages), len(model.languages)
                best[~letters], share[~letters], found[~letters] = -1, 0.0, 0
                pred[row:end], part[row:end], many[row:end] = names[best], share, found
            columns = [batch.column(k) for k in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(pred, pa.string()), pa.array(np.clip(part, 0, 1)), pa.array(many)],
                names=[*batch.schema.names, "lang_pred", "score", "n_languages"])

    return plain.mapInArrow(score, f"{kinds}, lang_pred string, score double, n_languages long")


def held_out(key: str = "doc_id") -> Column:
    """Whether a document is kept from learning; ids that are null are learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string")), F.lit(4)) == HELD_OUT, F.lit(False))


def learned(docs: DataFrame) -> Model:
    return fit(only(docs, "doc_id", "text", "lang").where(~held_out()), key=F.col("doc_id"))


@query()
def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learned(docs)
    found = identify(only(docs, "doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "n_languages")


def identified(docs: DataFrame) -> DataFrame:
    """The documents with a dominant known language, with their own columns; learned from their own labels."""
    found = identify(docs.select(*[F.col(f"`{c}`").alias(f"own{i}") for i, c in enumerate(docs.columns)], F.col("text")), learned(docs))
    passed = found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= DOMINANT))
    return passed.select(*[F.col(f"own{i}").alias(c) for i, c in enumerate(docs.columns)])
