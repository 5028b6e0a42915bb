"""Exact n-gram Jaccard self-join with set-relation skipping.

A document's set is its distinct 4-word shingles (64-bit hashes). Equal sets are one class from the start. Two
classes link when 100 x intersection >= 85 x union. The join goes over index lists:

* **Order.** Shingles are ordered by rarity: frequent ones, found by an exact count of all shingles in hash classes,
  go last by powers of two of their frequency, all others by hash. Any order gives the same links; this one keeps
  common passages out of the prefixes. A set's first n - ceil(0.85 n) + 1 shingles are indexed, so linked sets meet
  in the list of their first common shingle.
* **Block skipping by position.** Lists are cut into blocks of sizes that can link. Pairs whose sizes are too far apart are
  skipped, and so are pairs where one shared shingle plus the smaller rest behind its positions cannot reach the overlap needed.
* **Answers from similar sets.** Each block has a head, the set that stands in the most lists, and each set is first tried
  against the head it meets most often. A set X linked to a head P becomes a member of P, with |X - P| known; a second
  round does the same with the heads. From then on only heads stand in the lists. For two heads P and Q that meet, their
  overlap is computed once: if they link, their members need no comparison, since all are in one component; if not,
  a member pair is compared only where overlap(P, Q) + |X - P| + |Z - Q| could reach the threshold.

A group of copies of one text costs a pair a member and round, not all pairs. Lists are sorted by Spark and streamed, links
never leave the executors.

Defined results: null and empty texts and texts without words have the empty set and link with nothing; repeated rows
with one doc_id are one document; a null doc_id is never the smallest id, so a class of such rows only has a null
component; an empty table gives an empty table.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import broadcast_if_small
from .counts import classes_of, counted
from .data import SQL_LOWER, only, query, ship_package, store, table
from .graph import components
from .words import SPACED, Words, mix, words

SHINGLE = 4
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 85
#: Shingles in more documents than this go last in the order, if ORDERED of them at most do; else only more frequent ones.
FREQUENT = 16
ORDERED = 1_000_000
#: Rounds in which sets are gathered under heads.
ROUNDS = 2
_LINK = "{o} * (100L + {p}) >= {p} * ({n} + {m})".replace("{p}", f"{PERCENT}L")


def sets_of(found: Words, size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text with fewer words is one shingle."""
    hashes = found.hashes()
    at, windows = found.windows(size, hashes)
    cuts = np.searchsorted(at, found.first)
    out = []
    for k in range(len(found.first) - 1):
        n = int(found.first[k + 1] - found.first[k])
        if n >= size:
            out.append(np.unique(windows[cuts[k] : cuts[k + 1]]))
        elif n:
            own = Words(found.data[found.bounds[k] : found.bounds[k + 1]], np.array([0, found.bounds[k + 1] - found.bounds[k]]), SPACED, True)
            out.append(own.windows(n, own.hashes())[1])
        else:
            out.append(np.empty(0, np.uint64))
    return out


def _each(column):
    """Row number and set of every text of an Arrow column."""
    for row, _, found in words(column, SPACED, True):
        for k, own in enumerate(sets_of(found)):
            yield row + k, own


def _signature(own: np.ndarray) -> int:
    """64 bits of a set: sums of two mixes of its hashes, mixed again."""
    with np.errstate(over="ignore"):
        total = mix(own).sum(dtype=np.uint64)
        other = mix(own ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)
        return int(mix(np.array([total ^ mix(np.array([other + np.uint64(len(own))], np.uint64))[0]], np.uint64)).view(np.int64)[0])


def _measured(batches):
    for batch in batches:
        sizes, signs = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
        for row, own in _each(batch.column(1)):
            sizes[row], signs[row] = len(own), _signature(own) if len(own) else 0
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(signs)], names=["doc_id", "n_shingles", "sign"])


# ---- the order of shingles

def _frequent(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Hash classes of frequent shingles (sorted), their levels, and the bits of a class; the counts cover all documents."""
    found, bits = counted(docs, "text", lambda column: (own for _, own in _each(column)), FREQUENT)
    found = found.withColumn("level", F.floor(F.log2("count")).cast("long"))
    left, least = 0, 64
    for level, rows in sorted(map(tuple, found.groupBy("level").count().collect()), reverse=True):  # 64 levels at most
        left += rows
        if left > ORDERED:
            break
        least = level
    frequent = found.where(F.col("level") >= least).select("class", "level").toPandas()  # bounded by ORDERED
    order = np.argsort(frequent["class"].to_numpy(np.int64))
    return frequent["class"].to_numpy(np.int64)[order], frequent["level"].to_numpy(np.int64)[order], bits


def prefix_of(own: np.ndarray, classes: np.ndarray, levels: np.ndarray, bits: int) -> np.ndarray:
    """The indexed shingles of a set, in the global order."""
    length = len(own) - -(-PERCENT * len(own) // 100) + 1
    if not len(classes):
        return own[:length]
    key = classes_of(own, bits)
    at = np.minimum(np.searchsorted(classes, key), len(classes) - 1)
    level = np.where(classes[at] == key, levels[at], 0)
    return own[np.lexsort((own, level))[:length]]


# ---- index lists

def _postings(shared):
    def emit(batches):
        classes, levels, bits = shared.value
        for batch in batches:
            tokens, rows, places, seen = [], [], [], set()
            sizes = []
            for row, own in _each(batch.column(0)):
                sign = _signature(own) if len(own) else 0
                if not len(own) or sign in seen:  # copies in one batch are one entry
                    continue
                seen.add(sign)
                chosen = prefix_of(own, classes, levels, bits)
                tokens.append(chosen.view(np.int64))
                rows.append(np.full(len(chosen), sign))
                places.append(np.arange(len(chosen)))
                sizes.append(np.full(len(chosen), len(own)))
                if len(tokens) >= 1000:
                    yield _batch(tokens, rows, sizes, places)
                    tokens, rows, places, sizes = [], [], [], []
            if tokens:
                yield _batch(tokens, rows, sizes, places)
    return emit


def _batch(tokens, rows, sizes, places):
    size, place = np.concatenate(sizes), np.concatenate(places)
    return pa.RecordBatch.from_pydict({"token": pa.array(np.concatenate(tokens)), "sign": pa.array(np.concatenate(rows)),
                                       "n": pa.array(size), "rest": pa.array(size - place - 1)})


def _lists(batches):
    """Entries of lists with two sets at least, copies left out; input sorted by token, n, sign.

    A list may go on over any number of batches; only its last entry is remembered.
    """
    alone, given = None, None  # an entry that is its list's only one so far; or (token, sign) of the last one given out
    for batch in batches:
        token, sign, n, rest = (batch.column(k).to_numpy() for k in range(4))
        if alone is not None:
            token, sign, n, rest = (np.concatenate(([old], new)) for old, new in zip(alone, (token, sign, n, rest)))
        if not len(token):
            continue
        fresh = np.concatenate(([True], (token[1:] != token[:-1]) | (sign[1:] != sign[:-1])))
        if given is not None:
            fresh &= (token != given[0]) | (sign != given[1])
        token, sign, n, rest = token[fresh], sign[fresh], n[fresh], rest[fresh]
        if not len(token):
            continue
        first = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
        count = np.diff(np.append(first, len(token)))
        use = count > 1
        use[0] |= given is not None and given[0] == token[0]
        alone = None if use[-1] else (token[-1], sign[-1], n[-1], rest[-1])
        given = (token[-1], sign[-1]) if use[-1] else None
        out = np.repeat(use, count)
        if out.any():
            yield pa.RecordBatch.from_pydict({"token": token[out], "sign": sign[out], "n": n[out], "rest": rest[out]})


# ---- verification

def _own_text(batches):
    """Texts that have the set they stand for, in case a doc_id comes with several texts."""
    for batch in batches:
        fits = np.zeros(batch.num_rows, bool)
        signs = batch.column(0).to_numpy()
        for row, own in _each(batch.column(1)):
            fits[row] = len(own) > 0 and _signature(own) == signs[row]
        yield batch.filter(pa.array(fits))


def _overlaps(batches):
    for batch in batches:
        left = [own for _, own in _each(batch.column(2))]
        right = [own for _, own in _each(batch.column(3))]
        both = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(left, right)]
        yield pa.RecordBatch.from_pydict({
            "a": batch.column(0), "b": batch.column(1), "na": pa.array(map(len, left), pa.int64()),
            "nb": pa.array(map(len, right), pa.int64()), "common": pa.array(both, pa.int64())})


def _verify(pairs: DataFrame, docs: DataFrame, names: DataFrame) -> DataFrame:
    """Pairs (a, b) with both set sizes and the exact overlap; only texts that stand in a pair are moved.

    ``names`` gives a document (sign, doc_id) for each set.
    """
    pairs = store(pairs)
    needed = store(pairs.select(F.col("a").alias("sign")).union(pairs.select("b")).distinct().join(names, "sign"))
    texts = store(docs.join(broadcast_if_small(needed), "doc_id").select("sign", "text").mapInArrow(_own_text, "sign long, text string"))
    left = pairs.join(texts.select(F.col("sign").alias("a"), F.col("text").alias("ta")), "a")
    both = left.join(texts.select(F.col("sign").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")
    return store(both.mapInArrow(_overlaps, "a long, b long, na long, nb long, common long").distinct())


def _heads(standing: DataFrame, tried: DataFrame | None) -> DataFrame:
    """One pair (a, b) for each set b that meets a better connected set a of its size: from (token, sign, rest, n).

    The head of a list's block is the set that stands in the most lists; a set is tried against the head it meets most often
    among those it could link to and has not been tried against.
    """
    block = F.floor(F.log("n") / F.lit(-math.log(PERCENT / 100)))
    rank = standing.groupBy("sign").agg(F.count(F.lit(1)).alias("rank"))
    ranked = standing.join(rank, "sign").withColumn("block", block)
    head = ranked.groupBy("token", "block").agg(F.max(F.struct("rank", "sign", "n", "rest")).alias("top"))
    fits = F.expr(_LINK.format(o="(1 + least(rest, top.rest))", n="n", m="top.n"))
    met = ranked.join(head, ["token", "block"]).where("top.sign <> sign").groupBy("sign", F.col("top.sign").alias("head")).agg(
        F.count(F.lit(1)).alias("times"), F.bool_or(fits).alias("fits")).where("fits")
    if tried is not None:
        met = met.join(tried.select(F.col("a").alias("head"), F.col("b").alias("sign")), ["head", "sign"], "left_anti")
    return met.groupBy(F.col("sign").alias("b")).agg(F.max(F.struct("times", "head")).alias("m")).select(F.col("m.head").alias("a"), "b")


def jaccard_groups(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id``, ``n_shingles``, ``sign`` (its set), ``component_id``, the smallest doc_id it reaches by links."""
    spark = docs.sparkSession
    ship_package(spark)
    docs = only(docs, "doc_id", "text")
    members = store(docs.mapInArrow(_measured, "doc_id long, n_shingles long, sign long"))
    order = spark.sparkContext.broadcast(_frequent(docs))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    postings = docs.select("text").mapInArrow(_postings(order), "token long, sign long, n long, rest long")
    lists = postings.repartition(parts, "token").sortWithinPartitions("token", "n", "sign")
    entries = store(lists.mapInArrow(_lists, "token long, sign long, n long, rest long"))

    # one document of each set that stands in a list with another
    sizes = members.where("n_shingles > 0").groupBy("sign").agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n"))
    sizes = store(sizes.join(entries.select("sign").distinct(), "sign", "left_semi"))
    names = sizes.select("sign", "doc_id")
    linked = _LINK.format(o="common", n="na", m="nb")

    # rounds of heads: first over sets, then over the heads themselves
    links, center, tried, standing = None, None, None, entries.select("token", "sign", "rest")
    for _ in range(ROUNDS):
        compared = _verify(_heads(standing.join(sizes.select("sign", "n"), "sign"), tried), docs, names)
        tried = compared.select("a", "b") if tried is None else tried.union(compared.select("a", "b"))
        found = compared.where(linked)
        links = found if links is None else links.union(found)
        joined = found.select(F.col("b").alias("sign"), F.col("a").alias("to"), (F.col("nb") - F.col("common")).alias("step"), F.col("nb").alias("n"))
        if center is None:
            center = joined.select("sign", F.col("to").alias("head"), F.col("step").alias("extra"), "n")
        else:
            moved = center.join(joined.select(F.col("sign").alias("head"), "to", "step"), "head", "left").select(
                "sign", F.coalesce("to", "head").alias("head"), (F.col("extra") + F.coalesce("step", F.lit(0))).alias("extra"), "n")
            fresh = joined.join(center.select("sign"), "sign", "left_anti").select("sign", F.col("to").alias("head"), F.col("step").alias("extra"), "n")
            center = moved.union(fresh)
        center = store(center)
        standing = entries.join(center.select("sign", "head"), "sign", "left").groupBy(
            "token", F.coalesce("head", "sign").alias("sign")).agg(F.max("rest").alias("rest"))

    # heads that meet in a list, with what holds for all their members
    stood = entries.join(center.select("sign", "head"), "sign", "left").groupBy("token", F.coalesce("head", "sign").alias("head")).agg(
        F.min("n").alias("least"), F.max("n").alias("most"), F.max("rest").alias("rest"))
    x, y = stood.alias("x"), stood.alias("y")
    meet = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.head") < F.col("y.head"))
                  & F.expr(f"100L * x.most >= {PERCENT}L * y.least AND 100L * y.most >= {PERCENT}L * x.least")
                  & F.expr(_LINK.format(o="(1 + least(x.rest, y.rest))", n="x.least", m="y.least")))
    heads = meet.select(F.col("x.head").alias("a"), F.col("y.head").alias("b")).distinct()
    second = _verify(heads, docs, names)
    more = second.where(linked)

    # members of heads that do not link, where they meet themselves and the overlap of the heads leaves room
    own = entries.join(center.select("sign", "head", "extra"), "sign", "left").select(
        "token", "sign", "n", "rest", F.coalesce("head", "sign").alias("head"), F.coalesce("extra", F.lit(0)).alias("extra"))
    x, y = own.alias("x"), own.alias("y")
    close = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.head") != F.col("y.head"))
                   & F.expr("x.n < y.n OR x.n = y.n AND x.sign < y.sign") & F.expr("x.sign <> x.head OR y.sign <> y.head")
                   & F.expr(f"100L * x.n >= {PERCENT}L * y.n") & F.expr(_LINK.format(o="(1 + least(x.rest, y.rest))", n="x.n", m="y.n")))
    members_met = close.select(
        F.least("x.head", "y.head").alias("a"), F.greatest("x.head", "y.head").alias("b"), F.col("x.sign").alias("sx"), F.col("y.sign").alias("sy"),
        F.col("x.n").alias("nx"), F.col("y.n").alias("ny"), (F.col("x.extra") + F.col("y.extra")).alias("extra")).distinct()
    apart = second.where(f"NOT ({linked})").select("a", "b", "common")
    room = _LINK.format(o="least(common + extra, nx)", n="nx", m="ny")
    rest = members_met.join(apart, ["a", "b"]).where(room)
    third = _verify(rest.select(F.least("sx", "sy").alias("a"), F.greatest("sx", "sy").alias("b")).distinct(), docs, names)

    roots = components(links.union(more).union(third.where(linked)).select("a", "b"))
    named = members.join(roots.withColumnRenamed("node", "sign"), "sign", "left").withColumn("root", F.coalesce("root", "sign"))
    smallest = store(named.where("n_shingles > 0").groupBy("root").agg(F.min("doc_id").alias("component")))
    return named.join(smallest, "root", "left").select(
        "doc_id", "n_shingles", "sign", F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents without those that reach a smaller doc_id; all columns stay."""
    gone = store(jaccard_groups(docs).where("component_id < doc_id").select(F.col("doc_id").alias("_gone")).distinct())
    return docs.join(broadcast_if_small(gone), docs["doc_id"] == F.col("_gone"), "left_anti")


@query(sql=rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({SQL_LOWER.format("text")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 3], ' ') END AS g
      FROM d, unnest(range(1, greatest(len(w) - 2, 2))) AS t(i) WHERE len(w) > 0),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS MATERIALIZED (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM s AS x JOIN s AS y USING (g) WHERE x.doc_id <> y.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM o JOIN n AS p ON p.doc_id = a JOIN n AS q ON q.doc_id = b WHERE 100 * o >= 85 * (p.n + q.n - o)),
r AS (SELECT doc_id, doc_id AS c FROM d UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.c = l.a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) USING (doc_id)""")
def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
