"""Substring dedup with an FM-index per shard.

A window is ``WINDOW`` consecutive words of one document. A word goes when a window that covers it also starts in a
document with a smaller id. Windows find their copies as follows.

* **Routing.** The minimizer of a window is the least hash among its ``GRAM``-word sequences, so equal windows have equal
  minimizers. Consecutive windows with one minimizer form a passage of at most 20 words; passages go to shards by
  minimizer, so all copies of a window meet in one shard, and no text is streamed past every shard.
* **Filter.** Minimizers are counted exactly over all documents, then the windows of shared minimizers. Those in two texts or
  more go into a Bloom filter of at most ``FILTER_BITS`` bits, whatever the size of the data; a window that is absent has no copy.
  A fuller filter only lets more windows through.
* **Index.** Equal passages are one, owned by their smallest document. Each shard builds a compressed FM-index over its
  passages and streams them back through it: backward search over the wavelet matrix gives the matching statistics, capped
  at the window's length, and with each full match the smallest owner of its interval. Windows whose owner is smaller
  than the passage's own document are reported; documents other than the owner lose all windows of the passage.
* **Hot minimizers.** Where more than ``HOT`` passages share one minimizer, their windows are grouped by content
  instead, with the smallest owner combined before the shuffle. This is exact as well, and no shard outgrows its task.

Defined results: null or empty texts have no words; several rows with one doc_id are one document (none of them is
smaller than another); rows without a doc_id neither lose words nor make others lose them; an empty table gives an empty
table.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import broadcast_if_small
from .counts import classes_of, counted
from .data import SQL_SPACED, only, query, ship_package, store, table
from .fmindex import FMIndex
from .words import SPACED, Words, mix, words

WINDOW = 13
GRAM = 6
FILTER_BITS = 1 << 29
BLOCK_BITS = 1 << 19
#: Different passages of one minimizer that an index may hold, and words of passages in a shard, about.
HOT = 20_000
SHARD_WORDS = 400_000


def windows_of(found: Words) -> tuple[np.ndarray, ...]:
    """First word, hash, place of the minimizer and minimizer of every window of some texts."""
    single = found.hashes()
    at, grams = found.windows(GRAM, single)
    starts, hashes = found.windows(WINDOW, single)
    full = np.full(max(len(single), WINDOW), np.iinfo(np.uint64).max, np.uint64)
    full[at] = grams
    least = starts + np.lib.stride_tricks.sliding_window_view(full, WINDOW - GRAM + 1)[starts].argmin(axis=1)
    return starts, hashes, least, full[least]


def passages_of(starts: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first window and number of words of each run of neighbouring windows with one minimizer."""
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    first = np.flatnonzero(np.concatenate(([True], (least[1:] != least[:-1]) | (starts[1:] != starts[:-1] + 1))))
    return first, np.diff(np.append(first, len(starts))) + WINDOW - 1


def _by_text(found: Words, starts: np.ndarray, values: np.ndarray):
    """The distinct values of each text that has any."""
    rows = np.searchsorted(found.first, starts, "right") - 1
    for part in np.split(values, np.flatnonzero(np.diff(rows)) + 1):
        if len(part):
            yield np.unique(part)


def _minimizers(column):
    for _, _, found in words(column, SPACED):
        starts, _, least, minimizer = windows_of(found)
        first, _ = passages_of(starts, least)
        yield from _by_text(found, starts[first], minimizer[first])


def _windows(shared, column):
    """Hashes of the windows whose minimizer may be shared."""
    for _, _, found in words(column, SPACED):
        starts, hashes, _, minimizer = windows_of(found)
        keep = _contains(shared.value, minimizer)
        yield from _by_text(found, starts[keep], hashes[keep])


def _places(classes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    x = classes.astype(np.uint64)
    return tuple((mix(x ^ np.uint64(seed)) & np.uint64(size - 1)).astype(np.int64) for seed in (0x51, 0xC3A9))


def _contains(known: tuple[np.ndarray, int], hashes: np.ndarray) -> np.ndarray:
    table, bits = known
    out = np.ones(len(hashes), bool)
    for place in _places(classes_of(hashes, bits), len(table) << 6):
        out &= (table[place >> 6] >> (place & 63)) & 1 == 1
    return out


def _filter(shared: DataFrame) -> np.ndarray:
    """A Bloom filter of the shared classes as 64-bit words, at most FILTER_BITS bits.

    Tasks set the bits, a block of BLOCK_BITS at a time; the driver gets the finished blocks and puts them side by side.
    """
    size = min(FILTER_BITS, 1 << max(10, int(16 * shared.count()).bit_length()))
    width = min(size, BLOCK_BITS)

    def places(batches):
        for batch in batches:
            place = np.unique(np.concatenate(_places(batch.column(0).to_numpy(), size)))
            block = place // width
            first = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1]))) if len(block) else []
            parts = np.split((place % width).astype(np.int32), first[1:]) if len(block) else []
            yield pa.RecordBatch.from_pydict({"block": pa.array(block[first] if len(block) else [], pa.int64()),
                                              "places": pa.array([x.tobytes() for x in parts], pa.binary())})

    def fill(part: pa.Table) -> pa.Table:
        bits = np.zeros(width, bool)
        for x in part.column("places"):
            bits[np.frombuffer(x.as_py(), np.int32)] = True
        return pa.table({"block": [part.column("block")[0].as_py()], "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    blocks = shared.select("class").mapInArrow(places, "block long, places binary").groupBy("block").applyInArrow(fill, "block long, bits binary")
    out = np.zeros(size >> 6, np.int64)
    for row in blocks.collect():
        at = row.block * width >> 6
        out[at : at + (width >> 6)] = np.frombuffer(row.bits, np.int64)
    return out


def _passages(shared):
    """Passages of windows that may be shared: key, document and place; the first of a batch has its text and the batch's smallest document."""
    def emit(batches):
        for batch in batches:
            ids, marks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            seen: dict[bytes, int] = {}
            out: list[list] = [[] for _ in range(8)]
            owners = out[7]
            for row, _, found in words(batch.column(2), SPACED):
                starts, hashes, least, minimizer = windows_of(found)
                keep = _contains(shared.value, hashes)
                starts, least, minimizer = starts[keep], least[keep], minimizer[keep]
                first, count = passages_of(starts, least)
                start = starts[first]
                rows = np.searchsorted(found.first, start, "right") - 1
                begins, ends = found.starts, found.ends
                for s, n, k, m in zip(start.tolist(), count.tolist(), rows.tolist(), minimizer[first].view(np.int64).tolist()):
                    text = b" ".join(found.data[begins[s] : ends[s + n - 1]].tobytes().split(None))
                    key, doc = xxhash.xxh3_128_digest(text), ids[row + k]
                    at = seen.get(key)
                    if at is None:
                        seen[key] = len(owners)
                        values = (key, doc, marks[row + k], s - int(found.first[k]), n, m, text.decode(), doc)
                    else:
                        owners[at] = min(owners[at], doc)
                        values = (key, doc, marks[row + k], s - int(found.first[k]), n, None, None, None)
                    for column, value in zip(out, values):
                        column.append(value)
            if owners:
                kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(out, kinds)],
                                                 names=["key", "doc_id", "mark", "start", "n", "least", "words", "owner"])
    return emit


def _matched(part: pa.Table) -> pa.Table:
    """The different passages of a shard with their smallest document, and their windows that a smaller one has, as bits by place."""
    best: dict[bytes, list] = {}
    for key, owner, text in zip(*(part.column(name).to_pylist() for name in ("key", "owner", "words"))):
        if (known := best.setdefault(key, [owner, text]))[0] > owner:
            known[0] = owner
    owners = np.array([owner for owner, _ in best.values()], np.int64)
    ids: dict[str, int] = {}
    passages = [np.array([ids.setdefault(w, len(ids) + 1) for w in text.split(" ")]) for _, text in best.values()]
    _, least = FMIndex(passages, owners, WINDOW).matching(passages)
    bits = [int(((own[: len(own) - WINDOW + 1] < mine) << np.arange(len(own) - WINDOW + 1)).sum()) for own, mine in zip(least, owners)]
    return pa.table({"key": pa.array(list(best), pa.binary()), "owner": pa.array(owners), "bits": pa.array(bits, pa.int64())})


def covered(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """(doc_id, mark, hits): for each text with removed windows the places of passages and their windows, as bits."""
    spark = docs.sparkSession
    ship_package(spark)
    texts = only(docs, "doc_id", "text").where("doc_id IS NOT NULL").select("doc_id", F.xxhash64("text").alias("mark"), "text")
    shared, bits = counted(texts, "text", _minimizers, 2)
    known = spark.sparkContext.broadcast((_filter(shared), bits))
    shared, bits = counted(texts, "text", partial(_windows, known), 2)
    known = spark.sparkContext.broadcast((_filter(shared), bits))
    found = store(texts.mapInArrow(_passages(known), "key binary, doc_id long, mark long, start long, n long, least long, words string, owner long"))

    spelled = found.where("words IS NOT NULL").select("key", "owner", "least", "words")  # one row a batch and passage
    crowded = store(spelled.groupBy("least").count().where(F.col("count") > hot).select("least"))
    total = found.where("words IS NOT NULL").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shards = max(1, -(-int(total) // SHARD_WORDS))
    few = spelled.join(broadcast_if_small(crowded), "least", "left_anti")
    placed = few.select(F.pmod(F.xxhash64("least"), F.lit(shards)).alias("shard"), "key", "owner", "words")
    indexed = placed.groupBy("shard").applyInArrow(_matched, "key binary, owner long, bits long")

    # windows of crowded minimizers, by content
    many = spelled.join(broadcast_if_small(crowded), "least", "left_semi").groupBy("key").agg(F.min("owner").alias("owner"), F.max("words").alias("words"))
    window = many.withColumn("w", F.split("words", " ")).select("key", "owner", F.posexplode(F.expr(
        f"transform(sequence(1, size(w) - {WINDOW - 1}), i -> array_join(slice(w, i, {WINDOW}), ' '))")).alias("at", "window"))
    first = window.groupBy("window").agg(F.min("owner").alias("smallest"))
    grouped = window.join(first, "window").groupBy("key").agg(F.max("owner").alias("owner"), F.sum(
        F.when(F.col("smallest") < F.col("owner"), F.expr("shiftleft(1L, at)")).otherwise(F.lit(0))).alias("bits"))

    known_bits = store(indexed.union(grouped))
    all_windows = F.expr(f"shiftleft(1L, cast(n - {WINDOW - 1} as int)) - 1")
    hits = found.select("key", "doc_id", "mark", "start", "n").join(known_bits, "key").select(
        "doc_id", "mark", "start", F.when(F.col("doc_id") > F.col("owner"), all_windows).otherwise(F.col("bits")).alias("bits"))
    return hits.where("bits <> 0").groupBy("doc_id", "mark").agg(F.collect_list(F.struct("start", "bits")).alias("hits"))


def _spans(hits: list[dict], size: int) -> np.ndarray:
    """Which words are covered."""
    edge = np.zeros(size + 1, np.int64)
    for hit in hits:
        bits, start = hit["bits"], hit["start"]
        while bits:
            k = (bits & -bits).bit_length() - 1
            edge[start + k] += 1
            edge[start + k + WINDOW] -= 1
            bits &= bits - 1
    return np.cumsum(edge[:-1]) > 0


def without_repeats(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """All documents with ``text`` as their kept words joined by one space, ``n_words`` and ``n_removed``; other columns stay."""
    plain = docs.drop("n_words", "n_removed")
    hits = covered(plain, hot).withColumnsRenamed({"doc_id": "_doc", "mark": "_mark", "hits": "_hits"})
    joined = plain.join(hits, (F.col("doc_id") == F.col("_doc")) & (F.xxhash64("text") == F.col("_mark")), "left")
    joined = joined.select(*[f"`{c}`" for c in plain.columns], "_hits")
    place = plain.columns.index("text")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields)

    def rewrite(batches):
        for batch in batches:
            texts, counts, gone = [], [], []
            for text, hits in zip(batch.column(place), batch.column(batch.num_columns - 1)):
                spelled = (text.as_py() or "").encode().split(None)
                kept = spelled
                if hits.is_valid:
                    kept = [w for w, lost in zip(spelled, _spans(hits.as_py(), len(spelled)).tolist()) if not lost]
                texts.append(b" ".join(kept).decode())
                counts.append(len(spelled))
                gone.append(len(spelled) - len(kept))
            columns = [pa.array(texts, pa.string()) if k == place else batch.column(k) for k in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), pa.array(gone, pa.int64())],
                                             names=[*batch.schema.names[:-1], "n_words", "n_removed"])

    return joined.mapInArrow(rewrite, f"{kinds}, n_words long, n_removed long")


@query(sql=rf"""
WITH d AS (SELECT doc_id, {SQL_SPACED.format("text")} AS w FROM documents),
x AS (SELECT doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS g FROM d, unnest(range(1, len(w) - {WINDOW - 2})) AS t(i) WHERE len(w) >= {WINDOW}),
f AS (SELECT g, min(doc_id) AS first FROM x GROUP BY g HAVING min(doc_id) <> max(doc_id)),
c AS (SELECT DISTINCT doc_id, p FROM x JOIN f USING (g), unnest(range(i, i + {WINDOW})) AS t(p) WHERE doc_id > first),
k AS (SELECT d.doc_id, p, w[p] AS word, c.p IS NOT NULL AS gone
      FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d) AS d LEFT JOIN c USING (doc_id, p)),
s AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (NOT gone) AS kept FROM k GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN s USING (doc_id)""")
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = without_repeats(only(table(spark, sf_dir, "documents"), "doc_id", "text"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
