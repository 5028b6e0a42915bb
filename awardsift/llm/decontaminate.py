"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned over training windows.

Items of the benchmark give all their windows of ``WINDOW`` words, items with fewer words (but not none) one
window of all of them. The windows' hashes are broadcast; every window of every text is probed, first in a byte
map, then in the sorted hashes, and each hit is verified word by word before it counts.

The benchmark is measured: up to ``BLOCK_BYTES`` of text go into one broadcast, a larger benchmark is cut into
blocks of whole items that are scanned one after another in the same pass over the documents, without a shuffle.

Defined results: null or empty texts have no words and are clean; the windows of items without an
id hit like all others, only ``hit_items`` does not name them; repeated items count once; an empty benchmark hits nothing; repeated documents each get their own row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .data import BLOCK_BYTES, SQL_ALNUM, only, query, ship_package, table
from .words import ALNUM, LOWER, Words, words

WINDOW = 13
#: A document is contaminated if at least one in so many of its words is hit.
SHARE = 20


class Grams:
    """All windows of some benchmark items: exact texts by item, hashes by length, and a byte map for quick misses."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int = WINDOW):
        self.window, self.owners, by_length = window, {}, {}
        for item, text in items:
            data = np.frombuffer(text, np.uint8)
            found = Words(data, np.array([0, len(data)]), ALNUM, True)
            n = min(window, len(found.starts))
            if not n:
                continue
            at, hashes = found.windows(n, found.hashes())
            by_length.setdefault(n, []).append(hashes)
            spelled = spell(found)
            for i in at:
                self.owners.setdefault(b" ".join(spelled[i : i + n]), set()).update(() if item is None else (item,))
        self.hashes = {n: np.unique(np.concatenate(h)) for n, h in sorted(by_length.items())}
        self.bits = {n: max(16, int(len(h) * 16).bit_length()) for n, h in self.hashes.items()}
        self.maps = {}
        for n, h in self.hashes.items():
            self.maps[n] = np.zeros(1 << self.bits[n], bool)
            self.maps[n][h >> np.uint64(64 - self.bits[n])] = True

    def hits(self, found: Words) -> Iterator[tuple[int, int, set[str]]]:
        """First word, length and owners of every verified occurrence."""
        if not self.hashes or not len(found.starts):
            return
        single = found.hashes()
        for n, known in self.hashes.items():
            at, hashes = found.windows(n, single)
            maybe = self.maps[n][hashes >> np.uint64(64 - self.bits[n])]
            at, hashes = at[maybe], hashes[maybe]
            place = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            for i in at[known[place] == hashes]:
                owners = self.owners.get(b" ".join(spell(found, int(i), int(i) + n)))
                if owners is not None:
                    yield int(i), n, owners


def spell(found: Words, begin: int = 0, end: int | None = None) -> list[bytes]:
    """The lower-cased words themselves."""
    pairs = zip(found.starts[begin:end].tolist(), found.ends[begin:end].tolist())
    return [found.data[a:b].tobytes().translate(LOWER) for a, b in pairs]


def blocks_of(benchmark: DataFrame, limit: int = BLOCK_BYTES) -> Iterator[list[tuple[str | None, bytes]]]:
    """Whole items in blocks of about ``limit`` bytes; each block is fetched on its own."""
    items = only(benchmark, "item_id", "text").where("text IS NOT NULL").select(
        F.col("item_id").cast("string").alias("item"), "text")
    volume = items.agg(F.coalesce(F.sum(F.octet_length("text") + 32), F.lit(0))).first()[0]
    count = max(1, -(-int(volume) // (limit // 2)))
    for k in range(count):
        part = items if count == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(count)) == k)
        yield [(r.item, r.text.encode()) for r in part.distinct().collect()]


def scan_documents(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                   block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Add ``hit_spans`` (first word, length) and ``hit_items`` to documents; all their columns stay.

    Spans are merged and sorted; lengths and places count words. ``n_words`` is added as well.
    """
    ship_package(spark)
    plain = docs.drop("n_words", "hit_spans", "hit_items")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields)
    schema = f"{kinds}, n_words long, hit_spans array<struct<first: long, length: long>>, hit_items array<string>"
    out = plain.withColumns({"n_words": F.lit(None).cast("long"),
                             "hit_spans": F.lit(None).cast("array<struct<first: long, length: long>>"),
                             "hit_items": F.lit(None).cast("array<string>")})
    for items in blocks_of(benchmark, block_bytes):
        grams = spark.sparkContext.broadcast(Grams(items, window))
        out = out.mapInArrow(_scanner(grams), schema)
    return out


def _scanner(grams):
    def scan(batches):
        for batch in batches:
            counts, spans, items = _scan(batch, grams.value)
            keep = [batch.column(k) for k in range(batch.num_columns - 3)]
            kind = pa.list_(pa.struct([("first", pa.int64()), ("length", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [*keep, pa.array(counts, pa.int64()), pa.array(spans, kind), pa.array(items, pa.list_(pa.string()))],
                names=batch.schema.names)
    return scan


def _scan(batch: pa.RecordBatch, grams: Grams):
    names = batch.schema.names
    old_spans, old_items = batch.column(names.index("hit_spans")), batch.column(names.index("hit_items"))
    counts = np.zeros(batch.num_rows, np.int64)
    spans: list[list[dict]] = [[] for _ in range(batch.num_rows)]
    items: list[set[str]] = [set() for _ in range(batch.num_rows)]
    if old_spans.null_count < batch.num_rows:
        spans, items = [s or [] for s in old_spans.to_pylist()], [set(s or ()) for s in old_items.to_pylist()]
    for row, end, found in words(batch.column(names.index("text")), ALNUM, True):
        counts[row:end] = found.counts
        for at, n, owners in grams.hits(found):
            k = int(np.searchsorted(found.first, at, "right")) - 1
            spans[row + k].append({"first": at - int(found.first[k]), "length": n})
            items[row + k] |= owners
    return counts, [merge(s) for s in spans], [sorted(s) for s in items]


def merge(spans: list[dict]) -> list[dict]:
    out: list[dict] = []
    for span in sorted(spans, key=lambda s: s["first"]):
        if out and span["first"] <= out[-1]["first"] + out[-1]["length"]:
            out[-1]["length"] = max(out[-1]["length"], span["first"] + span["length"] - out[-1]["first"])
        else:
            out.append(dict(span))
    return out


N_HIT = "aggregate(hit_spans, 0L, (n, s) -> n + s.length)"


def flagged(scanned: DataFrame) -> DataFrame:
    """Add ``n_hit`` and ``contaminated`` to scanned documents."""
    return scanned.withColumn("n_hit", F.expr(N_HIT)).withColumn(
        "contaminated", F.expr(f"n_hit > 0 AND {SHARE}L * n_hit >= n_words"))


def remove_documents(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with their own columns."""
    return flagged(scan_documents(spark, docs, benchmark)).where("NOT contaminated").select(*[f"`{c}`" for c in docs.columns])


def remove_spans(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """All documents, with the hit words cut out of the text (from the first hit word's start to the last one's end)."""
    scanned = scan_documents(spark, docs, benchmark)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in scanned.schema.fields)

    def cut(batches):
        for batch in batches:
            names = batch.schema.names
            t = names.index("text")
            old, spans = batch.column(t), batch.column(names.index("hit_spans")).to_pylist()
            new = old.to_pylist()
            for row, _, found in words(old, ALNUM, True):
                for k in range(len(found.first) - 1):
                    if spans[row + k]:
                        text, base, at, parts = found.text(k), int(found.bounds[k]), 0, []
                        for s in spans[row + k]:
                            i = int(found.first[k]) + s["first"]
                            parts.append(text[at : int(found.starts[i]) - base])
                            at = int(found.ends[i + s["length"] - 1]) - base
                        new[row + k] = b"".join([*parts, text[at:]]).decode()
            columns = [pa.array(new, old.type) if k == t else batch.column(k) for k in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return scanned.mapInArrow(cut, schema).select(*[f"`{c}`" for c in docs.columns])


@query(sql=rf"""
WITH d AS (SELECT doc_id, {SQL_ALNUM.format("text")} AS w FROM documents),
b AS (SELECT DISTINCT item_id, {SQL_ALNUM.format("text")} AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS gram
      FROM b, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS t(i) WHERE len(w) > 0),
lengths AS (SELECT DISTINCT n FROM g),
x AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS gram
      FROM d, lengths, unnest(range(1, len(w) - n + 2)) AS t(i) WHERE len(w) >= n),
h AS (SELECT doc_id, i, x.n, item_id FROM x JOIN g USING (gram) WHERE x.n = g.n),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM h, unnest(range(i, i + n)) AS t(p) GROUP BY doc_id),
own AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN own USING (doc_id)""")
def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = only(table(spark, sf_dir, "documents"), "doc_id", "text")
    scanned = flagged(scan_documents(spark, docs, table(spark, sf_dir, "benchmark")))
    return scanned.select(
        "doc_id", "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), "contaminated",
    )
