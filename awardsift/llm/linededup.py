"""Incremental, reversible line dedup: sharded cuckoo filters backed by exact reference counts.

A line's key is the line without white space at its ends, A-Z lower-cased, as 128 bits of XXH3. The exact side is
a log of references (key, document, lines): inserting documents appends them, deleting documents appends their
negative, so a key's holders and its smallest holder are always known and every step can be undone. On top, one
cuckoo filter a shard of the key space holds the keys that at least two documents hold. A dedup pass over texts
probes the filters and looks only the remaining lines up in the exact table; the filters follow insertions
and deletions key by key, and a shard without room is built anew from the exact table.

Filters are broadcast when all of them together are within ``BLOCK_BYTES``; beyond that the pass joins the lines'
keys with the exact table directly. Both ways give the same result. Counts are combined before every shuffle, so a
line that a third of all documents hold costs one row a task.

Defined results: null or empty texts are one empty line and stay; keys of fewer than ``SHORTEST`` code points
are never dropped; several rows with one doc_id are one document; rows without a doc_id hold and lose nothing; an
empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cuckoo import CuckooFilter, Full
from .data import BLOCK_BYTES, folder, only, query, ship_package, store, table
from .words import WHITE

SHORTEST = 10
#: Keys that share a filter, about; the number of shards follows from the number of keys.
SHARD_KEYS = 1 << 17

_KEYS = "doc_id long, hi long, lo long, refs long"


def keys_of(text: bytes) -> Iterator[bytes | None]:
    """The 128-bit key of every line, None for lines that are too short to count."""
    for line in text.lower().split(b"\n"):  # bytes.lower() changes A-Z only
        key = line.strip(WHITE)
        long = len(key) >= SHORTEST and (len(key) >= 4 * SHORTEST or len(key.decode(errors="replace")) >= SHORTEST)
        yield xxhash.xxh3_128_digest(key) if long else None


def _halves(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(keys), ">i8").reshape(-1, 2).astype(np.int64)
    return both[:, 0], both[:, 1]


def _encoded(batch: pa.RecordBatch, place: int) -> Iterator[bytes]:
    for value in batch.column(place):
        yield (value.as_py() or "").encode()


def _references(batches):
    for batch in batches:
        ids, keys, refs = [], [], []
        for doc, text in zip(batch.column(0).to_pylist(), _encoded(batch, 1)):
            counts: dict[bytes, int] = {}
            for key in keys_of(text):
                if key is not None:
                    counts[key] = counts.get(key, 0) + 1
            ids += [doc] * len(counts)
            keys += counts
            refs += counts.values()
        if ids:
            hi, lo = _halves(keys)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hi), pa.array(lo), pa.array(refs, pa.int64())],
                                             names=["doc_id", "hi", "lo", "refs"])


class LineIndex:
    """The index in a folder that all executors share: reference log, exact counts and filters."""

    def __init__(self, spark: SparkSession, path: str):
        ship_package(spark)
        self.spark, self.path = spark, path
        self.batches: list[str] = []
        self.deleted = False
        self.filters: DataFrame | None = None
        self.shards = 1

    # ---- the exact side

    def log(self) -> DataFrame:
        return self.spark.read.schema(_KEYS).parquet(*self.batches)

    def _holders(self, log: DataFrame) -> DataFrame:
        """(hi, lo, first, last, holders) of keys somebody holds."""
        if self.deleted:
            log = log.groupBy("hi", "lo", "doc_id").agg(F.sum("refs").alias("refs")).where("refs > 0")
        return log.groupBy("hi", "lo").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.sum("refs").alias("refs"))

    def shared(self) -> DataFrame:
        """Keys that two documents at least hold, with the smallest of them and the number of lines."""
        return self._holders(self.log()).where("first <> last")

    def _append(self, rows: DataFrame) -> None:
        path = f"{self.path}/log-{len(self.batches)}"
        rows.write.parquet(path)
        self.batches.append(path)

    # ---- changes

    def insert(self, docs: DataFrame) -> LineIndex:
        """Take in documents (doc_id, text) that are not in the index yet."""
        rows = only(docs, "doc_id", "text").where("doc_id IS NOT NULL").mapInArrow(_references, _KEYS)
        return self._change(rows)

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        """Take documents (doc_id) out again; their lines count as if they had never been there."""
        held = self.log().join(only(doc_ids, "doc_id").distinct(), "doc_id", "left_semi")
        undone = held.groupBy("doc_id", "hi", "lo").agg((-F.sum("refs")).alias("refs")).where("refs <> 0")
        self.deleted = True
        return self._change(undone)

    def _change(self, rows: DataFrame) -> LineIndex:
        fresh = not self.batches
        self._append(rows)
        if fresh:
            return self
        if self.filters is None:
            return self
        batch = self.spark.read.schema(_KEYS).parquet(self.batches[-1])
        touched = self.log().join(batch.select("hi", "lo").distinct(), ["hi", "lo"], "left_semi")
        before = self.spark.read.schema(_KEYS).parquet(*self.batches[:-1]).join(batch.select("hi", "lo").distinct(), ["hi", "lo"], "left_semi")
        now = self._holders(touched).where("first <> last").select("hi", "lo", F.lit(1).alias("now"))
        then = self._holders(before).where("first <> last").select("hi", "lo", F.lit(1).alias("then"))
        moved = now.join(then, ["hi", "lo"], "full").where("now IS NULL OR then IS NULL")
        changes = moved.select(self._shard(self.shards).alias("shard"), F.col("lo"), F.coalesce("now", F.lit(0)).alias("now"))
        updated = store(self.filters.groupBy("shard").cogroup(changes.groupBy("shard")).applyInArrow(_update, "shard long, filter binary"))
        self.filters = None if updated.where("filter IS NULL").count() else updated
        return self

    # ---- the filters

    @staticmethod
    def _shard(shards: int):
        return F.pmod(F.col("hi"), F.lit(shards))

    def build(self) -> LineIndex:
        """Build the filters of all shards from the exact counts."""
        self.counts = store(self.shared())
        self.shards = max(1, -(-self.counts.count() // SHARD_KEYS))
        keyed = self.counts.select(self._shard(self.shards).alias("shard"), "lo")
        self.filters = store(keyed.groupBy("shard").applyInArrow(_build, "shard long, filter binary"))
        return self

    # ---- use

    def _candidates(self, docs: DataFrame) -> DataFrame:
        """Distinct (doc_id, hi, lo) of lines that may be shared."""
        size = self.filters.agg(F.coalesce(F.sum(F.octet_length("filter")), F.lit(0))).first()[0]
        if size > BLOCK_BYTES:
            return self.log().select("doc_id", "hi", "lo").distinct()
        known = self.spark.sparkContext.broadcast(({r.shard: bytes(r["filter"]) for r in self.filters.collect()}, self.shards))
        return docs.mapInArrow(_prober(known), "doc_id long, hi long, lo long")

    def dropped(self, docs: DataFrame) -> DataFrame:
        """(doc_id, keys): the keys whose lines each document loses, 16 bytes a key."""
        if self.filters is None:
            self.build()
        exact = self.shared() if self.deleted or len(self.batches) > 1 else self.counts
        lost = self._candidates(docs).join(exact.select("hi", "lo", "first"), ["hi", "lo"]).where("doc_id > first")
        pair = F.concat(F.lpad(F.hex("hi"), 16, "0"), F.lpad(F.hex("lo"), 16, "0"))
        return lost.groupBy("doc_id").agg(F.concat_ws("", F.collect_set(pair)).alias("_keys"))

    def dedup(self, docs: DataFrame) -> DataFrame:
        """Documents of the index without the lines that a document with a smaller id holds.

        The text is replaced; ``n_lines`` and ``n_dropped`` are added; all other columns stay.
        """
        plain = docs.drop("n_lines", "n_dropped")
        lost = self.dropped(only(plain, "doc_id", "text").where("doc_id IS NOT NULL"))
        joined = plain.join(lost, "doc_id", "left").select(*[f"`{c}`" for c in plain.columns], "_keys")
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields)
        place = plain.columns.index("text")

        def rewrite(batches):
            for batch in batches:
                texts, lines, drops = [], [], []
                for text, keys in zip(batch.column(place), batch.column(batch.num_columns - 1)):
                    raw = text.as_py()
                    parts = (raw or "").split("\n")
                    gone = 0
                    if keys.is_valid and keys.as_py():
                        found = bytes.fromhex(keys.as_py())
                        lost = {found[k : k + 16] for k in range(0, len(found), 16)}
                        kept = [part for part, key in zip(parts, keys_of(raw.encode())) if key is None or key not in lost]
                        gone = len(parts) - len(kept)
                        raw = "\n".join(kept)
                    texts.append(raw)
                    lines.append(len(parts))
                    drops.append(gone)
                columns = [pa.array(texts, pa.string()) if k == place else batch.column(k) for k in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(lines, pa.int64()), pa.array(drops, pa.int64())],
                                                 names=[*batch.schema.names[:-1], "n_lines", "n_dropped"])

        return joined.mapInArrow(rewrite, f"{kinds}, n_lines long, n_dropped long")


def _build(part: pa.Table) -> pa.Table:
    made = CuckooFilter.of(part.column("lo").to_numpy(), 1.5)
    return pa.table({"shard": [part.column("shard")[0].as_py()], "filter": [made.dumps()]})


def _update(old: pa.Table, changes: pa.Table) -> pa.Table:
    """A shard's filter after its changes; null if it has to be built anew."""
    shard = (old if old.num_rows else changes).column("shard")[0].as_py()
    made = CuckooFilter.loads(old.column("filter")[0].as_py()) if old.num_rows else CuckooFilter(1024)
    data: bytes | None = None
    try:
        if changes.num_rows:
            now, keys = changes.column("now").to_numpy() == 1, changes.column("lo").to_numpy()
            made.delete(keys[~now])
            made.insert(keys[now])
        data = made.dumps()
    except Full:
        pass
    return pa.table({"shard": pa.array([shard], pa.int64()), "filter": pa.array([data], pa.binary())})


def _prober(known):
    def probe(batches):
        blobs, shards = known.value
        filters = {shard: CuckooFilter.loads(blob) for shard, blob in blobs.items()}
        for batch in batches:
            ids, keys = [], []
            for doc, text in zip(batch.column(0).to_pylist(), _encoded(batch, 1)):
                own = {key for key in keys_of(text) if key is not None}
                ids += [doc] * len(own)
                keys += own
            if not ids:
                continue
            hi, lo = _halves(keys)
            shard = hi % shards
            maybe = np.zeros(len(hi), bool)
            for k in np.unique(shard):
                if k in filters:
                    mine = np.flatnonzero(shard == k)
                    maybe[mine] = filters[k].contains(lo[mine])
            if maybe.any():
                yield pa.RecordBatch.from_arrays([pa.array(np.array(ids, np.int64)[maybe]), pa.array(hi[maybe]), pa.array(lo[maybe])],
                                                 names=["doc_id", "hi", "lo"])
    return probe


def deduplicated(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One whole table through a new index."""
    return LineIndex(spark, folder(spark, "lines")).insert(docs).dedup(docs)


@query(sql=r"""
WITH l AS (SELECT doc_id, i, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
           FROM (SELECT doc_id, p, unnest(p) AS line, unnest(range(len(p))) AS i
                 FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS p FROM documents))),
s AS (SELECT k, min(doc_id) AS first FROM l WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1),
m AS (SELECT l.*, s.k IS NOT NULL AND doc_id <> first AS gone FROM l LEFT JOIN s USING (k))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id""")
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = deduplicated(spark, only(table(spark, sf_dir, "documents"), "doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
