"""Sharding by proportional stratified interleaving.

The rows of each source are shuffled by a seeded hash and ranked; a row's fractional rank is (rank + 1/2) / rows of
its source. Sorted by fractional rank, the sources are interleaved in proportion everywhere, so any contiguous cut
has the mixture of the whole table. The cut is by rows: shard sizes differ by one at most.

No source is ranked in one task: places come from range-partitioned sorts (see ``order.placed``), whose order is
refined by the hash, so a source with a third of all rows is spread over the tasks like any other.

Defined results: a null source is a source of its own; null or empty texts are placed like all others; repeated
rows are all placed; an empty table gives an empty table; other columns stay, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import broadcast_if_small
from .data import only, query, table
from .order import placed

SHARDS = 8
SEED = "shard-1"


def interleave(docs: DataFrame, shards: int = SHARDS, source: str = "source", key: str = "doc_id", seed: str = SEED) -> DataFrame:
    """Add ``shard`` (from 0) and ``slot`` (gapless from 0 in each shard) to all rows; all other columns stay."""
    columns = [c for c in docs.columns if c not in ("shard", "slot")]
    keyed = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)])
    at = {c: f"c{i}" for i, c in enumerate(columns)}
    shuffled = keyed.withColumns({
        "_source": F.concat(F.lit("s"), F.col(at[source])),
        "_hash": F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col(at[key]).cast("string"))), 1, 16),
    }).withColumn("_source", F.coalesce("_source", F.lit("n")))
    ranked = placed(shuffled, ["_source", "_hash", at[key]], "_rank")
    sizes = ranked.groupBy("_source").agg(F.min("_rank").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    fraction = (2 * (F.col("_rank") - F.col("_first")) + 1).cast("double") / (2 * F.col("_rows")).cast("double")
    fractions = ranked.join(broadcast_if_small(sizes), "_source").withColumn("_fraction", fraction).drop("_rank", "_first", "_rows")
    whole = placed(fractions, ["_fraction", "_hash", at[key]], "_place")
    total = whole.agg(F.count(F.lit(1)).alias("_total")).scalar()
    cut = whole.withColumn("_total", total).withColumn("_shard", F.expr(f"_place * {shards} div _total"))
    slot = F.expr(f"_place - (_shard * _total + {shards - 1}) div {shards}")
    return cut.select(*[F.col(at[c]).alias(c) for c in columns], F.col("_shard").cast("int").alias("shard"), slot.alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Write the rows as Parquet, one folder per shard, in slot order within each file."""
    placed_docs = interleave(docs, shards)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed_docs.repartitionByRange(max(parts, shards), "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


_CRC_TABLE = """SELECT list(c ORDER BY n) AS t FROM (
  SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c
  FROM (SELECT unnest(range(256)) AS n))"""

#: CRC-32 in DuckDB: bytes from the hexadecimal text, folded with the usual table.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
    list_transform(range(strlen(x)), lambda i: ('0x' || substr(hex(encode(x)), 2 * i::INT + 1, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])))"""


@query(sql=f"""
WITH crc AS MATERIALIZED ({_CRC_TABLE}),
bytes AS (SELECT doc_id, coalesce(text, '') AS x, source FROM documents),
d AS (SELECT doc_id, strlen(x) + 1 AS size, source, substr(md5('{SEED}' || coalesce(':' || doc_id, '')), 1, 16) AS h, 
             {_CRC} AS text_crc32 FROM bytes, crc),
f AS (SELECT *, (2 * row_number() OVER (PARTITION BY source ORDER BY h, doc_id) - 1)::DOUBLE
             / (2 * count(*) OVER (PARTITION BY source))::DOUBLE AS fraction FROM d),
p AS (SELECT *, row_number() OVER (ORDER BY fraction, h, doc_id) - 1 AS place, count(*) OVER () AS total FROM f)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'rows' AS law, (place * {SHARDS} // total)::INTEGER AS shard,
       (place - ((place * {SHARDS} // total) * total + {SHARDS - 1}) // {SHARDS})::BIGINT AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM p""")
def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = only(table(spark, sf_dir, "documents"), "doc_id", "text", "source").select(
        "doc_id", "source", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return interleave(docs).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                                   F.lit(None).cast("int").alias("grown_shard"))
