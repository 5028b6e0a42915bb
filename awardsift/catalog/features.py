"""Scaling, encoding, embedding, fusion, correlation and principal components."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import analysis, encoding, wide
from ..operators.embed import hashing_embedding as embed
from ..operators.fusion import FusionModel
from ..operators.vectors import sparse
from ..plans.prepare import prepare_labeled
from ..session import broadcast_if_small, checkpoint, ship_package, store
from ..functions import clean_text
from .base import AWARDS, DOCS, awards, docs, labeled_docs, query, sql_clean, table
from .joins import sql_top

KEYS = ["piid", "line_no", "supp_no", "part_no"]


def long_form(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Non-zero cells of a vector column: (key, feature, value)."""
    parts: Column = F.unwrap_udt(vector)
    at = F.when(parts["type"] == 0, parts["indices"]).otherwise(F.sequence(F.lit(0), F.size(parts["values"]) - 1))
    cells = df.select(key, F.explode(F.arrays_zip(at.alias("feature"), parts["values"].alias("value"))).alias("c"))
    return cells.select(key, F.col("c.feature").alias("feature"), F.col("c.value").alias("value")).where("value <> 0")


@query(f"""
WITH {AWARDS} SELECT 'value' AS "column", round(avg(value), 5) AS mean, round(stddev_pop(value), 5) AS std FROM awards
UNION ALL SELECT 'discount', round(avg(coalesce(nullif(discount, 0.05), 0)), 5), round(stddev_pop(coalesce(nullif(discount, 0.05), 0)), 5) FROM awards""")
def scaler_stats(spark, folder):
    rows = awards(spark, folder).withColumn("discount", F.nullif("discount", F.lit(0.05)))
    stats = encoding.scaler_statistics(rows, ["value", "discount"])
    return stats.withColumns({c: F.round(c, 5) for c in ("mean", "std")})


@query(f"""
WITH {AWARDS}, s AS (SELECT avg(value) AS m, stddev_pop(value) AS d FROM awards)
SELECT piid, line_no, supp_no, part_no, round((value - m) / d, 6) AS value, 0.0::DOUBLE AS constant FROM awards, s""")
def scaled_numeric(spark, folder):
    rows = awards(spark, folder).select(*KEYS, "value", F.lit(3.5).alias("constant"))
    train, _ = encoding.scale_columns(rows, None, ["value", "constant"])
    return train.withColumn("value", F.round("value", 6))


@query(f"""
WITH {DOCS}, c AS (SELECT DISTINCT 'agency' AS "column", agency AS category FROM docs UNION SELECT DISTINCT 'vendor', vendor FROM docs)
SELECT "column", category, CAST(row_number() OVER (PARTITION BY "column" ORDER BY category) - 1 AS INTEGER) AS slot FROM c""")
def encoder_categories(spark, folder):
    parts = encoding.encoder_categories(docs(spark, folder), ["agency", "vendor"])
    tables = [p.table.select(F.lit(p.column).alias("column"), "category", F.col("slot").cast("int").alias("slot")) for p in parts]
    return tables[0].union(tables[1])


@query(f"""
WITH {DOCS}, c AS (
  SELECT doc_id, CAST(dense_rank() OVER (ORDER BY agency) - 1 AS INTEGER) AS agency_slot,
    CAST(dense_rank() OVER (ORDER BY vendor) - 1 AS INTEGER) AS vendor_slot FROM docs)
SELECT doc_id, 'agency' AS "column", agency_slot AS feature, 1.0::DOUBLE AS value FROM c
UNION ALL SELECT doc_id, 'vendor', vendor_slot, 1.0::DOUBLE FROM c""")
def one_hot_long(spark, folder):
    encoded = encoding.encode_categories(docs(spark, folder).select("doc_id", "agency", "vendor"))
    return long_form(encoded, "doc_id", "agency_vector").withColumn("column", F.lit("agency")).unionByName(
        long_form(encoded, "doc_id", "vendor_vector").withColumn("column", F.lit("vendor")))


def _sql_buckets(source: str, size: int) -> str:
    return f"""words AS (
  SELECT doc_id, unnest([w FOR w IN string_split({sql_clean("description")}, ' ') IF w <> '']) AS w FROM {source}),
buckets AS (
  SELECT doc_id, CAST(('0x' || substr(md5(w), 1, 8))::BIGINT % {size} AS INTEGER) AS feature, count(*)::DOUBLE AS n FROM words GROUP BY ALL),
text_cells AS (
  SELECT doc_id, feature, n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)) AS value FROM buckets)"""


@query(f"WITH {DOCS}, {_sql_buckets('docs', 768)} SELECT doc_id, feature, round(value, 9) AS value FROM text_cells")
def hashing_embedding(spark, folder):
    texts = docs(spark, folder).select("doc_id", clean_text(F.col("description")).alias("clean_description"))
    return long_form(embed(texts), "doc_id", "text_vector").withColumn("value", F.round("value", 9))


@query(f"""
WITH {DOCS}, train AS (SELECT docs.* FROM docs JOIN labels USING (doc_id) WHERE quality = 0),
s AS (SELECT avg(value) AS m, stddev_pop(value) AS d FROM train), {sql_top("agency", "train")}, {sql_top("vendor", "train")},
known AS (
  SELECT doc_id, value, CASE WHEN agency IN (SELECT category FROM agency_top) THEN agency ELSE 'Unknown' END AS agency,
    CASE WHEN vendor IN (SELECT category FROM vendor_top) THEN vendor ELSE 'Unknown' END AS vendor FROM docs),
{_sql_buckets("docs", 768)}
SELECT doc_id, 'text_' || feature AS name, round(value, 9) AS value FROM text_cells
UNION ALL SELECT doc_id, 'num_normalized_value', round((value - m) / d, 9) FROM docs, s WHERE value <> m
UNION ALL SELECT doc_id, 'agency_' || agency, 1.0::DOUBLE FROM known
UNION ALL SELECT doc_id, 'vendor_' || vendor, 1.0::DOUBLE FROM known""")
def fused_features(spark, folder):
    """Model fitted on the labeled documents, applied to all; long form with feature names."""
    model = FusionModel.fit(checkpoint(prepare_labeled(labeled_docs(spark, folder)).drop("description")))
    prepared = prepare_labeled(docs(spark, folder)).drop("description")
    fused = model.transform(embed(prepared))
    names = broadcast_if_small(checkpoint(model.feature_names(spark, 768)))
    cells = long_form(fused, "doc_id", "features").join(names, "feature")
    return cells.select("doc_id", "name", F.round("value", 9).alias("value"))


def _vectors(spark, folder) -> DataFrame:
    return table(spark, folder, "embeddings").select("vec_id", array_to_vector("embedding").alias("features"))


@query("""
WITH cells AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
pairs AS (SELECT a.i AS i, b.i AS j, corr(a.x, b.x) AS r FROM cells a JOIN cells b ON a.vec_id = b.vec_id AND b.i < a.i GROUP BY 1, 2)
SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(r, 7) AS r FROM pairs WHERE abs(r) > 0.1""")
def correlation_pairs(spark, folder):
    return analysis.correlation_pairs(_vectors(spark, folder), limit=0.1).withColumn("r", F.round("r", 7))


@query()
def pca_cumulative_variance(spark, folder):
    return analysis.pca_variance(_vectors(spark, folder))


@query()
def pca_2d(spark, folder):
    return analysis.pca_2d(_vectors(spark, folder)).select("vec_id", "pc1", "pc2")


@query("""
WITH cells AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
c AS (SELECT a.i, b.i AS j, covar_samp(a.x, b.x) AS c FROM cells a JOIN cells b USING (vec_id) GROUP BY ALL)
SELECT count(DISTINCT i) AS components, round(sum(c) FILTER (WHERE i = j) / sum(c) FILTER (WHERE i = j), 9) AS total,
  round(sum(c * c) / pow(sum(c) FILTER (WHERE i = j), 2), 9) AS squares FROM c""")
def pca_moments(spark, folder):
    """Sum and sum of squares of all explained shares; the check takes them from trace and norm of the covariances."""
    shares = analysis.pca_variance(_vectors(spark, folder))
    x = F.col("variance_ratio")
    return shares.agg(F.count(F.lit(1)).alias("components"), F.round(F.sum(x), 9).alias("total"), F.round(F.sum(x * x), 9).alias("squares"))


_SQUARINGS = 20


def _sql_axis(name: str, source: str) -> str:
    """The leading axis of a covariance table by squaring it again and again: <name>_axis(i, v), <name>_top(value)."""
    steps = [f"{name}_0 AS MATERIALIZED (SELECT i, j, c / (SELECT sum(c) FROM {source} WHERE i = j) AS c FROM {source})"]
    for k in range(_SQUARINGS):
        steps.append(f"{name}_{k}s AS MATERIALIZED (SELECT a.i, b.j, sum(a.c * b.c) AS c FROM {name}_{k} a JOIN {name}_{k} b ON a.j = b.i GROUP BY ALL)")
        steps.append(f"{name}_{k + 1} AS MATERIALIZED (SELECT i, j, c / (SELECT sum(c) FROM {name}_{k}s WHERE i = j) AS c FROM {name}_{k}s)")
    last = f"{name}_{_SQUARINGS}"
    steps.append(f"{name}_top AS (SELECT sum(s.c * m.c) AS value FROM {source} s JOIN {last} m ON m.i = s.j AND m.j = s.i)")
    steps.append(f"""{name}_axis AS MATERIALIZED (SELECT i, c / sqrt((SELECT max(c) FROM {last} WHERE i = j)) AS v FROM {last}
  WHERE j = (SELECT arg_max(i, c) FROM {last} WHERE i = j))""")
    return ", ".join(steps)


@query(f"""
WITH cells AS MATERIALIZED (SELECT vec_id, x - avg(x) OVER (PARTITION BY i) AS x, i FROM (
  SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)),
cov AS MATERIALIZED (SELECT a.i, b.i AS j, sum(a.x * b.x) / ((SELECT count(*) FROM embeddings) - 1) AS c FROM cells a JOIN cells b USING (vec_id) GROUP BY ALL),
{_sql_axis("one", "cov")},
rest AS MATERIALIZED (SELECT cov.i, cov.j, c - (SELECT value FROM one_top) * a.v * b.v AS c FROM cov JOIN one_axis a ON a.i = cov.i JOIN one_axis b ON b.i = cov.j),
{_sql_axis("two", "rest")}
SELECT vec_id, round(abs(sum(x * a.v)), 6) AS pc1, round(abs(sum(x * b.v)), 6) AS pc2
FROM cells JOIN one_axis a USING (i) JOIN two_axis b USING (i) GROUP BY vec_id""")
def pca_2d_absolute(spark, folder):
    """Distance of each vector from the centre along the first two axes, whose directions have no sign."""
    placed = analysis.pca_2d(_vectors(spark, folder))
    return placed.select("vec_id", *[F.round(F.abs(c), 6).alias(c) for c in ("pc1", "pc2")])


WORD_COLUMNS = 65_536
_WORD = re.compile("[a-z]+")
# Words whose column a task remembers.
_WORDS_KEPT = 1 << 19
# Words of documents that are packed at a time.
_CELLS = 1 << 18
_SQL_WORDS = """words AS MATERIALIZED (SELECT doc_id, ('0x' || substr(md5(w), 1, 4))::INTEGER AS col, count(*)::DOUBLE AS x
  FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents) GROUP BY ALL),
n AS (SELECT count(*)::DOUBLE AS n FROM documents)"""


class _Columns(dict):
    """The column of each word; a word that is not held is hashed."""

    def __missing__(self, word: str) -> int:
        if len(self) > _WORDS_KEPT:
            self.clear()
        col = self[word] = int(hashlib.md5(word.encode()).hexdigest()[:4], 16)
        return col


def _packed(docs: list, counts: list[Counter], columns: _Columns, kind: pa.DataType) -> pa.RecordBatch:
    total = sum(map(len, counts))
    col = np.fromiter(chain.from_iterable(map(columns.__getitem__, words) for words in counts), np.int64, total)
    n = np.fromiter(chain.from_iterable(words.values() for words in counts), np.float64, total)
    key = np.repeat(np.arange(len(docs)), [len(words) for words in counts]) * WORD_COLUMNS + col
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    x = np.add.reduceat(n[order], first) if total else n
    row, at = np.divmod(key[first], WORD_COLUMNS)
    bounds = pa.array(np.searchsorted(row, np.arange(len(docs) + 1)), pa.int32())
    lists = [pa.ListArray.from_arrays(bounds, pa.array(v)) for v in (at.astype(np.int32), x)]
    return pa.RecordBatch.from_arrays([pa.array(docs, kind), *lists], names=["doc_id", "at", "x"])


def _count_words(batches):
    """Column counts of the words of all lower-cased texts of a doc_id, which come one after the other."""
    columns, docs, counts, held = _Columns(), [], [], 0
    for texts in batches:
        kind = texts.schema.field(0).type
        for doc, text in zip(texts.column(0).to_pylist(), texts.column(1)):
            if not docs or doc != docs[-1]:
                if held > _CELLS:
                    yield _packed(docs, counts, columns, kind)
                    docs, counts, held = [], [], 0
                docs.append(doc)
                counts.append(Counter())
            held -= len(counts[-1])
            counts[-1].update(_WORD.findall(text.as_py() or ""))
            held += len(counts[-1])
    if docs:
        yield _packed(docs, counts, columns, kind)


def _word_counts(spark, folder) -> DataFrame:
    """Documents with the counts of their words in 65,536 hashed columns; the texts go by doc_id once and are counted where they are."""
    ship_package(spark)
    documents = table(spark, folder, "documents").select("doc_id", F.lower("text").alias("text"))
    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = documents.repartition("doc_id").sortWithinPartitions("doc_id").mapInArrow(_count_words, f"doc_id {kind}, at array<int>, x array<double>")
    return rows.select("doc_id", sparse(WORD_COLUMNS, F.col("at"), F.col("x")).alias("features"))


_POWER_STEPS = 30


def _sql_leading(name: str, source: str) -> str:
    """The largest eigenvalue of a table (a, b, g) and its vector by the power method: <name>_top(value), <name>_axis(a, v)."""
    steps = [f"{name}_0 AS MATERIALIZED (SELECT a, sum(abs(g)) * (1 + a % 7) AS v FROM {source} GROUP BY a)"]
    for k in range(_POWER_STEPS):
        steps.append(f"{name}_{k}n AS MATERIALIZED (SELECT a, v / sqrt(sum(v * v) OVER ()) AS v FROM {name}_{k})")
        steps.append(f"{name}_{k + 1} AS MATERIALIZED (SELECT s.a, sum(g * v) AS v FROM {source} s JOIN {name}_{k}n m ON s.b = m.a GROUP BY s.a)")
    last = _POWER_STEPS
    steps.append(f"{name}_top AS (SELECT sum(x.v * y.v) AS value FROM {name}_{last} x JOIN {name}_{last - 1}n y USING (a))")
    steps.append(f"{name}_axis AS MATERIALIZED (SELECT a, v / sqrt(sum(v * v) OVER ()) AS v FROM {name}_{last})")
    return ", ".join(steps)


@query(f"""
WITH {_SQL_WORDS}, centre AS (SELECT col, sum(x) / n AS m FROM words, n GROUP BY col, n),
ids AS (SELECT doc_id AS a, coalesce(sum(x * m), 0) AS s FROM documents LEFT JOIN words USING (doc_id) LEFT JOIN centre USING (col) GROUP BY doc_id),
dots AS (SELECT p.doc_id AS a, q.doc_id AS b, sum(p.x * q.x) AS d FROM words p JOIN words q USING (col) GROUP BY ALL),
gram AS MATERIALIZED (SELECT x.a, y.a AS b, coalesce(d, 0) - x.s - y.s + (SELECT sum(m * m) FROM centre) AS g
  FROM ids x CROSS JOIN ids y LEFT JOIN dots ON dots.a = x.a AND dots.b = y.a),
{_sql_leading("one", "gram")},
rest AS MATERIALIZED (SELECT gram.a, gram.b, g - (SELECT value FROM one_top) * x.v * y.v AS g FROM gram JOIN one_axis x ON x.a = gram.a JOIN one_axis y ON y.a = gram.b),
{_sql_leading("two", "rest")},
total AS (SELECT sum(g) AS t FROM gram WHERE a = b)
SELECT 1::INTEGER AS component, round((SELECT value FROM one_top) / t, 7) AS variance_ratio FROM total
UNION ALL SELECT 2, round((SELECT value FROM two_top) / t, 7) FROM total""")
def wide_pca(spark, folder):
    """The first components of 65,536 word columns; the check goes through the products of all documents, where centred vectors have the same ones."""
    found = wide.variance(_word_counts(spark, folder), k=2)
    return found.select("component", F.round("variance_ratio", 7).alias("variance_ratio"))


@query(f"""
WITH {_SQL_WORDS}, columns AS MATERIALIZED (SELECT col, sum(x) / n AS m, sqrt(sum(x * x) / n - pow(sum(x) / n, 2)) AS s FROM words, n GROUP BY col, n),
met AS (SELECT a.col AS i, b.col AS j, sum(a.x * b.x) AS d FROM words a JOIN words b ON a.doc_id = b.doc_id AND b.col < a.col GROUP BY ALL),
pairs AS (SELECT i, j, (d / n - a.m * b.m) / (a.s * b.s) AS r FROM met, n, columns a, columns b WHERE a.col = i AND b.col = j AND a.s > 0 AND b.s > 0
  UNION ALL SELECT a.col, b.col, -a.m * b.m / (a.s * b.s) FROM columns a JOIN columns b ON b.col < a.col AND a.m * b.m > 0.9 * a.s * b.s
    ANTI JOIN met ON met.i = a.col AND met.j = b.col)
SELECT i, j, round(r, 6) AS r FROM pairs WHERE abs(r) > 0.9000001""")
def wide_correlation_pairs(spark, folder):
    """Word columns that go together in whole documents, out of 65,536."""
    pairs = analysis.correlation_pairs(store(_word_counts(spark, folder)), limit=0.9)
    return pairs.where(F.abs("r") > 0.9000001).withColumn("r", F.round("r", 6))
