"""Feature vectors without a description of every slot.

Spark's vector columns are structs of type (0 sparse, 1 dense), size, indices and values. They are put together
with column functions; the schema stays as small with a million slots as with ten.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import UserDefinedType

PARTS = "struct<type: tinyint, size: int, indices: array<int>, values: array<double>>"


def parts(df: DataFrame, name: str) -> Column:
    """The struct of a vector column, wrapped as a vector or not."""
    return F.unwrap_udt(name) if isinstance(df.schema[name].dataType, UserDefinedType) else F.col(name)


def sparse(size: int | Column, indices: Column, values: Column) -> Column:
    whole = F.lit(size) if isinstance(size, int) else size
    return F.struct(F.lit(0).alias("type"), whole.alias("size"), indices.alias("indices"), values.alias("values")).cast(PARTS)


def dense(values: Column) -> Column:
    nothing = F.lit(None).cast("int")
    return F.struct(F.lit(1).alias("type"), nothing.alias("size"), F.lit(None).cast("array<int>").alias("indices"), values.alias("values")).cast(PARTS)


def single(slot: Column, size: int) -> Column:
    """1 in one slot; zeros everywhere if the slot is null or beyond the size."""
    known = F.coalesce(slot < size, F.lit(False))
    return sparse(size, F.when(known, F.array(slot.cast("int"))).otherwise(F.array().cast("array<int>")),
                  F.when(known, F.array(F.lit(1.0))).otherwise(F.array().cast("array<double>")))


@F.arrow_udf(VectorUDT())
def as_vector(struct: pa.Array) -> pa.Array:
    """The same bytes as a vector column, which only a typed function can declare."""
    return struct


def _shifted(places: Column, start: Column) -> Column:
    return F.transform(places, lambda i: (i + start).cast("int"))


def joined(df: DataFrame, columns: list[str]) -> Column:
    """One sparse struct from number and vector columns of the same row, in the given order; zeros are left out."""
    kinds = dict(df.dtypes)
    offset, indices, values = F.lit(0), [], []
    for name in columns:
        if kinds[name] == "vector" or kinds[name].startswith("struct"):
            own = parts(df, name)
            size = F.coalesce(own["size"], F.size(own["values"]))
            at = F.when(own["type"] == 0, own["indices"]).otherwise(F.sequence(F.lit(0), F.size(own["values"]) - 1))
            indices.append(_shifted(at, offset))
            values.append(own["values"])
        else:
            size = F.lit(1)
            indices.append(F.array(offset.cast("int")))
            values.append(F.array(F.col(name).cast("double")))
        offset = offset + size
    cells = F.filter(F.arrays_zip(F.concat(*indices).alias("i"), F.concat(*values).alias("v")), lambda c: c["v"] != 0)
    return sparse(offset.cast("int"), F.transform(cells, lambda c: c["i"]), F.transform(cells, lambda c: c["v"]))
