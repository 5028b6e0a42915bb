"""Text to vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import CountVectorizerModel, Normalizer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package

TEXT_SIZE = 768
Encoder = Callable[[list[str]], np.ndarray]


def token_buckets(clean: Column, size: int) -> Column:
    """Bucket number, as text, of every word of a cleaned text: the first 32 bits of its md5 modulo ``size``."""
    words = F.filter(F.split(F.coalesce(clean, F.lit("")), " "), lambda w: w != "")
    return F.transform(
        words,
        lambda w: (F.conv(F.substring(F.md5(w.cast("binary")), 1, 8), 16, 10).cast("bigint") % size).cast("string"),
    )


def hashing_embedding(df: DataFrame, text: str = "clean_description", out: str = "text_vector", size: int = TEXT_SIZE) -> DataFrame:
    """Word counts per hash bucket, scaled to length 1. Needs no weights and reads the whole text.

    Counting and scaling are Spark ML transformers on sparse vectors, so texts never leave the JVM.
    """
    counter = CountVectorizerModel.from_vocabulary([str(i) for i in range(size)], inputCol="_buckets", outputCol="_counts")
    counted = counter.transform(df.withColumn("_buckets", token_buckets(F.col(text), size)))
    return Normalizer(p=2.0, inputCol="_counts", outputCol=out).transform(counted).drop("_buckets", "_counts")


def model_embedding(
    df: DataFrame, make_encoder: Callable[[], Encoder], text: str = "clean_description", out: str = "text_vector", batch_size: int = 8,
) -> DataFrame:
    """Vectors from a model: ``make_encoder`` loads it, once per Python worker, and returns texts -> matrix.

    Texts arrive in Arrow batches and are handed to the model ``batch_size`` at a time.
    """

    ship_package(df.sparkSession)

    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = make_encoder()
        for texts in batches:
            texts = texts.fillna("").tolist()
            parts = [encoder(texts[i:i + batch_size]) for i in range(0, len(texts), batch_size)]
            yield pd.Series([row for part in parts for row in np.asarray(part, dtype=np.float32)])

    return df.withColumn(out, array_to_vector(encode(F.col(text))))


def precomputed_embedding(df: DataFrame, vectors: DataFrame, key: str, values: str = "embedding", out: str = "text_vector") -> DataFrame:
    """Vectors from a table with one array per key."""
    return df.join(vectors.select(key, array_to_vector(F.col(values)).alias(out)), key)
