"""Small tables and plain-Python versions for the tests of the llm operators."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SMALL = "/root/testdata/sf0.001"


def documents(spark, texts, langs=None, sources=None):
    rows = [(k, t, (langs or ["en"])[k % len(langs or [1])], (sources or ["src0"])[k % len(sources or [1])], len(t or "")) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def awkward(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns whose names operators use themselves."""
    long = " ".join(f"w{k % 977}" for k in range(30_000))
    rows = [
        (0, None, None, None, None), (1, "", "en", "src0", 0), (2, "   \n\t\r ", "en", None, 6), (3, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen", "en", "src0", 5),
        (3, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen", "en", "src0", 5), (4, long, "en", "src1", len(long)),
        (5, long, "de", "src1", len(long)), (None, "a line of some length here\nand another line of it", None, "src0", 1), (6, "!!! ??? ...", None, "src2", 11), (7, "ñ é x", "es", "src0", 5),
        (None, None, None, None, None),
    ]
    names = ["kept", "shard", "slot", "probability", "n_words", "score", "lang_pred", "hit_items", "n_dropped", "component_id", "labels", "tokens"]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in names:
        df = df.selectExpr("*", f"'x' AS {name}")
    return df


def shuffled_words(seed, count, size=40):
    draw = random.Random(str(seed))
    return [f"w{draw.randrange(size)}" for _ in range(count)]
