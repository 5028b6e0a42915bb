import pytest
from pyspark.sql import functions as F

from awardsift import constants
from awardsift.functions import (
    any_keyword, clean_text, main_keywords, money, normalize_value, percentage, standardize_name, truncate, value_per_word, word_count,
)


def values(spark, column, inputs, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, x {kind}")
    return [r["y"] for r in rows.select("i", column.alias("y")).orderBy("i").collect()]


def test_clean_text(spark):
    given = ["  IT  Support!! (FY-2024) ", "snake_case\tTab\nLine", None, "", "¿Qué?  ÉTÉ—été", "***", "x²½", "a b"]
    assert values(spark, clean_text(F.col("x")), given) == [
        "it support fy 2024", "snake_case tab line", "", "", "qué été été", "", "x²½", "a b"]


@pytest.mark.parametrize("text, number", [
    ("$1,234.50", 1234.5), (" 7 ", 7.0), ("-3e2", -300.0), ("1_000", 1000.0), (".5", 0.5), ("5.", 5.0), ("12d", 0.0), ("0x1F", 0.0),
    ("n/a", 0.0), ("", 0.0), (None, 0.0), ("nan", 0.0), ("1__0", 0.0), ("inf", float("inf")), ("$", 0.0), ("1 2", 0.0),
])
def test_normalize_value_text(spark, text, number):
    assert values(spark, normalize_value(F.col("x")), [text]) == [number]


def test_normalize_value_numbers(spark):
    assert values(spark, normalize_value(F.col("x"), "double"), [2.5, None, float("nan")], "double") == [2.5, 0.0, 0.0]
    assert values(spark, normalize_value(F.col("x"), "bigint"), [7, None], "bigint") == [7.0, 0.0]


def test_words(spark):
    assert values(spark, word_count(F.col("x")), ["", "a", "a bc d"]) == [0, 1, 3]
    assert values(spark, value_per_word(F.lit(10.0), F.col("x")), ["", "a b"]) == [10.0, 5.0]


def test_standardize_name(spark):
    given = ["Acme, Inc.", "ACME LLC", "acme inc ", "acme co llc", "  Big   Co ", "inc", ".,", None, "Unknown", "A.B.C. Co.\n", "Zinc"]
    assert values(spark, standardize_name(F.col("x")), given) == [
        "acme", "acme", "acme inc", "acme co", "big co", "inc", "Unknown", "Unknown", "unknown", "abc", "zinc"]


def test_labels(spark):
    long = "x" * 51
    assert values(spark, truncate(F.col("x")), ["x" * 50, long, None]) == ["x" * 50, "x" * 47 + "...", None]
    assert values(spark, money(F.col("x")), [1234567.5, -5.0, 0.5, 1.5], "double") == ["$1,234,568", "$-5", "$0", "$2"]
    assert values(spark, percentage(F.col("x"), F.lit(8)), [2, None], "int") == [25.0, 0.0]
    assert values(spark, percentage(F.lit(3), F.col("x")), [0], "int") == [0.0]


def test_keyword_lists():
    assert len(constants.DEI_WORDS) == 23 and len(constants.NGO_WORDS) == 54 and len(constants.WASTE_WORDS) == 60
    assert len(main_keywords()) == 129


def test_keywords(spark):
    given = ["Office SUPPORT", "raid", "to aid", None, "nothing", "éaid", "aidé", "ſupport", "shıppıng", "AİD", "first-aid kit"]
    assert values(spark, any_keyword(F.col("x"), ["support", "aid", "shipping"]), given) == [
        True, True, True, False, False, True, True, True, True, True, True]
    assert values(spark, any_keyword(F.col("x"), ["support", "aid"], "whole_word"), given) == [
        True, False, True, False, False, False, False, True, False, True, True]
    assert values(spark, any_keyword(F.col("x"), []), ["a"]) == [False]
    with pytest.raises(ValueError):
        any_keyword(F.col("x"), ["a"], "other")
