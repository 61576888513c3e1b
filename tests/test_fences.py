"""Code fences, languages and epoch times by hand."""

from pyspark.sql import functions as F

from loomline.functions import fences


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column.alias("r")).first().r


def test_fences(spark):
    found = lambda text: [tuple(b) for b in one(spark, fences.code_fences(F.col("v")), text)]
    assert found("a\n```rs x\none\n\ntwo\n```\nb\n  ```\nthree") == [("rust", 3), ("unknown", 1)]
    assert found("```py\n```\n```GoLang\nx\r\ny\n``` end") == [("go", 2)]
    assert found("x ``` y\nz") == found("") == found(None) == []
    assert found("````c++\nx\n" + "line\n" * 50_000 + "```") == [("`c++", 50_001)]


def test_languages(spark):
    name = lambda path: one(spark, fences.file_language(F.col("v")), path)
    assert [name(p) for p in ("a/b.TSX", "a.b/c", ".bashrc", "x.tar.h", "", None)] == ["typescript", "unknown", "unknown", "c", "unknown", "unknown"]


def test_epochs(spark):
    at = lambda raw: one(spark, F.date_format(fences.epoch_time(F.col("v")), "yyyy-MM-dd HH:mm:ss.SSS"), raw, "long")
    assert [at(n) for n in (1_700_000_000, 1_700_000_000_123, 1_700_000_000_123_999_999, None)] == ["2023-11-14 22:13:20.000", *["2023-11-14 22:13:20.123"] * 2, None]
