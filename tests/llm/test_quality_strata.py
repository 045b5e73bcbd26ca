"""Learned quality rules act only where a stratum has a bound of its own, in however many strata."""

from pyspark.sql import functions as F

from alertloom.llm import quality


def rows_of(spark, first, strata, each, word_chars=500):
    """`each` ordinary texts in each of the strata; a text has 100 words."""
    return spark.range(first, first + strata * each).selectExpr(
        "id doc_id", f"concat('=', {first} + (id - {first}) div {each}) stratum", "100L n_words", f"{word_chars}L word_chars",
        "0L n_symbols", "0L n_dup_lines", "0L n_repeat_words", "5L n_lines")


def judged(measured, labelled):
    t = quality.calibrate(measured, labelled.selectExpr("doc_id", "1 quality", "0 toxic"))
    return t, measured.select("stratum", quality.verdict(t, F.col("stratum")).alias("kept"))


def test_more_than_64_strata(spark):
    large, odd = rows_of(spark, 0, 70, 2500), rows_of(spark, 1_000_000, 1, 50, 2000)
    t, got = judged(large.union(odd.withColumn("stratum", F.lit("=7"))), large)
    assert len(t.own) == 70 and len({name for name, *_ in t.rules}) == 70
    assert got.where("not kept").count() == 50


def test_strata_without_a_bound_keep_their_texts(spark):
    small, foreign = rows_of(spark, 0, 100, 90), rows_of(spark, 1_000_000, 1, 50, 2000)
    t, got = judged(small.union(foreign), small)
    assert t.rules == () and got.where("kept is null or not kept").count() == 0
    one = rows_of(spark, 2_000_000, 1, 3000)
    t, got = judged(small.union(foreign).union(one), small.union(one))
    assert {name for name, *_ in t.rules} == {"=2000000"} and got.where("not kept").count() == 0
