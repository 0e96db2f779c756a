"""Defined results where a formula has none: constant columns, no rows, unknown values."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from stairwell.operators import bleu, classify, curriculum, difficulty, qa_metrics, rows, tagging


@pytest.mark.parametrize("measure", [classify.pearson, classify.spearman])
@pytest.mark.parametrize("data", [[(1.0, 2.0), (1.0, 3.0)], [(1.0, 5.0), (2.0, 5.0)], []])
def test_correlation_without_spread_is_null(spark, measure, data):
    assert measure(spark.createDataFrame(data, "g double, p double"), "g", "p").first()[0] is None


def test_a_constant_batch_scales_to_zero(spark):
    df = spark.createDataFrame([(0, [2.0, 2.0]), (1, [2.0, 2.0])], "idx long, v array<double>")
    assert [r.v for r in difficulty.normalise(df, ["v"], "line").collect()] == [[0.0, 0.0]] * 2


def test_entities_of_nothing(spark):
    df = spark.createDataFrame([], "g array<string>, p array<string>")
    assert tuple(tagging.entity_scores(df, "g", "p").first()) == (0.0, 0.0, 0.0, 0.0)


def test_bleu_of_nothing(spark):
    df = spark.createDataFrame([], "k long, p string, r string")
    assert bleu.corpus_bleu(df, "p", "r").first().bleu == 0.0


@pytest.mark.parametrize("bad", [None, float("nan")])
def test_unknown_difficulty_is_an_error(spark, bad):
    df = spark.createDataFrame([(0, 1.0), (1, bad), (2, 3.0)], "idx long, difficulty double")
    with pytest.raises(Exception, match="null or not a number"):
        curriculum.difficulty_levels(df, 3).collect()


def test_an_unknown_index_is_an_error(spark):
    df = spark.range(3).withColumnRenamed("id", "idx")
    wanted = spark.createDataFrame([(0, 2), (1, 9)], "pos long, idx long")
    with pytest.raises(Exception, match="no row has index 9"):
        rows.select_by_index(df, wanted).collect()
    assert [r.idx for r in rows.select_by_index(df, wanted.where("pos = 0")).collect()] == [2]


def test_recall_counts_questions_without_a_prediction(spark):
    scored = spark.createDataFrame([("a", True, 1, 1.0, 0.1), ("b", False, 0, 0.0, 0.2)], "qid string, has_ans boolean, exact int, f1 double, na_prob double")
    questions = spark.createDataFrame([("a", True), ("b", False), ("c", True)], "qid string, has_ans boolean")
    curve = qa_metrics.pr_curve(scored, questions).where(F.col("kind") == "exact").orderBy("na_prob").collect()
    assert [(r.na_prob, r.precision, r.recall) for r in curve] == [(None, 1.0, 0.0), (0.1, 1.0, 0.5), (0.2, 0.5, 0.5)]
    assert {r.kind: r.ap for r in qa_metrics.average_precision(scored, questions).collect()}["exact"] == 50.0
