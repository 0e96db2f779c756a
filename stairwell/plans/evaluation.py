"""Whole evaluations: from questions and predictions, or logits, to metrics and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stairwell.operators import nbest as nb, qa_metrics as qa
from stairwell.session import materialise
from stairwell.sources.maps import with_na_probabilities


def gold_table(flat: DataFrame) -> DataFrame:
    """(``qid``, ``golds``, ``has_ans``) from flattened questions."""
    golds = F.transform("answers", lambda a: a["text"])
    return flat.select(F.col("id").alias("qid"), golds.alias("golds"), (F.size("answers") > 0).alias("has_ans"))


def evaluate_v2(
    questions: DataFrame,
    predictions: DataFrame,
    na_probs: DataFrame | None = None,
    threshold: float = 1.0,
    curves: bool = False,
) -> DataFrame:
    """(``key``, ``value``): the metric dictionary of a version 2 evaluation.

    ``predictions`` has ``pos, qid, prediction``; ``pos`` is the order in which ties
    of the probability are walked.  Best thresholds need ``na_probs``, average
    precisions in addition ``curves``.  Scores feed several passes, so they are
    written once.
    """
    ready = with_na_probabilities(predictions, na_probs)
    if na_probs is not None and "pos" in na_probs.columns:
        places = na_probs.select("qid", F.col("pos").alias("__pos"))
        ready = ready.join(places, "qid", "left").withColumn("pos", F.coalesce("__pos", "pos")).drop("__pos")
    scored = qa.score_answers(questions, ready)
    scored = materialise(scored.select("qid", "pos", "has_ans", "prediction", "na_prob", "exact", "f1"))
    metrics = qa.metric_map(qa.evaluate_v2(qa.apply_no_answer_threshold(scored, threshold=threshold)))
    if na_probs is None:
        return metrics
    best = qa.best_threshold(scored, questions.filter(~F.col("has_ans")))
    pairs = F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("double").alias("value")) for c in best.columns])
    metrics = metrics.unionByName(best.select(F.inline(pairs)))
    if curves:
        areas = qa.average_precision(scored, questions)
        metrics = metrics.unionByName(areas.select(F.concat(F.lit("pr_"), "kind", F.lit("_ap")).alias("key"), F.col("ap").alias("value")))
    return metrics


def evaluate_v1(questions: DataFrame, predictions: DataFrame) -> DataFrame:
    """(``key``, ``value``) of a version 1.1 evaluation; missing predictions count 0."""
    out = qa.evaluate_v1(qa.score_answers(questions, predictions, version=1, how="left"))
    pairs = F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("double").alias("value")) for c in ("exact_match", "f1")])
    return out.select(F.inline(pairs))


def answer_questions(
    features: DataFrame,
    logits: DataFrame,
    contexts: DataFrame,
    example: str,
    n_best: int = 20,
    max_answer: int = 30,
    with_negatives: bool = False,
    threshold: float = 0.0,
) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Predictions, n-best list and (with negatives) score differences of a span model."""
    scored = nb.window_candidates(nb.attach_logits(features, logits, [example, "window"]), n_best, max_answer)
    nbest = nb.example_nbest(scored, contexts, example, n_best=n_best, with_negatives=with_negatives)
    if not with_negatives:
        return nb.best_answer(nbest, example).drop("null_score"), nbest, None
    decided = nb.null_decision(nbest, example, threshold)
    return decided.select(example, "prediction_text"), nbest, decided.select(example, "score_diff")


def answer_questions_beam(
    features: DataFrame,
    logits: DataFrame,
    contexts: DataFrame,
    example: str,
    n_best: int = 20,
    max_answer: int = 30,
    start_n_top: int = 5,
    end_n_top: int = 5,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Predictions, n-best list and null scores of a beam model."""
    joined = nb.attach_logits(features, logits, [example, "window"])
    scored = nb.beam_candidates(joined, n_best, max_answer, start_n_top, end_n_top)
    nbest = nb.example_nbest(scored, contexts, example, n_best=n_best, beam=True)
    best = nb.best_answer(nbest, example)
    return best.drop("null_score"), nbest, best.drop("prediction_text")
