"""Answer scoring: exact match, token F1, aggregates, threshold search, precision-recall.

Per-question scores never leave the question's row: gold answers are an array,
and the token overlap is computed on sorted arrays.  Aggregates need no shuffle
beyond one partial sum per task.  Sweeps over the no-answer probability use
bucketed running totals, so ties and hot values do not gather in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from stairwell.functions.arrays import let, multiset_overlap
from stairwell.functions.text import normalize_answer, space_tokens
from stairwell.operators.ordering import BUCKET, PLACE, join_buckets, running_totals, sums_before, with_order_bucket
from stairwell.session import materialise

# Scores are summed as decimals: the total does not depend on the order of addition,
# so the first maximum of a sweep is the same on every run.
EXACT_SUM = "decimal(26,12)"


def f1_from_tokens(gold: Column, predicted: Column, empty_agrees: bool) -> Column:
    """Token F1 of two token arrays.

    ``empty_agrees``: two empty answers count 1 (version 2 scoring), else 0
    (version 1.1 scoring).
    """
    g, p = F.size(gold), F.size(predicted)

    def score(hits: Column) -> Column:
        precision, recall = hits / p, hits / g
        return F.when(hits == 0, F.lit(0.0)).otherwise(2 * precision * recall / (precision + recall))

    both_empty = (g == 0) & (p == 0) & F.lit(empty_agrees)
    return F.when((g == 0) | (p == 0), F.when(both_empty, 1.0).otherwise(0.0)).otherwise(
        let(multiset_overlap(gold, predicted).cast("double"), score)
    )


def score_answers(
    questions: DataFrame,
    predictions: DataFrame,
    qid: str = "qid",
    golds: str = "golds",
    prediction: str = "prediction",
    version: int = 2,
    how: str = "inner",
) -> DataFrame:
    """``questions`` plus ``exact`` and ``f1``, each the best over the gold answers.

    Version 2 ignores golds that normalise to nothing and falls back to the empty
    answer; version 1 uses the golds as they are.  Both scores are null for a
    question without a prediction (only with ``how="left"``).
    """
    joined = questions.join(predictions, qid, how)
    normalised = F.transform(golds, normalize_answer)
    if version == 2:
        kept = F.filter(normalised, lambda g: g != "")
        normalised = let(kept, lambda k: F.when(F.size(k) == 0, F.array(F.lit(""))).otherwise(k))
    ready = joined.withColumns(
        {"__golds": normalised, "__pred": normalize_answer(F.col(prediction))}
    ).withColumn("__tokens", space_tokens(F.col("__pred")))
    exact = F.array_max(F.transform("__golds", lambda g: (g == F.col("__pred")).cast("int")))
    f1 = F.array_max(
        F.transform(
            "__golds",
            lambda g: let(space_tokens(g), lambda t: f1_from_tokens(t, F.col("__tokens"), version == 2)),
        )
    )
    missing = F.col(prediction).isNull()
    scored = ready.withColumns(
        {
            "exact": F.when(missing, F.lit(None)).otherwise(F.coalesce(exact, F.lit(0))).cast("int"),
            "f1": F.when(missing, F.lit(None)).otherwise(F.coalesce(f1, F.lit(0.0))).cast("double"),
        }
    )
    return scored.drop("__golds", "__pred", "__tokens")


def has_answer(golds: str = "golds") -> Column:
    return F.size(golds) > 0


def missing_predictions(questions: DataFrame, predictions: DataFrame, qid: str = "qid") -> DataFrame:
    return questions.join(predictions, qid, "left_anti")


def apply_no_answer_threshold(scored: DataFrame, na_prob: str = "na_prob", threshold: float = 1.0) -> DataFrame:
    """Where ``na_prob`` exceeds the threshold the answer counts as empty."""
    gives_up = F.col(na_prob) > threshold
    right = F.when(F.col("has_ans"), 0.0).otherwise(1.0)
    return scored.withColumns(
        {
            "exact": F.when(gives_up, right).otherwise(F.col("exact").cast("double")),
            "f1": F.when(gives_up, right).otherwise(F.col("f1")),
        }
    )


def evaluate_v1(scored: DataFrame) -> DataFrame:
    """One row ``exact_match, f1, total`` over all questions; a missing prediction counts 0."""
    return scored.agg(
        (100 * F.avg(F.coalesce(F.col("exact"), F.lit(0)).cast("double"))).alias("exact_match"),
        (100 * F.avg(F.coalesce(F.col("f1"), F.lit(0.0)))).alias("f1"),
        F.count("*").alias("total"),
    )


def evaluate_v2(scored: DataFrame) -> DataFrame:
    """``exact, f1, total`` overall and per answerable group, one row each.

    ``scored`` has one row per predicted question.  A group that does not occur
    has no row.
    """
    summed = scored.rollup("has_ans").agg(
        F.grouping("has_ans").alias("__all"),
        (100 * F.avg(F.col("exact").cast("double"))).alias("exact"),
        (100 * F.avg("f1")).alias("f1"),
        F.count("*").alias("total"),
    )
    name = (
        F.when(F.col("__all") == 1, "overall").when(F.col("has_ans"), "HasAns").otherwise("NoAns").alias("part")
    )
    return summed.select(name, "exact", "f1", "total").filter("total > 0")


def metric_map(parts: DataFrame) -> DataFrame:
    """(``key``, ``value``) with the group prefixes of the flat metric dictionary."""
    prefix = F.when(F.col("part") == "overall", "").otherwise(F.concat("part", F.lit("_")))
    pairs = F.array(
        *[F.struct(F.lit(m).alias("m"), F.col(m).cast("double").alias("v")) for m in ("exact", "f1", "total")]
    )
    exploded = parts.select(prefix.alias("p"), F.inline(pairs))
    return exploded.select(F.concat("p", "m").alias("key"), F.col("v").alias("value"))


def _hopeful_buckets(placed: DataFrame, measures: tuple[str, ...]) -> DataFrame:
    """Buckets in which a running sum can reach its maximum, with the sums before them.

    Inside a bucket the sum rises by at most its positive parts; if that stays
    below a value some bucket ends on, the bucket need not be walked row by row.
    """
    ups = {f"up_{m}": F.sum(F.when(F.col(m) > 0, F.col(m)).otherwise(0)) for m in measures}
    based = sums_before(placed, {f"all_{m}": F.sum(m) for m in measures}, ups)
    based = based.withColumnsRenamed({f"__before_all_{m}": f"base_{m}" for m in measures})
    ends = based.agg(F.struct(*[F.max(F.col(f"base_{m}") + F.col(f"all_{m}")).alias(m) for m in measures]).alias("ends")).scalar()
    reachable = F.lit(False)
    for m in measures:
        reachable = reachable | (F.col(f"base_{m}") + F.col(f"up_{m}") >= F.greatest(f"__ends.{m}", F.lit(0)))
    return materialise(based.withColumn("__ends", ends).filter(reachable).select(BUCKET, *[f"base_{m}" for m in measures]))


def best_threshold(
    scored: DataFrame,
    unanswerable: DataFrame,
    na_prob: str = "na_prob",
    prediction: str = "prediction",
    pos: str = "pos",
) -> DataFrame:
    """One row: best achievable score and its no-answer threshold, for exact and F1.

    Starts from every unanswerable question being right and walks up ``na_prob``
    (ties in ``pos`` order): an answered question adds its score, a non-empty
    answer to an unanswerable one costs 1.  The first strict maximum wins, row by
    row; a maximum no better than the start gives threshold 0.  ``unanswerable`` has one
    row per question of the data set without an answer, predicted or not.
    """

    def gain(score: str, kind: str) -> Column:
        wrong = F.when(F.col(prediction) != "", F.lit(-1)).otherwise(F.lit(0))
        return F.when(F.col("has_ans"), F.col(score).cast(kind)).otherwise(wrong.cast(kind))

    # several passes follow over four narrow columns; the texts are left behind here
    gains = materialise(scored.select(na_prob, pos, gain("exact", "long").alias("e"), gain("f1", EXACT_SUM).alias("f")))
    placed = with_order_bucket(gains, na_prob, pos)
    hopeful = _hopeful_buckets(placed, ("e", "f"))
    inside = Window.partitionBy(BUCKET).orderBy(PLACE).rowsBetween(Window.unboundedPreceding, 0)
    walked = join_buckets(placed, hopeful)
    walked = walked.withColumns({f"c_{m}": F.col(f"base_{m}") + F.sum(m).over(inside) for m in ("e", "f")})

    def peak(m: str) -> Column:
        order = F.struct(F.col(f"c_{m}"), -F.col(na_prob), -F.col(pos))
        return F.max_by(F.struct(F.col(f"c_{m}").alias("gain"), F.col(na_prob).alias("at")), order).alias(m)

    rows = gains.agg(F.count("*").alias("n")).scalar()
    tops = walked.agg(peak("e"), peak("f")).withColumn("n", rows)
    base = unanswerable.agg(F.count("*").alias("no_ans")).scalar()

    def score(top: str) -> Column:
        return 100.0 * (base + F.greatest(F.col(f"{top}.gain"), F.lit(0))).cast("double") / F.col("n")

    def threshold(top: str) -> Column:
        return F.when(F.col(f"{top}.gain") > 0, F.col(f"{top}.at")).otherwise(F.lit(0.0))

    return tops.select(
        score("e").alias("best_exact"),
        threshold("e").alias("best_exact_thresh"),
        score("f").alias("best_f1"),
        threshold("f").alias("best_f1_thresh"),
    )


PR_KINDS = ("exact", "f1", "oracle")


def _pr_points(scored: DataFrame, na_prob: str) -> DataFrame:
    answered = F.col("has_ans").cast("int")
    groups = scored.groupBy(na_prob).agg(
        F.count("*").alias("__n"),
        F.sum((answered * F.col("exact")).cast(EXACT_SUM)).alias("__exact"),
        F.sum((answered * F.col("f1")).cast(EXACT_SUM)).alias("__f1"),
        F.sum(answered.cast(EXACT_SUM)).alias("__oracle"),
    )
    measures = {"upto": F.col("__n"), **{f"cum_{k}": F.col(f"__{k}") for k in PR_KINDS}}
    return running_totals(materialise(groups), na_prob, measures)


def _answerable(questions: DataFrame) -> Column:
    """Answerable questions of the data set, whether they were predicted or not."""
    return questions.agg(F.sum(F.col("has_ans").cast("long")).cast("double").alias("n")).scalar()


def pr_curve(scored: DataFrame, questions: DataFrame, na_prob: str = "na_prob") -> DataFrame:
    """(``kind``, ``na_prob``, ``precision``, ``recall``): one point per distinct probability.

    A point stands for accepting every answer up to that probability.  The
    curve's fixed first point (precision 1, recall 0) has a null probability.
    Recall counts all answerable ``questions`` (``has_ans``), predicted or not.
    Empty when no question has an answer.
    """
    points = _pr_points(scored, na_prob)
    positives = _answerable(questions)
    kinds = F.array(
        *[
            F.struct(
                F.lit(k).alias("kind"),
                (F.col(f"cum_{k}").cast("double") / F.col("upto")).alias("precision"),
                (F.col(f"cum_{k}").cast("double") / F.nullif(positives, F.lit(0.0))).alias("recall"),
            )
            for k in PR_KINDS
        ]
    )
    curve = points.select(F.col(na_prob).alias("na_prob"), F.inline(kinds)).filter("recall is not null")
    first = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall")) for k in PR_KINDS])
    start = questions.agg(F.sum(F.col("has_ans").cast("int")).alias("n")).filter("n > 0")
    start = start.select(F.lit(None).cast("double").alias("na_prob"), F.inline(first))
    return curve.unionByName(start).select("kind", "na_prob", "precision", "recall")


def average_precision(scored: DataFrame, questions: DataFrame, na_prob: str = "na_prob") -> DataFrame:
    """(``kind``, ``ap``): area under the stepwise curve, in percent; recall counts all answerable ``questions``."""
    points = _pr_points(scored, na_prob)
    positives = _answerable(questions)
    sums = points.agg(
        *[
            F.sum(F.col(f"cum_{k}").cast("double") / F.col("upto") * F.col(f"__{k}").cast("double")).alias(k)
            for k in PR_KINDS
        ]
    )
    kinds = F.array(
        *[
            F.struct(F.lit(k).alias("kind"), (100.0 * F.col(k) / F.nullif(positives, F.lit(0.0))).alias("ap"))
            for k in PR_KINDS
        ]
    )
    return sums.select(F.inline(kinds)).filter("ap is not null")


def na_histogram(scored: DataFrame, na_prob: str = "na_prob", bins: int = 20) -> DataFrame:
    """(``part``, ``bin``, ``n``, ``proportion``): no-answer probabilities per answerable group."""
    part = F.when(F.col("has_ans"), "HasAns").otherwise("NoAns")
    bin_of = F.least(F.floor(F.col(na_prob) * bins), F.lit(bins - 1)).cast("int")
    inside = scored.select(part.alias("part"), bin_of.alias("bin"), F.col(na_prob).between(0.0, 1.0).alias("in_range"))
    counts = inside.groupBy("part", "bin", "in_range").agg(F.count("*").alias("n"))
    # at most two groups of `bins` rows (plus out-of-range ones) from here on
    totals = counts.groupBy("part").agg(F.sum("n").alias("total"))
    return (
        counts.filter("in_range")
        .join(totals, "part")
        .select("part", "bin", "n", (F.col("n") / F.col("total")).alias("proportion"))
    )
