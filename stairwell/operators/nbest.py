"""From logits to ranked answer spans.

Everything that concerns one window happens inside its row: the top starts and
ends are picked from the arrays, paired and cut to the best ``n`` before any row
is produced.  Only those at most ``n`` candidates per window are shuffled to
their example, where the rank filter is again applied before the shuffle
(partial group limit).  An example with a huge number of windows therefore never
gathers in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from stairwell.functions.arrays import let
from stairwell.operators.features import TEXT_AT, WINDOW_TEXT

EMPTY_TEXT = "empty"  # fixed value: answer shown when only the null answer exists
BEAM_FALLBACK = -1e-6  # fixed value: log probabilities of the beam fallback answer


def attach_logits(features: DataFrame, logits: DataFrame, keys: list[str]) -> DataFrame:
    """Join model output to its window by key, never by position."""
    return features.join(logits, keys)


def _top(values: Column, n: int) -> Column:
    """``array<struct<neg,idx>>`` of the ``n`` largest elements, earlier index first on ties.

    The ``n``-th largest value comes from a sort of plain numbers; only elements that reach it become structs.
    """

    def reaching(least: Column) -> Column:
        marked = F.transform(values, lambda v, i: F.when(least.isNull() | (v >= least), F.struct((-v).alias("neg"), i.alias("idx"))))
        return F.slice(F.sort_array(F.filter(marked, lambda x: x.isNotNull())), F.lit(1), F.lit(n))

    return let(F.get(F.sort_array(values, asc=False), F.lit(n - 1)), reaching)


def _in_context(offsets: Column, best_context: Column | None, start: Column) -> Column:
    """Whether an answer may start at a position."""
    known = F.get(offsets, start).isNotNull()
    return known if best_context is None else known & F.coalesce(F.get(best_context, start), F.lit(False))


def _fits(start: Column, end: Column, max_answer: int) -> Column:
    return (end >= start) & (end - start < max_answer)


def _candidate(start: Column, end: Column, s: Column, e: Column, offsets: Column, with_text: bool) -> Column:
    begin, stop = F.get(offsets, start)["start"], F.get(offsets, end)["end"]
    # the window holds its own stretch of the context, so a short text is cut here and no context travels
    text = [F.substring(F.col(WINDOW_TEXT), begin - F.col(TEXT_AT) + 1, stop - begin).alias("text")] if with_text else []
    return F.struct(
        (-(s + e)).alias("neg_score"),
        start.alias("start_index"),
        end.alias("end_index"),
        s.alias("start_logit"),
        e.alias("end_logit"),
        begin.alias("start_char"),
        stop.alias("end_char"),
        *text,
    )


def window_candidates(
    df: DataFrame,
    n_best: int = 20,
    max_answer: int = 30,
    max_context: str | None = None,
    start_logits: str = "start_logits",
    end_logits: str = "end_logits",
    offsets: str = "offset_mapping",
    every: bool = False,
) -> DataFrame:
    """Add ``candidates`` and ``null_prediction``.

    Starts and ends are the window's best ``n_best``. Of their valid pairs the best ``n_best`` stay, more than a
    ranking over windows can use, or all of them with ``every``.

    ``max_context`` optionally names an array<boolean> that is true where a token
    has its maximum context in this window.  Windows with their text (``window_features`` with ``text``) give candidates
    with theirs.
    """
    off = F.col(offsets)
    best_context = F.col(max_context) if max_context else None
    starts = F.filter(_top(F.col(start_logits), n_best), lambda s: _in_context(off, best_context, s["idx"]))
    ends = F.filter(_top(F.col(end_logits), n_best), lambda e: F.get(off, e["idx"]).isNotNull())
    tops = F.struct(starts.alias("starts"), ends.alias("ends"))

    def pairs(t: Column) -> Column:
        return F.flatten(
            F.transform(
                t["starts"],
                lambda s: F.transform(
                    F.filter(t["ends"], lambda e: _fits(s["idx"], e["idx"], max_answer)),
                    lambda e: _candidate(s["idx"], e["idx"], -s["neg"], -e["neg"], off, WINDOW_TEXT in df.columns),
                ),
            )
        )

    ranked = F.sort_array(let(tops, pairs))
    first_start, first_end = F.get(start_logits, F.lit(0)), F.get(end_logits, F.lit(0))
    return df.withColumns(
        {
            "candidates": ranked if every else F.slice(ranked, F.lit(1), F.lit(n_best)),
            "null_prediction": F.struct(
                (first_start + first_end).alias("score"),
                first_start.alias("start_logit"),
                first_end.alias("end_logit"),
            ),
        }
    )


def beam_candidates(
    df: DataFrame,
    n_best: int = 20,
    max_answer: int = 30,
    start_n_top: int = 5,
    end_n_top: int = 5,
    max_context: str | None = None,
    offsets: str = "offset_mapping",
) -> DataFrame:
    """Beam form: for start ``i`` the ends are stored at ``i * end_n_top + j``."""
    off = F.col(offsets)
    best_context = F.col(max_context) if max_context else None
    slots = F.sequence(F.lit(0), F.lit(start_n_top * end_n_top - 1))
    picked = F.transform(
        slots,
        lambda k: F.struct(
            F.get("start_index", F.floor(k / end_n_top).cast("int")).alias("s"),
            F.get("end_index", k).alias("e"),
            F.get("start_log_probs", F.floor(k / end_n_top).cast("int")).alias("ps"),
            F.get("end_log_probs", k).alias("pe"),
        ),
    )
    usable = F.filter(
        picked,
        lambda x: _fits(x["s"], x["e"], max_answer)
        & _in_context(off, best_context, x["s"])
        & F.get(off, x["e"]).isNotNull(),
    )
    spans = F.transform(usable, lambda x: _candidate(x["s"], x["e"], x["ps"], x["pe"], off, WINDOW_TEXT in df.columns))
    return df.withColumns(
        {
            "candidates": F.slice(F.sort_array(spans), F.lit(1), F.lit(n_best)),
            "null_prediction": F.struct(
                F.col("cls_logit").alias("score"),
                F.col("cls_logit").alias("start_logit"),
                F.lit(0.0).cast(df.schema["cls_logit"].dataType).alias("end_logit"),
            ),
        }
    )


def span_rows(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """One row per candidate span of a window, best first."""
    names = ("start_index", "end_index", "start_logit", "end_logit", "start_char", "end_char")
    rows = F.transform(
        "candidates",
        lambda c, i: F.struct(
            (i + 1).alias("rank"), *[c[n].alias(n) for n in names], (-c["neg_score"]).alias("score")
        ),
    )
    return candidates.select(*keys, F.inline(rows))


def null_scores(candidates: DataFrame, example: str, window: str = "window") -> DataFrame:
    """Smallest null score of an example's windows, the first window on ties."""
    order = F.struct(F.col("null_prediction.score"), F.col(window))
    best = F.min_by(F.struct("null_prediction", F.col(window).alias("window")), order)
    return candidates.groupBy(example).agg(best.alias("b")).select(
        example,
        F.col("b.null_prediction.score").alias("null_score"),
        F.col("b.null_prediction.start_logit").alias("start_logit"),
        F.col("b.null_prediction.end_logit").alias("end_logit"),
        F.col("b.window").alias("window"),
    )


def example_nbest(
    candidates: DataFrame,
    contexts: DataFrame | None,
    example: str,
    context: str = "context",
    window: str = "window",
    n_best: int = 20,
    with_negatives: bool = True,
    beam: bool = False,
) -> DataFrame:
    """One row per example: ``nbest`` (ranked answers with text and probability) and ``null_score``.

    ``candidates`` comes from ``window_candidates`` or ``beam_candidates``;
    ``contexts`` has one row per example with the context text; None if the candidates have their texts, which spares
    the join.  Ties are broken by window, start and end.
    """
    own_text = contexts is None
    if own_text and "text" not in candidates.schema["candidates"].dataType.elementType.names:
        raise ValueError("candidates without texts need contexts")
    score_type = candidates.schema["null_prediction"].dataType["score"].dataType.simpleString()
    null_row = F.struct(
        F.lit(1).alias("kind"),
        F.col("null_prediction.score").alias("key"),
        F.lit(0).alias("start_index"),
        F.lit(0).alias("end_index"),
        F.col("null_prediction.start_logit").alias("start_logit"),
        F.col("null_prediction.end_logit").alias("end_logit"),
        F.lit(0).alias("start_char"),
        F.lit(0).alias("end_char"),
        F.lit("").alias("text"),
    )
    span_row = F.transform(
        "candidates",
        lambda c: F.struct(
            F.lit(0).alias("kind"),
            c["neg_score"].cast(score_type).alias("key"),
            c["start_index"].alias("start_index"),
            c["end_index"].alias("end_index"),
            c["start_logit"].cast(score_type).alias("start_logit"),
            c["end_logit"].cast(score_type).alias("end_logit"),
            c["start_char"].alias("start_char"),
            c["end_char"].alias("end_char"),
            (c["text"] if own_text else F.lit("")).alias("text"),
        ),
    )
    rows = candidates.select(example, F.col(window).alias("__w"), F.inline(F.concat(span_row, F.array(null_row))))
    # spans sort by descending score (key = -score), null rows by ascending score
    order = Window.partitionBy(example, "kind").orderBy("key", "__w", "start_index", "end_index", "start_logit")
    ranked = rows.withColumn("__rank", F.row_number().over(order)).filter(F.col("__rank") <= n_best)
    ranked = ranked.filter((F.col("kind") == 0) | (F.col("__rank") == 1))
    answer = F.struct(
        F.col("__rank").alias("rank"),
        (-F.col("key")).alias("score"),
        "start_logit",
        "end_logit",
        "start_char",
        "end_char",
        "text",
    )
    null_answer = F.struct(
        F.lit(0).alias("rank"),
        F.col("key").alias("score"),
        "start_logit",
        "end_logit",
        F.lit(0).alias("start_char"),
        F.lit(0).alias("end_char"),
        F.lit("").alias("text"),
    )
    # at most n_best + 1 rows per example remain
    grouped = ranked.groupBy(example).agg(
        F.sort_array(F.collect_list(F.when(F.col("kind") == 0, answer))).alias("spans"),
        F.max(F.when(F.col("kind") == 1, null_answer)).alias("null_answer"),
    )
    joined = grouped if own_text else grouped.join(contexts.select(example, F.col(context).alias("__context")), example)
    spans, null = F.col("spans"), F.col("null_answer")
    if with_negatives and not beam:
        ahead = F.filter(spans, lambda s: s["score"] >= null["score"])
        behind = F.filter(spans, lambda s: s["score"] < null["score"])
        kept = F.when(
            F.size(ahead) < n_best, F.slice(F.concat(ahead, F.array(null), behind), F.lit(1), F.lit(n_best))
        ).otherwise(F.concat(spans, F.array(null)))
    else:
        kept = spans
    text = lambda s: s["text"] if own_text else F.substring(F.col("__context"), s["start_char"] + 1, s["end_char"] - s["start_char"])
    answers = F.transform(
        kept,
        lambda s: F.struct(
            text(s).alias("text"), s["score"].alias("score"), s["start_logit"].alias("start_logit"),
            s["end_logit"].alias("end_logit"),
        ),
    )
    missing = F.lit(BEAM_FALLBACK if beam else 0.0).cast(score_type)
    fallback = F.array(
        F.struct(
            F.lit("" if beam else EMPTY_TEXT).alias("text"),
            (missing + missing).alias("score"),
            missing.alias("start_logit"),
            missing.alias("end_logit"),
        )
    )
    lonely = F.size("answers") == 0
    if not beam:
        lonely = lonely | ((F.size("answers") == 1) & (F.get("answers", F.lit(0))["text"] == ""))
    filled = joined.select(example, "null_answer", answers.alias("answers"))
    filled = filled.select(
        example,
        F.col("null_answer.score").alias("null_score"),
        F.when(lonely, F.concat(fallback, "answers")).otherwise(F.col("answers")).alias("answers"),
    )

    def with_probability(a: Column) -> Column:
        top = F.array_max(F.transform(a, lambda s: s["score"].cast("double")))

        def share(exps: Column) -> Column:
            total = F.aggregate(exps, F.lit(0.0), lambda acc, x: acc + x)
            return let(
                total,
                lambda t: F.transform(
                    a,
                    lambda s, i: F.struct(
                        s["text"].alias("text"),
                        s["start_logit"].alias("start_logit"),
                        s["end_logit"].alias("end_logit"),
                        s["score"].alias("score"),
                        (F.get(exps, i) / t).alias("probability"),
                    ),
                ),
            )

        return let(top, lambda m: let(F.transform(a, lambda s: F.exp(s["score"].cast("double") - m)), share))

    return filled.select(example, "null_score", with_probability(F.col("answers")).alias("nbest"))


def nbest_rows(nbest: DataFrame, example: str) -> DataFrame:
    """One row per ranked answer."""
    names = ("text", "start_logit", "end_logit", "score", "probability")
    rows = F.transform("nbest", lambda a, i: F.struct((i + 1).alias("rank"), *[a[n].alias(n) for n in names]))
    return nbest.select(example, F.inline(rows))


def best_answer(nbest: DataFrame, example: str) -> DataFrame:
    """(``example``, ``prediction_text``, ``null_score``): the top answer, without negatives and for beams."""
    return nbest.select(example, F.get("nbest", F.lit(0))["text"].alias("prediction_text"), "null_score")


def null_decision(nbest: DataFrame, example: str, threshold: float = 0.0) -> DataFrame:
    """Choose between the best non-empty answer and no answer.

    ``score_diff`` is the null score minus the best non-empty answer's two logits;
    no answer wins when it exceeds ``threshold``, and when there is no non-empty
    answer at all (``score_diff`` is then null).
    """
    real = F.get(F.filter("nbest", lambda a: a["text"] != ""), F.lit(0))
    return nbest.select(example, "null_score", real.alias("__best")).select(
        example,
        (F.col("null_score") - F.col("__best.start_logit") - F.col("__best.end_logit")).alias("score_diff"),
        "__best",
    ).select(
        example,
        "score_diff",
        F.when(F.col("__best").isNull() | (F.col("score_diff") > threshold), F.lit(""))
        .otherwise(F.col("__best.text"))
        .alias("prediction_text"),
    )


def format_predictions(
    predictions: DataFrame, references: DataFrame, example: str, probability: Column | None = None
) -> DataFrame:
    """(``id``, ``prediction_text``, ``no_answer_probability``, ``answers``) for the metric."""
    chance = probability if probability is not None else F.lit(0.0)
    shaped = predictions.select(
        F.col(example).alias("id"), "prediction_text", chance.cast("double").alias("no_answer_probability")
    )
    return shaped.join(references.select(F.col(example).alias("id"), "answers"), "id")
