"""Span search against a direct per-example search."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from stairwell.operators import nbest as nb
from stairwell.plans.evaluation import answer_questions

CONTEXT = "".join(chr(97 + i % 26) for i in range(200))
SCHEMA = (
    "id string, window int, offset_mapping array<struct<start:int,end:int>>, "
    "start_logits array<double>, end_logits array<double>, best array<boolean>"
)


def make_features(seed, examples=12, length=14):
    pick = random.Random(seed)
    rows = []
    for e in range(examples):
        for w in range(pick.randint(1, 4)):
            offsets = [None, None] + [(3 * (w * 5 + k), 3 * (w * 5 + k) + 2) for k in range(length - 3)] + [None]
            logits = lambda: [pick.randint(-8, 8) / 4 for _ in range(length)]
            rows.append((f"e{e}", w, offsets, logits(), logits(), [pick.random() < 0.7 for _ in range(length)]))
    return rows


def top(values, n):
    return sorted(range(len(values)), key=lambda i: (-values[i], i))[:n]


def search(windows, n_best, max_answer, use_best=False):
    """Ranked (score, start char, end char, start logit, end logit) and the null prediction."""
    found, null = [], None
    for _, w, offsets, starts, ends, best in windows:
        score = starts[0] + ends[0]
        if null is None or score < null[0]:
            null = (score, starts[0], ends[0])
        for s in top(starts, n_best):
            for e in top(ends, n_best):
                if offsets[s] is None or offsets[e] is None or e < s or e - s + 1 > max_answer:
                    continue
                if use_best and not best[s]:
                    continue
                found.append((-(starts[s] + ends[e]), w, s, e, offsets[s][0], offsets[e][1], starts[s], ends[e]))
    ranked = [(-f[0], f[4], f[5], f[6], f[7]) for f in sorted(found)]
    return ranked, null


def expected(windows, n_best, max_answer, negatives, use_best=False):
    ranked, null = search(windows, n_best, max_answer, use_best)
    rows = [(s, CONTEXT[a:b], x, y, 0) for s, a, b, x, y in ranked]
    if negatives:
        rows.append((null[0], "", null[1], null[2], 1))
        rows.sort(key=lambda r: -r[0])
        rows = rows[:n_best] if any(r[4] for r in rows[:n_best]) else rows[:n_best] + [r for r in rows if r[4]]
    rows = rows if negatives else rows[:n_best]
    if not rows or (len(rows) == 1 and rows[0][1] == ""):
        rows.insert(0, (0.0, "empty", 0.0, 0.0, 0))
    peak = max(r[0] for r in rows)
    mass = sum(math.exp(r[0] - peak) for r in rows)
    return [(r[1], r[2], r[3], math.exp(r[0] - peak) / mass) for r in rows], null


@pytest.mark.parametrize("n_best,max_answer,negatives,use_best", [(5, 4, True, False), (3, 30, False, False), (20, 2, True, True), (2, 1, True, True)])
def test_nbest(spark, n_best, max_answer, negatives, use_best):
    rows = make_features(n_best + max_answer)
    features = spark.createDataFrame(rows, SCHEMA)
    contexts = spark.createDataFrame([(f"e{e}", CONTEXT) for e in range(12)], "id string, context string")
    scored = nb.window_candidates(features, n_best, max_answer, "best" if use_best else None)
    got = nb.example_nbest(scored, contexts, "id", n_best=n_best, with_negatives=negatives).cache()
    decided = {r.id: r for r in nb.null_decision(got, "id", 0.5).collect()}
    nulls = {r.id: r for r in nb.null_scores(scored, "id").collect()}
    for r in got.collect():
        mine = [x for x in rows if x[0] == r.id]
        want, null = expected(mine, n_best, max_answer, negatives, use_best)
        assert [(a.text, a.start_logit, a.end_logit) for a in r.nbest] == [w[:3] for w in want]
        assert [a.probability for a in r.nbest] == pytest.approx([w[3] for w in want])
        assert sum(a.probability for a in r.nbest) == pytest.approx(1.0)
        assert nulls[r.id].null_score == null[0] == r.null_score
        real = [w for w in want if w[0] != ""]
        if real:
            diff = null[0] - real[0][1] - real[0][2]
            assert decided[r.id].score_diff == diff
            assert decided[r.id].prediction_text == ("" if diff > 0.5 else real[0][0])
        else:
            assert decided[r.id].prediction_text == ""


def test_texts_of_the_windows_equal_those_of_the_contexts(spark):
    """Windows with their own stretch of the text need no contexts, and the plan joins none."""
    from stairwell.functions.text import token_offsets
    from stairwell.operators.features import window_features

    pick = random.Random(6)
    texts = [(i, " ".join(pick.choice(["é", "𝒳y", "ab,", "c", "\n dd"]) for _ in range(pick.randint(0, 60)))) for i in range(20)]
    docs = spark.createDataFrame(texts, "id long, context string").withColumn("spans", token_offsets(F.col("context")))
    docs = docs.withColumn("q", F.array(F.lit("why"), F.lit("?")))
    for context_first in (False, True):
        features = window_features(docs, ["id"], "q", "spans", 16, 4, context_first, text="context")
        logits = lambda a: F.transform("tokens", lambda _, p: ((p * a + F.col("id") * 3 + F.col("window")) % 13).cast("double"))
        scored = nb.window_candidates(features.withColumns({"start_logits": logits(7), "end_logits": logits(5)}), 6, 5)
        own = nb.example_nbest(scored, None, "id", n_best=6)
        assert "Join" not in own._jdf.queryExecution().optimizedPlan().toString()
        joined = nb.example_nbest(scored, docs, "id", n_best=6)
        assert sorted(map(str, own.collect())) == sorted(map(str, joined.collect()))
        covered = {r.id: r.t for r in features.groupBy("id").agg(F.max(F.col("text_at") + F.length("window_text")).alias("t")).collect()}
        assert covered == {i: len(t.rstrip()) for i, t in texts}
    with pytest.raises(ValueError, match="need contexts"):
        nb.example_nbest(nb.window_candidates(spark.createDataFrame(make_features(1), SCHEMA)), None, "id")


def test_masked_window_falls_back(spark):
    row = ("x", 0, [None, None], [2.0, 1.0], [1.5, 1.0], [True, True])
    features = spark.createDataFrame([row], SCHEMA)
    contexts = spark.createDataFrame([("x", "abc")], "id string, context string")
    scored = nb.window_candidates(features)
    with_null = nb.example_nbest(scored, contexts, "id").first()
    assert [a.text for a in with_null.nbest] == ["empty", ""]
    assert nb.null_decision(nb.example_nbest(scored, contexts, "id"), "id").first().prediction_text == ""
    without = nb.example_nbest(scored, contexts, "id", with_negatives=False)
    assert [a.text for a in without.first().nbest] == ["empty"]
    assert nb.best_answer(without, "id").first().prediction_text == "empty"


def test_float_logits(spark):
    rows = [r[:5] for r in make_features(3, 2)]
    schema = SCHEMA.replace("array<double>", "array<float>").replace(", best array<boolean>", "")
    contexts = spark.createDataFrame([(f"e{e}", CONTEXT) for e in range(2)], "id string, context string")
    features = spark.createDataFrame(rows, schema)
    got = nb.example_nbest(nb.window_candidates(features, 4, 5), contexts, "id", n_best=4).collect()
    for r in got:
        want, _ = expected([(*x, None) for x in rows if x[0] == r.id], 4, 5, True)
        assert [a.text for a in r.nbest] == [w[0] for w in want]


def test_beam(spark):
    offsets = [(0, 1), (2, 3), (4, 5), None]
    row = ("x", 0, offsets, [0, 2], [-0.5, -1.0], [1, 0, 2, 3], [-0.1, -0.2, -0.3, -0.4], 0.7)
    other = ("x", 1, offsets, [3, 3], [-0.5, -1.0], [3, 3, 3, 3], [-0.1, -0.2, -0.3, -0.4], -0.2)
    lone = ("y", 0, offsets, [3, 3], [-0.5, -1.0], [3, 3, 3, 3], [-0.1, -0.2, -0.3, -0.4], 0.1)
    schema = (
        "id string, window int, offset_mapping array<struct<start:int,end:int>>, start_index array<int>, start_log_probs array<double>, "
        "end_index array<int>, end_log_probs array<double>, cls_logit double"
    )
    features = spark.createDataFrame([row, other, lone], schema)
    contexts = spark.createDataFrame([("x", "a b c"), ("y", "a b c")], "id string, context string")
    scored = nb.beam_candidates(features, start_n_top=2, end_n_top=2)
    got = {r.id: r for r in nb.example_nbest(scored, contexts, "id", beam=True).collect()}
    assert [(a.text, round(a.score, 6)) for a in got["x"].nbest] == [("a b", -0.6), ("a", -0.7), ("c", -1.3)]
    assert got["x"].null_score == -0.2
    assert [(a.text, a.score) for a in got["y"].nbest] == [("", -2e-6)]


def test_join_by_key_and_format(spark):
    rows = make_features(8, 4)
    full = spark.createDataFrame(rows, SCHEMA)
    features = full.select("id", "window", "offset_mapping")
    logits = full.select("id", "window", "start_logits", "end_logits").orderBy(F.rand(1))
    contexts = spark.createDataFrame([(f"e{e}", CONTEXT) for e in range(4)], "id string, context string")
    said, nbest, odds = answer_questions(features, logits, contexts, "id", 5, 4, with_negatives=True)
    assert said.count() == nbest.count() == odds.count() == 4
    golds = contexts.select("id", F.array(F.lit("abc")).alias("answers"))
    formatted = nb.format_predictions(said, golds, "id")
    assert formatted.columns == ["id", "prediction_text", "no_answer_probability", "answers"]
    assert {r.no_answer_probability for r in formatted.collect()} == {0.0}


def test_many_windows_of_one_example_are_cut_before_the_shuffle(spark):
    features = spark.createDataFrame(make_features(1), SCHEMA)
    contexts = spark.createDataFrame([("e0", CONTEXT)], "id string, context string")
    plan = nb.example_nbest(nb.window_candidates(features), contexts, "id")._jdf.queryExecution().executedPlan().toString()
    partial = [i for i, line in enumerate(plan.splitlines()) if "WindowGroupLimit" in line and "Partial" in line]
    final = [i for i, line in enumerate(plan.splitlines()) if "WindowGroupLimit" in line and "Final" in line]
    assert partial and final and final[0] < partial[0]
