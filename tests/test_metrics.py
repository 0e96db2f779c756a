"""Answer, classification, tagging and translation metrics."""

from __future__ import annotations

import math
import random
import tracemalloc
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from stairwell.operators import bleu, classify as cl, qa_metrics as qa, tagging as tg
from stairwell.plans import evaluation as ev
from test_text import normalized

QUESTIONS = "qid string, golds array<string>, has_ans boolean"
PREDICTIONS = "pos long, qid string, prediction string"


def f1(gold, said, version):
    g, p = normalized(gold).split(), normalized(said).split()
    same = sum((Counter(g) & Counter(p)).values())
    if version == 2 and (not g or not p):
        return float(g == p)
    if same == 0:
        return 0.0
    return 2 * same / len(p) * same / len(g) / (same / len(p) + same / len(g))


def test_golden_evaluation(spark):
    """8 answerable questions of which 7 are right, 9 others of which 3 are left empty."""
    answerable = [True] * 5 + [False] * 4 + [True] * 3 + [False] * 5
    empty = {8, 13, 14}
    golds = [(f"q{i:02}", [f"The answer {i}", f"answer {i}!"] if a else [], a) for i, a in enumerate(answerable)]
    said = [(i, f"q{i:02}", "" if i in empty else "wrong" if i == 11 else f"answer {i}") for i in range(17)]
    questions = spark.createDataFrame(golds, QUESTIONS)
    predictions = spark.createDataFrame(said, PREDICTIONS)
    chances = predictions.select("qid", F.lit(0.0).alias("na_prob"))
    got = {r.key: r.value for r in ev.evaluate_v2(questions, predictions, chances, curves=True).collect()}
    want = {
        "exact": 58.8235294117647, "f1": 58.8235294117647, "total": 17,
        "HasAns_exact": 87.5, "HasAns_f1": 87.5, "HasAns_total": 8,
        "NoAns_exact": 33.333333333333336, "NoAns_f1": 33.333333333333336, "NoAns_total": 9,
        "best_exact": 82.3529411764706, "best_exact_thresh": 0.0, "best_f1": 82.3529411764706, "best_f1_thresh": 0.0,
    }
    assert {k: got[k] for k in want} == pytest.approx(want)
    assert got["pr_oracle_ap"] == pytest.approx(100 * 8 / 17) and got["pr_exact_ap"] == pytest.approx(100 * 7 / 17 * 7 / 8)
    plain = {r.key for r in ev.evaluate_v2(questions, predictions).collect()}
    assert "best_exact" not in plain and "HasAns_f1" in plain


def answers(seed, n=120):
    pick = random.Random(seed)
    words = ["the", "cat", "sat", "A", "mat!", "on", "an", "é"]
    text = lambda: " ".join(pick.choice(words) for _ in range(pick.randint(0, 5)))
    golds = []
    for i in range(n):
        options = [text() for _ in range(pick.randint(0, 3))]
        golds.append((f"q{i:03}", options, bool(options)))
    said = [(i, q, pick.choice([text(), "", *(o or [""])]), pick.choice([0.0, 0.0, 0.25, 1.0, pick.random()])) for i, (q, o, _) in enumerate(golds) if i % 9]
    return golds, said


@pytest.mark.parametrize("version", [1, 2])
def test_scores(spark, version):
    golds, said = answers(version)
    questions, predictions = spark.createDataFrame(golds, QUESTIONS), spark.createDataFrame(said, PREDICTIONS + ", na_prob double")
    got = {r.qid: r for r in qa.score_answers(questions, predictions, version=version).collect()}
    by_id = {q: o for q, o, _ in golds}
    for _, qid, text, _ in said:
        options = by_id[qid]
        if version == 2:
            options = [o for o in options if normalized(o)] or [""]
        assert got[qid].exact == max((int(normalized(o) == normalized(text)) for o in options), default=0)
        assert got[qid].f1 == pytest.approx(max((f1(o, text, version) for o in options), default=0.0))
        assert got[qid].exact == 0 or version == 1 or got[qid].f1 == 1.0
    assert len(got) == len(said)
    missing = qa.missing_predictions(questions, predictions).count()
    assert missing == len(golds) - len(said)
    if version == 1:
        row = qa.evaluate_v1(qa.score_answers(questions, predictions, version=1, how="left")).first()
        assert row.total == len(golds)
        assert row.exact_match == pytest.approx(100 * sum(r.exact for r in got.values()) / len(golds))


def test_empty_answers_differ_between_versions(spark):
    questions = spark.createDataFrame([("q", ["the"], True)], QUESTIONS)
    said = spark.createDataFrame([(0, "q", "a")], PREDICTIONS)
    assert qa.score_answers(questions, said, version=2).first().f1 == 1.0
    assert qa.score_answers(questions, said, version=1).first().f1 == 0.0


def sweep(rows, unanswerable):
    """rows: (na_prob, pos, has_ans, prediction, score)."""
    score = best = unanswerable
    at = 0.0
    for chance, _, has, text, value in sorted(rows):
        score += value if has else (-1 if text else 0)
        if score > best + 1e-9:
            best, at = score, chance
    return 100.0 * best / len(rows), at


@pytest.mark.parametrize("seed,width", [(1, 1), (2, 8), (3, 64)])
def test_threshold_sweep_and_curves(spark, partitions, seed, width):
    partitions(width)
    golds, said = answers(seed, 300)
    questions, predictions = spark.createDataFrame(golds, QUESTIONS), spark.createDataFrame(said, PREDICTIONS + ", na_prob double")
    scored = qa.score_answers(questions, predictions).cache()
    rows = scored.collect()
    best = qa.best_threshold(scored, questions.filter("not has_ans")).first()
    none = sum(not h for _, _, h in golds)
    for name in ("exact", "f1"):
        want = sweep([(r.na_prob, r.pos, r.has_ans, r.prediction, r[name]) for r in rows], none)
        assert (best[f"best_{name}"], best[f"best_{name}_thresh"]) == pytest.approx(want)
    positives = sum(h for _, _, h in golds)
    areas = {r.kind: r.ap for r in qa.average_precision(scored, questions).collect()}
    curve = {(r.kind, r.na_prob): (r.precision, r.recall) for r in qa.pr_curve(scored, questions).collect()}
    for name in ("exact", "f1", "oracle"):
        value = lambda r: float(r.has_ans) * (1 if name == "oracle" else r[name])
        area, hits, recall = 0.0, 0.0, 0.0
        ordered = sorted(rows, key=lambda r: r.na_prob)
        for i, r in enumerate(ordered):
            hits += value(r)
            if i == len(ordered) - 1 or ordered[i + 1].na_prob != r.na_prob:
                p, new = hits / (i + 1), hits / positives
                area += p * (new - recall)
                recall = new
                assert curve[name, r.na_prob] == pytest.approx((p, new))
        assert areas[name] == pytest.approx(100 * area)
        assert curve[name, None] == (1.0, 0.0)
    histogram = qa.na_histogram(scored).collect()
    assert sum(r.n for r in histogram) == len(rows)
    assert sum(r.proportion for r in histogram if r.part == "HasAns") == pytest.approx(1.0)
    assert max(r.bin for r in histogram) == 19


def test_no_answerable_question(spark):
    questions = spark.createDataFrame([("q", [], False)], QUESTIONS)
    said = spark.createDataFrame([(0, "q", "", 0.5)], PREDICTIONS + ", na_prob double")
    scored = qa.score_answers(questions, said)
    assert qa.average_precision(scored, questions).count() == 0 and qa.pr_curve(scored, questions).count() == 0
    assert {r.part for r in qa.evaluate_v2(scored).collect()} == {"overall", "NoAns"}
    assert qa.best_threshold(scored, questions).first().best_exact == 100.0


def test_strict_threshold(spark):
    scored = spark.createDataFrame([(0.5, True, 1, 1.0), (0.6, True, 1, 1.0), (0.6, False, 0, 0.0)], "na_prob double, has_ans boolean, exact int, f1 double")
    got = [r.exact for r in qa.apply_no_answer_threshold(scored, threshold=0.5).collect()]
    assert got == [1.0, 0.0, 1.0]


def labels(spark, n=400, classes=3, seed=4):
    pick = random.Random(seed)
    rows = [(pick.randrange(classes), pick.randrange(classes), round(pick.random(), 1), pick.random()) for _ in range(n)]
    return rows, spark.createDataFrame(rows, "gold int, said int, x double, y double")


def test_multiclass_matthews(spark):
    rows, df = labels(spark)
    table = pd.DataFrame([r[:2] for r in rows], columns=["g", "p"])
    c, s = (table.g == table.p).sum(), len(table)
    t, p = table.g.value_counts(), table.p.value_counts()
    want = (c * s - sum(t[k] * p[k] for k in range(3))) / math.sqrt((s * s - (p**2).sum()) * (s * s - (t**2).sum()))
    assert cl.matthews(df, "gold", "said").first()[0] == pytest.approx(want)
    constant = df.withColumn("said", F.lit(1))
    assert cl.matthews(constant, "gold", "said").first()[0] == 0.0


def test_binary_metrics(spark):
    rows, df = labels(spark, classes=2)
    tp = sum(g == p == 1 for g, p, *_ in rows)
    wrong = sum(g != p for g, p, *_ in rows)
    row = cl.task_metrics(df, "gold", "said", "mrpc").first()
    assert (row.accuracy, row.f1) == pytest.approx((1 - wrong / 400, 2 * tp / (2 * tp + wrong)))
    assert row.combined_score == pytest.approx((row.accuracy + row.f1) / 2)
    assert cl.task_metrics(df, "gold", "said", "rte").columns == ["accuracy"]
    assert cl.mse(df, "gold", "said").first().mse == pytest.approx(wrong / 400)


@pytest.mark.parametrize("width", [1, 32])
def test_rank_correlation_with_ties(spark, partitions, width):
    partitions(width)
    rows, df = labels(spark)
    table = pd.DataFrame([r[2:] for r in rows], columns=["x", "y"])
    df = df.unionByName(df.limit(3).withColumn("y", F.lit(None).cast("double")))
    row = cl.task_metrics(df, "x", "y", "stsb").first()
    want = table.x.rank().corr(table.y.rank())
    assert (row.pearson, row.spearman) == pytest.approx((table.x.corr(table.y), want))


def test_checkpoint_names(spark):
    df = spark.createDataFrame([("100", "f1", 1.0), ("", "f1", 2.0), (None, "em", 3.0)], "step string, key string, value double")
    assert {(r.key, r.value) for r in cl.unify_checkpoints(df).collect()} == {("f1_100", 1.0), ("f1", 2.0), ("em", 3.0)}


def walk_chunks(tags):
    """Chunks by a left-to-right walk with an explicit open chunk."""
    out, begun = [], None
    for i, tag in enumerate([*tags, "O"]):
        mark, kind = tag[0], tag[2:]
        joins = begun is not None and mark in "IE" and kind == begun[0] and not closed  # noqa: F821
        if begun is not None and not joins:
            out.append((begun[0], begun[1], i - 1))
            begun = None
        if mark != "O" and not joins:
            begun = (kind, i)
        closed = mark in "ES"
    return out


def test_chunks(spark):
    pick = random.Random(5)
    kinds = ["O", "O", "B-PER", "I-PER", "B-LOC", "I-LOC", "E-PER", "S-LOC"]
    rows = [[pick.choice(kinds) for _ in range(pick.randint(0, 12))] for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, t array<string>")
    got = {r.i: [tuple(c) for c in r.c] for r in df.select("i", tg.chunks(F.col("t")).alias("c")).collect()}
    assert got == {i: walk_chunks(t) for i, t in enumerate(rows)}


def test_entity_scores(spark):
    rows = [(["B-PER", "I-PER", "O", "B-LOC"], ["B-PER", "I-PER", "O", "O"]), (["O", "B-LOC"], ["B-PER", "B-LOC"]), ([], [])]
    df = spark.createDataFrame(rows, "g array<string>, p array<string>")
    row = tg.entity_scores(df, "g", "p").first()
    assert tuple(row) == pytest.approx((2 / 3, 2 / 3, 2 / 3, 4 / 6))
    flat = {r.key: r.value for r in tg.flatten_entity_scores(tg.entity_scores_by_type(df, "g", "p")).collect()}
    named = {r.key: r.value for r in tg.entity_metric_map(df, "g", "p").collect()}
    assert named == {**flat, **{f"overall_{k}": v for k, v in row.asDict().items()}}
    assert flat["LOC_recall"] == 0.5 and flat["PER_precision"] == 0.5 and flat["PER_number"] == 1.0


def brute_bleu(pairs):
    hits, shown, sys_len, ref_len = [0] * 4, [0] * 4, 0, 0
    for said, gold in pairs:
        p, r = said.split(), gold.split()
        sys_len, ref_len = sys_len + len(p), ref_len + len(r)
        for n in range(1, 5):
            grams = lambda t: Counter(tuple(t[i : i + n]) for i in range(len(t) - n + 1))
            hits[n - 1] += sum((grams(p) & grams(r)).values())
            shown[n - 1] += max(len(p) - n + 1, 0)
    if hits[0] == 0 or shown[3] == 0:
        return 0.0
    halves, logs = 1.0, 0.0
    for h, s in zip(hits, shown):
        if h == 0:
            halves *= 2
        logs += math.log(100 * (h or 1 / halves) / s)
    return (math.exp(1 - ref_len / sys_len) if sys_len < ref_len else 1.0) * math.exp(logs / 4)


@pytest.mark.parametrize(
    "pairs",
    [
        [("the cat sat on the mat", "the cat sat on a mat"), ("the the the the", "the cat the dog")],
        [("a b c d e", "e d c b a"), ("x", "y")],
        [("a b", "a b")],
        [("p q r s", "a b c d")],
        [("", "a b c d e"), ("a b c d e", "a b c d e f g h")],
    ],
)
def test_bleu(spark, pairs):
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "k int, p string, r string")
    row = bleu.corpus_bleu(df, "p", "r").first()
    assert row.bleu == pytest.approx(brute_bleu(pairs), abs=5e-5)
    assert row.gen_len == pytest.approx(sum(len(p.split()) for p, _ in pairs) / len(pairs), abs=5e-5)
    counted = bleu.corpus_bleu(df, "p", "r", F.lit(7)).first()
    assert counted.gen_len == 7.0 and counted.bleu == row.bleu


def test_matches_are_counted_in_the_row(spark, monkeypatch):
    """Clipped n-grams of random rows against counters, in stretches of any size; no text is shuffled."""
    import pyarrow as pa

    pick = random.Random(8)
    texts = lambda: [None if pick.random() < 0.1 else pick.choices("abc", k=pick.randint(0, 12)) for _ in range(60)]
    said, meant = texts(), texts()
    want = []
    for p, r in zip(said, meant, strict=True):
        grams = lambda t, n: Counter(tuple((t or [])[k : k + n]) for k in range(len(t or []) - n + 1))
        row = [len(r or [])]
        for n in bleu.ORDERS:
            row += [(grams(p, n) & grams(r, n)).total(), grams(p, n).total()]
        want.append(row)
    for stretch in (1, 30, 1 << 20):
        monkeypatch.setattr(bleu, "BATCH_TOKENS", stretch)
        kind = pa.list_(pa.string())
        assert bleu._matches(pa.array(said, kind), pa.array(meant, kind)).to_pylist() == want
    df = spark.range(4).select(F.lit("a b").alias("p"), F.lit("a c").alias("r")).repartition(2)
    plan = bleu.corpus_bleu(df, "p", "r")._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" not in plan.replace("Repartition 2", "").replace("RepartitionByExpression [], 2", "") and "Generate" not in plan


def test_counting_a_large_batch_takes_little_memory():
    """A million tokens in one batch: the arrays that count them cover one stretch at a time."""
    import pyarrow as pa

    said = pa.array([[f"w{k % 50}" for k in range(i, i + 500)] for i in range(1000)])
    tracemalloc.start()
    counts = bleu._matches(said, said)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert counts.to_pylist() == [[500, 500, 500, 499, 499, 498, 498, 497, 497]] * 1000
    assert peak < 24 << 20
