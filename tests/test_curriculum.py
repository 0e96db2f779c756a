"""Difficulty scores and curricula."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stairwell.operators import curriculum as cu, difficulty as di, transport as tr
from stairwell.plans.training import build_curriculum, score_examples

HIDDEN = "idx long, layer int, token_pos int, vector array<float>"


def hidden(spark, n=6, tokens=4, width=5, seed=3):
    pick = np.random.default_rng(seed)
    rows = [
        (i, layer, k, [float(x) for x in pick.normal(size=width).astype(np.float32)])
        for i in range(n)
        for layer in (0, 1, -1)
        for k in range(tokens)
    ]
    return rows, spark.createDataFrame(rows, HIDDEN)


def clouds(rows, idx, layer):
    return np.array([v for i, l, _, v in sorted(rows[:], key=lambda r: r[:3]) if i == idx and l == layer], dtype=float)


def softmax(m):
    e = np.exp(m - m.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def kl(x, y):
    return float(np.mean(np.where(y > 0, y * (np.log(np.where(y > 0, y, 1)) - x), 0)))


@pytest.mark.parametrize("criterion", ["kl", "kl_one_sided"])
@pytest.mark.parametrize("norm", ["softmax", "line"])
def test_kl(spark, criterion, norm):
    rows, df = hidden(spark)
    got = {r.idx: r.difficulty for r in score_examples(df, criterion, norm).collect()}
    for i in got:
        x, y = clouds(rows, i, 0), clouds(rows, i, -1)
        if norm == "softmax":
            x, y = softmax(x), softmax(y)
        else:
            x, y = ((m - m.min()) / (m.max() - m.min()) for m in (x, y))
        want = (kl(x, y) + kl(y, x)) / 2 if criterion == "kl" else kl(x, y)
        assert got[i] == pytest.approx(want, rel=1e-6)


def test_line_uses_the_extremes_of_the_batch(spark):
    rows = [(i, i // 2, [float(i), float(i + 1)]) for i in range(4)]
    df = spark.createDataFrame(rows, "idx long, batch long, x array<double>")
    got = {r.idx: r.x for r in di.normalise(df, ["x"], "line", "batch").collect()}
    assert got == {0: [0.0, 0.5], 1: [0.5, 1.0], 2: [0.0, 0.5], 3: [0.5, 1.0]}
    whole = {r.idx: r.x for r in di.normalise(df, ["x"], "line").collect()}
    assert whole[0] == [0.0, 0.25] and whole[3] == [0.75, 1.0]
    assert di.normalise(df, ["x"], "Gaussian") is df
    with pytest.raises(ValueError):
        di.normalise(df, ["x"], "other")


def test_batch_scores(spark):
    scored = spark.createDataFrame([(i, float(i)) for i in range(10)], "idx long, difficulty double")
    got = {r.idx: r.batch_difficulty for r in di.batch_difficulty(scored, "idx", 4).collect()}
    assert got[0] == got[3] == 1.5 and got[8] == got[9] == 8.5


def test_two_points_have_half_their_cost(spark):
    """With one point on each side the source potential is half of |x-y|²/2."""
    rows = [(0, 0, 0, [0.0, 0.0]), (0, -1, 0, [3.0, 4.0]), (1, 0, 0, [1.0, 1.0]), (1, -1, 0, [1.0, 1.0])]
    got = {r.idx: r.difficulty for r in tr.sinkhorn_difficulty(spark.createDataFrame(rows, HIDDEN)).collect()}
    assert got == pytest.approx({0: 25 / 4, 1: 0.0})


def test_transport_meets_the_exact_cost(spark):
    """For a small blur both potentials together approach the optimal assignment."""
    from itertools import permutations

    pick = np.random.default_rng(0)
    x, y = pick.normal(size=(4, 3)), pick.normal(size=(4, 3)) + 2
    best = min(sum(((x[i] - y[j]) ** 2).sum() / 2 for i, j in enumerate(p)) for p in permutations(range(4))) / 4
    both = (tr.source_potential(x, y, 0.01, 0.9) + tr.source_potential(y, x, 0.01, 0.9)) / 4
    assert both == pytest.approx(best, rel=1e-2)


def test_transport_over_a_table(spark):
    rows, df = hidden(spark)
    got = {r.idx: r.difficulty for r in score_examples(df).collect()}
    assert got == pytest.approx({i: tr.source_potential(clouds(rows, i, 0), clouds(rows, i, -1)) for i in range(6)}, rel=1e-6)


@pytest.mark.parametrize("tile", [1, 16, 64, 150])
def test_tiled_transport_equals_the_dense_one(spark, tile):
    pick = np.random.default_rng(3)
    x, y = pick.normal(size=(200, 5)), pick.normal(size=(130, 5)) + 1
    dense = tr.source_potential(x, y)
    assert tr.source_potential(x, y, tile=tile) == pytest.approx(dense, rel=1e-9)
    if tile == 64:
        rows = [(0, layer, i, v.tolist()) for layer, cloud in ((0, x), (-1, y)) for i, v in enumerate(cloud)] + [(1, 0, 0, [0.0] * 5)]
        got = {r.idx: r.difficulty for r in tr.sinkhorn_difficulty(spark.createDataFrame(rows, HIDDEN), tile=tile).collect()}
        assert got[0] == pytest.approx(dense, rel=1e-6) and got[1] is None


def test_tiles_are_sent_once(spark):
    """A task sends one block per group and tile, however many batches it reads; a full memory sends them earlier."""
    import pyarrow as pa

    pick = np.random.default_rng(2)
    data, labels = pick.normal(size=(90, 7)), [i % 3 for i in range(90)]
    batches = [pa.RecordBatch.from_arrays([pa.array(labels[k : k + 10]), pa.array(list(data[k : k + 10]))], ["g", "v"]) for k in range(0, 90, 10)]
    for tile, most, rows in ((3, 1 << 30, 3 * 49), (7, 1 << 30, 3 * 49), (3, 1, 9 * 3 * 49)):
        sent = pa.Table.from_batches(di.moment_tiles("g", tile, most)(iter(batches))).to_pandas()
        assert len(sent) == rows
        for g in range(3):
            mine = data[[k for k in range(90) if labels[k] == g]]
            got = sent[sent.g == g].groupby(["i", "j"]).value.sum().to_numpy().reshape(7, 7)
            assert np.allclose(got, mine.T @ mine)


def test_layers_meet_in_one_shuffle(spark):
    _, df = hidden(spark)
    paired = di.pair_layers(df.withColumn("b", F.floor(F.col("idx") / 4)), by="b")
    for step in (paired, di.kl_difficulty(paired, "b")):
        plan = step._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "max(" not in plan
    some = spark.createDataFrame([(0, 0, 0, [1.0]), (0, -1, 0, [2.0]), (0, 0, 1, [3.0]), (1, -1, 0, [4.0]), (1, 5, 0, [9.0])], HIDDEN)
    got = sorted((r.idx, r.token_pos, r.x, r.y) for r in di.pair_layers(some).collect())
    assert got == [(0, 0, [1.0], [2.0]), (0, 1, [3.0], None), (1, 0, None, [4.0])]


def test_second_moment(spark):
    pick = np.random.default_rng(1)
    data = pick.normal(size=(50, 4)).astype(np.float32)
    rows = [(i, "ab"[i % 2], [float(v) for v in data[i]]) for i in range(50)]
    df = spark.createDataFrame(rows, "idx long, label string, vector array<float>").repartition(5)
    got = {(r.label, r.i, r.j): r.value for r in di.second_moment(df, "label", "vector").collect()}
    for k, label in enumerate("ab"):
        want = data[k::2].astype(float).T @ data[k::2].astype(float)
        for i in range(4):
            for j in range(4):
                assert got[label, i, j] == pytest.approx(want[i, j])


def test_vector_std(spark):
    rows, df = hidden(spark)
    last = df.filter("layer = -1")
    per_token = np.array([v for _, l, _, v in rows if l == -1])
    per_sample = np.array([clouds(rows, i, -1).mean(axis=0) for i in range(6)])
    got = [r["std"] for r in di.vector_std(last, "vector").orderBy("dim").collect()]
    assert got == pytest.approx(list(per_token.std(axis=0)), rel=1e-5)
    got = [r["std"] for r in di.vector_std(last, "vector", "idx").orderBy("dim").collect()]
    assert got == pytest.approx(list(per_sample.std(axis=0)), rel=1e-5)


def scored(spark, n=3000, seed=2):
    """Most rows are easy, so one level holds far more than its share."""
    pick = random.Random(seed)
    rows = [(i, pick.random() ** 3) for i in range(n)]
    return rows, spark.createDataFrame(rows, "idx long, difficulty double")


def leveled(rows, n):
    lo, hi = min(d for _, d in rows), max(d for _, d in rows)
    out = {i: [] for i in range(n)}
    for idx, d in rows:
        out[n - 1 if d == hi else int(n * (d - lo) / (hi - lo))].append(idx)
    return out


def first(ids, k, seed):
    return sorted(ids, key=lambda i: (hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i))[:k]


def stages_of(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.stage, []).append(r.idx)
    assert all(len(v) == len(set(v)) for v in out.values())
    return {k: set(v) for k, v in out.items()}


@pytest.mark.parametrize("n,gated,batch_size", [(3, True, 16), (3, False, 16), (5, True, 4)])
def test_cumulative_and_disjoint(spark, n, gated, batch_size):
    rows, df = scored(spark)
    levels, gate = leveled(rows, n), len(rows) * n // batch_size
    want = {}
    for i, ids in levels.items():
        k = len(ids) if gated and len(ids) <= gate else len(ids) // n
        want[i] = set(first(ids, k, 42))
    disjoint = stages_of(build_curriculum(df, "disjoint", n, batch_size, gated=gated))
    assert disjoint == {i: s for i, s in want.items() if s}
    cumulative = stages_of(build_curriculum(df, "cumulative", n, batch_size, gated=gated))
    for i in range(n):
        assert cumulative[i] == set().union(*[want[j] for j in range(i + 1)])
        assert i == 0 or cumulative[i - 1] <= cumulative[i]


def test_equal_difficulties_are_all_hard(spark):
    df = spark.createDataFrame([(i, 1.5) for i in range(5)], "idx long, difficulty double")
    assert {r.level for r in cu.difficulty_levels(df, 3).collect()} == {2}


def test_ordered(spark):
    rows, df = scored(spark, 500)
    levels = cu.difficulty_levels(df, 3)
    order = [r.idx for r in cu.ordered_full_set(levels).orderBy("pos").collect()]
    assert order == [i for level in leveled(rows, 3).values() for i in sorted(level)]
    stages = stages_of(build_curriculum(df, "ordered"))
    assert len(stages[0]) == 500 and set(stages) == {0, 1, 2, 3}


def test_batches(spark):
    rows, df = scored(spark, 997)
    units = cu.batch_levels(df, 3, 8)
    kept = {r.batch for r in cu.distill_batches(units, 3, 8, 1).collect()}
    means = {}
    for idx, d in rows:
        means.setdefault(idx // 8, []).append(d)
    want, gate = set(), int(997 / 8 / 3)
    for ids in leveled([(b, sum(v) / len(v)) for b, v in means.items()], 3).values():
        want |= set(first(ids, int(gate / 3) if len(ids) > gate else len(ids), 1))
    assert kept == want
    members = cu.batch_members(df, cu.distill_batches(units, 3, 8, 1), 8)
    assert {r.idx for r in members.collect()} == {i for i, _ in rows if i // 8 in want}


def test_random_kinds_and_plan(spark):
    _, df = scored(spark, 900)
    apart = stages_of(build_curriculum(df, "random"))
    assert {k: len(v) for k, v in apart.items()} == {0: 100, 1: 100, 2: 100}
    grown = stages_of(build_curriculum(df, "random_cumulative"))
    assert grown[2] == apart[0] | apart[1] | apart[2]
    plan = cu.training_plan(df, build_curriculum(df, "random"), 2).groupBy("plan_pos").count().collect()
    assert {r.plan_pos: r["count"] for r in plan} == {0: 900, 1: 900, 2: 100, 3: 100, 4: 100}
    with pytest.raises(ValueError):
        build_curriculum(df, "other")


def test_summaries_and_stage_rows(spark):
    rows, df = scored(spark, 300)
    stages = build_curriculum(df, "cumulative")
    summary = {(r.stage, r.level): r.n for r in cu.stage_summary(stages).collect()}
    assert summary[2, None] == sum(n for (s, level), n in summary.items() if s == 2 and level is not None)
    assert cu.stage_rows(df, stages, 0).count() == summary[0, None]
    table = {r.level: (r.n, r.threshold, r.total) for r in cu.level_summary(cu.difficulty_levels(df, 3), 3, 16).collect()}
    assert table[0] == (len(leveled(rows, 3)[0]), 300 * 3 // 16, 300)


def test_same_result_for_any_width(spark, partitions):
    _, df = scored(spark, 800)
    seen = []
    for width in (1, 8, 40):
        partitions(width)
        seen.append(stages_of(build_curriculum(df.repartition(width), "cumulative")))
    assert seen[0] == seen[1] == seen[2]
    assert not math.isnan(len(seen[0]))


def test_worker_functions_need_no_installed_package(tmp_path):
    import subprocess
    import sys

    from pyspark import cloudpickle

    (tmp_path / "f.pickle").write_bytes(cloudpickle.dumps(tr.source_potential))
    code = "import pickle, numpy as n; f = pickle.load(open('f.pickle', 'rb')); print(f(n.zeros((1, 2)), n.array([[3.0, 4.0]])))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True)
    assert float(out.stdout) == pytest.approx(25 / 4)
