"""Running totals, dense ids, ranks and hash samples against direct computation."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from stairwell.operators import curriculum as cu, ordering as od, sampling as sp


def frame(spark, rows):
    return spark.createDataFrame(rows, "value double, tie long, x long")


def skewed(n=2000):
    """A third of all rows share one value."""
    pick = random.Random(1)
    return [(0.0 if i % 3 == 0 else pick.choice([0.1, 0.5, pick.random()]), i, pick.randint(-5, 5)) for i in range(n)]


@pytest.mark.parametrize("width", [1, 3, 64])
def test_running_totals(spark, partitions, width):
    partitions(width)
    rows = skewed()
    got = od.running_totals(frame(spark, rows), "value", {"c": F.col("x")}, tie="tie").collect()
    total, want = 0, {}
    for value, tie, x in sorted(rows):
        total += x
        want[tie] = total
    assert {r.tie: r.c for r in got} == want


def test_buckets_follow_the_order_and_stay_small(spark):
    rows = skewed(3000)
    placed = od.with_order_bucket(frame(spark, rows), "value", "tie", edges=50)
    got = sorted((r.value, r.tie, r[od.BUCKET]) for r in placed.collect())
    buckets = [b for _, _, b in got]
    assert buckets == sorted(buckets)
    assert max(buckets.count(b) for b in set(buckets)) <= 3000 / 50 * 3


def test_dense_index(spark):
    rows = [(i * 37 % 1009, i) for i in range(1009)]
    df = spark.createDataFrame(rows, "key long, x int")
    got = od.dense_index(df, "key", edges=16).collect()
    assert sorted((r.key, r.idx) for r in got) == [(k, k) for k in range(1009)]


def test_dense_index_of_few_rows(spark):
    df = spark.createDataFrame([(5,)], "key long")
    assert [(r.key, r.idx) for r in od.dense_index(df, "key").collect()] == [(5, 0)]


def test_average_ranks(spark):
    df = spark.createDataFrame([(3,), (1,), (3,), (2,), (3,)], "v int")
    assert {r.v: r["rank"] for r in od.average_ranks(df, "v").collect()} == {1: 1.0, 2: 2.0, 3: 4.0}


def test_a_null_key_is_an_error(spark):
    df = spark.createDataFrame([(1,), (None,)], "key long")
    with pytest.raises(Exception, match="null in order column"):
        od.dense_index(df, "key").collect()


@pytest.mark.parametrize("kind,base,step", [("long", 1_700_000_000_000_000_000, 100), ("long", 1 << 60, 1), ("decimal(38,3)", 10**25, 7), ("string", 0, 1)])
def test_keys_keep_their_own_type(spark, kind, base, step):
    """Keys beyond the exact range of a double, with ties, and texts."""
    pick = random.Random(4)
    keys = [base + step * pick.randrange(300) for _ in range(900)]
    df = spark.createDataFrame([(str(k), i) for i, k in enumerate(keys)], "key string, tie long").withColumn("key", F.col("key").cast(kind))
    got = {r.tie: r.idx for r in od.dense_index(df, "key", tie="tie", edges=20).collect()}
    order = sorted(range(900), key=lambda i: (str(keys[i]) if kind == "string" else keys[i], i))
    assert got == {i: n for n, i in enumerate(order)}


def test_times_are_ordered(spark):
    df = spark.range(500).select((1_700_000_000_000_000 + (F.col("id") * 7919) % 500).alias("us"), "id")
    df = df.select(F.timestamp_micros("us").alias("key"), "us")
    assert [(r.us - 1_700_000_000_000_000, r.idx) for r in od.dense_index(df, "key", edges=16).orderBy("us").collect()] == [(k, k) for k in range(500)]


def test_buckets_do_not_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(od, "BUCKET_ROWS", 500)
    for rows in (5_000, 50_000):
        placed = od.with_order_bucket(spark.range(rows), "id")
        assert placed.groupBy(od.BUCKET).count().agg(F.max("count")).first()[0] <= 4 * 500


@pytest.mark.parametrize("group", [1, 3, 4_096])
def test_sums_on_two_levels(spark, monkeypatch, group):
    """Groups of one, of a few and of all buckets; a join by shuffle instead of a broadcast."""
    monkeypatch.setattr(od, "GROUP", group)
    monkeypatch.setattr(od, "BROADCAST_BUCKETS", 0 if group == 3 else 500_000)
    rows = skewed(900)
    got = od.running_totals(frame(spark, rows), "value", {"c": F.col("x"), "n": F.lit(1)}, tie="tie", edges=20).collect()
    total, want = 0, {}
    for n, (value, tie, x) in enumerate(sorted(rows)):
        total += x
        want[tie] = (total, n + 1)
    assert {r.tie: (r.c, r.n) for r in got} == want
    index = od.dense_index(frame(spark, rows), "value", tie="tie", edges=20).collect()
    assert {r.tie: r.idx + 1 for r in index} == {tie: n for tie, (_, n) in want.items()}


def test_a_plan_does_not_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(od, "BUCKET_ROWS", 100)
    sizes = set()
    for rows in (1_000, 10_000):
        keyed = spark.range(rows).select((F.col("id") * 7919 % 104_729).alias("key"), "id")
        plan = od.dense_index(keyed, "key", tie="id")._jdf.queryExecution().optimizedPlan().toString()
        sizes.add((len(plan.splitlines()), plan.count("Join"), plan.count("Window")))
        assert len(plan) < 5_000
    assert len(sizes) == 1


def hash_order(ids, seed):
    return sorted(ids, key=lambda i: (hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i))


@pytest.mark.parametrize("n", [0, 1, 5, 3000])
@pytest.mark.parametrize("quota", [0, 1, 700])
def test_first_by_hash(spark, n, quota):
    df = spark.createDataFrame([(i, i % 2) for i in range(n)], "idx long, level int")
    got = sp.first_by_hash(df, "idx", 9, F.lit(quota), "level").collect()
    want = {i for level in (0, 1) for i in hash_order([i for i in range(n) if i % 2 == level], 9)[:quota]}
    assert {r.idx for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("slot_rows", [1, 4])
def test_cut_slots_are_split_again(spark, monkeypatch, slot_rows):
    """Slots of one or a few rows at most: several rounds, the same rows, and no larger slot is ranked."""
    monkeypatch.setattr(sp, "SLOT_ROWS", slot_rows)
    monkeypatch.setattr(sp, "HEX_DIGITS", 1)
    df = spark.createDataFrame([(i, i % 2) for i in range(3000)], "idx long, level int")
    cut = lambda before, count: before + count <= 700
    tables = sp.slot_tables(df.withColumn("__hash", sp.shuffle_hash(9, "idx")), ["level"], cut, lambda before, count: before >= 700)
    assert len(tables) > 2 and tables[0].filter(F.col("__state") == sp.SPLIT).count() in (1, 2)
    assert all(r["__count"] <= slot_rows for t in tables for r in t.filter(F.col("__state") == sp.CUT).collect())
    got = sp.first_by_hash(df, "idx", 9, F.lit(700), "level").collect()
    want = {i for level in (0, 1) for i in hash_order([i for i in range(3000) if i % 2 == level], 9)[:700]}
    assert {r.idx for r in got} == want and len(got) == len(want)
    staged = {(r.stage, r.idx) for r in cu.random_stages(df.select("idx"), 3, 5).collect()}
    assert staged == {(place // 1000, x) for place, x in enumerate(hash_order(range(3000), 5)) if place % 1000 < 333}


@pytest.mark.parametrize("n", [2, 10, 999, 20000])
def test_random_stages(spark, n):
    df = spark.range(n).withColumnRenamed("id", "idx")
    # A row's stage is its place in the hash order divided by a third of the rows.
    size = n // 3
    want = {(place // size, x) for place, x in enumerate(hash_order(range(n), 5)) if size and place < 3 * size and place % size < int(1 / 3 * size)}
    got = cu.random_stages(df, 3, 5).collect()
    assert {(r.stage, r.idx) for r in got} == want and len(got) == len(want)


def test_the_count_table_is_bounded(spark):
    df = spark.range(100000).withColumnRenamed("id", "idx")
    slots = df.select(F.substring(sp.shuffle_hash(1, "idx"), 1, sp.HEX_DIGITS).alias("s")).distinct().count()
    assert slots == 16**sp.HEX_DIGITS
