"""The registered queries against their SQL, and the form of the native one."""

from __future__ import annotations

import time

import pytest
from compare import connect, mismatch

import __spark_entry__ as entry
from stairwell.llm import queries

SMALL = "/root/testdata/sf0.001"
ODD = "doc_id long, text string, lang string"


def test_all_are_registered():
    assert {*queries.QUERIES, "pipeline"} <= set(entry.queries())
    assert set(queries.ORACLE) <= set(queries.QUERIES) and [int(n[2:].split("_")[0]) for n in queries.QUERIES] == list(range(1, 14))


@pytest.mark.parametrize("name", list(queries.ORACLE))
def test_like_sql(spark, name):
    assert mismatch(spark, SMALL, connect(SMALL), queries.QUERIES[name], queries.ORACLE[name]) is None


def test_rules_stay_in_the_engine(spark):
    plan = queries.op4_quality_rules(spark, SMALL)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_counts_of_odd_texts(spark):
    eight = "a b c d e f g h"
    rows = [(None, None, None), (1, "", "en"), (2, " \n\t ", "en"), (3, eight, "en"), (4, f"{eight} {eight}", "en"), (5, "x " * 12, None), (6, "é|*\n\n é|*\na\x1cb", "de"), (6, "l\nl\nl", "de"), (7, "w " * 40_000, "en")]
    docs = spark.createDataFrame([(*r, 5, True) for r in rows], f"{ODD}, n_words int, kept boolean")
    got = queries.quality_rules.add_base_counts(queries.quality_rules.with_stratum(docs))
    shown = sorted(map(tuple, got.select(*queries.quality_rules.COUNTS, "base_failed").collect()))
    assert shown == sorted(
        [(0, 0, 0, 0, 0, True)] * 3
        + [(8, 8, 0, 0, 0, True), (16, 16, 0, 0, 16, True), (12, 12, 0, 0, 12, True), (3, 9, 4, 0, 0, True), (3, 3, 0, 2, 0, True), (40_000, 40_000, 0, 0, 40_000, True)]
    )
    labels = spark.createDataFrame([(3, 1), (None, 1), (4, None)], "doc_id long, quality int")
    cutoffs = queries.quality_rules.choose_cutoffs(got, labels)
    assert cutoffs.count() == 0
    assert queries.quality_rules.judge(got, cutoffs).where("kept").count() == 0
    assert queries.quality_rules.judge(got.limit(0), cutoffs).collect() == []


def test_counts_under_filters(spark):
    """Filters over the counts and the verdict do not make them anew per element: seconds for 40,000 words, not hours."""
    rules = queries.quality_rules
    docs = spark.createDataFrame([(1, " ".join(f"w{k % 30_000}" for k in range(40_000)), "en"), (2, "a b", "en")], ODD)
    counts = rules.add_base_counts(rules.with_stratum(docs))
    none = spark.createDataFrame([("en", "symbols", 2)], "stratum string, rule string, cutoff int")
    begin = time.time()
    assert [r.doc_id for r in counts.where("base_failed").collect()] == [1, 2]
    assert [r.n_repeat_words for r in counts.where("n_repeat_words > 10 and not n_words < 20").collect()] == [20_000]
    assert rules.judge(counts, none).where("kept").collect() == []
    assert time.time() - begin < 30


def test_cutoffs_keep_their_promise(spark):
    """Good documents whose measure is known: the strictest cutoff with a binomial tail small enough is chosen."""
    from math import comb

    rules = queries.quality_rules
    n = 3000
    rows = [(i, "en", 100, 500, 9 if i < 12 else 0, 0, 0, False) for i in range(n)]
    counts = spark.createDataFrame(rows, "doc_id long, stratum string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean")
    labels = counts.selectExpr("doc_id", "1 AS quality")
    got = {r.rule: r.cutoff for r in rules.choose_cutoffs(counts, labels, risk=0.01, delta=0.05).collect()}
    tests = sum(len(c) for _, c, _ in rules.RULES.values())
    tail = lambda k: sum(comb(n, i) * 0.01**i * 0.99 ** (n - i) for i in range(k + 1))
    strict = next(j for j, c in enumerate(rules.RULES["symbols"][1]) if tail(12 if 9 > c else 0) <= 0.05 / tests)
    assert got["symbols"] == strict
    assert got["dup_lines"] == got["repeats"] == 0
