"""Every stage of the pipeline against a brute-force version, stage by stage on what the one before kept."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest
from test_lsh_forest import brute as brute_classes
from test_packing import check
from test_suffix_repeats import brute as brute_repeats

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from stairwell.llm import queries, semantic_votes  # noqa: E402
from stairwell.llm.common import stored  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark):
    """What each stage returned."""
    docs, out = spark.read.parquet(f"{SMALL}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SMALL), name)
        out.append(docs)
    return out


def rows(df) -> dict:
    return {r.doc_id: r for r in df.collect()}


def test_rules_and_classifier(spark, kept):
    documents = rows(spark.read.parquet(f"{SMALL}/documents.parquet"))
    verdict = rows(queries.op4_quality_rules(spark, SMALL))
    first = rows(kept[0])
    assert first == {i: r for i, r in documents.items() if verdict[i].kept}
    model = semantic_votes.fit(spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet"))
    want = {i: r for i, r in first.items() if model.score([r.text])[0] >= 0.7}
    assert rows(kept[1]) == want and 0 < len(want) < len(first) <= len(documents)


def words5(text: str) -> set:
    words = text.encode().lower().split()
    return {tuple(words)} if 0 < len(words) < 5 else {tuple(words[k : k + 5]) for k in range(len(words) - 4)}


def test_near_duplicates(kept):
    before, after = rows(kept[1]), rows(kept[2])
    sets = {i: words5(r.text) for i, r in before.items()}
    group = {i: i for i in sets}
    for _ in range(len(sets)):
        for a in sets:
            for b in sets:
                if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    group[a] = min(group[a], group[b])
        if all(group[group[a]] == group[a] for a in sets):
            break
    assert after == {i: r for i, r in before.items() if group[i] == i}


def test_rows_of_one_id(spark):
    """Of an id's rows the one with the smallest text stays; null ids stay; a copy of another id goes with all rows of its id."""
    long = "one two three four five six seven eight nine ten"
    rows = [(1, "zebra", "en", "b", 5), (1, "apple pie", "en", "a", 9), (1, "apple pie", "de", "a", 9), (2, long, "en", "a", 1), (3, long, "en", "a", 1), (3, "other", "en", "a", 1), (None, "x", None, None, None), (None, "x", None, None, None), (4, None, "en", "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_duplicates(spark, docs, SMALL).collect()
    want = [(1, "apple pie", "de", "a", 9), (2, long, "en", "a", 1), (None, "x", None, None, None), (None, "x", None, None, None), (4, None, "en", "a", 0)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_repeats(kept):
    before, after = rows(kept[2]), rows(kept[3])
    order = sorted(before)
    for i, (left, removed, _) in zip(order, brute_repeats([before[i].text.encode() for i in order], 100), strict=True):
        assert after[i].text == (left.decode("utf-8", "ignore") if removed else before[i].text)
        assert after[i].n_chars == (len(after[i].text) if removed else before[i].n_chars)


def test_repeats_take_one_worker_a_task(spark):
    """Characters that a cut splits go where the text is cut, in one Python step, not in a second one behind it."""
    shared = "".join(chr(0x100 + k) for k in range(60))  # two bytes a character
    first, second = "\u00c1" + shared, "\u0081" + shared + "!"  # the characters before differ in their first byte only
    docs = [(1, first, "en", "a", 61), (2, second, "en", "a", 62), (3, None, None, None, None)]
    got = corpus_pipeline.repeats(spark, spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), SMALL)
    want = rows(got)
    assert (want[1].text, want[2].text, want[2].n_chars, want[3].text) == (first, "!", 1, None)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "ArrowEvalPython" not in plan


def test_packing_and_run(spark, kept):
    got = kept[4].collect()
    check(got, 2048)
    assert {r.doc_id for r in got} == set(rows(kept[3]))
    whole = corpus_pipeline.run(spark, SMALL).collect()
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, whole)) == sorted(map(key, got))


def test_odd_documents(spark):
    """Nulls, empty and repeated rows, extra columns and no rows pass through every stage."""
    good = "Plain words run on here, quietly and well, one after the other, until this short paragraph ends with more than twenty of them in it."
    data = [(1, good, "en", "a", 9, 5), (1, good, "en", "a", 9, 5), (2, None, None, None, None, 5), (3, "", "en", "a", 0, 5), (None, good + " No id.", None, "b", 1, 5), (4, good + " Two.", "xx", "b", 1, 5)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, score int")
    for df in (docs,):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            df = stored(stage(spark, df, SMALL), name)
            assert df.columns == corpus_pipeline.COLUMNS
        df.count()
        packed = corpus_pipeline.STAGES[-1][1](spark, df, SMALL).collect()
        assert len({r.doc_id for r in packed}) == df.select("doc_id").distinct().count()
    for name, stage in corpus_pipeline.STAGES[:2]:
        assert stage(spark, docs.limit(0), SMALL).count() == 0, name


def test_classes_helper_is_exact():
    assert brute_classes([(1, "a b c d"), (2, "A B c d"), (3, "")]) == {1: 1, 2: 1, 3: 3}
