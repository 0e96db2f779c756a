"""Whole preparations from example tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from stairwell.plans import preparation as pr
from stairwell.plans.training import score_examples
from stairwell.sources.lines import first_of_file

ANSWERS = "struct<text:array<string>,answer_start:array<int>>"


def test_questions(spark):
    rows = [("a", "Who won?", "William won in 1066.", (["William"], [0])), ("b", "Who lost?", "Nobody knows " * 20, ([], []))]
    df = spark.createDataFrame(rows, f"id string, question string, context string, answers {ANSWERS}")
    got = pr.question_features(df, max_length=20, overlap=4).orderBy("id", "window").collect()
    assert [(r.tokens[r.start_position : r.end_position + 1]) for r in got if r.id == "a"] == [["William"]]
    assert all(r.start_position == r.end_position == 0 for r in got if r.id == "b")
    assert len([r for r in got if r.id == "b"]) > 2
    assert pr.question_features(df, max_length=20, overlap=4, max_samples=1).count() == 1
    beam = pr.question_features(df, max_length=20, overlap=4, context_first=True)
    assert {r.tokens[r.cls_index] for r in beam.collect()} == {"[CLS]"} and "p_mask" in beam.columns
    assert "start_position" not in pr.question_features(df, labels=False).columns


def test_first_examples_in_file_order(spark, tmp_path):
    """Text ids that sort otherwise, several splits; the first examples, then the first windows over them."""
    rows = [(f"{(i * 37) % 50}", "who ?", f"w{i} " * (5 + i % 30)) for i in range(50)]
    (tmp_path / "x.csv").write_text("id,question,context\n" + "".join(",".join(r) + "\n" for r in rows))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "400")
    try:
        table = spark.read.option("header", True).csv(str(tmp_path / "x.csv"))
        assert table.rdd.getNumPartitions() > 3
        for n in (0, 1, 7, 20, 60):
            first = first_of_file(table, n)
            assert [(r.pos, r.id) for r in first.orderBy("pos").collect()] == [(i, r[0]) for i, r in enumerate(rows[:n])]
            all_windows = pr.question_features(first, max_length=15, overlap=2, labels=False, position="pos").select("pos", "window").collect()
            got = pr.question_features(first, max_length=15, overlap=2, labels=False, max_samples=n, position="pos").select("pos", "window").collect()
            assert sorted(map(tuple, got)) == sorted(map(tuple, all_windows))[:n]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_sentences(spark):
    df = spark.createDataFrame([(0, "a b c d", "e f", "yes"), (1, "g", "h", "no")], "idx int, sentence1 string, sentence2 string, label string")
    got = {r.idx: r for r in pr.sentence_features(df, max_length=8).collect()}
    assert got[0].tokens == ["[CLS]", "a", "b", "c", "[SEP]", "e", "f", "[SEP]"]
    assert (got[0].label, got[1].label) == (1, 0)
    single = pr.sentence_features(df.select("idx", "sentence1"), max_length=4)
    assert {r.idx: r.tokens for r in single.collect()}[0] == ["[CLS]", "a", "b", "[SEP]"]
    scored = df.withColumn("label", F.lit(0.5))
    assert pr.sentence_features(scored).first().label == 0.5


def test_tags(spark):
    df = spark.createDataFrame([("0", ["Rome", "is", "big"], ["B-LOC", "O", "O"])], "id string, tokens array<string>, ner_tags array<string>")
    row = pr.tag_features(df, piece_length=3).first()
    assert row.tokens == ["[CLS]", "Rom", "e", "is", "big", "[SEP]"]
    assert row.word_ids == [None, 0, 0, 1, 2, None] and row.labels == [-100, 0, -100, 1, 1, -100]
    assert pr.tag_features(df, piece_length=3, label_all_tokens=True).first().labels == [-100, 0, 0, 1, 1, -100]
    assert pr.tag_features(df, max_length=4).first().tokens == ["[CLS]", "Rome", "is", "[SEP]"]


def test_translation(spark):
    df = spark.createDataFrame([({"en": "a b c", "ro": "d e"},)], "translation map<string,string>")
    row = pr.translation_features(df, "en_XX", "ro_RO", "go: ", 3, 1).first()
    assert (row.tokens, row.labels) == (["go:", "a", "b"], ["d"])


def test_transport_after_scaling(spark):
    """Scaling by the extremes of a batch makes scores independent of a common shift and factor."""
    rows = [(i, layer, k, [float(i + k), float(layer)]) for i in range(4) for layer in (0, -1) for k in range(3)]
    df = spark.createDataFrame(rows, "idx long, layer int, token_pos int, vector array<double>")
    moved = df.withColumn("vector", F.transform("vector", lambda v: v * 3 + 7))
    scores = lambda d: {r.idx: round(r.difficulty, 9) for r in score_examples(d, norm="line", batch_size=2).collect()}
    assert scores(df) == scores(moved) and len(scores(df)) == 4
