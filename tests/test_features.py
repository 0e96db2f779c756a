"""Windows, labels, padding and alignment against step-by-step versions."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from stairwell.functions.text import token_offsets
from stairwell.operators import features as ft, rows as rw

CONTEXT = "In 1066 the Normans, led by William, crossed the sea and won at Hastings. Later they built many castles."


def examples(spark, rows):
    """rows: (id, question words, context, answer start, answer text)."""
    df = spark.createDataFrame(rows, "id string, question array<string>, context string, begin int, answer string")
    return df.withColumn("spans", token_offsets(F.col("context")))


def windows(df, max_length=16, overlap=3, context_first=False):
    return ft.window_features(df, ["id"], "question", "spans", max_length, overlap, context_first, ["begin", "answer"])


def brute_windows(tokens, budget, overlap):
    out, first = [], 0
    while True:
        out.append(tokens[first : first + budget])
        if first + budget >= len(tokens):
            return out
        first += budget - overlap


@pytest.mark.parametrize("max_length,overlap", [(16, 3), (40, 0), (9, 2), (100, 20)])
def test_windows_cover_the_context(spark, max_length, overlap):
    df = examples(spark, [("a", ["who", "led"], CONTEXT, 0, "In"), ("b", [], "Hi", None, None)])
    got = windows(df, max_length, overlap).orderBy("id", "window").collect()
    for row in got:
        assert len(row.tokens) == len(row.roles) == len(row.offset_mapping) <= max_length
        assert row.tokens[row.cls_index] == "[CLS]"
    for key, question in (("a", 2), ("b", 0)):
        text = CONTEXT if key == "a" else "Hi"
        import re

        tokens = re.findall(r"\w+|[^\w\s]", text)
        mine = [r for r in got if r.id == key]
        want = brute_windows(tokens, max_length - question - 3, overlap)
        assert [r.tokens[r.context_at : r.context_at + r.context_size] for r in mine] == want
        for r in mine:
            for k, place in enumerate(r.offset_mapping):
                assert (place is not None) == (r.roles[k] == ft.CONTEXT)
                if place is not None:
                    assert text[place["start"] : place["end"]] == r.tokens[k]


def test_a_question_without_room_is_an_error(spark):
    df = examples(spark, [("a", ["w"] * 12, CONTEXT, 0, "In")])
    with pytest.raises(Exception, match="no room"):
        windows(df, 16, 3).collect()


def brute_label(row):
    """Walk from both ends of the window, offsets of other tokens being zero."""
    offsets = [(o["start"], o["end"]) if o is not None else (0, 0) for o in row.offset_mapping]
    if row.begin is None:
        return row.cls_index, row.cls_index
    begin, end = row.begin, row.begin + len(row.answer)
    places = [k for k, role in enumerate(row.roles) if role == ft.CONTEXT]
    first, last = places[0], places[-1]
    if offsets[first][0] > begin or offsets[last][1] < end:
        return row.cls_index, row.cls_index
    k = first
    while k < len(offsets) and offsets[k][0] <= begin:
        k += 1
    m = last
    while offsets[m][1] >= end:
        m -= 1
    return k - 1, m + 1


@pytest.mark.parametrize("context_first", [False, True])
def test_label_spans(spark, context_first):
    answers = ["In", "1066", "Normans, led by William", "William", "Hastings", "many castles.", "castles.", "."]
    rows = [(f"q{i}", ["who", "won"], CONTEXT, CONTEXT.rindex(a), a) for i, a in enumerate(answers)]
    rows.append(("none", ["who"], CONTEXT, None, None))
    features = windows(examples(spark, rows), context_first=context_first)
    got = ft.answer_mask(ft.label_spans(features, "begin", "answer")).collect()
    assert any(r.is_impossible == 0.0 for r in got) and any(r.is_impossible == 1.0 for r in got)
    for r in got:
        assert (r.start_position, r.end_position) == brute_label(r)
        want = [0.0 if role == ft.CONTEXT or k == r.cls_index else 1.0 for k, role in enumerate(r.roles)]
        assert r.p_mask == want


@pytest.mark.parametrize("question,position", [("one two three four five", 6), ("one two", 8), ("a b c d e", 8)])
def test_an_answer_on_the_last_context_token(spark, question, position):
    """Context first: "a b c d [SEP] question [SEP] [CLS]", answer "d" at character 6. The scan passes the separator and
    question tokens that start at or before character 6, and stops before the first that starts later."""
    df = spark.createDataFrame([("e", question, "a b c d", 6, "d")], "id string, question string, context string, begin int, answer string")
    asked = token_offsets(F.col("question"))
    df = df.select("*", token_offsets(F.col("context")).alias("spans"), F.transform(asked, lambda t: t["tok"]).alias("q"), F.transform(asked, lambda t: t["start"]).alias("starts"))
    got = ft.window_features(df, ["id"], "q", "spans", 30, 4, True, ["begin", "answer"], question_starts="starts")
    row = ft.label_spans(got, "begin", "answer").first()
    assert (row.start_position, row.end_position) == (min(position, len(row.tokens) - 1), 3)
    offsets = [(0, 1), (2, 3), (4, 5), (6, 7), (0, 0), *[(m.start(), m.end()) for m in re.finditer(r"\w+", question)], (0, 0), (0, 0)]
    k = 0
    while k < len(offsets) and offsets[k][0] <= 6:
        k += 1
    assert row.start_position == k - 1


def test_empty_context(spark):
    got = ft.label_spans(windows(examples(spark, [("e", ["who"], "", 0, "")])), "begin", "answer").collect()
    assert [(r.context_size, r.start_position, r.is_impossible) for r in got] == [(0, 0, 1.0)]


def test_truncate_pair(spark):
    cases = [(a, b) for a in range(0, 12) for b in range(0, 12)]
    df = spark.createDataFrame(cases, "a int, b int")
    for room in (4, 5, 9):
        first, second = ft.truncate_pair(F.col("a"), F.col("b"), room)
        for r in df.select("a", "b", first.alias("x"), second.alias("y")).collect():
            a, b = r.a, r.b
            while a + b > room:
                if a > b:
                    a -= 1
                else:
                    b -= 1
            assert (r.x, r.y) == (a, b)


def test_batch_pad(spark):
    df = spark.createDataFrame([(i, list(range(i + 1))) for i in range(10)], "idx long, v array<int>")
    got = {r.idx: r for r in ft.batch_pad(df, "idx", "v", -1, batch_size=4, multiple=8).collect()}
    assert {r.padded_length for r in got.values()} == {8, 16}
    assert got[9].v == [*range(10), *[-1] * 6] and got[0].v == [0] + [-1] * 7


def test_labels(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("-1",)], "label string")
    vocabulary = ft.label_vocabulary(df, "label", unknown=-1)
    got = {r.label: r.label_id for r in ft.encode_labels(df, vocabulary, "label").collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "-1": -1}
    names = spark.createDataFrame([("neutral", 0), ("yes", 1)], "label string, label_id int")
    model = spark.createDataFrame([("YES", 0), ("Neutral", 1)], "name string, model_id int")
    assert {r.label: r.label_id for r in ft.model_vocabulary(names, model).collect()} == {"yes": 0, "neutral": 1}
    # one class without a partner, on either side: all keep their own ids
    other = spark.createDataFrame([("YES", 7), ("no", 5)], "name string, model_id int")
    more = model.unionByName(spark.createDataFrame([("no", 5)], "name string, model_id int"))
    for wrong in (other, more, model.limit(1)):
        assert {r.label: r.label_id for r in ft.model_vocabulary(names, wrong).collect()} == {"neutral": 0, "yes": 1}


def test_align_tags(spark):
    df = spark.createDataFrame([([7, 8], [None, 0, 0, 1, 1, 1, None])], "t array<int>, w array<int>")
    first, every = df.select(
        ft.align_tags(F.col("t"), F.col("w")).alias("f"), ft.align_tags(F.col("t"), F.col("w"), True).alias("a")
    ).first()
    assert first == [-100, 7, -100, 8, -100, -100, -100]
    assert every == [-100, 7, 7, 8, 8, 8, -100]


def test_masks(spark):
    df = spark.createDataFrame([([5, 0, 6, 0, 0], [1, 0, 0, 1, 1], [0, -100, 1, 0, -100], ["A", "B"])], "v array<int>, p array<int>, g array<int>, n array<string>")
    row = df.select(
        ft.mask_padding(F.col("v"), 0).alias("m"),
        ft.unmask_padding(ft.mask_padding(F.col("v"), 0), 0).alias("u"),
        ft.non_pad_length(F.col("v"), 0).alias("l"),
        ft.drop_ignored(F.col("p"), F.col("g"), F.col("n")).alias("d"),
    ).first()
    assert row.m == [5, -100, 6, -100, -100] and row.u == [5, 0, 6, 0, 0] and row.l == 2
    assert [tuple(x) for x in row.d] == [("B", "A"), ("A", "B"), ("B", "A")]


def test_roles(spark):
    qa = spark.createDataFrame([("q", "c", "a")], "context string, x string, answers string")
    assert rw.qa_roles(qa) == ("context", "context", "answers")
    pair = spark.createDataFrame([("a", "b", 1.0)], "u string, v string, label double")
    assert rw.pair_roles(pair) == ("u", "v") and rw.is_regression(pair)
    assert rw.pair_roles(pair.select("u", "label")) == ("u", None)
    named = pair.withColumn("sentence2", F.lit("")).withColumn("sentence1", F.lit(""))
    assert rw.pair_roles(named) == ("sentence1", "sentence2")
    assert rw.pair_roles(pair, "mnli") == ("premise", "hypothesis")
    tags = spark.createDataFrame([("t", "n")], "words string, ner_tags string")
    assert rw.tag_roles(tags) == ("words", "ner_tags")
    assert rw.tag_roles(tags, "pos") == ("words", "ner_tags")
    assert rw.tag_roles(tags, tokens="w", tags="g") == ("w", "g")


def test_selection(spark):
    data = spark.createDataFrame([(i, f"r{i}") for i in range(5)], "idx long, v string")
    wanted = spark.createDataFrame([(0, 3), (1, 1), (2, 3)], "pos long, idx long")
    got = rw.select_by_index(data, wanted).orderBy("pos").collect()
    assert [r.v for r in got] == ["r3", "r1", "r3"]
    assert [r.idx for r in rw.head(data, 2, "idx").collect()] == [0, 1]
    assert rw.head(data, None, "idx").count() == 5
    assert rw.peek(data, "idx", 1).collect() == rw.peek(data.repartition(3), "idx", 1).collect()


def test_map_batches(spark):
    out = rw.map_batches(spark.range(10), lambda b: b.assign(id=b["id"] * 2), "id long")
    assert sorted(r.id for r in out.collect()) == list(range(0, 20, 2))
