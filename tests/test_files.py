"""Readers and writers on small files."""

from __future__ import annotations

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from stairwell import evaluate
from stairwell.sinks import writers as wr
from stairwell.sources import cache, conll, json_splits, maps, pairs, qa, translation

DOCUMENT = {
    "version": "v2.0",
    "data": [
        {
            "title": "T",
            "paragraphs": [
                {
                    "context": "Rome is old.",
                    "qas": [
                        {"id": "a", "question": "What is old?", "is_impossible": False, "answers": [{"text": "Rome", "answer_start": 0}, {"text": "the Rome", "answer_start": 0}]},
                        {"id": "b", "question": "What is new?", "is_impossible": True, "answers": [], "plausible_answers": [{"text": "Rome", "answer_start": 0}]},
                    ],
                },
                {"context": "x", "qas": [{"id": "c", "question": "?", "answers": [{"text": "x", "answer_start": 0}]}]},
            ],
        }
    ],
}


@pytest.fixture
def nested(tmp_path):
    path = tmp_path / "dev.json"
    path.write_text(json.dumps(DOCUMENT, indent=1))
    return str(path)


def test_read_squad(spark, nested):
    rows = qa.read_squad(spark, nested).orderBy("article", "paragraph", "place").collect()
    assert [(r.id, r.paragraph, r.place, r.is_impossible) for r in rows] == [("a", 0, 0, False), ("b", 0, 1, True), ("c", 1, 0, False)]
    assert rows[0].answers[1].text == "the Rome" and rows[2].title == "T"
    view = qa.qa_view(qa.read_squad(spark, nested))
    assert {r.id: r.answers for r in view.collect()} == {"a": ["Rome", "the Rome"], "c": ["x"]}
    said = spark.createDataFrame([("a", "Paris")], "id string, prediction_text string")
    row = qa.qa_lookup(view, said).first()
    assert (row.first_answer, row.prediction) == ("Rome", "Paris")


def test_read_flat(spark, tmp_path):
    row = {"id": "1", "question": "q", "context": "c d", "answers": {"text": ["d"], "answer_start": [2]}}
    (tmp_path / "f.json").write_text(json.dumps({"data": [row, {**row, "id": "2"}]}))
    got = qa.read_flat_qa(spark, str(tmp_path / "f.json")).collect()
    assert [r.id for r in got] == ["1", "2"] and got[0].answers.answer_start == [2]
    (tmp_path / "f.csv").write_text('id,question,context,answers\n1,q,"c\nd","{""text"": [""d""], ""answer_start"": [2]}"\n')
    got = qa.read_flat_qa(spark, str(tmp_path / "f.csv"), "csv").collect()
    assert [(r.context, r.answers.text) for r in got] == [("c\nd", ["d"])]
    with pytest.raises(ValueError):
        qa.read_flat_qa(spark, "x", "xml")


def test_read_pairs(spark, tmp_path):
    for name in ("train", "test"):
        (tmp_path / f"{name}.csv").write_text('sentence1,sentence2,label\n"a, b",c,0.5\n')
    (tmp_path / "test.json").write_text('{"sentence1": "a", "label": 1}\n')
    files = {"train": str(tmp_path / "train.csv"), "test": str(tmp_path / "test.csv")}
    tables = pairs.read_pairs(spark, files, "double")
    assert tables["train"].first().sentence1 == "a, b" and dict(tables["test"].dtypes)["label"] == "double"
    with pytest.raises(ValueError):
        pairs.read_pairs(spark, {"train": files["train"], "test": str(tmp_path / "test.json")})
    with pytest.raises(ValueError):
        pairs.read_pairs(spark, {"train": "a.txt"})
    got = pairs.read_pairs(spark, {"train": str(tmp_path / "test.json")}, schema="sentence1 string, label int")
    assert got["train"].first().label == 1


def test_cross_language(spark, tmp_path):
    df = spark.createDataFrame(
        [(s, lang, f"{s}-{lang}") for s in ("train", "validation", "test") for lang in ("en", "de")],
        "split string, language string, text string",
    )
    df.write.partitionBy("split", "language").json(str(tmp_path / "x"))
    read = lambda *a: {r.text for r in pairs.read_cross_language(spark, str(tmp_path / "x"), "text string", *a).collect()}
    assert read("de", "en") == {"train-en", "validation-de", "test-de"}
    assert read("de") == {"train-de", "validation-de", "test-de"}


def conll_text(n):
    blocks = ["-DOCSTART- -X- -X- O\n"]
    for i in range(n):
        lines = [f"w{i}.{k} NN B-NP {'O' if k else 'B-PER'}" for k in range(i % 4 + 1)]
        blocks.append("\n".join(lines) + "\n" + ("\n" if i % 5 == 0 else ""))
        if i % 7 == 0:
            blocks.append("-DOCSTART- -X- -X- O\n")
    return "\n".join(blocks)


def walk_sentences(text):
    """Blocks of lines between separators, by one regular expression."""
    blocks = re.split(r"(?m)^(?:-DOCSTART-.*)?$\n?", text)
    return [[row.split(" ") for row in b.strip("\n").split("\n")] for b in blocks if b.strip("\n")]


@pytest.mark.parametrize("split", [128 * 1024 * 1024, 500])
@pytest.mark.parametrize("ending", ["\n", "\r\n"])
def test_read_conll(spark, tmp_path, split, ending):
    """The same sentences and ids however the file is cut."""
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        texts = {"a.txt": conll_text(200), "b.txt": conll_text(3)}
        for name, text in texts.items():
            (tmp_path / name).write_bytes(text.replace("\n", ending).encode())
        rows = conll.read_conll(spark, str(tmp_path)).collect()
        for name, text in texts.items():
            mine = sorted((r for r in rows if r.file.endswith(name)), key=lambda r: int(r.id))
            want = walk_sentences(text)
            assert [int(r.id) for r in mine] == list(range(len(want)))
            assert [r.tokens for r in mine] == [[x[0] for x in s] for s in want]
            assert [r.ner_tags for r in mine] == [[x[3] for x in s] for s in want]
            assert [r.pos_tags for r in mine] == [[x[1] for x in s] for s in want]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_declared_classes(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(conll_text(40).replace("\n", "\r\n").encode())
    named, ids = (conll.read_conll(spark, str(tmp_path), ids=x).orderBy(F.col("id").cast("int")).collect() for x in (False, True))
    for a, b in zip(named, ids, strict=True):
        for column, names in conll.CLASSES.items():
            assert [names[k] for k in b[column]] == a[column]
    assert [len(names) for names in conll.CLASSES.values()] == [47, 23, 9]
    (tmp_path / "a.txt").write_text("w NN B-NP B-XYZ\n")
    with pytest.raises(Exception, match="no declared class: B-XYZ"):
        conll.read_conll(spark, str(tmp_path), ids=True).collect()


def test_files_with_carriage_returns_are_split(spark, tmp_path, small_splits):
    (tmp_path / "a.txt").write_bytes(conll_text(200).replace("\n", "\r\n").encode())
    blocks = conll.read_records(spark, str(tmp_path), "\r\n\r\n")
    assert blocks.select("__split").distinct().count() > 5 and blocks.count() > 50


def test_translation(spark, tmp_path):
    (tmp_path / "t.json").write_text('{"translation": {"en": "a", "ro": "b"}}\n')
    row = translation.read_translation(spark, str(tmp_path / "t.json"), "en_XX", "ro_RO", "go: ").first()
    assert tuple(row) == ("go: a", "b")


@pytest.mark.parametrize("split", [128 * 1024 * 1024, 300])
def test_maps(spark, tmp_path, split):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        said = {f"q{i}": f'text {i}, "x": {{y}},' for i in range(100)}
        (tmp_path / "p.json").write_text(json.dumps(said, indent=4))
        (tmp_path / "flat.json").write_text(json.dumps(said))
        whole = maps.read_predictions(spark, str(tmp_path / "flat.json")).collect()
        lines = maps.read_predictions(spark, str(tmp_path / "p.json")).collect()
        want = [(i, q, t) for i, (q, t) in enumerate(said.items())]
        assert sorted(map(tuple, whole)) == sorted(map(tuple, lines)) == sorted(want)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("text", ['{\n"a":"1", "b":"2",\n"c":"3"\n}', '{"a":"1"\n,"b":"2"\n,"c":"3"}', '{"a":"0","b":"2","a":"1","c":"3"}'])
def test_maps_of_any_layout(spark, tmp_path, text):
    """All entries of a line, commas first, and repeated keys, of which the last value counts."""
    (tmp_path / "p.json").write_text(text)
    rows = maps.read_predictions(spark, str(tmp_path / "p.json")).collect()
    assert [r.qid for r in sorted(rows, key=lambda r: r.pos)] == ["a", "b", "c"]
    assert {r.qid: r.prediction for r in rows} == {"a": "1", "b": "2", "c": "3"}


def test_an_unreadable_map_is_an_error(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"a": "1", "b": ')
    with pytest.raises(Exception, match="(?i)malformed"):
        maps.read_predictions(spark, str(tmp_path / "p.json")).collect()


@pytest.fixture
def small_splits(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def nasty(rng, size=40):
    return "".join(rng.choice(['"', "\\", ",", "{", "}", "[", "]", ":", "\n", "é", "a", " "]) for _ in range(rng.randint(0, size)))


@pytest.mark.parametrize("indent", [None, 1])
def test_a_map_in_splits_equals_the_whole(spark, tmp_path, small_splits, indent):
    """Values full of quotes, escapes, commas and brackets, some longer than several splits; keys too."""
    rng = random.Random(3)
    said = {f"{nasty(rng)}{i}": nasty(rng, 3000 if i % 40 == 7 else 40) for i in range(300)}
    (tmp_path / "p.json").write_text(json.dumps(said, indent=indent, ensure_ascii=False))
    split = maps.read_predictions(spark, str(tmp_path / "p.json"))
    whole = maps.parse_map(spark.read.text(str(tmp_path / "p.json"), wholetext=True), "value", "prediction")
    assert json_splits._states(json_splits._pieces(spark, str(tmp_path / "p.json"))).count() > 20
    want = [(i, k, v) for i, (k, v) in enumerate(said.items())]
    assert sorted(map(tuple, split.collect())) == sorted(map(tuple, whole.collect())) == sorted(want)


def test_a_document_in_splits_equals_the_whole(spark, tmp_path, small_splits):
    rng = random.Random(4)
    paragraph = lambda k: {"context": nasty(rng, 900), "qas": [{"id": f"{k}-{j}", "question": nasty(rng), "answers": [{"text": nasty(rng), "answer_start": j}]} for j in range(k % 3)]}
    data = [{"title": nasty(rng), "paragraphs": [paragraph(k) for k in range(i % 4)]} for i in range(30)]
    document = {"list": [[1, "]"], {"data": [2]}], "object": {"a": [nasty(rng, 2000)], "b": {"data": []}}, "data": data, "after": ["x", nasty(rng, 900)]}
    (tmp_path / "d.json").write_text(json.dumps(document, ensure_ascii=False))
    got = qa.read_squad(spark, str(tmp_path / "d.json")).orderBy("article", "paragraph", "place").collect()
    want = [(i, j, k, a["title"], p["context"], q["question"], q["id"]) for i, a in enumerate(data) for j, p in enumerate(a["paragraphs"]) for k, q in enumerate(p["qas"])]
    assert [tuple(r)[:7] for r in got] == want and got[0].answers[0].answer_start == 0
    flat = {"data": [{"id": str(i), "question": nasty(rng), "context": nasty(rng, 1200), "answers": {"text": [nasty(rng)], "answer_start": [i]}} for i in range(60)]}
    (tmp_path / "f.json").write_text(json.dumps(flat))
    rows = qa.read_flat_qa(spark, str(tmp_path / "f.json"), position="pos").orderBy("pos").collect()
    assert [(r.pos, r.id, r.context) for r in rows] == [(i, x["id"], x["context"]) for i, x in enumerate(flat["data"])]


@pytest.mark.parametrize(
    "text", ['{"a": "1", "b": ', '{"a": "1",, "b": "2"}', '{"a": "1", }', '{"a": "1"]', '["a"]', 'x {"a": "1"}', '{"a": "1"}}', '{"a": "1" "b": "2"}', '{"a" "1"}', '{"a": "1}', '{"a": "1\\,2"}']
)
def test_bad_objects_are_errors(spark, tmp_path, text):
    (tmp_path / "p.json").write_text(text)
    with pytest.raises(Exception, match="(?i)malformed"):
        maps.read_predictions(spark, str(tmp_path / "p.json")).collect()


def test_objects_without_entries(spark, tmp_path):
    for k, text in enumerate(["{}", " {\n} ", ""]):
        (tmp_path / f"{k}.json").write_text(text)
        assert maps.read_predictions(spark, str(tmp_path / f"{k}.json")).collect() == []
    (tmp_path / "d.json").write_text('{"version": "x", "data": []}')
    assert qa.read_squad(spark, str(tmp_path / "d.json")).collect() == []


def test_positions_follow_the_file(spark, tmp_path, small_splits):
    """JSON lines in many splits, CSV with line breaks in its fields, several files in order of their paths."""
    rows = [{"sentence1": f"s{i * 7919 % 1000}", "label": i % 3} for i in range(400)]
    (tmp_path / "train.json").write_text("".join(json.dumps(r) + "\n" for r in rows))
    got = pairs.read_pairs(spark, {"train": str(tmp_path / "train.json")}, schema="sentence1 string, label int", position="pos")["train"]
    assert got.rdd.getNumPartitions() > 4
    assert [(r.pos, r.sentence1) for r in got.orderBy("pos").collect()] == [(i, r["sentence1"]) for i, r in enumerate(rows)]
    (tmp_path / "csv").mkdir()
    for part in (0, 1):
        body = "".join(f'{part}-{i},"q,\n{i}",c,"{{""text"": [""d""], ""answer_start"": [{i}]}}"\n' for i in range(90))
        (tmp_path / "csv" / f"{part}.csv").write_text("id,question,context,answers\n" + body)
    got = qa.read_flat_qa(spark, str(tmp_path / "csv"), "csv", position="pos").orderBy("pos").collect()
    assert [(r.pos, r.id, r.question, r.answers.answer_start) for r in got] == [(90 * p + i, f"{p}-{i}", f"q,\n{i}", [i]) for p in (0, 1) for i in range(90)]


def test_metric_dictionary_round_trip(spark, tmp_path):
    said = {"exact": 50.0, "f1": 62.5, "HasAns_total": 3.0}
    wr.write_metrics(spark.createDataFrame(list(said.items()), "key string, value double"), str(tmp_path / "m"))
    assert json.loads(text_of(tmp_path / "m")) == said
    assert {r.key: r.value for r in maps.read_metrics(spark, str(tmp_path / "m")).collect()} == said


def test_metric_map(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"f1": 2.5, "total": 17}')
    assert {r.key: r.value for r in maps.read_metrics(spark, str(tmp_path / "m.json")).collect()} == {"f1": 2.5, "total": 17.0}


def test_feature_cache(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(len(calls))

    read = lambda length, **k: cache.cached_features(spark, str(tmp_path), "train", "models/base", length, build, **k).count()
    assert [read(384), read(384), read(128), read(384, overwrite=True), read(384)] == [1, 1, 2, 3, 3]


def text_of(path):
    return "".join(p.read_text() for p in sorted(path.glob("part-*")))


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.12345, ["O", "B-X"], " b\n"), (0, 2.0, ["O"], "a ")], "i int, v double, tags array<string>, text string")
    wr.write_test_results(df.coalesce(1), str(tmp_path / "r"), "i", F.col("v"), regression=True)
    assert text_of(tmp_path / "r").splitlines()[:2] == ["index\tprediction", "0\t2.000"]
    assert "1\t0.123" in text_of(tmp_path / "r")
    many = spark.range(1000).select((999 - F.col("id")).alias("i"), F.lit("a\tb").alias("v")).repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    wr.write_test_results(many, str(tmp_path / "many"), "i", F.col("v"))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    shown = text_of(tmp_path / "many").splitlines()
    assert len(list((tmp_path / "many").glob("part-*"))) > 1 and shown == ["index\tprediction", *[f'{i}\t"a\tb"' for i in range(1000)]]
    wr.write_tag_lines(df, str(tmp_path / "t"), "tags", "i")
    assert text_of(tmp_path / "t") == "O\nO B-X\n"
    wr.write_generated(df, str(tmp_path / "g"), "text", "i")
    assert text_of(tmp_path / "g") == "a\nb\n"
    metrics = wr.with_samples(spark.createDataFrame([(0.5,)], "accuracy double"), df, "eval", 1)
    wr.write_metrics(metrics, str(tmp_path / "m"))
    assert json.loads(text_of(tmp_path / "m")) == {"accuracy": 0.5, "eval_samples": 1}
    said = df.select(F.col("i").alias("id"), F.col("text").alias("prediction_text"))
    wr.write_answers(str(tmp_path / "o"), said, said, said, prefix="eval")
    wr.write_answers(str(tmp_path / "o"), said, said)
    names = {p.name for p in (tmp_path / "o").iterdir()}
    assert names == {"eval_predictions.json", "eval_nbest_predictions.json", "eval_null_odds.json", "predictions.json", "nbest_predictions.json"}


def test_bucketed_tables_join_without_a_shuffle(spark, tmp_path):
    left = spark.range(100).withColumnRenamed("id", "k")
    spark.sql(f"CREATE DATABASE IF NOT EXISTS bucketed LOCATION '{tmp_path}/db'")
    for name in ("bucketed.a", "bucketed.b"):
        wr.write_bucketed(left.withColumn("v", F.col("k") * 2), name, ["k"], 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = spark.table("bucketed.a").join(spark.table("bucketed.b"), "k")
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString() and joined.count() == 100
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP DATABASE bucketed CASCADE")


def test_command_line(spark, nested, tmp_path, capsys):
    (tmp_path / "p.json").write_text(json.dumps({"a": "rome", "b": "Rome"}, indent=4))
    (tmp_path / "n.json").write_text(json.dumps({"a": 0.1, "b": 0.9}, indent=4))
    common = [nested, str(tmp_path / "p.json")]
    evaluate.main([*common, "-n", str(tmp_path / "n.json"), "-t", "0.5", "-o", str(tmp_path / "out"), "--curves"])
    got = json.loads(text_of(tmp_path / "out"))
    assert got["exact"] == 100.0 and got["best_exact_thresh"] == 0.1 and got["pr_oracle_ap"] == 50.0
    evaluate.main([*common, "--version", "1"])
    assert "33.33" in capsys.readouterr().out
