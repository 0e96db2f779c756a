"""Question-answering files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from stairwell.sources.json_splits import read_entries
from stairwell.sources.lines import with_position

ANSWERS = "array<struct<text:string,answer_start:bigint>>"
QUESTION = f"id:string,question:string,is_impossible:boolean,answers:{ANSWERS},plausible_answers:{ANSWERS}"
PARAGRAPHS = f"array<struct<context:string,qas:array<struct<{QUESTION}>>>>"
ARTICLE = f"title string, paragraphs {PARAGRAPHS}"
FLAT = "id string, question string, context string, answers struct<text:array<string>,answer_start:array<int>>"


def flatten_squad(nested: DataFrame) -> DataFrame:
    """One row per question of ``data[].paragraphs[].qas[]``, with its three positions.

    ``article``, ``paragraph`` and ``place`` number the nesting levels, so sorting
    by them gives document order.
    """
    return _questions(nested.select(F.posexplode("data").alias("article", "a")))


def _questions(articles: DataFrame) -> DataFrame:
    paragraphs = articles.select("article", "a.title", F.posexplode("a.paragraphs").alias("paragraph", "p"))
    questions = paragraphs.select("article", "paragraph", "title", "p.context", F.posexplode("p.qas").alias("place", "q"))
    return questions.select(
        "article",
        "paragraph",
        "place",
        "title",
        "context",
        "q.question",
        "q.id",
        "q.answers",
        F.coalesce("q.is_impossible", F.lit(False)).alias("is_impossible"),
    )


def _elements(spark: SparkSession, path: str, schema: str, name: str) -> DataFrame:
    """(``pos``, ``name``) of the ``data`` array in each file."""
    parsed = F.from_json("text", schema, {"mode": "FAILFAST"})
    return read_entries(spark, path, "data").select("pos", parsed.alias(name))


def read_squad(spark: SparkSession, path: str) -> DataFrame:
    """Nested JSON document(s) to one row per question.  A document is read in splits, an article is parsed by one task."""
    return _questions(_elements(spark, path, ARTICLE, "a").withColumnRenamed("pos", "article").withColumn("article", F.col("article").cast("int")))


def read_flat_qa(spark: SparkSession, path: str, kind: str = "json", position: str | None = None) -> DataFrame:
    """Flat rows: JSON with the rows under ``data``, or CSV with JSON text in ``answers``.

    ``position`` names a column for the rows' places in their file.
    """
    if kind == "json":
        rows = _elements(spark, path, FLAT, "row")
        return rows.select("row.*", *([F.col("pos").alias(position)] if position else []))
    if kind != "csv":
        raise ValueError("the file is csv or json")
    table = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    if "answers" in table.columns:
        parsed = F.from_json("answers", "text array<string>, answer_start array<int>")
        # withColumn would hide the file's metadata
        table = table.select(*[parsed.alias(c) if c == "answers" else F.col(c) for c in table.columns], *([F.col("_metadata")] if position else []))
    return with_position(table, position) if position else table


def qa_view(questions: DataFrame) -> DataFrame:
    """Answerable questions with all their answers, for browsing."""
    return questions.filter(~F.col("is_impossible")).select(
        "question", F.transform("answers", lambda a: a["text"]).alias("answers"), "id"
    )


def qa_lookup(view: DataFrame, predictions: DataFrame, qid: str = "id", text: str = "prediction_text") -> DataFrame:
    """First gold answer and prediction of every browsable question that has a prediction."""
    shown = predictions.select(qid, F.col(text).alias("prediction"))
    return view.join(shown, qid).select(qid, "question", F.get("answers", F.lit(0)).alias("first_answer"), "prediction")
