"""Inputs of the registered queries, derived by Spark from the given tables.

Nothing here selects part of a table: every row and every text is used whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from stairwell.functions.text import space_tokens, token_offsets
from stairwell.operators.features import window_features

MAX_LENGTH, OVERLAP = 384, 128


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


def questions(spark: SparkSession, folder: str) -> DataFrame:
    """Each user turn asks; the assistant's next turn, line by line, holds the gold answers."""
    turns = table(spark, folder, "conversations")
    asked = turns.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    replies = turns.filter("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply")
    )
    both = asked.join(replies, ["conv_id", "turn"], "left")
    no_golds = F.expr("cast(array() as array<string>)")
    return both.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("qid"),
        "conv_id",
        "turn",
        "question",
        "reply",
        F.when(F.col("reply").isNull(), no_golds).otherwise(F.split("reply", "\n")).alias("golds"),
        F.col("reply").isNotNull().alias("has_ans"),
    )


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Stand-in model answers; conversations opened by a system turn got none.

    The no-answer probability falls with the length of the answer, with many ties.
    """
    asked = questions(spark, folder)
    opened = table(spark, folder, "conversations").filter("role = 'system'").select("conv_id")
    kind = (F.col("conv_id") + F.col("turn")) % 4
    answer = (
        F.when(F.col("reply").isNull() & kind.isin(0, 2), F.lit(""))
        .when(F.col("reply").isNull(), F.col("question"))
        .when(kind == 0, F.element_at("golds", 1))
        .when(kind == 1, F.col("reply"))
        .when(kind == 2, F.concat(F.lit("The "), F.element_at("golds", -1), F.lit("!")))
        .otherwise(F.lit(""))
    )
    answered = asked.join(opened, "conv_id", "left_anti").select("qid", answer.alias("prediction"))
    words = F.size(F.filter(F.split("prediction", " "), lambda w: w != ""))
    chance = F.floor(F.lit(1000) / (1 + words)) / F.lit(1000.0)
    return answered.select("qid", F.col("qid").alias("pos"), "prediction", chance.cast("double").alias("na_prob"))


def contexts(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as contexts; the answer is the text from the middle token to the second after it."""
    docs = documents(spark, folder)
    spans = docs.select(
        "doc_id",
        F.col("text").alias("context"),
        F.array(F.lit("what"), F.lit("does"), "source", F.lit("say"), F.lit("in"), "lang").alias("question"),
        token_offsets(F.col("text")).alias("spans"),
    )
    middle = F.floor(F.size("spans") / 2).cast("int")
    first = F.get("spans", middle)["start"]
    last = F.get("spans", F.least(middle + 2, F.size("spans") - 1))["end"]
    return spans.select(
        "*", first.alias("start_char"), F.substring(F.col("context"), first + 1, last - first).alias("answer")
    )


def windows(spark: SparkSession, folder: str, context_first: bool = False, text: bool = False) -> DataFrame:
    docs = contexts(spark, folder)
    if context_first:
        docs = docs.withColumn("starts", F.transform(token_offsets(F.array_join("question", " ")), lambda t: t["start"]))
    return window_features(
        docs,
        ["doc_id"],
        "question",
        "spans",
        MAX_LENGTH,
        OVERLAP,
        context_first,
        carry=["start_char", "answer"],
        text="context" if text else None,
        question_starts="starts" if context_first else None,
    )


def with_span_logits(features: DataFrame) -> DataFrame:
    """Stand-in model output: one start and one end logit per position, with exact ties."""

    def logit(a: int, b: int, c: int, m: int):
        return F.transform(
            F.sequence(F.lit(0), F.size("tokens") - 1),
            lambda p: ((p * a + F.col("doc_id") * b + F.col("window") * c) % m).cast("double") / 64.0,
        )

    return features.select(
        "*",
        logit(7919, 104729, 31, 1009).alias("start_logits"),
        logit(6271, 15485863, 17, 1013).alias("end_logits"),
    )


def with_beam_logits(features: DataFrame, start_n_top: int = 5, end_n_top: int = 5) -> DataFrame:
    """Stand-in beam output: top start and end positions, their log probabilities, the CLS logit."""
    size = F.size("tokens")
    doc, window = F.col("doc_id"), F.col("window")

    def start_of(i):
        return (doc * 31 + window * 7 + i * 13) % size

    starts = F.transform(F.sequence(F.lit(0), F.lit(start_n_top - 1)), lambda i: start_of(i).cast("int"))
    slots = F.sequence(F.lit(0), F.lit(start_n_top * end_n_top - 1))
    ends = F.transform(
        slots, lambda k: ((start_of(F.floor(k / end_n_top)) + (k % end_n_top) * 4) % size).cast("int")
    )
    return features.select(
        "*",
        starts.alias("start_index"),
        ends.alias("end_index"),
        F.transform(F.sequence(F.lit(0), F.lit(start_n_top - 1)), lambda i: -((doc * 3 + window + i * 5) % 97).cast("double") / 16.0).alias("start_log_probs"),
        F.transform(slots, lambda k: -((doc * 5 + window + k * 7) % 89).cast("double") / 16.0).alias("end_log_probs"),
        (((doc * 37 + window * 11) % 101 - 50).cast("double") / 8.0).alias("cls_logit"),
    )


def sentences(spark: SparkSession, folder: str) -> DataFrame:
    """Every line of a document is a sentence of space-separated tokens."""
    lines = documents(spark, folder).select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    return lines.select("doc_id", "lang", "line", space_tokens(F.col("text")).alias("tokens"))


def gold_tags(tokens):
    """Tags by capital initials; long words are organisations, neighbours of one type belong together."""

    def capital(token):
        return token.rlike(r"^\p{Lu}")

    def entity(token):
        return F.when(F.length(token) > 6, "ORG").otherwise("PER")

    def tag(token, i):
        before = F.get(tokens, F.greatest(i - 1, F.lit(0)))
        goes_on = (i > 0) & capital(before) & (entity(before) == entity(token))
        return F.when(~capital(token), "O").otherwise(F.concat(F.when(goes_on, "I-").otherwise("B-"), entity(token)))

    return F.transform(tokens, tag)


def tagged(spark: SparkSession, folder: str) -> DataFrame:
    """Gold tags, and stand-in predictions that differ at some positions."""

    def guess(tag, i):
        turn = (F.col("doc_id") + F.col("line") + i) % 7
        return F.when(turn == 0, "O").when(turn == 3, "B-LOC").when((turn == 5) & (tag == "O"), "I-PER").otherwise(tag)

    marked = sentences(spark, folder).withColumn("ner_tags", gold_tags(F.col("tokens")))
    return marked.withColumn("predicted", F.transform("ner_tags", guess))


def classified(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled documents with a stand-in class prediction."""
    labels, docs = table(spark, folder, "labels"), table(spark, folder, "documents")
    joined = labels.join(docs.select("doc_id", "lang", "source", "n_chars"), "doc_id")
    return joined.withColumn("predicted", (F.col("n_chars") % 3 > 0).cast("int"))


def translations(spark: SparkSession, folder: str) -> DataFrame:
    """Document text as reference; the candidate misses the long words."""
    words = F.split("text", " ")
    kept = F.filter(words, lambda w: F.length(w) < 10)
    docs = documents(spark, folder)
    return docs.select("doc_id", F.create_map(F.lit("src"), F.array_join(kept, " "), F.lit("ref"), "text").alias("translation"))


def hidden(spark: SparkSession, folder: str) -> DataFrame:
    """Paired vectors: x an example's vector, y the mean vector of its label."""
    vectors = table(spark, folder, "embeddings")
    parts = vectors.select("label", F.posexplode("embedding").alias("dim", "value"))
    means = parts.groupBy("label", "dim").agg(F.avg(F.col("value").cast("double")).alias("mean"))
    # one entry per dimension of the vector type
    centres = means.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("dim", "mean"))).alias("c"))
    centres = centres.select("label", F.transform("c", lambda s: s["mean"]).alias("y"))
    return vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x")).join(centres, "label")


def token_clouds(spark: SparkSession, folder: str, width: int = 8) -> DataFrame:
    """The paired vectors cut into tokens of ``width`` components, one row per layer and token."""
    pieces = lambda v: F.transform(
        F.sequence(F.lit(0), F.ceil(F.size(v) / width).cast("int") - 1), lambda k: F.slice(v, k * width + 1, F.lit(width))
    )
    both = hidden(spark, folder).select(
        F.col("vec_id").alias("idx"),
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("layer"), pieces(F.col("x")).alias("tokens")),
                F.struct(F.lit(-1).alias("layer"), pieces(F.col("y")).alias("tokens")),
            )
        ).alias("l"),
    )
    return both.select("idx", "l.layer", F.posexplode("l.tokens").alias("token_pos", "vector"))


def plain_difficulty(spark: SparkSession, folder: str) -> DataFrame:
    """Text length as a plain difficulty."""
    docs = table(spark, folder, "documents")
    return docs.select(F.col("doc_id").alias("idx"), F.col("n_chars").cast("double").alias("difficulty"))
