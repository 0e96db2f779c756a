"""Source, row-selection and user-function queries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from stairwell.functions.arrays import let
from stairwell.functions.text import space_tokens
from stairwell.operators import rows as rw
from stairwell.plans import views
from stairwell.plans.answers import SQL_QA
from stairwell.plans.labels import SQL_SENTENCES
from stairwell.sources.conll import parse_conll
from stairwell.sources.qa import flatten_squad, qa_lookup, qa_view

SEED, PEEK = 7, 3


def nested_questions(spark: SparkSession, folder: str) -> DataFrame:
    """Each question as a nested document with one paragraph per line of its reply."""
    lines = F.when(F.col("has_ans"), F.col("golds")).otherwise(F.array(F.lit("")))

    def paragraph(line, i):
        answers = F.array(F.struct(line.alias("text"), F.lit(0).cast("long").alias("answer_start")))
        question = F.struct(
            F.concat_ws("-", "qid", i).alias("id"),
            "question",
            (~F.col("has_ans")).alias("is_impossible"),
            F.when(F.col("has_ans"), answers).otherwise(F.slice(answers, 1, 0)).alias("answers"),
        )
        return F.struct(line.alias("context"), F.array(question).alias("qas"))

    article = F.struct(F.col("qid").cast("string").alias("title"), F.transform(lines, paragraph).alias("paragraphs"))
    return views.questions(spark, folder).select(F.array(article).alias("data"))


def _flatten(spark, folder):
    flat = flatten_squad(nested_questions(spark, folder))
    return flat.select(
        "id",
        F.col("title").cast("long").alias("qid"),
        "paragraph",
        "place",
        "question",
        "context",
        "is_impossible",
        F.get("answers", F.lit(0))["text"].alias("answer"),
    )


def _view(spark, folder):
    shown = qa_view(flatten_squad(nested_questions(spark, folder)))
    return shown.select("id", "question", F.array_join("answers", "\n").alias("answers"))


def _lookup(spark, folder):
    """The browsable questions with the reply as their answers, beside the predictions."""
    answers = F.transform("golds", lambda g: F.struct(g.alias("text")))
    flat = views.questions(spark, folder).select(
        F.col("qid").cast("string").alias("id"), "question", answers.alias("answers"), (~F.col("has_ans")).alias("is_impossible")
    )
    said = views.predictions(spark, folder).select(F.col("qid").cast("string").alias("id"), F.col("prediction").alias("prediction_text"))
    return qa_lookup(qa_view(flat), said).select(F.col("id").cast("long").alias("qid"), "question", "first_answer", "prediction")


def _conll(spark, folder):
    """Documents as token-per-line text with a document start, parsed back into sentences."""

    def block(line):
        return let(
            space_tokens(line),
            lambda tokens: let(
                views.gold_tags(tokens),
                lambda tags: F.array_join(
                    F.transform(
                        tokens,
                        lambda t, i: F.concat(
                            t, F.lit(" X "), F.when(i == 0, "B").otherwise("I"), F.lit(" "), F.get(tags, i)
                        ),
                    ),
                    "\n",
                ),
            ),
        )

    text = F.concat(
        F.lit("-DOCSTART- -X- -X- O\n\n"),
        F.array_join(F.transform(F.split("text", "\n"), block), "\n\n"),
        F.lit("\n"),
    )
    docs = views.documents(spark, folder).select("doc_id", text.alias("text"))
    parsed = parse_conll(docs, "text", ["doc_id"])
    joined = [F.array_join(c, " ").alias(c) for c in ("tokens", "pos_tags", "chunk_tags", "ner_tags")]
    return parsed.select("doc_id", "sentence", *joined)


def _index(spark, folder):
    """Events have no dense id of their own; ties in time are broken by event."""
    at = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    events = views.table(spark, folder, "events").select("event_id", at.alias("at"))
    return rw.add_index(events, "at", "event_id").select("event_id", "idx")


def _index_big(spark, folder):
    """Keys beyond the exact range of a double, many of them equal; ties are broken by event."""
    events = views.table(spark, folder, "events").select("event_id", (F.lit(1 << 60) + F.col("user_id")).alias("at"))
    return rw.add_index(events, "at", "event_id").select("event_id", "idx")


def _select(spark, folder):
    """Every document, those of few characters first in the list, and labelled ones a second time."""
    docs = views.table(spark, folder, "documents").select("doc_id", "lang", "n_chars")
    again = views.table(spark, folder, "labels").join(docs, "doc_id", "left_semi").select((-1 - F.col("doc_id")).alias("pos"), "doc_id")
    wanted = docs.select((F.col("n_chars") * 1_000_000_000 + F.col("doc_id")).alias("pos"), "doc_id").unionByName(again)
    return rw.select_by_index(docs, wanted, "doc_id")


def _peek(spark, folder):
    docs = views.table(spark, folder, "documents").select("doc_id", "lang", "text")
    return rw.peek(docs, "doc_id", SEED, PEEK)


def _longest_word(batch: pd.DataFrame) -> pd.DataFrame:
    """A user function: words of a text and the length of the longest one."""
    words = batch["text"].str.split(" ")
    return pd.DataFrame(
        {
            "doc_id": batch["doc_id"],
            "words": words.map(len).astype("int64"),
            "longest": words.map(lambda w: max(map(len, w))).astype("int64"),
        }
    )


def _mapped(spark, folder):
    docs = views.documents(spark, folder).select("doc_id", "text")
    return rw.map_batches(docs, _longest_word, "doc_id long, words long, longest long")


QUERIES = {
    "squad_flatten": _flatten,
    "qa_view": _view,
    "qa_lookup": _lookup,
    "conll_sentences": _conll,
    "add_idx": _index,
    "add_idx_big": _index_big,
    "select_by_index": _select,
    "peek": _peek,
    "map_batches": _mapped,
}

# ---------------------------------------------------------------- checks in SQL

ORACLE = {
    "squad_flatten": f"""WITH {SQL_QA},
line AS (
  SELECT qid, question, has_ans, unnest(CASE WHEN has_ans THEN golds ELSE [''] END) AS t,
         unnest(range(CASE WHEN has_ans THEN len(golds) ELSE 1 END)) AS paragraph FROM qa)
SELECT qid || '-' || paragraph AS id, qid, paragraph, 0 AS place, question, t AS context, NOT has_ans AS is_impossible,
       CASE WHEN has_ans THEN t END AS answer FROM line""",
    "qa_view": f"""WITH {SQL_QA},
line AS (SELECT qid, question, unnest(golds) AS t, unnest(range(len(golds))) AS paragraph FROM qa WHERE has_ans)
SELECT qid || '-' || paragraph AS id, question, t AS answers FROM line""",
    "qa_lookup": f"""WITH {SQL_QA}
SELECT qid, question, golds[1] AS first_answer, prediction FROM qa JOIN pred USING (qid) WHERE has_ans""",
    "conll_sentences": f"""WITH {SQL_SENTENCES},
s AS (
  SELECT doc_id, line, string_agg(tok, ' ' ORDER BY i) AS tokens, string_agg('X', ' ') AS pos_tags,
         string_agg(CASE WHEN i = 0 THEN 'B' ELSE 'I' END, ' ' ORDER BY i) AS chunk_tags, string_agg(gold, ' ' ORDER BY i) AS ner_tags
  FROM tags GROUP BY ALL)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line) - 1 AS sentence, tokens, pos_tags, chunk_tags, ner_tags FROM s""",
    "add_idx": "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS idx FROM events",
    "add_idx_big": """SELECT event_id, row_number() OVER (ORDER BY 1152921504606846976 + user_id, event_id) - 1 AS idx FROM events""",
    "select_by_index": """SELECT n_chars * 1000000000 + doc_id AS pos, doc_id, lang, n_chars FROM documents
UNION ALL SELECT -1 - doc_id, doc_id, lang, n_chars FROM labels JOIN documents USING (doc_id)""",
    "peek": f"SELECT doc_id, lang, text FROM documents ORDER BY md5('{SEED}:' || doc_id), doc_id LIMIT {PEEK}",
    "map_batches": """SELECT doc_id, len(string_split(text, ' ')) AS words,
list_max(list_transform(string_split(text, ' '), lambda w: length(w))) AS longest FROM documents""",
}
