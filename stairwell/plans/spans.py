"""Feature windows and span post-processing."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stairwell.functions.text import SPACE, WORD, space_tokens, token_offsets
from stairwell.operators import features as ft, nbest as nb
from stairwell.plans import views
from stairwell.plans.preparation import question_features
from stairwell.plans.views import MAX_LENGTH, OVERLAP
from stairwell.sources.lines import first_of_file

PAD = "[PAD]"
FIXED_LENGTH, BATCH, MULTIPLE = 384, 16, 8
N_BEST, MAX_ANSWER, NULL_THRESHOLD = 20, 30, -12.0
HEAD = 100


def _joined(column: str, field: str | None = None):
    return F.array_join(F.transform(column, lambda s: (s[field] if field else s).cast("string")), " ")


def _tokens(spark, folder):
    docs = views.documents(spark, folder).select("doc_id", token_offsets(F.col("text")).alias("t"))
    return docs.select(
        "doc_id",
        F.size("t").alias("n"),
        _joined("t", "tok").alias("tokens"),
        _joined("t", "start").alias("starts"),
        _joined("t", "end").alias("ends"),
    )


def _window_rows(features: DataFrame) -> DataFrame:
    shown = F.transform("offset_mapping", lambda o: F.when(o.isNull(), "-").otherwise(F.concat_ws(":", o["start"], o["end"])))
    return features.select(
        "doc_id",
        "window",
        "first_token",
        F.size("tokens").alias("length"),
        F.array_join("tokens", " ").alias("tokens"),
        F.array_join(shown, " ").alias("offsets"),
    )


def _windows(spark, folder):
    return _window_rows(views.windows(spark, folder))


def _head(spark, folder):
    """The first documents of the file, whose ids are texts and sort otherwise, and the first of their windows."""
    table = views.table(spark, folder, "documents")
    source = F.concat(F.lit("what does "), "source", F.lit(" say in "), "lang").alias("question")
    start = F.struct(F.array(F.lit(None).cast("string")).alias("text"), F.array(F.lit(None).cast("int")).alias("answer_start"))
    examples = first_of_file(table, HEAD).select(
        "pos", F.concat(F.lit("d"), "doc_id").alias("id"), source, F.col("text").alias("context"), start.alias("answers")
    )
    features = question_features(examples, "id", MAX_LENGTH, OVERLAP, labels=False, max_samples=HEAD, position="pos")
    return features.select("id", "pos", "window", F.array_join("tokens", " ").alias("tokens"))


def _labels(spark, folder):
    labeled = ft.label_spans(views.windows(spark, folder), "start_char", "answer")
    return labeled.select("doc_id", "window", "start_position", "end_position")


def _mask(spark, folder):
    labeled = ft.label_spans(views.windows(spark, folder, context_first=True), "start_char", "answer")
    masked = ft.answer_mask(labeled)
    return masked.select(
        "doc_id",
        "window",
        "cls_index",
        "start_position",
        "end_position",
        "is_impossible",
        F.array_join(F.transform("p_mask", lambda m: m.cast("int").cast("string")), "").alias("p_mask"),
    )


def _words(spark, folder):
    return views.documents(spark, folder).select("doc_id", space_tokens(F.col("text")).alias("tokens"))


def _pad(spark, folder):
    padded = ft.pad_truncate(_words(spark, folder), "tokens", FIXED_LENGTH, PAD)
    return padded.select("doc_id", F.array_join("tokens", " ").alias("tokens"))


def _batch_pad(spark, folder):
    padded = ft.batch_pad(_words(spark, folder), "doc_id", "tokens", PAD, BATCH, MULTIPLE)
    return padded.select(
        "doc_id",
        "batch",
        "padded_length",
        F.size("tokens").alias("length"),
        F.size(F.filter("tokens", lambda t: t == PAD)).alias("pads"),
    )


def _candidates(spark, folder, every=False, text=False):
    scored = views.with_span_logits(views.windows(spark, folder, text=text))
    return nb.window_candidates(scored, N_BEST, MAX_ANSWER, every=every)


def _nbest(spark, folder, with_negatives=True):
    return nb.example_nbest(_candidates(spark, folder, text=True), None, "doc_id", n_best=N_BEST, with_negatives=with_negatives)


def _beam(spark, folder):
    scored = views.with_beam_logits(views.windows(spark, folder, context_first=True, text=True))
    return nb.example_nbest(nb.beam_candidates(scored, N_BEST, MAX_ANSWER), None, "doc_id", n_best=N_BEST, beam=True)


def _span_rows(spark, folder):
    """Every valid pair of a window, not only those a ranking over windows can use."""
    rows = nb.span_rows(_candidates(spark, folder, every=True), ["doc_id", "window"])
    return rows.select("doc_id", "window", "rank", "start_index", "end_index", "score")


def _null(spark, folder):
    return nb.null_scores(_candidates(spark, folder), "doc_id")


def _topk(spark, folder):
    return nb.nbest_rows(_nbest(spark, folder), "doc_id").select("doc_id", "rank", "text", "start_logit", "end_logit")


def _topk_spans(spark, folder):
    """Answers to data without unanswerable questions: the null answer does not compete."""
    rows = nb.nbest_rows(_nbest(spark, folder, with_negatives=False), "doc_id")
    return rows.select("doc_id", "rank", "text", "start_logit", "end_logit")


def _softmax(spark, folder):
    rows = nb.nbest_rows(_nbest(spark, folder), "doc_id")
    return rows.select("doc_id", "rank", F.round("probability", 6).alias("probability"))


def _decision(spark, folder):
    return nb.null_decision(_nbest(spark, folder), "doc_id", NULL_THRESHOLD)


def _beam_rows(spark, folder):
    rows = nb.nbest_rows(_beam(spark, folder), "doc_id")
    return rows.select("doc_id", "rank", "text", "score", F.round("probability", 6).alias("probability"))


def _formatted(spark, folder):
    answers = views.contexts(spark, folder).select("doc_id", F.col("answer").alias("answers"))
    return nb.format_predictions(nb.best_answer(_beam(spark, folder), "doc_id"), answers, "doc_id", F.col("null_score"))


QUERIES = {
    "token_offsets": _tokens,
    "doc_stride_windows": _windows,
    "head_features": _head,
    "answer_spans": _labels,
    "answer_mask": _mask,
    "pad_truncate": _pad,
    "batch_pad": _batch_pad,
    "nbest_spans": _span_rows,
    "null_score": _null,
    "nbest_topk": _topk,
    "nbest_topk_spans": _topk_spans,
    "nbest_softmax": _softmax,
    "null_decision": _decision,
    "beam_nbest": _beam_rows,
    "format_predictions": _formatted,
}

# ---------------------------------------------------------------- checks in SQL

Q_SIZE = 6  # words of the views' question
AT = Q_SIZE + 2  # first context position
EXTRA = Q_SIZE + 3  # tokens beside the context
BUDGET = MAX_LENGTH - EXTRA
STEP = BUDGET - OVERLAP

SQL_TOKENS = f"""
pieces AS (
  SELECT doc_id, unnest(range(len(l))) AS k, unnest(l) AS piece
  FROM (SELECT doc_id, regexp_extract_all(text, '[{WORD}]+|[{SPACE}]+|[^{WORD}{SPACE}]') AS l FROM documents)),
placed AS (SELECT doc_id, k, piece, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY k) AS e FROM pieces),
tok AS MATERIALIZED (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS i, piece AS tok,
         CAST(e - length(piece) AS BIGINT) AS s, CAST(e AS BIGINT) AS e
  FROM placed WHERE NOT regexp_matches(piece, '^[{SPACE}]'))
"""

SQL_WINDOWS = f"""{SQL_TOKENS},
counted AS (SELECT doc_id, count(tok) AS n FROM documents LEFT JOIN tok USING (doc_id) GROUP BY doc_id),
win AS (
  SELECT doc_id, n, unnest(range(0, 1 + greatest(0, CAST(ceil((n - {BUDGET}) / {STEP}.0) AS BIGINT)))) AS w FROM counted),
wsize AS (SELECT doc_id, w, n, least({BUDGET}, n - w * {STEP}) AS cs FROM win),
wt AS MATERIALIZED (
  SELECT wsize.doc_id, w, cs, i - w * {STEP} AS c, tok, s, e
  FROM wsize JOIN tok ON tok.doc_id = wsize.doc_id AND i >= w * {STEP} AND i < w * {STEP} + {BUDGET}),
ans AS (
  SELECT doc_id, max(s) FILTER (WHERE i = n // 2) AS b, max(e) FILTER (WHERE i = least(n // 2 + 2, n - 1)) AS f
  FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM tok) GROUP BY doc_id),
wl AS (
  SELECT wt.doc_id, w, any_value(cs) AS cs, min(s) AS s0, max(e) AS e1, any_value(b) AS b, any_value(f) AS f,
         count(*) FILTER (WHERE s <= b) AS na, count(*) FILTER (WHERE e >= f) AS nb
  FROM wt JOIN ans USING (doc_id) GROUP BY ALL)
"""

_SQL_WINDOW_ROWS = """
shown AS (
  SELECT doc_id, w, cs, string_agg(tok, ' ' ORDER BY c) AS ctx, string_agg(s || ':' || e, ' ' ORDER BY c) AS off
  FROM wt GROUP BY ALL)
"""
_SQL_TOKENS_SHOWN = "'[CLS] what does ' || source || ' say in ' || lang || ' [SEP] ' || ctx || ' [SEP]'"


def _sql_logit(a: int, b: int, c: int, m: int) -> str:
    return f"CAST((p * {a} + doc_id * {b} + w * {c}) % {m} AS DOUBLE) / 64"


SQL_CANDIDATES = f"""{SQL_WINDOWS},
seat AS (SELECT doc_id, w, cs, unnest(range(0, cs + {EXTRA})) AS p FROM wsize),
pos AS (SELECT seat.doc_id, seat.w, seat.cs, p, s, e FROM seat LEFT JOIN wt ON wt.doc_id = seat.doc_id AND wt.w = seat.w AND wt.c = p - {AT}),
lg AS MATERIALIZED (SELECT *, {_sql_logit(7919, 104729, 31, 1009)} AS sl, {_sql_logit(6271, 15485863, 17, 1013)} AS el FROM pos),
st AS (SELECT * FROM lg QUALIFY row_number() OVER (PARTITION BY doc_id, w ORDER BY sl DESC, p) <= {N_BEST}),
en AS (SELECT * FROM lg QUALIFY row_number() OVER (PARTITION BY doc_id, w ORDER BY el DESC, p) <= {N_BEST}),
span AS (
  SELECT st.doc_id, st.w, st.p AS sp, en.p AS ep, st.sl, en.el, st.sl + en.el AS score, st.s, en.e
  FROM st JOIN en ON st.doc_id = en.doc_id AND st.w = en.w
  WHERE st.s IS NOT NULL AND en.e IS NOT NULL
    AND en.p >= st.p AND en.p - st.p + 1 <= {MAX_ANSWER}),
every AS (SELECT *, row_number() OVER (PARTITION BY doc_id, w ORDER BY score DESC, sp, ep) AS rank FROM span),
cand AS (SELECT * FROM every WHERE rank <= {N_BEST}),
nul AS (
  SELECT doc_id, w, sl, el, sl + el AS score FROM lg WHERE p = 0
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY sl + el, w) = 1)
"""

SQL_NBEST = f"""{SQL_CANDIDATES},
top AS (
  SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, w, sp, ep) <= {N_BEST}),
texts AS (
  SELECT doc_id, 0 AS kind, w, sp, ep, sl, el, score, substring(text, s + 1, e - s) AS text
  FROM top JOIN documents USING (doc_id)),
merged AS (
  SELECT * FROM texts UNION ALL SELECT doc_id, 1, w, 0, 0, sl, el, score, '' FROM nul),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, kind, w, sp, ep) AS rank
  FROM merged QUALIFY rank <= {N_BEST} OR kind = 1),
lone AS (SELECT doc_id FROM ordered GROUP BY doc_id HAVING count(*) = 1 AND max(text) = ''),
listed AS (
  SELECT doc_id, rank + CASE WHEN doc_id IN (SELECT doc_id FROM lone) THEN 1 ELSE 0 END AS rank, text, sl, el, score
  FROM ordered
  UNION ALL SELECT doc_id, 1, 'empty', CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) FROM lone)
"""

SQL_BEAM = f"""{SQL_WINDOWS},
slot AS (SELECT doc_id, w, cs, cs + {EXTRA} AS size, unnest(range(25)) AS k FROM wsize),
bm AS (
  SELECT doc_id, w, cs, (doc_id * 31 + w * 7 + (k // 5) * 13) % size AS sp,
         ((doc_id * 31 + w * 7 + (k // 5) * 13) % size + (k % 5) * 4) % size AS ep,
         -CAST((doc_id * 3 + w + (k // 5) * 5) % 97 AS DOUBLE) / 16 AS sl,
         -CAST((doc_id * 5 + w + k * 7) % 89 AS DOUBLE) / 16 AS el
  FROM slot),
cand AS (SELECT *, sl + el AS score FROM bm WHERE sp < cs AND ep < cs AND ep >= sp AND ep - sp + 1 <= {MAX_ANSWER}),
top AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, w, sp, ep, sl) AS rank
  FROM cand QUALIFY rank <= {N_BEST}),
cls AS (SELECT doc_id, min(CAST((doc_id * 37 + w * 11) % 101 - 50 AS DOUBLE) / 8) AS null_score FROM wsize GROUP BY doc_id),
begun AS MATERIALIZED (SELECT top.*, s FROM top JOIN wt ON wt.doc_id = top.doc_id AND wt.w = top.w AND c = sp),
done AS MATERIALIZED (SELECT begun.*, wt.e AS e FROM begun JOIN wt ON wt.doc_id = begun.doc_id AND wt.w = begun.w AND c = ep),
listed AS (
  SELECT doc_id, rank, substring(text, s + 1, e - s) AS text, score FROM done JOIN documents USING (doc_id)
  UNION ALL
  SELECT doc_id, 1, '', CAST(-2e-6 AS DOUBLE) FROM counted WHERE doc_id NOT IN (SELECT doc_id FROM cand))
"""


def _sql_softmax(cte: str) -> str:
    return f"""{cte},
peak AS (SELECT doc_id, max(score) AS top FROM listed GROUP BY doc_id),
mass AS (SELECT doc_id, sum(exp(score - top)) AS total FROM listed JOIN peak USING (doc_id) GROUP BY doc_id)"""


_SQL_SHARE = "round(exp(score - top) / total, 6) AS probability"

ORACLE = {
    "token_offsets": f"""WITH {SQL_TOKENS}
SELECT doc_id, CAST(count(tok) AS INT) AS n, coalesce(string_agg(tok, ' ' ORDER BY i), '') AS tokens,
       coalesce(string_agg(CAST(s AS VARCHAR), ' ' ORDER BY i), '') AS starts,
       coalesce(string_agg(CAST(e AS VARCHAR), ' ' ORDER BY i), '') AS ends
FROM documents LEFT JOIN tok USING (doc_id) GROUP BY doc_id""",
    "doc_stride_windows": f"""WITH {SQL_WINDOWS}, {_SQL_WINDOW_ROWS}
SELECT doc_id, w AS "window", w * {STEP} AS first_token, cs + {EXTRA} AS length, {_SQL_TOKENS_SHOWN} AS tokens,
       repeat('- ', {AT}) || off || ' -' AS offsets
FROM shown JOIN documents USING (doc_id)""",
    "head_features": f"""WITH {SQL_WINDOWS}, {_SQL_WINDOW_ROWS},
filed AS (SELECT doc_id, source, lang, row_number() OVER () - 1 AS pos FROM documents)
SELECT 'd' || doc_id AS id, pos, w AS "window", {_SQL_TOKENS_SHOWN} AS tokens
FROM shown JOIN filed USING (doc_id)
WHERE pos < {HEAD} ORDER BY pos, w LIMIT {HEAD}""",
    "answer_spans": f"""WITH {SQL_WINDOWS}
SELECT doc_id, w AS "window",
       CASE WHEN NOT (s0 <= b AND e1 >= f) THEN 0 WHEN na = cs THEN cs + {EXTRA} - 1 ELSE {AT} + na - 1 END AS start_position,
       CASE WHEN NOT (s0 <= b AND e1 >= f) THEN 0 ELSE {AT} + cs - nb END AS end_position
FROM wl""",
    "answer_mask": f"""WITH {SQL_WINDOWS}
SELECT doc_id, w AS "window", cs + {EXTRA - 1} AS cls_index,
       CASE WHEN NOT (s0 <= b AND e1 >= f) THEN cs + {EXTRA - 1} WHEN na < cs THEN na - 1
            WHEN qn < {Q_SIZE} THEN cs + qn ELSE cs + {EXTRA - 1} END AS start_position,
       CASE WHEN NOT (s0 <= b AND e1 >= f) THEN cs + {EXTRA - 1} ELSE cs - nb END AS end_position,
       CAST(CASE WHEN s0 <= b AND e1 >= f THEN 0 ELSE 1 END AS DOUBLE) AS is_impossible,
       repeat('0', cs) || repeat('1', {EXTRA - 1}) || '0' AS p_mask
FROM (SELECT wl.*, len(list_filter([0, 5, 10, 11 + length(source), 15 + length(source), 18 + length(source)], lambda x: x <= b)) AS qn
      FROM wl JOIN documents USING (doc_id))""",
    "pad_truncate": f"""WITH t AS (
  SELECT doc_id, list_filter(regexp_split_to_array(text, '[{SPACE}]+'), lambda x: x <> '') AS l FROM documents)
SELECT doc_id, array_to_string(list_resize(l, {FIXED_LENGTH}, '{PAD}'), ' ') AS tokens FROM t""",
    "batch_pad": f"""WITH t AS (
  SELECT doc_id, doc_id // {BATCH} AS batch,
         len(list_filter(regexp_split_to_array(text, '[{SPACE}]+'), lambda x: x <> '')) AS n FROM documents),
m AS (SELECT *, CAST(ceil(max(n) OVER (PARTITION BY batch) / {MULTIPLE}.0) AS BIGINT) * {MULTIPLE} AS padded_length FROM t)
SELECT doc_id, batch, padded_length, padded_length AS length, padded_length - n AS pads FROM m""",
    "nbest_spans": f"""WITH {SQL_CANDIDATES}
SELECT doc_id, w AS "window", rank, sp AS start_index, ep AS end_index, score FROM every""",
    "null_score": f"""WITH {SQL_CANDIDATES}
SELECT doc_id, score AS null_score, sl AS start_logit, el AS end_logit, w AS "window" FROM nul""",
    "nbest_topk": f"WITH {SQL_NBEST} SELECT doc_id, rank, text, sl AS start_logit, el AS end_logit FROM listed",
    "nbest_topk_spans": f"""WITH {SQL_NBEST}
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, w, sp, ep) AS rank, text, sl AS start_logit, el AS end_logit FROM texts
UNION ALL SELECT doc_id, 1, '{nb.EMPTY_TEXT}', CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) FROM counted WHERE doc_id NOT IN (SELECT doc_id FROM texts)""",
    "nbest_softmax": f"""WITH {_sql_softmax(SQL_NBEST)}
SELECT doc_id, rank, {_SQL_SHARE} FROM listed JOIN peak USING (doc_id) JOIN mass USING (doc_id)""",
    "null_decision": f"""WITH {SQL_NBEST},
real AS (SELECT * FROM listed WHERE text <> '' QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY rank) = 1),
diff AS (SELECT nul.doc_id, nul.score - real.sl - real.el AS score_diff, real.text FROM nul LEFT JOIN real USING (doc_id))
SELECT doc_id, score_diff,
       CASE WHEN text IS NULL OR score_diff > {NULL_THRESHOLD} THEN '' ELSE text END AS prediction_text FROM diff""",
    "beam_nbest": f"""WITH {_sql_softmax(SQL_BEAM)}
SELECT doc_id, rank, text, score, {_SQL_SHARE} FROM listed JOIN peak USING (doc_id) JOIN mass USING (doc_id)""",
    "format_predictions": f"""WITH {SQL_BEAM}
SELECT doc_id AS id, listed.text AS prediction_text, null_score AS no_answer_probability,
       substring(d.text, b + 1, f - b) AS answers
FROM listed JOIN cls USING (doc_id) JOIN ans USING (doc_id) JOIN documents d USING (doc_id) WHERE rank = 1""",
}
