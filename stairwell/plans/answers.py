"""Answer-scoring queries."""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession, functions as F

from stairwell.functions.text import SPACE, normalize_answer
from stairwell.operators import qa_metrics as qa
from stairwell.plans import views

SWEEP_THRESHOLD = 0.05


def _scored(spark: SparkSession, folder: str, version: int = 2, how: str = "inner") -> DataFrame:
    return qa.score_answers(views.questions(spark, folder), views.predictions(spark, folder), version=version, how=how)


def _normalized(spark, folder):
    docs = views.documents(spark, folder)
    return docs.select("doc_id", normalize_answer(F.col("text")).alias("normalized"))


def _exact(spark, folder):
    return _scored(spark, folder).select("qid", "exact")


def _f1(version):
    return lambda spark, folder: _scored(spark, folder, version).select("qid", F.round("f1", 6).alias("f1"))


def _eval_v1(spark, folder):
    out = qa.evaluate_v1(_scored(spark, folder, 1, "left"))
    return out.select(F.round("exact_match", 6).alias("exact_match"), F.round("f1", 6).alias("f1"), "total")


def _threshold(spark, folder):
    out = qa.apply_no_answer_threshold(_scored(spark, folder), threshold=SWEEP_THRESHOLD)
    return out.select("qid", "exact", F.round("f1", 6).alias("f1"))


def _eval_v2(spark, folder):
    out = qa.evaluate_v2(qa.apply_no_answer_threshold(_scored(spark, folder)))
    return out.select("part", F.round("exact", 6).alias("exact"), F.round("f1", 6).alias("f1"), "total")


def _missing(spark, folder):
    return qa.missing_predictions(views.questions(spark, folder), views.predictions(spark, folder)).select("qid")


def _best(spark, folder):
    unanswerable = views.questions(spark, folder).filter(~F.col("has_ans"))
    out = qa.best_threshold(_scored(spark, folder), unanswerable)
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


def _curve(spark, folder):
    out = qa.pr_curve(_scored(spark, folder), views.questions(spark, folder))
    return out.select("kind", "na_prob", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


def _ap(spark, folder):
    return qa.average_precision(_scored(spark, folder), views.questions(spark, folder)).select("kind", F.round("ap", 6).alias("ap"))


def _histogram(spark, folder):
    out = qa.na_histogram(_scored(spark, folder))
    return out.select("part", "bin", "n", F.round("proportion", 6).alias("proportion"))


QUERIES = {
    "normalize_answer": _normalized,
    "squad_exact": _exact,
    "squad_f1_v1": _f1(1),
    "squad_f1_v2": _f1(2),
    "squad_eval_v1": _eval_v1,
    "na_threshold": _threshold,
    "squad_eval_v2": _eval_v2,
    "missing_preds": _missing,
    "best_thresh": _best,
    "pr_curve": _curve,
    "average_precision": _ap,
    "na_hist": _histogram,
}

# ---------------------------------------------------------------- checks in SQL

_PUNCT = string.punctuation.replace("'", "''")


def sql_normalize(text: str) -> str:
    words = rf"regexp_replace(translate(lower({text}), '{_PUNCT}', ''), '([\p{{L}}\p{{N}}_]+)', chr(1) || '\1' || chr(2), 'g')"
    bare = rf"regexp_replace(regexp_replace({words}, chr(1) || '(a|an|the)' || chr(2), ' ', 'g'), '[\x01\x02]', '', 'g')"
    return rf"trim(regexp_replace({bare}, '[{SPACE}]+', ' ', 'g'))"


SQL_QA = """
u AS (SELECT conv_id, turn, text AS question FROM conversations WHERE role = 'user'),
r AS (SELECT conv_id, turn - 1 AS turn, text AS reply FROM conversations WHERE role = 'assistant'),
qa AS (
  SELECT conv_id * 1000 + turn AS qid, conv_id, turn, question, reply,
         CASE WHEN reply IS NULL THEN [] ELSE string_split(reply, chr(10)) END AS golds,
         reply IS NOT NULL AS has_ans, (conv_id + turn) % 4 AS kind
  FROM u LEFT JOIN r USING (conv_id, turn)),
answered AS (
  SELECT qid, CASE WHEN reply IS NULL AND kind IN (0, 2) THEN ''
                   WHEN reply IS NULL THEN question
                   WHEN kind = 0 THEN golds[1]
                   WHEN kind = 1 THEN reply
                   WHEN kind = 2 THEN 'The ' || golds[len(golds)] || '!'
                   ELSE '' END AS prediction
  FROM qa WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system')),
pred AS (
  SELECT qid, qid AS pos, prediction,
         CAST(1000 // (1 + len(list_filter(string_split(prediction, ' '), lambda w: w <> ''))) AS DOUBLE) / 1000 AS na_prob
  FROM answered)
"""


def _sql_scores(version: int) -> str:
    """CTEs ending in ``scored(qid, has_ans, pos, prediction, na_prob, exact, f1)``."""
    keep = "WHERE gold <> ''" if version == 2 else ""
    fallback = (
        "UNION ALL SELECT qid, 0 AS gi, '' AS gold FROM qa WHERE qid NOT IN (SELECT qid FROM named WHERE gold <> '')"
        if version == 2
        else ""
    )
    empty = "CASE WHEN gn = 0 AND pn = 0 THEN 1.0 ELSE 0.0 END" if version == 2 else "0.0"
    return f"""{SQL_QA},
raw AS (SELECT qid, unnest(range(len(golds))) AS gi, unnest(golds) AS g FROM qa),
named AS (SELECT qid, gi, {sql_normalize('g')} AS gold FROM raw),
gold AS (SELECT qid, gi, gold FROM named {keep} {fallback}),
np AS (SELECT qid, {sql_normalize('prediction')} AS p FROM pred),
gt AS (SELECT qid, gi, tok, count(*) AS c FROM
        (SELECT qid, gi, unnest(string_split(gold, ' ')) AS tok FROM gold) WHERE tok <> '' GROUP BY ALL),
pt AS (SELECT qid, tok, count(*) AS c FROM
        (SELECT qid, unnest(string_split(p, ' ')) AS tok FROM np) WHERE tok <> '' GROUP BY ALL),
gs AS (SELECT qid, gi, sum(c) AS n FROM gt GROUP BY ALL),
ps AS (SELECT qid, sum(c) AS n FROM pt GROUP BY ALL),
common AS (SELECT gt.qid, gi, sum(least(gt.c, pt.c)) AS h FROM gt JOIN pt USING (qid, tok) GROUP BY ALL),
pairs AS (
  SELECT gold.qid, gold.gi, CAST(gold = p AS INT) AS em, CAST(coalesce(gs.n, 0) AS DOUBLE) AS gn,
         CAST(coalesce(ps.n, 0) AS DOUBLE) AS pn, CAST(coalesce(h, 0) AS DOUBLE) AS h
  FROM gold JOIN np USING (qid) LEFT JOIN gs ON gs.qid = gold.qid AND gs.gi = gold.gi
  LEFT JOIN ps ON ps.qid = gold.qid LEFT JOIN common ON common.qid = gold.qid AND common.gi = gold.gi),
best AS (
  SELECT qid, max(em) AS exact,
         max(CASE WHEN gn = 0 OR pn = 0 THEN {empty} WHEN h = 0 THEN 0.0
                  ELSE 2 * (h / pn) * (h / gn) / ((h / pn) + (h / gn)) END) AS f1
  FROM pairs GROUP BY qid),
scored AS (
  SELECT qid, has_ans, pos, prediction, na_prob, coalesce(exact, 0) AS exact,
         CAST(coalesce(f1, 0.0) AS DOUBLE) AS f1
  FROM qa JOIN pred USING (qid) LEFT JOIN best USING (qid))
"""


_V1, _V2 = _sql_scores(1), _sql_scores(2)

_SQL_WALK = f"""{_V2},
gains AS (
  SELECT *, CASE WHEN has_ans THEN CAST(exact AS DECIMAL(26,12)) WHEN prediction <> '' THEN -1 ELSE 0 END AS ge,
            CASE WHEN has_ans THEN CAST(f1 AS DECIMAL(26,12)) WHEN prediction <> '' THEN -1 ELSE 0 END AS gf FROM scored),
walk AS (
  SELECT *, sum(ge) OVER w AS ce, sum(gf) OVER w AS cf FROM gains
  WINDOW w AS (ORDER BY na_prob, pos ROWS UNBOUNDED PRECEDING)),
base AS (SELECT count(*) AS n0 FROM qa WHERE NOT has_ans),
te AS (SELECT ce AS top, na_prob AS at FROM walk ORDER BY ce DESC, na_prob, pos LIMIT 1),
tf AS (SELECT cf AS top, na_prob AS at FROM walk ORDER BY cf DESC, na_prob, pos LIMIT 1),
size AS (SELECT count(*) AS n FROM scored)
"""

_SQL_POINTS = f"""{_V2},
kinds AS (
  SELECT 'exact' AS kind, na_prob, CASE WHEN has_ans THEN CAST(exact AS DOUBLE) ELSE 0 END AS tp FROM scored
  UNION ALL SELECT 'f1', na_prob, CASE WHEN has_ans THEN f1 ELSE 0 END FROM scored
  UNION ALL SELECT 'oracle', na_prob, CASE WHEN has_ans THEN 1.0 ELSE 0 END FROM scored),
npos AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM qa WHERE has_ans),
groups AS (SELECT kind, na_prob, sum(tp) AS tp, count(*) AS n FROM kinds GROUP BY ALL),
points AS (
  SELECT kind, na_prob, tp, sum(tp) OVER w / sum(n) OVER w AS p, sum(tp) OVER w / (SELECT n FROM npos) AS r
  FROM groups WINDOW w AS (PARTITION BY kind ORDER BY na_prob ROWS UNBOUNDED PRECEDING))
"""

ORACLE = {
    "normalize_answer": f"SELECT doc_id, {sql_normalize('text')} AS normalized FROM documents",
    "squad_exact": f"WITH {_V2} SELECT qid, exact FROM scored",
    "squad_f1_v1": f"WITH {_V1} SELECT qid, round(f1, 6) AS f1 FROM scored",
    "squad_f1_v2": f"WITH {_V2} SELECT qid, round(f1, 6) AS f1 FROM scored",
    "squad_eval_v1": f"""WITH {_V1}
SELECT round(100 * avg(CAST(coalesce(exact, 0) AS DOUBLE)), 6) AS exact_match, round(100 * avg(coalesce(f1, 0.0)), 6) AS f1,
       count(*) AS total FROM qa LEFT JOIN scored USING (qid)""",
    "na_threshold": f"""WITH {_V2}
SELECT qid, CASE WHEN na_prob > {SWEEP_THRESHOLD} THEN (CASE WHEN has_ans THEN 0.0 ELSE 1.0 END) ELSE CAST(exact AS DOUBLE) END AS exact,
       round(CASE WHEN na_prob > {SWEEP_THRESHOLD} THEN (CASE WHEN has_ans THEN 0.0 ELSE 1.0 END) ELSE f1 END, 6) AS f1 FROM scored""",
    "squad_eval_v2": f"""WITH {_V2}
SELECT CASE WHEN grouping(has_ans) = 1 THEN 'overall' WHEN has_ans THEN 'HasAns' ELSE 'NoAns' END AS part,
       round(100 * avg(CAST(exact AS DOUBLE)), 6) AS exact, round(100 * avg(f1), 6) AS f1, count(*) AS total
FROM scored GROUP BY GROUPING SETS ((), (has_ans))""",
    "missing_preds": f"WITH {SQL_QA} SELECT qid FROM qa WHERE qid NOT IN (SELECT qid FROM pred)",
    "best_thresh": f"""WITH {_SQL_WALK}
SELECT round(100.0 * CAST(n0 + greatest(te.top, 0) AS DOUBLE) / n, 6) AS best_exact,
       CASE WHEN te.top > 0 THEN te.at ELSE 0.0 END AS best_exact_thresh,
       round(100.0 * CAST(n0 + greatest(tf.top, 0) AS DOUBLE) / n, 6) AS best_f1,
       CASE WHEN tf.top > 0 THEN tf.at ELSE 0.0 END AS best_f1_thresh
FROM base, te, tf, size""",
    "pr_curve": f"""WITH {_SQL_POINTS}
SELECT kind, na_prob, round(p, 6) AS precision, round(r, 6) AS recall FROM points
UNION ALL SELECT kind, CAST(NULL AS DOUBLE), CAST(1.0 AS DOUBLE), CAST(0.0 AS DOUBLE) FROM (SELECT DISTINCT kind FROM kinds)""",
    "average_precision": f"""WITH {_SQL_POINTS}
SELECT kind, round(100 * sum(p * tp) / (SELECT n FROM npos), 6) AS ap FROM points GROUP BY kind""",
    "na_hist": f"""WITH {_V2},
h AS (SELECT CASE WHEN has_ans THEN 'HasAns' ELSE 'NoAns' END AS part,
             CAST(least(floor(na_prob * 20), 19) AS INT) AS bin FROM scored)
SELECT part, bin, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY part) AS DOUBLE), 6) AS proportion
FROM h GROUP BY part, bin""",
}
