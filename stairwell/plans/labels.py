"""Classification, tagging and translation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from stairwell.functions.arrays import argmax, pad_to
from stairwell.functions.text import BLEU_RULES, SPACE, WORD, space_tokens
from stairwell.operators import bleu, classify as cl, features as ft, tagging as tg
from stairwell.plans import views
from stairwell.plans.preparation import sentence_features, tag_features, translation_features
from stairwell.sources.conll import NER_TAGS, class_ids
from stairwell.sources.pairs import cross_language_splits
from stairwell.sources.translation import translation_pairs

LOGIT_CLASSES = 5
PAD_ID = 0
SUBWORD = 4  # characters per stand-in subword
MAX_TAGGED, MAX_PAIR, MAX_SOURCE, MAX_TARGET, PREFIX = 64, 96, 64, 32, "translate: "


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def _encode(spark, folder):
    docs = views.table(spark, folder, "documents").select("doc_id", "lang")
    return ft.encode_labels(docs, ft.label_vocabulary(docs, "lang"), "lang")


def _vocabulary(spark, folder):
    return ft.tag_vocabulary(views.tagged(spark, folder), "predicted")


def _declared(spark, folder):
    """Whole preparation of sentences whose tags are ids of declared classes; long words are cut into pieces."""
    lines = views.tagged(spark, folder).select(F.concat_ws("-", "doc_id", "line").alias("id"), "tokens", class_ids(F.col("ner_tags"), NER_TAGS).alias("ner_tags"))
    ready = tag_features(lines, max_length=MAX_TAGGED, piece_length=SUBWORD)
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), " ").alias(c)
    return ready.select("id", joined("tokens"), joined("labels"))


def _sentence_pairs(spark, folder):
    """Whole preparation of sentence pairs: every labelled document beside its language and source."""
    docs = views.table(spark, folder, "documents").select("doc_id", F.col("text").alias("sentence1"), F.concat_ws(" ", "lang", "source").alias("sentence2"))
    labelled = docs.join(views.table(spark, folder, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id")
    ready = sentence_features(labelled, "doc_id", max_length=MAX_PAIR)
    return ready.select("doc_id", F.array_join("tokens", " ").alias("tokens"), "label")


def _translated(spark, folder):
    """Whole preparation of translations, cut to their lengths."""
    ready = translation_features(views.translations(spark, folder), "src", "ref", PREFIX, MAX_SOURCE, MAX_TARGET, ["doc_id"])
    return ready.select("doc_id", *[F.array_join(c, " ").alias(c) for c in ("tokens", "labels")])


def _align(spark, folder):
    """Words cut into subwords of a few characters, with a special token at both ends."""
    rows = views.tagged(spark, folder)
    names = F.array(*[F.lit(t) for t in ("B-ORG", "B-PER", "I-ORG", "I-PER", "O")])
    ids = F.transform("ner_tags", lambda t: (F.array_position(names, t) - 1).cast("int"))
    pieces = F.flatten(
        F.transform("tokens", lambda w, i: F.array_repeat(i, F.ceil(F.length(w) / SUBWORD).cast("int")))
    )
    nothing = F.array(F.lit(None).cast("int"))
    ready = rows.select("doc_id", "line", ids.alias("ids"), F.concat(nothing, pieces, nothing).alias("words"))
    shown = lambda flag: F.array_join(ft.align_tags(F.col("ids"), F.col("words"), flag), " ")
    return ready.select("doc_id", "line", shown(False).alias("first_only"), shown(True).alias("all_tokens"))


def _mask(spark, folder):
    """Word lengths as label ids, padded with the pad id to the longest line of the document."""
    rows = views.sentences(spark, folder)
    lengths = rows.withColumn("ids", F.transform("tokens", lambda w: F.length(w)))
    longest = F.max(F.size("ids")).over(Window.partitionBy("doc_id"))
    padded = lengths.withColumn("longest", longest).withColumn("ids", pad_to(F.col("ids"), F.col("longest"), F.lit(PAD_ID)))
    masked = ft.mask_padding(F.col("ids"), PAD_ID)
    return padded.select(
        "doc_id",
        "line",
        F.array_join(masked, " ").alias("masked"),
        F.array_join(ft.unmask_padding(masked, PAD_ID), " ").alias("restored"),
        ft.non_pad_length(F.col("ids"), PAD_ID).alias("length"),
    )


def _argmax(spark, folder):
    vectors = views.table(spark, folder, "embeddings")
    coarse = F.transform("embedding", lambda v: F.floor(v * 16))
    return vectors.select("vec_id", argmax(F.col("embedding")).alias("best"), argmax(coarse).alias("best_coarse"))


def _terms(spark, folder):
    return ft.term_frequency(views.documents(spark, folder), space_tokens(F.col("text")))


def _accuracy(spark, folder):
    out = cl.accuracy(views.classified(spark, folder), "quality", "predicted")
    return _rounded(out, "accuracy")


def _split_accuracy(spark, folder):
    out = cl.accuracy(views.classified(spark, folder), "quality", "predicted", ["source"])
    return _rounded(out.withColumnRenamed("source", "split"), "accuracy")


def _language_accuracy(spark, folder):
    return _rounded(cl.accuracy(views.classified(spark, folder), "quality", "predicted", ["lang"]), "accuracy")


def _mse(spark, folder):
    return _rounded(cl.mse(views.classified(spark, folder), "quality", "predicted"), "mse")


def _matthews(spark, folder):
    return _rounded(cl.matthews(views.classified(spark, folder), "quality", "predicted"), "matthews_correlation")


def _binary(spark, folder):
    return _rounded(cl.binary_f1(views.classified(spark, folder), "quality", "predicted"), "accuracy", "f1")


def _pearson(spark, folder):
    return _rounded(cl.pearson(views.classified(spark, folder), "n_chars", "quality"), "pearson")


def _spearman(spark, folder):
    return _rounded(cl.spearman(views.classified(spark, folder), "n_chars", "quality"), "spearman")


def _combined(spark, folder):
    out = cl.task_metrics(views.classified(spark, folder), "n_chars", "quality", "stsb")
    return _rounded(out, *out.columns)


def _language_split(spark, folder):
    """Sources as splits: training rows in German, the others in French."""
    docs = views.table(spark, folder, "documents")
    split = F.when(F.col("source") == "src0", "train").otherwise("validation")
    return cross_language_splits(docs.withColumn("split", split), "fr", "de", lang="lang").select("doc_id", "lang", "split")


def _entities(spark, folder):
    out = tg.entity_scores(views.tagged(spark, folder), "ner_tags", "predicted")
    return _rounded(out, *out.columns)


def _entities_by_type(spark, folder):
    out = tg.entity_scores_by_type(views.tagged(spark, folder), "ner_tags", "predicted")
    return _rounded(out, "precision", "recall", "f1")


def _merge(spark, folder):
    """Accuracy and error per language, as if each language were a checkpoint."""
    rows = views.classified(spark, folder)
    hit = F.when(F.col("quality") == F.col("predicted"), 1.0).otherwise(0.0)
    per = rows.groupBy(F.col("lang").alias("step")).agg(F.avg(hit).alias("accuracy"), F.avg(1 - hit).alias("error"))
    pairs = F.array(*[F.struct(F.lit(n).alias("key"), F.round(n, 6).alias("value")) for n in ("accuracy", "error")])
    return cl.unify_checkpoints(per.select("step", F.inline(pairs)))


def _pairs(spark, folder):
    rows = views.translations(spark, folder)
    return translation_pairs(rows, "src_XX", "ref_XX", "translate: ", keys=["doc_id"])


def _bleu(spark, folder):
    pairs = translation_pairs(views.translations(spark, folder), "src", "ref", keys=["doc_id"])
    return bleu.corpus_bleu(pairs, "source", "target")


QUERIES = {
    "label_encode": _encode,
    "tag_vocab": _vocabulary,
    "tag_features": _declared,
    "sentence_features": _sentence_pairs,
    "translation_features": _translated,
    "align_tags": _align,
    "mask_labels": _mask,
    "argmax_label": _argmax,
    "term_frequency": _terms,
    "accuracy": _accuracy,
    "split_accuracy": _split_accuracy,
    "xlang_accuracy": _language_accuracy,
    "mse": _mse,
    "matthews": _matthews,
    "binary_f1": _binary,
    "pearson": _pearson,
    "spearman": _spearman,
    "combined_score": _combined,
    "xlang_split": _language_split,
    "tag_prf": _entities,
    "tag_prf_by_type": _entities_by_type,
    "metric_merge": _merge,
    "translation_pairs": _pairs,
    "corpus_bleu": _bleu,
}

# ---------------------------------------------------------------- checks in SQL

SQL_CLS = """
cls AS (
  SELECT doc_id, quality, lang, source, n_chars, CAST(n_chars % 3 > 0 AS INT) AS predicted
  FROM labels JOIN documents USING (doc_id))
"""

SQL_SENTENCES = f"""
lines AS (
  SELECT doc_id, unnest(range(len(l))) AS line, unnest(l) AS text
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
sent AS (
  SELECT doc_id, line, list_filter(regexp_split_to_array(text, '[{SPACE}]+'), lambda x: x <> '') AS tokens FROM lines),
word AS (
  SELECT doc_id, line, unnest(range(len(tokens))) AS i, unnest(tokens) AS tok FROM sent),
typed AS (
  SELECT *, regexp_matches(tok, '^\\p{{Lu}}') AS cap, CASE WHEN length(tok) > 6 THEN 'ORG' ELSE 'PER' END AS ty FROM word),
prior AS (
  SELECT *, lag(cap) OVER w AS pcap, lag(ty) OVER w AS pty FROM typed
  WINDOW w AS (PARTITION BY doc_id, line ORDER BY i)),
golden AS (
  SELECT *, CASE WHEN NOT cap THEN 'O' WHEN pcap AND pty = ty THEN 'I-' || ty ELSE 'B-' || ty END AS gold FROM prior),
tags AS MATERIALIZED (
  SELECT doc_id, line, i, tok, gold,
         CASE (doc_id + line + i) % 7 WHEN 0 THEN 'O' WHEN 3 THEN 'B-LOC'
              WHEN 5 THEN CASE WHEN gold = 'O' THEN 'I-PER' ELSE gold END ELSE gold END AS pred
  FROM golden)
"""


def _sql_chunks(column: str, name: str) -> str:
    return f"""
{name}_s AS (
  SELECT doc_id, line, i, {column} AS t, lag({column}) OVER w AS q
  FROM tags WINDOW w AS (PARTITION BY doc_id, line ORDER BY i)),
{name}_n AS (
  SELECT *, sum(CASE WHEN t <> 'O' AND (q IS NULL OR q = 'O' OR t LIKE 'B-%' OR substring(q, 3) <> substring(t, 3)) THEN 1 ELSE 0 END)
            OVER (PARTITION BY doc_id, line ORDER BY i) AS c FROM {name}_s),
{name} AS (
  SELECT doc_id, line, any_value(substring(t, 3)) AS type, min(i) AS b, max(i) AS e
  FROM {name}_n WHERE t <> 'O' GROUP BY doc_id, line, c)"""


SQL_CHUNKS = f"""{SQL_SENTENCES},{_sql_chunks('gold', 'gc')},{_sql_chunks('pred', 'pc')},
hit AS (SELECT gc.* FROM gc JOIN pc USING (doc_id, line, type, b, e))
"""


def _sql_prf(c: str, f: str, s: str) -> str:
    p = f"(CASE WHEN {f} > 0 THEN CAST({c} AS DOUBLE) / {f} ELSE CAST(0 AS DOUBLE) END)"
    r = f"(CASE WHEN {s} > 0 THEN CAST({c} AS DOUBLE) / {s} ELSE CAST(0 AS DOUBLE) END)"
    f1 = f"CASE WHEN {p} + {r} > 0 THEN 2 * {p} * {r} / ({p} + {r}) ELSE CAST(0 AS DOUBLE) END"
    return f"round({p}, 6) AS precision, round({r}, 6) AS recall, round({f1}, 6) AS f1"


def _sql_bleu_tokens(text: str) -> str:
    out = f"regexp_replace({text}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"
    for old, new in BLEU_RULES:
        out = f"replace({out}, '{old}', '{new}')"
    out = f"(' ' || {out} || ' ')"
    for pattern, replacement in (
        (r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 "),
        (r"([^0-9])([\.,])", r"\1 \2 "),
        (r"([\.,])([^0-9])", r" \1 \2"),
        (r"([0-9])(-)", r"\1 \2 "),
    ):
        out = f"regexp_replace({out}, '{pattern}', '{replacement}', 'g')"
    return f"list_filter(regexp_split_to_array({out}, '[{SPACE}]+'), lambda x: x <> '')"


SQL_PAIRS = """
pairs AS (
  SELECT doc_id, text AS ref, array_to_string(list_filter(string_split(text, ' '), lambda w: length(w) < 10), ' ') AS cand
  FROM documents)
"""

_SQL_RANKS = f"""{SQL_CLS},
ranks AS (
  SELECT rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0 AS rx,
         rank() OVER (ORDER BY quality) + (count(*) OVER (PARTITION BY quality) - 1) / 2.0 AS ry FROM cls)
"""


SQL_GRAMS = f"""{SQL_PAIRS},
toks AS MATERIALIZED (SELECT doc_id, {_sql_bleu_tokens('cand')} AS p, {_sql_bleu_tokens('ref')} AS r FROM pairs),
word AS (
  SELECT doc_id, 'p' AS side, unnest(range(len(p))) AS i, unnest(p) AS w FROM toks
  UNION ALL SELECT doc_id, 'r', unnest(range(len(r))), unnest(r) FROM toks),
run AS (
  SELECT doc_id, side, w AS g1, w || ' ' || lead(w, 1) OVER o AS g2, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o AS g3,
         w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o AS g4
  FROM word WINDOW o AS (PARTITION BY doc_id, side ORDER BY i)),
gram AS (
  SELECT doc_id, side, unnest([1, 2, 3, 4]) AS n, unnest([g1, g2, g3, g4]) AS g FROM run),
tally AS (
  SELECT doc_id, n, g, count(*) FILTER (WHERE side = 'p') AS p, count(*) FILTER (WHERE side = 'r') AS r
  FROM gram WHERE g IS NOT NULL GROUP BY ALL),
size AS (SELECT n, CAST(sum(least(p, r)) AS DOUBLE) AS m, CAST(sum(p) AS DOUBLE) AS t FROM tally GROUP BY n)
"""


def _sql_size(n: int) -> str:
    return f"m{n} AS (SELECT m FROM size WHERE n = {n}), t{n} AS (SELECT t FROM size WHERE n = {n})"


_SMOOTH = (
    "CASE WHEN m1.m = 0 OR t4.t = 0 THEN 0 ELSE bp * exp(("
    + " + ".join(f"ln(100 * (CASE WHEN m{n}.m = 0 THEN 0.5 ELSE m{n}.m END) / t{n}.t)" for n in bleu.ORDERS)
    + ") / 4) END"
)

ORACLE = {
    "label_encode": """WITH v AS (SELECT lang, CAST(row_number() OVER (ORDER BY lang) - 1 AS INT) AS label_id FROM (SELECT DISTINCT lang FROM documents))
SELECT doc_id, lang, label_id FROM documents JOIN v USING (lang)""",
    "tag_vocab": f"""WITH {SQL_SENTENCES}
SELECT pred AS tag, CAST(row_number() OVER (ORDER BY pred) - 1 AS INT) AS tag_id FROM (SELECT DISTINCT pred FROM tags)""",
    "tag_features": f"""WITH {SQL_SENTENCES},
sub AS (
  SELECT doc_id, line, i, tok, gold, unnest(range(CAST(ceil(length(tok) / {SUBWORD}.0) AS BIGINT))) AS k FROM tags),
cut AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY i, k) AS place FROM sub QUALIFY place <= {MAX_TAGGED - 2}),
lab AS (
  SELECT doc_id, line, string_agg(substring(tok, k * {SUBWORD} + 1, {SUBWORD}), ' ' ORDER BY place) AS t,
         string_agg(CASE WHEN k = 0 THEN CAST(list_position({list(NER_TAGS)}, gold) - 1 AS VARCHAR) ELSE '{ft.IGNORED}' END, ' ' ORDER BY place) AS l
  FROM cut GROUP BY ALL)
SELECT sent.doc_id || '-' || sent.line AS id, concat_ws(' ', '[CLS]', t, '[SEP]') AS tokens, concat_ws(' ', '{ft.IGNORED}', l, '{ft.IGNORED}') AS labels
FROM sent LEFT JOIN lab USING (doc_id, line)""",
    "sentence_features": f"""WITH t AS (
  SELECT doc_id, quality, lang, source, regexp_extract_all(text, '[{WORD}]+|[^{WORD}{SPACE}]') AS w FROM documents JOIN labels USING (doc_id))
SELECT doc_id, CAST(quality AS INT) AS label,
       concat_ws(' ', '[CLS]', nullif(array_to_string(list_slice(w, 1, least(len(w), {MAX_PAIR - 5})), ' '), ''), '[SEP]', lang, source, '[SEP]') AS tokens FROM t""",
    "translation_features": f"""WITH p AS (
  SELECT doc_id, text AS ref, '{PREFIX}' || array_to_string(list_filter(string_split(text, ' '), lambda w: length(w) < 10), ' ') AS src FROM documents)
SELECT doc_id, array_to_string(list_slice(list_filter(regexp_split_to_array(src, '[{SPACE}]+'), lambda x: x <> ''), 1, {MAX_SOURCE}), ' ') AS tokens,
       array_to_string(list_slice(list_filter(regexp_split_to_array(ref, '[{SPACE}]+'), lambda x: x <> ''), 1, {MAX_TARGET}), ' ') AS labels FROM p""",
    "align_tags": f"""WITH {SQL_SENTENCES},
sub AS (
  SELECT doc_id, line, i, unnest(range(CAST(ceil(length(tok) / {SUBWORD}.0) AS BIGINT))) AS k,
         list_position(['B-ORG', 'B-PER', 'I-ORG', 'I-PER', 'O'], gold) - 1 AS id FROM tags),
agg AS (
  SELECT doc_id, line, string_agg(CASE WHEN k = 0 THEN id ELSE -100 END, ' ' ORDER BY i, k) AS f,
         string_agg(id, ' ' ORDER BY i, k) AS a FROM sub GROUP BY ALL)
SELECT doc_id, line, '-100 ' || coalesce(f || ' ', '') || '-100' AS first_only, '-100 ' || coalesce(a || ' ', '') || '-100' AS all_tokens
FROM sent LEFT JOIN agg USING (doc_id, line)""",
    "mask_labels": f"""WITH {SQL_SENTENCES},
p AS (SELECT doc_id, line, list_resize(list_transform(tokens, lambda w: length(w)), max(len(tokens)) OVER (PARTITION BY doc_id), 0) AS ids FROM sent)
SELECT doc_id, line, array_to_string(list_transform(ids, lambda v: CASE WHEN v = 0 THEN -100 ELSE v END), ' ') AS masked,
       array_to_string(ids, ' ') AS restored, len(list_filter(ids, lambda v: v <> 0)) AS length FROM p""",
    "argmax_label": """SELECT vec_id, list_position(embedding, list_max(embedding)) - 1 AS best,
list_position(list_transform(embedding, lambda v: floor(CAST(v AS DOUBLE) * 16)), list_max(list_transform(embedding, lambda v: floor(CAST(v AS DOUBLE) * 16)))) - 1 AS best_coarse
FROM embeddings""",
    "term_frequency": f"""SELECT term, count(*) AS n FROM (
SELECT unnest(list_filter(regexp_split_to_array(text, '[{SPACE}]+'), lambda x: x <> '')) AS term FROM documents) GROUP BY term""",
    "accuracy": f"""WITH {SQL_CLS}
SELECT round(avg(CAST(quality = predicted AS DOUBLE)), 6) AS accuracy, count(*) AS samples FROM cls""",
    "split_accuracy": f"""WITH {SQL_CLS}
SELECT source AS split, round(avg(CAST(quality = predicted AS DOUBLE)), 6) AS accuracy, count(*) AS samples FROM cls GROUP BY source""",
    "xlang_accuracy": f"""WITH {SQL_CLS}
SELECT lang, round(avg(CAST(quality = predicted AS DOUBLE)), 6) AS accuracy, count(*) AS samples FROM cls GROUP BY lang""",
    "mse": f"WITH {SQL_CLS} SELECT round(avg(CAST((quality - predicted) * (quality - predicted) AS DOUBLE)), 6) AS mse FROM cls",
    "matthews": f"""WITH {SQL_CLS},
m AS (
  SELECT CAST(count(*) FILTER (WHERE quality = 1 AND predicted = 1) AS DOUBLE) AS tp, CAST(count(*) FILTER (WHERE quality = 0 AND predicted = 1) AS DOUBLE) AS fp,
         CAST(count(*) FILTER (WHERE quality = 1 AND predicted = 0) AS DOUBLE) AS fn, CAST(count(*) FILTER (WHERE quality = 0 AND predicted = 0) AS DOUBLE) AS tn FROM cls)
SELECT round(CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) = 0 THEN 0
             ELSE (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) END, 6) AS matthews_correlation FROM m""",
    "binary_f1": f"""WITH {SQL_CLS},
m AS (SELECT CAST(count(*) FILTER (WHERE quality = 1 AND predicted = 1) AS DOUBLE) AS tp, count(*) FILTER (WHERE quality <> predicted) AS wrong, count(*) AS n FROM cls)
SELECT round(CAST(n - wrong AS DOUBLE) / n, 6) AS accuracy, round(CASE WHEN 2 * tp + wrong = 0 THEN 0 ELSE 2 * tp / (2 * tp + wrong) END, 6) AS f1 FROM m""",
    "pearson": f"WITH {SQL_CLS} SELECT round(corr(CAST(n_chars AS DOUBLE), CAST(quality AS DOUBLE)), 6) AS pearson FROM cls",
    "spearman": f"WITH {_SQL_RANKS} SELECT round(corr(CAST(rx AS DOUBLE), CAST(ry AS DOUBLE)), 6) AS spearman FROM ranks",
    "combined_score": f"""WITH {_SQL_RANKS},
v AS (SELECT (SELECT corr(CAST(n_chars AS DOUBLE), CAST(quality AS DOUBLE)) FROM cls) AS p, (SELECT corr(CAST(rx AS DOUBLE), CAST(ry AS DOUBLE)) FROM ranks) AS s)
SELECT round(p, 6) AS pearson, round(s, 6) AS spearman, round((p + s) / 2, 6) AS combined_score FROM v""",
    "xlang_split": """SELECT doc_id, lang, CASE WHEN source = 'src0' THEN 'train' ELSE 'validation' END AS split FROM documents
WHERE lang = CASE WHEN source = 'src0' THEN 'de' ELSE 'fr' END""",
    "tag_prf": f"""WITH {SQL_CHUNKS},
n AS (SELECT (SELECT count(*) FROM hit) AS c, (SELECT count(*) FROM pc) AS f, (SELECT count(*) FROM gc) AS s)
SELECT {_sql_prf('c', 'f', 's')}, (SELECT round(avg(CAST(gold = pred AS DOUBLE)), 6) FROM tags) AS accuracy FROM n""",
    "tag_prf_by_type": f"""WITH {SQL_CHUNKS},
n AS (
  SELECT type, sum(c) AS c, sum(f) AS f, CAST(sum(s) AS BIGINT) AS s FROM (
    SELECT type, 1 AS c, 0 AS f, 0 AS s FROM hit UNION ALL SELECT type, 0, 1, 0 FROM pc UNION ALL SELECT type, 0, 0, 1 FROM gc)
  GROUP BY type)
SELECT type, {_sql_prf('c', 'f', 's')}, s AS number FROM n""",
    "metric_merge": f"""WITH {SQL_CLS},
s AS (SELECT lang, avg(CAST(quality = predicted AS DOUBLE)) AS a, avg(CAST(quality <> predicted AS DOUBLE)) AS e FROM cls GROUP BY lang)
SELECT 'accuracy_' || lang AS key, round(a, 6) AS value FROM s UNION ALL SELECT 'error_' || lang, round(e, 6) FROM s""",
    "translation_pairs": f"WITH {SQL_PAIRS} SELECT doc_id, 'translate: ' || cand AS source, ref AS target FROM pairs",
    "corpus_bleu": f"""WITH {SQL_GRAMS},
{', '.join(_sql_size(n) for n in bleu.ORDERS)},
len_ AS (SELECT CAST(sum(len(p)) AS DOUBLE) AS sys, CAST(sum(len(r)) AS DOUBLE) AS ref, avg(len(p)) AS g FROM toks),
bp AS (SELECT CASE WHEN sys < ref THEN exp(1 - ref / sys) ELSE 1 END AS bp, g FROM len_)
SELECT round({_SMOOTH}, 4) AS bleu, round(g, 4) AS gen_len FROM bp, m1, m2, m3, m4, t1, t2, t3, t4""",
}
