"""The registered queries of the operators, and their SQL where SQL can say the same."""

from __future__ import annotations

import string
import uuid

import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stairwell.llm import binary_codes, license_scan, lsh_forest, packing, periodic_runs, quality_rules, semantic_votes, toxic_spans
from stairwell.llm.byte_pairs import ByteBpe
from stairwell.llm.common import shared_folder, stored
from stairwell.llm.merkle_manifest import MerkleManifest, leaf_digest
from stairwell.llm.subword_lattice import SubwordLattice
from stairwell.llm.suffix_repeats import SuffixRepeats
from stairwell.llm.token_rollups import TokenRollups


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _fold(folds: int, held_out: int):
    """Whether a document's label is withheld."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == held_out, F.lit(False))


def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document, learnt from the labels outside the held-out third, with the offending spans."""
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    model = toxic_spans.fit(docs, _table(spark, folder, "labels").where(~_fold(3, 1)))
    scored = toxic_spans.add_toxicity(docs, model)
    return scored.select("doc_id", _fold(3, 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "spans")


def op10_quality_votes(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of every document, learnt from the labels outside the held-out quarter."""
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    model = semantic_votes.fit(docs, _table(spark, folder, "labels").where(~_fold(4, 2)))
    scored = semantic_votes.add_score(docs, model)
    return scored.select("doc_id", _fold(4, 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op2_binary_codes(spark: SparkSession, folder: str) -> DataFrame:
    """Classes of near-copies among all embeddings: cosine 0.9."""
    return binary_codes.near_duplicates(_table(spark, folder, "embeddings"), threshold=0.9)


# Tokenizer versions whose counts Java's, and the check's, regular expressions can make.
_COUNTED = {"words-1": r"[^\x20\x09-\x0D]+", "words-2": r"[\p{L}]+|[\p{N}]+|[^\x20\x09-\x0D\p{L}\p{N}]"}


def _token_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, source, lang, tokenizer, whole, short): tokens of every text, and of its distinct lines; no text goes further. Stored."""
    text = F.coalesce("text", F.lit(""))
    lines = F.split(text, "\n")
    count = lambda t, p: F.size(F.regexp_extract_all(t, F.lit(p), F.lit(0))).cast("long")
    again = F.size(F.array_distinct(lines)) < F.size(lines)
    short = lambda p: F.when(again, count(F.array_join(F.array_distinct(lines), "\n"), p))
    counts = [F.struct(F.lit(v).alias("tokenizer"), count(text, p).alias("whole"), short(p).alias("short")) for v, p in _COUNTED.items()]
    rows = stored(docs.select("doc_id", "source", "lang", F.array(*counts).alias("counts")), "token-counts")
    rows = rows.select("doc_id", "source", "lang", F.explode("counts").alias("c")).select("doc_id", "source", "lang", "c.*")
    return rows.withColumn("short", F.coalesce("short", "whole"))


def op3_token_rollups(spark: SparkSession, folder: str) -> DataFrame:
    """Token totals after three batches: all documents come in; those labelled toxic go, and those of low quality are
    counted again without repeated lines; the first batch is delivered once more and changes nothing."""
    docs, labels = _table(spark, folder, "documents"), _table(spark, folder, "labels")
    counts = _token_counts(docs)
    marks = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    marked = counts.join(marks.where("toxic = 1 or quality = 0"), "doc_id")
    change = lambda df, n, op: df.select("doc_id", "source", "lang", "tokenizer", n.alias("n_tokens"), F.lit(op).alias("op"), F.lit(0).alias("seq"))
    arrive = change(counts, F.col("whole"), "insert")
    gone = change(marked.where("toxic = 1"), F.lit(0).cast("long"), "delete")
    again = change(marked.where("toxic is null or toxic = 0"), F.col("short"), "revise")
    rollups = TokenRollups(spark, f"{shared_folder(spark)}/rollups-{uuid.uuid4().hex}")
    for batch, changes in ((0, arrive), (1, gone.unionByName(again)), (0, arrive)):
        rollups.commit(batch, changes)
    return rollups.totals(2)


def op6_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Every document that covers four fifths of a license notice or text."""
    return license_scan.scan(_table(spark, folder, "documents"), license_scan.TEMPLATES)


def op4_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Base counts of every document and the verdict of the risk-controlled rules, strata by language."""
    docs = quality_rules.with_stratum(_table(spark, folder, "documents").select("doc_id", "text", "lang"))
    counts = quality_rules.add_base_counts(docs).drop("text", "lang")
    counts = stored(counts, "quality-counts")
    cutoffs = quality_rules.choose_cutoffs(counts, _table(spark, folder, "labels"))
    return quality_rules.judge(counts, cutoffs).select("doc_id", *quality_rules.COUNTS, "base_failed", "kept")


def op5_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's pieces and their places in sequences of 2048 tokens."""
    return packing.pack_documents(_table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_suffix_repeats(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the bytes of 100-byte strings that start earlier, as counts and a digest."""
    cut = SuffixRepeats(_table(spark, folder, "documents"), least=100).cut()
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_lsh_forest(spark: SparkSession, folder: str) -> DataFrame:
    """Classes of near-copies: three-word shingles, similarity 0.85."""
    return lsh_forest.near_duplicates(_table(spark, folder, "documents"), width=3, percent=85)


def op9_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every document and the bytes they decode to, as digests."""
    model = ByteBpe(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    coded = model.encode(_table(spark, folder, "documents"), decoded=True)
    return coded.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )


def op11_subword_lattice(spark: SparkSession, folder: str) -> DataFrame:
    """Log10 probability of every document by all segmentations of its words, learnt outside the held-out seventh."""
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    model = SubwordLattice(docs, public_tokenizers.path("piece_bpe_32k.model"), learn=~_fold(7, 2))
    return model.score().select("doc_id", _fold(7, 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def _with_repetitions(text: pd.Series, crc: pd.Series) -> pd.Series:
    """Texts whose crc ends in 0 repeat, from a word on, a few words of theirs up to their end."""
    out = []
    for t, h in zip(text, crc, strict=True):
        words = periodic_runs.words_of(t) if h is not None and h % 10 == 0 else []
        if n := len(words):
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            t = b" ".join(words[:a] + [words[a + i % p] for i in range(n - a)]).decode()
        out.append(t)
    return pd.Series(out, dtype=object)


def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Periodic runs of words in every document, of which a tenth gets one of its own."""
    crc = F.coalesce(F.crc32(F.col("doc_id").cast("string")), F.lit(1).cast("long"))
    repeat = F.pandas_udf(_with_repetitions, "string")
    docs = _table(spark, folder, "documents").select("doc_id", repeat("text", crc).alias("text"))
    digest = lambda c: F.sha2(c, 256).alias(f"{c}_sha256")
    return periodic_runs.add_runs(docs).select("doc_id", *periodic_runs.RESULTS[:5], digest("runs"), digest("collapsed"))


def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's leaf, proof and verdict in a manifest of a tree per language; a third is tampered with after it was made."""
    docs = _table(spark, folder, "documents")
    before = ["doc_id", "source", "lang", "n_chars"]
    digest = lambda text: leaf_digest([*map(F.col, before), text])
    third = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    leaves = docs.select("doc_id", "lang", digest(F.col("text")).alias("leaf"), F.when(third, digest(lower)).alias("tampered"))
    out = MerkleManifest(leaves, "lang", "doc_id", "leaf", ["tampered"]).proofs(changed="tampered")
    return out.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def _op13_sql(levels: int = 11) -> str:
    """The same manifest level by level, for up to 8^levels documents of a language."""
    field = lambda c: f"coalesce(CAST(octet_length(encode({c})) AS VARCHAR) || ':' || {c}, '-')"
    fields = " || ".join(field(c) for c in ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)"))
    leaf = lambda text: f"sha256({fields} || {field(text)})"
    lower = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    steps = "flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda s: [CAST(ord(s) AS UBIGINT), 0, 0, 0, 0, 0, 0, 0]))"
    bit = "xor(xor(c, x) >> 1, CAST(3988292384 AS UBIGINT) * (xor(c, x) & 1))"
    crc = f"xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), {steps}), lambda c, x: {bit}), CAST(4294967295 AS UBIGINT))"
    sql = f"""WITH d AS (SELECT *, {leaf("text")} AS leaf, CASE WHEN {crc} % 3 = 0 THEN {leaf(lower)} END AS tampered FROM documents),
a0 AS (SELECT coalesce('=' || lang, '') AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
       count(*) OVER (PARTITION BY lang) AS n, leaf AS digest, doc_id, leaf, tampered FROM d)"""
    for side, base in (("a", "a"), ("b", "b")):
        if side == "b":
            sql += f""",
b0 AS (SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n, digest, tree AS name FROM a{levels})"""
        for k in range(levels):
            near = f"array_to_string(list(digest) OVER (PARTITION BY tree, pos // 8 ORDER BY pos ROWS BETWEEN "
            sql += f""",
{base}p{k} AS (SELECT tree, pos, n, CASE WHEN n > 1 THEN coalesce({near}UNBOUNDED PRECEDING AND 1 PRECEDING), ''), '') END AS l,
        CASE WHEN n > 1 THEN coalesce({near}1 FOLLOWING AND UNBOUNDED FOLLOWING), ''), '') END AS r FROM {base}{k}),
{base}{k + 1} AS (SELECT tree, pos // 8 AS pos, (n + 7) // 8 AS n, CASE WHEN n = 1 THEN min(digest) ELSE sha256(string_agg(digest, '' ORDER BY pos)) END AS digest
        FROM {base}{k} GROUP BY tree, pos // 8, n)"""
    # Siblings are gathered and folded leaf by leaf.
    sql += """,
f0 AS (SELECT a0.tree, a0.pos, doc_id, leaf, coalesce(tampered, leaf) AS fold, '' AS proof FROM a0)"""
    for k in range(levels):
        sql += f""",
f{k + 1} AS (SELECT f{k}.tree, f{k}.pos // 8 AS pos, doc_id, leaf, CASE WHEN p.l IS NULL THEN fold ELSE sha256(p.l || fold || p.r) END AS fold,
        proof || coalesce(p.l || p.r, '') AS proof FROM f{k} JOIN ap{k} p ON f{k}.tree = p.tree AND f{k}.pos = p.pos)"""
    sql += f""",
g0 AS (SELECT f.*, a{levels}.digest AS subroot, b0.pos AS place FROM f{levels} f JOIN a{levels} ON f.tree = a{levels}.tree JOIN b0 ON f.tree = b0.name)"""
    for k in range(levels):
        sql += f""",
g{k + 1} AS (SELECT g.tree, doc_id, leaf, subroot, g.place // 8 AS place, CASE WHEN p.l IS NULL THEN fold ELSE sha256(p.l || fold || p.r) END AS fold,
        proof || coalesce(p.l || p.r, '') AS proof FROM g{k} g JOIN bp{k} p ON g.place = p.pos)"""
    return f"""{sql}
SELECT doc_id, leaf, subroot, b{levels}.digest AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = b{levels}.digest AS verified
FROM g{levels}, b{levels}"""


def _op4_sql() -> str:
    """The same counts by unnested words and windows; the binomial sums by the logarithm of the gamma function."""
    cuts = ", ".join(
        f"('{rule}', '{measure}', {j}, {c}, {str(low).lower()})"
        for rule, (measure, values, low) in quality_rules.RULES.items()
        for j, c in enumerate(values)
    )
    blank = r"[\x20\x09-\x0D]"
    return f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws FROM d),
lines AS (SELECT doc_id, x FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n FROM lines GROUP BY doc_id),
win AS (SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 7), ' ') AS x FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, x) AS n FROM win) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM rep, (SELECT unnest(range(0, 8)) AS o) GROUP BY doc_id),
c AS (SELECT w.doc_id, stratum, CAST(len(ws) AS BIGINT) AS n_words,
        CAST(length(regexp_replace(t, '{blank}+', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c),
cuts(rule, measure, j, c, low) AS (VALUES {cuts}),
v AS (SELECT b.*, rule, j, 100 * CASE measure WHEN 'n_symbols' THEN n_symbols WHEN 'n_dup_lines' THEN n_dup_lines
        WHEN 'n_repeat_words' THEN n_repeat_words ELSE word_chars END AS value, c * n_words AS bound, low FROM b, cuts),
f AS (SELECT *, CASE WHEN low THEN value < bound ELSE value > bound END AS fires FROM v),
good AS (SELECT f.* FROM f WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)),
k AS (SELECT stratum, rule, j, count(*) AS n, count(*) FILTER (WHERE fires) AS k FROM good GROUP BY stratum, rule, j),
p AS (SELECT k.*, (SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.01) + (n - i) * ln(0.99)))
        FROM (SELECT unnest(range(0, k.k + 1)) AS i)) AS tail, (SELECT count(DISTINCT stratum) FROM k) * (SELECT count(*) FROM cuts) AS m FROM k),
chosen AS (SELECT stratum, rule, min(j) AS j FROM p WHERE k <= floor(0.01 * n) AND tail <= 0.05 / m GROUP BY stratum, rule),
bad AS (SELECT DISTINCT f.doc_id FROM f JOIN chosen USING (stratum, rule, j) WHERE fires)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM bad) AS kept FROM b"""


_OP3_SQL = """
WITH m AS (SELECT doc_id, max(toxic) AS toxic, min(quality) AS quality FROM labels GROUP BY doc_id),
d AS (SELECT documents.*, toxic, quality FROM documents LEFT JOIN m USING (doc_id) WHERE coalesce(toxic, 0) <> 1),
t AS (SELECT doc_id, source, lang, CASE WHEN quality = 0 THEN list_distinct(string_split(coalesce(text, ''), chr(10)))
        ELSE [coalesce(text, '')] END AS parts FROM d),
p AS (SELECT doc_id, source, lang, unnest(parts) AS x FROM t),
c AS (SELECT doc_id, source, lang, 'words-1' AS tokenizer, len(regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+')) AS n FROM p
      UNION ALL SELECT doc_id, source, lang, 'words-2', len(regexp_extract_all(x, '[\\p{L}]+|[\\p{N}]+|[^\\x20\\x09-\\x0D\\p{L}\\p{N}]')) FROM p)
SELECT source, lang, tokenizer, count(DISTINCT doc_id) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tokens FROM c GROUP BY ALL"""

_OP2_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE len(embedding) = len(list_filter(embedding, lambda x: isfinite(x))) AND list_max(list_transform(embedding, lambda x: abs(x))) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
r(a, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.c = l.a)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = vec_id) AS n_links, component_id, vec_id = component_id AS kept
FROM (SELECT a AS vec_id, min(c) AS component_id FROM r GROUP BY a)"""

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_binary_codes": op2_binary_codes,
    "op3_token_rollups": op3_token_rollups,
    "op4_quality_rules": op4_quality_rules,
    "op5_packing": op5_packing,
    "op6_license_scan": op6_license_scan,
    "op7_suffix_repeats": op7_suffix_repeats,
    "op8_lsh_forest": op8_lsh_forest,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_quality_votes": op10_quality_votes,
    "op11_subword_lattice": op11_subword_lattice,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_merkle_manifest": op13_merkle_manifest,
}
ORACLE = {"op2_binary_codes": _OP2_SQL, "op3_token_rollups": _OP3_SQL, "op4_quality_rules": _op4_sql(), "op13_merkle_manifest": _op13_sql()}
