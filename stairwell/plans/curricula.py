"""Difficulty and curriculum queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from stairwell.operators import curriculum as cu, difficulty as di
from stairwell.operators.transport import sinkhorn_difficulty
from stairwell.plans import views
from stairwell.plans.training import score_examples

LEVELS, BATCH, SEED, EPOCHS = 3, 16, 42, 2
VECTOR_BATCH = 16


def _components(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    return df.select(*keys, F.posexplode(F.transform(vector, lambda v: F.round(v, 6))).alias("dim", "value"))


def _scaled(kind: str):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        vectors = views.table(spark, folder, "embeddings").select(
            "vec_id", di.batch_of("vec_id", VECTOR_BATCH), F.col("embedding").cast("array<double>").alias("x")
        )
        batch = "batch" if kind == "line" else None
        return _components(di.normalise(vectors, ["x"], kind, batch), ["vec_id"], "x")

    return run


def _kl(symmetric: bool):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        paired = di.normalise(views.hidden(spark, folder), ["x", "y"], "line")
        return _rounded(di.kl_difficulty(paired, "vec_id", symmetric))

    return run


def _rounded(df: DataFrame, name: str = "difficulty") -> DataFrame:
    return df.withColumn(name, F.round(name, 6))


def _batch_mean(spark, folder):
    paired = di.normalise(views.hidden(spark, folder), ["x", "y"], "line")
    scored = di.kl_difficulty(paired, "vec_id")
    out = di.batch_difficulty(scored, "vec_id", VECTOR_BATCH)
    return out.select("vec_id", "batch", F.round("batch_difficulty", 6).alias("difficulty"))


def _batch_tensor(spark, folder):
    """A batch scored as one tensor, scaled by its own extremes."""
    rows = views.hidden(spark, folder).withColumn("batch", di.batch_of("vec_id", VECTOR_BATCH))
    return _rounded(di.kl_difficulty(di.normalise(rows, ["x", "y"], "line", "batch"), "batch"))


def _sinkhorn(spark, folder):
    out = sinkhorn_difficulty(views.token_clouds(spark, folder))
    return out.select("idx", F.round("difficulty", 4).alias("difficulty"))


def _scored(spark, folder):
    """Whole scoring from hidden states: both layers of a token side by side, scaled by the extremes of the batch."""
    scored = score_examples(views.token_clouds(spark, folder), "kl", "line", batch_size=VECTOR_BATCH)
    return _rounded(scored)


def _moment(spark, folder):
    vectors = views.table(spark, folder, "embeddings")
    return _rounded(di.second_moment(vectors, "label", "embedding"), "value")


def _std(spark, folder):
    return _rounded(di.vector_std(views.table(spark, folder, "embeddings"), "embedding"), "std")


def _leveled(spark, folder):
    return cu.difficulty_levels(views.plain_difficulty(spark, folder), LEVELS)


def _levels(spark, folder):
    return _leveled(spark, folder)


def _uniform(spark, folder):
    return cu.distill_uniform(_leveled(spark, folder), LEVELS, SEED)


def _gated(spark, folder):
    return cu.distill_gated(_leveled(spark, folder), LEVELS, BATCH, SEED)


def _batches(spark, folder):
    units = cu.batch_levels(views.plain_difficulty(spark, folder), LEVELS, BATCH)
    kept = cu.distill_batches(units, LEVELS, BATCH, SEED)
    return kept.select("batch", "level", "examples", F.round("difficulty", 6).alias("difficulty"))


def _cumulative(spark, folder):
    return cu.cumulative_stages(_gated(spark, folder), LEVELS).select("stage", "level", "idx")


def _disjoint(spark, folder):
    return cu.disjoint_stages(_uniform(spark, folder)).select("stage", "level", "idx")


def _ordered(spark, folder):
    return cu.ordered_full_set(_leveled(spark, folder)).select("pos", "level", "idx")


def _ordered_stages(spark, folder):
    return cu.ordered_curriculum(_leveled(spark, folder), LEVELS, SEED)


def _random(cumulative: bool):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        rows = views.plain_difficulty(spark, folder)
        return cu.random_stages(rows, LEVELS, SEED, cumulative=cumulative).select("stage", "level", "idx")

    return run


def _plan(spark, folder):
    return cu.training_plan(views.plain_difficulty(spark, folder), _disjoint(spark, folder), EPOCHS)


def _summary(spark, folder):
    return cu.stage_summary(_cumulative(spark, folder))


def _level_summary(spark, folder):
    return cu.level_summary(_leveled(spark, folder), LEVELS, BATCH)


QUERIES = {
    "norm_linear": _scaled("line"),
    "norm_softmax": _scaled("softmax"),
    "norm_logsoftmax": _scaled("logsoftmax"),
    "kl_difficulty": _kl(True),
    "kl_one_sided": _kl(False),
    "batch_difficulty": _batch_mean,
    "batch_tensor_difficulty": _batch_tensor,
    "sinkhorn_difficulty": _sinkhorn,
    "score_examples": _scored,
    "density_matrix": _moment,
    "vector_std": _std,
    "difficulty_levels": _levels,
    "distill_uniform": _uniform,
    "distill_gated": _gated,
    "distill_batches": _batches,
    "cumulative_stages": _cumulative,
    "disjoint_stages": _disjoint,
    "ordered_set": _ordered,
    "ordered_curriculum": _ordered_stages,
    "random_stages": _random(False),
    "random_cumulative": _random(True),
    "training_plan": _plan,
    "stage_summary": _summary,
    "level_summary": _level_summary,
}

# ---------------------------------------------------------------- checks in SQL

SQL_VECTORS = f"""
v AS (
  SELECT vec_id, label, vec_id // {VECTOR_BATCH} AS batch, unnest(range(len(embedding))) AS dim,
         CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)
"""


def _sql_hidden(batch: str = "") -> str:
    """``h(vec_id, batch, x, y)`` with both sides scaled to their extremes (per ``batch`` if given)."""
    over = f"PARTITION BY {batch}" if batch else ""
    return f"""{SQL_VECTORS},
c AS (SELECT label, dim, avg(x) AS y FROM v GROUP BY ALL),
raw AS (SELECT vec_id, batch, dim, x, y FROM v JOIN c USING (label, dim)),
h AS (
  SELECT vec_id, batch, (x - min(x) OVER ({over})) / (max(x) OVER ({over}) - min(x) OVER ({over})) AS x,
         (y - min(y) OVER ({over})) / (max(y) OVER ({over}) - min(y) OVER ({over})) AS y FROM raw)
"""


_XY = "CASE WHEN y > 0 THEN y * (ln(y) - x) ELSE 0 END"
_YX = "CASE WHEN x > 0 THEN x * (ln(x) - y) ELSE 0 END"
_SYM = f"({_XY} + {_YX}) / 2"

SQL_LEVELED = f"""
src AS (SELECT doc_id AS idx, CAST(n_chars AS DOUBLE) AS difficulty FROM documents),
ext AS (SELECT min(difficulty) AS lo, max(difficulty) AS hi FROM src),
lev AS (
  SELECT idx, difficulty, CAST(CASE WHEN difficulty = hi THEN {LEVELS - 1}
         ELSE least(floor({LEVELS} * (difficulty - lo) / (hi - lo)), {LEVELS - 1}) END AS INT) AS level FROM src, ext),
hashed AS (
  SELECT *, row_number() OVER (PARTITION BY level ORDER BY md5('{SEED}:' || idx), idx) AS rk,
         count(*) OVER (PARTITION BY level) AS n, count(*) OVER () AS total FROM lev),
uni AS (SELECT idx, difficulty, level FROM hashed WHERE rk <= n // {LEVELS}),
gat AS (
  SELECT idx, difficulty, level FROM hashed
  WHERE rk <= CASE WHEN n > total * {LEVELS} // {BATCH} THEN n // {LEVELS} ELSE n END),
stg AS (SELECT idx, difficulty, level, unnest(range(level, {LEVELS})) AS stage FROM gat)
"""

SQL_RANDOM = f"""
src AS (SELECT doc_id AS idx FROM documents),
shuf AS (
  SELECT idx, row_number() OVER (ORDER BY md5('{SEED}:' || idx), idx) - 1 AS rk, count(*) OVER () // {LEVELS} AS split FROM src),
kept AS (
  SELECT idx, CAST(rk // split AS INT) AS level FROM shuf
  WHERE rk < split * {LEVELS} AND rk % split < CAST(floor(CAST(1 AS DOUBLE) / 3 * split) AS BIGINT))
"""

BLUR, SCALING, WIDTH = 0.05, 0.9, 8


def _sql_softmin(rows: str, columns: str, cost: str, other: str) -> str:
    """``-eps * log(mean(exp((other - cost) / eps)))`` for every row, as a list."""
    score = f"{other}[j] - {cost}"
    top = f"list_max(list_transform(range(1, len({columns}) + 1), lambda j: {score}))"
    mass = f"list_sum(list_transform(range(1, len({columns}) + 1), lambda j: exp(({score} - {top}) / eps)))"
    return f"list_transform(range(1, len({rows}) + 1), lambda i: -{top} - eps * ln({mass} / len({columns})))"


_F_STEP = _sql_softmin("x", "y", "c[i][j]", "g")
_G_STEP = _sql_softmin("y", "x", "c[j][i]", "f")

SQL_TRANSPORT = f"""{SQL_VECTORS},
c0 AS (SELECT label, dim, avg(x) AS y FROM v GROUP BY ALL),
p AS (SELECT vec_id, dim, x, y FROM v JOIN c0 USING (label, dim)),
t AS (
  SELECT vec_id, dim // {WIDTH} AS k, list(x ORDER BY dim) AS x, list(y ORDER BY dim) AS y,
  FROM p GROUP BY ALL),
cl AS (SELECT vec_id, list(x ORDER BY k) AS x, list(y ORDER BY k) AS y FROM t GROUP BY vec_id),
box AS (
  SELECT vec_id, sqrt(sum(r * r)) AS d FROM (
    SELECT vec_id, greatest(max(x), max(y)) - least(min(x), min(y)) AS r FROM p GROUP BY vec_id, dim % {WIDTH}) GROUP BY vec_id),
ready AS MATERIALIZED (
  SELECT vec_id, x, y,
         list_transform(x, lambda a: list_transform(y, lambda b:
           list_sum(list_transform(range(1, {WIDTH} + 1), lambda n: (a[n] - b[n]) * (a[n] - b[n]))) / 2)) AS c,
         [d * d] || list_transform(range(CAST(ceil((2 * ln({BLUR}) - 2 * ln(d)) / (2 * ln({SCALING}))) AS BIGINT)),
           lambda n: exp(2 * ln(d) + n * 2 * ln({SCALING}))) || [{BLUR} * CAST({BLUR} AS DOUBLE)] AS temps
  FROM cl JOIN box USING (vec_id)),
walk AS (
  SELECT vec_id, 0 AS step, {_F_STEP} AS f, {_G_STEP} AS g
  FROM (SELECT *, temps[1] AS eps, list_transform(x, lambda a: CAST(0 AS DOUBLE)) AS f,
               list_transform(y, lambda b: CAST(0 AS DOUBLE)) AS g FROM ready)
  UNION ALL
  SELECT vec_id, step + 1, list_transform(range(1, len(f) + 1), lambda i: (f[i] + nf[i]) / 2),
         list_transform(range(1, len(g) + 1), lambda j: (g[j] + ng[j]) / 2)
  FROM (SELECT vec_id, step, f, g, {_F_STEP} AS nf, {_G_STEP} AS ng
        FROM (SELECT walk.vec_id, step, f, g, x, y, c, temps[step + 1] AS eps
              FROM walk JOIN ready ON ready.vec_id = walk.vec_id WHERE step < len(temps)))),
final AS (
  SELECT vec_id, {_F_STEP} AS f
  FROM (SELECT walk.vec_id, f, g, x, y, c, temps[len(temps)] AS eps
        FROM walk JOIN ready ON ready.vec_id = walk.vec_id WHERE step = len(temps)))
"""

ORACLE = {
    "sinkhorn_difficulty": f"""WITH RECURSIVE {SQL_TRANSPORT}
SELECT vec_id AS idx, round(list_sum(f), 4) AS difficulty FROM final""",
    "norm_linear": f"""WITH {SQL_VECTORS}
SELECT vec_id, dim, round((x - min(x) OVER w) / (max(x) OVER w - min(x) OVER w), 6) AS value FROM v WINDOW w AS (PARTITION BY batch)""",
    "norm_softmax": f"""WITH {SQL_VECTORS}, p AS (SELECT *, exp(x - max(x) OVER (PARTITION BY vec_id)) AS e FROM v)
SELECT vec_id, dim, round(e / sum(e) OVER (PARTITION BY vec_id), 6) AS value FROM p""",
    "norm_logsoftmax": f"""WITH {SQL_VECTORS}, p AS (SELECT *, x - max(x) OVER (PARTITION BY vec_id) AS s FROM v)
SELECT vec_id, dim, round(s - ln(sum(exp(s)) OVER (PARTITION BY vec_id)), 6) AS value FROM p""",
    "kl_difficulty": f"WITH {_sql_hidden()} SELECT vec_id, round(avg({_SYM}), 6) AS difficulty FROM h GROUP BY vec_id",
    "kl_one_sided": f"WITH {_sql_hidden()} SELECT vec_id, round(avg({_XY}), 6) AS difficulty FROM h GROUP BY vec_id",
    "batch_difficulty": f"""WITH {_sql_hidden()}, s AS (SELECT vec_id, batch, avg({_SYM}) AS d FROM h GROUP BY ALL)
SELECT vec_id, batch, round(avg(d) OVER (PARTITION BY batch), 6) AS difficulty FROM s""",
    "batch_tensor_difficulty": f"WITH {_sql_hidden('batch')} SELECT batch, round(avg({_SYM}), 6) AS difficulty FROM h GROUP BY batch",
    "score_examples": f"WITH {_sql_hidden('batch')} SELECT vec_id AS idx, round(avg({_SYM}), 6) AS difficulty FROM h GROUP BY vec_id",
    "density_matrix": """SELECT label, i, j, round(sum(CAST(embedding[i + 1] AS DOUBLE) * embedding[j + 1]), 6) AS value
FROM embeddings, (SELECT unnest(range(64)) AS i) a, (SELECT unnest(range(64)) AS j) b GROUP BY ALL""",
    "vector_std": f"WITH {SQL_VECTORS} SELECT dim, round(stddev_pop(x), 6) AS std FROM v GROUP BY dim",
    "difficulty_levels": f"WITH {SQL_LEVELED} SELECT idx, difficulty, level FROM lev",
    "distill_uniform": f"WITH {SQL_LEVELED} SELECT * FROM uni",
    "distill_gated": f"WITH {SQL_LEVELED} SELECT * FROM gat",
    "distill_batches": f"""WITH b AS (
  SELECT doc_id // {BATCH} AS batch, avg(CAST(n_chars AS DOUBLE)) AS difficulty, count(*) AS examples FROM documents GROUP BY ALL),
x AS (SELECT min(difficulty) AS lo, max(difficulty) AS hi, sum(examples) AS n FROM b),
l AS (
  SELECT b.*, CAST(floor(CAST(n AS DOUBLE) / {BATCH} / {LEVELS}) AS BIGINT) AS gate,
         CAST(CASE WHEN difficulty = hi THEN {LEVELS - 1} ELSE least(floor({LEVELS} * (difficulty - lo) / (hi - lo)), {LEVELS - 1}) END AS INT) AS level
  FROM b, x),
r AS (SELECT *, row_number() OVER (PARTITION BY level ORDER BY md5('{SEED}:' || batch), batch) AS rk, count(*) OVER (PARTITION BY level) AS m FROM l)
SELECT batch, level, examples, round(difficulty, 6) AS difficulty FROM r WHERE rk <= CASE WHEN m > gate THEN gate // {LEVELS} ELSE m END""",
    "cumulative_stages": f"WITH {SQL_LEVELED} SELECT stage, level, idx FROM stg",
    "disjoint_stages": f"WITH {SQL_LEVELED} SELECT level AS stage, level, idx FROM uni",
    "ordered_set": f"WITH {SQL_LEVELED} SELECT row_number() OVER (ORDER BY level, idx) - 1 AS pos, level, idx FROM lev",
    "ordered_curriculum": f"""WITH {SQL_LEVELED}
SELECT 0 AS stage, level, idx FROM lev
UNION ALL SELECT CAST(unnest(range(level, {LEVELS})) + 1 AS INT), level, idx FROM uni""",
    "random_stages": f"WITH {SQL_RANDOM} SELECT level AS stage, level, idx FROM kept",
    "random_cumulative": f"WITH {SQL_RANDOM} SELECT unnest(range(level, {LEVELS})) AS stage, level, idx FROM kept",
    "training_plan": f"""WITH {SQL_LEVELED}
SELECT unnest(range({EPOCHS})) AS plan_pos, 'full' AS kind, idx FROM src
UNION ALL SELECT level + {EPOCHS}, 'stage', idx FROM uni""",
    "stage_summary": f"""WITH {SQL_LEVELED}
SELECT stage, level, count(*) AS n FROM stg GROUP BY GROUPING SETS ((stage, level), (stage))""",
    "level_summary": f"""WITH {SQL_LEVELED}
SELECT level, count(*) AS n, any_value(total * {LEVELS} // {BATCH}) AS threshold, any_value(total) AS total FROM hashed GROUP BY level""",
}
