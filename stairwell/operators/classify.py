"""Classification and regression metrics; each is one pass with partial aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stairwell.operators.ordering import average_ranks
from stairwell.session import materialise


def _count(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0)).cast("double")


def accuracy(df: DataFrame, gold: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    """``accuracy`` and the number of ``samples``, optionally per split or language."""
    hit = F.when(F.col(gold) == F.col(predicted), 1.0).otherwise(0.0)
    return df.groupBy(*(by or [])).agg(F.avg(hit).alias("accuracy"), F.count("*").alias("samples"))


def capped_samples(n: Column, max_samples: int | None) -> Column:
    """Number of samples reported with a metric."""
    return n if max_samples is None else F.least(n, F.lit(max_samples).cast("long"))


def mse(df: DataFrame, gold: str, predicted: str) -> DataFrame:
    return df.agg(F.avg(F.pow(F.col(predicted) - F.col(gold), 2)).alias("mse"))


def confusion(df: DataFrame, gold: str, predicted: str) -> DataFrame:
    """Binary counts ``tp, fp, fn, tn`` for the positive class 1."""
    g, p = F.col(gold) == 1, F.col(predicted) == 1
    return df.agg(
        _count(g & p).alias("tp"), _count(~g & p).alias("fp"), _count(g & ~p).alias("fn"), _count(~g & ~p).alias("tn")
    )


def matthews(df: DataFrame, gold: str, predicted: str) -> DataFrame:
    """Matthews correlation over any number of classes; 0 when one side is constant.

    Counted per (gold, predicted) pair first, so only the class table is
    aggregated further.
    """
    cells = df.groupBy(gold, predicted).agg(F.count("*").cast("double").alias("n"))
    by_gold = cells.groupBy(F.col(gold).alias("k")).agg(F.sum("n").alias("t"))
    by_pred = cells.groupBy(F.col(predicted).alias("k")).agg(F.sum("n").alias("p"))
    per_class = by_gold.join(by_pred, "k", "full").select(
        F.coalesce("t", F.lit(0.0)).alias("t"), F.coalesce("p", F.lit(0.0)).alias("p")
    )
    totals = per_class.agg(
        F.sum("t").alias("s"),
        F.sum(F.col("t") * F.col("p")).alias("tp"),
        F.sum(F.col("t") * F.col("t")).alias("tt"),
        F.sum(F.col("p") * F.col("p")).alias("pp"),
    )
    right = cells.agg(F.sum(F.when(F.col(gold) == F.col(predicted), F.col("n")).otherwise(0.0)).alias("c")).scalar()
    s = F.col("s")
    spread = F.sqrt(s * s - F.col("pp")) * F.sqrt(s * s - F.col("tt"))
    value = F.when(spread == 0, F.lit(0.0)).otherwise((right * s - F.col("tp")) / spread)
    return totals.select(value.alias("matthews_correlation"))


def binary_f1(df: DataFrame, gold: str, predicted: str) -> DataFrame:
    """``accuracy`` and ``f1`` of the positive class; F1 is 0 without any positive."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    bottom = 2 * tp + fp + fn
    return confusion(df, gold, predicted).select(
        ((tp + tn) / (tp + fp + fn + tn)).alias("accuracy"),
        F.when(bottom == 0, F.lit(0.0)).otherwise(2 * tp / bottom).alias("f1"),
    )


def pearson(df: DataFrame, gold: str, predicted: str) -> DataFrame:
    """Null when a side is constant."""
    known = df.select(F.col(gold).cast("double").alias("g"), F.col(predicted).cast("double").alias("p")).dropna()
    spread = F.stddev_pop("g") * F.stddev_pop("p")
    return known.agg((F.covar_pop("g", "p") / F.nullif(spread, F.lit(0.0))).alias("pearson"))


def spearman(df: DataFrame, gold: str, predicted: str) -> DataFrame:
    """Correlation of average ranks; null when a side is constant.

    Rows collapse to distinct (gold, predicted) pairs, written once, before any
    ranking; ranks come from bucketed running totals over distinct values.  Rows
    with a null on either side are left out, as in the plain correlation.
    """
    known = df.select(gold, predicted).dropna()
    pairs = materialise(known.groupBy(gold, predicted).agg(F.count("*").alias("__w")))
    x = average_ranks(pairs.select(gold, "__w"), gold, "__x", "__w")
    y = average_ranks(pairs.select(predicted, "__w"), predicted, "__y", "__w")
    ranked = pairs.join(x, gold).join(y, predicted)
    n = F.sum("__w").cast("double")

    def moment(expr: Column) -> Column:
        return F.sum(F.col("__w") * expr)

    a, b = F.col("__x"), F.col("__y")
    sums = ranked.agg(
        n.alias("n"),
        moment(a).alias("a"),
        moment(b).alias("b"),
        moment(a * a).alias("aa"),
        moment(b * b).alias("bb"),
        moment(a * b).alias("ab"),
    )
    cov = F.col("ab") - F.col("a") * F.col("b") / F.nullif(F.col("n"), F.lit(0.0))
    va = F.col("aa") - F.col("a") * F.col("a") / F.nullif(F.col("n"), F.lit(0.0))
    vb = F.col("bb") - F.col("b") * F.col("b") / F.nullif(F.col("n"), F.lit(0.0))
    return sums.select((cov / F.nullif(F.sqrt(F.greatest(va * vb, F.lit(0.0))), F.lit(0.0))).alias("spearman"))


def combined_score(metrics: DataFrame) -> DataFrame:
    """Add the mean of all metrics when there is more than one."""
    names = metrics.columns
    if len(names) < 2:
        return metrics
    total = sum((F.col(c) for c in names[1:]), F.col(names[0]))
    return metrics.withColumn("combined_score", total / len(names))


# Which metrics a known sentence task reports.
TASK_METRICS = {
    "cola": ("matthews",),
    "mrpc": ("binary_f1",),
    "qqp": ("binary_f1",),
    "stsb": ("pearson", "spearman"),
}


def task_metrics(df: DataFrame, gold: str, predicted: str, task: str | None = None) -> DataFrame:
    """The metric row of a sentence task; other tasks report accuracy."""
    names = TASK_METRICS.get(task or "", ())
    if not names:
        return accuracy(df, gold, predicted).select("accuracy")
    known = {"matthews": matthews, "binary_f1": binary_f1, "pearson": pearson, "spearman": spearman}
    rows = [known[n](df, gold, predicted) for n in names]
    first = rows[0]
    for other in rows[1:]:
        first = first.withColumns({c: other.select(c).scalar() for c in other.columns})
    return combined_score(first)


def unify_checkpoints(metrics: DataFrame, step: str = "step") -> DataFrame:
    """(``key``, ``value``) over checkpoints, the key suffixed by the step when there is one.

    ``metrics`` has ``step, key, value``; an empty or null step leaves the key as it is.
    """
    suffix = F.nullif(F.col(step).cast("string"), F.lit(""))
    return metrics.select(F.concat_ws("_", "key", suffix).alias("key"), "value")
