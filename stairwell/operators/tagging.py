"""Entity-level precision, recall and F1 from tag sequences.

Chunks are found inside each sentence's arrays; a sentence yields its counts per
entity type, and only those counts are aggregated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stairwell.functions.arrays import let


def chunks(tags: Column) -> Column:
    """``array<struct<type,start,end>>`` of the entities of one tag sequence (inclusive ends).

    Prefixes B, I, E, S and O.  A chunk starts at B or S, after O, E or S, or where the type
    changes; it ends symmetrically.  An I without a B therefore opens a chunk.
    """

    def parsed(t: Column) -> Column:
        return F.struct(F.substring(t, 1, 1).alias("p"), F.substring(t, 3, 1 << 30).alias("k"))

    outside = F.struct(F.lit("O").alias("p"), F.lit("").alias("k"))

    def breaks(left: Column, right: Column) -> Column:
        """Whether two neighbouring tags belong to different chunks."""
        return right["p"].isin("B", "S", "O") | left["p"].isin("E", "S", "O") | (left["k"] != right["k"])

    def found(s: Column) -> Column:
        place = F.sequence(F.lit(1), F.greatest(F.size(s) - 2, F.lit(1)))
        inside = lambda i: F.get(s, i)["p"] != "O"
        starts = F.filter(place, lambda i: inside(i) & breaks(F.get(s, i - 1), F.get(s, i)))
        ends = F.filter(place, lambda i: inside(i) & breaks(F.get(s, i), F.get(s, i + 1)))
        return let(
            ends,
            lambda e: F.transform(
                starts,
                lambda b, n: F.struct(
                    F.get(s, b)["k"].alias("type"), (b - 1).alias("start"), (F.get(e, n) - 1).alias("end")
                ),
            ),
        )

    padded = F.concat(F.array(outside), F.transform(tags, parsed), F.array(outside))
    return let(padded, found)


def _type_counts(df: DataFrame, gold: str, predicted: str) -> DataFrame:
    both = df.select(chunks(F.col(gold)).alias("g"), chunks(F.col(predicted)).alias("p"))
    matched = both.select("g", "p", F.array_intersect("g", "p").alias("m"))

    def flagged(side: str) -> Column:
        marks = [F.lit(int(side == n)).alias(n) for n in ("g", "p", "m")]
        return F.transform(side, lambda c: F.struct(c["type"].alias("type"), *marks))

    flags = F.concat(*[flagged(side) for side in ("g", "p", "m")])
    rows = matched.select(F.inline(flags))
    return rows.groupBy("type").agg(
        F.sum("m").alias("correct"), F.sum("p").alias("found"), F.sum("g").alias("support")
    )


def _prf(correct: Column, found: Column, support: Column) -> list[Column]:
    c = correct.cast("double")
    precision = F.when(found > 0, c / found).otherwise(0.0)
    recall = F.when(support > 0, c / support).otherwise(0.0)
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    return [precision.alias("precision"), recall.alias("recall"), f1.alias("f1")]


def entity_scores_by_type(df: DataFrame, gold: str, predicted: str) -> DataFrame:
    """``type, precision, recall, f1, number`` (number of gold entities)."""
    counts = _type_counts(df, gold, predicted)
    c, f, s = F.col("correct"), F.col("found"), F.col("support")
    return counts.select("type", *_prf(c, f, s), s.alias("number"))


def entity_scores(df: DataFrame, gold: str, predicted: str) -> DataFrame:
    """One row ``precision, recall, f1, accuracy``: all entities together, and tokens; 0 without any."""
    side = df.select(
        F.size(gold).alias("n"),
        F.size(F.filter(F.arrays_zip(F.col(gold).alias("g"), F.col(predicted).alias("p")), lambda z: z["g"] == z["p"])).alias("same"),
        chunks(F.col(gold)).alias("g"),
        chunks(F.col(predicted)).alias("p"),
    )
    sums = side.agg(
        F.sum("n").alias("n"),
        F.sum("same").alias("same"),
        F.sum(F.size(F.array_intersect("g", "p"))).alias("correct"),
        F.sum(F.size("p")).alias("found"),
        F.sum(F.size("g")).alias("support"),
    )
    parts = _prf(F.col("correct"), F.col("found"), F.col("support"))
    return sums.select(*parts, F.coalesce(F.col("same").cast("double") / F.nullif(F.col("n"), F.lit(0)), F.lit(0.0)).alias("accuracy"))


def entity_metric_map(df: DataFrame, gold: str, predicted: str) -> DataFrame:
    """(``key``, ``value``): ``overall_<metric>`` and ``<type>_<metric>``."""
    overall = entity_scores(df, gold, predicted)
    pairs = F.array(
        *[F.struct(F.lit(f"overall_{c}").alias("key"), F.col(c).alias("value")) for c in overall.columns]
    )
    by_type = flatten_entity_scores(entity_scores_by_type(df, gold, predicted))
    return overall.select(F.inline(pairs)).unionByName(by_type)


def flatten_entity_scores(by_type: DataFrame) -> DataFrame:
    """(``key``, ``value``) with keys ``<type>_<metric>``."""
    names = ("precision", "recall", "f1", "number")
    pairs = F.array(*[F.struct(F.lit(n).alias("m"), F.col(n).cast("double").alias("value")) for n in names])
    return by_type.select("type", F.inline(pairs)).select(F.concat_ws("_", "type", "m").alias("key"), "value")
