"""Array expressions: argmax, softmax, padding, multiset overlap."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def argmax(values: Column) -> Column:
    """Zero-based position of the largest element, the first one on ties."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def vector_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def vector_mean(values: Column) -> Column:
    return vector_sum(values) / F.size(values)


def as_doubles(values: Column) -> Column:
    return values.cast("array<double>")


def softmax(values: Column) -> Column:
    def scaled(v: Column) -> Column:
        exps = let(F.array_max(v), lambda top: F.transform(v, lambda x: F.exp(x - top)))
        return let(exps, lambda e: let(vector_sum(e), lambda s: F.transform(e, lambda x: x / s)))

    return let(as_doubles(values), scaled)


def log_softmax(values: Column) -> Column:
    def shifted(v: Column) -> Column:
        def with_top(top: Column) -> Column:
            total = F.aggregate(v, F.lit(0.0), lambda acc, x: acc + F.exp(x - top))
            return let(F.log(total), lambda ls: F.transform(v, lambda x: x - top - ls))

        return let(F.array_max(v), with_top)

    return let(as_doubles(values), shifted)


def linear_scale(values: Column, low: Column, high: Column) -> Column:
    """Components between 0 (``low``) and 1 (``high``); all 0 when the bounds are equal."""
    width = F.nullif(high - low, F.lit(0.0))
    return F.transform(as_doubles(values), lambda x: F.coalesce((x - low) / width, F.lit(0.0)))


def pad_to(values: Column, length: Column, filler: Column) -> Column:
    """Cut to ``length`` and fill up to it; the result always has ``length`` elements."""
    kept = F.slice(values, F.lit(1), length)
    return F.concat(kept, F.array_repeat(filler, F.greatest(length - F.size(values), F.lit(0))))


def multiset_overlap(left: Column, right: Column) -> Column:
    """Number of elements two arrays share, counting repetitions.

    Both sides are sorted once and walked together, so a row costs
    O((n+m) log(n+m)) whatever its length and nothing is exploded or shuffled.
    """

    def walk(pair: Column) -> Column:
        a, b = pair["a"], pair["b"]
        start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("hits"))

        def step(s: Column, _: Column) -> Column:
            # past either end the comparisons are null and nothing is counted
            x, y = F.get(a, s["i"]), F.get(b, s["j"])
            return F.struct(
                (s["i"] + F.when(x > y, 0).otherwise(1)).alias("i"),
                (s["j"] + F.when(x < y, 0).otherwise(1)).alias("j"),
                (s["hits"] + F.when(x == y, 1).otherwise(0)).alias("hits"),
            )

        return F.aggregate(F.sequence(F.lit(1), F.size(a) + F.size(b)), start, step, lambda s: s["hits"])

    both = F.struct(F.sort_array(left).alias("a"), F.sort_array(right).alias("b"))
    return F.when((F.size(left) == 0) | (F.size(right) == 0), F.lit(0)).otherwise(let(both, walk))
