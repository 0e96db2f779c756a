"""Corpus BLEU.

N-grams are counted inside their row: tokens of an Arrow batch get numbers, an n-gram is named by the number of its
first n-1 tokens and its last token, and matches are the smaller of its two counts in the row.  Nothing
is expanded or shuffled; only sums per order leave a task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from stairwell.functions.text import bleu_tokens

ORDERS = (1, 2, 3, 4)
BATCH_TOKENS = 1 << 16  # tokens counted at once


def _numbered(codes: np.ndarray) -> np.ndarray:
    return np.unique(codes, return_inverse=True)[1].ravel()


def _sizes(lists: pa.ListArray) -> np.ndarray:
    return pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _counts(predicted: pa.ListArray, reference: pa.ListArray) -> np.ndarray:
    """Per row: tokens of the reference, then per order the n-grams matched and the n-grams of the prediction."""
    rows = len(predicted)
    sizes = [_sizes(side) for side in (predicted, reference)]
    flat = pa.concat_arrays([predicted.flatten(), reference.flatten()])
    word = flat.dictionary_encode().indices.to_numpy().astype(np.int64)
    kinds = int(word.max(initial=0)) + 1
    size = np.concatenate(sizes)
    row = np.repeat(np.tile(np.arange(rows), 2), size)
    text = np.repeat(np.arange(2 * rows), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(word))  # tokens of the text from here on
    out = np.zeros((rows, 1 + 2 * len(ORDERS)), np.int64)
    out[:, 0] = sizes[1]
    gram = row
    for n in ORDERS:
        here = np.flatnonzero(left >= n)  # places where an n-gram begins
        gram = _numbered(gram[here] * kinds + word[here + n - 1])
        of_row, said = row[here], text[here] < rows
        seen = int(gram.max(initial=-1)) + 1
        counts = [np.bincount(gram[side], minlength=seen) for side in (said, ~said)]
        owner = np.zeros(seen, np.int64)
        owner[gram] = of_row
        out[:, 2 * n - 1] = np.bincount(owner, np.minimum(*counts), rows)
        out[:, 2 * n] = np.bincount(of_row[said], minlength=rows)
        whole = np.zeros(len(word), np.int64)
        whole[here] = gram
        gram = whole
    return out


def _matches(predicted: pa.Array, reference: pa.Array) -> pa.Array:
    """The counts of every row as an array, in stretches of rows that bound the memory."""
    parts, at = [], 0
    size = np.cumsum(_sizes(predicted) + _sizes(reference))
    while at < len(size):
        until = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + BATCH_TOKENS, "right")))
        parts.append(_counts(predicted.slice(at, until - at), reference.slice(at, until - at)))
        at = until
    rows = np.concatenate(parts) if parts else np.zeros((0, 1 + 2 * len(ORDERS)), np.int64)
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.ravel()))


def corpus_bleu(
    df: DataFrame, predicted: str, reference: str, length: Column | None = None
) -> DataFrame:
    """One row ``bleu, gen_len`` rounded to four places.

    One reference per prediction and row; both texts are trimmed
    and tokenised the standard way.  An order without a match counts as half,
    then a quarter, ... of one match; no match at all scores 0.  ``length`` is the
    generated length of a row (default: the number of tokens).
    """
    counts = F.arrow_udf(_matches, "array<bigint>")(bleu_tokens(F.col(predicted)), bleu_tokens(F.col(reference)))
    total = lambda k: F.coalesce(F.sum(F.get("__counts", F.lit(k))), F.lit(0)).cast("double")
    sums = df.select(counts.alias("__counts")).agg(
        total(0).alias("ref"),
        *[total(2 * n - 1).alias(f"m{n}") for n in ORDERS],
        *[total(2 * n).alias(f"t{n}") for n in ORDERS],
    )
    pairs = df.agg(F.count("*").cast("double").alias("n")).scalar()
    gen_len = df.agg(F.avg(length)).scalar() if length is not None else F.col("t1") / F.nullif(pairs, F.lit(0.0))
    misses = F.lit(0)
    logs = F.lit(0.0)
    for n in ORDERS:
        match, shown = F.col(f"m{n}"), F.col(f"t{n}")
        misses = misses + F.when(match == 0, 1).otherwise(0)
        counted = F.when(match == 0, F.pow(F.lit(2.0), -misses)).otherwise(match)
        logs = logs + F.log(100.0 * counted / F.nullif(shown, F.lit(0.0)))
    short = F.col("t1") < F.col("ref")
    penalty = F.when(short, F.exp(1 - F.col("ref") / F.nullif(F.col("t1"), F.lit(0.0)))).otherwise(1.0)
    empty = (F.col("m1") == 0) | (F.col(f"t{ORDERS[-1]}") == 0)
    score = F.when(empty, F.lit(0.0)).otherwise(penalty * F.exp(logs / len(ORDERS)))
    return sums.select(F.round(score, 4).alias("bleu"), F.round(gen_len, 4).alias("gen_len"))
