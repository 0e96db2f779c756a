"""Whole preparations: from example tables to model features, with column roles resolved by name or position.

Words and symbols stand in for subwords; a table of other tokens can be given to
the operators directly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stairwell.functions.text import space_tokens, token_offsets
from stairwell.operators import features as ft, rows as rw
from stairwell.operators.features import CLS, SEP
from stairwell.sources.translation import translation_pairs


def first_answer(answers: Column) -> tuple[Column, Column]:
    """Start character and text of the first answer of ``struct<text[],answer_start[]>``; null without one."""
    return F.get(answers["answer_start"], F.lit(0)), F.get(answers["text"], F.lit(0))


def _words(text: Column) -> Column:
    return F.transform(token_offsets(text), lambda s: s["tok"])


def question_features(
    examples: DataFrame,
    key: str = "id",
    max_length: int = 384,
    overlap: int = 128,
    context_first: bool = False,
    labels: bool = True,
    max_samples: int | None = None,
    position: str | None = None,
) -> DataFrame:
    """Windows of question-answering examples, with answer positions for training.

    ``max_samples`` limits the examples before they are cut into windows and the
    windows afterwards: the first ones by ``position``, the column with their places in the file, which the
    windows keep; without it, by key.  ``context_first`` gives the beam layout with its answer mask.
    """
    question, context, answers = rw.qa_roles(examples)
    start, text = first_answer(F.col(answers))
    placed = position is not None
    picked = examples.filter(F.col(position) < max_samples) if placed and max_samples is not None else examples if placed else rw.head(examples, max_samples, key)
    keys = [key, position] if placed else [key]
    ready = picked.select(
        *keys,
        token_offsets(F.col(question)).alias("__q"),
        token_offsets(F.col(context)).alias("__spans"),
        *([start.alias("start_char"), text.alias("answer")] if labels else []),
    )
    carry = ["start_char", "answer"] if labels else []
    asked = {"__question": F.transform("__q", lambda t: t["tok"]), "__starts": F.transform("__q", lambda t: t["start"])}
    starts = "__starts" if context_first and labels else None
    out = ft.window_features(ready.withColumns(asked), keys, "__question", "__spans", max_length, overlap, context_first, carry, question_starts=starts)
    if labels:
        out = ft.label_spans(out, "start_char", "answer").drop(*carry, ft.QUESTION_STARTS)
    if context_first:
        out = ft.answer_mask(out)
    if placed:
        return out if max_samples is None else rw.first_windows(out, max_samples, position)
    return rw.head(out, max_samples, key, "window")


def sentence_features(
    examples: DataFrame,
    key: str = "idx",
    task: str | None = None,
    max_length: int = 128,
    vocabulary: DataFrame | None = None,
    label: str = "label",
) -> DataFrame:
    """``key``, ``tokens`` and ``label`` of sentences or sentence pairs.

    The longer text of a pair gives way first.  Class labels become ids by
    ``vocabulary`` (from the training split); a floating label stays as it is.
    """
    first, second = rw.pair_roles(examples.drop(key), task)
    has_label = label in examples.columns
    texts = examples.select(
        key,
        _words(F.col(first)).alias("a"),
        *([_words(F.col(second)).alias("b")] if second else []),
        *([label] if has_label else []),
    )
    if second:
        a, b = ft.truncate_pair(F.size("a"), F.size("b"), max_length - 3)
        tokens = F.concat(
            F.array(F.lit(CLS)), F.slice("a", F.lit(1), a), F.array(F.lit(SEP)), F.slice("b", F.lit(1), b), F.array(F.lit(SEP))
        )
    else:
        tokens = F.concat(F.array(F.lit(CLS)), F.slice("a", 1, max_length - 2), F.array(F.lit(SEP)))
    out = texts.select(key, tokens.alias("tokens"), *([label] if has_label else []))
    if not has_label or rw.is_regression(examples, label, task):
        return out
    ids = vocabulary if vocabulary is not None else ft.label_vocabulary(examples, label)
    return ft.encode_labels(out, ids, label, "__id").drop(label).withColumnRenamed("__id", label)


def tag_features(
    examples: DataFrame,
    key: str = "id",
    task: str = "ner",
    max_length: int = 512,
    label_all_tokens: bool = False,
    piece_length: int | None = None,
    vocabulary: DataFrame | None = None,
) -> DataFrame:
    """``key``, ``tokens``, ``word_ids`` and aligned ``labels`` of tagged sentences.

    ``piece_length`` cuts words into pieces of that many characters, as a subword
    tokeniser would.  Tags become ids by ``vocabulary`` (``tag``, ``tag_id``), by default that of all tags in order;
    tags that are numbers are ids of declared classes already and stay.
    """
    tokens, tags = rw.tag_roles(examples, task)
    declared = dict(examples.dtypes)[tags] in ("array<int>", "array<bigint>")
    if not declared:
        names = vocabulary if vocabulary is not None else ft.tag_vocabulary(examples, tags)
        # the tags a classifier tells apart: one array literal row
        listed = names.agg(F.transform(F.sort_array(F.collect_list(F.struct("tag_id", "tag"))), lambda s: s["tag"])).scalar()
        examples = examples.withColumn("__names", listed)
    size = piece_length or 1 << 30

    def pieces(word: Column, i: Column) -> Column:
        count = F.greatest(F.ceil(F.length(word) / size), F.lit(1)).cast("int")
        return F.transform(
            F.sequence(F.lit(0), count - 1),
            lambda k: F.struct(F.substring(word, k * size + 1, F.lit(size)).alias("t"), i.alias("w")),
        )

    ids = F.col(tags).cast("array<int>") if declared else F.transform(tags, lambda t: (F.array_position("__names", t) - 1).cast("int"))
    cut = examples.select(
        key,
        F.slice(F.flatten(F.transform(tokens, pieces)), 1, max_length - 2).alias("p"),
        ids.alias("ids"),
    )
    nothing = F.array(F.lit(None).cast("int"))
    shaped = cut.select(
        key,
        "ids",
        F.concat(F.array(F.lit(CLS)), F.transform("p", lambda x: x["t"]), F.array(F.lit(SEP))).alias("tokens"),
        F.concat(nothing, F.transform("p", lambda x: x["w"]), nothing).alias("word_ids"),
    )
    return shaped.select(key, "tokens", "word_ids", ft.align_tags(F.col("ids"), F.col("word_ids"), label_all_tokens).alias("labels"))


def translation_features(
    examples: DataFrame,
    source: str,
    target: str,
    prefix: str = "",
    max_source: int = 1024,
    max_target: int = 128,
    keys: list[str] | None = None,
) -> DataFrame:
    """``tokens`` of the prefixed source and ``labels`` of the target, each cut to its length."""
    pairs = translation_pairs(examples, source, target, prefix, keys)
    return pairs.select(
        *(keys or []),
        F.slice(space_tokens(F.col("source")), 1, max_source).alias("tokens"),
        F.slice(space_tokens(F.col("target")), 1, max_target).alias("labels"),
    )
