"""From text to model features: windows, span labels, padding, label ids, tag alignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from stairwell.functions.arrays import pad_to

IGNORED = -100  # fixed value: positions a loss or a metric must skip
SPAN = "struct<start:int,end:int>"
NO_SPAN = f"cast(null as {SPAN})"
QUESTION, CONTEXT, SPECIAL = 0, 1, -1
CLS, SEP = "[CLS]", "[SEP]"
WINDOW_TEXT, TEXT_AT, QUESTION_STARTS = "window_text", "text_at", "question_starts"


def window_features(
    df: DataFrame,
    keys: list[str],
    question_tokens: str,
    context_spans: str,
    max_length: int = 384,
    overlap: int = 128,
    context_first: bool = False,
    carry: list[str] | None = None,
    text: str | None = None,
    question_starts: str | None = None,
) -> DataFrame:
    """One row per window of an example's context.

    ``question_tokens`` is array<string>, ``context_spans`` is
    array<struct<tok,start,end>>.  A window holds at most ``max_length`` tokens
    counting the question and three special tokens; neighbouring windows share
    ``overlap`` context tokens and the last one reaches the end of the context.
    Layouts: ``[CLS] question [SEP] context [SEP]`` or, with ``context_first``,
    ``context [SEP] question [SEP] [CLS]``.

    Output: ``keys``, ``window``, ``first_token`` (context position of the window),
    ``tokens``, ``roles`` (0 question, 1 context, -1 special), ``offset_mapping``
    (null outside the context), ``context_at`` (position of the first context
    token), ``context_size``, ``cls_index``, and the ``carry`` columns.  ``text`` names the context's text: every window
    then has the stretch of it that its tokens cover (``window_text``) and where that begins (``text_at``).
    ``question_starts`` names the character positions at which the question's tokens start, which the windows then keep:
    ``label_spans`` needs them where the question follows the context.
    """
    q_size = F.size(question_tokens)
    budget = (F.lit(max_length) - q_size - 3).cast("int")
    step = budget - overlap
    n = F.size(context_spans)
    extra = F.greatest(F.ceil((n - budget) / step), F.lit(0)).cast("int")
    too_long = F.raise_error(F.lit("the question leaves no room for the context overlap"))
    sized = df.select(
        *keys,
        *(carry or []),
        *([F.col(text).alias("__text")] if text else []),
        *([F.col(question_starts).alias(QUESTION_STARTS)] if question_starts else []),
        F.col(question_tokens).alias("__q"),
        F.col(context_spans).alias("__c"),
        budget.alias("__budget"),
        F.when(step <= 0, too_long.cast("int")).otherwise(step).alias("__step"),
        F.when(step <= 0, F.lit(0)).otherwise(extra).alias("__last"),
    )
    def stretch(w: Column) -> list[Column]:
        if not text:
            return []
        begin = F.coalesce(F.get("__c", w * F.col("__step"))["start"], F.lit(0))
        last = F.least(w * F.col("__step") + F.col("__budget"), F.size("__c")) - 1
        size = F.coalesce(F.get("__c", last)["end"], F.lit(0)) - begin
        return [begin.alias(TEXT_AT), F.substring(F.col("__text"), begin + 1, size).alias(WINDOW_TEXT)]

    pieces = F.transform(
        F.sequence(F.lit(0), F.col("__last")),
        lambda w: F.struct(
            w.alias("window"),
            (w * F.col("__step")).alias("first_token"),
            F.slice("__c", w * F.col("__step") + 1, F.col("__budget")).alias("spans"),
            *stretch(w),
        ),
    )
    starts = [QUESTION_STARTS] if question_starts else []
    cut = sized.select(*keys, *(carry or []), "__q", *starts, F.inline(pieces))
    spans = F.col("spans")
    c_size = F.size(spans)
    words = F.transform(spans, lambda s: s["tok"])
    places = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))

    def roles_of(size: Column, role: int) -> Column:
        return F.array_repeat(F.lit(role), size)

    def nothing(size: Column | int) -> Column:
        return F.array_repeat(F.expr(NO_SPAN), size if isinstance(size, Column) else F.lit(size))

    q_len = F.size("__q")
    one = F.lit(1)
    if context_first:
        tokens = F.concat(words, F.array(F.lit(SEP)), "__q", F.array(F.lit(SEP), F.lit(CLS)))
        roles = F.concat(
            roles_of(c_size, CONTEXT),
            roles_of(one, SPECIAL),
            roles_of(q_len, QUESTION),
            roles_of(F.lit(2), SPECIAL),
        )
        offsets = F.concat(places, nothing(q_len + 3))
        context_at, cls_index = F.lit(0), c_size + q_len + 2
    else:
        tokens = F.concat(F.array(F.lit(CLS)), "__q", F.array(F.lit(SEP)), words, F.array(F.lit(SEP)))
        roles = F.concat(
            roles_of(one, SPECIAL),
            roles_of(q_len, QUESTION),
            roles_of(one, SPECIAL),
            roles_of(c_size, CONTEXT),
            roles_of(one, SPECIAL),
        )
        offsets = F.concat(nothing(q_len + 2), places, nothing(1))
        context_at, cls_index = q_len + 2, F.lit(0)
    return cut.select(
        *keys,
        "window",
        "first_token",
        tokens.alias("tokens"),
        roles.alias("roles"),
        offsets.alias("offset_mapping"),
        context_at.cast("int").alias("context_at"),
        c_size.alias("context_size"),
        cls_index.cast("int").alias("cls_index"),
        *(carry or []),
        *([TEXT_AT, WINDOW_TEXT] if text else []),
        *starts,
    )


def label_spans(features: DataFrame, start_char: str, answer_text: str) -> DataFrame:
    """Add ``start_position``, ``end_position`` and ``is_impossible`` to windows.

    ``start_char`` is null when there is no answer.  No answer, or one that does
    not lie fully inside the window, points at the CLS token.  Otherwise the start
    is the last token beginning at or before the answer, the end the first token
    (scanning back) ending at or after it.  When that start is the window's last
    context token the forward scan runs on: through special tokens, whose offset is zero, and, where the question
    follows the context and its ``question_starts`` are known, through question tokens
    that start at or before the answer's position in the context.  So the position is the one before the first
    question token that starts later, or the last one of the feature.
    """
    # context tokens are neighbours, so a slice finds them
    spans = F.slice("offset_mapping", F.col("context_at") + 1, F.col("context_size"))
    begin = F.col(start_char)
    end = begin + F.length(answer_text)
    size, base = F.col("context_size"), F.col("context_at")
    inside = (
        begin.isNotNull()
        & (size > 0)
        & (F.get(spans, F.lit(0))["start"] <= begin)
        & (F.get(spans, size - 1)["end"] >= end)
    )
    not_after = F.size(F.filter(spans, lambda o: o["start"] <= begin))
    not_before = F.size(F.filter(spans, lambda o: o["end"] >= end))
    beyond = F.size("tokens") - 1
    if QUESTION_STARTS in features.columns:
        passed = F.size(F.filter(QUESTION_STARTS, lambda s: s <= begin))
        stops = (base == 0) & (passed < F.size(QUESTION_STARTS))
        beyond = F.when(stops, size + passed).otherwise(beyond)
    start_token = F.when(not_after == size, beyond).otherwise(base + not_after - 1)
    end_token = base + size - not_before
    cls = F.col("cls_index")
    hit = F.coalesce(inside, F.lit(False))
    return features.select(
        "*",
        F.when(hit, start_token).otherwise(cls).cast("int").alias("start_position"),
        F.when(hit, end_token).otherwise(cls).cast("int").alias("end_position"),
        F.when(hit, 0.0).otherwise(1.0).alias("is_impossible"),
    )


def answer_mask(features: DataFrame) -> DataFrame:
    """Add ``p_mask``: 0.0 where an answer may lie (context tokens and CLS), else 1.0."""
    mask = F.transform(
        "roles",
        lambda role, k: F.when((role == CONTEXT) | (k == F.col("cls_index")), 0.0).otherwise(1.0),
    )
    return features.withColumn("p_mask", mask)


def pad_truncate(df: DataFrame, column: str, length: int, filler: object, out: str | None = None) -> DataFrame:
    """Exactly ``length`` elements per array."""
    return df.withColumn(out or column, pad_to(F.col(column), F.lit(length), F.lit(filler)))


def truncate_pair(first_size: Column, second_size: Column, room: int) -> tuple[Column, Column]:
    """Sizes left when the longer of two texts is shortened, token by token, to fit ``room``.

    On a tie the second one gives way, so an odd remainder stays with the first.
    """
    half_up, half_down = (room + 1) // 2, room // 2
    fits = first_size + second_size <= room
    first = (
        F.when(fits, first_size)
        .when(second_size <= half_down, F.lit(room) - second_size)
        .when(first_size <= half_up, first_size)
        .otherwise(F.lit(half_up))
    )
    second = F.when(fits, second_size).otherwise(F.lit(room) - first)
    return first.cast("int"), second.cast("int")


def batch_pad(
    df: DataFrame,
    idx: str,
    column: str,
    filler: object,
    batch_size: int,
    multiple: int = 1,
    out: str | None = None,
) -> DataFrame:
    """Pad to the longest array of the batch, rounded up to ``multiple``.

    Batches are runs of ``batch_size`` consecutive unique ids, so a window
    partition never holds more than ``batch_size`` rows.
    """
    batched = df.withColumn("batch", F.expr(f"`{idx}` div {int(batch_size)}"))
    longest = F.max(F.size(column)).over(Window.partitionBy("batch"))
    target = (F.ceil(longest / multiple) * multiple).cast("int")
    sized = batched.withColumn("padded_length", target)
    return sized.withColumn(out or column, pad_to(F.col(column), F.col("padded_length"), F.lit(filler)))


def label_vocabulary(df: DataFrame, label: str, unknown: object | None = None) -> DataFrame:
    """(``label``, ``label_id``): sorted distinct labels numbered from 0.

    The window runs over the distinct classes of a classifier, not over rows.
    """
    names = df.select(label).filter(F.col(label).isNotNull())
    if unknown is not None:
        names = names.filter(F.col(label).cast("string") != str(unknown))
    position = F.row_number().over(Window.orderBy(label)) - 1
    return names.distinct().select(label, position.cast("int").alias("label_id"))


def model_vocabulary(vocabulary: DataFrame, model: DataFrame, label: str = "label") -> DataFrame:
    """``vocabulary`` with the ids of a model, given as (``name``, ``model_id``), where both name the same classes.

    Names are compared in lower case. If any class of either side has no partner, the vocabulary's own ids stay.
    """
    ours = vocabulary.withColumn("__name", F.lower(F.col(label).cast("string")))
    theirs = model.select(F.lower("name").alias("__name"), "model_id").dropDuplicates(["__name"])
    paired = ours.join(theirs, "__name", "full")
    lone = F.sum((F.col("label_id").isNull() | F.col("model_id").isNull()).cast("int")).over(Window.partitionBy())
    chosen = F.when(lone > 0, F.col("label_id")).otherwise(F.col("model_id")).cast("int")
    # The window runs over classes, not over rows.
    return paired.withColumn("label_id", chosen).filter(F.col(label).isNotNull()).select(label, "label_id")


def encode_labels(
    df: DataFrame, vocabulary: DataFrame, label: str, out: str = "label_id", unknown: object = -1
) -> DataFrame:
    """Replace labels by their ids; the unknown marker stays -1."""
    ids = vocabulary.select(label, F.col("label_id").alias(out))
    joined = df.join(ids, label, "left")
    return joined.withColumn(
        out,
        F.when(F.col(label).cast("string") == str(unknown), F.lit(-1)).otherwise(F.col(out)).cast("int"),
    )


def tag_vocabulary(df: DataFrame, tags: str) -> DataFrame:
    """(``tag``, ``tag_id``): every tag that occurs, sorted and numbered from 0."""
    return label_vocabulary(df.select(F.explode(F.array_distinct(tags)).alias("tag")), "tag").withColumnRenamed(
        "label_id", "tag_id"
    )


def align_tags(tag_ids: Column, word_ids: Column, label_all_tokens: bool = False) -> Column:
    """Tag ids per subword: special tokens and, by default, later subwords are ignored."""

    def one(word: Column, i: Column) -> Column:
        tag = F.get(tag_ids, word)
        repeat = (i > 0) & (word == F.get(word_ids, F.greatest(i - 1, F.lit(0))))
        later = tag if label_all_tokens else F.lit(IGNORED)
        return F.when(word.isNull(), F.lit(IGNORED)).when(repeat, later).otherwise(tag).cast("int")

    return F.transform(word_ids, one)


def mask_padding(ids: Column, pad_id: int) -> Column:
    """Padding in label ids becomes the ignored marker."""
    return F.transform(ids, lambda i: F.when(i != pad_id, i).otherwise(F.lit(IGNORED)))


def unmask_padding(ids: Column, pad_id: int) -> Column:
    """The ignored marker becomes padding again, as decoding needs it."""
    return F.transform(ids, lambda i: F.when(i != IGNORED, i).otherwise(F.lit(pad_id)))


def drop_ignored(predicted: Column, gold: Column, names: Column) -> Column:
    """``array<struct<predicted,gold>>`` of names where the gold id is not ignored."""
    paired = F.transform(
        gold, lambda g, i: F.struct(F.get(predicted, i).alias("p"), g.alias("g"))
    )
    kept = F.filter(paired, lambda x: x["g"] != IGNORED)
    return F.transform(
        kept,
        lambda x: F.struct(F.get(names, x["p"]).alias("predicted"), F.get(names, x["g"]).alias("gold")),
    )


def non_pad_length(ids: Column, pad_id: int) -> Column:
    return F.size(F.filter(ids, lambda i: i != pad_id))


def term_frequency(df: DataFrame, tokens: Column) -> DataFrame:
    """(``term``, ``n``) over the corpus; counts are combined before the shuffle."""
    return df.select(F.explode(tokens).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
