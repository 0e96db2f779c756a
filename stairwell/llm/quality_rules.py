"""Quality rules whose cutoffs are risk-controlled on labelled documents; DataFrame functions only.

Every rule rejects a document whose measure is beyond a cutoff. For each stratum and rule, the strictest
cutoff of a fixed list is taken for which an exact binomial test on the labelled good documents shows
that the rule rejects at most ``risk`` of the good ones. The tests of all strata, rules and cutoffs
share the error ``delta`` by Bonferroni's correction, so with probability 1 - delta every rule in every
stratum keeps its promise; all rules together reject at most ``risk`` times their number.

Defined results: null or empty text has no words and fails the base rule; a null stratum is a stratum of its
own; a stratum with too few labels has no cutoffs and loses only what the base rule rejects; labels with
null id or null value are ignored; repeated rows count each; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLANK = r"[\x20\x09-\x0D]+"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
# Rule: measure, words it is held against, cutoffs in hundredths from strict to loose, and whether too little is bad.
RULES = {
    "symbols": ("n_symbols", [2, 5, 10, 15, 20, 30, 50, 75, 100, 150, 200], False),
    "dup_lines": ("n_dup_lines", [1, 2, 3, 4, 5, 7, 10, 15], False),
    "repeats": ("n_repeat_words", [2, 5, 8, 10, 15, 20, 25], False),
    "long_words": ("word_chars", [600, 700, 800, 900, 1000, 1200, 1500], False),
    "short_words": ("word_chars", [450, 400, 350, 300, 250, 200], True),
}
WINDOW = 8
MAX_STRATA = 10_000


def add_base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the COUNTS and base_failed; columns of these names are replaced."""
    own = [c for c in docs.columns if c not in (*COUNTS, "base_failed")]
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(t, BLANK), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = docs.select(
        *own,
        words.alias("__words"),
        F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        lines.alias("__lines"),
    )
    df = df.select(
        *own,
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        F.size("__words").cast("long").alias("n_words"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        "__words",
        F.transform("__words", lambda w: F.xxhash64(w)).alias("__hashes"),
    )
    # Hashes of 2, 4 and 8 words from those of half as many; at the end of the text they cover fewer.
    for width in (1, 2, 4):
        later = F.slice("__hashes", width + 1, F.size("__hashes"))
        df = df.withColumn("__hashes", F.zip_with("__hashes", later, lambda x, y: F.xxhash64(x, y)))
    last = F.size("__words") - WINDOW
    df = df.withColumn("__hashes", F.when(last > 0, F.slice("__hashes", 1, last + 1)))
    # Windows are equal if their 64-bit hashes are; only documents with a repeated one sort them.
    alike = F.coalesce(F.size(F.array_distinct("__hashes")) < F.size("__hashes"), F.lit(False))
    placed = F.sort_array(F.transform("__hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.select(*own, *COUNTS[:4], F.when(alike, placed).alias("__placed"))
    same = lambda s, j: s["h"] == F.get("__placed", j)["h"]
    found = F.filter(F.transform("__placed", lambda s, j: F.when(same(s, j - 1) | same(s, j + 1), s["i"])), lambda i: i.isNotNull())
    df = df.select(*own, *COUNTS[:4], F.sort_array(found).alias("__found"))
    covered = F.aggregate(
        F.transform("__found", lambda i, j: F.least(F.lit(WINDOW), F.coalesce(F.get("__found", j + 1) - i, F.lit(WINDOW)))),
        F.lit(0),
        lambda a, x: a + x,
    )
    # The condition always holds. Being no function of the row, it keeps the optimiser from copying all of the above
    # into later filters, where the arrays would be made anew for each of their elements.
    once = F.monotonically_increasing_id() >= 0
    df = df.select(*own, *COUNTS[:4], F.when(once, F.coalesce(covered, F.lit(0))).otherwise(0).cast("long").alias("n_repeat_words"))
    return df.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def _beyond(rule: str) -> Column:
    """How many of the rule's cutoffs, counted from the strictest, reject the row."""
    measure, cutoffs, too_little = RULES[rule]
    value, n = 100 * F.col(measure), F.col("n_words")
    return sum(((value < c * n) if too_little else (value > c * n)).cast("int") for c in cutoffs)


def choose_cutoffs(counts: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", risk: float = 0.01, delta: float = 0.05) -> DataFrame:
    """(stratum, rule, cutoff): index of the chosen cutoff in the rule's list; rules without a safe cutoff are absent.

    ``counts`` has the key, the stratum and the counts. The sums are grouped before anything else; from then on the
    tables have a row per stratum, rule and cutoff. The critical number of rejections sums the binomial terms
    in order, in logarithms, over ``risk`` times the stratum's labels at most.
    """
    good = labels.where((F.col(label) == 1) & F.col(key).isNotNull()).select(key).distinct()
    good = counts.where("not base_failed").join(good, key, "left_semi")
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), _beyond(r).alias("beyond")) for r in RULES]))
    tally = good.select("stratum", rules.alias("r")).groupBy("stratum", "r.rule", "r.beyond").agg(F.count("*").alias("rows"))
    tally = tally.groupBy("stratum", "rule").agg(F.sum("rows").alias("n"), F.map_from_entries(F.collect_list(F.struct("beyond", "rows"))).alias("rows"))
    sizes = F.create_map(*[x for r, (_, cuts, _) in RULES.items() for x in (F.lit(r), F.lit(len(cuts)))])
    strata = F.size(F.collect_set("stratum").over(Window.partitionBy()))
    tests = F.when(strata <= MAX_STRATA, strata * sum(len(cuts) for _, cuts, _ in RULES.values())).otherwise(F.raise_error(F.lit("too many strata")))
    tally = tally.select("stratum", "rule", "n", "rows", F.log(F.lit(delta) / tests).alias("limit"))
    odds = F.log(F.lit(risk / (1 - risk)))
    step = lambda a, i: F.struct(  # noqa: E731  a.term: log of the i-th binomial term; a.total: the terms up to it
        (a["term"] + odds + F.log((F.col("n") - i) / (i + 1.0))).alias("term"),
        (a["total"] + F.exp(a["term"])).alias("total"),
        F.when(a["total"] + F.exp(a["term"]) <= F.exp("limit"), i).otherwise(a["k"]).alias("k"),
    )
    start = F.struct((F.col("n") * F.log(F.lit(1 - risk))).alias("term"), F.lit(0.0).alias("total"), F.lit(-1).cast("long").alias("k"))
    # The distribution function passes one half at the mean, so no critical value lies beyond risk * n.
    tally = tally.withColumn("critical", F.aggregate(F.sequence(F.lit(0).cast("long"), F.least(F.floor(risk * F.col("n")), F.col("n") - 1)), start, step, lambda a: a["k"]))
    rejected = lambda j: F.aggregate(F.map_values(F.map_filter("rows", lambda b, _: b > j)), F.lit(0).cast("long"), lambda a, x: a + x)
    safe = F.filter(F.sequence(F.lit(0), sizes[F.col("rule")] - 1), lambda j: rejected(j) <= F.col("critical"))
    return tally.select("stratum", "rule", F.array_min(safe).alias("cutoff")).where("cutoff is not null")


def judge(counts: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """``counts`` with kept: not base_failed and not beyond the cutoff of any rule of the stratum.

    The cutoffs, a row per stratum and so at most MAX_STRATA, are broadcast.
    """
    by_rule = cutoffs.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("__cutoffs"))
    df = counts.join(F.broadcast(by_rule), "stratum", "left")
    fires = [F.coalesce(_beyond(r) > F.col("__cutoffs")[r], F.lit(False)) for r in RULES]
    rejected = fires[0]
    for f in fires[1:]:
        rejected = rejected | f
    return df.withColumn("kept", ~F.col("base_failed") & ~rejected).drop("__cutoffs")


def with_stratum(df: DataFrame, stratum: str = "lang") -> DataFrame:
    return df.withColumn("stratum", F.coalesce(F.col(stratum).cast("string"), F.lit("")))
