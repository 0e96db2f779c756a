"""Text and array expressions against plain Python."""

from __future__ import annotations

import random
import re
import string
import tracemalloc
from collections import Counter

import pyarrow as pa
import pyarrow.compute as pc
import pytest
import regex
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from stairwell.functions import arrays as ar, text as tx

SAMPLES = [
    "",
    "   ",
    "The cat, a dog & an owl!",
    "theatre an-a the",
    "a the an",
    "élan théa là the end",
    "the–cat a€b",
    "it's 3.14, isn't it? U.S.A. 1,000",
    "über-the-top\tA\nAN",
    "x" * 500 + " the " + "y" * 500,
    "can't the_a a_ _the",
    "…the… ½ a½ ²an",
]


def normalized(text: str) -> str:
    text = "".join(c for c in text.lower() if c not in string.punctuation)
    return " ".join(re.sub(r"\b(a|an|the)\b", " ", text).split())


def column(spark, values, expr, kind="string"):
    rows = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}")
    return [r[1] for r in sorted(rows.select("i", expr(F.col("v")).alias("o")).collect())]


def test_normalize_answer(spark):
    assert column(spark, SAMPLES, tx.normalize_answer) == [normalized(s) for s in SAMPLES]


def test_space_tokens(spark):
    assert column(spark, SAMPLES, tx.space_tokens) == [s.split() for s in SAMPLES]


def test_strip(spark):
    values = ["  a b\t\n", "　x ", "", "y"]
    assert column(spark, values, tx.strip) == [v.strip() for v in values]


def expected_offsets(text: str):
    return [(m.group(), m.start(), m.end()) for m in re.finditer(r"\w+|[^\w\s]", text)]


def test_token_offsets(spark):
    values = [*SAMPLES, " ".join(f"w{i}," for i in range(2000)), "a" * 40 + "!" * 100]
    got = column(spark, values, tx.token_offsets)
    assert [[tuple(s) for s in r] for r in got] == [expected_offsets(v) for v in values]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="aA, .the\n\té-1'", max_size=60), min_size=1, max_size=30))
def test_text_properties(spark, values):
    assert column(spark, values, tx.normalize_answer) == [normalized(v) for v in values]
    for value, spans in zip(values, column(spark, values, tx.token_offsets)):
        assert [value[s["start"] : s["end"]] for s in spans] == [s["tok"] for s in spans]


@settings(max_examples=5, deadline=None)
@given(
    st.lists(
        st.tuples(st.lists(st.sampled_from("abcde"), max_size=12), st.lists(st.sampled_from("abcdf"), max_size=12)),
        min_size=1,
        max_size=20,
    )
)
def test_multiset_overlap(spark, pairs):
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a array<string>, b array<string>")
    got = rows.select("i", ar.multiset_overlap(F.col("a"), F.col("b")).alias("n")).collect()
    assert {r.i: r.n for r in got} == {i: sum((Counter(a) & Counter(b)).values()) for i, (a, b) in enumerate(pairs)}


@pytest.mark.parametrize("stretch", [1, 50, 1 << 20])
def test_token_offsets_of_a_batch(monkeypatch, stretch):
    """Stretches of one text, of a few, of all; nulls, slices of arrays, code points of every length, words that touch across texts."""
    monkeypatch.setattr(tx, "SCAN_BYTES", stretch)
    pick = random.Random(5)
    values = ["".join(pick.choice("aZ_9é字𝒳 \t\u3000,.!\u0301😀") for _ in range(pick.randint(0, 30))) for _ in range(200)]
    values = [None if i % 17 == 3 else v for i, v in enumerate(values)] + ["a", "a", "", None]
    want = [None if v is None else [(m.group(), *m.span()) for m in regex.finditer(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]", v)] for v in values]
    show = lambda rows: [None if r is None else [tuple(s.values()) for s in r] for r in rows]
    assert show(tx._token_offsets(pa.array(values)).to_pylist()) == want
    assert show(tx._token_offsets(pa.array(values).slice(7, 90)).to_pylist()) == want[7:97]
    assert tx._token_offsets(pa.array([], pa.string())).to_pylist() == []


def test_token_offsets_leave_the_worker_by_stretch(spark):
    """A worker never holds the tokens of a whole batch, and the scan's arrays stay small."""
    batch = pa.array(["some words, 12 " * 200] * 1500 + [None, "", "x"])
    tracemalloc.start()
    sizes, words = [], 0
    for piece in tx._sent_by_stretch(iter([batch, batch.slice(0, 0), batch.slice(1500)])):
        sizes.append(len(piece))
        words += pc.sum(pc.list_value_length(piece)).as_py() or 0
        assert piece.nbytes < 8 * tx.SCAN_BYTES
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(sizes) == 1506 and max(sizes) < 200 and words == 1500 * 800 + 2
    assert peak < 40 << 20
    rows = spark.range(0, 300, 1, 1).select(F.concat(F.repeat(F.lit("a b."), 1000), F.col("id").cast("string")).alias("t"))
    got = rows.select(F.col("t"), tx.token_offsets(F.col("t")).alias("s")).select(F.substring_index("t", ".", -1).alias("id"), F.element_at("s", -1)["tok"].alias("last"), F.size("s").alias("n")).collect()
    assert [(int(r.id), r.last, r.n) for r in got] == [(i, str(i), 3001) for i in range(300)]


def test_a_long_text_is_scanned_by_piece(monkeypatch):
    """What the scan of one long text takes beside its tokens does not grow with it; words that a border cuts stay whole."""
    parts = ["é" * 700_000, " ", "字," * 300_000, "\n" * 600_000, "some words, 12 " * 200_000, "x_" * 400_000]
    text = "".join(parts)
    batch = pa.array(["before", text, None, text[:10], " " * 600_000, "after"])
    tracemalloc.start()
    rows = [row for piece in tx._sent_by_stretch(iter([batch])) for row in piece]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 10 * len(text.encode())
    want = [(m.group(), *m.span()) for m in regex.finditer(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]", text)]
    assert [tuple(s.values()) for s in rows[1].as_py()] == want and len(want) == 2 + 600_000 + 800_000
    assert [None if r.as_py() is None else len(r) for r in rows] == [1, len(want), None, 1, 0, 1]


def test_argmax_takes_the_first_of_equals(spark):
    assert column(spark, [[1.0, 3.0, 3.0], [2.0]], ar.argmax, "array<double>") == [1, 0]


def test_softmax_is_stable(spark):
    rows = column(spark, [[1000.0, 1000.0], [0.0, -1000.0]], ar.softmax, "array<double>")
    assert rows[0] == [0.5, 0.5] and rows[1][0] == pytest.approx(1.0)
    logs = column(spark, [[1000.0, 1000.0]], ar.log_softmax, "array<double>")
    assert logs[0] == pytest.approx([-0.6931471805599453] * 2)


def test_pad_to(spark):
    got = column(spark, [[1, 2, 3], []], lambda v: ar.pad_to(v, F.lit(2), F.lit(0)), "array<int>")
    assert got == [[1, 2], [0, 0]]


def test_bleu_tokens(spark):
    values = ['Hello, world! &quot;a&amp;b&quot; 1,000.5 co-op 5-6 <skipped>x-\ny', "it's $5.", "", "end-\n"]
    want = [
        ["Hello", ",", "world", "!", '"', "a", "&", "b", '"', "1,000.5", "co-op", "5", "-", "6", "xy"],
        ["it", "'", "s", "$", "5", "."],
        [],
        ["end-"],
    ]
    want[1] = ["it's", "$", "5", "."]
    assert column(spark, values, tx.bleu_tokens) == want
