"""Packing: ids like the library's, a slow restatement of the rule, complete and gapless sequences, odd input."""

from __future__ import annotations

import random
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stairwell.llm import packing, queries
from stairwell.llm.common import stored

PATH = public_tokenizers.path("word_bpe_49k.json")
SMALL = "/root/testdata/sf0.01"


def slow_rule(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """The rule by trying every place and adding up all squares."""
    used: list[int] = []
    out = []
    for size in lengths:
        trials = []
        for gap in sorted({capacity - u for u in used if size <= capacity - u < capacity}):
            place = max((k for k, u in enumerate(used) if capacity - u == gap), key=lambda k: -k)
            trials.append((gap, place))
        trials.append((capacity, len(used)))

        def squares(place: int, size: int = size) -> int:
            after = [u + size * (k == place) for k, u in enumerate(used)] + ([size] if place == len(used) else [])
            open_gaps = [capacity - u for u in after if u < capacity]
            return sum(open_gaps.count(g) ** 2 for g in set(open_gaps))

        gap, place = min(trials, key=lambda t: (squares(t[1]), t[0]))
        if place == len(used):
            used.append(0)
        out.append((gap, size))
        used[place] += size
    return out


def test_the_rule_tries_every_gap():
    rng = random.Random(4)
    for _ in range(30):
        lengths = [rng.randint(1, 12) for _ in range(25)]
        sequence, offset = packing.sum_of_squares(lengths, 12)
        assert [(12 - int(o), n) for o, n in zip(offset, lengths, strict=True)] == slow_rule(lengths, 12)


def check(rows: list, capacity: int) -> None:
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity


def test_ids_and_places_of_odd_input(spark):
    rng = random.Random(8)
    letters = "abé üß'svet 12²½,!?|*\xa0\x1cİΣσ漢🙂\t\n"
    texts = [None, "", "  ", "word " * 700, "It's <|endoftext|> WE'LL", *("".join(rng.choices(letters, k=rng.randint(0, 90))) for _ in range(120))]
    rows = list(enumerate(texts)) + [(None, "no id"), (3, texts[3])]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, length int").repartition(3)
    placed = packing.pack_documents(docs, PATH, capacity=64, keep_ids=True)
    got = placed.collect()
    check(got, 64)
    model, want = Tokenizer.from_file(PATH), []
    for i, t in rows:
        ids = [*model.encode(t or "", add_special_tokens=False).ids, 0]
        want += [(i, at // 64, at, tuple(ids[at : at + 64])) for at in range(0, len(ids), 64)]
    found = [(r.doc_id, r.piece, r.start, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in got]
    assert sorted(found, key=str) == sorted(want, key=str)
    assert all(r.length == len(r.ids) // 4 and r.ids_crc32 == crc32(r.ids) for r in got)
    whole = {r.sequence_id: bytes(r.ids) for r in packing.assemble(placed).collect()}
    assert sum(map(len, whole.values())) == sum(len(r.ids) for r in got)
    r = got[0]
    assert whole[r.sequence_id][4 * r.offset : 4 * (r.offset + r.length)] == r.ids
    assert packing.pack_documents(docs.limit(0), PATH).collect() == []


def test_groups_are_packed_apart(spark):
    pieces = stored(spark.range(500).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), (F.col("id") % 97 + 1).alias("length")), "test")
    got = packing.pack(pieces, capacity=100, group=60).collect()
    check(got, 100)
    assert len(got) == 500 and len({r.sequence_id >> 32 for r in got}) > 3


@pytest.mark.parametrize("folder", [SMALL])
def test_query_fills_sequences(spark, folder):
    got = queries.QUERIES["op5_packing"](spark, folder).collect()
    check(got, 2048)
    docs = {r.doc_id for r in got}
    assert len(docs) == 1000
    least = -(-sum(r.length for r in got) // 2048)
    assert len({r.sequence_id for r in got}) <= 1.02 * least + 1
