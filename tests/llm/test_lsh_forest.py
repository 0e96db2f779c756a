"""Near-duplicates against brute force over planted families, and odd input."""

from __future__ import annotations

import random
import re

import pyarrow as pa
import pytest

from stairwell.llm import lsh_forest
from stairwell.llm.common import connected_components


def shingles(text: str | None) -> set:
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(words)} if 0 < len(words) < 3 else {tuple(words[k : k + 3]) for k in range(len(words) - 2)}


def brute(docs: list[tuple]) -> dict[int, int]:
    found = {i: i for i, _ in docs}

    def root(x: int) -> int:
        while found[x] != x:
            x = found[x]
        return x

    sets = [(i, shingles(t)) for i, t in docs]
    for k, (a, x) in enumerate(sets):
        for b, y in sets[:k]:
            if x and y and 100 * len(x & y) >= 85 * len(x | y) and root(a) != root(b):
                found[max(root(a), root(b))] = min(root(a), root(b))
    return {i: root(i) for i in found}


def families(rng: random.Random) -> list[str | None]:
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    texts: list[str | None] = []
    for size, edits, length in [(40, 3, 150), (25, 6, 160), (12, 1, 40), (8, 4, 90), (3, 1, 25)]:
        base = [word() for _ in range(length)]
        for k in range(size):
            copy = list(base)
            for _ in range(edits * (k > 0)):  # a star: copies are nearer to the original than to each other
                copy[rng.randrange(length)] = word()
            texts.append(" ".join(copy).upper() if k % 5 == 1 else " ".join(copy))
    chain = [word() for _ in range(120)]
    for _ in range(10):
        chain = list(chain)
        chain[rng.randrange(120)] = word()
        chain[rng.randrange(120)] = word()
        texts.append("\n".join(chain))
    texts += [" ".join(word() for _ in range(rng.randint(1, 60))) for _ in range(60)]
    texts += ["same text", "same  TEXT", "same", "", None, " \t ", "É a b", "é a b", "a\x1cb c d", texts[0], texts[0], "w " * 30_000, "w " * 29_000]
    return texts


def test_like_brute_force(spark):
    rng = random.Random(11)
    texts = families(rng)
    ids = rng.sample(range(10_000), len(texts))
    docs = list(zip(ids, texts, strict=True))
    want = brute(docs)
    rows = [(i, t, 5, True) for i, t in docs] + [(None, texts[0], 5, True), (ids[3], texts[3], 5, True)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id long, kept boolean").repartition(5)
    got = lsh_forest.near_duplicates(df, 3, 85).collect()
    assert len(got) == len(rows)
    by = dict(docs)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.component_id, r.kept, r.n_shingles) == (want[r.doc_id], want[r.doc_id] == r.doc_id, len(shingles(by[r.doc_id])))


@pytest.mark.parametrize("block", [70, 1000])
def test_all_groups_of_a_crowded_region_meet(spark, monkeypatch, block):
    """600 rows tie on one path: every pair of different groups is a candidate once, in many cells or in one."""
    monkeypatch.setattr(lsh_forest, "BLOCK", block)
    group = [0] * 200 + [1] * 100 + list(range(2, 302))
    rows = [(0, 5, b"t" * 16, d, g, b"s" * 160) for d, g in enumerate(group)]
    df = spark.createDataFrame(rows, "tree int, head long, tail binary, doc long, grp long, sketch binary").repartition(4)
    regions = spark.createDataFrame([(0, 5, 600, 0, 200)], "tree int, head long, n long, main long, n_main long")
    cells = lsh_forest._cells(df, regions).repartition(3, "cell").sortWithinPartitions("cell")

    def pairs(parts):
        for cell in lsh_forest._by_cell(parts):
            doc = cell.column("doc").to_numpy()
            for a, b, _ in lsh_forest._candidates_in(cell, 0.72):
                yield pa.RecordBatch.from_arrays([pa.array(doc[a]), pa.array(doc[b])], ["a", "b"])

    got = [(min(r), max(r)) for r in cells.mapInArrow(pairs, "a long, b long").collect()]
    want = {(a, b) for b in range(600) for a in range(b) if group[a] != group[b]}
    assert len(got) == len(set(got)) and set(got) == want


def test_cells_give_forests(spark, monkeypatch):
    """Groups in one region of two trees: the links connect what brute force connects, and each cell has fewer links than groups."""
    rng = random.Random(3)
    base = [str(rng.random()) for _ in range(60)]
    texts = [" ".join(base[: rng.randint(40, 60)] + [str(k)] * (k % 3)) for k in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc long, text string").repartition(3)
    sets = lsh_forest.forest_rows(docs, 3)
    rows = [(t, 5, bytes([d % 7]) * 16, d, d, b"s" * 160) for d in range(60) for t in (0, 1)]
    rest = spark.createDataFrame(rows, "tree int, head long, tail binary, doc long, grp long, sketch binary")
    regions = spark.createDataFrame([(t, 5, 60, 0, 1) for t in (0, 1)], "tree int, head long, n long, main long, n_main long")
    want = brute(list(enumerate(texts)))
    for block in (1000, 20):
        monkeypatch.setattr(lsh_forest, "BLOCK", block)
        links = lsh_forest._met(lsh_forest._cells(rest, regions), docs, sets, 3, 85, 0.0)
        links = [tuple(r) for r in links.collect()]
        found = {r.id: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
        assert {d: found.get(d, d) for d in range(60)} == want
        assert block == 20 or len(links) <= 59 * 2
        assert all(100 * len(shingles(texts[a]) & shingles(texts[b])) >= 85 * len(shingles(texts[a]) | shingles(texts[b])) for a, b in links)


def test_pairs_of_several_trees_in_a_later_batch(spark):
    """Every pair is found in two trees of the same Arrow batch."""
    rows = [(t, t, b"t" * 16, 10 * (t // 2) + d, 10 * (t // 2) + d, b"s" * 160) for t in range(40) for d in range(4)]
    df = spark.createDataFrame(rows, "tree int, head long, tail binary, doc long, grp long, sketch binary")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "24")
    try:
        got = {(r.a, r.b) for r in lsh_forest._neighbours(df, 3, 0.72, 1).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == {(10 * j + a, 10 * j + b) for j in range(20) for b in range(4) for a in range(b)}


def test_no_rows(spark):
    assert lsh_forest.near_duplicates(spark.createDataFrame([], "doc_id long, text string"), 3, 85).collect() == []


def test_components_of_long_chains(spark):
    order = list(range(300))
    random.Random(2).shuffle(order)
    links = spark.createDataFrame([*zip(order, order[1:]), (1000, 1001), (1001, 1002), (7, 7), (2000, 2000)], "a long, b long").repartition(6)
    got = {r.id: r.component for r in connected_components(links).collect()}
    assert got == {i: 0 for i in range(300)} | {1000: 1000, 1001: 1000, 1002: 1000}


def test_likeness_is_worked_out_once(spark):
    """A popular row meets its region; likeness and its bound are one Python step, so a task needs one worker."""
    sketch = [bytes([d] * k + [0] * (160 - k)) for d, k in ((0, 0), (1, 16), (2, 120))]
    rows = [(0, 7, b"t", d, d, s, 9 - d) for d, s in enumerate(sketch)]
    rows += [(1, 8, b"u", 5, 1, sketch[0], 1), (1, 8, b"u", 6, 1, sketch[0], 1)]  # of one group
    df = spark.createDataFrame(rows, "tree int, head long, tail binary, doc long, grp long, sketch binary, popular long")
    pairs = lsh_forest._pivots(df, 0.5)
    assert [tuple(r) for r in pairs.collect()] == [(0, 1, 0.9)]
    assert lsh_forest._pivots(df.where("doc < 0"), 0.5).collect() == []
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"ArrowEvalPython|MapInArrow", plan)) == 1
