"""Embedding near-duplicates against all pairs, with clusters, equal vectors, crowded buckets and odd input."""

from __future__ import annotations

import numpy as np

from stairwell.llm import binary_codes


def vectors(rng: np.random.Generator) -> list[list | None]:
    out = list(rng.normal(size=(900, 24)))
    for size, noise in [(60, 0.25), (30, 0.35), (15, 0.1), (5, 0.42)]:
        out += list(rng.normal(size=24) + noise * rng.normal(size=(size, 24)))
    out += [3.5 * out[0], out[1], out[1], out[1], -out[2]]
    rows = [x.tolist() for x in out]
    return rows + [None, [], [0.0] * 24, [1.0, None] + [0.0] * 22, [float("nan")] * 24, [float("inf")] + [0.0] * 23, [1.0, 2.0], [1e-200] * 24, [1e200] * 24]


def brute(ids: list[int], rows: list) -> tuple[dict, dict]:
    unit = {i: np.array(r) / max(map(abs, r)) for i, r in zip(ids, rows, strict=True) if r and len(r) == 24 and None not in r and np.isfinite(r).all() and any(r)}
    unit = {i: x / np.linalg.norm(x) for i, x in unit.items()}
    names = sorted(unit)
    cosine = np.array([unit[i] for i in names]) @ np.array([unit[i] for i in names]).T
    linked = (cosine >= 0.9) & ~np.eye(len(names), dtype=bool)
    links = dict.fromkeys(ids, 0) | {i: int(linked[k].sum()) for k, i in enumerate(names)}
    group = {i: i for i in ids}
    for _ in range(50):
        for k, i in enumerate(names):
            group[i] = min([group[i], *(group[names[j]] for j in np.flatnonzero(linked[k]))])
    return links, group


def run(spark, monkeypatch) -> None:
    rng = np.random.default_rng(3)
    rows = vectors(rng)
    ids = rng.permutation(5000)[: len(rows)].tolist()
    links, group = brute(ids, rows)
    data = [(i, r, 1) for i, r in zip(ids, rows, strict=True)] + [(None, rows[0], 1), (ids[5], rows[5], 1)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, n_links int").repartition(4)
    got = binary_codes.near_duplicates(df, 0.9).collect()
    assert len(got) == len(data)
    pairs = found = 0
    for r in got:
        if r.vec_id is None:
            assert r.n_links == 0 and r.component_id is None and r.kept
            continue
        assert r.n_links <= links[r.vec_id] and r.kept == (r.component_id == r.vec_id)
        pairs, found = pairs + links[r.vec_id], found + r.n_links
    assert pairs > 2000 and found >= 0.99 * pairs
    assert np.mean([r.component_id == group[r.vec_id] for r in got if r.vec_id is not None]) >= 0.995


def test_like_all_pairs(spark, monkeypatch):
    run(spark, monkeypatch)


def test_crowded_buckets_are_cut(spark, monkeypatch):
    monkeypatch.setattr(binary_codes, "BLOCK", 20)
    run(spark, monkeypatch)


def test_every_length_links(spark):
    """Lengths as common as others and rare ones: pairs of one length link, pairs of different lengths never."""
    rng = np.random.default_rng(5)
    data, want, i = [], {}, 0
    for width, pairs in ((24, 40), (23, 40), (3, 1), (1, 1), (200, 2)):
        for _ in range(pairs):
            base = rng.normal(size=width)
            for vector in (base, 2 * base + 0.01 * rng.normal(size=width)):
                data.append((i, vector.tolist()))
                want[i] = i - i % 2
                i += 1
    data += [(i, [1.0] * 7), (i + 1, [1.0] * 8), (i + 2, [1.0] * 8)]
    got = {r.vec_id: r for r in binary_codes.near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<double>"), 0.9).collect()}
    wide = [k for k, v in data if len(v) > 3]
    expected = want | {i: i, i + 1: i + 1, i + 2: i + 1}
    assert {k: got[k].component_id for k in wide} == {k: expected[k] for k in wide}
    assert all(len(data[r.component_id][1]) == len(data[k][1]) for k, r in got.items())


def test_nothing_to_compare(spark):
    schema = "vec_id long, embedding array<float>"
    assert binary_codes.near_duplicates(spark.createDataFrame([], schema), 0.9).collect() == []
    got = binary_codes.near_duplicates(spark.createDataFrame([(4, None), (9, [0.0])], schema), 0.9).collect()
    assert sorted(map(tuple, got)) == [(4, 0, 4, True), (9, 0, 9, True)]
