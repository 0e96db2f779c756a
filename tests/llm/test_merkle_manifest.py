"""The manifest against a recursive one; blocks of any size; tampering; odd tables."""

from __future__ import annotations

import random
from hashlib import sha256

from pyspark.sql import functions as F

from stairwell.llm.merkle_manifest import MerkleManifest, digest_of_proof, fold, forward, leaf_digest, reverse

hashed = lambda s: sha256(s.encode()).hexdigest()


def levels_of(digests: list[str], run: int) -> list[list[str]]:
    out = [digests]
    while len(out[-1]) > 1:
        out.append([hashed("".join(out[-1][k : k + run])) for k in range(0, len(out[-1]), run)])
    return out


def siblings(levels: list[list[str]], place: int, run: int) -> str:
    out = ""
    for level in levels[:-1]:
        begin = place // run * run
        out += "".join(level[begin:place] + level[place + 1 : begin + run])
        place //= run
    return out


def manifest(rows: list[tuple], run: int) -> dict:
    """(tree, key, digest) -> (subroot, root, digest of the proof)."""
    trees: dict = {}
    for tree, key, digest in sorted(rows, key=lambda r: (r[0] is not None, (r[0] or "").encode(), r[1] is not None, r[1] or 0, r[2])):
        trees.setdefault(tree, []).append((key, digest))
    built = {t: levels_of([d for _, d in leaves], run) for t, leaves in trees.items()}
    top = levels_of([b[-1][0] for b in built.values()], run)
    out: dict = {}
    for k, (t, leaves) in enumerate(trees.items()):
        for place, (key, digest) in enumerate(leaves):
            proof = siblings(built[t], place, run) + siblings(top, k, run)
            out.setdefault((t, key, digest), []).append((built[t][-1][0], top[-1][0], hashed(proof)))
    return out


def test_sweeps_of_one_block():
    for n in (1, 2, 7, 8, 9, 64, 65, 511, 512):
        digests = [hashed(str(k)) for k in range(n)]
        levels = levels_of(digests, 8)
        known, first = forward(digests, n)
        assert known == [d for level in levels for d in level]
        proofs = reverse(known, first, "")
        assert [digest_of_proof(p) for p in proofs] == [hashed(siblings(levels, k, 8)) for k in range(n)]
        assert all(fold(d, p) == known[-1] for d, p in zip(digests, proofs, strict=True))
        assert all(fold(hashed("x" + d), p) != known[-1] for d, p in zip(digests, proofs, strict=True))


def test_many_tiers(spark):
    """Runs of 2 or 3 and blocks of one or two levels, so that trees and the tree of subroots have several tiers."""
    rng = random.Random(4)
    sizes = {None: 1, "": 5, "a": 70, "b": 33, "ä": 2, **{f"t{k}": 1 + k % 3 for k in range(14)}}
    rows = [(t, k, hashed(f"{t}{k}")) for t, n in sizes.items() for k in range(n)]
    rows += [("a", None, hashed("n")), ("a", 3, hashed("second")), ("b", 4, hashed("b4")), ("b", 4, hashed("b4"))]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, hashed("bad") if r[1] == 1 else None, 9) for r in rows], "lang string, doc_id long, leaf string, wrong string, n int").repartition(4)
    for run, depth in ((2, 1), (3, 2), (8, 4)):
        want = manifest(rows, run)
        got: dict = {}
        for r in MerkleManifest(df.withColumn("same_lang", F.col("lang")), "lang", "doc_id", "leaf", ["same_lang", "wrong"], run, depth).proofs("wrong").collect():
            got.setdefault((r.same_lang, r.key, r.leaf), []).append((r.subroot, r.root, r.proof_sha256))
            assert r.verified == (r.wrong is None) == (r.folded_root == r.root)
        assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_single_leaf_and_empty_table(spark):
    df = spark.createDataFrame([(7, "en", hashed("a"))], "doc_id long, lang string, leaf string")
    row = MerkleManifest(df, "lang", "doc_id", "leaf").proofs().first()
    assert row.subroot == row.root == row.leaf == row.folded_root and row.proof_sha256 == hashed("") and row.verified
    empty = MerkleManifest(df.limit(0), "lang", "doc_id", "leaf")
    assert empty.root is None and empty.proofs().collect() == []


def test_leaf_digest(spark):
    df = spark.createDataFrame([(1, None, "é"), (None, "", None)], "a long, b string, c string")
    got = [r[0] for r in df.select(leaf_digest([F.col(c) for c in "abc"])).collect()]
    assert got == [hashed("1:1-2:é"), hashed("-0:-")]
