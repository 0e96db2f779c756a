"""Merkle manifest of a table by time-forward processing: digests go up in label order, proof suffixes come down in reverse.

Every row is a leaf. The leaves of a tree (a language) are numbered in order; runs of 8 neighbours become their
parent until one node, the subroot, remains; the subroots, in order of their trees, become the root likewise.

A node is labelled by its tree, tier and position, so that children come before parents. Time-forward processing visits the
nodes by label and sends each digest, as a message addressed to the parent's label, into a priority queue that the parent
is served from. The queue is external: blocks of 8^4 neighbours are visited by one task each, in the order in which
Spark's sorting shuffle delivers them; messages within a block wait in a heap of at most its nodes, and the message that
leaves a block, its root, is a row of the next tier's table. The reversed sweep visits the labels from the root down, and the
queue then delivers to every node the suffix of its proof, to which it adds its siblings. A tier is 1/4096 of the one
below; all leaves of a tree never meet in a task, and no digest passes the driver but the root.

Defined results: a null field is ``-``, an empty one ``0:``; null trees and null keys come first; rows that repeat a key are
leaves each, in order of their digests; a tree of one leaf is its own subroot; an empty table has no rows and no root; columns
other than those asked for are ignored. All folding is done again by a lost task, with the same result.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stairwell.llm.common import small, stored

RUN = 8  # neighbours under one parent
DEPTH = 4  # levels of a block
NODES = "tree string, pos long, n long, digest string"


def leaf_digest(fields: list[Column]) -> Column:
    """Hex SHA-256 of the fields, each its byte count, a colon and its value, or ``-``."""
    text = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]), 256)


def _hash(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def _widths(nodes: int, of_tree: int, run: int, depth: int) -> list[int]:
    """Nodes on each level of a block with that many lowest ones, in a tree with ``of_tree`` of them."""
    widths, left = [nodes], of_tree
    while left > 1 and len(widths) <= depth:
        widths.append(-(-widths[-1] // run))
        left = -(-left // run)
    return widths


def forward(digests: list[str], of_tree: int, run: int = RUN, depth: int = DEPTH) -> tuple[list[str], list[int]]:
    """Digests of all nodes of a block by label (level by level), and the first label of each level."""
    widths = _widths(len(digests), of_tree, run, depth)
    first = list(itertools.accumulate(widths, initial=0))
    known: list[str] = []
    queue: list[tuple[int, int, str]] = []  # (label of the parent, label of the child, digest)
    for level, width in enumerate(widths):
        for j in range(width):
            label = first[level] + j
            if level == 0:
                digest = digests[j]
            else:
                got = []
                while queue and queue[0][0] == label:
                    got.append(heapq.heappop(queue)[2])
                digest = _hash("".join(got))
            known.append(digest)
            if level + 1 < len(widths):
                heapq.heappush(queue, (first[level + 1] + j // run, label, digest))
    return known, first


def reverse(known: list[str], first: list[int], suffix: str, run: int = RUN) -> list[str]:
    """Proof of every lowest node of a block: per level ``left siblings,right siblings|``, then the block's own ``suffix``."""
    top = len(first) - 2
    proofs = [""] * first[1]
    queue = [(-first[top], suffix)]
    for level in range(top, -1, -1):
        for label in range(first[level + 1] - 1, first[level] - 1, -1):
            mine = heapq.heappop(queue)[1]
            if level == 0:
                proofs[label] = mine
                continue
            begin = first[level - 1] + (label - first[level]) * run
            children = known[begin : min(begin + run, first[level])]
            for k in range(len(children)):
                heapq.heappush(queue, (-(begin + k), f"{''.join(children[:k])},{''.join(children[k + 1 :])}|{mine}"))
    return proofs


def fold(digest: str, proof: str) -> str:
    """The root that a leaf and its proof lead to."""
    for level in proof.split("|")[:-1]:
        left, right = level.split(",")
        digest = _hash(left + digest + right)
    return digest


def digest_of_proof(proof: str) -> str:
    """Digest of a proof's siblings, level by level, left to right."""
    return _hash(proof.replace(",", "").replace("|", ""))


def _sorted_rows(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for part in parts:
        yield from zip(*[c.to_pylist() for c in part.columns], strict=True)


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 2048) -> Iterator[pa.RecordBatch]:
    while chunk := list(itertools.islice(rows, size)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*chunk, strict=True), schema, strict=True)], schema=schema)


def _numbered(df: DataFrame, tree: Column, order: list[str], keep: list[str], label: str) -> DataFrame:
    """(tree, pos, n, *keep): the rows of every tree numbered in ``order``, and their number. Stored.

    A range shuffle puts the rows in order without gathering a tree; positions are those in the partition plus the rows
    before it. The table of first positions has a row per partition and tree that begins or goes on in it.
    """
    df = df.select(tree.cast("string").alias("tree"), *dict.fromkeys([*order, *keep])).repartitionByRange("tree", *order)
    df = df.sortWithinPartitions("tree", *order).select("tree", *keep, F.monotonically_increasing_id().alias("m"))
    df = stored(df, label).withColumn("part", F.shiftright("m", 33))
    parts = df.groupBy("tree", "part").agg(F.count("*").alias("rows"), F.min("m").alias("start"))
    by_tree = Window.partitionBy("tree")
    before = F.sum("rows").over(by_tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("tree", "part", (F.coalesce(before, F.lit(0)) - F.col("start")).alias("shift"), F.sum("rows").over(by_tree).alias("n"))
    parts = small(stored(parts, f"{label}-parts"), 64)
    here = (df["part"] == parts["part"]) & df["tree"].eqNullSafe(parts["tree"])
    return df.join(parts, here).select(df["tree"], (F.col("m") + F.col("shift")).alias("pos"), "n", *keep)


class MerkleManifest:
    """Trees over the leaves (tree, key, digest) of ``df``, and the proof of every leaf."""

    def __init__(self, df: DataFrame, tree: str, key: str, digest: str, carry: list[str] = (), run: int = RUN, depth: int = DEPTH) -> None:
        self.run, self.depth, self.carry = run, depth, list(carry)
        leaves = df.select(F.col(tree).cast("string").alias("tree"), F.col(key).alias("key"), F.col(digest).alias("digest"), *self.carry)
        self.leaves = _numbered(leaves, F.col("tree"), ["key", "digest"], ["key", "digest", *self.carry], "leaves")
        self.tiers = self._up(self.leaves, "subtrees")
        self.subroots = (self.tiers[-1] if self.tiers else self.leaves).select("tree", "digest")
        ordered = _numbered(self.subroots.withColumnRenamed("tree", "name"), F.lit(""), ["name"], ["name", "digest"], "subroots")
        self.top = [ordered, *self._up(ordered, "roots")]
        found = self.top[-1].select("digest").first()
        self.root = found[0] if found else None

    def _blocks(self, nodes: DataFrame, *more: str) -> DataFrame:
        """``nodes`` with their block, a block in one task and its nodes in order."""
        df = nodes.withColumn("block", F.floor(F.col("pos") / F.lit(self.run**self.depth)).cast("long"))
        return df.select("tree", "block", "pos", "n", "digest", *more).repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")

    def _up(self, nodes: DataFrame, label: str) -> list[DataFrame]:
        """The tiers above ``nodes``: roots of blocks, until every tree has one node."""
        run, depth = self.run, self.depth

        def roots(rows):
            for (tree, block), got in itertools.groupby(rows, lambda r: r[:2]):
                got = list(got)
                known, _ = forward([r[4] for r in got], got[0][3], run, depth)
                yield tree, block, -(-got[0][3] // run**depth), known[-1]

        schema = pa.schema([("tree", pa.string()), ("pos", pa.int64()), ("n", pa.int64()), ("digest", pa.string())])
        tiers, largest = [], nodes.agg(F.max("n")).first()[0] or 0
        while largest > 1:
            up = self._blocks(tiers[-1] if tiers else nodes).mapInArrow(lambda parts: _batches(roots(_sorted_rows(parts)), schema), NODES)
            tiers.append(stored(up, label))
            largest = -(-largest // run**depth)
        return tiers

    def _down(self, nodes: DataFrame, suffixes: DataFrame, carry: list[tuple[str, str]], finish, schema: str) -> DataFrame:
        """``finish(tree, pos, digest, carried values, proof)`` of every node; ``suffixes`` (tree, block, proof) are those of their blocks.

        A block's suffix travels as a row in front of its nodes.
        """
        names = [c for c, _ in carry]
        blank = [F.lit(None).cast(kind).alias(c) for c, kind in carry]
        ahead = suffixes.select("tree", "block", F.lit(-1).cast("long").alias("pos"), F.lit(0).cast("long").alias("n"), F.col("proof").alias("digest"), *blank)
        here = nodes.withColumn("block", F.floor(F.col("pos") / F.lit(self.run**self.depth)).cast("long")).select("tree", "block", "pos", "n", "digest", *names)
        both = ahead.unionByName(here).repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")
        run, depth = self.run, self.depth

        def proofs(rows):
            for (tree, _), got in itertools.groupby(rows, lambda r: r[:2]):
                head, *got = got
                known, first = forward([r[4] for r in got], got[0][3], run, depth)
                for r, proof in zip(got, reverse(known, first, head[4], run), strict=True):
                    yield finish(tree, r[2], r[4], r[5:], proof)

        types = {"string": pa.string(), "bigint": pa.int64()}
        arrow = pa.schema([(c, types[kind]) for c, kind in (x.split() for x in schema.split(", "))])
        return both.mapInArrow(lambda parts: _batches(proofs(_sorted_rows(parts)), arrow), schema)

    def proofs(self, changed: str | None = None) -> DataFrame:
        """(key, *carry, leaf, subroot, root, proof_sha256, folded_root, verified) of every leaf.

        ``changed`` names a carried string column: where it is not null it is folded in place of the leaf's digest.
        """
        between = lambda tree, pos, digest, _, proof: (tree, pos, proof)
        step, plain = "tree string, block bigint, proof string", lambda df: df.select("tree", "pos", "n", "digest")
        whole = self.top[0].sparkSession.createDataFrame([("", 0, "")] if self.root else [], step)
        suffixes = whole
        for tier in self.top[-2:0:-1]:
            suffixes = stored(self._down(plain(tier), suffixes, [], between, step), "suffixes")
        if len(self.top) > 1:
            suffixes = stored(self._down(self.top[0], suffixes, [("name", "string")], lambda tree, pos, digest, more, proof: (more[0], 0, proof), step), "suffixes")
        else:
            suffixes = self.top[0].select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("block"), F.lit("").alias("proof"))
        for tier in self.tiers[-2::-1] if self.tiers else []:
            suffixes = stored(self._down(plain(tier), suffixes, [], between, step), "suffixes")
        kinds = dict(self.leaves.dtypes)
        carry = [(c, kinds[c]) for c in ["key", *self.carry]]
        k = [c for c, _ in carry].index(changed) if changed else None

        def finish(tree, pos, digest, more, proof):
            start = digest if k is None or more[k] is None else more[k]
            return (tree, *more, digest, digest_of_proof(proof), fold(start, proof))

        names = ", ".join(f"{c} {kind}" for c, kind in [("tree", "string"), *carry, *((c, "string") for c in ("leaf", "proof_sha256", "folded_root"))])
        out = self._down(self.leaves, suffixes, carry, finish, names)
        subroots = small(stored(self.subroots.select(F.col("tree").alias("name"), F.col("digest").alias("subroot")), "subroots"), 128)
        out = out.join(subroots, out["tree"].eqNullSafe(subroots["name"]))
        root = F.lit(self.root).cast("string")
        return out.select("key", *self.carry, "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))
