"""Embedding near-duplicates: learned binary codes, multi-index Hamming tables, rerank with the vectors.

Iterative quantisation learns, on a bounded sample of unit vectors, rotations whose signs lose little of the vector.
The codes' bits are cut into substrings, one per table; two vectors are candidates if a substring is equal and
the whole codes are near. The length of a substring follows the number of vectors, so buckets keep their size,
and the number of tables follows from it: so many that a pair exactly at the threshold is missed with
probability MISS at most, if bits differ as often as for random hyperplanes. Candidates are compared by exact cosine in
double precision. Equal vectors are one node with a count; a crowded bucket is cut into blocks that are
compared two by two, each in a task of its own.

Defined results: a vector that is null, zero or holds a null or non-finite component links with nothing; vectors of different
lengths do not link, and every length has tables of its own; a null id links with nothing, which is kept; rows of one id are one vector if equal, and
one node with several directions else; other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stairwell.llm.common import connected_components, small, stored

SAMPLE = 8192  # vectors the rotations are learned on
ROUNDS = 30
BUCKET = 512  # vectors a bucket should hold
BLOCK = 2048  # rows of a crowded bucket that are compared at once
MISS = 1e-4
NEAR = 0.36  # share of differing bits up to which a candidate is reranked; unrelated vectors differ in half


def unit_rows(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Places and unit vectors (double precision) of the usable rows."""
    places, rows = [], []
    for k, x in enumerate(column):
        values = x.as_py()
        if values and None not in values:
            row = np.array(values, "f8")
            top = np.abs(row).max()
            if np.isfinite(top) and top > 0:
                row = row / top
                places.append(k)
                rows.append(row / np.sqrt(row @ row))
    return np.array(places, "i8"), rows


def learn_rotations(sample: np.ndarray, count: int, seed: int = 7) -> np.ndarray:
    """``count`` matrices side by side, whose signs are balanced codes of the sample."""
    rng, out = np.random.default_rng(seed), []
    _, axes = np.linalg.eigh(sample.T @ sample)
    turned = sample @ axes
    for _ in range(count):
        spin = np.linalg.qr(rng.normal(size=axes.shape))[0]
        for _ in range(ROUNDS):
            bits = np.where(turned @ spin > 0, 1.0, -1.0)
            u, _, v = np.linalg.svd(bits.T @ turned)
            spin = (u @ v).T
        out.append(axes @ spin)
    return np.concatenate(out, 1)


class Tables:
    """The layout: bits per substring, number of tables, number of learned codes."""

    def __init__(self, rows: int, width: int, threshold: float) -> None:
        flip = math.acos(threshold) / math.pi
        self.bits = max(4, min(40, math.ceil(math.log2(max(rows, 1) / BUCKET)))) if rows > BUCKET else 4
        self.count = math.ceil(math.log(MISS) / math.log(1 - (1 - flip) ** self.bits))
        self.codes = math.ceil(self.bits * self.count / width)

    def keys(self, bits: np.ndarray) -> np.ndarray:
        """The substrings as numbers, a column per table."""
        cut = bits[:, : self.bits * self.count].reshape(len(bits), self.count, self.bits)
        return cut.astype("i8") @ (1 << np.arange(self.bits, dtype="i8"))


def _near_pairs(first: pd.DataFrame, second: pd.DataFrame | None, table: int, layout: Tables) -> pd.DataFrame:
    """Candidates between two blocks, or within one, that no earlier table has found."""
    codes = [np.frombuffer(b"".join(x["code"]), "u1").reshape(len(x), -1) for x in (first, first if second is None else second)]
    ids = [x["id"].to_numpy() for x in (first, first if second is None else second)]
    size, limit, out = codes[0].shape[1], int(NEAR * codes[0].shape[1] * 8), []
    for at in range(0, len(ids[0]), 64):
        far = np.zeros((len(ids[0][at : at + 64]), len(ids[1])), "i4")
        for byte in range(size):
            far += np.bitwise_count(codes[0][at : at + 64, byte, None] ^ codes[1][None, :, byte])
        i, j = np.nonzero(far <= limit)
        i += at
        use = ids[0][i] != ids[1][j]
        if second is None:
            use &= i < j
        out.append(np.stack([i[use], j[use]]))
    i, j = np.concatenate(out, 1) if out else np.empty((2, 0), "i8")
    if len(i) and table:
        keys = [layout.keys(np.unpackbits(c, axis=1)) for c in codes]
        new = (keys[0][i, :table] != keys[1][j, :table]).all(1)
        i, j = i[new], j[new]
    a, b = ids[0][i], ids[1][j]
    return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def _links(nodes: DataFrame, width: int, rows: int, threshold: float) -> DataFrame:
    """(a, b): links among the ``rows`` distinct vectors of one width."""
    layout = Tables(rows, width, threshold)
    sample = nodes.orderBy(F.xxhash64("raw"), "raw").select("unit").limit(SAMPLE).collect()
    rotations = nodes.sparkSession.sparkContext.broadcast(learn_rotations(np.array([np.frombuffer(r.unit) for r in sample]), layout.codes))

    def code(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            units = np.array([np.frombuffer(x.as_py()) for x in part.column(1)]).reshape(-1, width)
            bits = (units @ rotations.value > 0).astype("u1")
            packed = np.packbits(bits, axis=1)
            columns = [part.column(0), pa.array([x.tobytes() for x in packed], pa.binary()), pa.array(list(layout.keys(bits)), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "code", "keys"])

    coded = stored(nodes.select("id", "unit").mapInArrow(code, "id long, code binary, keys array<long>"), "codes")
    index = coded.select("id", "code", F.posexplode("keys").alias("t", "bucket"))
    sizes = index.groupBy("t", "bucket").agg(F.count("*").alias("n")).where("n > 1")
    sizes = stored(sizes.select("t", "bucket", F.ceil(F.col("n") / BLOCK).alias("blocks")), "buckets")
    # A row of a crowded bucket goes to every pair of blocks that its own block is in.
    index = index.join(small(sizes, 32), ["t", "bucket"]).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")))
    index = index.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    index = index.select("t", "bucket", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "id", "code")

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        x, y, table = (int(rows[c].iloc[0]) for c in ("x", "y", "t"))
        if x == y:
            return _near_pairs(rows, None, table, layout)
        return _near_pairs(rows[rows["own"] == x], rows[rows["own"] == y], table, layout)

    pairs = stored(index.groupBy("t", "bucket", "x", "y").applyInPandas(compare, "a long, b long"), "candidates")

    @F.pandas_udf("boolean")
    def linked(a: pd.Series, b: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype=bool)
        x, y = (np.frombuffer(b"".join(s)).reshape(len(s), -1) for s in (a, b))
        return pd.Series((x * y).sum(1) >= threshold)

    units = nodes.select("id", "unit")
    both = pairs.join(units.select(F.col("id").alias("a"), F.col("unit").alias("u")), "a").join(units.select(F.col("id").alias("b"), F.col("unit").alias("v")), "b")
    return stored(both.where(linked("u", "v")).select("a", "b").distinct(), "links")


def near_duplicates(vectors: DataFrame, threshold: float, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(key, n_links, component_id, kept): every vector with the number of others at cosine >= threshold."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(column).cast("array<double>").alias("v"))

    def clean(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            places, units = unit_rows(part.column(1))
            raw = [np.array(part.column(1)[int(k)].as_py(), "f8").tobytes() for k in places]
            columns = [part.column(0).take(pa.array(places)), pa.array(raw, pa.binary()), pa.array([len(x) // 8 for x in raw], pa.int32())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([x.tobytes() for x in units], pa.binary())], ["id", "raw", "width", "unit"])

    usable = rows.where("id is not null").mapInArrow(clean, "id long, raw binary, width int, unit binary")
    nodes = usable.groupBy("raw").agg(F.min("id").alias("id"), F.count_distinct("id").alias("copies"), F.first("width").alias("width"), F.first("unit").alias("unit"))
    nodes = stored(nodes, "vectors")
    # Tables for each width that occurs more than once; vectors of different widths have no cosine.
    widths = nodes.groupBy("width").count().orderBy("width").collect()
    found = [_links(nodes.where(F.col("width") == r.width), r.width, r["count"], threshold) for r in widths if r["count"] > 1]
    links = reduce(DataFrame.unionByName, found, spark.createDataFrame([], "a long, b long"))
    # Links of a node: its copies, and the copies of the nodes it is linked with.
    counts = nodes.groupBy("id").agg(F.sum("copies").alias("copies"))
    ends = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).join(counts.withColumnRenamed("id", "b"), "b")
    near = ends.groupBy(F.col("a").alias("node")).agg(F.sum("copies").alias("near"))
    member = usable.select("id", "raw").distinct().join(nodes.select("raw", F.col("id").alias("node"), "copies"), "raw")
    member = stored(member.join(near, "node", "left").select("id", "node", (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("links")), "members")
    edges = links.unionByName(member.where("id != node").select(F.col("id").alias("a"), F.col("node").alias("b")))
    found = stored(connected_components(edges), "components")
    total = member.groupBy("id").agg(F.sum("links").cast("long").alias("n_links"))
    out = rows.select("id").join(total, "id", "left").join(found, "id", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))
