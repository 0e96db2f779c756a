"""Near-duplicates by an LSH forest: sorted signature orders whose longest-common-prefix neighbours are candidates.

A document's set of word shingles gives TREES paths of DEPTH minimum hashes. Documents with equal sets are one node.
In every tree the nodes are sorted by their path; a node's candidates are the rows before it that share at least
MIN_DEPTH steps, the nearest first, so the depth that two nodes must share grows by itself where a region is
crowded and stays at the minimum where it is sparse. In crowded regions the copies of one original resemble
that original more than each other; so every node also meets the region's most popular node, the one whose
paths are shared most, at the minimum depth and at full depth.

The first round checks the two likeliest candidates of a node. In the second, all nodes of a region meet that are not yet
connected, the longest common prefixes first: every region that holds several groups is a cell, and one of more than
BLOCK rows is cut into blocks that meet two by two, where the rows of the region's largest group meet only the others. A sketch
of the signature drops candidates that are far below the threshold; every link is confirmed on the full sets. A cell
confirms its candidates itself and gives a spanning forest of its groups, never a list of pairs.

Defined results: null or empty text, or text without words, has an empty set and is linked with nothing; a null id is
linked with nothing and kept; rows of one id are one document, linked if one of its texts is;
other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stairwell.llm.common import batches_of, connected_components, small, stored

TREES, DEPTH, MIN_DEPTH = 20, 8, 4
LAG = 2  # neighbours before a row in the first round
BLOCK = 512  # rows of a crowded region that meet as one block
SLACK = 0.13  # how far below the threshold a sketch may lie: over 4.5 standard deviations of 160 hashes
CACHE_WORDS = 100_000
BATCH = 500  # rows that carry a text or a whole set in an Arrow batch
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_FACTORS = _mixed(np.arange(1, TREES * DEPTH + 1, dtype="u8") * _MIX[0]) | np.uint64(1)


class _Words(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= CACHE_WORDS:
            self.clear()
        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out


def shingle_set(text: str | None, width: int, words: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles; of fewer words, the whole sequence is one."""
    found = (text or "").encode("utf-8", "replace").lower().split()  # ASCII white space and letters only
    hashes = np.array([words[w] for w in found], "u8")
    if not len(hashes):
        return hashes
    wide = min(width, len(hashes))
    total = np.full(len(hashes) - wide + 1, wide, "u8")
    for k in range(wide):
        total = _mixed(total * _MIX[1] + hashes[k : len(hashes) - wide + 1 + k] * _MIX[2])
    return np.unique(total)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The minimum of every hash function over a set, as 32-bit numbers, tree by tree."""
    out = np.full(len(_FACTORS), np.iinfo("u8").max, "u8")
    for at in range(0, len(shingles), 2048):
        part = shingles[at : at + 2048, None] * _FACTORS
        out = np.minimum(out, (part ^ (part >> np.uint64(29))).min(0))
    return (out >> np.uint64(32)).astype("u4")


def _documents(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))


def forest_rows(docs: DataFrame, width: int) -> DataFrame:
    """(doc, n_shingles, print, heads, tails, sketch): per tree a hash of the path's first steps and the steps that follow."""

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        words = _Words()
        for part in parts:
            for at in range(0, len(part), 1000):
                piece = part.slice(at, 1000)
                out: list[list] = [[], [], [], [], []]
                for text in piece.column(1):
                    found = shingle_set(text.as_py(), width, words)
                    out[0].append(len(found))
                    if not len(found):
                        for column in out[1:]:
                            column.append(None)
                        continue
                    paths = signature(found).reshape(TREES, DEPTH)
                    out[1].append(xxhash.xxh3_128_digest(found.tobytes()))
                    head = np.arange(1, TREES + 1, dtype="u8")
                    for step in range(MIN_DEPTH):
                        head = _mixed(head * _MIX[0] + paths[:, step])
                    out[2].append(head.view("i8"))
                    out[3].append(paths[:, MIN_DEPTH:].astype(">u4").tobytes())
                    out[4].append(paths.astype("u1").tobytes())
                kinds = [pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([piece.column(0), *[pa.array(c, t) for c, t in zip(out, kinds, strict=True)]], names)

    names = ["doc", "n_shingles", "print", "heads", "tails", "sketch"]
    return docs.mapInArrow(rows, "doc long, n_shingles long, print binary, heads array<long>, tails binary, sketch binary")


def _alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal hashes of sketches (rows of bytes)."""
    return (a == b).mean(1)


def _neighbours(rows: DataFrame, lag: int, least: float, parts: int) -> DataFrame:
    """(a, b, alike): rows of a tree near each other in its order, with shared heads and different groups.

    The order is cut into ranges anywhere, also within equal paths; the last rows before a cut are met again with
    the first rows behind it.
    """
    fields = "tree int, head long, tail binary, doc long, grp long, sketch binary"

    def pairs(part: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"a": [], "b": [], "alike": []}).astype({"a": "i8", "b": "i8", "alike": "f8"})]
        head, tree, doc, grp = (part[c].to_numpy() for c in ("head", "tree", "doc", "grp"))
        sketch = np.frombuffer(b"".join(part["sketch"]), "u1").reshape(len(part), -1)
        for k in range(1, min(lag, len(part) - 1) + 1):
            near = np.flatnonzero((head[k:] == head[:-k]) & (tree[k:] == tree[:-k]) & (grp[k:] != grp[:-k]))
            alike = _alike(sketch[near], sketch[near + k])
            near, alike = near[alike >= least], alike[alike >= least]
            x, y = doc[near], doc[near + k]
            out.append(pd.DataFrame({"a": np.minimum(x, y), "b": np.maximum(x, y), "alike": alike}))
        return pd.concat(out)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, first = None, None
        for part in batches:
            if not len(part):
                continue
            whole = part if last is None else pd.concat([last, part], ignore_index=True)
            found = pairs(whole)
            if last is not None:  # pairs within the rows kept from before have been sent already
                old = pairs(last).drop_duplicates(["a", "b"])
                found = pd.concat([old, found]).drop_duplicates(["a", "b"]).iloc[len(old) :]
            yield found.assign(edge=None)
            first = whole.iloc[:lag] if first is None or len(first) < lag else first
            last = whole.iloc[-lag:].reset_index(drop=True)
        if last is not None:
            both = pd.concat([first, last]).drop_duplicates(["tree", "doc"])
            yield pd.DataFrame({"a": None, "b": None, "alike": None, "edge": both.to_dict("records")})

    kinds = f"a long, b long, alike double, edge struct<{fields.replace(' ', ':').replace(',:', ',')}>"
    order = ["tree", "head", "tail", "doc"]
    ranged = rows.select(*[f.split()[0] for f in fields.split(", ")]).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    found = stored(ranged.mapInPandas(scan, kinds), "neighbours")
    # The rows beside all cuts, a few per range, in order again: at most 2 * lag * parts of them.
    cuts = found.where("edge is not null").select("edge.*")
    ahead = Window.partitionBy("tree", "head").orderBy("tail", "doc")
    beside = [F.lag(F.struct("doc", "grp", "sketch"), k).over(ahead).alias(f"l{k}") for k in range(1, lag + 1)]
    cuts = cuts.select("doc", "grp", "sketch", *beside)
    cuts = cuts.select("doc", "grp", "sketch", F.explode(F.array(*[f"l{k}" for k in range(1, lag + 1)])).alias("l")).where("l is not null and l.grp != grp and l.doc != doc")
    cuts = cuts.select(F.least("doc", "l.doc").alias("a"), F.greatest("doc", "l.doc").alias("b"), "sketch", F.col("l.sketch").alias("other"))
    return found.where("a is not null").select("a", "b", "alike").unionByName(_near(cuts, least))


def _cells(rest: DataFrame, regions: DataFrame) -> DataFrame:
    """(cell, tree, doc, grp, tail, sketch, x, y): the rows of every region, dealt to cells in which they meet.

    ``regions`` (tree, head, n, main, n_main) hold several groups. A region is cut into blocks of about BLOCK rows, and a cell is
    a pair of blocks; most regions are one block and one cell. The rows of the region's largest group, ``main``, need not
    meet each other. Blocks of the main group count from 0, the others' from x_blocks.
    """
    one = F.col("n") <= BLOCK
    blocks = regions.select(
        "tree",
        "head",
        "main",
        F.when(one, 0).otherwise(F.ceil(F.col("n_main") / BLOCK)).alias("x_blocks"),
        F.when(one, 1).otherwise(F.ceil((F.col("n") - F.col("n_main")) / BLOCK)).alias("y_blocks"),
    )
    rows = rest.join(small(blocks, 48), ["tree", "head"])
    rows = rows.withColumn("block", F.expr("if(x_blocks > 0 and grp = main, pmod(xxhash64(doc), x_blocks), x_blocks + pmod(xxhash64(doc), y_blocks))"))
    others = "transform(sequence(0, x_blocks + y_blocks - 1), j -> named_struct('x', least(j, block), 'y', greatest(j, block)))"
    main = "transform(sequence(x_blocks, x_blocks + y_blocks - 1), j -> named_struct('x', block, 'y', j))"
    rows = rows.withColumn("cell", F.explode(F.expr(f"if(block < x_blocks, {main}, {others})")))
    cell = F.xxhash64("tree", "head", "cell.x", "cell.y").alias("cell")
    sides = [(F.col("block") == F.col(f"cell.{side}")).alias(side) for side in ("x", "y")]
    return rows.select(cell, "tree", "doc", "grp", "tail", "sketch", *sides)


def _by_cell(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of a task, which are in order of their cells, one cell at a time."""
    kept: list[pa.Table] = []
    for part in parts:
        table = pa.Table.from_batches([part])
        cell = table.column("cell").to_numpy()
        cuts = [0, *(np.flatnonzero(cell[1:] != cell[:-1]) + 1).tolist(), len(cell)]
        for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
            if begin == end:
                continue
            if kept and kept[0].column("cell")[0].as_py() != int(cell[begin]):
                yield pa.concat_tables(kept)
                kept = []
            kept.append(table.slice(begin, end - begin))
    if kept:
        yield pa.concat_tables(kept)


def _candidates_in(cell: pa.Table, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, rows, likeness) of candidates: of different groups and documents, a row of one block with one of the other."""
    doc, grp, in_x, in_y = (cell.column(c).to_numpy() for c in ("doc", "grp", "x", "y"))
    sketch = np.frombuffer(b"".join(cell.column("sketch").to_pylist()), "u1").reshape(len(doc), -1)
    left, right = np.flatnonzero(in_x), np.flatnonzero(in_y)
    within = in_x & in_y  # a block that meets itself, each pair once
    step = max(1, 20_000 // max(len(right), 1))
    for at in range(0, len(left), step):
        some = left[at : at + step]
        wanted = (grp[some, None] != grp[right]) & (doc[some, None] != doc[right])
        wanted &= ~(within[some, None] & within[right]) | (some[:, None] < right)
        k, j = np.nonzero(wanted)
        alike = _alike(sketch[some[k]], sketch[right[j]])
        near = alike >= least
        if near.any():
            yield some[k[near]], right[j[near]], alike[near]


CELL = "cell long, tree int, doc long, grp long, tail binary, sketch binary, x boolean, y boolean"


def _met(cells: DataFrame, docs: DataFrame, sets: DataFrame, width: int, percent: int, least: float) -> DataFrame:
    """(a, b): links between rows of different groups that share a cell; of each cell a spanning forest of its groups.

    First the sketches tell which rows have a candidate in their cell, then only those rows' sets are sent there. A cell tests
    its candidates, the longest common prefixes first, and skips pairs that its own links connect already or that met in
    an earlier tree; so it gives fewer links than it has rows, however many pairs are alike, and a task holds one cell.
    """

    def with_candidates(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in _by_cell(parts):
            near = np.zeros(len(cell), bool)
            for a, b, _ in _candidates_in(cell, least):
                near[a], near[b] = True, True
            if near.any():
                yield from cell.filter(pa.array(near)).combine_chunks().to_batches()

    ordered = lambda df: df.repartition("cell").sortWithinPartitions("cell")
    rows = stored(ordered(cells).mapInArrow(with_candidates, CELL), "candidates")
    heads = sets.where("n_shingles > 0").select("doc", "heads")
    table = _shingles(docs, stored(rows.select("doc").distinct(), "wanted"), width).join(heads, "doc")
    full = ordered(rows.join(table, "doc").select(*[c.split()[0] for c in CELL.split(", ")], "heads", "shingles"))

    def links(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in _by_cell(parts):
            found = _forest_of(cell, least, percent)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["a", "b"])

    with batches_of(docs.sparkSession, BATCH):
        return stored(full.mapInArrow(links, "a long, b long").distinct(), "links")


def _forest_of(cell: pa.Table, least: float, percent: int) -> list[tuple[int, int]]:
    """Confirmed links that connect the cell's groups as far as its rows do."""
    pairs = list(_candidates_in(cell, least))
    if not pairs:
        return []
    a, b, alike = (np.concatenate(c) for c in zip(*pairs, strict=True))
    doc, grp, tree = (cell.column(c).to_numpy() for c in ("doc", "grp", "tree"))
    heads = np.array(cell.column("heads").to_pylist(), "i8")
    tail = np.frombuffer(b"".join(cell.column("tail").to_pylist()), "u4").reshape(len(doc), -1)
    fresh = np.ones(len(a), bool)  # no earlier tree has both in one region, where they met
    for s in range(int(tree.max())):
        fresh &= (heads[a, s] != heads[b, s]) | (s >= tree[a])
    a, b, alike = a[fresh], b[fresh], alike[fresh]
    depth = np.logical_and.accumulate(tail[a] == tail[b], axis=1).sum(1)
    order = np.lexsort((-alike, -depth))
    sets = [np.frombuffer(x, "u8") for x in cell.column("shingles").to_pylist()]
    parent = {g: g for g in grp.tolist()}

    def root(g: int) -> int:
        while parent[g] != g:
            parent[g] = g = parent[parent[g]]
        return g

    out = []
    for i, j in zip(a[order].tolist(), b[order].tolist(), strict=True):
        p, q = root(int(grp[i])), root(int(grp[j]))
        if p != q and _linked(sets[i], sets[j], percent):
            parent[max(p, q)] = min(p, q)
            out.append((int(doc[i]), int(doc[j])))
    return out


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if not (len(x) and len(y)) or 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= percent * (len(x) + len(y) - common)


def _near(pairs: DataFrame, least: float) -> DataFrame:
    """(a, b, alike): the pairs (a, b, sketch, other) whose sketches are at least so alike.

    Likeness and choice are one step: a filter on a column from Python would be pushed down with that function, which
    then runs twice, in two workers a task.
    """

    def near(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if not len(part):
                continue
            alike = _alike(*(np.frombuffer(b"".join(part.column(c).to_pylist()), "u1").reshape(len(part), -1) for c in (2, 3)))
            kept = pa.array(alike >= least)
            yield pa.RecordBatch.from_arrays([*(part.column(c).filter(kept) for c in (0, 1)), pa.array(alike[alike >= least])], ["a", "b", "alike"])

    return pairs.mapInArrow(near, "a long, b long, alike double")


def _pivots(rows: DataFrame, least: float) -> DataFrame:
    """(a, b, alike): every row with the most popular row of its region, at the minimum and at full depth, if in another group."""
    found = []
    for region in (["tree", "head"], ["tree", "head", "tail"]):
        best = F.max_by(F.struct(F.col("doc").alias("p"), F.col("grp").alias("pg"), F.col("sketch").alias("ps")), F.struct("popular", -F.col("doc")))
        top = rows.groupBy(*region).agg(best.alias("top"), F.count("*").alias("n")).where("n > 1").select(*region, "top.*")
        pairs = rows.join(top, region).where("grp != pg and doc != p")
        found.append(pairs.select(F.least("doc", "p").alias("a"), F.greatest("doc", "p").alias("b"), "sketch", "ps").dropDuplicates(["a", "b"]))
    pairs = found[0].unionByName(found[1]).dropDuplicates(["a", "b"])
    return _near(pairs.select("a", "b", "sketch", F.col("ps").alias("other")), least)


def _shingles(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(doc, shingles): the full sets of the documents in the stored table ``ids``, made anew from their texts. Stored."""

    def sets(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for part in parts:
            for at in range(0, len(part), 500):
                piece = part.slice(at, 500)
                found = [shingle_set(t.as_py(), width, words).tobytes() for t in piece.column(1)]
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(found, pa.binary())], ["doc", "shingles"])

    wanted = docs.join(small(ids, 16), "doc", "left_semi").select("doc", "text")
    with batches_of(docs.sparkSession, BATCH):
        return stored(wanted.mapInArrow(sets, "doc long, shingles binary").distinct(), "shingles")


def _confirmed(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs, a few per document, whose full sets reach the threshold."""
    ids = stored(pairs.select(F.explode(F.array("a", "b")).alias("doc")).distinct(), "wanted")
    table = _shingles(docs, ids, width)

    @F.pandas_udf("boolean")
    def linked(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([_linked(np.frombuffer(x, "u8"), np.frombuffer(y, "u8"), percent) for x, y in zip(a, b, strict=True)], dtype=bool)

    left = pairs.join(table.select(F.col("doc").alias("a"), F.col("shingles").alias("x")), "a")
    both = left.join(table.select(F.col("doc").alias("b"), F.col("shingles").alias("y")), "b")
    with batches_of(docs.sparkSession, BATCH):
        return stored(both.where(linked("x", "y")).select("a", "b").distinct(), "links")


def near_duplicates(docs: DataFrame, width: int, percent: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id, kept): a row per document, with the smallest key it is connected with.

    Two documents are linked if 100 * intersection >= percent * union of their sets of ``width``-word shingles.
    """
    spark = docs.sparkSession
    docs = _documents(docs, key, text)
    with batches_of(spark, BATCH):
        sets = stored(forest_rows(docs, width), "forest")
    nodes = sets.where("doc is not null and n_shingles > 0")
    # Sets that occur once need no partner; the others are few enough to meet their copies without a shuffle, mostly.
    first = nodes.groupBy("print").agg(F.min("doc").alias("rep"), F.count("*").alias("n")).where("n > 1").select("print", "rep")
    copies = nodes.select("doc", "print").join(small(stored(first, "prints"), 40), "print").select("doc", "rep")
    copies = stored(copies.where("doc != rep"), "copies")
    alone = nodes.join(small(copies.select("doc").distinct(), 16), "doc", "left_anti")
    heads = alone.select("doc", "print", F.posexplode("heads").alias("tree", "head"))
    shared = heads.groupBy("tree", "head").agg(F.count("*").alias("n")).where("n > 1").select("tree", "head")
    members = heads.join(shared, ["tree", "head"]).groupBy("doc", "print").agg(F.map_from_entries(F.collect_set(F.struct("tree", "head"))).alias("at"))
    rows = alone.join(members, ["doc", "print"]).select("doc", "tails", "sketch", F.explode("at").alias("tree", "head"))
    steps = 4 * (DEPTH - MIN_DEPTH)
    rows = rows.select("tree", "head", F.expr(f"substring(tails, tree * {steps} + 1, {steps})").alias("tail"), "doc", "sketch")
    rows = stored(rows, "rows")
    depth = rows.groupBy("tree", "head", "tail").agg(F.count("*").alias("n"))
    popular = rows.join(depth, ["tree", "head", "tail"]).groupBy("doc").agg(F.sum("n").alias("popular"))
    rows = stored(rows.join(popular, "doc"), "rows")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    least = percent / 100 - SLACK

    fresh = rows.withColumn("grp", F.col("doc"))
    pairs = _pivots(fresh, least).unionByName(_neighbours(fresh, LAG, least, parts)).dropDuplicates(["a", "b"])
    best = Window.partitionBy("doc").orderBy(F.desc("alike"), "a", "b")
    sides = stored(pairs, "pairs")
    likeliest = sides.select("a", "b", "alike", F.explode(F.array("a", "b")).alias("doc"))
    # A hub is in many pairs; each of its partners keeps its own two, so ranking is needed on the partners' side only.
    often = likeliest.groupBy("doc").agg(F.count("*").alias("n")).where(F.col("n") <= 4 * TREES)
    ranked = likeliest.join(often, "doc").withColumn("rank", F.row_number().over(best)).where("rank <= 2").select("a", "b").distinct()
    links = _confirmed(stored(ranked, "first"), docs, width, percent)

    edges = copies.select(F.col("doc").alias("a"), F.col("rep").alias("b")).unionByName(links)
    found = stored(connected_components(edges), "components").select(F.col("id").alias("doc"), F.col("component").alias("grp"))
    rest = rows.join(found, "doc", "left").withColumn("grp", F.coalesce("grp", "doc"))
    rest = stored(rest, "rest")
    # Only regions that hold two groups still matter.
    sizes = rest.groupBy("tree", "head", "grp").agg(F.count("*").alias("n"))
    sizes = sizes.groupBy("tree", "head").agg(F.sum("n").alias("n"), F.max(F.struct("n", "grp")).alias("top"), F.count("*").alias("groups"))
    mixed = stored(sizes.where("groups > 1").select("tree", "head", "n", F.col("top.grp").alias("main"), F.col("top.n").alias("n_main")), "mixed")
    edges = edges.unionByName(_met(_cells(rest, mixed), docs, sets, width, percent, least))
    found = stored(connected_components(edges), "components")
    out = sets.select("doc", "n_shingles").join(found.withColumnRenamed("id", "doc"), "doc", "left")
    component = F.coalesce("component", "doc")
    return out.select(F.col("doc").alias(key), "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc"), F.lit(True)).alias("kept"))
