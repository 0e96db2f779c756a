"""Exact substring repeats by an enhanced suffix array and its common-prefix interval tree.

Two equal strings of LEAST bytes contain the same anchor: the GRAM-byte string with the smallest hash among their
positions. Anchors are dealt by their hash, and those that occur in one place only are dropped. Occurrences whose whole
surroundings are equal are settled at once: all but the earliest are repeats. The others' surroundings meet in groups by
anchor; a group's suffix array is scanned with a stack, every interval of suffixes with a common prefix of LEAST bytes
or more whose left neighbours differ is a maximal repeat with all its occurrences, and all occurrences but the
earliest are covered. Repeats longer than the surroundings come from several anchors and join up.

An anchor with more than HOT different surroundings (a passage that a large part of all documents quotes) is not
gathered in a task: the LEAST-byte strings around it are grouped by two 64-bit hashes, with the earliest
place pre-aggregated.

Defined results: null text is empty; matches do not cross rows; rows of one id are documents in the order of their texts'
hashes, equal rows are one document and each gets its result; null ids come last; texts shorter than LEAST
bytes lose nothing; other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stairwell.llm.common import small, stored

GRAM = 32  # bytes of an anchor
FLAT = 1 << 18  # bytes of text whose anchors are found at once
LIMIT = 1 << 19  # anchors a task holds before it settles what it has
SLICE = 1000  # texts whose anchors are dealt at once
DEAL_BYTES = 16 << 20  # text bytes per bucket of anchors
HOT = 5000  # different surroundings of one anchor that are gathered
GROUP_ROWS = 4000  # surroundings per suffix array, roughly

_ODD = np.uint64(0x9E3779B97F4A7C15 | 1)
_ODD2 = np.uint64(0xC2B2AE3D27D4EB4F | 1)
_RECORD = np.dtype([("gram", "<u8"), ("around", "<u8"), ("doc", "<i8"), ("at", "<i4"), ("begin", "<i4"), ("end", "<i4")])
_LEFT = np.dtype([("gram", "<u8"), ("doc", "<i8"), ("begin", "<i4"), ("end", "<i4")])
_PLACE = np.dtype([("gram", "<u8"), ("begin", "<i4"), ("end", "<i4")])
_SPAN = np.dtype([("doc", "<i8"), ("start", "<i4"), ("stop", "<i4")])


def _powers(base: np.uint64, count: int) -> np.ndarray:
    out = np.full(count, base, "u8")
    out[0] = 1
    return np.multiply.accumulate(out)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Hashes:
    """Hashes of any substrings of a flat text, from sums of bytes times powers of an odd number (modulo 2^64)."""

    def __init__(self, flat: np.ndarray, base: np.uint64) -> None:
        self.up = _powers(base, len(flat) + 1)
        self.down = _powers(np.uint64(pow(int(base), -1, 1 << 64)), len(flat) + 1)
        self.sums = np.zeros(len(flat) + 1, "u8")
        np.cumsum((_mixed(np.arange(1, 257, dtype="u8") * _ODD2)[flat]) * self.up[:-1], out=self.sums[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[begin]) * self.down[begin])

    def all(self, width: int) -> np.ndarray:
        return _mixed((self.sums[width:] - self.sums[:-width]) * self.down[: len(self.sums) - width])


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over every ``width`` neighbours, by doubling."""
    done = 1
    while 2 * done <= width:
        x = pick(x[:-done], x[done:])
        done *= 2
    return pick(x[: len(x) - (width - done)], x[width - done :]) if done < width else x


def _flat_texts(docs: list[tuple[int, bytes]], least: int) -> Iterator[tuple[np.ndarray, list[tuple[int, int, int, int]]]]:
    """Texts laid end to end, about FLAT bytes at a time; of each part: document, its place there, and in the document.

    A longer text is cut into parts that overlap by more than any surroundings.
    """
    margin, chunks, rows, size = 4 * least, [], [], 0
    for doc, text in docs:
        for at in range(0, max(len(text), 1), FLAT):
            begin = max(0, at - margin)
            piece = text[begin : at + FLAT + margin]
            if len(piece) >= least:
                rows.append((doc, size, size + len(piece), begin))
                chunks.append(piece)
                size += len(piece)
            if size >= FLAT:
                yield np.frombuffer(b"".join(chunks), "u1"), rows
                chunks, rows, size = [], [], 0
    if rows:
        yield np.frombuffer(b"".join(chunks), "u1"), rows


def find_anchors(docs: list[tuple[int, bytes]], least: int) -> np.ndarray:
    """Anchors of all LEAST-byte strings of some texts, with a hash of their surroundings."""
    out = [np.empty(0, _RECORD)]
    for flat, rows in _flat_texts(docs, least):
        doc, low, high, base = (np.array(x, "i8") for x in zip(*rows, strict=True))
        hashes = _Hashes(flat, _ODD)
        grams = hashes.all(GRAM)
        width = least - GRAM + 1
        smallest = _slide(grams, width, np.minimum)
        owner = np.repeat(np.arange(len(rows)), high - low)
        # Strings over a text's end count for nothing.
        smallest[owner[: len(smallest)] != owner[least - 1 : least - 1 + len(smallest)]] = 0
        padded = np.concatenate([np.zeros(width - 1, "u8"), smallest, np.zeros(width - 1, "u8")])
        at = np.flatnonzero((_slide(padded, width, np.maximum) == grams) & (grams > 0))
        mine = owner[at]
        begin, end = np.maximum(at - (least - GRAM), low[mine]), np.minimum(at + least, high[mine])
        found = np.empty(len(at), _RECORD)
        found["gram"], found["doc"] = grams[at], doc[mine]
        found["around"] = _mixed(hashes.of(begin, end) + (at - begin).astype("u8") * _ODD + (end - at).astype("u8") * _ODD2)
        shift = base[mine] - low[mine]
        found["at"], found["begin"], found["end"] = at + shift, begin + shift, end + shift
        out.append(found)
    return np.concatenate(out)


def _runs(x: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """The distinct values of a sorted array, and where each begins and ends."""
    kinds, starts = np.unique(x, return_index=True)
    return kinds, list(zip(starts.tolist(), [*starts[1:].tolist(), len(x)], strict=False))


def _only(records: np.ndarray, kind: np.dtype) -> np.ndarray:
    """The fields of ``kind``, packed."""
    out = np.empty(len(records), kind)
    for name in kind.names:
        out[name] = records[name]
    return out


def _blobs(records: np.ndarray, bucket: np.ndarray) -> pa.RecordBatch:
    """(bucket, records as bytes): few rows carry many records through a shuffle."""
    order = np.argsort(bucket, kind="stable")
    records, bucket = records[order], bucket[order]
    kinds, runs = _runs(bucket)
    columns = [pa.array(kinds.astype("i8")), pa.array([records[a:b].tobytes() for a, b in runs], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["bucket", "records"])


def _bucket_of(x: np.ndarray, buckets: int) -> np.ndarray:
    return (_mixed(x.astype("u8")) % np.uint64(buckets)).astype("i8")


def settle(records: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(spans, firsts): of equal surroundings the earliest place stays, the other places are covered.

    The hash of the surroundings determines the anchor.
    """
    around = records["around"].copy()
    order = np.argsort(around, kind="stable")
    around = around[order]
    same = np.append(False, around[1:] == around[:-1])[: len(around)]
    several = np.flatnonzero(same | np.append(same[1:], False))
    if len(several):
        tied = records[order[several]]
        order[several] = order[several][np.lexsort((tied["at"], tied["doc"], around[several]))]
    gone = records[order[same]]
    before = records[order[np.flatnonzero(same) - 1]]
    gone = gone[((gone["doc"] != before["doc"]) | (gone["at"] != before["at"])) & (gone["end"] - gone["begin"] >= least)]
    spans = np.empty(len(gone), _SPAN)
    spans["doc"], spans["start"], spans["stop"] = gone["doc"], gone["begin"], gone["end"]
    return _merged(spans), records[order[~same]]


def _shared(records: np.ndarray) -> np.ndarray:
    """The records whose anchor has another one."""
    _, kind, count = np.unique(records["gram"], return_inverse=True, return_counts=True)
    return records[count[kind] > 1]


def repeat_intervals(pieces: list[bytes], group: np.ndarray, rank: np.ndarray, least: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Maximal repeats among the pieces of every group: (length, pieces, places in them).

    ``rank`` is where a piece begins in an order of all bytes; occurrences come in the order of rank plus place, each place
    once, though pieces of a document may overlap.
    """
    sizes = np.array([len(p) for p in pieces])
    if not len(sizes) or sizes.max() < least:
        return
    wide = int(sizes.max())
    flat = np.frombuffer(b"".join(pieces), "u1")
    starts = np.cumsum(sizes) - sizes
    hashes = _Hashes(flat, _ODD)
    many = np.maximum(sizes - least + 1, 0)
    owner = np.repeat(np.arange(len(sizes)), many)
    place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    begin = starts[owner] + place
    # Only suffixes whose first LEAST bytes occur twice in the group can be in an interval.
    key = _mixed(hashes.of(begin, begin + least) + group[owner].astype("u8") * _ODD)
    _, kind, count = np.unique(key, return_inverse=True, return_counts=True)
    use = np.flatnonzero(count[kind] > 1)
    owner, place, begin = owner[use], place[use], begin[use]
    if not len(use):
        return
    # The suffix array: suffixes in the order of their group and bytes.
    padded = np.append(flat, np.zeros(wide, "u1"))
    length = sizes[owner] - place
    rows = np.lib.stride_tricks.sliding_window_view(padded, wide)[begin]
    rows[np.arange(wide) >= length[:, None]] = 0
    order = np.lexsort((length, rows.view(f"S{wide}").ravel(), group[owner]))
    owner, place, begin, length, rows = owner[order], place[order], begin[order], length[order], rows[order]
    # Common prefixes of neighbours.
    differs = rows[1:] != rows[:-1]
    common = np.where(differs.any(1), differs.argmax(1), wide)
    common = np.minimum(common, np.minimum(length[1:], length[:-1]))
    common[group[owner[1:]] != group[owner[:-1]]] = 0
    # Bytes to the left; the begin of a piece differs from everything.
    left = np.where(place > 0, padded[np.maximum(begin - 1, 0)].astype("i8"), -1 - np.arange(len(place)))
    changes = np.append(0, np.cumsum(left[1:] != left[:-1]))
    where = rank[owner] + place
    stack: list[list[int]] = []  # common prefix and first suffix of the open intervals
    for k, prefix in enumerate([*common.tolist(), 0]):
        first = k
        while stack and stack[-1][0] > prefix:
            size, first = stack.pop()
            # The interval's last suffix is the k-th; without a change to the left it is part of a longer repeat.
            if changes[k] > changes[first]:
                at = first + np.unique(where[first : k + 1], return_index=True)[1]
                if len(at) > 1:
                    yield size, owner[at], place[at]
        if prefix >= least and not (stack and stack[-1][0] == prefix):
            stack.append([prefix, first])


def _numbered(docs: DataFrame, key: str, text: str, carry: list[str]) -> DataFrame:
    """(doc, text, carry): ``doc`` orders the documents; it is the id itself unless ids are missing or repeated."""
    docs = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.struct(key, *carry).alias("carry"))
    odd = docs.groupBy("id").agg(F.count("*").alias("n")).where("id is null or n > 1")
    if odd.isEmpty():
        return docs.select(F.col("id").alias("doc"), "text", "carry")
    order = [F.col("id").isNull(), F.col("id"), F.col("mark")]
    marks = docs.select("id", F.xxhash64("text").alias("mark")).distinct().repartitionByRange(*order).sortWithinPartitions(*order)
    # Ranges follow the order, and the number's high bits are the range.
    marks = stored(marks.withColumn("doc", F.monotonically_increasing_id()), "order")
    on = F.col("d.id").eqNullSafe(F.col("m.id")) & (F.xxhash64("d.text") == F.col("m.mark"))
    return docs.alias("d").join(marks.alias("m"), on).select("m.doc", "d.text", "d.carry")


class SuffixRepeats:
    """The job over one table of texts; ``least`` is the shortest repeat in bytes, ``carry`` names columns that cut() passes on."""

    def __init__(self, docs: DataFrame, least: int = 100, key: str = "doc_id", text: str = "text", carry: list[str] | None = None) -> None:
        if least < 2 * GRAM:
            raise ValueError(f"repeats must have {2 * GRAM} bytes at least")
        self.least = least
        self.docs = _numbered(docs, key, text, [c for c in carry or [] if c != key])

    def _settled(self) -> DataFrame:
        """(kind, bucket, records): spans (0) dealt by document, and the anchors left: gathered (1) and hot (2)."""
        least, size = self.least, self.docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        buckets = self.buckets = max(1, -(-size // DEAL_BYTES))

        def anchors(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in parts:
                for at in range(0, len(part), SLICE):
                    piece = part.slice(at, SLICE)
                    texts = [(d, t.encode("utf-8", "replace")) for d, t in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True)]
                    # Copies within the slice are settled here, so that the shuffle carries one of them.
                    spans, fresh = settle(find_anchors(texts, least), least)
                    yield _tagged(_blobs(fresh, _bucket_of(fresh["gram"], buckets)), 1)
                    yield _tagged(_blobs(spans, _bucket_of(spans["doc"], buckets)), 0)

        def _tagged(batch: pa.RecordBatch, kind: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([kind] * len(batch), pa.int32()), *batch.columns], ["kind", "bucket", "records"])

        schema = "kind int, bucket long, records binary"
        found = self.docs.select("doc", "text").mapInArrow(anchors, schema)

        def compact(kept: np.ndarray, hot: set[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Settles what a bucket holds so far; surroundings of anchors that are or become hot leave it."""
            spans, kept = settle(kept, least)
            grams, kind, count = np.unique(kept["gram"], return_inverse=True, return_counts=True)
            crowded = count > HOT
            if hot:
                crowded |= np.isin(grams, np.array(list(hot), "u8"))
            hot.update(grams[crowded].tolist())
            return spans, kept[~crowded[kind]], kept[crowded[kind]]

        def meet(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def close(kept: np.ndarray, hot: set[int]) -> Iterator[pa.RecordBatch]:
                for kind, records in zip((0, 1, 2), compact(kept, hot), strict=True):
                    if kind == 1:
                        records = _shared(records)
                    yield from send(kind, records)

            def send(kind: int, records: np.ndarray) -> Iterator[pa.RecordBatch]:
                if len(records):
                    records = records if kind == 0 else _only(records, _LEFT)
                    yield _tagged(_blobs(records, _bucket_of(records["doc"], buckets)), kind)

            bucket, held, rows, limit, hot = None, [], 0, LIMIT, set()
            for part in parts:
                spans = part.filter(pa.array(kind == 0 for kind in part.column(0).to_pylist()))
                if len(spans):
                    yield spans
                for kind, b, x in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2), strict=True):
                    if kind == 0:
                        continue
                    if b != bucket:
                        if held:
                            yield from close(np.concatenate(held), hot)
                        bucket, held, rows, limit, hot = b, [], 0, LIMIT, set()
                    held.append(np.frombuffer(x.as_py(), _RECORD))
                    rows += len(held[-1])
                    if rows >= limit:
                        spans, kept, away = compact(np.concatenate(held), hot)
                        yield from send(0, spans)
                        yield from send(2, away)
                        held, rows = [kept], len(kept)
                        limit = max(LIMIT, 2 * rows)
            if held:
                yield from close(np.concatenate(held), hot)

        # Spans pass through the same shuffle, so that the texts are read once and nothing is written twice.
        dealt = found.repartition(buckets, "bucket").sortWithinPartitions("bucket")
        return stored(dealt.mapInArrow(meet, schema), "met")

    def _surroundings(self, settled: DataFrame, kind: int, fn, schema: str) -> DataFrame:
        """``fn(doc, text, records)`` over the documents that have anchors of a kind left."""

        def unpack(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in parts:
                for x in part.column(0):
                    records = np.frombuffer(x.as_py(), _LEFT)
                    records = records[np.argsort(records["doc"], kind="stable")]
                    docs, runs = _runs(records["doc"])
                    places = _only(records, _PLACE)
                    cut = [places[a:b].tobytes() for a, b in runs]
                    yield pa.RecordBatch.from_arrays([pa.array(docs), pa.array(cut, pa.binary())], ["doc", "records"])

        left = settled.where(f"kind = {kind}").select("records").mapInArrow(unpack, "doc long, records binary")
        left = stored(left.groupBy("doc").agg(F.collect_list("records").alias("records")), "left")
        size = left.agg(F.count("*"), F.sum(F.expr("aggregate(records, 0L, (a, x) -> a + length(x))"))).first()
        wanted = small(left, 1, (size[0] or 0) * 32 + (size[1] or 0))
        texts = self.docs.select("doc", "text").join(wanted, "doc")

        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in parts:
                for at in range(0, len(part), 256):
                    piece = part.slice(at, 256).to_pydict()
                    for row in zip(piece["doc"], piece["text"], piece["records"], strict=True):
                        records = np.unique(np.frombuffer(b"".join(row[2]), _PLACE))
                        yield from fn(row[0], row[1].encode("utf-8", "replace"), records)

        return texts.select("doc", "text", "records").mapInArrow(run, schema)

    def _groups(self, settled: DataFrame) -> DataFrame:
        """Surroundings (cell, gram, doc, begin, piece) of the gathered anchors; a cell's groups share a suffix array."""
        cells = settled.where("kind = 1").agg(F.sum(F.length("records"))).first()[0] or 0
        cells = max(1, cells // _LEFT.itemsize // GROUP_ROWS)

        def pieces(doc: int, text: bytes, records: np.ndarray) -> Iterator[pa.RecordBatch]:
            cut = [text[a:b] for a, b in zip(records["begin"].tolist(), records["end"].tolist(), strict=True)]
            columns = [pa.array(_bucket_of(records["gram"], cells)), pa.array(records["gram"].view("i8")), pa.array([doc] * len(cut), pa.int64()), pa.array(records["begin"].copy()), pa.array(cut, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["cell", "gram", "doc", "begin", "piece"])

        return self._surroundings(settled, 1, pieces, "cell long, gram long, doc long, begin int, piece binary")

    def _scan(self, settled: DataFrame, fn, schema: str) -> DataFrame:
        """``fn`` over the maximal repeats of every cell's groups: (length, docs, starts), the earliest first."""
        least = self.least

        def scan(rows: pd.DataFrame) -> pd.DataFrame:
            doc, begin = rows["doc"].to_numpy(), rows["begin"].to_numpy().astype("i8")
            group = np.unique(rows["gram"].to_numpy(), return_inverse=True)[1]
            rank = np.unique(doc, return_inverse=True)[1].astype("i8") * (int(begin.max()) + 8 * least) + begin
            return fn((size, doc[owner], begin[owner] + place) for size, owner, place in repeat_intervals(rows["piece"].tolist(), group, rank, least))

        return self._groups(settled).groupBy("cell").applyInPandas(scan, schema)

    def _hot_spans(self, settled: DataFrame) -> DataFrame:
        """Covered strings around hot anchors: of every LEAST-byte string around them, all places but the earliest."""
        least = self.least

        def strings(doc: int, text: bytes, records: np.ndarray) -> Iterator[pa.RecordBatch]:
            flat = np.frombuffer(text, "u1")
            first, second = _Hashes(flat, _ODD), _Hashes(flat, _ODD2)
            at = np.unique(np.concatenate([np.arange(a, b - least + 1) for a, b in zip(records["begin"].tolist(), records["end"].tolist(), strict=True)]))
            columns = [pa.array(h.of(at, at + least).view("i8")) for h in (first, second)] + [pa.array([doc] * len(at), pa.int64()), pa.array(at.astype("i4"))]
            yield pa.RecordBatch.from_arrays(columns, ["h", "g", "doc", "start"])

        rows = stored(self._surroundings(settled, 2, strings, "h long, g long, doc long, start int"), "strings")
        first = rows.groupBy("h", "g").agg(F.min(F.struct("doc", "start")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
        again = rows.join(first, ["h", "g"]).where("struct(doc, start) != first")
        return again.select("doc", "start", (F.col("start") + least).alias("stop"))

    def groups(self) -> DataFrame:
        """(length, occurrences): the maximal repeats among the gathered surroundings of anchors, the earliest place first.

        A partial view, which no query uses: of equal surroundings only the earliest is gathered, so a repeat longer than
        them appears as its ends only, with the places that differ there, and hot anchors are absent. ``covered`` has all.
        """

        def rows(found) -> pd.DataFrame:
            out = [(int(n), [{"doc": int(d), "start": int(s)} for d, s in zip(docs, starts, strict=True)]) for n, docs, starts in found]
            return pd.DataFrame(out, columns=["length", "occurrences"])

        return self._scan(self._settled(), rows, "length int, occurrences array<struct<doc:long,start:int>>")

    def covered(self) -> DataFrame:
        """(doc, starts, stops): the maximal runs of bytes of each document that lie in a string that starts earlier, too."""
        settled = self._settled()
        buckets = self.buckets

        def cover(found) -> pd.DataFrame:
            parts = [np.empty(0, _SPAN)]
            for size, docs, starts in found:
                spans = np.empty(len(docs) - 1, _SPAN)
                spans["doc"], spans["start"], spans["stop"] = docs[1:], starts[1:], starts[1:] + size
                parts.append(spans)
                if len(parts) > 1000:
                    parts = [_merged(np.concatenate(parts))]
            batch = _blobs(x := _merged(np.concatenate(parts)), _bucket_of(x["doc"], buckets))
            return batch.to_pandas()

        gathered = self._scan(settled, cover, "bucket long, records binary")
        hot = []
        if not settled.where("kind = 2").isEmpty():
            spans = self._hot_spans(settled)

            def packed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for part in parts:
                    x = np.empty(len(part), _SPAN)
                    for name in x.dtype.names:
                        x[name] = part[name]
                    yield _blobs(x := _merged(x), _bucket_of(x["doc"], buckets)).to_pandas()

            hot.append(spans.mapInPandas(packed, "bucket long, records binary"))
        every = settled.where("kind = 0").select("bucket", "records").unionByName(gathered)
        for df in hot:
            every = every.unionByName(df)

        def join(rows: pd.DataFrame) -> pd.DataFrame:
            spans = _merged(np.frombuffer(b"".join(rows["records"]), _SPAN))
            docs, runs = _runs(spans["doc"])
            pick = lambda name: [spans[name][a:b].copy() for a, b in runs]
            return pd.DataFrame({"doc": docs, "starts": pick("start"), "stops": pick("stop")})

        return stored(every.groupBy("bucket").applyInPandas(join, "doc long, starts array<int>, stops array<int>"), "covered")

    def cut(self, readable: bool = False) -> DataFrame:
        """(key, carried columns, kept, n_bytes, n_removed, n_spans): what remains of every text, as bytes.

        ``readable``: as text; bytes that are no character any more are left out.
        """
        covered = self.covered()
        size = covered.agg(F.count("*"), F.sum(F.size("starts"))).first()
        covered = small(covered, 1, (size[0] or 0) * 48 + (size[1] or 0) * 8)
        rows = self.docs.join(covered, "doc", "left")

        def keep(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in parts:
                for at in range(0, len(part), 512):
                    piece, out = part.slice(at, 512), [[], [], [], []]
                    data = piece.to_pydict()
                    for text, starts, stops in zip(data["text"], data["starts"], data["stops"], strict=True):
                        raw = text.encode("utf-8", "replace")
                        starts, stops = starts or [], stops or []
                        kept = b"".join([raw[a:b] for a, b in zip([0, *stops], [*starts, len(raw)], strict=True)])
                        shown = kept.decode("utf-8", "ignore") if readable else kept
                        for column, x in zip(out, (shown, len(raw), len(raw) - len(kept), len(starts)), strict=True):
                            column.append(x)
                    kinds = (pa.string() if readable else pa.binary(), pa.int64(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([piece.column(0), *[pa.array(x, t) for x, t in zip(out, kinds, strict=True)]], names)

        names = ["carry", "kept", "n_bytes", "n_removed", "n_spans"]
        out = rows.select("carry", "text", "starts", "stops")
        kind = out.schema["carry"].dataType.simpleString()
        return out.mapInArrow(keep, f"carry {kind}, kept {'string' if readable else 'binary'}, n_bytes long, n_removed long, n_spans long").select("carry.*", *names[1:])


def _merged(spans: np.ndarray) -> np.ndarray:
    """Spans joined where they overlap or touch."""
    if not len(spans):
        return spans
    spans = spans[np.lexsort((spans["start"], spans["doc"]))]
    # Shift documents apart, so that one running maximum of the ends serves all.
    doc = np.unique(spans["doc"], return_inverse=True)[1].astype("i8") << 32
    start, stop = doc + spans["start"], np.maximum.accumulate(doc + spans["stop"])
    first = np.append(True, start[1:] > stop[:-1])
    last = np.append(first[1:], True)
    out = spans[first].copy()
    out["stop"] = stop[last] - doc[last]
    return out
