"""Entries of large JSON objects, read in splits.

A JSON object is one value, but not one task's work: Spark's text reader cuts the file at commas, in
splits of any size, and a split can be understood without its predecessors in two passes.

1. Every split is summed up by what it does to a reader that enters it outside a string and to one that enters
   inside: whether quotes flip the state, and how far brackets change the depth.  The sums of a file's
   splits compose to the state at the start of each (a table with a row per split).
2. With that state every split cuts its text into entries.  What an entry has in several splits are fragments,
   at most two per split, which are joined in order.

A backslash never precedes a comma in JSON, so no escape crosses a cut.  The separator is put back behind every piece;
the one that this adds to the end of the file is outside the object.  Text that is no object is an error
(unbalanced brackets and quotes, text around the object, empty entries; the entries' own text is
parsed strictly by the callers).  A file without a character has no entries.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from stairwell.session import materialise

_ESCAPE = re.compile(r"\\.", re.DOTALL)
_TOKEN = re.compile(r'"(?:[^"\\]++|\\.)*+"?|[\[\]{},]', re.DOTALL)
_REST_OF_STRING = re.compile(r'(?:[^"\\]++|\\.)*+"?', re.DOTALL)
_MEMBER = re.compile(r'"((?:[^"\\]++|\\.)*+)"\s*:\s*$', re.DOTALL)
ENTRY = "file string, split long, local long, member string, starts boolean, ends boolean, opened boolean, closed boolean, text string"


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    meta = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split")]
    return spark.read.option("lineSep", ",").text(path).select("value", *meta)


def _per_split(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, str]]:
    """((file, split, ...), text) for every stretch of a batch that belongs to one split, separators put back."""
    for part in parts:
        keys = list(zip(*[c.to_pylist() for c in part.columns[1:]], strict=True))
        values, begin = part.column(0).to_pylist(), 0
        for end in range(1, len(keys) + 1):
            if end == len(keys) or keys[end] != keys[begin]:
                yield keys[begin], ",".join(values[begin:end]) + ","
                begin = end


def _effect(text: str) -> tuple[int, int, int]:
    """(whether the quotes flip the state, change of depth if entered outside a string, the same if inside)."""
    stretches = _ESCAPE.sub("", text).split('"')
    depth = [sum(s.count("{") + s.count("[") - s.count("}") - s.count("]") for s in stretches[k::2]) for k in (0, 1)]
    return (len(stretches) - 1) % 2, *depth


def _summaries(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[tuple, tuple[int, int, int]] = {}
    for key, text in _per_split(parts):
        flip, outside, inside = sums.get(key, (0, 0, 0))
        more_flip, *more = _effect(text)
        sums[key] = (flip ^ more_flip, outside + more[flip], inside + more[1 - flip])
    rows = [(*key, *value) for key, value in sums.items()]
    columns = zip(*rows, strict=True) if rows else [[]] * 5
    types = [pa.string(), *[pa.int64()] * 4]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["file", "split", "flip", "outside", "inside"])


def _states(pieces: DataFrame) -> DataFrame:
    """(file, split, quoted, depth) at the start of every split."""
    sums = materialise(pieces.mapInArrow(_summaries, "file string, split long, flip long, outside long, inside long"))
    # one row per split of a file
    file = Window.partitionBy("file")
    before = file.orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    known = sums.withColumn("quoted", F.coalesce(F.sum("flip").over(before), F.lit(0)) % 2)
    known = known.withColumn("change", F.when(F.col("quoted") == 1, F.col("inside")).otherwise(F.col("outside")))
    depth = F.coalesce(F.sum("change").over(before), F.lit(0))
    whole = (F.sum("change").over(file) == 0) & (F.sum("flip").over(file) % 2 == 0)
    bad = F.raise_error(F.concat(F.lit("malformed JSON object, brackets or quotes stay open: "), F.col("file"))).cast("long")
    return materialise(known.select("file", "split", "quoted", F.when(whole, depth).otherwise(bad).alias("depth")))


class _Cutter:
    """Walks the text of one split and collects entries and fragments of entries."""

    def __init__(self, key: tuple, level: int) -> None:
        self.file, self.split, quoted, self.depth = key
        self.quoted, self.level = bool(quoted), level
        self.rows: list[tuple] = []
        self.text: list[str] = []
        self.member: str | None = None
        self.head = ""  # text of the object before an array opens
        self.count = 0
        self.inside = self.depth >= level
        self.starts, self.opened, self.local = False, False, -1

    def _end(self, ends: bool, closed: bool) -> None:
        self.rows.append((self.file, self.split, self.local, self.member, self.starts, ends, self.opened, closed, "".join(self.text)))
        self.text = []

    def _begin(self, opened: bool) -> None:
        self.inside, self.starts, self.opened, self.local = True, True, opened, self.count
        self.count += 1

    def _bad(self, what: str) -> ValueError:
        return ValueError(f"malformed JSON object, {what}: {self.file}")

    def _keep(self, text: str) -> None:
        if self.inside:
            self.text.append(text)
        elif self.depth == 0 and text.strip():
            raise self._bad("text around it")
        elif self.level == 2 and self.depth == 1:
            self.head += text

    def take(self, text: str) -> None:
        at = 0
        if self.quoted:
            at = _REST_OF_STRING.match(text).end()
            self.quoted = text[at - 1] != '"'  # what stays open runs to the separator at the end
            self._keep(text[:at])
        for token in _TOKEN.finditer(text, at):
            self._keep(text[at : token.start()])
            at, symbol = token.end(), token.group()
            if symbol[0] == '"':
                self.quoted = symbol[-1] != '"'
                self._keep(symbol)
            elif symbol in "{[":
                self._open(symbol)
            elif symbol in "}]":
                self._close(symbol)
            elif self.depth == self.level and self.inside:
                self._end(True, False)
                self._begin(False)
            elif self.inside:
                self._keep(symbol)
            else:
                self.head = ""
        self._keep(text[at:])

    def _open(self, symbol: str) -> None:
        if self.depth == 0 and symbol != "{":
            raise self._bad("it is none")
        self.depth += 1
        if self.depth == self.level:
            if self.level == 2:
                name = _MEMBER.search(self.head)
                self.member = name.group(1) if name and symbol == "[" else ""
                self.head = ""
            self._begin(True)
        else:
            self._keep(symbol)

    def _close(self, symbol: str) -> None:
        if self.depth == self.level and self.inside:
            # an array's name is known where it opens; what opened in an earlier split may be an object
            if symbol != "}" if self.level == 1 else self.member and symbol != "]":
                raise self._bad("brackets do not match")
            self._end(True, True)
            self.inside = False
            self.depth -= 1
        else:
            self.depth -= 1
            self._keep(symbol if self.depth else "")
        if self.depth < 0:
            raise self._bad("brackets do not match")

    def finish(self) -> list[tuple]:
        if self.inside:
            self._end(False, False)
        rows, self.rows = self.rows, []
        return rows


def _entries_of(level: int):
    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), *[pa.bool_()] * 4, pa.string()]
    names = [c.split()[0] for c in ENTRY.split(", ")]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, cutter = None, None
        for key, text in _per_split(parts):
            if key != last:
                if cutter:
                    yield batch(cutter.finish())
                last, cutter = key, _Cutter(key, level)
            cutter.take(text)
            rows, cutter.rows = cutter.rows, []
            yield batch(rows)
        if cutter:
            yield batch(cutter.finish())

    return cut


def read_entries(spark: SparkSession, path: str, member: str | None = None) -> DataFrame:
    """(file, pos, text): entries of each file's object in order, as ``"key": value``.

    With ``member``: the elements of the array that the object holds under that name.
    """
    pieces = _pieces(spark, path)
    # A row per split, some hundred bytes for each split's many megabytes. The join must keep the rows in read order.
    placed = pieces.join(F.broadcast(_states(pieces)), ["file", "split"]).select("value", "file", "split", "quoted", "depth")
    cut = materialise(placed.mapInArrow(_entries_of(2 if member else 1), ENTRY))
    if member:
        cut = _with_member(cut).filter(F.col("member") == member)
    whole = cut.filter("starts and ends").select("file", "split", "local", "opened", "closed", "text")
    parts = cut.filter("not (starts and ends)")
    # at most two narrow rows per split
    begun = F.sum(F.col("starts").cast("long")).over(Window.partitionBy("file").orderBy("split", "local"))
    order = parts.select("file", "split", "local", begun.alias("entry"))
    grouped = parts.join(order, ["file", "split", "local"]).groupBy("file", "entry").agg(F.sort_array(F.collect_list(F.struct("split", "local", "opened", "closed", "text"))).alias("f"))
    joined = grouped.select(
        "file",
        F.get("f", F.lit(0))["split"].alias("split"),
        F.get("f", F.lit(0))["local"].alias("local"),
        F.get("f", F.lit(0))["opened"].alias("opened"),
        F.element_at("f", -1)["closed"].alias("closed"),
        F.array_join(F.transform("f", lambda s: s["text"]), "").alias("text"),
    )
    entries = whole.unionByName(joined)
    blank = F.trim(F.translate("text", "\t\r\n", "   ")) == ""
    bad = F.raise_error(F.concat(F.lit("malformed JSON object, an entry is empty: "), F.col("file")))
    entries = entries.filter(~(blank & F.col("opened") & F.col("closed"))).withColumn("text", F.when(blank, bad).otherwise(F.col("text")))
    splits = entries.groupBy("file", "split").agg(F.count("*").alias("n"), F.min("local").alias("least"), F.max("local").alias("most"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    twice = F.raise_error(F.concat(F.lit("malformed JSON object, a member comes twice: "), F.col("file"))).cast("long")
    shift = F.when(F.col("most") - F.col("least") + 1 == F.col("n"), F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("least")).otherwise(twice)
    shifts = materialise(splits.select("file", "split", shift.alias("shift")))
    return entries.join(F.broadcast(shifts), ["file", "split"]).select("file", (F.col("local") + F.col("shift")).alias("pos"), "text")


def _with_member(cut: DataFrame) -> DataFrame:
    """Entries with the name of their array, also where it opened in an earlier split."""
    named = cut.groupBy("file", "split").agg(F.max_by("member", F.when(F.col("member").isNotNull(), F.col("local"))).alias("last"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    named = materialise(named.select("file", "split", F.last("last", ignorenulls=True).over(before).alias("from_before")))
    filled = cut.join(F.broadcast(named), ["file", "split"])
    return filled.withColumn("member", F.coalesce("member", "from_before")).drop("from_before")
