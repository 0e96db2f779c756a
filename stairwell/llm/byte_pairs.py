"""Byte-level BPE over overlapping chunks: encode texts to ids, decode ids to bytes.

A long text is cut into chunks that overlap. Every chunk is split into pre-tokens on its own, from an
arbitrary place, and its pre-token starts settle into the true ones after a few characters. Two
neighbouring chunks are stitched at the first start that both find in their overlap; from there to the
next stitch, the pre-tokens are encoded. A text whose chunks never agree is split as a whole.

Defined results: null text counts as empty, an empty text has no ids, repeated rows are encoded each,
other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stairwell.llm.common import small, stored

# Words and pre-tokens that a worker remembers before it starts over.
CACHE_WORDS, CACHE_PIECES = 300_000, 100_000
SLICE = 1 << 23  # bytes of results sent back at once


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a rank file (one base64 token and its id per line)."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


class _Encoder:
    """Ids of pre-tokens as little-endian 32-bit bytes, remembered per distinct pre-token or word.

    A single space between two characters that are no white space always starts a pre-token, and nothing
    before it changes what follows. So a word with its space is split and encoded once for all its places.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import regex
        import tiktoken

        self.split = regex.compile(pattern)
        self.model = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _learn(self, piece: str) -> bytes:
        if len(self.known) >= CACHE_PIECES:
            self.known.clear()
        ids = self.known[piece] = np.array(self.model.encode_ordinary(piece), "<u4").tobytes()
        return ids

    def _learn_word(self, word: str) -> bytes:
        if len(self.words) >= CACHE_WORDS:
            self.words.clear()
        if not word or word[-1].isspace():
            raise ValueError("white space beside the space")
        ids = self.words[word] = np.array(self.model.encode_ordinary(" " + word), "<u4").tobytes()
        return ids

    def ids(self, pieces: list[str]) -> bytes:
        known, learn = self.known.get, self._learn
        return b"".join([known(p) or learn(p) for p in pieces])

    def text(self, text: str) -> bytes:
        first, *words = text.split(" ")
        if first and words and not first[-1].isspace():
            ids = list(map(self.words.get, words))
            try:
                if None in ids:
                    learn = self._learn_word
                    ids = [learn(w) if x is None else x for w, x in zip(words, ids, strict=True)]
                return self.ids(self.split.findall(first)) + b"".join(ids)
            except ValueError:
                pass
        return self.ids(self.split.findall(text))


class _Decoder:
    """Bytes of ids, by lookup in the joined tokens."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        table = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            table[rank] = token
        self.sizes = np.array([len(t) for t in table], "i8")
        self.places = np.cumsum(self.sizes) - self.sizes
        self.letters = np.frombuffer(b"".join(table), "u1")

    def bytes(self, ids: bytes) -> bytes:
        ids = np.frombuffer(ids, "<u4")
        size = self.sizes[ids]
        shift = self.places[ids] - (np.cumsum(size) - size)
        return self.letters[np.repeat(shift, size) + np.arange(size.sum())].tobytes()


class ByteBpe:
    """Encoder and decoder of one rank file. The ranks (bounded by the vocabulary) are broadcast once."""

    def __init__(self, spark: SparkSession, path: str, pattern: str, chunk: int = 1 << 16, overlap: int = 256) -> None:
        if not 0 < 2 * overlap <= chunk:
            raise ValueError("a chunk must be at least twice as long as its overlap")
        self.ranks = spark.sparkContext.broadcast(read_ranks(path))
        self.pattern, self.chunk, self.overlap = pattern, chunk, overlap

    def encode(self, docs: DataFrame, key: str = "doc_id", text: str = "text", decoded: bool = False) -> DataFrame:
        """(key, ids[, bytes]): ids as little-endian unsigned 32-bit integers in one binary value, and what they decode to."""
        docs = docs.select(F.col(key).alias(key), F.coalesce(F.col(text), F.lit("")).alias("text"))
        short = self._whole(docs.where(F.length("text") <= self.chunk), key, decoded)
        long = self._long(docs, key)
        return short.unionByName(long.withColumn("bytes", self.decode(F.col("ids"))) if decoded else long)

    def decode(self, ids: Column) -> Column:
        """The tokens' bytes, one after the other."""
        ranks = self.ranks

        @F.pandas_udf("binary")
        def decoded(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            decoder = _Decoder(ranks.value)
            for part in parts:
                yield part.map(decoder.bytes)

        return decoded(ids)

    def _whole(self, docs: DataFrame, key: str, decoded: bool = False) -> DataFrame:
        """Texts encoded each at once, in one pass through Python."""
        ranks, pattern = self.ranks, self.pattern

        def encoded(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            encoder, decoder = _Encoder(ranks.value, pattern), _Decoder(ranks.value)
            for part in parts:
                begin, size, ids = 0, 0, []
                for k, text in enumerate(part.column(1)):
                    ids.append(encoder.text(text.as_py()))
                    size += len(ids[-1])
                    if size >= SLICE or k == len(part) - 1:
                        columns = [part.column(0).slice(begin, len(ids)), pa.array(ids, pa.binary())]
                        if decoded:
                            columns.append(pa.array([decoder.bytes(x) for x in ids], pa.binary()))
                        yield pa.RecordBatch.from_arrays(columns, [key, "ids", "bytes"][: len(columns)])
                        begin, size, ids = k + 1, 0, []

        kind = docs.schema[key].dataType.simpleString()
        return docs.select(key, "text").mapInArrow(encoded, f"`{key}` {kind}, ids binary" + ", bytes binary" * decoded)

    def _long(self, docs: DataFrame, key: str) -> DataFrame:
        chunk, overlap, ranks, pattern = self.chunk, self.overlap, self.ranks, self.pattern

        def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in parts:
                for i, x in enumerate(part.column(1)):
                    x, doc = x.as_py(), part.column(2)[i].as_py()
                    for k, at in enumerate(range(0, len(x), chunk)):
                        start = max(0, at - overlap)
                        piece = pa.array([x[start : at + chunk + overlap]])
                        row = [part.column(0).slice(i, 1), pa.array([doc]), pa.array([k]), pa.array([start]), pa.array([at]), pa.array([len(x)]), piece]
                        yield pa.RecordBatch.from_arrays(row, names)

        names = [key, "doc", "k", "start", "at", "size", "piece"]
        kind = docs.schema[key].dataType.simpleString()
        schema = f"`{key}` {kind}, doc string, k long, start long, at long, size long, piece string"
        # A long row's name follows from its key and text, so a task that is run again cuts the same chunks; equal rows share one.
        long = docs.where(F.length("text") > chunk)
        long = long.select(key, "text", F.sha2(F.concat(F.to_json(F.struct(key)), F.lit("\0"), "text"), 256).alias("doc"))
        counts = long.groupBy("doc").agg(F.count("*").alias("n"))
        counts = stored(counts.where("n > 1"), "counts")
        table = stored(long.mapInArrow(cut, schema).dropDuplicates(["doc", "k"]), "chunks")

        @F.pandas_udf("struct<head:array<int>,tail:array<int>>")
        def starts(start: pd.Series, at: pd.Series, size: pd.Series, piece: pd.Series) -> pd.DataFrame:
            import regex

            rule, rows = regex.compile(pattern), []
            for s, a, n, x in zip(start, at, size, piece, strict=True):
                edge, last = a + chunk, s + len(x) == n
                spans = [(m.start() + s, m.end() + s) for m in rule.finditer(x)]
                # A match that touches the cut may go on behind it, and what follows is then unknown.
                sure = [b for b, e in spans if last or e < s + len(x)]
                rows.append((np.array([b for b in sure if a <= b < a + overlap], "i4"), np.array([b for b in sure if edge <= b < edge + overlap], "i4")))
            return pd.DataFrame(rows, columns=["head", "tail"])

        order = Window.partitionBy("doc").orderBy("k")
        zones = table.select("doc", "k", "size", starts("start", "at", "size", "piece").alias("z"))
        zones = zones.withColumn("stitch", F.array_min(F.array_intersect("z.head", F.lag("z.tail").over(order))))
        zones = zones.withColumn("stitch", F.when(F.col("k") == 0, F.lit(0)).otherwise(F.col("stitch").cast("long")))
        zones = zones.withColumn("until", F.coalesce(F.lead("stitch").over(order), F.when(F.lead("k").over(order).isNull(), F.col("size"))))
        whole = Window.partitionBy("doc")
        zones = zones.withColumn("sure", F.count("stitch").over(whole) == F.count("k").over(whole))
        zones = stored(zones.select("doc", "k", "stitch", "until", "sure"), "stitches")

        @F.pandas_udf("binary")
        def pieces(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            encoder = _Encoder(ranks.value, pattern)
            for start, piece, first, until in parts:
                out = []
                for s, x, a, b in zip(start, piece, first, until, strict=True):
                    spans = encoder.split.finditer(x, int(a - s))
                    out.append(encoder.ids([m.group() for m in spans if m.start() + s < b]))
                yield pd.Series(out)

        joined = table.join(zones, ["doc", "k"])
        done = joined.where("sure").withColumn("part", pieces("start", "piece", "stitch", "until"))
        # Chunks that never agree: their nominal pieces are put together again and split at once.
        nominal = F.col("piece").substr(F.col("at") - F.col("start") + 1, F.lit(chunk))
        again = joined.where("not sure").groupBy("doc").agg(F.first(key).alias(key), F.sort_array(F.collect_list(F.struct("k", nominal.alias("x")))).alias("xs"))
        again = again.join(small(counts, 80), "doc", "left")
        # Equal rows have equal ids: each is sent as often as it occurs.
        times = F.explode(F.array_repeat(F.lit(0), F.coalesce("n", F.lit(1)).cast("int")))
        again = self._whole(again.select(key, F.array_join("xs.x", "").alias("text"), times.alias("time")), key)

        @F.pandas_udf("binary")
        def together(parts: pd.Series) -> pd.Series:
            return parts.map(lambda x: b"".join(x))

        done = done.groupBy("doc").agg(F.first(key).alias(key), F.sort_array(F.collect_list(F.struct("k", "part"))).alias("xs"))
        done = done.join(small(counts, 80), "doc", "left").select(key, together(F.col("xs.part")).alias("ids"), "n")
        return done.select(key, "ids", times.alias("time")).drop("time").unionByName(again)
