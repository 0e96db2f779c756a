"""Packing of token pieces into sequences by the sum-of-squares rule.

Documents become token ids plus an end id; only a document longer than a sequence is cut. A piece that fills a
sequence is one. The others are dealt by a hash into groups of about GROUP pieces, longest first, and
each goes where the squared counts of open sequences per remaining gap become smallest: into an open
sequence of some gap, or into a new one. A group's state is bounded by its size, and all groups run beside each other.

Defined results: null or empty text is the end id alone; repeated rows are packed each; among equal sums the tightest gap
wins and a new sequence comes last; equal lengths are taken in the order of key and piece; no rows give no rows; columns
beside key and text are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stairwell.llm.common import stored

CAPACITY = 2048
GROUP = 20_000  # pieces packed together
CACHE_WORDS = 500_000  # words whose ids a worker remembers


class _WordIds(dict):
    """Ids of words between ASCII white space, as little-endian 32-bit bytes.

    For a tokenizer that drops white space, a text's ids are its words' ids one after the other. The library
    is slow with lone words, so runs of plain Latin letters are merged, once per distinct word, by the rank encoder,
    in an alphabet in which a word's last byte has a letter of its own; all other words, and files of
    another make, go to the library.
    """

    def __init__(self, tokenizer: str) -> None:
        import regex
        from tokenizers import Tokenizer

        super().__init__()
        self.model = Tokenizer.from_str(tokenizer)
        spec = json.loads(tokenizer)
        steps = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])] + [x["type"] for x in (spec["pre_tokenizer"] or {}).get("pretokenizers", [])]
        self.plain = steps == ["NFC", "Replace", "Lowercase", "Split", "ByteLevel"] and spec["model"]["end_of_word_suffix"] == "</w>"
        if self.plain:
            self.split = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
            self.special = [x["content"] for x in spec["added_tokens"]]
            self.known: dict[str, bytes] = {}
            self.merge = self._ranks(spec["model"]["vocab"])

    @staticmethod
    def _last(raw: bytes) -> bytes:
        """The last byte, a small letter or a continuation byte, as a letter of its own: a capital or a control."""
        return raw[:-1] + bytes([raw[-1] - (32 if raw[-1] < 128 else 128)])

    def _ranks(self, vocabulary: dict[str, int]):
        """An encoder with the vocabulary's letter tokens; ids grow in the order of the merges."""
        import tiktoken

        # In the file, bytes that do not print stand as characters from 256 on, in their order.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
        ranks = {}
        for token, rank in vocabulary.items():
            body = token.removesuffix("</w>")
            raw = bytes(byte[c] for c in body) if all(c in byte for c in body) else b""
            if raw and all(97 <= b <= 122 or b >= 128 for b in raw) and (body == token or raw[-1] < 192):
                ranks[raw if body == token else self._last(raw)] = rank
        free = max(vocabulary.values()) + 1
        ranks |= {bytes([b]): free + b for b in range(256) if bytes([b]) not in ranks}
        return tiktoken.Encoding("letters", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._encode_single_piece

    def _piece(self, piece: str) -> bytes:
        if len(self.known) >= CACHE_WORDS:
            self.known.clear()
        ids = self.merge(self._last(piece.encode())) if piece.isalpha() else self.model.encode(piece, add_special_tokens=False).ids
        out = self.known[piece] = np.array(ids, "<u4").tobytes()
        return out

    def _word(self, raw: bytes) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        word = raw.decode()
        simple = self.plain and len(word) < 64 and word.isprintable() and max(word) < "\u0250" and "\u0130" not in word
        if simple and not any(x in word for x in self.special):
            word = word.lower()
            pieces = [word] if word.isalpha() else [word[:-1], word[-1]] if word[:-1].isalpha() and word[-1] in ",." else self.split.findall(word)
            known, piece = self.known.get, self._piece
            ids = b"".join([known(p) or piece(p) for p in pieces])
        else:
            ids = np.array(self.model.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        self[raw] = ids
        return ids

    def text(self, text: str | None) -> bytes:
        words = (text or "").encode().split()
        ids = list(map(self.get, words))
        if None in ids:
            word = self._word
            ids = [word(w) if x is None else x for w, x in zip(words, ids, strict=True)]
        return b"".join(ids)


def token_pieces(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """(key, piece, start, length, ids_crc32[, ids]): the documents' ids and the end id, cut at multiples of the capacity.

    The tokenizer file must describe a model that drops white space; it is read once and broadcast.
    """
    with open(tokenizer_path, encoding="utf-8") as file:
        tokenizer = docs.sparkSession.sparkContext.broadcast(file.read())
    end = np.array([end_id], "<u4").tobytes()
    fields = "piece:int,start:long,length:long,ids_crc32:long" + ",ids:binary" * keep_ids

    @F.pandas_udf(f"array<struct<{fields}>>")
    def pieces(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words = _WordIds(tokenizer.value)
        for part in parts:
            rows = []
            for x in part:
                ids, row = words.text(x) + end, []
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    cut = ids[at : at + 4 * capacity]
                    row.append({"piece": k, "start": at // 4, "length": len(cut) // 4, "ids_crc32": crc32(cut)} | ({"ids": cut} if keep_ids else {}))
                rows.append(row)
            yield pd.Series(rows)

    return docs.select(F.col(key).alias(key), F.explode(pieces(F.col(text))).alias("p")).select(key, "p.*")


def sum_of_squares(lengths: list[int], capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each length, taken in the given order."""
    count = np.zeros(capacity + 1, "i8")  # open sequences per gap; a full one and a new one count for nothing
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    sequence, offset = np.empty(len(lengths), "i8"), np.empty(len(lengths), "i8")
    made = 0
    for k, size in enumerate(lengths):
        gaps = np.flatnonzero(count[size:capacity]) + size
        rest = gaps - size
        change = 2 * (count[rest] - count[gaps]) + 1 + (rest > 0)
        best = int(change.argmin()) if len(gaps) else -1
        fresh = 2 * count[capacity - size] + 1 if size < capacity else 0
        if best >= 0 and change[best] <= fresh:
            gap = int(gaps[best])
            place = open_at[gap].pop()
            count[gap] -= 1
        else:
            gap, place, made = capacity, made, made + 1
        sequence[k], offset[k] = place, capacity - gap
        if gap > size:
            open_at[gap - size].append(place)
            count[gap - size] += 1
    return sequence, offset


def pack(pieces: DataFrame, key: str = "doc_id", capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """``pieces`` (key, piece, length and what else they have) with sequence_id and offset.

    ``pieces`` must be a stored table: it is counted, and read once for each of full and partial pieces.
    """
    kept = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    pieces = pieces.select(*kept)
    part = pieces.where(F.col("length") < capacity)
    groups = max(1, -(-part.count() // group))
    part = part.withColumn("__group", F.pmod(F.xxhash64(key, "piece"), F.lit(groups)))
    schema = part.drop("__group").schema.add("sequence_id", "long").add("offset", "long")

    def packed(rows: pd.DataFrame) -> pd.DataFrame:
        number = int(rows["__group"].iloc[0])
        rows = rows.drop(columns="__group").sort_values(["length", key, "piece"], ascending=[False, True, True], kind="stable")
        sequence, offset = sum_of_squares(rows["length"].tolist(), capacity)
        return rows.assign(sequence_id=sequence + (number << 32), offset=offset)

    full = pieces.where(F.col("length") >= capacity)
    full = full.withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    return part.groupBy("__group").applyInPandas(packed, schema).unionByName(full)


def pack_documents(docs: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    """Pieces of all documents with their places."""
    return pack(stored(token_pieces(docs, tokenizer_path, **options), "pieces"), capacity=options.get("capacity", CAPACITY), key=options.get("key", "doc_id"))


def assemble(placed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the ids of packed pieces (with their ids) joined into sequences of bounded length."""

    @F.pandas_udf("binary")
    def join(parts: pd.Series) -> pd.Series:
        return parts.map(b"".join)

    rows = placed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("x"))
    return rows.select("sequence_id", join("x.ids").alias("ids"))
