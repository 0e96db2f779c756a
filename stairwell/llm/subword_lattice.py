"""Marginal probability of texts under a unigram model of subword pieces: all segmentations of every word count.

The pieces and their first scores come from an existing vocabulary file, which is not changed. A word, with the blank before
it, is a lattice: every piece that matches at a place is an edge. The forward recursion adds, in logarithms, the
probabilities of all paths, so no segmentation is preferred. The scores are fitted to the learning texts by expected
counts (forward-backward over the same lattices), with the file's scores as a prior of ``PRIOR`` pieces. Pieces and the end of
text are one distribution, so the probabilities of all texts sum to one; no piece spans two words, so a text is
the product of its words and the end, and every distinct word is worked out once.

The word counts, the base of everything here, are a table with a row per distinct word that grows with the corpus.
Words that make up more than 1/``HOT`` of all words are at most ``HOT`` many: they are broadcast, and texts count them
where they are read. All other words go to the table by a shuffle, in which no word has more than that share of the rows.

Defined results: a null text is empty; a text without words is its end; every byte is a piece, so no word is impossible;
without learning texts the file's scores stand and the word counts are 0; a row that comes several times (same id and text) is
counted each time and returned each time; null ids are learnt from; columns other than id and text are ignored. Sums are
decimals with 15 places, so they do not depend on their order.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stairwell.llm.common import stored

HOT = 300_000
PRIOR = 1_000.0
ROUNDS = 3
FLUSH = 200_000  # distinct words a task counts before it sends them on
PAIRS = 50_000  # pairs of text and word sent on at once, if not those of one text
CELLS = 400_000  # word places worked on at once
LONG = 400  # bytes from which a word is worked out alone
DECIMAL = "decimal(38,15)"
_BLANKS = bytes([32, *range(9, 14)])


def ranked(score: float) -> float:
    """Log weight of a piece whose score is minus its rank in a merge list: Zipf's law."""
    return -math.log(3.0 - score)


def load_pieces(path: str, weight: Callable[[float], float] = ranked) -> tuple[list[bytes], np.ndarray]:
    """Pieces that lower-cased words can hold, and their normalised log probabilities; the last one is the end of text.

    ``weight`` makes a log weight of a file's score: the identity for a file of log probabilities. Single bytes weigh as the
    last rank.
    """
    file = sentencepiece.SentencePieceProcessor(model_file=path)
    least = weight(-float(file.vocab_size()))
    found = {bytes([b]): least for b in range(256) if b == 32 or b not in _BLANKS and not 65 <= b <= 90}
    for i in range(file.vocab_size()):
        if file.is_unknown(i) or file.is_control(i) or file.is_byte(i):
            continue
        piece = file.id_to_piece(i).replace("▁", " ").encode()
        if piece and not any(b in _BLANKS for b in piece[1:]) and piece[0] not in _BLANKS[1:] and not any(65 <= b <= 90 for b in piece):
            found[piece] = max(found.get(piece, -math.inf), weight(file.get_score(i)))
    scores = np.array([*found.values(), weight(0.0)])
    return [*found, b""], scores - np.logaddexp.reduce(scores)


def build_trie(pieces: list[bytes]) -> dict[str, np.ndarray]:
    """The pieces' trie as plain arrays: an open-addressed table of (node, byte) and the piece that ends at each node."""
    edges: dict[int, int] = {}
    ends = [-1]
    for k, piece in enumerate(pieces):
        node = 0
        for b in piece:
            key = node * 256 + b
            if key not in edges:
                edges[key] = len(ends)
                ends.append(-1)
            node = edges[key]
        if piece:
            ends[node] = k
    bits = max(4, math.ceil(math.log2(4 * len(edges) + 1)))
    keys, values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
    for key, value in edges.items():
        slot = ((key * 0x9E3779B97F4A7C15) & (2**64 - 1)) >> (64 - bits)
        while keys[slot] >= 0:
            slot = (slot + 1) % (1 << bits)
        keys[slot], values[slot] = key, value
    return {"keys": keys, "values": values, "ends": np.array(ends, np.int32), "longest": np.array(max(map(len, pieces)))}


def _step(trie: dict[str, np.ndarray], nodes: np.ndarray, byte: np.ndarray) -> np.ndarray:
    """Node behind each (node, byte), -1 if there is none."""
    keys, size = trie["keys"], len(trie["keys"])
    want = nodes.astype(np.int64) * 256 + byte
    slot = ((want.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - size.bit_length() + 1)).astype(np.int64)
    out = np.full(len(want), -1, np.int64)
    rest = np.arange(len(want))
    while len(rest):
        seen = keys[slot[rest]]
        hit = seen == want[rest]
        out[rest[hit]] = trie["values"][slot[rest[hit]]]
        rest = rest[~hit & (seen >= 0)]
        slot[rest] = (slot[rest] + 1) % size
    return out


def _edges(trie: dict[str, np.ndarray], words: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(begin, end, rows, pieces) of all matches in the words, rows of bytes, ordered by begin."""
    for begin in range(int(lengths.max(initial=0))):
        rows = np.flatnonzero(lengths > begin)
        nodes = np.zeros(len(rows), np.int64)
        for end in range(begin + 1, begin + int(trie["longest"]) + 1):
            alive = lengths[rows] >= end
            rows, nodes = rows[alive], nodes[alive]
            if not len(rows):
                break
            nodes = _step(trie, nodes, words[rows, end - 1])
            rows, nodes = rows[nodes >= 0], nodes[nodes >= 0]
            pieces = trie["ends"][nodes]
            here = pieces >= 0
            if here.any():
                yield begin, end, rows[here], pieces[here]


def forward(trie: dict[str, np.ndarray], scores: np.ndarray, words: np.ndarray, lengths: np.ndarray, keep: list | None = None) -> np.ndarray:
    """alpha[row, place]: log probability of all segmentations up to the place; ``keep`` collects the edges."""
    alpha = np.full((len(words), words.shape[1] + 1), -np.inf)
    alpha[:, 0] = 0.0
    for edge in _edges(trie, words, lengths):
        begin, end, rows, pieces = edge
        alpha[rows, end] = np.logaddexp(alpha[rows, end], alpha[rows, begin] + scores[pieces])
        if keep is not None:
            keep.append(edge)
    return alpha


def expected(trie: dict[str, np.ndarray], scores: np.ndarray, words: np.ndarray, lengths: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Expected number of uses of each piece in the words, each as often as it counts."""
    edges: list = []
    alpha = forward(trie, scores, words, lengths, edges)
    every = np.arange(len(words))
    total = alpha[every, lengths]
    beta = np.full(alpha.shape, -np.inf)
    beta[every, lengths] = 0.0
    uses = np.zeros(len(scores))
    for begin, end, rows, pieces in reversed(edges):
        path = scores[pieces] + beta[rows, end]
        beta[rows, begin] = np.logaddexp(beta[rows, begin], path)
        uses += np.bincount(pieces, counts[rows] * np.exp(alpha[rows, begin] + path - total[rows]), len(scores))
    return uses


def _blocks(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(indices, matrix of bytes, lengths) of words of similar length, a blank before each; words without end are cut in no way."""
    sizes = np.array([len(w) for w in words], np.int64) + 1
    order, at = np.argsort(sizes, kind="stable"), 0
    while at < len(order):
        until = at + 1
        while until < len(order) and (until + 1 - at) * sizes[order[until]] <= CELLS and sizes[order[until]] <= max(LONG, sizes[order[at]]):
            until = min(len(order), until + max(1, (until - at) // 2))
        while until > at + 1 and (until - at) * sizes[order[until - 1]] > CELLS:
            until -= 1
        picked = order[at:until]
        width = int(sizes[picked[-1]])
        flat = b"".join((b" " + words[i]).ljust(width, b"\0") for i in picked)
        yield picked, np.frombuffer(flat, np.uint8).reshape(len(picked), width), sizes[picked]
        at = until


def _counted(parts: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """(word, learnt, other) counts of the texts of a task; ``learn`` says which count they go to."""
    bags: tuple[Counter, Counter] = (Counter(), Counter())

    def out():
        for k, bag in enumerate(bags):
            rows = iter(bag.items())
            while chunk := list(itertools.islice(rows, 20_000)):
                n, none = pa.array([c for _, c in chunk], pa.int64()), pa.array([0] * len(chunk), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in chunk], pa.binary()), n if k == 0 else none, none if k == 0 else n], names)
            bag.clear()

    for part in parts:
        for text, learn in zip(part.column(0), part.column(1).to_pylist(), strict=True):
            bags[0 if learn else 1].update((text.as_py() or "").encode().lower().split())
            if len(bags[0]) + len(bags[1]) > FLUSH:
                yield from out()
    yield from out()


class SubwordLattice:
    """The fitted model: the piece scores and the table of words.

    ``learn`` is a condition on ``docs``: the texts to learn from. Fitting runs at once and writes the word tables.
    """

    def __init__(self, docs: DataFrame, path: str, learn: Column, key: str = "doc_id", text: str = "text", rounds: int = ROUNDS) -> None:
        self.docs, self.key, self.text = docs, key, text
        learn = F.coalesce(learn, F.lit(False))
        pieces, self.scores = load_pieces(path)
        self.trie = docs.sparkSession.sparkContext.broadcast(build_trie(pieces))
        names = ["word", "learnt", "other"]
        counts = docs.select(F.col(text), learn.alias("learn")).mapInArrow(lambda parts: _counted(parts, names), "word binary, learnt long, other long")
        words = counts.groupBy("word").agg(F.sum("learnt").alias("learnt"), (F.sum("learnt") + F.sum("other")).alias("total"))
        words = stored(words, "words")
        found = words.agg(F.sum("learnt"), F.sum((F.col("learnt") > 0).cast("long")), F.sum("total")).first()
        texts = docs.where(learn).count()
        self.ends = texts
        self.tokens = (found[0] or 0) + texts  # N
        self.kinds = (found[1] or 0) + (texts > 0)  # V
        self.total = found[2] or 0
        prior = np.exp(self.scores)
        for _ in range(rounds if texts else 0):
            uses = self._expected(words)
            uses[-1] += texts
            fitted = uses + PRIOR * prior
            self.scores = np.log(fitted / fitted.sum())
        self.words = stored(self._with_score(words), "word-scores")

    def _base(self, count: Column) -> Column:
        """log10((c + 1) / (N + V + 1))."""
        return F.log10((count + 1) / F.lit(float(self.tokens + self.kinds + 1)))

    def _expected(self, words: DataFrame) -> np.ndarray:
        trie, scores = self.trie, self.scores

        def uses(parts):
            sums = np.zeros(len(scores))
            for part in parts:
                counts = part.column(1).to_numpy(zero_copy_only=False).astype(float)
                for picked, matrix, lengths in _blocks(part.column(0).to_pylist()):
                    sums += expected(trie.value, scores, matrix, lengths, counts[picked])
            used = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(sums[used], pa.float64())], ["piece", "uses"])

        rows = words.where("learnt > 0").select("word", "learnt").mapInArrow(uses, "piece long, uses double")
        sums = rows.groupBy("piece").agg(F.sum(F.col("uses").cast("decimal(38,9)")).cast("double").alias("uses")).collect()  # a row per piece at most
        out = np.zeros(len(scores))
        for r in sums:
            out[r.piece] = r.uses
        return out

    def _with_score(self, words: DataFrame) -> DataFrame:
        trie, scores = self.trie, self.scores

        def marginals(parts):
            for part in parts:
                out = np.zeros(part.num_rows)
                for picked, matrix, lengths in _blocks(part.column(0).to_pylist()):
                    out[picked] = forward(trie.value, scores, matrix, lengths)[np.arange(len(picked)), lengths] / math.log(10)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out)], [*part.schema.names, "score"])

        return words.select("word", "learnt", "total").mapInArrow(marginals, "word binary, learnt long, total long, score double")

    def score(self, docs: DataFrame | None = None) -> DataFrame:
        """(key, n_tokens, n_known, train_tokens, base_score, score) of every row; scores are log10 probabilities.

        ``docs`` are the rows that the model was made with, or some of them.
        """
        docs = (self.docs if docs is None else docs).select(F.col(self.key).alias("key"), F.coalesce(self.text, F.lit("")).alias("text"))
        least = max(1, math.ceil(self.total / HOT))
        words = self.words.withColumn("base", self._base(F.col("learnt")))
        rows = words.where(F.col("total") >= least).orderBy("word").collect()  # HOT rows at most
        hot = {
            "place": {bytes(r.word): k for k, r in enumerate(rows)},
            "known": np.array([r.learnt > 0 for r in rows], np.int64),
            "base": np.array([r.base for r in rows], float),
            "score": np.array([r.score for r in rows], float),
        }
        hot = docs.sparkSession.sparkContext.broadcast(hot)
        end_base = math.log10((self.ends + 1) / (self.tokens + self.kinds + 1))
        end = (int(self.ends > 0), end_base, float(self.scores[-1]) / math.log(10))
        kind = dict(docs.dtypes)["key"]

        def name(text: bytes) -> int:
            return int.from_bytes(blake2b(text, digest_size=8).digest(), "little", signed=True)

        def heads(parts):
            """Every text's number of words, and the sums over its end and its broadcast words."""
            place, known, base, score = (hot.value[c] for c in ("place", "known", "base", "score"))
            for part in parts:
                rows = []
                for text in part.column(1):
                    text = text.as_py().encode()
                    bag = Counter(text.lower().split())
                    n = np.fromiter(bag.values(), np.int64, len(bag))
                    at = np.fromiter((place.get(w, -1) for w in bag), np.int64, len(bag))
                    all_words, n, at = int(n.sum()), n[at >= 0], at[at >= 0]
                    rows.append((name(text), all_words + 1, int((n * known[at]).sum()) + end[0], float((n * base[at]).sum()) + end[1], float((n * score[at]).sum()) + end[2]))
                types = [pa.int64()] * 3 + [pa.float64()] * 2
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, types, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["key", "hash", "n_tokens", "known", "base", "score"])

        def others(parts):
            """(key, hash, word, n, first) of every text's other words; ``first`` marks one of them."""
            place = hot.value["place"]
            for part in parts:
                found, counts, sizes, names = [], [], [], []

                def out(until):
                    """Pairs of the texts before ``until`` that are not out yet."""
                    of = np.repeat(np.arange(until - len(sizes), until), sizes)
                    first = np.diff(of, prepend=-1) > 0
                    columns = [part.column(0).take(pa.array(of)), pa.array(np.repeat(np.array(names, np.int64), sizes)), pa.array(found, pa.binary()), pa.array(counts, pa.int64()), pa.array(first)]
                    for lists in (found, counts, sizes, names):
                        lists.clear()
                    return pa.RecordBatch.from_arrays(columns, ["key", "hash", "word", "n", "first"])

                for k, text in enumerate(part.column(1)):
                    text = text.as_py().encode()
                    before = len(found)
                    for w, n in Counter(text.lower().split()).items():
                        if w not in place:
                            found.append(w)
                            counts.append(n)
                    sizes.append(len(found) - before)
                    names.append(name(text))
                    if len(found) > PAIRS:
                        yield out(k + 1)
                yield out(part.num_rows)

        head = docs.mapInArrow(heads, f"key {kind}, hash long, n_tokens long, known long, base double, score double")
        rare = docs.mapInArrow(others, f"key {kind}, hash long, word binary, n long, first boolean")
        rare = rare.join(words.where(F.col("total") < least).select("word", "learnt", F.col("base"), "score"), "word")
        weighted = lambda c: F.sum((F.col("n") * F.col(c)).cast(DECIMAL))
        rare = rare.groupBy("key", "hash").agg(
            F.sum(F.col("first").cast("long")).alias("times"),
            F.sum(F.when(F.col("learnt") > 0, F.col("n")).otherwise(0)).alias("more_known"),
            weighted("base").alias("more_base"),
            weighted("score").alias("more_score"),
        )
        rare = rare.withColumnsRenamed({"key": "rare_key", "hash": "rare_hash"})
        out = head.join(rare, F.col("key").eqNullSafe(F.col("rare_key")) & (F.col("hash") == F.col("rare_hash")), "left")
        share = lambda c: F.coalesce(F.col(c) / F.col("times"), F.lit(0).cast(DECIMAL)).cast(DECIMAL)
        return out.select(
            F.col("key").alias(self.key),
            "n_tokens",
            (F.col("known") + F.coalesce((F.col("more_known") / F.col("times")).cast("long"), F.lit(0))).alias("n_known"),
            F.lit(int(self.tokens)).cast("long").alias("train_tokens"),
            (F.col("base").cast(DECIMAL) + share("more_base")).cast("double").alias("base_score"),
            (F.col("score").cast(DECIMAL) + share("more_score")).cast("double").alias("score"),
        )
