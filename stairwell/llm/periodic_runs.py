"""Maximal periodic runs of the words of texts, found on a run-length grammar made by recompression.

A text is compressed bottom-up: block compression replaces every maximal block of one symbol, then pair compression replaces pairs
whose first symbol is of the left half of the alphabet and whose second is of the right, and so on until the text no longer shrinks. Equal
symbols stand for equal words, and a word sequence is parsed alike wherever it occurs, but for its ends. The longest common
extension of two places climbs the levels while their symbols begin together and are equal, jumps over equal symbols
and, at blocks, over as many of them as both sides have left, and descends where they differ.

Candidates lie on harmonic grids: a run of period q and at least four periods holds four neighbouring multiples of q
with the same word on them. For every such place and period the extensions to both sides, of a text and of its mirror image, give the
exact run. All grids together have n * (1 + 1/2 + ...) places. There are no suffix arrays and no limit on n or q.

A run is a stretch with smallest period q and a length of at least max(LEAST, 4 * q), which no neighbour extends. Every
text is worked out by itself, in memory proportional to its words; nothing is shuffled.

Defined results: a null or empty text has no words and no runs; of runs with the greatest length / period the one with the smallest
start, then the smallest period is named; repeated rows count each; other columns are kept, those of the results' names
are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField, StructType

LEAST = 6  # words of a run
TIMES = 4  # periods of a run
GRID = 4096  # words of a text up to which all places of all grids are listed once for all texts
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)
RESULTS = ["n_runs", "start", "length", "period", "exponent_milli", "runs", "collapsed"]


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII blanks."""
    return (text or "").encode().split()


def _blocks(symbols: np.ndarray) -> np.ndarray:
    """First index of every maximal block of one symbol."""
    return np.flatnonzero(np.append(True, symbols[1:] != symbols[:-1])[: len(symbols)])


def _left_half(symbols: np.ndarray) -> np.ndarray:
    """Whether each place's symbol belongs to the left half of the alphabet, of which many pairs go to the right half.

    The halves are given by a bit of the symbol times an odd number, or, if no pair goes from left to right, of the
    symbol itself: neighbours differ, so one bit tells some of them apart.
    """
    mixed = [(symbols.astype(np.uint64) * np.uint64(m)) >> np.uint64(63) for m in _ODD]
    plain = [(symbols >> k) & 1 for k in range(int(symbols.max()).bit_length())]
    for sides in (mixed, plain):
        sides = [x.astype(bool) for half in sides for x in (half, half == 0)]
        pairs = [np.count_nonzero(x[:-1] & ~x[1:]) for x in sides]
        if max(pairs):
            return sides[int(np.argmax(pairs))]
    raise AssertionError("neighbours are equal")


def _named(*parts: np.ndarray) -> np.ndarray:
    """Equal columns get equal numbers."""
    order = np.lexsort(parts)
    changed = np.zeros(len(order), bool)
    for p in parts:
        changed[1:] |= p[order[1:]] != p[order[:-1]]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(changed)
    return out


class Grammar:
    """Levels of a recompressed text: symbols, where each begins in the text, where its block ends, its place on the next level and on the one below."""

    def __init__(self, symbols: np.ndarray) -> None:
        self.n = len(symbols)
        self.levels: list[tuple[list, list, list, list, list]] = []
        symbols, starts = np.asarray(symbols, np.int64), np.arange(len(symbols) + 1)
        self._raw = [(symbols, starts)]
        while len(symbols) > 1:
            first = _blocks(symbols)
            if len(first) < len(symbols):
                symbols = _named(symbols[first], np.diff(np.append(first, len(symbols))))
                starts = np.append(starts[first], self.n)
                self._raw.append((symbols, starts))
            if len(symbols) > 1:
                left = _left_half(symbols)
                joined = left[:-1] & ~left[1:]
                first = np.flatnonzero(~np.concatenate([[False], joined]))
                second = np.where(np.append(joined, False)[first], symbols[np.minimum(first + 1, len(symbols) - 1)], -1)
                symbols = _named(symbols[first], second)
                starts = np.append(starts[first], self.n)
                self._raw.append((symbols, starts))
        self._link()

    def _link(self) -> None:
        for level, (symbols, starts) in enumerate(self._raw):
            bounds = np.append(_blocks(symbols), len(symbols))
            block_end = np.repeat(bounds[1:], np.diff(bounds))
            up = np.full(len(symbols), -1)
            if level + 1 < len(self._raw):
                above = self._raw[level + 1][1][:-1]
                up[np.searchsorted(starts[:-1], above)] = np.arange(len(above))
            down = np.searchsorted(self._raw[level - 1][1], starts[:-1]) if level else np.zeros(len(symbols), np.int64)
            self.levels.append((symbols.tolist(), starts.tolist(), block_end.tolist(), up.tolist(), down.tolist()))

    def mirror(self) -> Grammar:
        """The grammar of the text read backwards."""
        other = object.__new__(Grammar)
        other.n, other.levels = self.n, []
        other._raw = [(symbols[::-1], self.n - starts[::-1]) for symbols, starts in self._raw]
        other._link()
        return other

    def extension(self, i: int, j: int) -> int:
        """Length of the longest common prefix of what begins at i and at j, i < j."""
        if j >= self.n:
            return 0
        levels, level, a, b = self.levels, 0, i, j
        while True:
            symbols, starts, block_end, up, _ = levels[level]
            while symbols[a] == symbols[b] and up[a] >= 0 and up[b] >= 0 and levels[level + 1][0][up[a]] == levels[level + 1][0][up[b]]:
                a, b, level = up[a], up[b], level + 1
                symbols, starts, block_end, up, _ = levels[level]
            if symbols[a] == symbols[b]:
                step = min(block_end[a] - a, block_end[b] - b)
                a, b = a + step, b + step
                if b == len(symbols):
                    return self.n - j
            elif level == 0:
                return starts[a] - i
            else:
                down = levels[level][4]
                a, b, level = down[a], down[b], level - 1


def harmonic_grid(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(last word that matters, place, period) of all places on grids of texts of up to n words, by the first."""
    rows = [np.arange(0, n - (TIMES - 1) * q, q) for q in range(1, n // TIMES + 1)]
    periods = np.repeat(np.arange(1, len(rows) + 1), [len(r) for r in rows])
    places = np.concatenate(rows) if rows else periods
    last = places + (TIMES - 1) * periods
    order = np.argsort(last, kind="stable")
    return last[order], places[order], periods[order]


def _candidates(text: np.ndarray, grid: tuple[np.ndarray, np.ndarray, np.ndarray]) -> list[tuple[int, int]]:
    """(period, place) where TIMES neighbours on the period's grid are equal, in order."""
    n = len(text)
    if n <= GRID:
        size = np.searchsorted(grid[0], n)
        places, periods = grid[1][:size], grid[2][:size]
        for k in range(1, TIMES):
            same = text[places] == text[places + k * periods]
            places, periods = places[same], periods[same]
        return sorted(zip(periods.tolist(), places.tolist(), strict=True))
    found = []
    for q in range(1, n // TIMES + 1):
        points = text[::q]
        same = points[1:] == points[:-1]
        hits = np.flatnonzero(same[2:] & same[1:-1] & same[:-2])
        found += [(q, k * q) for k in hits.tolist()]
    return found


def find_runs(words: list, grid: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> list[tuple[int, int, int]]:
    """(start, period, length) of every run, ordered; ``grid`` is harmonic_grid(GRID) if it is at hand."""
    kinds: dict = {}
    text = np.array([kinds.setdefault(w, len(kinds)) for w in words], np.int64)
    n, found = len(words), {}
    if n < LEAST:
        return []
    candidates = _candidates(text, grid or harmonic_grid(min(n, GRID)))
    if not candidates:
        return []
    ahead = Grammar(text)
    back, done = ahead.mirror(), (0, 0)
    for q, i in candidates:
        if done[0] == q and i + q < done[1]:
            continue
        end = i + q + ahead.extension(i, i + q)
        start = i - back.extension(n - i - q, n - i)
        done = (q, end)
        if end - start >= max(LEAST, TIMES * q):
            found.setdefault((start, end), q)  # multiples of its period come later
    return sorted((start, q, end - start) for (start, end), q in found.items())


def summary(words: list[bytes], grid: tuple | None = None) -> tuple:
    """RESULTS of one text."""
    runs = find_runs(words, grid)
    lines = "".join(f"{start},{length},{q}\n" for start, q, length in runs)
    if not runs:
        return 0, None, None, None, None, lines, b" ".join(words).decode()
    start, q, length = max(runs, key=lambda r: (Fraction(r[2], r[1]), -r[0], -r[1]))
    gone = np.zeros(len(words), bool)
    for s, p, size in runs:
        gone[s + p : s + size] = True
    left = b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)
    return len(runs), start, length, q, 1000 * length // q, lines, left.decode()


def add_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with RESULTS instead of the text; ``runs`` lists ``start,length,period`` lines, ``collapsed`` the words that repeat nothing."""
    keep = [c for c in docs.columns if c not in (text, *RESULTS)]
    own = [StructField(c, LongType()) for c in RESULTS[:5]] + [StructField(c, StringType()) for c in RESULTS[5:]]
    schema = StructType([docs.schema[c] for c in keep] + own)
    types = [pa.int64()] * 5 + [pa.string()] * 2

    def results(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid = harmonic_grid(GRID)
        for part in parts:
            for at in range(0, part.num_rows, 256):
                some = part.slice(at, 256)
                rows = [summary(words_of(value.as_py()), grid) for value in some.column(len(keep))]
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([*some.columns[: len(keep)], *columns], [*keep, *RESULTS])

    return docs.select(*keep, text).mapInArrow(results, schema)
