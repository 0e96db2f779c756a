"""License scan by patience alignment.

Words that occur once in the text and once in the template are anchors; the longest sequence of anchors that
increases in both is kept, and the gaps between them are aligned in the same way, where more words are unique. Beside
an anchor, and at the ends of a gap, equal words are taken as they come. Coverage is the share of the template's words
that are aligned. A longer text than SPREAD templates is aligned region by region, and the best region counts, so words scattered over
a long text are no match. A copy that lacks at most m words of a template holds one of any m + 1 different words of it, so the places of the m + 1
rarest words in the text lead to every copy: each is tried with the words near it, and with just as many as the
template has around that word.

Only texts that hold enough of a template's words are aligned; this bound never excludes a sufficient coverage. Templates are a
table of names and texts (``read_templates`` reads one); TEMPLATES are those at hand.

Defined results: null or empty text, and an empty template, match nothing; equal coverage goes to the earliest region; repeated rows
are scanned each; other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stairwell.llm.license_texts import TEMPLATES  # noqa: F401  the default list

SPREAD = 4  # times its length over which a copy of a template may be spread by words between its own
_WORD = re.compile(r"[^\W_]+")

def words_at(text: str) -> list[tuple[str, int, int]]:
    """Lower-case words and their places."""
    return [(m.group().lower(), m.start(), m.end()) for m in _WORD.finditer(text)]


def longest_increasing(values: list[int]) -> list[int]:
    """Positions of a longest strictly increasing subsequence, by piles of cards."""
    tops, piles, before = [], [], [-1] * len(values)
    for k, x in enumerate(values):
        at = bisect_left(tops, x)
        before[k] = piles[at - 1] if at else -1
        if at == len(tops):
            tops.append(x)
            piles.append(k)
        else:
            tops[at], piles[at] = x, k
    out, k = [], piles[-1] if piles else -1
    while k >= 0:
        out.append(k)
        k = before[k]
    return out[::-1]


def align(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """Pairs of places (text, template) that are aligned, increasing in both."""
    found, gaps = [], [(0, len(text), 0, len(template))]
    while gaps:
        a, b, c, d = gaps.pop()
        while a < b and c < d and text[a] == template[c]:
            found.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            found.append((b, d))
        if a == b or c == d:
            continue
        once = {w for w, n in Counter(template[c:d]).items() if n == 1}
        counts = Counter(w for w in text[a:b] if w in once)
        place = {w: k for k, w in enumerate(template[c:d], c) if counts.get(w) == 1}
        anchors = [(k, place[w]) for k, w in enumerate(text[a:b], a) if w in place]
        kept = [anchors[k] for k in longest_increasing([j for _, j in anchors])]
        if kept:
            found += kept
            edges = [(a - 1, c - 1), *kept, (b, d)]
            gaps += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:], strict=False)]
    return sorted(found)


def _regions(words: list[str], template: list[str], present: Counter, least: float) -> Iterator[tuple[int, int]]:
    """Stretches of the text that hold every copy of a sufficient coverage: around the places of the template's rarest words."""
    n = len(template)
    lacking = n - math.ceil(least * n - 1e-9)
    first: dict[str, int] = {}
    for j, w in enumerate(template):
        first.setdefault(w, j)
    rare = set(sorted((w for w in first), key=lambda w: (present[w], w))[: lacking + 1])
    if sum(present[w] for w in rare) <= 1 and len(words) <= SPREAD * n:
        return  # the whole text is the one region
    slack, last = max(2, n // 4), {}
    for k, w in enumerate(words):
        if w in rare:
            if k - last.get("wide", -n) > slack:
                last["wide"] = k
                yield max(0, k - SPREAD // 2 * n), k + SPREAD // 2 * n
            begin = k - first[w]
            if begin != last.get("close"):
                last["close"] = begin
                yield max(0, begin - slack), max(0, begin) + n + slack


def read_templates(spark: SparkSession, path: str) -> dict[str, str]:
    """Templates from a folder of text files, by file name; the list is small and known to its owner."""
    rows = spark.read.text(path, wholetext=True).select("value", "_metadata.file_name").collect()
    return {r.file_name.rsplit(".", 1)[0]: r.value for r in rows}


def scan_text(text: str | None, templates: dict[str, list[str]], least: float) -> list[dict]:
    """Matches of the templates (as word lists): name, coverage, begin and end in the text, words aligned."""
    found = words_at(text or "")
    words = [w for w, _, _ in found]
    present, out = Counter(words), []
    for name, template in templates.items():
        if not template or sum(w in present for w in template) < least * len(template):
            continue
        best = align(words, template) if len(words) <= SPREAD * len(template) else []
        for low, high in _regions(words, template, present, least) if len(best) < len(template) else ():
            pairs = [(i + low, j) for i, j in align(words[low:high], template)]
            if len(pairs) > len(best) or (len(pairs) == len(best) and pairs and pairs[0][0] < best[0][0]):
                best = pairs
            if len(best) == len(template):
                break
        if len(best) >= least * len(template):
            out.append({"template": name, "coverage": len(best) / len(template), "begin": found[best[0][0]][1], "end": found[best[-1][0]][2], "n_aligned": len(best)})
    return out


def scan(docs: DataFrame, templates: dict[str, str], least: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, template, coverage, begin, end, n_aligned): every template that is covered at least to ``least``."""
    if not 0 < least <= 1:
        raise ValueError("coverage lies above 0 and is 1 at most")
    lists = {name: [w for w, _, _ in words_at(x)] for name, x in templates.items()}

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            hits = [(k, m) for k, x in enumerate(part.column(1)) for m in scan_text(x.as_py(), lists, least)]
            columns = [part.column(0).take(pa.array([k for k, _ in hits], pa.int64()))]
            columns += [pa.array([m[n] for _, m in hits], t) for n, t in kinds.items()]
            yield pa.RecordBatch.from_arrays(columns, [key, *kinds])

    kinds = {"template": pa.string(), "coverage": pa.float64(), "begin": pa.int64(), "end": pa.int64(), "n_aligned": pa.int64()}
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, template string, coverage double, begin long, end long, n_aligned long"
    return docs.select(F.col(key).alias(key), F.col(text)).mapInArrow(rows, schema)
