"""Text expressions: answer normalisation, tokens with offsets, BLEU tokenisation."""

from __future__ import annotations

import string
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F

# The articles dropped by answer normalisation, and the code points
# that count as white space.
ARTICLES = ("a", "an", "the")
SPACE = (
    r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
SPACE_CHARS = "".join(
    chr(c)
    for c in [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
)
# Letters, numbers and the underscore make up words.
WORD = r"\p{L}\p{N}_"
SCAN_BYTES = 1 << 18  # bytes of texts scanned at once; the scan takes some 40 to 70 times as much
_TOKENS = pa.list_(pa.struct([("tok", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def normalize_answer(text: Column) -> Column:
    """Lower case, no ASCII punctuation, no whole-word articles, single spaces."""
    bare = F.translate(F.lower(text), string.punctuation, "")
    no_articles = F.regexp_replace(bare, rf"(?<![{WORD}])({'|'.join(ARTICLES)})(?![{WORD}])", " ")
    return F.trim(F.regexp_replace(no_articles, f"[{SPACE}]+", " "))


def strip(text: Column) -> Column:
    """Without white space at either end."""
    return F.btrim(text, F.lit(SPACE_CHARS))


def space_tokens(text: Column) -> Column:
    """Split on runs of white space; an empty text has no tokens."""
    return F.filter(F.split(text, f"[{SPACE}]+"), lambda t: t != "")


def _kind(c: str) -> int:
    """0 in a gap, 1 in a word, 2 for a symbol of its own."""
    return 0 if c in SPACE_CHARS else 1 if c == "_" or unicodedata.category(c)[0] in "LN" else 2


def _kinds(points: np.ndarray) -> np.ndarray:
    """The kind of every code point."""
    present = np.zeros(int(points.max(initial=0)) + 1, bool)
    present[points] = True
    kinds = np.zeros(len(present), np.uint8)
    for p in np.flatnonzero(present).tolist():
        kinds[p] = _kind(chr(p))
    return kinds[points]


def _located(texts: pa.Array) -> pa.Array:
    """Tokens of all texts at once, from the texts' bytes: no loop over texts or tokens."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
    begins = (data & 0xC0) != 0x80  # bytes that begin a code point
    at_byte = np.append(np.flatnonzero(begins), len(data))
    of_byte = np.cumsum(begins) - 1
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    bounds = np.append(np.cumsum(begins) - begins, len(points))[offsets - offsets[0]]  # first code point of each text
    kind = _kinds(points)
    inside, word = kind > 0, kind == 1
    first = np.zeros(len(points) + 1, bool)
    first[bounds] = True
    goes_on = np.zeros(len(points), bool)  # in a word, not its first
    goes_on[1:] = word[1:] & word[:-1] & ~first[1:-1]
    starts = np.flatnonzero(inside & ~goes_on)
    ends = np.flatnonzero(inside & ~np.append(goes_on, False)[1:]) + 1
    of_text = np.searchsorted(starts, bounds)
    shift = np.repeat(bounds[:-1], np.diff(of_text))
    spelled = np.append(0, np.cumsum(at_byte[ends] - at_byte[starts])).astype(np.int32)
    kept = data[inside[of_byte]] if len(data) else data
    tokens = pa.StringArray.from_buffers(len(starts), pa.py_buffer(spelled), pa.py_buffer(kept.tobytes()))
    columns = [tokens, pa.array((starts - shift).astype(np.int32)), pa.array((ends - shift).astype(np.int32))]
    found = pa.StructArray.from_arrays(columns, ["tok", "start", "end"])
    mask = texts.is_null() if texts.null_count else None
    return pa.ListArray.from_arrays(pa.array(of_text.astype(np.int32)), found, mask=mask)


def _located_by_piece(text: pa.Array) -> pa.Array:
    """Tokens of one text that is longer than SCAN_BYTES: its pieces are scanned one by one, a word cut by a border is joined again."""
    begin, end = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + 2].tolist()
    data = np.frombuffer(text.buffers()[2], np.uint8)
    cuts = []
    for cut in range(begin, end, SCAN_BYTES):
        while data[cut] & 0xC0 == 0x80:  # a piece begins with a whole code point
            cut -= 1
        cuts.append(cut)
    cuts = np.append(np.unique(cuts), end).astype(np.int32)
    pieces = pa.StringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts), text.buffers()[2])
    found = [_located(pieces.slice(k, 1)).values for k in range(len(pieces))]
    lengths = pc.utf8_length(pieces).to_numpy()
    shifts = (np.cumsum(lengths) - lengths).astype(np.int32)
    starts, ends = (np.concatenate([f.field(n).to_numpy() + s for f, s in zip(found, shifts)]) for n in ("start", "end"))
    tokens, firsts = pa.concat_arrays([f.field("tok") for f in found]), np.cumsum([len(f) for f in found[:-1]])
    del found
    own = np.ones(len(tokens), bool)  # tokens that do not go on with the one before
    for i in firsts.tolist():
        if 0 < i < len(tokens) and starts[i] == ends[i - 1]:
            own[i] = _kind(tokens[i - 1].as_py()[-1]) != 1 or _kind(tokens[i].as_py()[0]) != 1
    heads = np.flatnonzero(own)
    spelled = np.append(0, np.cumsum(pc.binary_length(tokens).to_numpy(), dtype=np.int32))[np.append(heads, len(tokens))].astype(np.int32)
    whole = pa.StringArray.from_buffers(len(heads), pa.py_buffer(spelled), tokens.buffers()[2])
    columns = [whole, pa.array(starts[heads]), pa.array(ends[np.append(heads, len(tokens))[1:] - 1])]
    return pa.ListArray.from_arrays(pa.array([0, len(heads)], pa.int32()), pa.StructArray.from_arrays(columns, ["tok", "start", "end"]))


def _stretches(texts: pa.Array) -> Iterator[pa.Array]:
    """Tokens in stretches of about SCAN_BYTES, which bound the memory; a longer text is a stretch of its own, scanned by piece."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.string())
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1)
    at = 0
    while at < len(texts):
        until = max(at + 1, int(np.searchsorted(ends, ends[at] + SCAN_BYTES, "right")) - 1)
        stretch = texts.slice(at, until - at)
        yield _located(stretch) if ends[until] - ends[at] <= SCAN_BYTES else _located_by_piece(stretch)
        at = until


def _token_offsets(texts: pa.Array) -> pa.Array:
    parts = list(_stretches(texts))
    return pa.concat_arrays(parts) if parts else pa.array([], _TOKENS)


def _sent_by_stretch(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Every stretch leaves the worker before the next is scanned, so no batch's tokens are ever held together."""
    for texts in batches:
        yield from _stretches(texts)


def token_offsets(text: Column) -> Column:
    """``array<struct<tok,start,end>>``: words and single symbols with character offsets.

    Words are letters, numbers and underscores. The bytes of an Arrow batch are scanned at once: positions come from one
    comparison of neighbours, so the cost per byte does not depend on how long a text is. A worker holds one Arrow batch of texts
    and the tokens of one stretch of it, or of one text if that is longer.
    """
    return F.arrow_udf(_sent_by_stretch, "array<struct<tok:string,start:int,end:int>>")(text)


# The substitutions of the standard machine-translation tokeniser
# ("13a"), in the order in which they apply.  The space is left out of the first
# class: it separates tokens whether or not more spaces are put around it.
BLEU_RULES = (
    ("<skipped>", ""),
    ("-\n", ""),
    ("\n", " "),
    ("&quot;", '"'),
    ("&amp;", "&"),
    ("&lt;", "<"),
    ("&gt;", ">"),
)
BLEU_SPLITS = (
    (r"([\{-\~\[-\`\!-\&\(-\+\:-\@\/])", r" $1 "),
    (r"([^0-9])([\.,])", r"$1 $2 "),
    (r"([\.,])([^0-9])", r" $1 $2"),
    (r"([0-9])(-)", r"$1 $2 "),
)


def bleu_tokens(text: Column) -> Column:
    out = strip(text)
    for old, new in BLEU_RULES:
        out = F.replace(out, F.lit(old), F.lit(new))
    out = F.concat(F.lit(" "), out, F.lit(" "))
    for pattern, replacement in BLEU_SPLITS:
        out = F.regexp_replace(out, pattern, replacement)
    return space_tokens(out)
