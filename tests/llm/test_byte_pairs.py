"""Encoding against the whole-text encoder, with chunks so short that every long text is stitched."""

from __future__ import annotations

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from stairwell.llm import byte_pairs
from stairwell.llm.byte_pairs import ByteBpe, read_ranks
from stairwell.llm.common import stored

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
TEXTS = [
    None, "", " ", "a", "  two  spaces  ", "it's we'll 'tis ''s", "tab\tand\n\n new  \n\nlines \n x", "x" * 700, " " * 300 + "y",
    "zürich 漢字かな １２ ½ ² ßtraße " * 40, "word " * 500, "a b\n" * 300 + "    end \x1c\x1f.", "🙂🙃 " * 200, "<|endoftext|> x",
    "the cat sat, on 12 mats!! " * 100, "q" * 40 + " " + "7" * 400 + " tail",
]


@pytest.mark.parametrize(("chunk", "overlap"), [(64, 16), (200, 32), (1 << 16, 256)])
def test_like_the_whole_text(spark, chunk, overlap):
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(PATH), special_tokens={})
    rows = [(i, t, "ids") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "again"), (None, "no id " * 60, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    model = ByteBpe(spark, PATH, public_tokenizers.PATTERN, chunk, overlap)
    got = model.encode(docs)
    got = got.withColumn("bytes", model.decode(F.col("ids"))).collect()
    assert len(got) == len(rows)
    want = {i: t or "" for i, t, _ in rows}
    for row in got:
        text = want[row.doc_id]
        assert list(memoryview(bytes(row.ids)).cast("I")) == own.encode_ordinary(text)
        assert bytes(row.bytes) == text.encode()


def test_chunks_have_the_same_names_in_every_run(spark, monkeypatch):
    """What a task writes when it is run again must fit what others wrote before; equal rows are all kept."""
    kept = []
    monkeypatch.setattr(byte_pairs, "stored", lambda df, label: kept.append((label, df)) or stored(df, label))
    text, run = "the cat sat, on 12 mats!! " * 40, "q" * 400
    rows = [(1, text), (1, text), (1, text + "x"), (2, text), (None, text), (None, text), (3, run), (3, run)]
    model = ByteBpe(spark, PATH, public_tokenizers.PATTERN, 64, 16)
    got = model.encode(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    decoded = [(r.doc_id, bytes(r.b).decode()) for r in got.select("doc_id", model.decode(F.col("ids")).alias("b")).collect()]
    assert sorted(decoded, key=str) == sorted(rows, key=str)
    chunks = next(df for label, df in kept if label == "chunks")
    first, again = (sorted(chunks.select("doc", "k").collect()) for _ in range(2))  # two plans: nothing of the first is used again
    assert first == again


def test_no_rows(spark):
    model = ByteBpe(spark, PATH, public_tokenizers.PATTERN)
    got = model.encode(spark.createDataFrame([], "doc_id long, text string"))
    assert got.withColumn("b", model.decode(F.col("ids"))).collect() == []


def test_a_chunk_needs_room_for_its_overlap(spark):
    with pytest.raises(ValueError, match="overlap"):
        ByteBpe(spark, PATH, public_tokenizers.PATTERN, 10, 6)
