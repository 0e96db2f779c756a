"""Token-per-line files: ``token pos chunk ner``, sentences set apart by empty lines.

An empty line is the record separator handed to Spark's text reader, so a large
file is read in splits and each record is a sentence already; no running count
over the file's lines is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stairwell.sources.lines import number_in_file, read_records

# The marker of a document start, and the declared classes of the format's three tag columns, in order of their ids.
DOCUMENT_START = "-DOCSTART-"
POS_TAGS = tuple(
    "\" '' # $ ( ) , . : `` CC CD DT EX FW IN JJ JJR JJS LS MD NN NNP NNPS NNS NN|SYM PDT POS PRP PRP$ "
    "RB RBR RBS RP SYM TO UH VB VBD VBG VBN VBP VBZ WDT WP WP$ WRB".split()
)
CHUNK_TAGS = tuple(
    "O B-ADJP I-ADJP B-ADVP I-ADVP B-CONJP I-CONJP B-INTJ I-INTJ B-LST I-LST B-NP I-NP B-PP I-PP B-PRT I-PRT "
    "B-SBAR I-SBAR B-UCP I-UCP B-VP I-VP".split()
)
NER_TAGS = ("O", "B-PER", "I-PER", "B-ORG", "I-ORG", "B-LOC", "I-LOC", "B-MISC", "I-MISC")
CLASSES = {"pos_tags": POS_TAGS, "chunk_tags": CHUNK_TAGS, "ner_tags": NER_TAGS}


def class_ids(tags: Column, names: tuple[str, ...]) -> Column:
    """``array<int>``: places of the tags among the declared classes; a tag that is none of them is an error."""
    declared = F.array(*[F.lit(n) for n in names])

    def one(tag: Column) -> Column:
        place = F.array_position(declared, tag)
        unknown = F.raise_error(F.concat(F.lit("no declared class: "), F.coalesce(tag, F.lit("null")))).cast("int")
        return F.when(place > 0, (place - 1).cast("int")).otherwise(unknown)

    return F.transform(tags, one)


def block_sentences(block: Column) -> Column:
    """``array<array<string>>``: the non-empty sentences of a text, as arrays of lines.

    A document-start line separates just as an empty line does.
    """
    unix = F.regexp_replace(block, "\r\n?", "\n")
    marked = F.regexp_replace(unix, rf"(?m)^{DOCUMENT_START}.*$", "")
    pieces = F.split(marked, "\n\n+")
    lines = F.transform(pieces, lambda p: F.filter(F.split(p, "\n"), lambda line: line != ""))
    return F.filter(lines, lambda s: F.size(s) > 0)


def sentence_columns(lines: Column) -> list[Column]:
    """Tokens and the three tag arrays of a sentence's lines."""

    def column(position: int) -> Column:
        return F.transform(lines, lambda line: F.rtrim(F.element_at(F.split(line, " "), position + 1)))

    names = ("tokens", "pos_tags", "chunk_tags", "ner_tags")
    return [column(i).alias(name) for i, name in enumerate(names)]


def parse_conll(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """``keys``, ``sentence`` (0.. within the row) and the token and tag arrays."""
    sentences = df.select(*keys, F.posexplode(block_sentences(F.col(text))).alias("sentence", "lines"))
    return sentences.select(*keys, "sentence", *sentence_columns(F.col("lines")))


def read_conll(spark: SparkSession, path: str, ids: bool = False) -> DataFrame:
    """``file``, ``id`` ("0".."n-1" per file), ``tokens``, ``pos_tags``, ``chunk_tags``, ``ner_tags``.

    With ``ids`` the tags are the numbers of the declared CLASSES.  Large files are read in splits; the first line
    tells whether the empty line between them ends in a carriage return, too.
    """
    first = spark.read.option("lineSep", "\n").text(path).first()
    end = "\r\n" if first and first.value.endswith("\r") else "\n"
    blocks = read_records(spark, path, separator=end * 2)
    lines = blocks.select(F.explode(block_sentences(F.col("value"))).alias("lines"), "__file", "__split")
    numbered = number_in_file(lines, "place")
    out = numbered.select("file", F.col("place").cast("string").alias("id"), *sentence_columns(F.col("lines")))
    return out.withColumns({c: class_ids(F.col(c), names) for c, names in CLASSES.items()}) if ids else out
