"""Token totals by source, language and tokenizer version, maintained by signed deltas.

A batch of changes inserts, deletes or recounts documents. It is compared with the ledger (the last count of every
document and tokenizer version) and becomes a few signed rows per source, language and version: what a document counted
before goes off, what it counts now comes on. Totals are the sums of all committed batches.

A commit writes the batch's ledger rows, with what each replaces, and sums the totals from them; Spark's success mark
beside the totals is the commit. A batch whose mark exists is skipped, so delivering it again changes nothing; one that
broke off is written anew, and its half-written ledger rows are not read meanwhile. Batches are committed one at a time.
Every ``COMPACT`` batches the ledger and the totals are written as one table each, without what is gone, so a commit reads
that table and the batches since; a compaction that broke off is not read and is done again by the next one.

Defined results: null ids, sources, languages are values of their own; of several changes of one document and version in a
batch, the last in the order (seq, op, n_tokens, source, lang) counts; deleting what is not there changes nothing;
an insert of a known document is a recount; a count of null is 0; groups whose last document is gone disappear;
other columns are ignored; an empty batch is committed as such.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ["doc_id", "tokenizer"]
GROUP = ["source", "lang", "tokenizer"]
COMPACT = 16
LEDGER = "doc_id long, tokenizer string, source string, lang string, n_tokens long, alive boolean, batch long"
TOTALS = "source string, lang string, tokenizer string, docs long, tokens long, batch long"


class TokenRollups:
    """The tables under a shared folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, table: str, batch: int) -> str:
        return f"{self.folder}/{table}/batch-{batch}"

    def _done(self, table: str, batch: int) -> bool:
        context = self.spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(f"{self._path(table, batch)}/_SUCCESS")
        return path.getFileSystem(context._jsc.hadoopConfiguration()).exists(path)

    def committed(self, batch: int) -> bool:
        return self._done("totals", batch)

    def _read(self, table: str, schema: str, below: int) -> DataFrame:
        """All batches before ``below``, which numbers them without gaps; the oldest of them as one compacted table."""
        since = next((b for b in range(below // COMPACT * COMPACT, 0, -COMPACT) if self._done(f"compact-{table}", b)), 0)
        paths = [self._path(table, b) for b in range(since, below)] + ([self._path(f"compact-{table}", since)] if since else [])
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _ledger(self, below: int) -> DataFrame:
        """(doc_id, tokenizer, o): the last row of every document and version."""
        return self._read("ledger", LEDGER, below).groupBy(*KEY).agg(F.max(F.struct("batch", "source", "lang", "n_tokens", "alive")).alias("o"))

    def _sums(self, below: int) -> DataFrame:
        return self._read("totals", TOTALS, below).groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))

    def _compact(self, below: int) -> None:
        """The state after the batches before ``below`` as one table; documents and groups that are gone are left out."""
        if not self._done("compact-ledger", below):
            self._ledger(below).where("o.alive").select(*KEY, "o.source", "o.lang", "o.n_tokens", "o.alive", "o.batch").write.mode("overwrite").parquet(self._path("compact-ledger", below))
        if not self._done("compact-totals", below):
            last = F.lit(below - 1).cast("long").alias("batch")
            self._sums(below).where("docs > 0").select(*GROUP, "docs", "tokens", last).write.mode("overwrite").parquet(self._path("compact-totals", below))

    def commit(self, batch: int, changes: DataFrame) -> bool:
        """Apply changes (doc_id, tokenizer, source, lang, n_tokens, op, seq), op one of insert, revise, delete.

        Batches are numbered from 0. Returns whether the batch was applied now.
        """
        if self.committed(batch):
            return False
        if batch and not self.committed(batch - 1):
            raise ValueError(f"batch {batch - 1} is not committed")
        bad = F.raise_error(F.concat(F.lit("unknown op "), F.coalesce("op", F.lit("null")))).cast("boolean")
        alive = F.when(F.col("op") == "delete", F.lit(False)).when(F.col("op").isin("insert", "revise"), F.lit(True)).otherwise(bad)
        last = F.max(F.struct("seq", "op", "n_tokens", "source", "lang", alive.alias("alive"))).alias("c")
        new = changes.groupBy(*KEY).agg(last).select(*KEY, "c.source", "c.lang", F.coalesce("c.n_tokens", F.lit(0)).cast("long").alias("n_tokens"), "c.alive")
        if batch and batch % COMPACT == 0:
            self._compact(batch)
        old = self._ledger(batch)
        both = new.alias("n").join(old.alias("o"), F.col("n.doc_id").eqNullSafe(F.col("o.doc_id")) & (F.col("n.tokenizer") == F.col("o.tokenizer")), "left")
        # Written once with what each row replaces; the totals come from what was written.
        ledger = both.select("n.*", "o.o").where("alive or o.alive").withColumn("batch", F.lit(batch).cast("long"))
        ledger.write.mode("overwrite").parquet(self._path("ledger", batch))
        both = self.spark.read.schema(ledger.schema).parquet(self._path("ledger", batch))
        off = F.struct(F.col("o.source").alias("source"), F.col("o.lang").alias("lang"), F.lit(-1).alias("docs"), (-F.col("o.n_tokens")).alias("tokens"), F.col("o.alive").alias("use"))
        on = F.struct("source", "lang", F.lit(1).alias("docs"), F.col("n_tokens").alias("tokens"), F.col("alive").alias("use"))
        signed = both.select("tokenizer", F.explode(F.array(off, on)).alias("d")).where("d.use").select("tokenizer", "d.*")
        totals = signed.groupBy(*GROUP).agg(F.sum("docs").cast("long").alias("docs"), F.sum("tokens").cast("long").alias("tokens"))
        totals.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").parquet(self._path("totals", batch))
        return True

    def totals(self, batches: int) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens) after the first ``batches`` batches."""
        return self._sums(batches).where("docs > 0").withColumnsRenamed({"docs": "n_docs", "tokens": "n_tokens"})
