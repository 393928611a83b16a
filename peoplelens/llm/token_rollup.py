"""Token totals by source, language and tokenizer version, maintained by signed deltas.

A store is a shared folder. A batch of changes is turned into signed rows against what earlier batches left of the same documents: an
insert adds its count, a delete takes the old one away, a revision does both. The signed rows go to the ledger, their sums
per group to the deltas, and totals are the sum of all deltas. Since sums are additive, no batch reads the corpus or older totals.

A batch counts once its commit record is written, which is the last thing done. Applying a committed batch again changes nothing; what
a broken attempt has left behind is overwritten by the next one and never read.

Changes are (op, seq, doc_id, version, source, lang, tokens) with op 'upsert' or 'delete'. Defined cases: of several changes of one document and
version in a batch the one with the largest seq holds (ties: the larger row). Deleting what is not there does nothing. A change without
a doc_id cannot be revised later: its upserts are added as they come, its deletes ignored. NULL source and lang are groups of their own,
NULL tokens count as 0.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from peoplelens.llm.common import names_in, staged

GROUP = ("source", "lang", "version")
CHANGE = "op string, seq long, doc_id long, version string, source string, lang string, tokens long"
ENTRY = ("doc_id", "version", "source", "lang", "tokens")

#: Byte-level BPE: how a text is cut before merging (fixed, as published with the vocabularies).
CUT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Rollup:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _at(self, kind: str, batch: str) -> str:
        if not re.fullmatch(r"[A-Za-z0-9_-]+", batch):
            raise ValueError("a batch id is made of letters, digits, _ and -")
        return f"{self.folder}/{kind}/{batch}"

    def is_committed(self, batch: str) -> bool:
        return "_SUCCESS" in names_in(self.spark, self._at("commits", batch))

    def batches(self) -> list[str]:
        names = names_in(self.spark, f"{self.folder}/commits")
        return sorted(n for n in names if self.is_committed(n))

    def _read(self, kind: str, schema: str) -> DataFrame:
        paths = [self._at(kind, b) for b in self.batches()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def ledger(self) -> DataFrame:
        return self._read("ledger", "doc_id long, version string, source string, lang string, tokens long, sign int")

    def entries(self) -> DataFrame:
        """What the committed batches leave of each document."""
        signed = self.ledger().groupBy(*ENTRY).agg(F.sum("sign").alias("n")).filter("n > 0")
        return signed.select(*ENTRY, "n")

    def totals(self) -> DataFrame:
        """(source, lang, version, documents, tokens) over the committed batches; groups that became empty are left out."""
        return (self._read("deltas", "source string, lang string, version string, documents long, tokens long")
                .groupBy(*GROUP).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens")).filter("documents <> 0"))

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Apply one batch; False if it was committed before."""
        if self.is_committed(batch):
            return False
        changes = changes.select("op", "seq", "doc_id", "version", "source", "lang", F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"))
        latest = Window.partitionBy("doc_id", "version").orderBy(F.col("seq").desc(), F.struct("op", "source", "lang", "tokens").desc())
        last = changes.filter("doc_id IS NOT NULL").withColumn("r", F.row_number().over(latest)).filter("r = 1").drop("r")
        last = staged(last, "changes")
        old = (self.ledger().filter("doc_id IS NOT NULL").join(last.select("doc_id", "version"), ["doc_id", "version"], "left_semi")
               .groupBy(*ENTRY).agg(F.sum("sign").alias("n")).filter("n > 0"))
        unnamed = changes.filter("doc_id IS NULL AND op = 'upsert'").select(*ENTRY, F.lit(1).alias("sign"))
        signed = (last.filter("op = 'upsert'").select(*ENTRY, F.lit(1).alias("sign"))
                  .unionByName(old.select(*ENTRY, (-F.col("n")).cast("int").alias("sign"))).unionByName(unnamed))
        signed.write.mode("overwrite").parquet(self._at("ledger", batch))
        written = self.spark.read.schema(signed.schema).parquet(self._at("ledger", batch))
        (written.groupBy(*GROUP).agg(F.sum("sign").cast("long").alias("documents"), F.sum(F.col("sign") * F.col("tokens")).alias("tokens"))
         .write.mode("overwrite").parquet(self._at("deltas", batch)))
        self.spark.range(1).select(F.lit(batch).alias("batch")).coalesce(1).write.mode("overwrite").parquet(self._at("commits", batch))
        return True


def token_counts(docs: DataFrame, vocabularies: dict[str, str], keep: tuple[str, ...] = ("doc_id", "source", "lang"),
                 text: str = "text") -> DataFrame:
    """(kept columns, version, tokens): tokens of each whole text under each byte-level BPE vocabulary.

    ``vocabularies`` maps a version's name to the path of its ranks file, which the driver reads and sends to the tasks (under
    2 MB each). NULL texts have no tokens.
    """
    source = docs.select(*keep, F.col(text).alias("_text"))
    schema = source.drop("_text").schema.add("version", "string").add("tokens", "long")
    files = {}
    for version, path in vocabularies.items():
        with open(path, "rb") as f:
            files[version] = f.read()
    shared = docs.sparkSession.sparkContext.broadcast(files)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        encoders = {version: tiktoken.Encoding(version, pat_str=CUT, special_tokens={}, mergeable_ranks={
            base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines())})
            for version, data in shared.value.items()}
        for batch in batches:
            texts = [t or "" for t in batch["_text"]]
            batch = batch.drop(columns="_text")
            for version, encoder in encoders.items():
                yield batch.assign(version=version, tokens=[len(encoder.encode_ordinary(t)) for t in texts])

    return source.mapInPandas(run, schema)
