"""Incremental disambiguation as Structured Streaming.

Each micro-batch of mentions is decided against the snapshot of authors that
the batches before it left; decisions are appended and a new snapshot is
written under the batch's number, so a batch that is run again overwrites its
own output and nothing else (exactly once per batch id).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import incremental

_AUTHORS = "author_id string, canonical_name string, orcid string, coauthors array<string>, journals array<string>, affiliations array<string>, seq long"
MENTIONS = "mention_id string, seq long, name string, orcid string, coauthors array<string>, journals array<string>, affiliations array<string>"


def stream_mentions(spark: SparkSession, folder: str, schema: str = MENTIONS, files_per_batch: int = 1) -> DataFrame:
    """Mentions from Parquet files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


class Disambiguator:
    """foreachBatch sink: decisions below ``out``/decisions, snapshots below ``out``/authors."""

    def __init__(self, spark: SparkSession, out: str, mode: str = "baseline", accept: float = 0.90, reject: float = 0.20):
        self.spark, self.out, self.mode, self.accept, self.reject = spark, out.rstrip("/"), mode, accept, reject

    def authors(self, batch: int) -> DataFrame:
        """The snapshot after a batch; empty before the first."""
        if batch < 0:
            return self.spark.createDataFrame([], _AUTHORS)
        return self.spark.read.schema(_AUTHORS).parquet(f"{self.out}/authors/batch={batch}")

    def decisions(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.out}/decisions")

    def __call__(self, batch: DataFrame, number: int) -> None:
        rows = batch.dropDuplicates(["mention_id"])
        before = self.authors(number - 1)
        made = incremental.snapshot(rows, before, self.mode, self.accept, self.reject).withColumn("batch", F.lit(number))
        path = f"{self.out}/decisions/number={number}"
        made.write.mode("overwrite").parquet(path)
        decided = self.spark.read.parquet(path)
        incremental.absorb(before, rows, decided).write.mode("overwrite").parquet(f"{self.out}/authors/batch={number}")


def run(mentions: DataFrame, sink: Disambiguator, checkpoint: str):
    """Start the query; ``availableNow`` ends it when the present files are done."""
    return mentions.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def decision_rates(decisions: DataFrame, time: str = "ts", window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Decisions by event-time window and kind, with a watermark: works on streams and batches alike."""
    return decisions.withWatermark(time, late).groupBy(F.window(time, window), "decision").agg(F.count("*").alias("n"))
