"""Run registry and checks on outputs of experiments."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..exceptions import DataIntegrityError


def config_hash(config: dict) -> str:
    return hashlib.md5(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()[:8]


class RunRegistry:
    """Runs as JSON lines below ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def register_run(self, run_id: str, experiment: str, config: dict, dataset: str, metrics: dict[str, float], output: str, timestamp: str = "") -> None:
        row = (run_id, timestamp, experiment, config_hash(config), dataset, {k: float(v) for k, v in metrics.items()}, output)
        self.spark.createDataFrame([row], schemas.RUN).coalesce(1).write.mode("append").json(self.path)

    def load_all_runs(self) -> DataFrame:
        return self.spark.read.schema(schemas.RUN).json(self.path)

    def find_run(self, run_id: str) -> DataFrame:
        return self.load_all_runs().where(F.col("run_id") == run_id)

    def clear(self) -> None:
        self.spark.createDataFrame([], schemas.RUN).write.mode("overwrite").json(self.path)

    def check_outputs(self) -> None:
        """DataIntegrityError if two experiments name one output, or give equal metrics."""
        runs = self.load_all_runs()
        shared = runs.groupBy("output").agg(F.count_distinct("experiment").alias("n")).where("n > 1")
        same = runs.groupBy(F.to_json(F.map_from_entries(F.array_sort(F.map_entries("metrics")))).alias("m")).agg(F.count_distinct("experiment").alias("n")).where("n > 1")
        if not shared.isEmpty() or not same.isEmpty():
            raise DataIntegrityError("experiments share an output or have the same metrics")


def check_tables_differ(a: DataFrame, b: DataFrame, keys: list[str], values: list[str], within: float = 1e-6) -> None:
    """DataIntegrityError if two result tables are the same within a tolerance."""
    joined = a.select(*keys, *[F.col(v).alias(f"a_{v}") for v in values]).join(b.select(*keys, *[F.col(v).alias(f"b_{v}") for v in values]), keys, "full")
    differs = F.lit(False)
    for v in values:
        differs = differs | F.coalesce(F.abs(F.col(f"a_{v}") - F.col(f"b_{v}")) > within, F.lit(True))
    if joined.where(differs).isEmpty():
        raise DataIntegrityError("the tables are identical")
