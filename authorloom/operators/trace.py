"""Decision traces: redaction, rows, hashes and the review queue."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SALT
from ..functions import text as T
from ..shipping import ship


def redacted_mention(salt: str = SALT) -> Column:
    """Struct of a mention (name, orcid, affiliations, coauthors, journals): hashes and counts, no plain text but the ORCID."""
    empty = F.array().cast("array<string>")
    affiliations, coauthors, journals = (F.coalesce(F.col(c), empty) for c in ("affiliations", "coauthors", "journals"))
    return F.struct(
        T.redacted_name("name", salt).alias("name"),
        F.col("orcid").alias("orcid"),
        F.transform(affiliations, lambda x: T.salted_hash(x, salt)).alias("affiliation"),
        F.size(coauthors).alias("coauthor_count"),
        F.size(journals).alias("journal_count"),
        F.transform(F.slice(F.array_sort(journals), 1, 2), lambda x: T.salted_hash(x, salt, 12)).alias("journal_samples"),
    )


def decision_hash(decision: str, score: float, components: dict[str, float], author: str | None, mode: str, thresholds: dict[str, float]) -> str:
    """First 12 hex digits of the SHA-256 of a decision's sorted JSON, numbers rounded to 6 places."""
    data = {"decision": decision, "score_total": round(score, 6), "score_components": {k: round(v, 6) for k, v in components.items()}, "best_author_id": author, "mode": mode, "thresholds": {k: round(v, 6) for k, v in thresholds.items()}}
    return hashlib.sha256(json.dumps(data, sort_keys=True, ensure_ascii=False).encode()).hexdigest()[:12]


def decision_hash_udf(spark: SparkSession, mode: str, thresholds: dict[str, float]):
    """Arrow-batched: (decision, score, components as a JSON object, author) to the hash. Python spells floats its own way."""
    ship(spark)

    @F.pandas_udf("string")
    def apply(decision: pd.Series, score: pd.Series, components: pd.Series, author: pd.Series) -> pd.Series:
        rows = zip(decision, score, components, author, strict=True)
        return pd.Series([decision_hash(d, float(s), json.loads(c) if c else {}, a if isinstance(a, str) else None, mode, thresholds) for d, s, c, a in rows], dtype="object")

    return apply


def blocking_keys(salt: str | None = None) -> Column:
    """Reported keys; with a salt, names in them are hashed (reports of old show surnames in plain text)."""
    from .blocking import reported_keys

    keys = reported_keys("name", "orcid")
    if salt is None:
        return keys
    return F.transform(keys, lambda k: F.when(k.startswith("orcid:"), k).otherwise(F.concat(F.substring_index(k, ":", 1), F.lit(":"), T.salted_hash(F.substring_index(k, ":", -1), salt))))


def rows(mentions: DataFrame, decisions: DataFrame, mode: str, accept: float, reject: float, run_id: str = "", salt: str = SALT, hash_keys: bool = False) -> DataFrame:
    """Trace rows: decisions (mention_id, decision, score_total, components, best_author_id, candidate_count, reason) with redacted mentions."""
    thresholds = {"accept": accept, "reject": reject}
    joined = decisions.join(mentions, "mention_id")
    components = F.col("components") if "components" in decisions.columns else F.create_map().cast("map<string,double>")
    hashed = decision_hash_udf(mentions.sparkSession, mode, thresholds)
    as_json = F.to_json(components)
    return joined.select(
        "mention_id", F.lit(run_id).alias("run_id"), F.lit(mode).alias("mode"), "decision", F.round("score_total", 6).alias("score_total"),
        F.transform_values(components, lambda _, v: F.round(v, 6)).alias("score_components"),
        F.create_map(F.lit("accept"), F.lit(accept), F.lit("reject"), F.lit(reject)).alias("thresholds"),
        "best_author_id", "reason", hashed("decision", "score_total", as_json, "best_author_id").alias("deterministic_hash"), "candidate_count",
        blocking_keys(salt if hash_keys else None).alias("blocking_keys"), redacted_mention(salt).alias("mention"),
    )


def review_queue(trace: DataFrame) -> DataFrame:
    """Undecided rows, pending review."""
    return trace.where(F.col("decision") == "unknown").withColumn("review_status", F.lit("pending"))
