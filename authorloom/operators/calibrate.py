"""m/u calibration from ORCID-labelled mentions: features, bins, pairs, tables."""

from __future__ import annotations

import yaml
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions import text as T
from .scoring import configured_bin

#: Bins of the calibrated features; both ends count, the first that holds a value wins.
BINS = {
    "name_similarity": [{"name": "exact", "min": 0.95, "max": 1.0}, {"name": "high", "min": 0.85, "max": 0.95}, {"name": "medium", "min": 0.7, "max": 0.85}, {"name": "low", "min": 0.5, "max": 0.7}, {"name": "none", "min": 0.0, "max": 0.5}],
    "affiliation_similarity": [{"name": "exact", "min": 0.95, "max": 1.0}, {"name": "high", "min": 0.7, "max": 0.95}, {"name": "partial", "min": 0.4, "max": 0.7}, {"name": "none", "min": 0.0, "max": 0.4}],
}


def positive_pairs(mentions: DataFrame) -> DataFrame:
    """(a, b, weight): all pairs of mentions of one ORCID, by classes of equal mentions.

    Mentions of an ORCID with the same name, affiliation and venue make a class,
    which its smallest id stands for. Two classes stand for as many pairs as the
    product of their sizes, a class with itself for the pairs within it. So a
    person's many lines cost as few rows as they have spellings.
    """
    rows = mentions.select("mention_id", F.trim(T.text("orcid")).alias("orcid"), T.text("raw_name").alias("name"), T.text("affiliation").alias("aff"), T.text("venue").alias("venue")).where("orcid <> ''")
    classes = rows.groupBy("orcid", "name", "aff", "venue").agg(F.min("mention_id").alias("id"), F.count("*").alias("n"))
    side = lambda k: classes.select("orcid", F.col("id").alias(k), F.col("n").alias(f"n_{k}"))
    weight = F.when(F.col("a") == F.col("b"), F.expr("n_a * (n_a - 1) div 2")).otherwise(F.col("n_a") * F.col("n_b"))
    return side("a").join(side("b"), "orcid").where("a <= b").select("a", "b", weight.alias("weight")).where("weight > 0")


def negative_pairs(mentions: DataFrame, n: int = 10_000, seed: str = "42") -> DataFrame:
    """(a, b) of mentions of different ORCIDs: ``n`` slots draw two mentions each by hash; equal ORCIDs are dropped.

    A mention takes the slot pair whose number its hash gives, so sampling is
    two joins on slot numbers and no cross product.
    """
    rows = mentions.select("mention_id", F.trim(T.text("orcid")).alias("orcid")).where("orcid <> ''")
    side = lambda tag, m, o: rows.groupBy(F.pmod(F.xxhash64("mention_id", F.lit(seed + tag)), F.lit(n)).alias("slot")).agg(F.min(F.struct(F.md5(F.concat("mention_id", F.lit(seed + tag))).alias("h"), F.col("mention_id").alias("m"), F.col("orcid").alias("o"))).alias("x")).select("slot", F.col("x.m").alias(m), F.col("x.o").alias(o))
    return side("a", "a", "oa").join(side("b", "b", "ob"), "slot").where("oa <> ob").select("a", "b")


def pair_features(pairs: DataFrame, mentions: DataFrame, ratio=None) -> DataFrame:
    """a, b, weight, feature, bin rows. ``ratio`` compares two string columns; Jaro-Winkler unless given. Pairs without a weight count once."""
    pairs = pairs if "weight" in pairs.columns else pairs.withColumn("weight", F.lit(1).cast("long"))
    ratio = ratio or S.jaro_winkler_udf(mentions.sparkSession)
    side = lambda p: mentions.select(F.col("mention_id").alias(p), T.text("raw_name").alias(f"{p}_name"), T.text("orcid").alias(f"{p}_orcid"), T.text("affiliation").alias(f"{p}_aff"), T.text("venue").alias(f"{p}_venue"))
    rows = pairs.join(side("a"), "a").join(side("b"), "b")
    name = ratio(F.lower("a_name"), F.lower("b_name"))
    aff = F.when((F.col("a_aff") == "") | (F.col("b_aff") == ""), 0.0).otherwise(ratio(F.lower("a_aff"), F.lower("b_aff")))
    venue = F.when(F.lower("a_venue") == F.lower("b_venue"), F.when(F.col("a_venue") == "", "different").otherwise("same")).when((F.col("a_venue") != "") & (F.col("b_venue") != "") & (ratio(F.lower("a_venue"), F.lower("b_venue")) > 0.5), "similar").otherwise("different")
    orcid = F.when((F.col("a_orcid") != "") & (F.col("a_orcid") == F.col("b_orcid")), "exact").otherwise("none")
    found = {"name_similarity": configured_bin(name, BINS["name_similarity"]), "orcid_match": orcid, "affiliation_similarity": configured_bin(aff, BINS["affiliation_similarity"]), "venue_similarity": venue}
    return rows.select("a", "b", "weight", F.explode(F.array(*[F.struct(F.lit(k).alias("feature"), v.alias("bin")) for k, v in found.items()])).alias("x")).select("a", "b", "weight", "x.feature", "x.bin")


def table(positive: DataFrame, negative: DataFrame, alpha: float = 1.0) -> DataFrame:
    """feature, bin, m, u: shares with Laplace smoothing over the bins seen in either, rounded to 6 places. Rows count by their weight, once without."""
    weight = lambda rows: F.col("weight") if "weight" in rows.columns else F.lit(1).cast("long")
    none = F.lit(0).cast("long")
    both = positive.select("feature", "bin", weight(positive).alias("p"), none.alias("q")).union(negative.select("feature", "bin", none, weight(negative)))
    counts = both.groupBy("feature", "bin").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    w = Window.partitionBy("feature")
    share = lambda c: F.round((F.col(c) + alpha) / (F.sum(c).over(w) + alpha * F.count("*").over(w)), 6)
    return counts.select("feature", "bin", share("p").alias("m"), share("q").alias("u"))


def to_yaml(calibrated: DataFrame) -> str:
    """The table (features x bins rows) as YAML that ``config.mu_table`` reads."""
    out: dict = {}
    for r in calibrated.orderBy("feature", "bin").collect():
        out.setdefault(r["feature"], {})[r["bin"]] = {"m": r["m"], "u": r["u"]}
    return yaml.safe_dump({"mu_table": out}, sort_keys=True)


def levenshtein_ratio(a: Column, b: Column) -> Column:
    """A native stand-in for Jaro-Winkler."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when((a == "") | (b == ""), 0.0).otherwise(1 - F.levenshtein(a, b) / longest)
