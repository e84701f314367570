"""Name perturbations for stress tests, and ORCID blinding.

Choices follow from hashes of the mention id, so they are the same on every run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..exceptions import DataIntegrityError
from ..functions import chinese
from ..functions import text as T


def uniform(key: Column, tag: str) -> Column:
    """A number in [0, 1) from the first 8 hex digits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat(key, F.lit(tag))), 1, 8), 16, 10).cast("double") / float(1 << 32)


def perturbed(name: Column, key: Column) -> tuple[Column, Column]:
    """(new name, operation): swap order 40 %, punctuation 20 %, space removed or hyphenated 20 %, given name to an initial 20 %."""
    draw = uniform(key, "op")
    by_blank = T.tokens(name)
    parts = F.when((F.size(by_blank) < 2) & F.contains(name, F.lit(",")), F.transform(F.split(name, ","), lambda x: F.trim(x))).otherwise(by_blank)
    two = F.size(parts) >= 2
    swapped = F.when(two, F.array_join(F.reverse(parts), " ")).otherwise(name)
    given = F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit(""))
    initial = F.when(~two, name).when(F.length(given) > 1, F.concat(parts[0], F.lit(" "), F.left(given, F.lit(1)), F.lit("."))).otherwise(swapped)
    space = F.when(uniform(key, "space") < 0.5, F.replace(name, F.lit(" "), F.lit(""))).otherwise(F.replace(name, F.lit(" "), F.lit("-")))
    comma = F.when(F.contains(name, F.lit(",")), F.replace(F.replace(name, F.lit(","), F.lit("")), F.lit("  "), F.lit(" "))).when(F.size(by_blank) >= 2, F.concat(by_blank[0], F.lit(", "), F.array_join(F.slice(by_blank, F.lit(2), F.size(by_blank)), " "))).otherwise(name)
    op = F.when(F.trim(name) == "", "none").when(draw < 0.4, "swap_order").when(draw < 0.6, "punctuation").when(draw < 0.8, "remove_space").otherwise(F.when(two & (F.length(given) <= 1), "swap_order_fallback").otherwise("initialize_given"))
    new = F.when(op == "none", name).when(op == "swap_order", swapped).when(op == "punctuation", comma).when(op == "remove_space", space).otherwise(initial)
    return F.trim(new), op


def stress(mentions: DataFrame, rate: float = 0.3) -> DataFrame:
    """Mentions with raw_name_original and stress_op; a hash-drawn ``rate`` of romanised Chinese names is perturbed and loses its parsed parts."""
    chosen = chinese.is_romanized_chinese("raw_name") & (uniform(F.col("mention_id"), "pick") < rate)
    new, op = perturbed(T.text("raw_name"), F.col("mention_id"))
    blank = lambda c: F.when(F.col("_s"), F.lit("")).otherwise(F.col(c))
    return mentions.withColumns({"_s": chosen, "_new": new, "_op": op, "raw_name_original": F.col("raw_name")}).withColumns({"raw_name": F.when(F.col("_s"), F.col("_new")).otherwise(F.col("raw_name")), "stress_op": F.when(F.col("_s"), F.col("_op")), "lastname": blank("lastname"), "firstname": blank("firstname")}).drop("_s", "_new", "_op")


def report(stressed: DataFrame) -> DataFrame:
    """op, n, changed: how many mentions each operation met and changed."""
    return stressed.where("stress_op IS NOT NULL").groupBy(F.col("stress_op").alias("op")).agg(F.count("*").alias("n"), F.count_if(F.col("raw_name") != F.col("raw_name_original")).alias("changed"))


def check(stressed: DataFrame, rate: float = 0.3) -> None:
    """DataIntegrityError unless some names are stressed, at least 0.6 x rate of them, and four fifths of those changed."""
    cn = chinese.is_romanized_chinese("raw_name_original")
    r = stressed.agg(F.count_if(cn).alias("cn"), F.count("stress_op").alias("n"), F.count_if(F.col("stress_op").isNotNull() & (F.col("raw_name") != F.col("raw_name_original"))).alias("changed")).first()
    if not r["n"] or r["n"] < 0.6 * rate * r["cn"] or r["changed"] < 0.8 * r["n"]:
        raise DataIntegrityError(f"stress set out of bounds: {r.asDict()}")


def blind(mentions: DataFrame) -> DataFrame:
    """Mentions without ORCIDs."""
    return mentions.withColumn("orcid", F.lit(""))


def is_blind(mentions: DataFrame) -> bool:
    """Whether no row has an ORCID; every row counts."""
    return mentions.where(T.text("orcid") != "").isEmpty()


def orcid_counts(mentions: DataFrame) -> DataFrame:
    """total, with_orcid, unique_orcids: one row."""
    o = F.nullif(T.text("orcid"), F.lit(""))
    return mentions.agg(F.count("*").alias("total"), F.count(o).alias("with_orcid"), F.count_distinct(o).alias("unique_orcids"))


def subset_stats(mentions: DataFrame) -> DataFrame:
    """total, chinese, non_chinese, ratio, chinese_orcids: one row."""
    cn = chinese.is_romanized_chinese("raw_name")
    got = mentions.agg(F.count("*").alias("total"), F.count_if(cn).alias("chinese"), F.count_distinct(F.when(cn, F.nullif(T.text("orcid"), F.lit("")))).alias("chinese_orcids"))
    return got.select("total", "chinese", (F.col("total") - F.col("chinese")).alias("non_chinese"), F.when(F.col("total") > 0, F.col("chinese") / F.col("total")).otherwise(0.0).alias("ratio"), "chinese_orcids")
