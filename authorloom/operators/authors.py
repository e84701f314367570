"""The author table: creation, merging, lookups and statistics.

Sets are sorted arrays without repeats; ids follow from the first record's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


#: Hex digits of an id: 128 bits, so that ids of different records do not meet; and those shown to people.
ID_DIGITS, SHOWN_DIGITS = 32, 8


def author_id(record_id: Column, prefix: str = "au_") -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(record_id, 256), 1, ID_DIGITS))


def shown(identifier: Column) -> Column:
    """An id's short form, for display only: it can stand for several."""
    return F.regexp_replace(identifier, f"_([0-9a-f]{{{SHOWN_DIGITS}}})[0-9a-f]+$", "_$1")


def as_set(*columns: Column) -> Column:
    """Sorted distinct non-blank members of arrays."""
    joined = F.concat(*[F.coalesce(c, F.array().cast("array<string>")) for c in columns])
    return F.array_sort(F.array_distinct(F.filter(joined, lambda x: x.isNotNull() & (x != ""))))


def from_records(records: DataFrame) -> DataFrame:
    """A new author for each record (record_id, name, coauthors, journal, affiliation)."""
    return records.select(
        author_id(F.col("record_id")).alias("author_id"), F.col("name").alias("canonical_name"), F.lit("").alias("orcid"),
        as_set(F.col("coauthors")).alias("coauthors"), as_set(F.array("journal")).alias("journals"), as_set(F.array("affiliation")).alias("affiliations"),
        as_set(F.array("name")).alias("alternate_names"), as_set(F.array("record_id")).alias("linked_records"), F.lit(1.0).alias("confidence_score"))


def publication_from_record(records: DataFrame) -> DataFrame:
    title = T.either("publication_title", F.concat(F.lit("Publication from "), "record_id"))
    return records.select(author_id(F.col("record_id"), "pub_").alias("pub_id"), title.alias("title"), "journal", "year", F.col("coauthors").alias("coauthor_names"))


def merge_records(authors: DataFrame, matched: DataFrame) -> DataFrame:
    """Authors with matched records (author_id, record_id, name, coauthors, journal, affiliation) taken in.

    Record sets are pre-aggregated by author; confidence is at most 0.95 once
    an author has more than one record.
    """
    got = matched.groupBy("author_id").agg(F.collect_set("name").alias("n"), F.collect_set("journal").alias("j"), F.collect_set("affiliation").alias("f"), F.collect_set("record_id").alias("r"), F.array_distinct(F.flatten(F.collect_set("coauthors"))).alias("c"))
    joined = authors.join(got, "author_id", "left")
    sets = {"alternate_names": "n", "journals": "j", "affiliations": "f", "linked_records": "r", "coauthors": "c"}
    out = joined.withColumns({k: as_set(F.col(k), F.col(v)) for k, v in sets.items()})
    return out.withColumn("confidence_score", F.when(F.size("linked_records") > 1, F.least("confidence_score", F.lit(0.95))).otherwise(F.col("confidence_score"))).select(*authors.columns)


def merge_authors(authors: DataFrame, into: DataFrame) -> DataFrame:
    """Authors with sources folded into targets (source_id, target_id, score): set unions, confidence min(target's, 0.95 x score's smallest)."""
    sources = authors.join(into, F.col("author_id") == F.col("source_id")).select(F.col("target_id"), F.col("score"), *[F.col(c) for c in authors.columns])
    sets = ("alternate_names", "journals", "affiliations", "linked_records", "coauthors")
    got = sources.groupBy(F.col("target_id").alias("author_id")).agg(F.min("score").alias("_s"), *[F.array_distinct(F.flatten(F.collect_set(c))).alias(f"_{c}") for c in sets])
    kept = authors.join(into.select(F.col("source_id").alias("author_id")), "author_id", "left_anti").join(got, "author_id", "left")
    out = kept.withColumns({c: as_set(F.col(c), F.col(f"_{c}")) for c in sets})
    return out.withColumn("confidence_score", F.when(F.col("_s").isNull(), F.col("confidence_score")).otherwise(F.least(F.col("confidence_score"), F.col("_s") * 0.95))).select(*authors.columns)


def remove(authors: DataFrame, ids: DataFrame) -> DataFrame:
    return authors.join(ids, "author_id", "left_anti")


def find_by_orcid(authors: DataFrame, orcid: str) -> DataFrame:
    """The author last inserted with an ORCID."""
    return authors.where(T.clean_orcid("orcid") == T.clean_orcid(F.lit(orcid))).orderBy(F.desc("seq")).limit(1)


def search(authors: DataFrame, name: str) -> DataFrame:
    """Authors with a surname."""
    return authors.where(F.lower(T.surname("canonical_name")) == name.lower())


def stats(authors: DataFrame) -> DataFrame:
    """total, with_orcid, unique_surnames, avg_records: one row."""
    return authors.agg(F.count("*").alias("total"), F.count_if(T.text("orcid") != "").alias("with_orcid"), F.count_distinct(F.nullif(F.lower(T.surname("canonical_name")), F.lit(""))).alias("unique_surnames"), F.avg(F.size("linked_records")).alias("avg_records"))


def validate(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected with a reason): needs an id and a non-blank name, and must not be processed before."""
    why = F.when(T.text("record_id") == "", "missing record_id").when(F.trim(T.text("name")) == "", "blank name").when(F.coalesce("processed", F.lit(False)), "already processed")
    marked = records.withColumn("reason", why)
    return marked.where("reason IS NULL").drop("reason"), marked.where("reason IS NOT NULL")


def with_record_ids(records: DataFrame) -> DataFrame:
    """Records with blank ids replaced by ones derived from the row."""
    made = F.concat(F.lit("rec_"), F.substring(F.sha2(F.to_json(F.struct(*[c for c in records.columns if c != "record_id"])), 256), 1, ID_DIGITS))
    return records.withColumn("record_id", T.either("record_id", made))
