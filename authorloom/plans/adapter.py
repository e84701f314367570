"""A bibliographic reading of the star-schema tables, in Spark and as SQL.

An order is an article, a line of it a mention, a part the person behind it.
Persons' surnames carry the part's size in letters, so that names are diverse.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import chinese


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mention_id, seq, doi, raw_name, firstname, lastname, orcid, affiliation, venue, year, coauthors, person."""
    t = lambda n: read(spark, sf_dir, n)
    joined = (
        t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long").alias("l_quantity"))
        .join(t("part").select("p_partkey", "p_name", "p_brand", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
        .join(t("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(t("nation").select("n_nationkey", "n_name"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(t("orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    )
    first, last = F.split_part("p_name", F.lit(" "), F.lit(1)), F.concat(F.split_part("p_name", F.lit(" "), F.lit(2)), F.translate(F.col("p_size").cast("string"), "0123456789", "abcdefghij"))
    rows = joined.select(
        F.substring(F.md5(F.concat_ws("_", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")])), 1, 12).alias("mention_id"),
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).cast("long").alias("seq"), F.col("l_orderkey").cast("string").alias("doi"), F.concat(first, F.lit(" "), last).alias("raw_name"), first.alias("firstname"), last.alias("lastname"),
        F.when(F.col("l_partkey") % 5 == 0, "").otherwise(F.concat(F.lit("0000-"), F.lpad(F.col("l_partkey").cast("string"), 12, "0"))).alias("orcid"),
        F.col("n_name").alias("affiliation"), F.col("p_brand").alias("venue"), F.year("o_orderdate").alias("year"), F.col("l_partkey").alias("person"),
        F.col("l_orderkey").alias("_order"))  # lines are dealt by it already to join the orders
    everyone = F.array_sort(F.collect_set("raw_name").over(Window.partitionBy("_order")))  # an order has a bounded number of lines
    return rows.withColumn("coauthors", F.array_remove(everyone, F.col("raw_name"))).drop("_order")


MENTION = """m0 AS (
  SELECT substr(md5(concat_ws('_', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT))), 1, 12) AS mention_id,
    CAST(l_orderkey * 100 + l_linenumber AS BIGINT) AS seq, CAST(l_orderkey AS VARCHAR) AS doi,
    split_part(p_name, ' ', 1) AS firstname,
    split_part(p_name, ' ', 2) || translate(CAST(p_size AS VARCHAR), '0123456789', 'abcdefghij') AS lastname,
    CASE WHEN l_partkey % 5 = 0 THEN '' ELSE '0000-' || lpad(CAST(l_partkey AS VARCHAR), 12, '0') END AS orcid,
    n_name AS affiliation, p_brand AS venue, year(o_orderdate) AS year, l_partkey AS person
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
    JOIN nation ON s_nationkey = n_nationkey JOIN orders ON l_orderkey = o_orderkey),
m1 AS (SELECT *, firstname || ' ' || lastname AS raw_name FROM m0),
everyone AS (SELECT doi, list_sort(list_distinct(list(raw_name))) AS names FROM m1 GROUP BY doi),
mention AS (SELECT m1.*, list_filter(names, lambda x: x <> raw_name) AS coauthors FROM m1 JOIN everyone USING (doi))"""


def probes(rows: DataFrame, blind: bool = True) -> DataFrame:
    """Mentions as the merger takes them; without ORCIDs if blind."""
    return rows.select("mention_id", "seq", F.col("raw_name").alias("name"), (F.lit("") if blind else F.col("orcid")).alias("orcid"), "coauthors", F.array("venue").alias("journals"), F.array("affiliation").alias("affiliations"), F.col("person").alias("true_id"))


def authors(rows: DataFrame) -> DataFrame:
    """An author for each person, with the sets of all its mentions."""
    got = rows.groupBy("person").agg(F.min("raw_name").alias("canonical_name"), F.min("orcid").alias("orcid"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("coauthors")))).alias("coauthors"), F.array_sort(F.collect_set("venue")).alias("journals"), F.array_sort(F.collect_set("affiliation")).alias("affiliations"))
    return got.select(F.concat(F.lit("au_"), F.lpad(F.col("person").cast("string"), 10, "0")).alias("author_id"), "canonical_name", "orcid", "coauthors", "journals", "affiliations", F.array("canonical_name").alias("alternate_names"), F.col("person").alias("seq"))


AUTHOR = """author AS (
  SELECT 'au_' || lpad(CAST(person AS VARCHAR), 10, '0') AS author_id, min(raw_name) AS canonical_name, min(orcid) AS orcid,
    list_sort(list_distinct(flatten(list(coauthors)))) AS coauthors, list_sort(list_distinct(list(venue))) AS journals,
    list_sort(list_distinct(list(affiliation))) AS affiliations, person AS seq
  FROM mention GROUP BY person)"""


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, doi, title: documents; the first line is the title, and some have a DOI that several share."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    doi = F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.concat(F.lit("https://doi.org/10.1/"), (F.col("doc_id") % 4001).cast("string"), F.lit("."), F.col("n_chars").cast("string")))
    return docs.select(F.col("doc_id").alias("seq"), doi.alias("doi"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"))


ARTICLE = """article AS (
  SELECT doc_id AS seq, CASE WHEN doc_id % 3 = 0 THEN '' ELSE '10.1/' || (doc_id % 4001) || '.' || n_chars END AS doi,
    split_part(text, chr(10), 1) AS raw_title,
    array_to_string(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(split_part(text, chr(10), 1)), '[^\\p{L}\\p{N}_\\s]', '', 'g'), '\\s+', ' ', 'g')), ' '),
      lambda w: w <> '' AND w NOT IN ('a','an','the','of','in','on','at','to','for','with','by','from')), ' ') AS title
  FROM documents)"""


def chinese_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions with romanised Chinese and other names, from customers."""
    rows = read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    surnames = F.array(*[F.lit(x) for x in (*chinese.SURNAMES[:30], "smith", "garcia", "brown")])
    given = F.array(*[F.lit(x) for x in ("xiaoming", "wei", "jian-ming", "hui", "l", "maria")])
    k = F.col("c_custkey")
    last, first = F.element_at(surnames, (k % 33 + 1).cast("int")), F.element_at(given, (F.floor(k / 33) % 6 + 1).cast("int"))
    return rows.select(F.substring(F.md5(k.cast("string")), 1, 12).alias("mention_id"), k.alias("_original_index"), F.concat(last, F.lit(" "), first).alias("raw_name"), F.lit("").alias("lastname"), F.lit("").alias("firstname"), F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("o"), (k % 1009).cast("string"))).alias("orcid"), F.col("c_mktsegment").alias("affiliation"))


def chinese_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as the merger takes them: four successive ones write together, a segment is both the affiliation and the journal."""
    rows = chinese_mentions(spark, sf_dir).withColumn("together", F.floor(F.col("_original_index") / 4))
    everyone = F.array_sort(F.collect_set("raw_name").over(Window.partitionBy("together")))  # of four rows
    rows = rows.withColumn("coauthors", F.array_remove(everyone, F.col("raw_name")))
    return rows.select("mention_id", F.col("_original_index").alias("seq"), F.col("raw_name").alias("name"), "orcid", "coauthors", F.array("affiliation").alias("journals"), F.array("affiliation").alias("affiliations"))


CHINESE = """cn_mention AS (
  SELECT substr(md5(CAST(c_custkey AS VARCHAR)), 1, 12) AS mention_id, c_custkey AS _original_index,
    [{surnames}][c_custkey % 33 + 1] || ' ' || ['xiaoming','wei','jian-ming','hui','l','maria'][(c_custkey // 33) % 6 + 1] AS raw_name,
    CASE WHEN c_custkey % 4 = 0 THEN '' ELSE 'o' || (c_custkey % 1009) END AS orcid
  FROM customer)""".format(surnames=",".join(f"'{x}'" for x in (*chinese.SURNAMES[:30], "smith", "garcia", "brown")))
