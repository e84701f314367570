"""Readers: JSON, JSONL, CSV, text, YAML, nested articles, DOI lists and lookups. Schemas are explicit; nothing is inferred."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .. import schemas
from ..functions import text as T


def mentions_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Mentions, one JSON object a line; blank lines are skipped, missing strings are empty."""
    rows = spark.read.schema(schemas.MENTION).json(path)
    names = ("mention_id", "doi", "raw_name", "lastname", "firstname", "orcid", "affiliation", "venue", "year")
    return rows.withColumns({c: T.text(c) for c in names} | {"coauthors": F.coalesce("coauthors", F.array().cast("array<string>"))})


def clusters_json(spark: SparkSession, path: str) -> DataFrame:
    """cluster_id, mention_id from ``{"clusters": {...}}`` or the bare map."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "clusters map<string,array<string>>").alias("a"), F.from_json("value", "map<string,array<string>>", {"mode": "PERMISSIVE"}).alias("b"))
    return whole.select(F.explode(F.coalesce("a.clusters", "b")).alias("cluster_id", "ids")).select("cluster_id", F.explode("ids").alias("mention_id"))


def splits_json(spark: SparkSession, path: str) -> DataFrame:
    """orcid, split from ``{"splits": {name: {"orcids": [...]}}}``."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "splits map<string,struct<orcids:array<string>,mention_ids:array<string>>>").alias("x"))
    return whole.select(F.explode("x.splits").alias("split", "s")).select(F.explode("s.orcids").alias("orcid"), "split")


def author_dump(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Author rows with their place, from ``{"authors": [...]}`` or a bare list; ``limit`` counts places (a feature of the source)."""
    row = f"array<struct<{', '.join(f'{x.split()[0]}:{x.split()[1]}' for x in schemas.AUTHOR_DUMP.split(', '))}>>"
    whole = spark.read.text(path, wholetext=True).select(F.coalesce(F.from_json("value", f"authors {row}")["authors"], F.when(F.ltrim("value").startswith("["), F.from_json("value", row))).alias("a"))
    rows = whole.select(F.posexplode("a").alias("_original_index", "x")).select("_original_index", "x.*")
    return rows if limit is None else rows.where(F.col("_original_index") < limit)


def mentions_from_authors(dump: DataFrame) -> DataFrame:
    """Mentions of author rows; rows with a blank name go, their places stay counted."""
    return dump.where(F.trim(T.text("original_name")) != "").select(
        T.mention_id(T.text("doi"), F.col("_original_index"), T.text("original_name")).alias("mention_id"), T.text("doi").alias("doi"), T.text("original_name").alias("raw_name"),
        T.text("lastname").alias("lastname"), T.text("firstname").alias("firstname"), T.text("orcid").alias("orcid"), T.text("affiliation").alias("affiliation"), T.text("journal").alias("venue"), T.text("year").alias("year"),
        F.coalesce("coauthors", F.array().cast("array<string>")).alias("coauthors"), F.col("_original_index").cast("long").alias("_original_index"))


def publication_year(published: Column) -> Column:
    return F.try_element_at(F.try_element_at(published["date-parts"], F.lit(1)), F.lit(1))


def articles(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Nested articles flattened to doi, title, journal, year, authors."""
    raw = spark.read.schema(schemas.ARTICLE).option("multiLine", multi_line).json(path)
    return raw.select(T.normalize_doi("DOI").alias("doi"), F.coalesce(F.try_element_at("title", F.lit(1)), F.lit("")).alias("title"), F.coalesce(F.try_element_at(F.col("`container-title`"), F.lit(1)), F.lit("")).alias("journal"), publication_year(F.col("published")).alias("year"), F.coalesce("author", F.array().cast("array<struct<given:string,family:string,ORCID:string,sequence:string,affiliation:array<struct<name:string>>>>")).alias("authors"))


def article_mentions(rows: DataFrame) -> DataFrame:
    """A mention for each author of an article, with the other authors' names."""
    names = F.transform("authors", lambda a: T.full_name(a["given"], a["family"]))
    spread = rows.withColumn("names", names).select("doi", "journal", "year", "names", F.posexplode("authors").alias("position", "a"))
    name = T.full_name(F.col("a.given"), F.col("a.family"))
    return spread.select(T.mention_id(F.col("doi"), F.col("position"), name).alias("mention_id"), "doi", name.alias("name"), T.clean_orcid("a.ORCID").alias("orcid"), F.filter(F.transform(F.coalesce("a.affiliation", F.array().cast("array<struct<name:string>>")), lambda x: x["name"]), lambda x: x.isNotNull()).alias("affiliations"), F.filter(F.array("journal"), lambda x: x != "").alias("journals"), "year", F.filter("names", lambda n: n != name).alias("coauthors"), "position", T.text("a.sequence").alias("sequence"))


def metrics_csv(spark: SparkSession, path: str, numbers: tuple[str, ...]) -> DataFrame:
    """CSV with a header; the named columns as doubles where they parse."""
    rows = spark.read.option("header", True).csv(path)
    return rows.withColumns({c: F.col(c).try_cast("double") for c in numbers})


def doi_list(spark: SparkSession, path: str) -> DataFrame:
    """DOIs of a JSON list of strings, blanks left out."""
    whole = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", "array<string>")).alias("place", "doi"))
    return whole.select("place", T.normalize_doi("doi").alias("doi")).where("doi <> ''")


def id_list(spark: SparkSession, path: str) -> DataFrame:
    """Ids of a text file, one a line."""
    return spark.read.text(path).select(F.trim("value").alias("mention_id")).where("mention_id <> ''")


class _Part(InputPartition):
    def __init__(self, dois: list[str]):
        super().__init__(dois)


class DoiLookup(DataSource):
    """Batch source of article metadata by DOI (format ``doi_lookup``).

    ``options(dois="a,b", batch=50)``; a subclass gives ``fetch``, which maps a
    DOI to (title, journal, year) or None. The base class has no network: it
    finds nothing. Failed DOIs are left out, after ``retries`` further tries.
    """

    @classmethod
    def name(cls) -> str:
        return "doi_lookup"

    def schema(self) -> str:
        return "doi string, title string, journal string, year int"

    @staticmethod
    def fetch(doi: str):
        return None

    def reader(self, schema) -> DataSourceReader:
        return _DoiReader(self.options, self.fetch)


class _DoiReader(DataSourceReader):
    def __init__(self, options, fetch):
        self.dois = [d.strip() for d in options.get("dois", "").split(",") if d.strip()]
        self.batch, self.retries, self.fetch = int(options.get("batch", 50)), int(options.get("retries", 2)), fetch

    def partitions(self):
        return [_Part(self.dois[i : i + self.batch]) for i in range(0, len(self.dois), self.batch)] or [_Part([])]

    def read(self, partition):
        for doi in partition.value:
            for _ in range(1 + self.retries):
                try:
                    got = self.fetch(doi)
                except OSError:
                    continue
                if got:
                    yield (doi, *got)
                break


def batch_lookup(dois: DataFrame, fetch: Callable[[str], tuple | None], schema: str = "doi string, title string, journal string, year int") -> DataFrame:
    """Metadata of a table of DOIs through ``fetch``, by partition; failures are left out."""

    def run(batches):
        for pdf in batches:
            rows = [(d, *got) for d in pdf["doi"] if (got := fetch(d))]
            yield type(pdf)(rows, columns=[x.split()[0] for x in schema.split(", ")])

    return dois.select(T.normalize_doi("doi").alias("doi")).where("doi <> ''").distinct().mapInPandas(run, schema)
