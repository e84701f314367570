"""Baseline clusterings, gold clusters, cluster summaries and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import storage
from ..functions import chinese
from ..functions import text as T
from .components import components


def by_key(mentions: DataFrame, key: Column, prefix: str) -> DataFrame:
    """cluster_id, mention_id: mentions with a common key; blank keys are left out."""
    return mentions.select(F.concat(F.lit(prefix), key).alias("cluster_id"), "mention_id", key.alias("_k")).where("_k <> ''").drop("_k")


def fini(mentions: DataFrame) -> DataFrame:
    return by_key(mentions, T.fini_key("raw_name", "lastname", "firstname"), "fini:")


def aini(mentions: DataFrame) -> DataFrame:
    return by_key(mentions, T.aini_key("raw_name", "lastname", "firstname"), "aini:")


def oracle(mentions: DataFrame) -> DataFrame:
    """By ORCID; a mention without one is alone."""
    orcid = F.trim(T.text("orcid"))
    return mentions.select(F.when(orcid == "", F.concat(F.lit("unlabeled:"), "mention_id")).otherwise(F.concat(F.lit("orcid:"), orcid)).alias("cluster_id"), "mention_id")


def heuristic(mentions: DataFrame, least: float = 0.3) -> DataFrame:
    """FINI blocks, linked by affiliation similarity of ``least`` or if both have none.

    Mentions of a block with equal affiliations are linked anyway, so pairs are
    only made between a block's distinct affiliations.
    """
    rows = storage.cut(mentions.select("mention_id", T.heuristic_key("raw_name", "lastname", "firstname").alias("block"), T.text("affiliation").alias("aff")), "heuristic")
    nodes = rows.groupBy("block", "aff").agg(F.min("mention_id").alias("first"))
    # a pair within the bound shares a word: an equi-join on words, not a cross product of the block
    words = nodes.select("block", "aff", F.explode(T.affiliation_tokens("aff")).alias("w"))
    a, b = words.select("block", "w", F.col("aff").alias("x")), words.select("block", "w", F.col("aff").alias("y"))
    met = a.join(b, ["block", "w"]).where("x < y").select("block", "x", "y").distinct()
    from ..functions.similarity import token_jaccard

    linked = met.where(token_jaccard("x", "y") >= least)
    # affiliations without a usable word link to nothing but (if empty) themselves; equal ones do if they have words
    node_id = F.xxhash64("block", "aff")
    edges = linked.select(F.xxhash64("block", "x").alias("a"), F.xxhash64("block", "y").alias("b"))
    roots = components(edges)
    joined = rows.withColumn("node", node_id).join(roots, "node", "left")
    lonely = (F.col("aff") != "") & (F.size(T.affiliation_tokens("aff")) == 0)
    root = F.coalesce("root", "node")
    firsts = joined.where(~lonely).groupBy(root.alias("r")).agg(F.min("mention_id").alias("first"))
    grouped = joined.where(~lonely).withColumn("r", root).join(firsts, "r").select(F.concat(F.lit("old_heuristic:"), "first").alias("cluster_id"), "mention_id")
    return grouped.union(joined.where(lonely).select(F.concat(F.lit("old_heuristic:"), "mention_id"), "mention_id"))


def from_pairs(pairs: DataFrame, mentions: DataFrame) -> DataFrame:
    """Clusters of merged mention pairs (a, b): connected components named by their smallest mention; others alone."""
    ids = mentions.select("mention_id", F.xxhash64("mention_id").alias("node"))
    edges = pairs.select(F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b"))
    joined = ids.join(components(edges), "node", "left").select("mention_id", F.coalesce("root", "node").alias("root"))
    first = joined.groupBy("root").agg(F.min("mention_id").alias("first"))
    return joined.join(first, "root").select(F.concat(F.lit("cluster:"), "first").alias("cluster_id"), "mention_id")


def from_decisions(decisions: DataFrame, keep_unknown: bool = True) -> DataFrame:
    """Clusters of decisions (mention_id, decision, author_id, new_author_id)."""
    kind, author, new = F.lower("decision"), T.text("author_id"), T.text("new_author_id")
    cluster = (
        F.when((kind == "merge") & (author != ""), F.concat(F.lit("author:"), author))
        .when(kind == "new", F.concat(F.lit("new:"), T.either(new, F.col("mention_id"))))
        .when(kind == "unknown", F.concat(F.lit("unk:"), "mention_id"))
        .otherwise(F.concat(F.lit("other:"), "mention_id"))
    )
    rows = decisions if keep_unknown else decisions.where(kind != "unknown")
    return rows.select(cluster.alias("cluster_id"), "mention_id")


def greedy_chinese(mentions: DataFrame, order: str = "_original_index") -> DataFrame:
    """Greedy dual-key clusters of romanised Chinese names, FINI keys for the rest.

    A mention joins the cluster of its first key, else of its second, else
    opens one and registers both. That depends on order only within names whose
    keys are connected, so mentions with equal key pairs are first reduced to
    their earliest, and each connected set of keys is folded by itself.
    """
    one, two = chinese.dual_keys("raw_name", "lastname", "firstname")
    rows = mentions.select("mention_id", F.col(order).alias("seq"), chinese.is_romanized_chinese("raw_name").alias("cn"), one.alias("k1"), two.alias("k2"), T.heuristic_key("raw_name", "lastname", "firstname").alias("key"))
    rest = rows.where(~F.col("cn")).select(F.concat(F.lit("fini:"), "key").alias("cluster_id"), "mention_id")
    names = storage.cut(rows.where("cn").groupBy("k1", "k2").agg(F.min("seq").alias("seq")), "names")
    roots = components(names.select(F.xxhash64("k1").alias("a"), F.xxhash64("k2").alias("b")))
    parted = names.withColumn("node", F.xxhash64("k1")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))

    def fold(pdf):
        known: dict[str, str] = {}
        out = []
        for k1, k2 in pdf.sort_values("seq")[["k1", "k2"]].itertuples(index=False):
            if k1 in known:
                got = known[k1]
            elif k2 in known:
                got = known[k2]
            else:
                got = known[k1] = known[k2] = "cn_cluster:" + k1
            out.append((k1, k2, got))
        return type(pdf)(out, columns=["k1", "k2", "cluster_id"])

    from ..shipping import ship

    ship(mentions.sparkSession)
    folded = parted.groupBy("root").applyInPandas(fold, "k1 string, k2 string, cluster_id string")
    return rest.union(rows.where("cn").join(folded, ["k1", "k2"]).select("cluster_id", "mention_id"))


def summary(clusters: DataFrame) -> DataFrame:
    """num_clusters, num_mentions, avg_size, singletons, max_size."""
    sizes = clusters.groupBy("cluster_id").agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("num_clusters"), F.sum("n").alias("num_mentions"), F.avg("n").alias("avg_size"), F.count_if(F.col("n") == 1).alias("singletons"), F.max("n").alias("max_size"))


def gold(mentions: DataFrame, least: int = 2) -> DataFrame:
    """cluster_id (the ORCID), mention_id, for ORCIDs of at least ``least`` mentions."""
    labelled = mentions.select(F.trim(T.text("orcid")).alias("cluster_id"), "mention_id").where("cluster_id <> ''")
    enough = labelled.groupBy("cluster_id").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return labelled.join(enough.select("cluster_id"), "cluster_id", "left_semi")


def size_distribution(clusters: DataFrame) -> DataFrame:
    """bucket (1 to 5, 6-10, 11-20, 21+), clusters, mentions."""
    n = F.col("n")
    bucket = F.when(n <= 5, n.cast("string")).when(n <= 10, "6-10").when(n <= 20, "11-20").otherwise("21+")
    return clusters.groupBy("cluster_id").agg(F.count("*").alias("n")).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("clusters"), F.sum("n").alias("mentions"))


def gold_rollup(mentions: DataFrame, least: int = 2) -> DataFrame:
    """orcid, mention_count and distinct names, affiliations and venues of each gold ORCID."""
    orcid = F.trim(T.text("orcid"))
    distinct = lambda c: F.count_distinct(F.nullif(T.text(c), F.lit("")))
    return mentions.where(orcid != "").groupBy(orcid.alias("orcid")).agg(F.count("*").alias("mention_count"), distinct("raw_name").alias("names"), distinct("affiliation").alias("affiliations"), distinct("venue").alias("venues")).where(F.col("mention_count") >= least)


def split_by_orcid(mentions: DataFrame, share: float = 0.3, salt: str = "split") -> DataFrame:
    """orcid, split: the first ``share`` of ORCIDs in the order of a salted hash are dev, the rest test.

    Ranks come from counts by hash range, so no task orders all ORCIDs.
    """
    orcids = mentions.select(F.trim(T.text("orcid")).alias("orcid")).where("orcid <> ''").distinct().withColumn("h", F.md5(F.concat("orcid", F.lit(salt))))
    bucket = F.substring("h", 1, 3)
    sizes = orcids.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))  # 4096 rows at most
    running = sizes.select("bucket", (F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy(F.lit(1))).alias("total"))
    ranked = orcids.withColumn("bucket", bucket).join(F.broadcast(running), "bucket").withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy("bucket").orderBy("h", "orcid")))
    return ranked.select("orcid", F.when(F.col("rank") <= F.floor(F.col("total") * share), "dev").otherwise("test").alias("split"))


def init_eval(mentions: DataFrame, ratio: float = 0.5, order: Column | None = None) -> DataFrame:
    """mention_id, orcid, part: of each ORCID's mentions, the first max(1, floor(n x ratio)) in order are init, the rest eval."""
    rows = mentions.select("mention_id", F.trim(T.text("orcid")).alias("orcid"), (order if order is not None else F.md5("mention_id")).alias("h")).where("orcid <> ''")
    w = Window.partitionBy("orcid")
    rank = F.row_number().over(w.orderBy("h", "mention_id"))
    return rows.select("mention_id", "orcid", F.when(rank <= F.greatest(F.lit(1), F.floor(F.count("*").over(w) * ratio)), "init").otherwise("eval").alias("part"))
