"""The co-author graph as an edge table (src, dst, weight), src < dst."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import check_limit


def edges(links: DataFrame) -> DataFrame:
    """Accumulated weights of undirected links (a, b[, weight]); self loops and blanks are ignored."""
    weight = F.col("weight") if "weight" in links.columns else F.lit(1)
    real = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> '' AND b <> '' AND a <> b")
    return real.groupBy(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).agg(F.sum(weight).cast("long").alias("weight"))


def coauthor_links(papers: DataFrame) -> DataFrame:
    """(a, b) for each pair of distinct authors (author_id) of a paper (doi).

    Authors of one paper are gathered once and paired inside the row: a paper's
    pairs are the edges themselves, so this is the size of the output.
    """
    rows = papers.groupBy("doi").agg(F.array_sort(F.collect_set("author_id")).alias("ids"))
    pairs = F.flatten(F.transform("ids", lambda a, i: F.transform(F.slice(F.col("ids"), i + 2, F.size("ids")), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return rows.select(F.explode(pairs).alias("p")).select("p.a", "p.b")


def both_ways(graph: DataFrame) -> DataFrame:
    """(node, other, weight) in both directions."""
    return graph.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("other"), "weight"), F.struct(F.col("dst").alias("node"), F.col("src").alias("other"), "weight"))).alias("x")).select("x.*")


def degrees(graph: DataFrame) -> DataFrame:
    """node, degree, strength."""
    return both_ways(graph).groupBy("node").agg(F.count("*").alias("degree"), F.sum("weight").alias("strength"))


def stats(graph: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """nodes, edges, avg_degree (2 E / N): one row. ``nodes`` (column node) adds lonely ones."""
    ends = both_ways(graph).select("node")
    count = (ends if nodes is None else ends.union(nodes.select("node"))).distinct().agg(F.count("*").alias("nodes"))
    joined = count.crossJoin(graph.agg(F.count("*").alias("edges")))  # two tables of one row
    return joined.select("nodes", "edges", F.when(F.col("nodes") > 0, 2 * F.col("edges") / F.col("nodes")).otherwise(0.0).alias("avg_degree"))


def neighbours(graph: DataFrame, node: str) -> DataFrame:
    return both_ways(graph).where(F.col("node") == node).select("other", "weight")


def remove_nodes(graph: DataFrame, nodes: DataFrame) -> DataFrame:
    """The graph without the nodes (column node) and their edges."""
    gone = nodes.select("node").distinct()
    return graph.join(gone, graph["src"] == gone["node"], "left_anti").join(gone, F.col("dst") == gone["node"], "left_anti")


def k_hop(graph: DataFrame, starts: DataFrame, depth: int = 2) -> DataFrame:
    """(start, node): nodes within ``depth`` steps, the start included; starts outside the graph and depth 0 give none."""
    pairs = both_ways(graph).select("node", "other")
    known = pairs.select("node").distinct()
    if depth <= 0:
        return known.select(F.col("node").alias("start"), "node").limit(0)
    reached = starts.select(F.col("start").alias("node")).distinct().join(known, "node", "left_semi").select(F.col("node").alias("start"), "node")
    frontier = reached
    for _ in range(depth):
        step = frontier.join(pairs, "node").select("start", F.col("other").alias("node"))
        reached = reached.union(step).distinct()
        frontier = reached
    return reached


def strongest(graph: DataFrame, k: int) -> DataFrame:
    """The k heaviest edges."""
    return graph.orderBy(F.desc("weight"), "src", "dst").limit(k)


def affected_by_publication(graph: DataFrame, coauthors: DataFrame, depth: int = 2, most: int = 1000) -> DataFrame:
    """pub_id, node: a publication's authors (pub_id, author_id) and what lies within ``depth``; of more than ``most`` the strongest."""
    check_limit("most", most)
    reached = k_hop(graph, coauthors.select(F.col("author_id").alias("start")), depth)
    scope = coauthors.join(reached.withColumnRenamed("start", "author_id"), "author_id").select("pub_id", "node").union(coauthors.select("pub_id", F.col("author_id").alias("node"))).distinct()
    ranked = scope.join(degrees(graph), "node", "left").withColumn("r", F.row_number().over(Window.partitionBy("pub_id").orderBy(F.desc(F.coalesce("strength", F.lit(0))), "node")))
    return ranked.where(F.col("r") <= most).select("pub_id", "node")


def affected_by_record(authors: DataFrame, full_scan_threshold: int = 0) -> DataFrame:
    """All authors if there are any and at most ``full_scan_threshold``; else none."""
    n = authors.agg(F.count("*").alias("n"))
    return authors.select("author_id").crossJoin(n).where((F.col("n") > 0) & (F.col("n") <= full_scan_threshold)).select("author_id")  # one row


def _fold(c: Column) -> Column:
    return F.lower(F.trim(c))


def _known_as(authors: DataFrame) -> DataFrame:
    """author_id, names: the folded canonical and alternate names, distinct and in order."""
    names = F.concat(F.array("canonical_name"), F.coalesce("alternate_names", F.array().cast("array<string>")))
    return authors.select("author_id", F.array_sort(F.array_distinct(F.filter(F.transform(names, _fold), lambda x: x.isNotNull()))).alias("names"))


def coauthor_ids(records: DataFrame, authors: DataFrame) -> DataFrame:
    """record_id, author_id: authors whose canonical or alternate name equals a co-author's, ignoring case and outer blanks."""
    names = _known_as(authors).select("author_id", F.explode("names").alias("k"))
    asked = records.select("record_id", F.explode(F.array_distinct(F.transform("coauthors", _fold))).alias("k")).where("k <> ''")
    return asked.join(names, "k").select("record_id", "author_id").distinct()


def coauthor_counts(records: DataFrame, authors: DataFrame) -> DataFrame:
    """record_id, authors: how many authors ``coauthor_ids`` finds for a record, if any.

    Authors (author_id unique) of equal names are counted once for all records; a
    record meets each such class, not each author, and a class of several names only once.
    """
    classes = _known_as(authors).where(F.size("names") > 0).groupBy("names").agg(F.count("*").alias("n"))
    alone = classes.where(F.size("names") == 1).select(F.get("names", F.lit(0)).alias("k"), "n")
    several = classes.where(F.size("names") > 1).select("names", "n", F.explode("names").alias("k"))
    asked = records.select("record_id", F.explode(F.array_distinct(F.transform("coauthors", _fold))).alias("k")).where("k <> ''")
    one = asked.join(alone, "k").select("record_id", "n")
    more = asked.join(several, "k").groupBy("record_id", "names").agg(F.first("n").alias("n")).select("record_id", "n")
    return one.union(more).groupBy("record_id").agg(F.sum("n").alias("authors"))
