"""Connected components by repeated contraction.

Every round hooks each node to the smallest-hashed of itself and its
neighbours and replaces edges by edges between the chosen nodes. A hash that
changes with the round makes the expected number of rounds logarithmic, also
for long chains. Neighbour minima are pre-aggregated before the shuffle, edges
are joined with a one-row-a-node table (a skewed join that can be split), and
each round is written to the shared folder. Nothing but a row count comes to
the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import storage


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """(a, b) long pairs -> (node, root): one row for each node of an edge.

    Self loops and repeated or reversed edges change nothing; null ends are
    ignored; no edges give no rows. ``rows``: about how many edges there are at
    most, if known. ``root`` is some node of the component,
    the same for all its nodes.
    """
    a, b = F.col("a"), F.col("b")
    now = storage.cut(edges.where("a <> b").select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct(), "edges", rows)
    steps = []
    while n := now.count():
        seed = F.lit(len(steps))
        both = now.union(now.select("b", "a"))
        rank = lambda c: F.struct(F.xxhash64(seed, c).alias("h"), c.alias("v"))
        hooks = both.groupBy("a").agg(F.min(rank(b)).alias("m")).select(a.alias("node"), F.least(F.col("m"), rank(a))["v"].alias("to"))
        hooks = storage.cut(hooks, "hooks", 2 * n)
        steps.append(hooks)
        left = hooks.select(F.col("node").alias("a"), F.col("to").alias("x"))
        right = hooks.select(F.col("node").alias("b"), F.col("to").alias("y"))
        new = now.join(left, "a").join(right, "b").where("x <> y")
        new = storage.cut(new.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges", n)
        storage.discard(now)
        now = new
    if not steps:
        return edges.select(a.alias("node"), a.alias("root")).limit(0)
    out = steps[-1].select("node", F.col("to").alias("root"))
    for earlier in reversed(steps[:-1]):  # a node that left in a round follows the one it was hooked to
        out = earlier.join(out.withColumnRenamed("node", "to"), "to", "left").select("node", F.coalesce("root", "to").alias("root"))
    return out
