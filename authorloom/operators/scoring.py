"""Comparison vectors, bins, scores and three-way decisions.

Pairs carry the mention's columns as ``m_*`` and the author's as ``a_*`` (name,
orcid, coauthors, journals, affiliations).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import storage
from ..config import ACCEPT, BINS, MU, REJECT, SIMILARITY_THRESHOLD, WEIGHTS
from ..functions import similarity as S
from ..functions import text as T
from . import blocking


def _hashed(c: Column) -> Column:
    """A set as 64-bit hashes of its normalised members: smaller to shuffle and quicker to intersect than strings."""
    return F.transform(S.normal_set(c), lambda x: F.xxhash64(x))


def prepare(rows: DataFrame, prefix: str, key: str, *carried: str) -> DataFrame:
    """key and normalised features of mentions or authors, once a row instead of once a pair."""
    empty = F.array().cast("array<string>")
    return rows.select(
        key,
        *carried,
        F.col("name").alias(f"{prefix}_name"),
        S.normalize_name("name").alias(f"{prefix}_norm"),
        T.clean_orcid("orcid").alias(f"{prefix}_orcid"),
        _hashed(F.col("coauthors")).alias(f"{prefix}_coauthors"),
        _hashed(F.col("journals")).alias(f"{prefix}_journals"),
        F.array_distinct(F.transform(F.coalesce("affiliations", empty), S.normalize_affiliation)).alias(f"{prefix}_affiliations"),
    )


def binned(feature: str, sim: Column) -> Column:
    """The bin of a similarity: the first whose lowest value it reaches, ``low`` above 0, else ``none``."""
    out = None
    for name, least in BINS[feature]:
        out = F.when(sim >= least, name) if out is None else out.when(sim >= least, name)
    return out.when(sim > 0, "low").otherwise("none")


def configured_bin(sim: Column, bins: list[dict]) -> Column:
    """The first configured bin that holds a value; both ends count."""
    out = F.lit(None).cast("string")
    for b in reversed(bins):
        if "max_diff" in b:
            hit = sim <= b["max_diff"]
        elif "value" in b:
            hit = sim == F.lit(b["value"])
        else:
            hit = (sim >= b["min"]) & (sim <= b["max"])
        out = F.when(hit, b["name"]).otherwise(out)
    return out


def _with_overlaps(pairs: DataFrame, sets: tuple[str, ...] = ("coauthors", "journals")) -> DataFrame:
    """Sizes of common parts in a projection of their own, so that each intersection is computed once; the smaller side is hashed."""
    return pairs.select("*", *[F.size(F.array_intersect(f"a_{c}", f"m_{c}")).alias(f"_{c}") for c in sets])


def _jaccard(c: str, both_empty: float) -> Column:
    m, a, shared = F.size(f"m_{c}"), F.size(f"a_{c}"), F.col(f"_{c}")
    return F.when((m == 0) & (a == 0), both_empty).when((m == 0) | (a == 0), 0.0).otherwise(shared / (m + a - shared))


def compare(pairs: DataFrame) -> DataFrame:
    """Pairs with similarities and bins; an empty side gives 0 and ``none``."""
    bare = (T.text("m_name") == "") | (T.text("a_name") == "")
    orcid = (F.col("m_orcid") != "") & (F.col("m_orcid") == F.col("a_orcid"))
    out = _with_overlaps(pairs).select(
        *[c for c in ("mention_id", "author_id", "key", "copies") if c in pairs.columns],
        S.name_ratio(F.col("m_norm"), F.col("a_norm"), bare).alias("name_sim"),
        orcid.alias("orcid_match"),
        _jaccard("coauthors", 0.0).alias("coauthor_sim"),
        _jaccard("journals", 0.0).alias("journal_sim"),
        S.affiliation_ratio(F.col("m_affiliations"), F.col("a_affiliations")).alias("affiliation_sim"),
    )
    bins = {f"{f}_bin": binned(f, F.col(f"{f}_sim")) for f in ("name", "coauthor", "journal", "affiliation")}
    return out.withColumns(bins | {"orcid_bin": F.when(F.col("orcid_match"), "match").otherwise("missing")})


def weighted(weights: dict[str, float] = WEIGHTS) -> Column:
    """Weighted sum of name, coauthor and journal similarity, in that order."""
    return F.col("name_sim") * weights["name"] + F.col("coauthor_sim") * weights["coauthors"] + F.col("journal_sim") * weights["journals"]


def log_ratio(m: float, u: float) -> float:
    """ln(m / u) with 1e-10 for a zero; 0 if both are."""
    if u == 0:
        return math.log(m / 1e-10) if m else 0.0
    return math.log((m or 1e-10) / u)


def fellegi_sunter(mu: dict = MU, features: tuple[str, ...] = ("name", "orcid", "coauthor", "journal", "affiliation")) -> Column:
    """Sum of ln(m / u) over the bins; features and bins that the table lacks add nothing."""
    total = F.lit(0.0)
    for feature in features:
        part = F.lit(0.0)
        for name, (m, u) in mu.get(feature, {}).items():
            part = F.when(F.col(f"{feature}_bin") == name, log_ratio(m, u)).otherwise(part)
        total = total + part
    return total


def legacy_similarity(weights: dict[str, float] = WEIGHTS) -> Column:
    """Score of the single-threshold engine over prepared pairs: two empty sets count as equal; weightless parts are left out."""
    bare = (T.text("m_name") == "") | (T.text("a_name") == "")
    parts = {
        "name": lambda: S.name_ratio(F.col("m_norm"), F.col("a_norm"), bare),
        "coauthors": lambda: S.set_jaccard(F.col("m_coauthors"), F.col("a_coauthors"), 1.0),
        "journals": lambda: S.set_jaccard(F.col("m_journals"), F.col("a_journals"), 1.0),
        "affiliations": lambda: S.set_jaccard(F.col("m_affiliations"), F.col("a_affiliations"), 1.0),
    }
    out = None
    for name, weight in weights.items():
        if weight > 0:
            part = parts[name]() * weight
            out = part if out is None else out + part
    return out if out is not None else F.lit(0.0)


def scored(compared: DataFrame, mode: str = "baseline", weights: dict = WEIGHTS, mu: dict = MU) -> DataFrame:
    """With a score, rounded to 9 places: sums that differ in their last bits only are ties."""
    return compared.withColumn("score", F.round(weighted(weights) if mode == "baseline" else fellegi_sunter(mu), 9))


def best(scores: DataFrame, k: int = 1) -> DataFrame:
    """The k best candidates of each mention: highest score, then smallest author_id."""
    for by in (["key", "mention_id"], ["mention_id"]):  # pairs met by key are dealt by it: their first choice needs no shuffle
        if set(by) <= set(scores.columns):
            w = Window.partitionBy(*by).orderBy(F.desc("score"), "author_id")
            scores = scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return scores


def tops(scores: DataFrame) -> DataFrame:
    """mention_id, author_id, score, n: the best candidate of each mention (as ``best``) and how many there are."""
    top = scores.groupBy("mention_id").agg(F.min_by(F.struct("author_id", "score"), F.struct((-F.col("score")).alias("s"), "author_id")).alias("top"), F.count("*").alias("n"))
    return top.select("mention_id", "top.author_id", "top.score", "n")


def decision(score: Column, accept: float = ACCEPT, reject: float = REJECT) -> Column:
    """merge, new or unknown; no candidate (null score) is new."""
    return F.when(score.isNull(), "new").when(score >= accept, "merge").when(score <= reject, "new").otherwise("unknown")


def reason(score: Column, author: Column, accept: float = ACCEPT, reject: float = REJECT) -> Column:
    s = F.coalesce(score, F.lit(0.0))
    merge = F.format_string("Score %.3f >= accept_threshold " + str(accept) + ", merged with author %s", s, author)
    new = F.format_string("Score %.3f <= reject_threshold " + str(reject) + ", created new author", s)
    review = F.format_string("Score %.3f in uncertain range (" + f"{reject} < score < {accept}" + "), requires manual review", s)
    kind = decision(score, accept, reject)
    return F.when(kind == "merge", merge).when(kind == "new", new).otherwise(review)


def decide(mentions: DataFrame, scores: DataFrame, accept: float = ACCEPT, reject: float = REJECT) -> DataFrame:
    """mention_id, decision, score_total, best_author_id, candidate_count, reason: one row for each mention."""
    return decided(mentions.select("mention_id").join(tops(scores), "mention_id", "left"), accept, reject)


def decided(rows: DataFrame, accept: float = ACCEPT, reject: float = REJECT) -> DataFrame:
    """``decide`` of mentions with their ``tops`` (nulls without a candidate)."""
    score, author = F.col("score"), F.col("author_id")
    kind = decision(score, accept, reject)
    return rows.select("mention_id", kind.alias("decision"), F.coalesce(score, F.lit(0.0)).alias("score_total"), F.when(kind == "merge", author).alias("best_author_id"), F.coalesce("n", F.lit(0)).alias("candidate_count"), reason(score, author, accept, reject).alias("reason"))


def legacy_decision(score: Column, threshold: float = SIMILARITY_THRESHOLD) -> Column:
    return F.when(score >= threshold, "merged").otherwise("new_author")


def pairs_of(mentions: DataFrame, authors: DataFrame, lists: DataFrame) -> DataFrame:
    """Candidate pairs with both sides' prepared features, from (mention_id, ids).

    Features join the lists before these are spread, so pairs are shuffled once:
    mentions' few features travel to the authors' many, which are hashed by
    their unique id, and only scores travel on.
    """
    m = prepare(mentions, "m", "mention_id")
    a = prepare(authors.withColumnRenamed("canonical_name", "name"), "a", "author_id")
    spread = m.join(lists, "mention_id").select(*m.columns, F.explode("ids").alias("author_id"))
    return spread.join(a.hint("shuffle_hash"), "author_id")


def profiles(mentions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mentions with their ``profile``, and the distinct profiles, as mentions of that id with the number of their ``copies``.

    A profile is all that a score depends on, named by 128 bits of its hash:
    mentions that do not differ in it are scored once.
    """
    named = mentions.withColumn("profile", F.unhex(F.md5(F.to_json(F.struct(*FEATURES)))))
    distinct = named.groupBy(F.col("profile").alias("mention_id")).agg(*[F.first(c).alias(c) for c in FEATURES], F.count("*").alias("copies"))
    return named, distinct


#: What a mention is scored by.
FEATURES = ("name", "orcid", "coauthors", "journals", "affiliations")
#: Rows (a mention's key each) that a task of ``pairs_met`` pairs with their authors.
MET_ROWS = 20_000


def pairs_met(mentions: DataFrame, authors: DataFrame) -> DataFrame:
    """Candidate pairs with both sides' prepared features and the ``key`` they met by.

    Both sides are dealt by key (``blocking.meetings``) and pairs made where
    they meet, so that what is dealt out grows with mentions and authors and
    not with pairs.
    """
    carried = ["copies"] if "copies" in mentions.columns else []
    m = prepare(mentions, "m", "mention_id", *carried)
    a = prepare(authors.withColumnRenamed("canonical_name", "name"), "a", "author_id")
    left, right, met = blocking.meetings(mentions, authors, m, a)
    n = max(int(mentions.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-len(blocking.KINDS) * mentions.count() // MET_ROWS))
    left, right = left.repartition(n, "key"), right.repartition(n, "key")
    return left.join(right.hint("shuffle_hash"), "key").where(met)


def legacy_report(weights: dict[str, float] = WEIGHTS, threshold: float = SIMILARITY_THRESHOLD) -> Column:
    """A text report of a legacy decision over compared pairs with a score."""
    sims = {"name": "name_sim", "coauthors": "coauthor_sim", "journals": "journal_sim"}
    lines = [F.format_string("Record %s against author %s", "mention_id", "author_id")]
    lines += [F.format_string(f"  {k}: %.3f (weight {w:.1f})", sims[k]) for k, w in weights.items() if w > 0 and k in sims]
    lines.append(F.format_string(f"Total %.3f, threshold {threshold:.2f}: %s", "score", legacy_decision(F.col("score"), threshold)))
    return F.concat_ws("\n", *lines)


def decision_stats(decisions: DataFrame) -> DataFrame:
    """processed, merged, new, unknown, mean_score, candidates: one row."""
    of = lambda k: F.count_if(F.col("decision") == k).alias({"merge": "merged"}.get(k, k))
    return decisions.agg(F.count("*").alias("processed"), of("merge"), of("new"), of("unknown"), F.avg("score_total").alias("mean_score"), F.sum("candidate_count").alias("candidates"))
