"""Candidate authors by blocking keys: an equi-join of exploded keys, capped.

Authors: author_id, canonical_name, orcid, affiliations, journals, seq.
Mentions: mention_id, name, orcid, affiliations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import storage
from ..config import AFFILIATION_BUCKET, MAX_CANDIDATES
from ..functions import text as T


def _key(kind: str, value: Column) -> Column:
    return F.when(value != "", F.concat(F.lit(kind + ":"), value))


def author_keys(authors: DataFrame, with_journals: bool = True) -> DataFrame:
    """author_id, seq, key: ORCID, surname, surname with initial, first two affiliations and first three journals (sorted)."""
    name = F.col("canonical_name")
    first = lambda c, n: F.slice(F.array_sort(F.array_distinct(F.coalesce(F.col(c), F.array().cast("array<string>")))), 1, n)
    keys = [F.array(_key("orcid", T.clean_orcid("orcid")), _key("surname", F.lower(T.surname(name))), _key("surname_init", T.surname_initial(name))), F.transform(first("affiliations", 2), lambda x: _key("affil", T.block_string(x)))]
    if with_journals:
        keys.append(F.transform(first("journals", 3), lambda x: _key("journal", T.block_string(x))))
    return authors.select("author_id", "seq", F.explode(F.array_distinct(F.array_compact(F.concat(*keys)))).alias("key"))


def probed_keys() -> Column:
    """A mention's probed keys, sorted: ORCID, surname, surname with initial, first affiliation."""
    name = F.col("name")
    affiliation = F.coalesce(F.try_element_at("affiliations", F.lit(1)), F.lit(""))
    keys = F.array(_key("orcid", T.clean_orcid("orcid")), _key("surname", F.lower(T.surname(name))), _key("surname_init", T.surname_initial(name)), _key("affil", T.block_string(affiliation)))
    return F.array_sort(F.array_distinct(F.array_compact(keys)))


def mention_keys(mentions: DataFrame) -> DataFrame:
    """mention_id, key."""
    return mentions.select("mention_id", F.explode(probed_keys()).alias("key"))


def _capped(authors: DataFrame, most: int, affiliation_bucket: int) -> DataFrame:
    """author_id, key: the first ``most`` of a key's authors by id, of an affiliation's the first ``affiliation_bucket`` by insertion."""
    keys = author_keys(authors, with_journals=False)
    is_affil = F.col("key").startswith("affil:")
    by_seq = Window.partitionBy("key").orderBy("seq", "author_id")
    by_id = Window.partitionBy("key").orderBy("author_id")
    affil = keys.where(is_affil).withColumn("r", F.row_number().over(by_seq)).where(F.col("r") <= affiliation_bucket)
    rest = keys.where(~is_affil).withColumn("r", F.row_number().over(by_id)).where(F.col("r") <= most)
    return affil.union(rest).select("author_id", "key")


def candidate_lists(mentions: DataFrame, authors: DataFrame, most: int = MAX_CANDIDATES, affiliation_bucket: int = AFFILIATION_BUCKET) -> DataFrame:
    """mention_id (one row each), ids: the first ``most`` by author_id of all authors that share a probed key.

    A key's authors beyond the first ``most`` by id can never be among a
    mention's, so each key is cut before the join (affiliation keys to their
    first ``affiliation_bucket`` by insertion first): a hot key costs a
    mention no more than ``most`` ids. Mentions with equal sets of keys besides the
    ORCID share one lookup, and lists are joined last, so that no list is
    dealt out for each mention. Mentions without a candidate have no row.
    """
    capped = _capped(authors, most, affiliation_bucket).groupBy("key").agg(F.collect_list("author_id").alias("ids"))  # at most ``most`` a key
    is_orcid = F.col("key").startswith("orcid:")
    keys = F.filter(probed_keys(), lambda k: ~k.startswith("orcid:"))
    # a key set is named by 128 bits of its hash: quicker to group and join by than arrays
    named = mentions.select("mention_id", keys.alias("keys"), _key("orcid", T.clean_orcid("orcid")).alias("orcid")).select("mention_id", "orcid", "keys", F.xxhash64("keys").alias("s1"), F.xxhash64(F.lit(1), "keys").alias("s2"))
    sets = named.groupBy("s1", "s2").agg(F.first("keys").alias("keys"))
    met = sets.select("s1", "s2", F.explode("keys").alias("key")).join(capped.where(~is_orcid), "key")
    found = met.groupBy("s1", "s2").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, most).alias("ids"))  # three keys a set
    # mentions without an ORCID are spread by their id
    own = capped.where(is_orcid).select(F.col("key").alias("orcid"), F.col("ids").alias("own"))
    probed = named.select("mention_id", "s1", "s2", F.coalesce("orcid", F.xxhash64("mention_id").cast("string")).alias("orcid")).join(own, "orcid", "left")
    none = F.array().cast("array<string>")
    both = F.when(F.col("own").isNull(), F.col("ids")).otherwise(F.slice(F.array_sort(F.array_union(F.coalesce("ids", none), F.col("own"))), 1, most))
    return probed.select("mention_id", "s1", "s2", "own").join(found, ["s1", "s2"], "left").select("mention_id", both.alias("ids")).where(F.size("ids") > 0)


#: Kinds of probed keys, in the order in which a pair that shares several is met.
KINDS = ("orcid", "surname", "surname_init", "affil")


def meetings(mentions: DataFrame, authors: DataFrame, m: DataFrame, a: DataFrame, most: int = MAX_CANDIDATES, affiliation_bucket: int = AFFILIATION_BUCKET) -> tuple[DataFrame, DataFrame, Column]:
    """Both sides of an equi-join on ``key`` whose pairs, where the condition holds, are those of ``candidates``, each once.

    Left: the rows ``m`` (by mention_id) for each key and the mention's last
    candidate, right: ``a`` (by author_id) for each key. A pair is met at the first of
    KINDS that it shares; an author beyond the last of a full list is none of
    the mention's candidates. So neither lists nor pairs are dealt out.
    """
    capped = storage.cut(_capped(authors, most, affiliation_bucket), "capped")
    lists = candidate_lists(mentions, authors, most, affiliation_bucket)
    last = storage.cut(lists.select("mention_id", F.when(F.size("ids") >= most, F.element_at("ids", most)).alias("last")), "lists")
    keyed = mentions.select("mention_id", probed_keys().alias("keys"))
    of = lambda kind: F.get(F.filter("keys", lambda k: F.substring_index(k, ":", 1) == kind), 0)
    left = storage.cut(m.join(keyed.join(last, "mention_id"), "mention_id"), "probed")
    left = left.select("*", *[F.xxhash64(of(k)).alias(f"probed_{k}") for k in KINDS[:3]], F.explode("keys").alias("key")).drop("keys")
    filed = capped.groupBy("author_id").agg(F.collect_list("key").alias("keys"), *[F.max(F.when(F.col("key").startswith(k + ":"), F.xxhash64("key"))).alias(f"filed_{k}") for k in KINDS[:3]])
    right = storage.cut(a.join(filed, "author_id"), "filed").select("*", F.explode("keys").alias("key")).drop("keys")
    storage.discard(capped, last)
    met = F.col("last").isNull() | (F.col("author_id") <= F.col("last"))
    for i, k in enumerate(KINDS[:3]):
        earlier = F.substring_index("key", ":", 1).isin(*KINDS[: i + 1])
        met = met & (earlier | F.coalesce(F.col(f"probed_{k}") != F.col(f"filed_{k}"), F.lit(True)))
    return left, right, met


def candidates(mentions: DataFrame, authors: DataFrame, most: int = MAX_CANDIDATES, affiliation_bucket: int = AFFILIATION_BUCKET) -> DataFrame:
    """mention_id, author_id pairs of ``candidate_lists``."""
    return candidate_lists(mentions, authors, most, affiliation_bucket).select("mention_id", F.explode("ids").alias("author_id"))


def reported_keys(name, orcid) -> Column:
    """Keys as decision reports spell them (other than the probed ones)."""
    surname = F.lower(T.surname(name))
    initial = F.upper(F.left(F.coalesce(F.try_element_at(T.tokens(name), F.lit(1)), F.lit("")), F.lit(1)))
    o = T.text(orcid)
    return F.array_compact(F.array(_key("orcid", o), _key("surname", surname), F.when((surname != "") & (F.size(T.tokens(name)) > 1), F.concat(F.lit("surname_initial:"), surname, F.lit("_"), initial))))
