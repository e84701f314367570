"""URL filtering against dated lists: a temporal as-of join.

List entries are events: at a time, a list adds or removes a pattern (a host
with all below it, or a host and path prefix). Each (list, pattern)'s events
become validity intervals [from, to). A capture is matched through every
suffix of its host and every prefix of its path (a hash join on the pattern)
with the entries that are active when it was fetched. Intervals are spread
over time buckets of ``BUCKET_DAYS`` days, clipped to the captures' own span,
so that a much-changed pattern does not meet captures of other times.

Per list the longest pattern decides; allowing lists come before blocking ones.

Defined results: a null or unparsable URL, or a null time, matches nothing and
is kept with action ``none``; events without a time, list or pattern are
ignored; of events of one moment removal comes last (it wins); repeated events
change nothing; a capture is a key, a URL and a time, so captures of one key at
several times are judged each at its own; repeated captures get repeated equal
rows; a null key is kept; very long URLs are taken whole; empty tables give
no matches or no rows; further columns of either table are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import sized

BUCKET_DAYS = 32
#: Suffixes of a host and prefixes of a path are all tried; these bound only the parsing pattern.
_HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)"
_PATH = r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)"


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _HOST, 1))


def keys_of(url: Column) -> Column:
    """All patterns that would match a URL: host suffixes, and host with path prefixes."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    steps = F.filter(F.split(F.regexp_extract(url, _PATH, 1), "/"), lambda x: x != "")
    prefixes = F.when(F.size(steps) > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.size(steps), F.lit(1))), lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(steps, F.lit(1), i), "/")))).otherwise(F.array().cast("array<string>"))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(suffixes, prefixes)))


def intervals(events: DataFrame) -> DataFrame:
    """(list, action, pattern, from_ts, to_ts) from (list, action, pattern, added, ts); to_ts null while active."""
    known = events.where("list IS NOT NULL AND pattern IS NOT NULL AND ts IS NOT NULL AND added IS NOT NULL")
    # one state a moment: removal wins
    states = known.groupBy("list", "pattern", "ts").agg(F.min("added").alias("added"), F.min("action").alias("action"))
    w = Window.partitionBy("list", "pattern").orderBy("ts")
    return states.withColumn("to_ts", F.lead("ts").over(w)).where("added").select("list", "action", "pattern", F.col("ts").alias("from_ts"), "to_ts")


def _bucket(ts: Column) -> Column:
    return F.floor(F.unix_seconds(ts) / (BUCKET_DAYS * 86400)).cast("long")


def _url_hashes(url: Column, *names: str) -> list[Column]:
    first, second = names or ("h1", "h2")
    return [F.xxhash64(url).alias(first), F.xxhash64(F.lit(1), url).alias(second)]


def matches(captures: DataFrame, events: DataFrame, key: str = "page_id", url: str = "url", ts: str = "fetch_ts") -> DataFrame:
    """(key, ts, h1, h2, list, action, pattern): the longest active pattern of each list for each capture (key, time and hashes of the URL)."""
    rows = captures.select(F.col(key).alias("_k"), F.col(url).alias("_u"), F.col(ts).alias("_ts"), *_url_hashes(F.col(url))).where("_ts IS NOT NULL").distinct()
    span = rows.agg(_bucket(F.min("_ts")).alias("lo"), _bucket(F.max("_ts")).alias("hi")).first()
    probes = rows.select("_k", "_ts", "h1", "h2", _bucket(F.col("_ts")).alias("_b"), F.explode(keys_of(F.col("_u"))).alias("pattern"))
    lo, hi = (span["lo"] or 0, span["hi"] if span["hi"] is not None else -1)
    first, last = F.greatest(_bucket(F.col("from_ts")), F.lit(lo)), F.least(F.coalesce(_bucket(F.col("to_ts")), F.lit(hi)), F.lit(hi))
    valid = intervals(events).where(first <= last).withColumn("_b", F.explode(F.sequence(first, last)))
    met = probes.join(valid, ["pattern", "_b"]).where("_ts >= from_ts AND (to_ts IS NULL OR _ts < to_ts)")
    best = met.groupBy("_k", "_ts", "h1", "h2", "list").agg(F.max(F.struct(F.length("pattern").alias("n"), "pattern", "action")).alias("m"))
    return best.select(F.col("_k").alias(key), F.col("_ts").alias(ts), "h1", "h2", "list", "m.action", "m.pattern")


def filter_urls(captures: DataFrame, events: DataFrame, key: str = "page_id", url: str = "url", ts: str = "fetch_ts") -> DataFrame:
    """(key, host, action, n_lists, pattern): a row for each capture; action is allow, block or none."""
    found = matches(captures, events, key, url, ts).groupBy(F.col(key).alias("_k"), F.col(ts).alias("_ts"), "h1", "h2").agg(
        F.min("action").alias("_action"), F.count("*").alias("_n"), F.min(F.struct("action", "list", "pattern")).alias("_m"))  # "allow" sorts before "block"
    rows = captures.select(F.col(key).alias("_key"), F.col(ts).alias("_at"), F.coalesce(host_of(F.col(url)), F.lit("")).alias("host"), *_url_hashes(F.col(url), "u1", "u2"))
    same = F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_at") == F.col("_ts")) & (F.col("u1") == F.col("h1")) & (F.col("u2") == F.col("h2"))
    out = rows.join(found, same, "left").select(F.col("_key").alias(key), "host", F.coalesce("_action", F.lit("none")).alias("action"), F.coalesce("_n", F.lit(0)).alias("n_lists"), F.col("_m.pattern").alias("pattern"))
    return sized(out, captures.count())
