"""Order-dependent processing: exact ordered folds, and scalable snapshots.

``replay`` runs the three-way merger over ordered mentions exactly. A mention
only meets authors with which it shares a probed key, and every author comes
from a mention, so connected sets of keys are independent: one fold each.
Mentions of one set that all share everything are unavoidable sequential work;
``snapshot`` is the scalable way: each batch sees the authors of earlier ones.

``legacy_replay`` runs the single-threshold engine, whose every record meets
every author: one fold, for small inputs.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import uuid

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import storage
from ..config import ACCEPT, AFFILIATION_BUCKET, MAX_AFFECTED, MAX_CANDIDATES, REJECT, SIMILARITY_THRESHOLD, WEIGHTS
from ..functions import similarity as S
from ..functions import text as T
from ..shipping import ship
from . import blocking
from .authors import ID_DIGITS
from .components import components


def levenshtein(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def name_ratio(a: str, b: str) -> float:
    """Of normalised names."""
    if a == b:
        return 1.0
    return max(0.0, 1.0 - levenshtein(a, b) / max(len(a), len(b)))


def set_ratio(a: frozenset, b: frozenset, both_empty: float) -> float:
    if not a and not b:
        return both_empty
    return len(a & b) / len(a | b) if a and b else 0.0


def _normal(mentions: DataFrame) -> DataFrame:
    """What a fold needs, normalised by Spark expressions."""
    return mentions.select(
        "mention_id", "seq", F.col("name"), S.normalize_name("name").alias("norm"), T.clean_orcid("orcid").alias("orcid"),
        S.normal_set(F.col("coauthors")).alias("coauthors"), S.normal_set(F.col("journals")).alias("journals"), "affiliations",
        F.lower(T.surname("name")).alias("surname"), T.surname_initial("name").alias("initial"), F.transform(F.coalesce("affiliations", F.array().cast("array<string>")), T.block_string).alias("blocks"))


_DECIDED = "mention_id string, seq long, decision string, score_total double, best_author_id string, candidate_count long, author_id string"


class _Fold:
    """The authors of one connected set of keys and the decision on its next mention.

    Of a key's authors only the first ``most`` by id can be candidates, of an affiliation's
    the first ``bucket`` by insertion, so no list is longer. A score is kept for all
    mentions of equal features until its author changes.
    """

    def __init__(self, accept: float, reject: float, weights: dict, most: int, bucket: int):
        self.accept, self.reject, self.weights, self.most, self.bucket = accept, reject, weights, most, bucket
        self.authors: dict[str, dict] = {}
        self.index: dict[str, list[str]] = {}  # sorted by id; of affiliations in order of insertion
        self.scores: dict[tuple, dict[str, tuple[int, float]]] = {}  # of mentions' features: author -> (its version, score)
        self.held = 0  # how many scores
        self.names: dict[tuple[str, str], float] = {}

    def file(self, a: dict) -> None:
        keys = [f"orcid:{a['orcid']}"] * bool(a["orcid"]) + [f"surname:{a['surname']}"] * bool(a["surname"]) + [f"surname_init:{a['initial']}"] * bool(a["initial"])
        i = a["id"]
        for k in keys:
            ids = self.index.setdefault(k, [])
            if len(ids) < self.most or i < ids[-1]:
                at = bisect.bisect_left(ids, i)
                if at == len(ids) or ids[at] != i:
                    ids.insert(at, i)
                    del ids[self.most :]
        for x in sorted(a["blocks"])[:2]:
            if x and len(ids := self.index.setdefault(f"affil:{x}", [])) < self.bucket and i not in ids:
                ids.append(i)

    def name(self, a: str, b: str) -> float:
        if len(self.names) > _KNOWN:
            self.names.clear()
        if (got := self.names.get((a, b))) is None:
            got = self.names[a, b] = name_ratio(a, b)
        return got

    def score(self, r, a: dict, co: frozenset, jo: frozenset) -> float:
        name = 0.0 if not r.name or not a["name"] else self.name(r.norm, a["norm"])
        return name * self.weights["name"] + set_ratio(co, a["coauthors"], 0.0) * self.weights["coauthors"] + set_ratio(jo, a["journals"], 0.0) * self.weights["journals"]

    def decide(self, r) -> tuple:
        first = r.blocks[0] if len(r.blocks) else ""
        found = set()
        for kind, value in (("orcid", r.orcid), ("surname", r.surname), ("surname_init", r.initial)):
            if value:
                found.update(self.index.get(f"{kind}:{value}", ()))
        if first:
            found.update(self.index.get(f"affil:{first}", ()))
        chosen = sorted(found)[: self.most]
        co, jo = frozenset(r.coauthors), frozenset(r.journals)
        if self.held > _KNOWN:
            self.scores.clear()
            self.held = 0
        known = self.scores.setdefault((bool(r.name), r.norm, co, jo), {})
        top, score, authors = None, -math.inf, self.authors
        for i in chosen:
            a = authors[i]
            got = known.get(i)
            if got is None or got[0] != a["version"]:
                self.held += got is None
                got = known[i] = (a["version"], self.score(r, a, co, jo))
            if got[1] > score:
                top, score = i, got[1]
        kind = "new" if top is None else "merge" if score >= self.accept else "new" if score <= self.reject else "unknown"
        if kind == "merge":
            a, owner, blocks = authors[top], top, set(r.blocks)
            if not jo <= a["journals"]:
                a["journals"] |= jo
                a["version"] += 1
            if not blocks <= a["blocks"]:
                a["blocks"] |= blocks
                self.file(a)
        else:
            owner = "au_" + hashlib.sha256(r.mention_id.encode()).hexdigest()[:ID_DIGITS]
            authors[owner] = {"id": owner, "version": 0, "name": r.name, "norm": r.norm, "orcid": r.orcid, "surname": r.surname, "initial": r.initial, "coauthors": co, "journals": jo, "blocks": set(r.blocks)}
            self.file(authors[owner])
        return r.mention_id, r.seq, kind, 0.0 if top is None else float(score), top if kind == "merge" else None, len(chosen), owner


#: So many name ratios a fold keeps at most, and scores.
_KNOWN = 1_000_000
_COLUMNS = [c.split()[0] for c in _DECIDED.split(", ")]


def _fold_three_way(accept: float, reject: float, weights: dict, most: int, bucket: int):
    """All rows as one set."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        decide = _Fold(accept, reject, weights, most, bucket).decide
        return pd.DataFrame([decide(r) for r in pdf.sort_values("seq").itertuples(index=False)], columns=_COLUMNS)

    return fold


def _folds_three_way(*args):
    """Batches of rows in order of root and seq: a set's authors are kept from batch to batch, its rows are not."""

    def folds(batches):
        root, fold = None, None
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                if fold is None or r.root != root:
                    root, fold = r.root, _Fold(*args)
                out.append(fold.decide(r))
            yield pd.DataFrame(out, columns=_COLUMNS)

    return folds


def replay(mentions: DataFrame, accept: float = ACCEPT, reject: float = REJECT, weights: dict = WEIGHTS, most: int = MAX_CANDIDATES, bucket: int = AFFILIATION_BUCKET) -> DataFrame:
    """Exact ordered three-way processing of mentions (mention_id, seq, name, orcid, coauthors, journals, affiliations).

    A merge adds journals and affiliations to the author; new and unknown open
    an author. Returns mention_id, seq, decision, score_total, best_author_id,
    candidate_count, author_id (whom the mention ended up with).
    """
    ship(mentions.sparkSession)
    named = mentions.withColumns({"canonical_name": F.col("name"), "author_id": F.col("mention_id")})
    probed = blocking.mention_keys(mentions)
    filed = named.select("mention_id", F.explode(F.array_compact(F.transform(F.coalesce("affiliations", F.array().cast("array<string>")), lambda x: F.when(x != "", F.concat(F.lit("affil:"), T.block_string(x)))))).alias("key"))
    keys = probed.union(filed).distinct()
    edges = keys.select(F.xxhash64("mention_id").alias("a"), F.xxhash64(F.lit("key"), "key").alias("b"))
    rows = _normal(mentions).withColumn("node", F.xxhash64("mention_id")).join(components(edges), "node", "left").withColumn("root", F.coalesce("root", "node"))
    n = int(mentions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "root").sortWithinPartitions("root", "seq").mapInPandas(_folds_three_way(accept, reject, weights, most, bucket), _DECIDED)


def legacy_replay(records: DataFrame, threshold: float = SIMILARITY_THRESHOLD, weights: dict = WEIGHTS, most: int = MAX_AFFECTED) -> DataFrame:
    """Ordered single-threshold processing of records (record_id, seq, name, coauthors, journal, affiliation): a small-input feature.

    Every record meets the first ``most`` authors by id. Returns record_id,
    seq, decision (merged, new_author, rejected), matched_author_id, score.
    """
    ship(records.sparkSession)
    rows = records.select(F.lit(1).alias("one"), "record_id", "seq", F.col("name"), S.normalize_name("name").alias("norm"), S.normal_set(F.col("coauthors")).alias("coauthors"), S.normal_set(F.filter(F.array("journal"), lambda x: x.isNotNull() & (x != ""))).alias("journals"))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        authors: dict[str, dict] = {}
        out = []
        for r in pdf.sort_values("seq").itertuples(index=False):
            if not r.record_id or not (r.name or "").strip():
                out.append((r.record_id, r.seq, "rejected", None, 0.0))
                continue
            co, jo = frozenset(r.coauthors), frozenset(r.journals)
            top, score = None, -1.0
            for i in sorted(authors)[:most]:
                a = authors[i]
                parts = {"name": name_ratio(r.norm, a["norm"]), "coauthors": set_ratio(co, a["coauthors"], 1.0), "journals": set_ratio(jo, a["journals"], 1.0)}
                s = 0.0
                for k, w in weights.items():
                    if w > 0:
                        s += parts[k] * w
                if s > score:
                    top, score = i, s
            if top is not None and score >= threshold:
                authors[top]["coauthors"] |= co
                authors[top]["journals"] |= jo
                out.append((r.record_id, r.seq, "merged", top, score))
            else:
                new = "au_" + hashlib.sha256(r.record_id.encode()).hexdigest()[:ID_DIGITS]
                authors[new] = {"norm": r.norm, "coauthors": co, "journals": jo}
                out.append((r.record_id, r.seq, "new_author", new, max(0.0, score)))
        return pd.DataFrame(out, columns=["record_id", "seq", "decision", "matched_author_id", "score"])

    return rows.groupBy("one").applyInPandas(fold, "record_id string, seq long, decision string, matched_author_id string, score double")


def snapshot(mentions: DataFrame, authors: DataFrame, mode: str = "baseline", accept: float = ACCEPT, reject: float = REJECT) -> DataFrame:
    """Decisions of a batch of mentions against a fixed author table: the scalable step of incremental processing."""
    from . import meeting, scoring

    named, distinct = scoring.profiles(mentions)
    distinct = storage.cut(distinct, "profiles")
    sides = f"sides {uuid.uuid4().hex}"
    with storage.owned(sides):
        met = meeting.dealt(distinct, authors, mode)
    storage.discard(distinct)  # its rows are in the sides
    tops = meeting.best(met, mode).withColumnRenamed("mention_id", "profile")
    tops = storage.cut(tops, "tops")
    storage.free(sides)  # no pair is made again
    return scoring.decided(named.select("mention_id", "profile").join(tops, "profile", "left"), accept, reject)


def absorb(authors: DataFrame, mentions: DataFrame, decisions: DataFrame) -> DataFrame:
    """The author table after a batch: merged mentions add journals and affiliations, others open authors."""
    from .authors import as_set, author_id

    rows = decisions.select("mention_id", "decision", "best_author_id").join(mentions, "mention_id")
    added = rows.where(F.col("decision") == "merge").groupBy(F.col("best_author_id").alias("author_id")).agg(F.array_distinct(F.flatten(F.collect_set("journals"))).alias("_j"), F.array_distinct(F.flatten(F.collect_set("affiliations"))).alias("_f"))
    kept = authors.join(added, "author_id", "left").withColumns({"journals": as_set(F.col("journals"), F.col("_j")), "affiliations": as_set(F.col("affiliations"), F.col("_f"))})
    columns = ["author_id", "canonical_name", "orcid", "coauthors", "journals", "affiliations", "seq"]
    opened = rows.where(F.col("decision") != "merge").select(author_id(F.col("mention_id")).alias("author_id"), F.col("name").alias("canonical_name"), "orcid", as_set(F.col("coauthors")).alias("coauthors"), as_set(F.col("journals")).alias("journals"), as_set(F.col("affiliations")).alias("affiliations"), "seq")
    return kept.select(*columns).unionByName(opened.select(*columns))
