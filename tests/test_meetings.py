"""Candidate pairs where keys meet, against plain sets; scores once a profile."""

import random

from pyspark.sql import functions as F

from authorloom.operators import blocking, scoring

from .test_engine import AUTHOR, PROBE


def drawn(spark, n=90, m=70):
    rng = random.Random(5)
    name = lambda: f"{rng.choice(['Ann', 'Bo', 'Al', ''])} {rng.choice(['Lee', 'Kim', 'Ray', 'Fox'])}".strip()
    orcid, place = (lambda: rng.choice(["", "", "o1", "o2", "o3"])), (lambda: rng.choice(["MIT", "ETH", "CERN", ""]))
    co = lambda: sorted(rng.sample(["x", "y", "z", "w"], rng.randrange(4)))
    authors = [(f"au_{i:03}", name(), orcid(), co(), ["J"], sorted({place(), place()}), n - i) for i in range(n)]
    mentions = [(f"m{i}", i, name() if i % 9 else "", orcid(), co(), ["J"], [place()]) for i in range(m)]
    return spark.createDataFrame(mentions, PROBE), spark.createDataFrame(authors, AUTHOR), mentions, authors


def plain(mentions, authors, most, bucket):
    def keys(name, orcid, places):
        w = name.split()
        named = {"s:" + w[-1].lower(), "i:" + (w[-1].lower() + "_" + w[0][0].lower() if len(w) > 1 else w[-1].lower())} if w else set()
        return named | ({"o:" + orcid} if orcid else set()) | {"f:" + p.lower() for p in places if p}

    filed = {}
    for i, name, orcid, _, _, places, seq in authors:
        for k in keys(name, orcid, places):
            filed.setdefault(k, []).append((seq, i))
    filed = {k: [i for _, i in sorted(v)[:bucket]] if k[0] == "f" else [i for _, i in v] for k, v in filed.items()}
    out = set()
    for i, _, name, orcid, _, _, places in mentions:
        out |= {(i, a) for a in sorted({a for k in keys(name, orcid, places) for a in filed.get(k, [])})[:most]}
    return out


def test_meetings_are_the_candidates(spark):
    ms, authors, m, a = drawn(spark)
    for most, bucket in ((100, 20), (7, 3), (1, 1)):
        want = plain(m, a, most, bucket)
        listed = [tuple(r) for r in blocking.candidates(ms, authors, most, bucket).collect()]
        left, right, met = blocking.meetings(ms, authors, ms.select("mention_id"), authors.select("author_id"), most, bucket)
        pairs = [tuple(r) for r in left.join(right, "key").where(met).select("mention_id", "author_id").collect()]
        assert len(listed) == len(set(listed)) and set(listed) == want
        assert len(pairs) == len(set(pairs)) and set(pairs) == want


def test_profiles_are_scored_once_and_pairs_not_dealt_out(spark):
    ms, authors, _, _ = drawn(spark)
    twice = ms.union(ms.withColumn("mention_id", F.concat(F.lit("again"), "mention_id")))
    named, distinct = scoring.profiles(twice)
    assert distinct.count() == scoring.profiles(ms)[1].count() and distinct.agg(F.sum("copies")).first()[0] == 2 * ms.count()
    pairs = scoring.pairs_met(distinct, authors)
    tops = scoring.tops(scoring.scored(scoring.compare(pairs))).withColumnRenamed("mention_id", "profile")
    got = scoring.decided(named.select("mention_id", "profile").join(tops, "profile", "left"), 0.7, 0.2)
    every = scoring.scored(scoring.compare(scoring.pairs_of(twice, authors, blocking.candidate_lists(twice, authors))))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, scoring.decide(twice, every, 0.7, 0.2).collect()), key=repr)
    above = pairs._jdf.queryExecution().executedPlan().toString().split("ShuffledHashJoin")[0]
    assert "Exchange" not in above  # what is dealt out are the two sides


def test_sides_of_pairs_go_before_results_are_joined(spark, sf_dir):
    """Once each profile's best is written, the sides that its pairs were made of are deleted."""
    from authorloom import storage
    from authorloom.plans import catalog

    before = set(storage._written)
    for name in ("legacy_decision", "best_match_fs", "incremental_snapshots"):
        out = catalog.queries()[name](spark, sf_dir)
        left = {x.rpartition("/")[2].split("-")[0] for x in set(storage._written) - before}
        assert "tops" in left and not left & {"probed", "filed", "profiles"}
        assert out.count() > 0
