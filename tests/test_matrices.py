"""Scores by matrices where keys meet, against the same pairs as rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from authorloom.operators import blocking, incremental, meeting, scoring

from .test_meetings import drawn


@pytest.mark.parametrize("mode", ["baseline", "fs", "legacy"])
def test_matrices_score_as_rows(spark, monkeypatch, mode):
    monkeypatch.setattr(meeting, "TASK_ROWS", 9)  # several tasks a key
    ms, authors, _, _ = drawn(spark)
    pairs = scoring.pairs_of(ms, authors, blocking.candidate_lists(ms, authors))
    every = pairs.withColumn("score", F.round(scoring.legacy_similarity(), 9)) if mode == "legacy" else scoring.scored(scoring.compare(pairs), mode)
    every = every.select("mention_id", "author_id", "score")
    order = lambda df: sorted(map(tuple, df.collect()))
    sides = meeting.dealt(ms, authors, mode)
    assert order(meeting.best(sides, mode)) == order(scoring.tops(every))
    got = scoring.best(meeting.tops(sides, mode, 5), 5).select("mention_id", "rank", "author_id", "score")
    assert order(got) == order(scoring.best(every, 5).select("mention_id", "rank", "author_id", "score"))
    if mode == "fs":
        names = [f"{f}_bin" for f in meeting.FEATURES]
        sums = [F.round(F.sum(f"{s}_sim"), 6) for s in meeting.SIMS]
        want = scoring.compare(pairs).groupBy(*names).agg(F.count("*"), *sums)
        assert order(meeting.bins(sides).groupBy(*names).agg(F.sum("pairs"), *sums)) == order(want)


def test_no_row_is_made_for_a_pair(spark, sf_dir):
    """The plan of a decision joins no authors to mentions: the only rows after the sides are a mention's best of each key."""
    from authorloom.plans import catalog

    _, a, sides = catalog._met(spark, sf_dir)
    met = meeting.tops(sides)
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "ShuffledHashJoin" not in plan
    assert met.count() <= sides.where("side = 1").count()


def test_edits_and_rounding():
    rng = random.Random(3)
    words = ["", "a", "é" * 70] + ["".join(rng.choice("abcö") for _ in range(rng.randint(1, 12))) for _ in range(20)]
    assert meeting.edits(words, words[::-1]).tolist() == [[incremental.levenshtein(a, b) for b in words[::-1]] for a in words]
    values = np.array([0.3 / 512, 0.0005859375, 1.0000000005, -2.5e-10, -1.5e-9, 0.1 + 0.2, 0.0, 7.123456789499999])
    assert meeting.rounded(values).tolist() == [0.000585938, 0.000585938, 1.000000001, 0.0, -2e-9, 0.3, 0.0, 7.123456789]
