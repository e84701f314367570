"""Windows that a conflict elsewhere, equal values or few plain tokens used to take with them."""

import itertools
import random

from authorloom.llm import decontam

from .test_operators import docs_of

ROW = "the shop sold {} red boxes on monday and then {} blue boxes on friday before the owner went home to count them all again"
TABLE = "12 kg 40 km 3 Paris 17 Rome 250 g 8 Oslo 99 mm 4"


def test_conflicts_take_only_their_own_windows(spark):
    bench = spark.createDataFrame([(1, ROW.format(5, 5)), (2, ROW.format(3, 4).replace("shop", "store")), (3, TABLE), (4, "7 9 11 13")], "item_id long, text string")
    rows = [(1, "Intro text here. " + ROW.format(5, 6)), (2, "Intro text here. " + ROW.format(5, 5).replace("shop", "store")), (3, f"Some words first and {TABLE} after."), (4, TABLE.replace("1", "2").replace("4", "5")), (5, "it has 7 9 11 13 in it"), (6, "it has 7 9 11 14 in it")]
    got = {(r["doc_id"], r["item_id"]): r for r in decontam.contamination(docs_of(spark, rows), bench).collect()}
    assert {(1, 1), (2, 2), (3, 3), (5, 4)} <= set(got) and not {d for d, _ in got} & {4, 6}
    assert got[1, 1]["share"] == 1 and got[3, 3]["share"] == 1


def test_largest_mapping_against_all_subsets():
    rng = random.Random(1)
    for _ in range(150):
        windows = {p: frozenset((rng.randrange(3), rng.randrange(3)) for _ in range(rng.randint(1, 2))) for p in range(7)}
        fits = lambda some: len({b for p in some for b, _ in windows[p]}) == len({x for p in some for x in windows[p]})
        most = max(n for n in range(8) for some in itertools.combinations(windows, n) if fits(some))
        got = decontam.largest(windows)
        assert len(got) == most and fits(got)
