"""Blocking, scoring, decisions, traces, dedup, graph, clusters, metrics and incremental runs."""

import hashlib
import json
import random
from collections import namedtuple

import pytest
from pyspark.sql import functions as F

from authorloom.exceptions import DataIntegrityError
from authorloom.operators import authors as author_ops
from authorloom.operators import blocking, calibrate, cluster, dedup, graph, incremental, metrics, registry, scoring, stress, trace
from authorloom.operators.components import components
from authorloom.plans import adapter
from authorloom.sources import readers, writers
from authorloom.streaming import micro_batches

PROBE = "mention_id string, seq long, name string, orcid string, coauthors array<string>, journals array<string>, affiliations array<string>"
AUTHOR = "author_id string, canonical_name string, orcid string, coauthors array<string>, journals array<string>, affiliations array<string>, seq long"


@pytest.fixture(scope="module")
def john(spark):
    return spark.createDataFrame([("au_1", "John Smith", "0000-0001-2345-6789", ["Alice Brown", "Bob Wilson"], ["Nature", "Science"], ["Harvard University"], 1)], AUTHOR)


def probes(spark, *rows):
    return spark.createDataFrame([(f"m{i}", i, *r) for i, r in enumerate(rows)], PROBE)


def every(mentions, authors):
    """All authors as each mention's candidates."""
    return mentions.select("mention_id").crossJoin(authors.agg(F.collect_list("author_id").alias("ids")))


# ---- blocking ----------------------------------------------------------------

def test_blocking(spark):
    people = [("Zhang Wei", "1111"), ("Zhang Li", ""), ("John Smith", ""), ("Jane Doe", "")] + [(f"Test Author {i}", "") for i in range(100)]
    authors = spark.createDataFrame([(f"au_{i:03}", n, o, [], [], [], i) for i, (n, o) in enumerate(people)], AUTHOR)
    asked = [("Wei Zhang", "1111"), ("Wang Wei", ""), ("Zhang Wei", ""), ("John Smith", ""), ("", ""), ("Nonexistent Person", ""), ("Some Author", "")]
    ms = probes(spark, *[(n, o, [], [], []) for n, o in asked])
    found = {}
    for r in blocking.candidates(ms, authors, most=50).collect():
        found.setdefault(r["mention_id"], []).append(r["author_id"])
    assert "au_000" in found["m0"] and "au_000" in found["m1"] and len(found["m2"]) <= 10 and found["m3"] == ["au_002"] and "m4" not in found and "m5" not in found
    authors_numeric = spark.createDataFrame([(f"au_{i:03}", f"Author{i} Jones", "", [], [], ["MIT"], 100 - i) for i in range(60)], AUTHOR)
    got = blocking.candidates(probes(spark, ("X Jones", "", [], [], [])), authors_numeric, most=50).agg(F.min("author_id"), F.max("author_id"), F.count("*")).first()
    assert tuple(got) == ("au_000", "au_049", 50)
    by_place = blocking.candidates(probes(spark, ("X Other", "", [], [], ["MIT"])), authors_numeric).agg(F.min("author_id"), F.count("*")).first()
    assert tuple(by_place) == ("au_040", 20)  # the first twenty by insertion
    assert spark.range(1).select(blocking.reported_keys(F.lit("J. A. Smith"), F.lit("o"))).first()[0] == ["orcid:o", "surname:smith", "surname_initial:smith_J"]


# ---- scoring -----------------------------------------------------------------

def test_three_layers(spark, john):
    ms = probes(spark, ("J. Smith", "0000-0001-2345-6789", ["Alice Brown"], ["Nature"], ["Harvard University"]), ("Alice Wang", "", ["David Lee"], ["Cell"], ["Stanford University"]))
    pairs = scoring.pairs_of(ms, john, every(ms, john))
    c = scoring.compare(pairs)
    got = {r["mention_id"]: r for r in c.select("*", scoring.weighted().alias("base"), scoring.fellegi_sunter().alias("fs")).collect()}
    a = got["m0"]
    assert (a["name_sim"], a["name_bin"], a["coauthor_bin"], a["journal_bin"], a["affiliation_bin"], a["orcid_bin"]) == (pytest.approx(0.7), "medium", "high", "high", "exact", "match")
    assert (a["base"], a["fs"]) == (pytest.approx(0.60), pytest.approx(16.196056, abs=1e-6))
    assert got["m1"]["base"] == 0 and got["m1"]["affiliation_sim"] == pytest.approx(0.615385, abs=1e-6) and got["m1"]["fs"] == pytest.approx(-7.293018, abs=1e-6)
    bare = probes(spark, ("John Smith", "", [], [], []))
    fs = scoring.compare(scoring.pairs_of(bare, john, every(bare, john))).select(scoring.fellegi_sunter()).first()[0]
    assert fs == pytest.approx(-1.668699, abs=1e-6)
    legacy = scoring.pairs_of(bare, john.withColumns({"coauthors": F.array().cast("array<string>"), "journals": F.array().cast("array<string>")}), every(bare, john))
    assert legacy.select(scoring.legacy_similarity()).first()[0] == 1.0


def test_three_way_goldens(spark, john):
    ms = probes(spark, ("John Smith", "0000-0001-2345-6789", ["Alice Brown", "Bob Wilson"], ["Nature", "Science"], []), ("Robert Johnson", "", [], [], []), ("J. A. Smith", "", ["Alice Brown", "X", "Y"], ["Other"], ["Harvard Medical School"]))
    scores = scoring.scored(scoring.compare(scoring.pairs_of(ms, john, blocking.candidate_lists(ms, john))))
    d = {r["mention_id"]: r for r in scoring.decide(ms, scores, 0.7, 0.2).collect()}
    assert [d[f"m{i}"]["decision"] for i in range(3)] == ["merge", "new", "unknown"]
    assert d["m0"]["best_author_id"] == "au_1" and d["m2"]["best_author_id"] is None and d["m1"]["candidate_count"] == 0
    assert d["m0"]["reason"] == "Score 1.000 >= accept_threshold 0.7, merged with author au_1" and d["m1"]["reason"] == "Score 0.000 <= reject_threshold 0.2, created new author"
    t = {"accept": 0.7, "reject": 0.2}
    assert trace.decision_hash("merge", 1.0, {"name": 0.5, "coauthors": 0.3, "journals": 0.2}, "au_da5efd57", "baseline", t) == "c85aa6bc9d3e"
    assert trace.decision_hash("new", 0.0, {}, None, "baseline", t) == "dedeee6c797b"
    assert trace.decision_hash("unknown", 0.45, {"name": 0.35, "coauthors": 0.1, "journals": 0.0}, None, "baseline", t) == "8265286cbb20"
    rows = trace.rows(ms, scoring.decide(ms, scores, 0.7, 0.2), "baseline", 0.7, 0.2, "run", hash_keys=True)
    text = "\n".join(rows.toJSON().collect())
    assert "Smith" not in text and "smith" not in text and "Harvard" not in text and "0000-0001-2345-6789" in text
    assert [r["mention_id"] for r in trace.review_queue(rows).collect()] == ["m2"]


def test_best_breaks_ties_by_id(spark):
    s = spark.createDataFrame([("m", "b", 0.5), ("m", "a", 0.5), ("m", "c", 0.4)], "mention_id string, author_id string, score double")
    assert [(r["author_id"], r["rank"]) for r in scoring.best(s, 2).orderBy("rank").collect()] == [("a", 1), ("b", 2)]


# ---- dedup -------------------------------------------------------------------

def test_dedup_goldens(spark):
    rows = [(1, "10.1/a", "The Genome of the Sea Urchin"), (2, "https://doi.org/10.1/a", "Other title"), (3, "", "The Genome of the Sea Urchin"), (4, "10.1/d", "Genome, of sea urchin!"), (5, "10.1/e", "Deep learning"), (6, None, None), (7, "", "Genome sea urchins"), (8, "10.1/A", "")]
    articles = spark.createDataFrame(rows, "seq long, doi string, title string")
    assert {(r["seq"], r["kept"], r["reason"]) for r in dedup.exact(articles).collect()} == {(2, 1, "doi"), (3, 1, "title"), (4, 1, "title")}
    assert {r["seq"] for r in dedup.unique(articles).collect()} == {1, 5, 6, 8}
    assert {r["seq"] for r in dedup.unique(articles, mode="token").collect()} == {1, 5, 6, 7, 8}
    assert tuple(dedup.stats(articles).first()) == (8, 5, 6, 1, 2)


@pytest.mark.parametrize("mode", ["indel", "token"])
def test_fuzzy_pairs_against_all_pairs(spark, mode):
    from authorloom.functions import similarity as S

    rng = random.Random(4)
    base = [" ".join(rng.choice(["deep", "sea", "urchin", "genome", "learning", "of", "stars"]) + str(rng.randint(0, 3)) for _ in range(rng.randint(2, 7))) for _ in range(12)]
    titles = set(base)
    for t in base:
        for _ in range(5):
            i = rng.randrange(len(t))
            titles.add(rng.choice([t[:i] + t[i + 1 :], t[:i] + "z" + t[i:], t + " more", t[:i] + "q" + t[i + 1 :]]).strip())
    least = 0.9 if mode == "indel" else 0.7
    words = lambda t: set(t.lower().split())
    ratio = S.indel_ratio if mode == "indel" else lambda a, b: len(words(a) & words(b)) / len(words(a) | words(b))
    want = {(a, b) for a in titles for b in titles if a < b and ratio(a, b) >= least}
    got = dedup.fuzzy_pairs(spark.createDataFrame([(t,) for t in titles], "title string"), least, mode).collect()
    assert want and {tuple(r) for r in got} == want


@pytest.mark.parametrize("mode", ["indel", "token"])
def test_fuzzy_pairs_verifies_few_candidates(spark, monkeypatch, mode):
    """Titles of a small vocabulary share segments and rare words with many others; few such pairs reach the ratio."""
    from authorloom.functions import similarity as S

    rng = random.Random(6)
    vocabulary = [a + b for a in ("deep", "sea", "star", "gene", "cold") for b in ("", "ing", "er", "ish", "x", "ful")]
    titles = sorted({" ".join(rng.sample(vocabulary, 3 if mode == "indel" else 12)) for _ in range(300)})
    frame = spark.createDataFrame([(t,) for t in titles], "title string")
    made = []
    if mode == "indel":
        monkeypatch.setattr(S, "indel_ratio_udf", lambda spark: lambda a, b: F.lit(1.0))
        made.append(dedup.fuzzy_pairs(frame, 0.9, mode).count())
    else:
        candidates = dedup._token_candidates
        monkeypatch.setattr(dedup, "_token_candidates", lambda sets, least: made.append(candidates(sets, least).count()) or candidates(sets, least))
        dedup.fuzzy_pairs(frame, 0.8, mode)
    assert made[0] < len(titles)


def test_fuzzy_pairs_of_exactly_the_least_ratio(spark):
    """0.1 x 20 edits are two, whatever the doubles say: one in each half of ten letters."""
    frame = spark.createDataFrame([("abcdefghij",), ("acdefghzij",)], "title string")
    assert [tuple(r) for r in dedup.fuzzy_pairs(frame, 0.9).collect()] == [("abcdefghij", "acdefghzij")]


# ---- graph, components, clusters ---------------------------------------------

def test_graph_goldens(spark):
    links = spark.createDataFrame([("2", "1"), ("2", "3"), ("3", "4"), ("4", "5"), ("1", "2"), ("1", "2"), ("1", "1"), ("", "3"), (None, "2")], "a string, b string")
    g = graph.edges(links)
    assert {tuple(r) for r in g.collect()} == {("1", "2", 3), ("2", "3", 1), ("3", "4", 1), ("4", "5", 1)}
    pub = spark.createDataFrame([("p", "2"), ("p", "3")], "pub_id string, author_id string")
    assert {r["node"] for r in graph.affected_by_publication(g, pub, 2).collect()} == {"1", "2", "3", "4", "5"}
    assert [r["node"] for r in graph.affected_by_publication(g, pub, 2, 1).collect()] == ["2"]
    assert {r["node"] for r in graph.k_hop(g, spark.createDataFrame([("1",), ("zz",)], "start string"), 2).collect()} == {"1", "2", "3"}
    assert graph.k_hop(g, spark.createDataFrame([("1",)], "start string"), 0).count() == 0
    assert tuple(graph.stats(g).first()) == (5, 4, 1.6) and tuple(graph.stats(g.limit(0)).first()) == (0, 0, 0)
    assert {tuple(r)[:2] for r in graph.remove_nodes(g, spark.createDataFrame([("2",)], "node string")).collect()} == {("3", "4"), ("4", "5")}
    assert {tuple(r) for r in graph.neighbours(g, "3").collect()} == {("2", 1), ("4", 1)}
    assert graph.strongest(g, 1).first()["weight"] == 3
    au = spark.createDataFrame([("a",), ("b",)], "author_id string")
    assert graph.affected_by_record(au, 5).count() == 2 and graph.affected_by_record(au, 0).count() == 0


def test_coauthor_counts_meet_classes_of_names(spark):
    """As many authors as ``coauthor_ids`` finds; of authors of equal names a record meets one class."""
    authors = [(f"a{i}", ["Ann Lee", "Bo Xu", "Cy Ode"][i % 3], [[], ["bo xu "], ["Dee", "ann lee"], None][i % 4]) for i in range(60)] + [("n", None, None), ("m", None, ["Dee", None])]
    authors = spark.createDataFrame(authors, "author_id string, canonical_name string, alternate_names array<string>")
    records = spark.createDataFrame([("r1", ["Ann Lee", " ANN LEE"]), ("r2", ["Bo Xu", "Dee", ""]), ("r3", ["Nobody", None]), ("r4", []), ("r5", ["cy ode", "ann lee", "bo xu"])], "record_id string, coauthors array<string>")
    want = {r["record_id"]: r["count"] for r in graph.coauthor_ids(records, authors).groupBy("record_id").count().collect()}
    got = {r["record_id"]: r["authors"] for r in graph.coauthor_counts(records, authors).collect()}
    assert got == want and set(got) == {"r1", "r2", "r5"}


def test_mentions_are_dealt_once_to_meet_their_authors(spark, sf_dir):
    """jaccard_coauthors deals lines by person once, after one dealing by order, and no strings of co-authors."""
    from authorloom.plans import catalog

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = catalog.queries()["jaccard_coauthors"](spark, sf_dir)
        out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    dealt = [x for x in plan.splitlines() if "Exchange hashpartitioning(" in x and "ReusedExchange" not in x]
    assert sum("(person" in x for x in dealt) == 1 and not any("(doi" in x for x in dealt)


def test_components_of_chains_and_stars(spark):
    rng = random.Random(1)
    chain = [(i, i + 1) for i in range(60)]
    star = [(1000, 1000 + i) for i in range(1, 80)]
    lone = [(5, 5), (None, 3)]
    more = [(rng.randint(2000, 2060), rng.randint(2000, 2060)) for _ in range(40)]
    edges = chain + star + lone + more + [(b, a) for a, b in star[:5]]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            parent[find(a)] = find(b)
    assert set(got) == {x for x in parent}
    assert len({(got[x], find(x)) for x in parent}) == len(set(got.values())) == len({find(x) for x in parent})
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


MENTIONS = "mention_id string, raw_name string, lastname string, firstname string, orcid string, affiliation string, venue string, _original_index long"


def test_heuristic_clusters(spark):
    rows = [("a", "John Smith", "", "", "", "Harvard Medical School", "", 0), ("b", "J Smith", "", "", "", "Harvard University", "", 1), ("c", "Jane Smith", "", "", "", "Oxford Univ", "", 2), ("d", "Jim Smith", "", "", "", "", "", 3), ("e", "J Smith", "", "", "", None, "", 4), ("f", "Ann Lee", "", "", "", "X", "", 5), ("g", "Al Lee", "", "", "", "X", "", 6)]
    got = {}
    for r in cluster.heuristic(spark.createDataFrame(rows, MENTIONS), 0.2).collect():
        got.setdefault(r["cluster_id"], set()).add(r["mention_id"])
    assert sorted(map(sorted, got.values())) == [["a", "b"], ["c"], ["d", "e"], ["f"], ["g"]]


def test_greedy_chinese_against_plain_fold(spark):
    names = ["Wang Xiaoming", "Xiaoming Wang", "Wang Xiao", "Xia Wang", "Li Wei", "Wei Li", "John Smith", "Li Wang", "Wang Li", "Weixin Li"]
    rows = [(f"m{i}", n, "", "", "", "", "", i) for i, n in enumerate(names * 2)]
    frame = spark.createDataFrame(rows, MENTIONS)
    known, want = {}, {}
    for m, n, *_ in rows:
        if n == "John Smith":
            want.setdefault("fini", set()).add(m)
            continue
        a, b = n.lower().split()
        k1, k2 = f"cn:{a}_{b[:3]}", f"cn:{b}_{a[:3]}"
        c = known.get(k1) or known.get(k2)
        if not c:
            c = known[k1] = known[k2] = m
        want.setdefault(c, set()).add(m)
    got = {}
    for r in cluster.greedy_chinese(frame).collect():
        got.setdefault(r["cluster_id"], set()).add(r["mention_id"])
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_clusters_from_pairs_and_decisions(spark):
    ms = spark.createDataFrame([(x,) for x in "abcd"], "mention_id string")
    got = {(r["cluster_id"], r["mention_id"]) for r in cluster.from_pairs(spark.createDataFrame([("b", "a"), ("b", "c")], "a string, b string"), ms).collect()}
    assert got == {("cluster:a", "a"), ("cluster:a", "b"), ("cluster:a", "c"), ("cluster:d", "d")}
    d = spark.createDataFrame([("a", "merge", "x", None), ("b", "NEW", None, "n"), ("c", "unknown", None, None), ("d", "?", None, None)], "mention_id string, decision string, author_id string, new_author_id string")
    assert {r["cluster_id"] for r in cluster.from_decisions(d).collect()} == {"author:x", "new:n", "unk:c", "other:d"}
    assert cluster.from_decisions(d, keep_unknown=False).count() == 3


# ---- metrics -----------------------------------------------------------------

def clusters(spark, *groups):
    return spark.createDataFrame([(f"c{i}", m) for i, g in enumerate(groups) for m in g], "cluster_id string, mention_id string")


@pytest.mark.parametrize(("gold", "pred", "p", "r", "pairs"), [
    (["123", "45"], ["123", "45"], 1, 1, (4, 0, 0)), (["123"], ["1", "2", "3"], 1, 1 / 3, (0, 0, 3)), (["12", "34"], ["1234"], 0.5, 1, (2, 4, 0)), (["123"], ["12", "3"], 1, 5 / 9, (1, 0, 2)),
])
def test_metric_goldens(spark, gold, pred, p, r, pairs):
    g, q = clusters(spark, *gold), clusters(spark, *pred)
    for v in ("v1", "v2", "v3"):
        b = metrics.b_cubed(g, q, v).first()
        assert (b["precision"], b["recall"]) == (pytest.approx(p), pytest.approx(r))
        x = metrics.pairwise(g, q, v).first()
        assert (x["tp"], x["fp"], x["fn"]) == pairs


def test_metric_variants_conflicts_and_filter(spark):
    g, q = clusters(spark, "12", "34"), clusters(spark, "125", "3")
    assert metrics.b_cubed(g, q, "v1").first()["precision"] == pytest.approx((2 / 3 + 2 / 3 + 1) / 3)
    assert metrics.b_cubed(g, q, "v2").first()["recall"] == pytest.approx((1 + 1 + 0.5 + 0) / 4)
    assert metrics.b_cubed(g, q, "v3").first()["precision"] == pytest.approx(1)
    assert metrics.pairwise(g, q, "v1").first()["fp"] == 2 and metrics.pairwise(g, q, "v3").first()["fp"] == 0
    assert tuple(metrics.conflict_rate(g, clusters(spark, "123")).first()) == (1, 1, 1.0) and tuple(metrics.conflict_rate(g, clusters(spark, "1", "2")).first()) == (0, 0, 0.0)
    kept = metrics.restrict(clusters(spark, "123", "45"), spark.createDataFrame([("1",), ("2",), ("5",)], "mention_id string"))
    assert sorted((r["cluster_id"], r["mention_id"]) for r in kept.collect()) == [("c0", "1"), ("c0", "2"), ("c1", "5")]
    assert metrics.all_metrics(g, q).count() == 7


def test_decision_scores(spark):
    s = spark.createDataFrame([("m1", 1, 0.9, 1), ("m2", 2, 0.8, 3), ("m3", 3, 0.1, 4), ("m4", 9, None, None), ("m5", 1, 0.5, 1)], "mention_id string, true_id long, score double, author_true_id long")
    known = spark.createDataFrame([(1,), (2,), (3,)], "true_id long")
    grid = metrics.threshold_grid(spark, [0.7], [0.2, 0.7])
    assert grid.count() == 1
    got = {v: metrics.decision_scores(s, grid, known, v).first() for v in metrics.DECISION_VARIANTS}
    assert [(got[v]["correct"], got[v]["wrong"]) for v in ("d1", "d2", "d3")] == [(1, 1), (1, 2), (2, 2)]
    assert (got["d1"]["merged"], got["d1"]["new"], got["d1"]["unknown"]) == (2, 2, 1)


# ---- calibration, stress, registry -------------------------------------------

def test_ids_tell_records_apart_whose_short_forms_meet(spark):
    from authorloom.operators import authors

    first = {}
    for i in range(300_000):
        short = hashlib.sha256(f"r{i}".encode()).hexdigest()[:8]
        if short in first:
            break
        first[short] = i
    pair = [f"r{first[short]}", f"r{i}"]
    rows = spark.createDataFrame([(x,) for x in pair], "record_id string").select(authors.author_id(F.col("record_id")).alias("id"))
    got = rows.select("id", authors.shown(F.col("id")).alias("shown")).collect()
    assert len({r["id"] for r in got}) == 2 and len({r["shown"] for r in got}) == 1 and got[0]["shown"] == f"au_{short}"


def test_calibration(spark):
    pos = spark.createDataFrame([("f", "exact")] * 3 + [("f", "none")], "feature string, bin string")
    neg = spark.createDataFrame([("f", "none")] * 2, "feature string, bin string")
    got = {r["bin"]: (r["m"], r["u"]) for r in calibrate.table(pos, neg).collect()}
    assert got == {"exact": (round(4 / 6, 6), 0.25), "none": (round(2 / 6, 6), 0.75)}
    assert "exact" in calibrate.to_yaml(calibrate.table(pos, neg))
    ms = spark.createDataFrame([(f"m{i}", "Ann Lee", "", "", f"o{i % 4}", "MIT", "Nature", i) for i in range(12)], MENTIONS)
    assert sum(r["weight"] for r in calibrate.positive_pairs(ms).collect()) == 4 * 3
    mixed = spark.createDataFrame([(f"m{i}", ["Ann Lee", "A. Lee", "Ann  Lee"][i % 3], "", "", "o1" if i < 9 else "", "MIT" if i % 2 else "", "Nature", i) for i in range(12)], MENTIONS)
    rows = [r.asDict() for r in mixed.collect()]
    keys = lambda r: (r["raw_name"], r["affiliation"], r["venue"])
    plain = sorted(tuple(sorted((keys(x), keys(y)))) for i, x in enumerate(rows) for y in rows[:i] if x["orcid"] and x["orcid"] == y["orcid"])
    names = {r["mention_id"]: keys(r) for r in rows}
    got = sorted(tuple(sorted((names[r["a"]], names[r["b"]]))) for r in calibrate.positive_pairs(mixed).collect() for _ in range(r["weight"]))
    assert got == plain
    assert all(a[-1] != b[-1] or int(a[1:]) % 4 != int(b[1:]) % 4 for a, b in (tuple(r) for r in calibrate.negative_pairs(ms, 20).collect()))
    feats = calibrate.pair_features(calibrate.positive_pairs(ms), ms)
    assert {(r["feature"], r["bin"]) for r in feats.collect()} == {("name_similarity", "exact"), ("orcid_match", "exact"), ("affiliation_similarity", "exact"), ("venue_similarity", "same")}


def test_stress_and_blinding(spark):
    ms = spark.createDataFrame([(f"m{i}", f"{s} Xiaoming", "L", "F", "o", "", "", i) for i, s in enumerate(["Wang", "Li", "Smith", "Chen"] * 50)], MENTIONS)
    out = stress.stress(ms, 0.5)
    stress.check(out, 0.5)
    assert out.where("raw_name LIKE '%Smith%' AND stress_op IS NOT NULL").count() == 0
    assert {r["op"] for r in stress.report(out).collect()} <= {"swap_order", "punctuation", "remove_space", "initialize_given"}
    assert out.where("stress_op = 'swap_order'").first()["raw_name"].startswith("Xiaoming ")
    with pytest.raises(DataIntegrityError):
        stress.check(stress.stress(ms, 0.0), 0.5)
    assert not stress.is_blind(ms) and stress.is_blind(stress.blind(ms)) and tuple(stress.orcid_counts(ms).first()) == (200, 200, 1)


def test_registry(spark, tmp_path):
    r = registry.RunRegistry(spark, f"{tmp_path}/runs")
    r.register_run("r1", "fini", {"a": 1}, "d", {"f1": 0.5}, "o1")
    r.register_run("r2", "aini", {"a": 2}, "d", {"f1": 0.6}, "o2")
    r.check_outputs()
    assert r.load_all_runs().count() == 2 and r.find_run("r2").first()["experiment"] == "aini"
    r.register_run("r3", "other", {"a": 2}, "d", {"f1": 0.6}, "o3")
    with pytest.raises(DataIntegrityError):
        r.check_outputs()
    r.clear()
    assert r.load_all_runs().count() == 0
    t = spark.createDataFrame([("a", 0.5)], "k string, v double")
    registry.check_tables_differ(t, t.withColumn("v", F.col("v") + 0.1), ["k"], ["v"])
    with pytest.raises(DataIntegrityError):
        registry.check_tables_differ(t, t, ["k"], ["v"])


# ---- authors and incremental runs --------------------------------------------

def test_author_table(spark):
    records = spark.createDataFrame([("r1", "Ann Lee", ["Bob"], "Nature", "MIT", False), ("r2", "A. Lee", ["Cy", "Bob"], "Cell", None, False), ("", "No Id", [], None, None, False), ("r4", "  ", [], None, None, False), ("r5", "Old", [], None, None, True)], "record_id string, name string, coauthors array<string>, journal string, affiliation string, processed boolean")
    good, bad = author_ops.validate(records)
    assert {r["record_id"] for r in good.collect()} == {"r1", "r2"} and {r["reason"] for r in bad.collect()} == {"missing record_id", "blank name", "already processed"}
    a = author_ops.from_records(good.where("record_id = 'r1'"))
    out = author_ops.merge_records(a, good.where("record_id = 'r2'").crossJoin(a.select("author_id"))).first()
    assert (out["alternate_names"], out["journals"], out["coauthors"], out["linked_records"], out["confidence_score"]) == (["A. Lee", "Ann Lee"], ["Cell", "Nature"], ["Bob", "Cy"], ["r1", "r2"], 0.95)
    both = author_ops.from_records(good)
    ids = [r["author_id"] for r in both.orderBy("canonical_name").collect()]
    merged = author_ops.merge_authors(both, spark.createDataFrame([(ids[0], ids[1], 0.8)], "source_id string, target_id string, score double")).collect()
    assert len(merged) == 1 and merged[0]["confidence_score"] == pytest.approx(0.76) and merged[0]["journals"] == ["Cell", "Nature"]
    seqd = both.withColumn("seq", F.lit(1)).withColumn("orcid", F.lit("o"))
    assert author_ops.find_by_orcid(seqd, "https://orcid.org/o").count() == 1 and author_ops.search(seqd, "Lee").count() == 2
    assert author_ops.with_record_ids(records).where("record_id = ''").count() == 0


DEMO = "record_id string, seq long, name string, coauthors array<string>, journal string"


def test_legacy_replay(spark):
    rows = [("r1", 1, "Ann Lee", ["Bob"], "Nature"), ("r2", 2, "Ann Lee", ["Bob"], "Nature"), ("r3", 3, "", [], None), ("r4", 4, "Zed Xu", ["Q"], "Cell")]
    got = {r["record_id"]: r for r in incremental.legacy_replay(spark.createDataFrame(rows, DEMO)).collect()}
    assert [got[f"r{i}"]["decision"] for i in range(1, 5)] == ["new_author", "merged", "rejected", "new_author"]
    assert got["r2"]["matched_author_id"] == got["r1"]["matched_author_id"] and got["r2"]["score"] == 1.0


def plain_replay(rows, accept, reject):
    """All mentions in one pass, over one index."""
    fold = incremental._fold_three_way(accept, reject, {"name": 0.5, "coauthors": 0.3, "journals": 0.2}, 100, 20)
    return fold(rows)


def test_replay_is_exact_whatever_the_partitioning(spark):
    rng = random.Random(8)
    first, last, places = ["Ann", "Bob", "Cy", "Dee", "A."], ["Lee", "Xu", "Ode", "Roy"], ["MIT", "ETH", "", "KTH"]
    rows = [(f"m{i:03}", i, f"{rng.choice(first)} {rng.choice(last)}" if rng.random() < 0.95 else "", rng.choice(["", "", f"o{rng.randint(0, 9)}"]), rng.sample(["P", "Q", "R"], rng.randint(0, 2)), rng.sample(["Nature", "Cell"], rng.randint(0, 2)), [p for p in rng.sample(places, 2) if p]) for i in range(150)]
    frame = spark.createDataFrame(rows, PROBE)
    got = {r["mention_id"]: (r["decision"], round(r["score_total"], 9), r["author_id"]) for r in incremental.replay(frame, 0.7, 0.3).collect()}
    want = plain_replay(incremental._normal(frame).toPandas(), 0.7, 0.3)
    assert got == {r.mention_id: (r.decision, round(r.score_total, 9), r.author_id) for r in want.itertuples()}
    assert {d for d, _, _ in got.values()} == {"merge", "new", "unknown"}


def test_fold_keeps_short_lists_and_its_scores(monkeypatch):
    """All mentions of one surname: a key's list holds no more authors than can be candidates, and equal mentions are not scored anew."""
    made, ratio = [], incremental.name_ratio
    monkeypatch.setattr(incremental, "name_ratio", lambda a, b: made.append((a, b)) or ratio(a, b))
    fold = incremental._Fold(0.9, 0.1, {"name": 0.5, "coauthors": 0.3, "journals": 0.2}, 10, 4)
    names = [f"{a}{b} lee" for a in ("ann", "bob", "cy") for b in "abcd"]
    row = namedtuple("row", "mention_id seq name norm orcid coauthors journals surname initial blocks")
    got = [fold.decide(row(f"m{i}", i, names[i % 12], names[i % 12], "", [], ["P"], "lee", "lee_" + names[i % 12][0], ["mit"])) for i in range(600)]
    assert max(map(len, fold.index.values())) <= 10 and len(fold.index["affil:mit"]) == 4
    assert got[-1][5] == 10 and len(made) == len(set(made)) <= 144


def test_streaming_micro_batches(spark, tmp_path):
    one = [("m1", 1, "Ann Lee", "", ["Bob"], ["Nature"], ["MIT"]), ("m2", 2, "Zed Xu", "", [], ["Cell"], [])]
    two = [("m3", 3, "Ann Lee", "", ["Bob"], ["Nature"], ["ETH"]), ("m4", 4, "Q Roe", "", [], [], [])]
    for k, rows in enumerate((one, two)):
        spark.createDataFrame(rows, PROBE).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        sink = micro_batches.Disambiguator(spark, f"{tmp_path}/out", accept=0.9, reject=0.2)
        micro_batches.run(micro_batches.stream_mentions(spark, f"{tmp_path}/in"), sink, f"{tmp_path}/check").awaitTermination()
    d = {r["mention_id"]: r["decision"] for r in sink.decisions().collect()}
    assert d == {"m1": "new", "m2": "new", "m3": "merge", "m4": "new"}
    last = {r["canonical_name"]: r["affiliations"] for r in sink.authors(1).collect()}
    assert last == {"Ann Lee": ["ETH", "MIT"], "Zed Xu": [], "Q Roe": []}
    timed = spark.createDataFrame([("2024-01-01 00:01:00", "new"), ("2024-01-01 00:02:00", "new"), ("2024-01-01 00:07:00", "merge")], "ts string, decision string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert sorted((r["decision"], r["n"]) for r in micro_batches.decision_rates(timed).collect()) == [("merge", 1), ("new", 2)]


# ---- sources and sinks -------------------------------------------------------

def test_sources(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text(json.dumps({"mention_id": "a", "raw_name": "Ann", "year": "2020", "coauthors": ["B"]}) + "\n\n" + json.dumps({"mention_id": "b", "orcid": None}) + "\n")
    rows = {r["mention_id"]: r for r in readers.mentions_jsonl(spark, f"{tmp_path}/m.jsonl").where("mention_id <> ''").collect()}
    assert rows["a"]["coauthors"] == ["B"] and rows["b"]["orcid"] == "" and rows["b"]["coauthors"] == []
    (tmp_path / "c.json").write_text(json.dumps({"metadata": {"n": 1}, "clusters": {"x": ["a", "b"]}}))
    (tmp_path / "d.json").write_text(json.dumps({"x": ["a"], "y": ["b"]}))
    assert readers.clusters_json(spark, f"{tmp_path}/c.json").count() == 2 and {r["cluster_id"] for r in readers.clusters_json(spark, f"{tmp_path}/d.json").collect()} == {"x", "y"}
    (tmp_path / "s.json").write_text(json.dumps({"splits": {"dev": {"orcids": ["o"], "mention_ids": []}}}))
    assert tuple(readers.splits_json(spark, f"{tmp_path}/s.json").first()) == ("o", "dev")
    people = [{"original_name": n, "doi": "10.1/x"} for n in ("Ann Lee", " ", "Bob Roy")]
    (tmp_path / "a.json").write_text(json.dumps({"authors": people}))
    (tmp_path / "b.json").write_text(json.dumps(people))
    for name in ("a", "b"):
        ms = readers.mentions_from_authors(readers.author_dump(spark, f"{tmp_path}/{name}.json")).collect()
        assert [m["_original_index"] for m in ms] == [0, 2]
    assert readers.author_dump(spark, f"{tmp_path}/a.json", 2).count() == 2
    import hashlib

    assert ms[0]["mention_id"] == hashlib.md5(b"10.1/x_0_Ann Lee").hexdigest()[:12]
    art = [{"DOI": "https://doi.org/10.1/a", "container-title": ["Nature"], "published": {"date-parts": [[2020, 1]]}, "title": ["T"], "author": [{"given": "Ann", "family": "Lee", "ORCID": "http://orcid.org/o", "affiliation": [{"name": "MIT"}]}, {"family": "Roy"}, {}]}]
    (tmp_path / "art.json").write_text(json.dumps(art))
    got = readers.article_mentions(readers.articles(spark, f"{tmp_path}/art.json")).orderBy("position").collect()
    assert [g["name"] for g in got] == ["Ann Lee", "Roy", "Unknown Author"] and got[0]["orcid"] == "o" and got[0]["affiliations"] == ["MIT"] and got[0]["coauthors"] == ["Roy", "Unknown Author"] and got[0]["year"] == 2020
    (tmp_path / "x.csv").write_text("name,f1\na,0.5\nb,n/a\n")
    assert [r["f1"] for r in readers.metrics_csv(spark, f"{tmp_path}/x.csv", ("f1",)).orderBy("name").collect()] == [0.5, None]
    (tmp_path / "dois.json").write_text(json.dumps(["", "https://doi.org/10.1/a", "10.1/b"]))
    dois = readers.doi_list(spark, f"{tmp_path}/dois.json")
    assert [r["doi"] for r in dois.orderBy("place").collect()] == ["10.1/a", "10.1/b"]
    (tmp_path / "ids.txt").write_text("a\n\n b \n")
    assert {r["mention_id"] for r in readers.id_list(spark, f"{tmp_path}/ids.txt").collect()} == {"a", "b"}
    spark.dataSource.register(readers.DoiLookup)
    assert spark.read.format("doi_lookup").options(dois="10.1/a,10.1/b", batch=1).load().count() == 0
    found = readers.batch_lookup(dois, lambda d: ("T", "J", 2020) if d.endswith("a") else None)
    assert [tuple(r) for r in found.collect()] == [("10.1/a", "T", "J", 2020)]


def test_sinks(spark, tmp_path):
    c = clusters(spark, "ab", "c")
    writers.clusters_json(c, f"{tmp_path}/c")
    assert spark.read.json(f"{tmp_path}/c").count() == 2
    assert json.loads(writers.clusters_document(c, {"method": "fini"}).first()["document"]) == {"metadata": {"method": "fini"}, "clusters": {"c0": ["a", "b"], "c1": ["c"]}}
    writers.append_jsonl(c, f"{tmp_path}/j")
    writers.append_jsonl(c, f"{tmp_path}/j")
    assert spark.read.json(f"{tmp_path}/j").count() == 6
    m = spark.createDataFrame([("fini_x", 0.5), ("aini", 0.75)], "method string, f1 double")
    writers.metrics_csv(m, f"{tmp_path}/m")
    assert readers.metrics_csv(spark, f"{tmp_path}/m", ("f1",)).count() == 2
    tex = writers.latex_table(m, [F.desc("f1")], {"method": "Method", "f1": "F1"}, top=1)
    assert "aini & 75.0" in tex and "fini" not in tex
    assert writers.engine_state(m, m.limit(1), m.limit(0)).count() == 3


# ---- registered queries ------------------------------------------------------

def test_every_query_has_the_columns_of_its_sql(spark, sf_dir):
    import duckdb

    import __spark_entry__ as entry
    from authorloom.plans import catalog

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    sql = catalog.oracle_sql()
    assert set(sql) <= set(entry.queries())
    for name in ("name_keys", "title_norm", "fini_clusters", "b_cubed", "pairwise", "blocking_candidates", "three_way_decision", "dedup_doi_title", "coauthor_edges", "stress_names"):
        got = catalog.queries()[name](spark, sf_dir)
        want = con.execute(sql[name]).fetchall()
        names = [d[0] for d in con.description]
        key = lambda r: tuple(str(x) for x in r)
        assert sorted(got.columns) == sorted(names)
        assert sorted(map(key, (tuple(r) for r in got.select(*names).collect()))) == sorted(map(key, want)), name


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0


def test_adapter_mentions(spark, sf_dir):
    m = adapter.mentions(spark, sf_dir)
    n = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    assert m.count() == n == m.select("mention_id").distinct().count()


def test_replay_query_uses_all_features(spark):
    """Leaving out co-authors or affiliations, or forgetting those that merges add, changes the query's decisions or candidates."""
    from authorloom.plans import adapter, catalog

    sf_dir = "/root/testdata/sf0.01"  # with ORCIDs that several customers share
    rows = incremental._normal(adapter.chinese_probes(spark, sf_dir)).toPandas()

    def rolled(rows):
        out = plain_replay(rows, 0.6, 0.2)
        return {k: (len(g), g.author_id.nunique(), int(g.candidate_count.sum()), round(g.score_total.mean(), 5)) for k, g in out.groupby("decision")}

    got = {r["decision"]: (r["n"], r["authors"], r["candidates"], round(r["mean_score"], 5)) for r in catalog.queries()["incremental_replay"](spark, sf_dir).collect()}
    assert got == rolled(rows) and "merge" in got
    for left_out in ("coauthors", "blocks", "journals", "orcid"):
        less = rows.copy()
        less[left_out] = [""] * len(rows) if left_out == "orcid" else [[]] * len(rows)
        assert rolled(less) != got
