"""The command line on small files, and reports."""

import json

import pytest

from authorloom import cli
from authorloom.exceptions import ConfigurationError
from authorloom.operators import blocking, scoring
from authorloom.sources import writers

from .test_engine import AUTHOR, PROBE


def call(spark, *args):
    return cli.run(spark, cli.parser().parse_args([str(a) for a in args]))


def test_cluster_and_evaluate(spark, tmp_path):
    rows = [{"mention_id": f"m{i}", "raw_name": n, "orcid": o} for i, (n, o) in enumerate([("Ann Lee", "1"), ("A Lee", "1"), ("Bob Roy", "2")])]
    (tmp_path / "m.jsonl").write_text("\n".join(map(json.dumps, rows)))
    call(spark, "cluster", "--method", "fini", tmp_path / "m.jsonl", tmp_path / "c")
    got = {r["cluster_id"]: r["mentions"] for r in spark.read.json(f"{tmp_path}/c").collect()}
    assert got == {"fini:lee_a": ["m0", "m1"], "fini:roy_b": ["m2"]}
    for name, value in (("g", {"x": ["m0", "m1"], "y": ["m2"]}), ("p", {"clusters": got})):
        (tmp_path / f"{name}.json").write_text(json.dumps(value))
    out = {r["metric"]: r["value"] for r in call(spark, "evaluate", tmp_path / "g.json", tmp_path / "p.json", tmp_path / "e").collect()}
    assert out["b3_f1"] == out["pairwise_f1"] == 1 and out["conflict_rate"] == 0


def test_decide_dedup_and_report(spark, tmp_path):
    m = spark.createDataFrame([("m1", 1, "Ann Lee", "", ["Bob"], ["Nature"], []), ("m2", 2, "Zed Xu", "", [], [], [])], PROBE)
    a = spark.createDataFrame([("a1", "Ann Lee", "", ["Bob"], ["Nature"], [], 1)], AUTHOR)
    m.write.parquet(f"{tmp_path}/m")
    a.write.parquet(f"{tmp_path}/a")
    got = call(spark, "decide", "--mode", "baseline", tmp_path / "m", tmp_path / "a", tmp_path / "d")
    assert {r["mention_id"]: r["decision"] for r in got.collect()} == {"m1": "merge", "m2": "new"}
    assert tuple(scoring.decision_stats(got).first()) == (2, 1, 1, 0, 0.5, 1)
    assert {r["decision"] for r in call(spark, "decide", "--accept", "5", "--reject", "0", tmp_path / "m", tmp_path / "a", tmp_path / "f").collect()} == {"merge", "new"}
    with pytest.raises(ConfigurationError):
        call(spark, "decide", "--accept", "0.1", "--reject", "0.5", tmp_path / "m", tmp_path / "a", tmp_path / "x")
    scores = scoring.scored(scoring.compare(scoring.pairs_of(m, a, blocking.candidate_lists(m, a))))
    assert "Total 1.000, threshold 0.85: merged" in scores.select(scoring.legacy_report()).first()[0]
    spark.createDataFrame([(1, "10.1/a", "T one"), (2, "10.1/a", "T two"), (3, "", "T one")], "seq long, doi string, title string").write.parquet(f"{tmp_path}/art")
    assert [r["seq"] for r in call(spark, "dedup", tmp_path / "art", tmp_path / "u").collect()] == [1]
    assert writers.svg_curve([(0.1, 0.9), (0.5, 0.5)], "PR").count("<circle") == 2
