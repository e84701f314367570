"""Goldens of normalisers, keys and similarities."""

import random

import pytest
from pyspark.sql import functions as F

from authorloom import config
from authorloom.exceptions import ConfigurationError
from authorloom.functions import chinese
from authorloom.functions import similarity as S
from authorloom.functions import text as T
from authorloom.operators import scoring


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("f", "value", "want"), [
    (T.normalize_name, "  J. A.  O'Smith ", "j a osmith"), (T.normalize_name, None, ""), (T.normalize_string, " Nature  Physics. ", "nature physics."),
    (T.normalize_affiliation, "Department of Physics, University of X!", "dept of physics univ of x"), (T.normalize_affiliation, "Ünïversity  Institute", "ünïversity inst"),
    (T.clean_orcid, " https://orcid.org/0000-1 ", "0000-1"), (T.normalize_doi, "https://doi.org/10.1/ABC ", "10.1/ABC"), (T.normalize_title, "The Genome of the Sea-Urchin!", "genome seaurchin"),
    (T.normalize_title, "", ""), (T.surname, "John A. Smith ", "Smith"), (T.surname, "  ", ""), (T.surname_initial, "John Smith", "smith_j"), (T.surname_initial, "Plato", "plato"), (T.surname_initial, None, ""),
    (T.fini_key, "Smith, John", "smith_j"), (T.aini_key, "Smith, John-Paul", "smith_jp"), (T.aini_key, "John-Paul Smith", "smith_j"), (T.fini_key, "Plato", "plato"), (T.fini_key, " ", ""),
    (T.heuristic_key, "John Smith", "smith_j"), (T.heuristic_key, "Plato", "plato"), (T.block_string, "Harvard Medical School", "harvard_medical_school"),
    (T.script, "Иванов Иван", "cyrillic"), (T.script, "李明", "cjk"), (T.script, "John Smith", "latin"), (T.script, "abиж", "mixed"), (T.script, "12", "other"), (T.script, "", "empty"),
])
def test_text(spark, f, value, want):
    assert one(spark, f("v"), v=value) == want


def test_redaction_goldens(spark):
    hashes = {"John Smith": "a2bb2b11fdc2d985", "Robert Johnson": "1c78a6a12b50ba7c", "J. A. Smith": "e64ef1d36ae8221c", "Harvard University": "b336230fc7950967"}
    for text, want in hashes.items():
        assert one(spark, T.salted_hash("v", config.SALT), v=text) == want
    assert one(spark, T.salted_hash("v", config.SALT, 12), v="Nature") == "edc6d74ff185"
    r = one(spark, T.redacted_name("v", config.SALT), v="J. A. Smith").asDict()
    assert r == {"hash": "e64ef1d36ae8221c", "tokens": 3, "length": 11, "script": "latin", "has_initial": False}


def test_chinese_predicate(spark):
    for name in ("Wang Xiaoming", "Zhang Wei", "Liu Y.", "Chen Hui", "Yang Jian-Ming", "Xiao-Hong Li", "Lin M."):
        assert one(spark, chinese.is_romanized_chinese("v"), v=name)
    for name in ("John Smith", "Maria Garcia", "Michael Brown", "", None):
        assert not one(spark, chinese.is_romanized_chinese("v"), v=name)
    assert one(spark, chinese.is_romanized_chinese("v", strict=True), v="Wang Xiaoming") and not one(spark, chinese.is_romanized_chinese("v", strict=True), v="Liu Y.")
    one_key, two_key = chinese.dual_keys("v")
    assert (one(spark, one_key, v="Wang Xiaoming"), one(spark, two_key, v="Wang Xiaoming")) == ("cn:wang_xia", "cn:xiaoming_wan")


@pytest.mark.parametrize(("a", "b", "want"), [("张三", "张三", 1.0), ("张三", "张珊", 0.5), ("", "x", 0.0), ("J. Smith", "John Smith", 0.7), ("J. A. Smith", "John Smith", 0.7), ("张三", "Zhang San", 0.0)])
def test_name_similarity(spark, a, b, want):
    assert one(spark, S.name_similarity("a", "b"), a=a, b=b) == pytest.approx(want)


def test_set_and_affiliation_similarity(spark):
    row = spark.createDataFrame([(["A b", "a  B", "c"], ["c", "d"], [], ["Harvard Medical School"], ["Harvard University"])], "x array<string>, y array<string>, e array<string>, p array<string>, q array<string>")
    got = row.select(S.jaccard(F.col("x"), F.col("y")), S.jaccard(F.col("e"), F.col("e")), S.jaccard(F.col("e"), F.col("e"), 0.0), S.jaccard(F.col("x"), F.col("e")), S.affiliation_similarity(F.col("p"), F.col("q")), S.affiliation_similarity(F.col("p"), F.col("p"))).first()
    assert list(got) == pytest.approx([1 / 3, 1, 0, 0, 0.40909090909090906, 1])


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_jaro_winkler_and_indel(spark):
    for a, b, want in (("john smith", "jon smyth", 0.917037), ("MARTHA", "MARHTA", 0.961111), ("Wei Chen", "Chen Wei", 0.583333), ("abcde", "bcdea", 0.866667), ("abxyz", "abqrs", 0.68), ("", "x", 0), ("a", "a", 1)):
        assert S.jaro_winkler(a, b) == pytest.approx(want, abs=1e-6)
    assert S.indel_ratio("genome sea urchin", "genome sea urchins") == pytest.approx(0.971429, abs=1e-6)
    rng = random.Random(2)
    for _ in range(300):
        a, b = ("".join(rng.choice("abcé") for _ in range(rng.randint(0, 12))) for _ in range(2))
        assert S.indel_ratio(a, b) == (2 * plain_lcs(a, b) / (len(a) + len(b)) if a or b else 1)
    rows = spark.createDataFrame([("john smith", "jon smyth"), (None, "x")], "a string, b string")
    assert [r[0] for r in rows.select(S.jaro_winkler_udf(spark)("a", "b")).collect()] == pytest.approx([0.917037, 0], abs=1e-6)
    assert [r[0] for r in rows.select(S.indel_ratio_udf(spark)("a", "a")).collect()] == [1, 1]


def test_config(tmp_path):
    with pytest.raises(ValueError):
        config.check_weights({"name": 0.5, "coauthors": 0.7, "journals": 0.2})
    with pytest.raises(ConfigurationError):
        config.engine_config(accept=0.1, reject=0.2)
    with pytest.raises(ConfigurationError):
        config.engine_config(other=1)
    assert config.engine_config(mode="fs", accept=9.0, reject=-1.0)["accept"] == 9.0
    assert scoring.log_ratio(0.95, 0.01) == pytest.approx(4.553877, abs=1e-6) and scoring.log_ratio(0, 0) == 0
    p = tmp_path / "mu.yaml"
    p.write_text("mu_table:\n  name_similarity:\n    exact: {m: 0.9, u: 0.1}\n")
    assert config.mu_table(str(p)) == {"name": {"exact": (0.9, 0.1)}} and config.mu_table() == config.MU
    p.write_text("mu_table:\n  name:\n    exact: {m: 1.9, u: 0.1}\n")
    with pytest.raises(ConfigurationError):
        config.mu_table(str(p))
    b = tmp_path / "bins.yaml"
    b.write_text("x:\n  bins:\n    - {name: same, max_diff: 0}\n    - {name: close, max_diff: 2}\n")
    assert config.bins_config(str(b))["x"][1]["name"] == "close"


def test_configured_bins(spark):
    from authorloom.operators.calibrate import BINS

    values = [(0.95,), (0.9499,), (0.85,), (0.7,), (0.0,), (1.0,)]
    got = spark.createDataFrame(values, "v double").select(scoring.configured_bin(F.col("v"), BINS["name_similarity"])).collect()
    assert [r[0] for r in got] == ["exact", "high", "high", "medium", "none", "exact"]
