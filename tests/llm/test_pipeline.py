"""The pipeline's stages on the smallest data, against plain versions of what each keeps."""

import corpus_pipeline
from pyspark.sql import functions as F

from authorloom.llm import decontam

from .test_jaccard import plain_groups
from .test_operators import ODD, check_pieces, docs_of, plain_drops


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        if name != "packing":
            assert out.columns == columns
            got = {r["doc_id"]: r["text"] for r in out.collect()}
        if name == "quality":
            wrong = [d for d, q in labels.items() if (d in got) != (q == 1)]
            assert len(wrong) <= 0.05 * len(labels)
        elif name == "line_dedup":
            lost = plain_drops([x for x in kept.items() if x[1] is not None])
            want = {d: "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in lost) for d, t in kept.items()}
            assert got == want
        elif name == "simhash":
            assert set(got) == set(plain_groups(list(kept.items())).values())
        elif name == "decontamination":
            bad = {r["doc_id"] for r in decontam.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
            assert set(got) == set(kept) - bad
        else:
            check_pieces(out.collect(), kept)
        docs, kept = out, got
    assert corpus_pipeline.run(spark, sf_dir).count() == out.count()


def test_stages_on_odd_input(spark, sf_dir, tmp_path):
    """Nulls, empty texts, repeated rows, rows without a key, a long text, clashing columns; then an empty table."""
    rows = docs_of(spark, [*ODD, (70, "a long text of many words. " * 9000)])
    clashing = ("_text", "_key", "root", "size", "h", "k", "first", "node", "_lost", "_doc", "_bad", "line", "s")
    rows = rows.select("*", *[F.lit(1).alias(c) for c in clashing if c not in rows.columns])
    for name, docs in (("odd", rows), ("none", rows.limit(0))):
        columns = docs.columns
        for k, (stage_name, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{name}{k}")
            docs = spark.read.parquet(f"{tmp_path}/{name}{k}")
            if stage_name != "packing":
                assert docs.columns == columns
            if stage_name == "line_dedup":  # drops lines only, except where rows share a key
                assert {r["doc_id"] for r in docs.collect()} <= {k for k, _ in ODD} | {70}
        assert (docs.count() > 0) == (name == "odd")


def test_stages_free_what_they_wrote(spark, sf_dir):
    from authorloom import storage

    out = corpus_pipeline.run(spark, sf_dir)
    owner = f"pipeline {spark.sparkContext.applicationId}"
    assert not [p for p, (_, o) in storage._written.items() if o == owner]
    assert out.count() > 0
    chained = corpus_pipeline.simhash_stage(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)
    again = corpus_pipeline.benchmark_stage(spark, chained, sf_dir)  # not written in between: what it reads stays
    assert again.count() > 0
