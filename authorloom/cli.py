"""Command line: cluster, decide, evaluate, dedup.

    python -m authorloom.cli cluster --method fini mentions.jsonl out/
    python -m authorloom.cli decide --mode fs --accept 9 --reject -1 mentions/ authors/ out/
    python -m authorloom.cli evaluate --variant v2 gold.json pred.json out/
    python -m authorloom.cli dedup articles/ out/
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from . import config
from .operators import blocking, cluster, dedup, metrics, scoring
from .sources import readers, writers

METHODS = {"fini": cluster.fini, "aini": cluster.aini, "oracle": cluster.oracle, "heuristic": cluster.heuristic, "greedy-chinese": cluster.greedy_chinese}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="authorloom", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("cluster", help="cluster a mention file by a baseline method")
    c.add_argument("--method", choices=METHODS, default="fini")
    c.add_argument("mentions")
    d = sub.add_parser("decide", help="three-way decisions of mentions against authors (Parquet)")
    d.add_argument("--mode", choices=("baseline", "fs"), default="fs")
    d.add_argument("--accept", type=float, default=config.ACCEPT)
    d.add_argument("--reject", type=float, default=config.REJECT)
    d.add_argument("--max-candidates", type=int, default=config.MAX_CANDIDATES)
    d.add_argument("--weights", nargs=3, type=float, metavar=("NAME", "COAUTHORS", "JOURNALS"), default=list(config.WEIGHTS.values()))
    d.add_argument("--mu-table", help="JSON or YAML m/u values; the built-in ones if absent")
    d.add_argument("mentions")
    d.add_argument("authors")
    e = sub.add_parser("evaluate", help="metrics of predicted against gold clusters")
    e.add_argument("--variant", choices=("v1", "v2", "v3"), default="v1")
    e.add_argument("gold")
    e.add_argument("predicted")
    u = sub.add_parser("dedup", help="articles (Parquet: seq, doi, title) without repeats")
    u.add_argument("--ratio", choices=("indel", "token"), default="indel")
    u.add_argument("--least", type=float, default=dedup.FUZZY)
    u.add_argument("articles")
    for s in (c, d, e, u):
        s.add_argument("out")
    return p


def run(spark: SparkSession, args: argparse.Namespace) -> DataFrame | None:
    """Carry out one command; returns what it wrote as a table, if it did."""
    if args.command == "cluster":
        writers.clusters_json(METHODS[args.method](readers.mentions_jsonl(spark, args.mentions)), args.out)
        return None
    if args.command == "decide":
        weights = dict(zip(config.WEIGHTS, args.weights, strict=True))
        settings = config.engine_config(weights=weights, accept=args.accept, reject=args.reject, mode=args.mode, max_candidates=args.max_candidates)
        mentions, authors = spark.read.parquet(args.mentions), spark.read.parquet(args.authors)
        pairs = scoring.pairs_of(mentions, authors, blocking.candidate_lists(mentions, authors, settings["max_candidates"]))
        scores = scoring.scored(scoring.compare(pairs), settings["mode"], weights, config.mu_table(args.mu_table))
        out = scoring.decide(mentions, scores, settings["accept"], settings["reject"])
    elif args.command == "evaluate":
        out = metrics.all_metrics(readers.clusters_json(spark, args.gold), readers.clusters_json(spark, args.predicted), args.variant)
    else:
        out = dedup.unique(spark.read.parquet(args.articles), args.least, args.ratio)
    out.write.mode("overwrite").parquet(args.out)
    return spark.read.parquet(args.out)


def main() -> None:
    args = parser().parse_args()
    spark = SparkSession.builder.appName("authorloom").getOrCreate()
    run(spark, args)
    spark.stop()


if __name__ == "__main__":
    main()
