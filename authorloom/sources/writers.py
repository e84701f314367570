"""Sinks: cluster JSON, JSONL appends, metrics CSV, tables and engine state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def clusters_json(clusters: DataFrame, path: str) -> None:
    """One ``{"cluster_id", "mentions"}`` object a line, in as many files as there are partitions: readable at any size."""
    clusters.groupBy("cluster_id").agg(F.array_sort(F.collect_list("mention_id")).alias("mentions")).write.mode("overwrite").json(path)


def clusters_document(clusters: DataFrame, metadata: dict[str, str]) -> DataFrame:
    """``{metadata, clusters}`` as one JSON string: for exports that fit a document."""
    one = clusters.groupBy("cluster_id").agg(F.array_sort(F.collect_list("mention_id")).alias("ids")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("cluster_id", "ids")))).alias("clusters"))
    meta = F.create_map(*[F.lit(x) for kv in sorted(metadata.items()) for x in kv])
    return one.select(F.to_json(F.struct(meta.alias("metadata"), "clusters")).alias("document"))


def append_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def metrics_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def latex_table(rows: DataFrame, order: list, columns: dict[str, str], top: int = 10, places: int = 1) -> str:
    """A LaTeX tabular of the first ``top`` rows; doubles as percentages."""
    kinds = dict(rows.dtypes)
    lines = [" & ".join(columns.values()) + r" \\", r"\midrule"]
    for r in rows.orderBy(*order).limit(top).collect():
        cells = [f"{100 * r[c]:.{places}f}" if kinds[c] == "double" else str(r[c]).replace("_", r"\_") for c in columns]
        lines.append(" & ".join(cells) + r" \\")
    return "\n".join([rf"\begin{{tabular}}{{{'l' * len(columns)}}}", r"\toprule", *lines, r"\bottomrule", r"\end{tabular}"])


def engine_state(authors: DataFrame, statistics: DataFrame, graph: DataFrame) -> DataFrame:
    """Authors, statistics and graph rows as JSON strings (part, document)."""
    part = lambda name, df: df.select(F.lit(name).alias("part"), F.to_json(F.struct(*df.columns)).alias("document"))
    return part("author", authors).union(part("statistics", statistics)).union(part("graph", graph))


def svg_curve(points: list[tuple[float, float]], title: str, x: str = "recall", y: str = "precision", size: int = 400) -> str:
    """An HTML page with one curve over [0, 1] x [0, 1]; the points of a sweep are few."""
    at = lambda p: f"{40 + p[0] * size:.1f},{20 + (1 - p[1]) * size:.1f}"
    ticks = "".join(f'<text x="{40 + t * size / 4:.0f}" y="{size + 36}" font-size="10">{t / 4:.2f}</text><text x="4" y="{24 + (4 - t) * size / 4:.0f}" font-size="10">{t / 4:.2f}</text>' for t in range(5))
    dots = "".join(f'<circle cx="{at(p).split(",")[0]}" cy="{at(p).split(",")[1]}" r="3"/>' for p in points)
    frame = f'<rect x="40" y="20" width="{size}" height="{size}" fill="none" stroke="#888"/>'
    line = f'<polyline fill="none" stroke="#336" points="{" ".join(map(at, sorted(points)))}"/>'
    return f'<!DOCTYPE html><title>{title}</title><h1>{title}</h1><svg width="{size + 80}" height="{size + 60}">{frame}{line}{dots}{ticks}<text x="{size // 2}" y="{size + 52}">{x}</text><text x="44" y="14">{y}</text></svg>'
