"""The registered queries of this subpackage: one for each operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, decontam, fingerprints, lang_id, line_dedup, packing, quality, simhash, substring_dedup, tokens, url_filter


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _remainder(n: int):
    return F.crc32(F.col("doc_id").cast("string")) % n


def url_captures(pages: DataFrame) -> DataFrame:
    """Captures with a fetch time: pages carry none, so it follows from page_id (a day within two years)."""
    day = F.pmod(F.col("page_id") * 37, F.lit(730)).cast("int")
    return pages.select("page_id", "url", F.date_add(F.lit("2023-01-01").cast("date"), day).cast("timestamp").alias("fetch_ts"))


def url_events(pages: DataFrame) -> DataFrame:
    """Dated list entries on the pages' own hosts, by the remainder of a number from the host's MD5: a
    block list adds a fifth, drops them half a year later and adds them again
    after another; an allow list names a tenth from a day on."""
    hosts = pages.select(url_filter.host_of(F.col("url")).alias("pattern")).where("pattern <> ''").distinct()
    c = F.conv(F.substring(F.md5("pattern"), 1, 6), 16, 10).cast("long")
    start = (c % 400).cast("int")
    event = lambda lst, action, added, after: F.struct(F.lit(lst).alias("list"), F.lit(action).alias("action"), F.lit(added).alias("added"), F.date_add(F.lit("2023-01-01").cast("date"), start + after).cast("timestamp").alias("ts"))
    blocked = F.when(c % 5 == 0, F.array(event("block", "block", True, 0), event("block", "block", False, 180), event("block", "block", True, 360)))
    allowed = F.when(c % 10 == 5, F.array(event("allow", "allow", True, 30)))
    none = F.array().cast("array<struct<list:string,action:string,added:boolean,ts:timestamp>>")
    return hosts.select("pattern", F.explode(F.concat(F.coalesce(blocked, none), F.coalesce(allowed, none))).alias("e")).select("pattern", "e.*")


def op1_url_filter(spark, sf_dir):
    pages = _read(spark, sf_dir, "pages")
    return url_filter.filter_urls(url_captures(pages), url_events(pages))


def op2_language_id(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = lang_id.train(docs.where(_remainder(5) != 0))
    return lang_id.identify(docs, model).select("doc_id", (_remainder(5) == 0).alias("held_out"), "lang_pred", "score", "n_spans")


def op3_simhash(spark, sf_dir):
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op4_token_store(spark, sf_dir):
    folder = common.scratch(spark, "store")
    return tokens.write_store(_read(spark, sf_dir, "documents"), folder, tokens.tokenizer_path()).documents()


def op5_substring_dedup(spark, sf_dir):
    return substring_dedup.repeats(_read(spark, sf_dir, "documents"))


def op6_packing(spark, sf_dir):
    return packing.pack_documents(_read(spark, sf_dir, "documents"), tokens.tokenizer_path())


def op7_quality(spark, sf_dir):
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.where(_remainder(3) != 1))
    return quality.score(docs, model).select("doc_id", (_remainder(3) == 1).alias("held_out"), "score", "predicted")


def op8_decontamination(spark, sf_dir):
    return decontam.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op9_fingerprints(spark, sf_dir):
    return fingerprints.edit_study(_read(spark, sf_dir, "documents"))


def op10_line_dedup(spark, sf_dir):
    out = line_dedup.report(_read(spark, sf_dir, "documents"))
    joined = lambda c: F.coalesce(F.array_join(F.transform(c, lambda x: x.cast("string")), ","), F.lit(""))
    return out.select("doc_id", "n_lines", "n_dropped", "n_near", joined("dropped").alias("dropped"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_url_filter, op2_language_id, op3_simhash, op4_token_store, op5_substring_dedup, op6_packing, op7_quality, op8_decontamination, op9_fingerprints, op10_line_dedup)}


_HOST = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1))"
#: Captures and list entries as in url_captures and url_events.
OP1_SQL = f"""WITH cap AS (SELECT page_id, DATE '2023-01-01' + CAST((page_id * 37) % 730 AS INTEGER) AS d, {_HOST} AS host,
  list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS steps FROM pages),
h AS (SELECT host AS pattern, c, DATE '2023-01-01' + CAST(c % 400 AS INTEGER) AS d0 FROM (SELECT DISTINCT host, CAST('0x' || substr(md5(host), 1, 6) AS BIGINT) AS c FROM cap WHERE host <> '')),
valid AS (SELECT pattern, 'block' AS list, 'block' AS action, d0 AS lo, d0 + 180 AS hi FROM h WHERE c % 5 = 0
  UNION ALL SELECT pattern, 'block', 'block', d0 + 360, DATE '9999-01-01' FROM h WHERE c % 5 = 0
  UNION ALL SELECT pattern, 'allow', 'allow', d0 + 30, DATE '9999-01-01' FROM h WHERE c % 10 = 5),
keys AS (SELECT page_id, d, unnest(list_distinct(list_concat(list_transform(range(1, len(string_split(host, '.')) + 1), lambda i: array_to_string(string_split(host, '.')[i:], '.')), list_transform(range(1, len(steps) + 1), lambda i: host || '/' || array_to_string(steps[1:i], '/'))))) AS pattern FROM cap WHERE host <> ''),
met AS (SELECT page_id, list, action, pattern FROM keys JOIN valid USING (pattern) WHERE d >= lo AND d < hi QUALIFY row_number() OVER (PARTITION BY page_id, list ORDER BY length(pattern) DESC, pattern DESC) = 1),
best AS (SELECT page_id, min(action) AS action, count(*) AS n, arg_min(pattern, action || list) AS pattern FROM met GROUP BY page_id)
SELECT page_id, coalesce(host, '') AS host, coalesce(action, 'none') AS action, coalesce(n, 0) AS n_lists, best.pattern AS pattern FROM cap LEFT JOIN best USING (page_id)"""

#: A line goes if an earlier one is equal or, from 16 characters on, within one edit: some cut makes the texts before it, and those after one changed, added or lost character, equal.
OP10_SQL = """WITH l AS (SELECT doc_id, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS BIGINT) AS line, trim(unnest(string_split(text, chr(10)))) AS s FROM documents),
e AS (SELECT * FROM l WHERE s <> ''),
f AS (SELECT s, min((doc_id, line)) AS first FROM e GROUP BY s),
n AS (SELECT s, first, unnest([length(s), length(s) - 1]) AS n FROM f WHERE length(s) >= 16),
k AS (SELECT s, first, n, 0 AS q, right(s, n - n // 2) AS h FROM n UNION ALL SELECT s, first, n, 1, left(s, n // 2) FROM n),
p AS (SELECT DISTINCT a.s AS x, b.s AS y, b.first AS prev FROM k a JOIN k b USING (n, q, h) WHERE b.first < a.first AND abs(length(a.s) - length(b.s)) <= 1),
near AS (SELECT x AS s, min(prev) AS near FROM p WHERE len(list_filter(range(0, length(x) + 1), lambda i: left(x, i) = left(y, i)
  AND substr(x, i + 1 + CAST(length(x) >= length(y) AS INTEGER)) = substr(y, i + 1 + CAST(length(y) >= length(x) AS INTEGER)))) > 0 GROUP BY x),
d AS (SELECT doc_id, line, near IS NOT NULL AS is_near FROM e JOIN f USING (s) LEFT JOIN near USING (s) WHERE coalesce(near, first) < (doc_id, line)),
g AS (SELECT doc_id, count(*) AS n_dropped, count(*) FILTER (is_near) AS n_near, string_agg(CAST(line AS VARCHAR), ',' ORDER BY line) AS dropped FROM d GROUP BY doc_id)
SELECT doc_id, CAST(len(string_split(text, chr(10))) AS BIGINT) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, coalesce(n_near, 0) AS n_near, coalesce(dropped, '') AS dropped FROM documents LEFT JOIN g USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": OP1_SQL, "op10_line_dedup": OP10_SQL}
