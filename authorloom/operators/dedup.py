"""Article deduplication: DOI, then normalised title, then fuzzy title."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import storage
from ..functions import similarity as S
from ..functions import text as T
from ..shipping import ship
from .components import components

FUZZY = 0.95


def _prepared(articles: DataFrame) -> DataFrame:
    """seq, doi, title (normalised); blanks are null so that they match nothing."""
    return articles.select("seq", F.nullif(T.normalize_doi("doi"), F.lit("")).alias("doi"), F.nullif(T.normalize_title("title"), F.lit("")).alias("title"))


def _followers(rows: DataFrame, by: str) -> DataFrame:
    """seq, kept: later articles with the same value, and the first of them."""
    first = rows.where(F.col(by).isNotNull()).groupBy(by).agg(F.min("seq").alias("kept"))
    return rows.join(first, by).where("seq > kept").select("seq", "kept")


def exact(articles: DataFrame) -> DataFrame:
    """seq, kept, reason (doi or title): articles that repeat an earlier one exactly.

    The DOI decides first; titles are compared among articles that no DOI match
    has taken out, as only kept articles are indexed.
    """
    rows = storage.cut(_prepared(articles), "articles")
    by_doi = _followers(rows, "doi").withColumn("reason", F.lit("doi"))
    left = rows.join(by_doi.select("seq"), "seq", "left_anti")
    by_title = _followers(left, "title").withColumn("reason", F.lit("title"))
    return by_doi.union(by_title)


def fuzzy_pairs(titles: DataFrame, least: float = FUZZY, mode: str = "indel") -> DataFrame:
    """(a, b) of titles (column title, distinct) with a ratio of ``least`` or more, a < b.

    Two ways to ratio: ``indel`` (edits) or ``token`` (word sets). For token
    sets, similar ones share one of the rarest words of each (prefix filter, ``_token_pairs``).
    For indel, they share one of the rarest character grams of each (``_gram_pairs``); of titles
    too short for that, the longer holds a segment of the shorter, up to a shift (``_segments``).
    Either way candidates come from an equi-join and the ratio is verified.
    """
    if mode == "token":
        return _token_pairs(titles, least)
    size = F.length("title")
    q = _gram_size(least)
    short = _shortest_by_grams(least, q) - 1 if q else None
    own, looked = _segments(titles, least, short)
    n, m = F.length("x"), F.length("y")
    met = own.withColumnRenamed("title", "x").join(looked.withColumnRenamed("title", "y"), "key").where((n < m) | ((n == m) & (F.col("x") < F.col("y")))).select("x", "y")
    if q:
        met = met.union(_gram_pairs(titles.where(size > short), least, q))
    # edits that may substitute are never more than those that insert and delete; of long titles the ratio is as quick
    near = met.where((n + m > _LONG) | (F.levenshtein("x", "y") <= (1 - least) * (n + m) + _SLACK))
    pairs = near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    return pairs.where(S.indel_ratio_udf(titles.sparkSession)("a", "b") >= least)


#: Two titles of more characters than this are not tried by ``levenshtein`` first.
_LONG = 200
#: Characters are counted in so many classes, grams in 2 to the power of so many.
_CLASSES, _COUNTED = 16, 20


def _gram_size(least: float) -> int:
    """How long grams are, 0 if ``least`` allows too many edits for them."""
    rate = 2 * (1 - least) / least
    q = min(6, int(0.75 / rate)) if rate > 0 else 6
    return q if q >= 3 else 0


def _edits(size: int, least: float) -> int:
    """The most insertions and deletions between a title of a size and any within the ratio."""
    return int((1 - least) * (size + int(size * (2 - least) / least + _SLACK)) + _SLACK)


def _shortest_by_grams(least: float, q: int) -> int:
    """From this size on, a title always has more disjoint grams than there can be edits."""
    size = q * int(2 / (1 / q - 2 * (1 - least) / least) + 2)
    while size and size // q > _edits(size, least):
        size -= 1
    return size + 1


def _rarest(order, q: int, edits: int) -> int:
    """How many of the positions in ``order`` it takes until ``edits`` + 1 of them start disjoint grams."""
    low, high = edits + 1, len(order)
    while low < high:
        k = (low + high) // 2
        found, free = 0, 0
        for i in sorted(order[:k]):
            if i >= free:
                found, free = found + 1, i + q
        low, high = (low, k) if found > edits else (k + 1, high)
    return low


def _grams(title: str, q: int):
    """64-bit hashes of a title's grams of ``q`` characters, in order."""
    c = np.frombuffer(title.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    h = np.zeros(max(0, len(c) - q + 1), np.uint64)
    for k in range(q):
        h = (h ^ c[k : len(c) - q + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def _gram_pairs(titles: DataFrame, least: float, q: int) -> DataFrame:
    """(x, y) candidates for a ratio of ``least`` among titles that ``_shortest_by_grams`` admits.

    An edit spoils only grams that meet, so of d + 1 disjoint grams one outlives d edits. Of each title
    the rarest grams are dealt out until d + 1 of them are disjoint: then two titles within d
    edits share one of these (the one whose last is the rarer has it among its own), and
    it moves by at most as many places as there are edits of one kind. Any order by rarity
    that is the same for all will do: grams are counted in classes of their hash. Titles are
    numbered; pairs that share a gram go on if their characters, counted in
    classes, allow the ratio. So keys grow with a title's length.
    """
    spark = titles.sparkSession
    ship(spark)
    rows = storage.cut(titles.select(F.monotonically_increasing_id().alias("id"), "title"), "titles")

    def count(batches):
        total = np.zeros(1 << _COUNTED, np.int64)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                np.add.at(total, (_grams(t, q) >> np.uint64(64 - _COUNTED)).astype(np.int64), 1)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["c", "n"])

    counted = rows.select("title").mapInArrow(count, "c long, n long").groupBy("c").agg(F.sum("n").alias("n")).toPandas()  # 2 ** _COUNTED rows at most
    table = np.zeros(1 << _COUNTED, np.int64)
    table[counted["c"].to_numpy(np.int64)] = counted["n"].to_numpy(np.int64)
    known = spark.sparkContext.broadcast(table)

    def deal(batches):
        for batch in batches:
            out = {c: [] for c in ("id", "n", "key", "i")}
            for one, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                h = _grams(t, q)
                order = np.lexsort((h, known.value[(h >> np.uint64(64 - _COUNTED)).astype(np.int64)]))
                k = _rarest(order.tolist(), q, _edits(len(t), least))
                while k < len(order) and h[order[k]] == h[order[k - 1]]:
                    k += 1
                i = order[:k]
                out["id"].append(np.full(k, one, np.int64))
                out["n"].append(np.full(k, len(t), np.int32))
                out["key"].append(h[i].view(np.int64))
                out["i"].append(i.astype(np.int32))
            if out["id"]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in out.values()], names=list(out))

    def classes(batches):
        for batch in batches:
            made = np.zeros((batch.num_rows, _CLASSES), np.int32)
            for row, t in zip(made, batch.column(1).to_pylist(), strict=True):
                row += np.bincount(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4") % _CLASSES, minlength=_CLASSES).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, np.ascontiguousarray(made.T))], names=["id", *[f"c{k}" for k in range(_CLASSES)]])

    keys = storage.cut(rows.mapInArrow(deal, "id long, n int, key long, i int"), "grams")
    n, m, i, j = (F.col(c) for c in ("n", "m", "i", "j"))
    edits = F.floor((1 - least) * (n + m) + _SLACK)
    once = (n < m) | ((n == m) & (F.col("id") < F.col("id2")))
    moved = (2 * (j - i) <= edits + m - n) & (2 * (i - j) <= edits - m + n)
    other = keys.select("key", F.col("id").alias("id2"), n.alias("m"), i.alias("j"))
    met = storage.cut(keys.join(other, "key").where(once & (m - n <= edits) & moved).select("id", "id2").distinct(), "met")
    storage.discard(keys)
    bags = storage.cut(rows.mapInArrow(classes, "id long, " + ", ".join(f"c{k} int" for k in range(_CLASSES))), "bags")
    both = met.join(bags, "id").join(bags.select(F.col("id").alias("id2"), *[F.col(f"c{k}").alias(f"e{k}") for k in range(_CLASSES)]), "id2")
    apart = sum((F.abs(F.col(f"c{k}") - F.col(f"e{k}")) for k in range(_CLASSES)), F.lit(0))
    sizes = sum((F.col(f"c{k}") + F.col(f"e{k}") for k in range(_CLASSES)), F.lit(0))
    likely = both.where(apart <= (1 - least) * sizes + _SLACK).select("id", "id2")
    return likely.join(rows.withColumnRenamed("title", "x"), "id").join(rows.select(F.col("id").alias("id2"), F.col("title").alias("y")), "id2").select("x", "y")


#: For bounds that are products of doubles.
_SLACK = 1e-9
#: Words of 64 bits in a digest of a title's words.
_DIGEST = 4


def _token_pairs(titles: DataFrame, least: float) -> DataFrame:
    """``fuzzy_pairs`` by word sets.

    Words are hashes, ordered by how many titles have them. Similarity t needs a common
    word among the n - ceil(t n) + 1 rarest of each. A pair is tried where the
    word, with i and j rarer ones before it, could be the first they share: then they share min(n - i, m - j)
    at most, and t (n + m) / (1 + t) are needed. Digests, parities of the words' bits, differ in no
    more bits than the sets in words; pairs over the bound, (1 - t) (n + m) / (1 + t), go
    before the sets are compared. Titles are numbered and join last.
    """
    words = F.array_distinct(F.filter(F.split(F.lower("title"), r"\s+"), lambda w: w != ""))
    rows = storage.cut(titles.select(F.monotonically_increasing_id().alias("id"), "title"), "titles")
    spread = rows.select("id", F.explode(F.transform(words, lambda w: F.xxhash64(w))).alias("w"))
    ordered = spread.join(spread.groupBy("w").agg(F.count("*").alias("df")), "w").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "w"))).alias("ws"))
    bits = [F.expr(f"aggregate(words, 0L, (x, w) -> x ^ IF((w & {_DIGEST - 1}) = {k}, shiftleft(1L, CAST(shiftrightunsigned(w, 8) & 63 AS INT)), 0L))").alias(f"d{k}") for k in range(_DIGEST)]
    sets = storage.cut(ordered.select("id", F.size("ws").alias("n"), F.col("ws.w").alias("words")).select("*", *bits), "words")
    met = _token_candidates(sets, least)
    n, m = F.col("n"), F.col("m")
    full = met.join(sets.select("id", "n", "words"), "id").join(sets.select(F.col("id").alias("id2"), n.alias("m"), F.col("words").alias("others")), "id2")
    shared = F.size(F.array_intersect("words", "others"))
    good = full.where(shared / (n + m - shared) >= least).select("id", "id2")
    named = good.join(rows.withColumnRenamed("title", "x"), "id").join(rows.select(F.col("id").alias("id2"), F.col("title").alias("y")), "id2")
    return named.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def _token_candidates(sets: DataFrame, least: float) -> DataFrame:
    """(id, id2) of sets (id, n, words in order, digest) that could be alike by ``least``, the smaller first."""
    digest = [f"d{k}" for k in range(_DIGEST)]
    first = (F.col("n") - F.ceil(F.col("n") * least - _SLACK) + 1).cast("int")
    keys = sets.select("id", "n", *digest, F.posexplode(F.slice("words", F.lit(1), first)).alias("i", "key"))
    right = keys.select("key", F.col("id").alias("id2"), F.col("n").alias("m"), F.col("i").alias("j"), *[F.col(d).alias(f"other_{d}") for d in digest])
    n, m = F.col("n"), F.col("m")
    once = (n < m) | ((n == m) & (F.col("id") < F.col("id2")))
    able = F.least(n - F.col("i"), m - F.col("j")) >= (n + m) * (least / (1 + least)) - _SLACK
    apart = sum((F.bit_count(F.col(d).bitwiseXOR(F.col(f"other_{d}"))) for d in digest), F.lit(0))
    near = apart <= (n + m) * ((1 - least) / (1 + least)) + _SLACK
    return keys.join(right, "key").where(once & (n >= m * least - _SLACK) & able & near).select("id", "id2").distinct()


def _segments(titles: DataFrame, least: float, longest: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(title, key) of own segments and of those looked up: of titles within the ratio, the longer looks up one of the shorter's.

    A ratio of t over lengths n <= m allows d = (1 - t)(n + m) insertions and
    deletions, and m <= n (2 - t) / t. Cut the shorter into d + 1 segments: one
    survives whole and moves by at most d places. The longer looks its segments
    up at all shifts, for every length the shorter may have, ``longest`` at most.
    """
    n = F.length("title")
    top = n
    if longest is not None:
        titles = titles.where(F.ceil(n * least / (2 - least) - _SLACK) <= longest)
        top = F.least(n, F.lit(longest))
    most = lambda size: F.floor((1 - least) * (size + F.floor(size * (2 - least) / least + _SLACK)) + _SLACK).cast("int")
    indexed = (titles if longest is None else titles.where(n <= longest)).select("title", n.alias("n"), (most(n) + 1).alias("parts"))
    cut_at = lambda size, parts, i: F.floor(size * i / parts).cast("int")
    own = indexed.select("title", F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda i: F.xxhash64("n", i, F.substring("title", cut_at(F.col("n"), F.col("parts"), i) + 1, cut_at(F.col("n"), F.col("parts"), i + 1) - cut_at(F.col("n"), F.col("parts"), i))))).alias("key"))
    shortest = F.ceil(n * least / (2 - least) - _SLACK).cast("int")
    probes = titles.select("title", F.explode(F.sequence(F.greatest(shortest, F.lit(1)), top)).alias("s")).withColumn("parts", most(F.col("s")) + 1)
    probes = probes.select("title", "s", "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("i"), (F.col("parts") - 1).alias("d"))
    a, b = cut_at(F.col("s"), F.col("parts"), F.col("i")), cut_at(F.col("s"), F.col("parts"), F.col("i") + 1)
    probes = probes.select("title", "s", "i", a.alias("a"), (b - a).alias("w"), F.explode(F.sequence(-F.col("d"), F.col("d"))).alias("shift")).where((F.col("a") + F.col("shift") >= 0) & (F.col("a") + F.col("shift") + F.col("w") <= F.length("title")))
    looked = probes.select("title", F.xxhash64("s", "i", F.substring("title", F.col("a") + F.col("shift") + 1, F.col("w"))).alias("key"))
    return own, looked.distinct()


def fuzzy(articles: DataFrame, least: float = FUZZY, mode: str = "indel") -> DataFrame:
    """seq, kept, ratio group: articles whose title is alike an earlier one's, by connected groups.

    Distinct titles are compared. Each article after the first of its group
    repeats the group's first. (A strictly sequential replay, where a duplicate
    never becomes a match for others, can keep more.)
    """
    rows = storage.cut(_prepared(articles).where("title IS NOT NULL"), "titles")
    titles = storage.cut(rows.groupBy("title").agg(F.min("seq").alias("first")), "distinct_titles")
    edges = fuzzy_pairs(titles.select("title"), least, mode).select(F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b"))
    named = titles.withColumn("node", F.xxhash64("title")).join(components(edges), "node", "left").select("title", "first", F.coalesce("root", "node").alias("root"))
    first = named.groupBy("root").agg(F.min("first").alias("kept"))
    return rows.join(named.join(first, "root").select("title", "kept"), "title").where("seq > kept").select("seq", "kept")


def unique(articles: DataFrame, least: float = FUZZY, mode: str = "indel") -> DataFrame:
    """The articles that no stage takes for a repeat."""
    gone = exact(articles).select("seq")
    left = articles.join(gone, "seq", "left_anti")
    return left.join(fuzzy(left, least, mode).select("seq"), "seq", "left_anti")


def stats(articles: DataFrame) -> DataFrame:
    """total, with_doi, with_title, duplicates by reason: one row."""
    rows = _prepared(articles)
    totals = rows.agg(F.count("*").alias("total"), F.count("doi").alias("with_doi"), F.count("title").alias("with_title"))
    found = exact(articles).agg(F.count_if(F.col("reason") == "doi").alias("doi_duplicates"), F.count_if(F.col("reason") == "title").alias("title_duplicates"))
    return totals.crossJoin(found)  # two tables of one row
