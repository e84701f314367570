"""Line deduplication by a deletion-neighbourhood join; DataFrame functions only.

A line is dropped if an earlier line (by document key, then place) has the same
text, or a text within one edit (a character changed, added or left out).
Lines are compared without leading and trailing blanks. One edit is a small part
of a line only if that is long: it counts between lines of ``LEAST`` characters
or more (a parameter), while equal lines of any length do. Blank lines stay.

1. Lines become 128-bit hashes; each distinct line knows its first place.
2. Lines within one edit have their first or their last half in common, for
   the shorter's length, and all but one of SECTORS sectors. Hashes of those
   tell which distinct lines can have such a neighbour at all, and where the
   edit would be; the rest goes no further.
3. There each line emits its neighbourhood as hashed keys, built from sums
   of character-and-place hashes: the line itself, the line with each place
   blanked, and the line with each character left out. Equal blanked keys are
   one change apart; a left-out key equal to another line's own key is one
   character apart.
4. For each key only the first places are kept (a pre-aggregated minimum), so
   no pairs within a group are made, and each line learns of its earliest
   neighbour. The edit distance to it is verified on the texts.

So the work is linear in the text, a line that fills a third of the corpus
included: joins with one row a key can be split.

Defined results: null and empty texts are kept as they are; rows without a key
are kept whole and not compared; the key names a document (rows that repeat a
key are treated alike); ties cannot occur, as places are unique; very long
lines take time in proportion to n * sqrt(n) at most; an empty table gives no
rows; other columns, whatever their names, are kept by ``remove`` and ignored
otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Characters from which on lines within one edit count as repeats.
LEAST = 16
#: Sectors of a line of which two neighbours differ in one.
SECTORS = 32


def _lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """doc_id, line (its number from 0), s (text without outer blanks), for lines that are not blank."""
    chosen = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc_id"), F.posexplode(F.split(F.col(text), "\n")).alias("line", "s"))
    return chosen.select("doc_id", "line", F.trim("s").alias("s")).where("s <> ''")


def _without(s: Column, n: Column, q: Column, parts: int) -> Column:
    """Hash of the line without sector q of ``parts`` equal ones, for n its length as that of the shorter or longer of a pair.

    Lines within one edit have one of these in common: that of the sector (of
    the shorter's length) with the edit, by the text before and after it.
    """
    edge = lambda k: F.floor(n * k / parts).cast("int")
    return F.xxhash64(n, q, F.substring(s, F.lit(1), edge(q)), F.right(s, n - edge(q + 1)))


def _halves(s: Column) -> Column:
    """Hashes without each half; compiled code, for all lines."""
    return F.array(*[_without(s, n, F.lit(q), 2) for n in (F.length(s), F.length(s) - 1) for q in range(2)])


def _sectors(s: Column) -> Column:
    """(n, q, h) of the line without each of SECTORS sectors."""
    every = F.sequence(F.lit(0), F.lit(SECTORS - 1))
    of = lambda n: F.transform(every, lambda q: F.struct(n.alias("n"), q.alias("q"), _without(s, n, q, SECTORS).alias("h")))
    return F.concat(of(F.length(s)), of(F.length(s) - 1))


def _shared(spread: DataFrame) -> DataFrame:
    """The rows whose hash h another line has too: distinct lines have each of their hashes once."""
    return spread.join(spread.groupBy("h").count().where("count > 1").select("h"), "h")


def _fold(array: Column) -> Column:
    return F.aggregate(array, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x))


def _settled(df: DataFrame, *columns: Column | str) -> DataFrame:
    """The columns, worked out once for each row: not again for each element of an array that a later step maps."""
    return df.select(F.explode(F.array(F.struct(*columns))).alias("v")).select("v.*")


def _variants(lines: DataFrame) -> DataFrame:
    """first, kind, key: the hashed neighbourhood of each line (first, s, n, q) at the places of sector q; kind 0 own, 1 blanked, 2 left out.

    With c(i) the hash of character i and place i, a line's sum is the
    exclusive-or of all c(i). Blanking place p takes c(p) out and adds the
    place. Leaving p out moves later characters one place down: c(i) before p
    and d(i), the hash of character i and place i - 1, after it.
    """
    letters = F.split("s", "")
    edge = lambda q: F.floor(F.col("n") * q / SECTORS).cast("int")
    size, lo, block = F.col("size"), F.col("lo"), F.col("block")
    last = F.least(edge(F.col("q") + 1), F.length("s") - 1)
    hashes = lambda shift: F.transform(letters, lambda ch, i: F.xxhash64(ch, i - shift))
    x = _settled(lines, "first", F.length("s").alias("size"), edge(F.col("q")).alias("lo"), last.alias("hi"), hashes(0).alias("c"), hashes(1).alias("d"))
    before, after = F.slice("c", F.lit(1), lo), F.slice("d", lo + 1, size)
    sector = lambda c: F.slice(c, lo + 1, F.col("hi") - lo + 1).alias(c)
    x = _settled(x, "first", "size", "lo", _fold(F.col("c")).alias("all"), _fold(before).bitwiseXOR(_fold(after)).alias("cd"), sector("c"), sector("d"))
    # running exclusive-ors of the sector's moved places, by blocks of some square root of its size
    both = F.zip_with("c", "d", lambda a, b: a.bitwiseXOR(b))
    x = _settled(x, *x.columns, both.alias("x"), F.greatest(F.lit(8), F.ceil(F.sqrt(F.size("c"))).cast("int")).alias("block"))
    numbers = F.sequence(F.lit(0), F.floor(F.size("x") / block).cast("int"))
    x = _settled(x, *x.columns, F.transform(numbers, lambda b: _fold(F.slice("x", b * block + 1, block))).alias("parts"))
    x = _settled(x, *x.columns, F.transform("parts", lambda _, b: _fold(F.slice("parts", F.lit(1), b))).alias("blocks"))

    def moved(i: Column) -> Column:
        at = F.floor(i / block).cast("int")
        return F.get("blocks", at).bitwiseXOR(_fold(F.slice("x", at * block + 1, i - at * block)))

    row = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.alias("key"))
    own = F.array(row(0, F.xxhash64(size, "all")))
    blanked = F.transform("c", lambda h, i: row(1, F.xxhash64(size, F.col("all").bitwiseXOR(h), lo + i)))
    out = F.transform("d", lambda h, i: row(2, F.xxhash64(size - 1, F.col("cd").bitwiseXOR(moved(i)).bitwiseXOR(h))))
    return x.select("first", F.explode(F.concat(own, blanked, out)).alias("v")).select("first", "v.kind", "v.key").distinct()


def _within_one(s: Column, r: Column) -> Column:
    """Whether two lines are within one edit: all of them but one sector is equal, and the edit distance there is at most 1."""
    n = F.least(F.length(s), F.length(r))
    edge = lambda k: F.floor(n * k / SECTORS).cast("int")
    around = lambda x, q: F.struct(F.substring(x, F.lit(1), edge(q)), F.right(x, n - edge(q + 1)))
    inside = lambda x, q: F.substring(x, edge(q) + 1, F.length(x) - n + edge(q + 1) - edge(q))
    near = lambda q: (around(s, q) == around(r, q)) & (F.levenshtein(inside(s, q), inside(r, q), 1) >= 0)
    return (F.abs(F.length(s) - F.length(r)) <= 1) & F.exists(F.sequence(F.lit(0), F.lit(SECTORS - 1)), near)


def dropped_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """doc_id, line, by_doc_id, by_line, near: each line to drop and the earliest line that it repeats."""
    place = F.struct("doc_id", "line")
    s = F.col("s")
    halves = F.when(F.length(s) >= least, _halves(s))
    hashed = common.cut(_lines(docs, key, text).select("doc_id", "line", F.xxhash64(s).alias("h1"), F.xxhash64(F.lit(1), s).alias("h2"), halves.alias("halves")), "lines")
    n = hashed.count()
    firsts = hashed.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "line", "halves")).alias("f")).select("h1", "h2", F.struct("f.doc_id", "f.line").alias("first"), "f.halves")
    firsts = common.cut(firsts, "distinct", n)
    # 2. distinct lines that share a half, then all but one sector, with another; h1 stands for a line, what it lets through in vain goes no further
    some = _shared(firsts.select("h1", F.explode("halves").alias("h"))).select("h1").distinct()
    some = firsts.where("halves IS NOT NULL").drop("halves").join(some, "h1")
    wanted = some.groupBy(F.col("first.doc_id").alias("doc_id")).agg(F.collect_list(F.struct(F.col("first.line").alias("line"), "h1", "h2")).alias("w"))
    texts = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("_t"))
    found = texts.join(wanted, "doc_id").select("doc_id", F.split("_t", "\n").alias("all"), F.explode("w").alias("w"))
    found = found.select("w.h1", "w.h2", F.struct("doc_id", F.col("w.line").alias("line")).alias("first"), F.trim(F.try_element_at("all", F.col("w.line") + 1)).alias("s"))
    found = common.cut(found.where((F.xxhash64("s") == F.col("h1")) & (F.xxhash64(F.lit(1), s) == F.col("h2"))).dropDuplicates(["h1", "h2"]), "found", n)
    sectors = common.cut(found.select("first", F.explode(_sectors(s)).alias("x")).select("first", "x.*"), "sectors")
    close = common.cut(found.select("first", "s").join(_shared(sectors).select("first", "n", "q"), "first"), "close", n)
    common.discard(sectors)
    # 3. and 4. variants, their first places, and each line's earliest neighbour
    variants = common.cut(_variants(close), "variants", n)
    common.discard(close)
    kind, first = F.col("kind"), F.col("first")
    earliest = variants.groupBy("key").agg(*[F.min(F.when(kind == k, first)).alias(f"by{k}") for k in range(3)], F.count("*").alias("n")).where("n > 1")
    other = F.when(kind == 0, F.col("by2")).when(kind == 1, F.col("by1")).otherwise(F.col("by0"))
    met = variants.join(earliest, "key").select("first", other.alias("by")).where("by < first").groupBy("first").agg(F.min("by").alias("by"))
    theirs = found.select(first.alias("by"), s.alias("r"))
    near = found.join(met, "first").join(theirs, "by").where(_within_one(s, F.col("r"))).select("h1", "h2", F.col("by").alias("near"))
    # every occurrence of a line with an earlier neighbour goes; of others, all but the first
    fates = firsts.select("h1", "h2", "first").join(near, ["h1", "h2"], "left")
    by = F.least("first", "near")
    told = hashed.select("doc_id", "line", "h1", "h2").join(fates, ["h1", "h2"]).where(by < place)
    return told.select("doc_id", "line", by["doc_id"].alias("by_doc_id"), by["line"].alias("by_line"), (by < first).alias("near")).dropDuplicates(["doc_id", "line"])


def report(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """doc_id, n_lines, n_dropped, n_near, dropped (line numbers from 0), kept_doc_ids: one row for each key."""
    lines = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.size(F.split(F.col(text), "\n")), F.lit(0)).alias("n_lines")).groupBy("doc_id").agg(F.max("n_lines").cast("long").alias("n_lines"))
    lost = dropped_lines(docs, key, text, least).groupBy("doc_id").agg(F.count("*").alias("n_dropped"), F.count(F.when(F.col("near"), 1)).alias("n_near"), F.sort_array(F.collect_list("line")).alias("dropped"), F.sort_array(F.collect_set("by_doc_id")).alias("kept_doc_ids"))
    out = lines.join(lost, "doc_id", "left").select("doc_id", "n_lines", F.coalesce("n_dropped", F.lit(0)).alias("n_dropped"), F.coalesce("n_near", F.lit(0)).alias("n_near"), "dropped", "kept_doc_ids")
    return common.sized(out, docs.count())


def remove(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """The documents without their dropped lines."""
    doc, gone = common.unused("_doc", docs), common.unused("_lost", docs)
    lost = dropped_lines(docs, key, text, least).groupBy(F.col("doc_id").alias(doc)).agg(F.collect_set("line").alias(gone))
    joined = docs.join(lost, docs[key] == lost[doc], "left")
    kept = F.filter(F.split(F.col(text), "\n"), lambda _, i: ~F.array_contains(gone, i))
    out = joined.withColumn(text, F.when(F.col(gone).isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))).select(*docs.columns)
    return common.sized(out, docs.count(), common.TEXT_ROWS)
