"""Near duplicates by the Jaccard similarity of word shingles, exact.

A text's words (as in ``simhash``) form shingles of ``SHINGLE`` words; texts
link if their sets of shingles have a Jaccard similarity of 4/5 or more.

Texts with equal sets collapse first. A set of n shingles emits the n - ceil(4n/5)
+ 1 first of their hashes: two sets that link have one of these in common
(prefix filter; any fixed order of the shingles will do). The order is that of
the hashes, with the commonest (at most ``HOT_KEYS``) last. Those are counted
over whole sets, of all sets that emit a common hash: of a passage that many
texts share, no shingle is left to fill the buckets when others have gone last.
First the sets' SimHash fingerprints are linked (``simhash.close``), and the links that the
sets confirm connect near copies. Then, as fingerprints can leave sets apart that link,
in ``ROUNDS`` rounds all sets in a bucket of one hash are compared with one hub,
drawn by hash; sets that this connects need no further pairs. Only buckets that
still hold sets of different components are paired, across components, and only
where the two could link with the bucket's hash as the first they share: with i
and j hashes before it, min(n - i, m - j) must reach 4 (n + m) / 9. So the smaller
set has it among its first n / 9, for larger ones of up to (5n - 9i) / 4 shingles,
which bands of sizes turn into join keys. No link is lost, as linked sets pass
in the bucket of the first hash they share, and a large group of near copies
costs a few comparisons each.

A comparison begins with digests: bit i of a digest is the parity of the number
of shingles whose hash is i modulo its length, some two bits a shingle. The bits
in which two digests differ are at most the shingles that one set has and the
other has not, and sets that link differ in (n + m) / 9 shingles at most. The digests
form a ring of ``SEGMENTS`` segments; by the pigeonring principle a pair within
the bound has a segment from which all chains of 1, 2, ... segments stay within
their share of it. Pairs without one, then pairs over the bound, are pruned
before the sets are fetched and compared in full.

Defined results: null and empty texts have the empty set, and it links to
itself alone; fewer than ``SHINGLE`` words make one shingle of them all; rows
that repeat a key and text are alike; very long texts are compared whole; an
empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from . import common, simhash

SHINGLE = 5
#: The least similarity, as a fraction.
NUM, DEN = 4, 5
#: A hash in more buckets' sets than this is common; so many of these go last. Neither changes the result.
COMMON, HOT_KEYS = 32, 1 << 16
ROUNDS = 2
#: Sizes in one band differ by this factor at most.
BAND = 1.05
#: Segments of a ring of digests.
SEGMENTS = 8


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles, unsigned."""
    return np.unique(np.array(simhash._hashes(text, SHINGLE) if text else [], np.uint64))


def _sets(docs: DataFrame, key: str, text: str, whole: bool, hot=None, wide: bool = False) -> DataFrame:
    """doc_id, node (digest of the set), n, hashes.

    The hashes are all of the set (``whole``), or the first ones, of which a linked
    set shares one; ``wide``: the upper halves of all of a set with one of ``hot``
    among its first ones, else none. ``hot`` are upper halves too: a hash that
    shares one by chance goes last as well, which changes no result.
    """

    def make():
        late = hot.value if hot is not None else None

        def f(ids, texts):
            out = {c: [] for c in ("node", "n", "hashes")} | ({"digest": [], "fp": []} if whole else {})
            for t in texts:
                h = shingles(t)
                n = len(h)
                out["node"].append(xxhash.xxh64_intdigest(h.astype("<u8").tobytes(), 42))
                out["n"].append(n)
                if whole:
                    out["digest"].append(parities(h))
                    out["fp"].append(simhash.fingerprint(h).view(np.int64))
                first = n - -(-NUM * n // DEN) + 1 if n else 0
                if late is not None:
                    upper = (h >> np.uint64(32)).astype(np.uint32)
                    last = late[np.minimum(np.searchsorted(late, upper), len(late) - 1)] == upper
                    if wide:
                        out["hashes"].append(upper[: n if last[:first].any() else 0].view(np.int32))
                        continue
                    else:
                        h = np.concatenate([h[~last], h[last]])
                out["hashes"].append(h[: n if whole else first].view(np.int64))
            return out | {"doc_id": ids, "node": np.array(out["node"], np.uint64).view(np.int64)}

        return f

    return common.map_texts(docs, make, f"doc_id long, node long, n int, hashes array<{'int' if wide else 'long'}>" + ", digest binary, fp long" * whole, key, text)


def parities(hashes: np.ndarray) -> bytes:
    """The digest of a set: parities by the hash's remainder, for a power of two of 2n bits or more."""
    bits = max(64, 1 << (2 * len(hashes) - 1).bit_length() if len(hashes) else 0)
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _fold(digest: np.ndarray, size: int) -> np.ndarray:
    while len(digest) > size:
        half = len(digest) // 2
        digest = digest[:half] ^ digest[half:]
    return digest


def within(a: bytes, b: bytes, most: int) -> bool:
    """Whether two digests differ in at most ``most`` bits, by the pigeonring's chains first."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    size = min(len(x), len(y))
    differ = np.bitwise_count(_fold(x, size) ^ _fold(y, size)).reshape(SEGMENTS, -1).sum(axis=1, dtype=np.int64)
    ring = np.cumsum(np.concatenate([differ, differ]))
    before = np.concatenate([[0], ring])[:SEGMENTS]
    steps = np.arange(1, SEGMENTS + 1)
    chains = ring[np.arange(SEGMENTS)[:, None] + steps - 1] - before[:, None]  # from each start, after 1, 2, ... segments
    return bool((chains * SEGMENTS <= steps * most).all(axis=1).any()) and int(differ.sum()) <= most


def _pruned(batches):
    for batch in batches:
        a, b, n, m, x, y = (c.to_pylist() for c in batch.columns)
        good = [within(p, q, (i + j) * (DEN - NUM) // (DEN + NUM)) for i, j, p, q in zip(n, m, x, y, strict=True)]
        yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(good, pa.bool_()))


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The (a, b) pairs of nodes whose sets link."""
    common.ship(pairs.sparkSession)
    side = lambda c, value: sets.select(F.col("node").alias(c), *value)
    size = lambda c: (F.col("n").alias(f"n_{c}"), F.col("digest").alias(f"digest_{c}"))
    both = pairs.join(side("a", size("a")), "a").join(side("b", size("b")), "b").select("a", "b", "n_a", "n_b", "digest_a", "digest_b")
    likely = common.cut(both.mapInArrow(_pruned, "a long, b long"), "likely")
    # only the sets that are still compared are dealt out for it
    nodes = likely.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = common.cut(sets.select("node", "hashes").join(nodes, "node", "left_semi"), "compared")
    full = likely.join(side("a", [F.col("hashes").alias("a_set")]), "a").join(side("b", [F.col("hashes").alias("b_set")]), "b")
    common_n = F.size(F.array_intersect("a_set", "b_set"))
    linked = common.cut(full.where((DEN + NUM) * common_n >= NUM * (F.size("a_set") + F.size("b_set"))).select("a", "b"), "linked")
    common.discard(likely, sets)
    return linked


def _band(n) -> Column:
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(BAND))).cast("int")


def _across(dealt: DataFrame) -> DataFrame:
    """The (a, b) pairs of nodes of different roots that could link with a bucket's hash (i others before it) as the first they share."""
    n, i, m, j = (F.col(c) for c in ("n", "i", "m", "j"))
    most = F.floor(((DEN * n) - (NUM + DEN) * i) / NUM)  # the largest partner's size
    small = dealt.where(most >= n).select("h", "node", "n", "i", "root", F.explode(F.sequence(_band(n), _band(most))).alias("band"))
    large = dealt.select("h", F.col("node").alias("node2"), n.alias("m"), i.alias("j"), F.col("root").alias("root2"), _band(n).alias("band"))
    need = NUM * (n + m)
    able = ((NUM + DEN) * (n - i) >= need) & ((NUM + DEN) * (m - j) >= need)
    once = (m > n) | ((m == n) & (F.col("node") < F.col("node2")))
    met = small.join(large, ["h", "band"]).where(able & once & (F.col("root") != F.col("root2")))
    return met.select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b")).distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, component_id (the smallest key of its group): one row for each input row."""
    spark = docs.sparkSession
    marked = common.cut(_sets(docs, key, text, False), "sets")
    count = marked.count()
    firsts = common.cut(marked.groupBy("node").agg(F.min("doc_id").alias("first")), "nodes", count)
    # a set emits a hash once, so several rows are several sets
    emitted = lambda sets: sets.join(firsts, "node").where("doc_id = first").dropDuplicates(["node"]).select("node", "n", F.posexplode("hashes").alias("i", "h"))

    def commonest(sets: DataFrame):
        """The upper halves of the HOT_KEYS commonest hashes at most, sorted: half as much to deal out."""
        upper = F.col("h") if dict(sets.dtypes)["hashes"] == "array<int>" else F.shiftright("h", 32).cast("int")
        with common.tidy(spark):
            often = emitted(sets).groupBy(upper.alias("h")).count().where(F.col("count") > COMMON).orderBy(F.desc("count"), "h").limit(HOT_KEYS).select("h").toPandas()  # HOT_KEYS bounds it
        return np.sort(often["h"].to_numpy(np.int32).view(np.uint32))

    first_hot = commonest(marked)
    if len(first_hot):
        hot = commonest(_sets(docs, key, text, False, spark.sparkContext.broadcast(first_hot), wide=True))
        early, marked = marked, common.cut(_sets(docs, key, text, False, spark.sparkContext.broadcast(hot)), "sets")
        common.discard(early)
    common.reclaim(spark)
    several = emitted(marked).groupBy("h").count().where("count > 1").select("h")
    dealt = common.cut(emitted(marked).join(several, "h").select("h", "node", "n", "i", F.col("node").alias("root")), "buckets")
    ids = common.cut(marked.select("doc_id", "node"), "ids", count)
    common.discard(marked)
    common.reclaim(spark)
    # sets in full of the nodes that share a bucket
    sharing = dealt.select("node").distinct().join(firsts, "node").select("node", F.col("first").alias("_first"))
    # a node goes with the rows of its first key, so that sets are not dealt out to be found; of a key's rows, those of another set go by the digest
    texts = docs.select(F.col(key).alias("_first"), F.col(text).alias("_text"), F.xxhash64(text).alias("_hash")).join(sharing, "_first").dropDuplicates(["_first", "node", "_hash"])
    sets = common.cut(_sets(texts, "node", "_text", True).where("doc_id = node").select("node", "n", "fp", "digest", "hashes"), "full")
    common.reclaim(spark)
    fits = (F.col("n") * DEN >= F.col("m") * NUM) & (F.col("m") * DEN >= F.col("n") * NUM) & (F.col("root") != F.col("root2"))
    pairs = lambda rows: rows.where(fits).select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b")).distinct()
    other = F.struct(F.col("node").alias("node2"), F.col("n").alias("m"), F.col("root").alias("root2"))
    edges = None
    for r in range(ROUNDS + 1):
        if r:
            hubs = dealt.groupBy("h").agg(F.min_by(other, F.struct(F.xxhash64(F.lit(r - 1), "h", "node"), "node")).alias("hub"))
            tried = pairs(dealt.join(hubs, "h").select("node", "n", "root", "hub.*"))
        else:  # sets that link share a bucket, so these fingerprints are all that can
            tried = simhash.close(sets.where("n > 0").select("node", "fp"), count)
        new = _linked(tried, sets)
        edges = common.cut(new if edges is None else edges.union(new), "links", count)
        known = dealt.drop("root").join(components(edges, count), "node", "left").withColumn("root", F.coalesce("root", "node"))
        mixed = known.groupBy("h").agg(F.min("root").alias("y"), F.max("root").alias("z")).where("y <> z").select("h")
        before, dealt = dealt, common.cut(known.join(mixed, "h").select("h", "node", "n", "i", "root"), "buckets")
        common.discard(before)
        common.reclaim(spark)
    edges = common.cut(edges.union(_linked(_across(dealt), sets)), "links", count)
    common.discard(sets, dealt)
    roots = components(edges, count)
    named = common.cut(firsts.join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root")), "named", count)
    common.discard(firsts)
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    out = ids.join(named.join(smallest, "root").select("node", "component_id"), "node").select("doc_id", "component_id")
    return common.sized(out, count)


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, one of each near-duplicate group: that of the smallest key.

    Rows that repeat a key are all kept or all dropped; rows without a key are kept.
    """
    name = common.unused("_dropped", docs)
    dropped = near_duplicates(docs.where(F.col(key).isNotNull()), key, text).where("doc_id <> component_id").select(F.col("doc_id").alias(name)).distinct()
    return common.sized(docs.join(dropped, docs[key] == dropped[name], "left_anti"), docs.count(), common.TEXT_ROWS)
