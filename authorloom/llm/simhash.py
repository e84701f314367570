"""SimHash near-duplicate groups with pigeonring candidate filtering.

A text's words (runs without ASCII white space, A-Z lower-cased) form 3-word
shingles; a fingerprint bit is set if more than half of the shingles' XXH64
(seed 42) have it. Two fingerprints link if they differ in at most 2 bits.

Pairs are sought between *distinct* fingerprints, so copies collapse before
any pair is made. The 64 bits form a ring of three segments. By the pigeonring
principle a pair within 2 bits has a segment from which, going round the ring,
the first 1, 2, 3 segments differ in at most 0, 1, 2 bits (the floors of the
proportional budgets 2/3, 4/3, 2). The first term gives a hash-join key (which
segment, its value); the chain is checked on each candidate before the full
Hamming distance.

Buckets of more than ``PAIR_LIMIT`` fingerprints go on to the chain's second term, by
hash too: each fingerprint is looked up under its own next segment and emits
that and all values one bit away, so sub-buckets hold only pairs within the
budget of two segments. Small sub-buckets are paired, with the chain and the
distance checked as above. Sub-buckets that are still large are dense groups of
near copies: there each fingerprint emits itself and every variant with one bit
outside the first segment turned; two fingerprints with a common variant differ in at
most two bits, and every pair within two bits that shares the segment has one.
So the members of a variant are all linked to its smallest: work stays linear
and no link is lost.

Defined results: null and empty texts (no words) have fingerprint zero and
link like any other; fewer than three words make one shingle of them all;
repeated rows and ties share a fingerprint; very long texts count whole; an
empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from . import common

SHINGLE = 3
DISTANCE = 2
#: First bit and width of the segments; DISTANCE + 1 of them.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Distinct fingerprints in a bucket that are still compared pair by pair.
PAIR_LIMIT = 32

_FOLD = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def _hashes(text: str, size: int = SHINGLE) -> list[int]:
    words = text.encode("utf-8", "surrogatepass").translate(_FOLD).split()  # of bytes: at 9-13 and 32 alone
    n = len(words)
    if not n:
        return []
    joined = b" ".join(words)
    if n < size:
        return [xxhash.xxh64_intdigest(joined, 42)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    starts = ends - np.fromiter(map(len, words), np.int64, n) - 1
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], 42) for a, b in zip(starts[: n - size + 1].tolist(), (ends[size - 1 :] - 1).tolist(), strict=True)]


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit."""
    total = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 1 << 15):
        some = hashes[lo : lo + (1 << 15)]
        bits = np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.uint32)
    return total


def fingerprint(hashes: np.ndarray) -> np.uint64:
    """The bits that over half of the hashes have; zero of none."""
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
    return (weights * (_bit_counts(hashes.astype("<u8")) * 2 > len(hashes))).sum(dtype=np.uint64)


def fingerprints_of(texts: list[str | None]) -> np.ndarray:
    """Unsigned 64-bit fingerprints."""
    out = np.zeros(len(texts), np.uint64)
    for k, text in enumerate(texts):
        hashes = _hashes(text) if text else []
        if hashes:
            out[k] = fingerprint(np.array(hashes, np.uint64))
    return out


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long)."""
    make = lambda: lambda ids, texts: {"doc_id": ids, "fp": fingerprints_of(texts).view(np.int64)}
    return common.map_texts(docs, make, "doc_id long, fp long", key, text)


def _segment(fp: Column, k: int) -> Column:
    first, width = SEGMENTS[k]
    return F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << width) - 1))


def _differs(a: Column, b: Column, k: int) -> Column:
    return F.bit_count(_segment(a, k).bitwiseXOR(_segment(b, k)))


def _ring(a: Column, b: Column, start: Column) -> Column:
    """Whether the chain that begins at segment ``start`` stays within its budgets."""
    m = len(SEGMENTS)
    out = F.lit(False)
    for s in range(m):
        used, ok = F.lit(0), F.lit(True)
        for step in range(m):
            used = used + _differs(a, b, (s + step) % m)
            ok = ok & (used <= (step + 1) * DISTANCE // m)
        out = F.when(start == s, ok).otherwise(out)
    return out


def links(distinct: DataFrame, n: int, pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp); enough of them to connect all that link. n: how many there are."""
    fp = F.col("fp")
    keys = F.array(*[F.struct(F.lit(k).alias("s"), _segment(fp, k).alias("v")) for k in range(len(SEGMENTS))])
    rows = distinct.select("fp", F.explode(keys).alias("k")).select("fp", "k.s", "k.v")
    sizes = rows.groupBy("s", "v").agg(F.count("*").alias("n")).where("n > 1")
    dealt = common.cut(rows.join(sizes, ["s", "v"]), "buckets", len(SEGMENTS) * n)
    a, b = F.col("a"), F.col("b")
    checked = lambda pairs: pairs.where(_ring(a, b, F.col("s"))).where(F.bit_count(a.bitwiseXOR(b)) <= DISTANCE).select("a", "b")
    small = dealt.where(F.col("n") <= pair_limit)
    pairs = checked(small.select("s", "v", fp.alias("a")).join(small.select("s", "v", fp.alias("b")), ["s", "v"]).where("a < b"))
    # the chain's second term: the next segment, its own value and those one bit away
    of_start = lambda values: F.coalesce(*[F.when(F.col("s") == k, values((k + 1) % len(SEGMENTS))) for k in range(len(SEGMENTS))])
    near = of_start(lambda k: F.array(*[_segment(fp, k).bitwiseXOR(F.lit(m)).cast("long") for m in (0, *(1 << i for i in range(SEGMENTS[k][1])))]))
    second = dealt.where(F.col("n") > pair_limit).select("fp", "s", "v", of_start(lambda k: _segment(fp, k)).alias("own"), F.explode(near).alias("w"))
    sizes = second.groupBy("s", "v", "w").agg(F.count("*").alias("n"), F.count_if(F.col("own") == F.col("w")).alias("owners")).where("n > 1 AND owners > 0")
    second = common.cut(second.join(sizes, ["s", "v", "w"]), "chains")
    less = second.where(F.col("n") <= pair_limit)
    met = less.where("own = w").select("s", "v", "w", fp.alias("x")).join(less.select("s", "v", "w", fp.alias("y")), ["s", "v", "w"]).where("x <> y")
    pairs = pairs.union(checked(met.select("s", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))))
    # the bits outside segment s; each turned once, and none
    turned = F.lit(None)
    for s, (first, width) in enumerate(SEGMENTS):
        masks = [0, *(1 << i for i in range(64) if not first <= i < first + width)]
        signed = [x - (1 << 64) if x >> 63 else x for x in masks]
        turned = F.when(F.col("s") == s, F.array(*[F.lit(x).cast("long") for x in signed])).otherwise(turned)
    large = second.where(F.col("n") > pair_limit).select("fp", "s").distinct().select("fp", "s", F.explode(turned).alias("m"))
    large = large.select("fp", "s", fp.bitwiseXOR(F.col("m")).alias("variant"))
    hubs = large.groupBy("s", "variant").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a < z").select("s", "variant", "a")
    starred = large.join(hubs, ["s", "variant"]).where("fp <> a").select("a", fp.alias("b"))
    return pairs.union(starred)


def close(nodes: DataFrame, n: int, pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """(a, b) pairs of nodes (node, fp; n of them at most): enough to connect all whose fingerprints are equal or link."""
    distinct = common.cut(nodes.groupBy("fp").agg(F.min("node").alias("first")), "distinct", n)
    equal = nodes.join(distinct, "fp").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    side = lambda c: distinct.select(F.col("fp").alias(c), F.col("first").alias(f"{c}_node"))
    linked = links(distinct.select("fp"), n, pair_limit).distinct().join(side("a"), "a").join(side("b"), "b")
    return equal.union(linked.select(F.least("a_node", "b_node"), F.greatest("a_node", "b_node"))).distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """doc_id, fingerprint (hex), component_id: one row for each input row."""
    marked = common.cut(fingerprints(docs, key, text), "simhash")
    n = marked.count()
    distinct = common.cut(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct", n)
    roots = components(links(distinct.select("fp"), n, pair_limit), n)
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = common.cut(named, "named", n)
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = named.join(smallest, "root").select("fp", "component_id")
    out = marked.join(classes, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
    return common.sized(out, n)


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, one of each near-duplicate group: that of the smallest key.

    Rows that repeat a key are all kept or all dropped; rows without a key are kept.
    """
    name = common.unused("_dropped", docs)
    dropped = near_duplicates(docs.where(F.col(key).isNotNull()), key, text).where("doc_id <> component_id").select(F.col("doc_id").alias(name)).distinct()
    return common.sized(docs.join(dropped, docs[key] == dropped[name], "left_anti"), docs.count(), common.TEXT_ROWS)


def keep_similar(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, one of each group of texts whose sets of 5-word shingles are alike by 0.8 or more.

    Fingerprints of those sets are linked as in ``near_duplicates`` (segments in a
    ring, chains, two bits), and the links that the sets confirm in full connect near
    copies. A fingerprint of 64 bits cannot find all pairs: sets of a Jaccard similarity
    of 0.8 differ in some 10 of 64 bits, as far as many unrelated ones. So an exact
    way follows for the sets that the fingerprints leave apart (``jaccard``).
    """
    from . import jaccard  # which uses this module's words

    return jaccard.keep_one(docs, key, text)
