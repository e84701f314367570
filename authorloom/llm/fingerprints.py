"""Improbable-feature digests of documents, and their likeness.

Every window of ``WINDOW`` bytes has the entropy of its byte counts; a fixed
rule ranks entropies from the rarest (farthest from typical text) on, and
windows below ``FLOOR`` bits (runs) are left out. A window is a feature if it
has the lowest rank, leftmost first, in at least ``POPULAR`` of the ``REACH``
neighbouring stretches that hold it. Features are hashed into a chain of Bloom
filters of ``FILTER_BITS`` bits, ``PER_FILTER`` features each. Two digests'
likeness is the mean, over the filters of the shorter chain, of the largest
overlap with a filter of the other, normalised between chance and the most
possible.

Only bytes of one text enter its digest: equal texts have equal digests.

Defined results: null text is empty; an empty text has an empty digest, alike
1 to an empty one and 0 to others; a text without features has one, the hash
of all of it; rows that repeat a key are ordered by their text's hash and each
is the next of the one before; a null key comes first; a table of one row is
its own next; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW, REACH, POPULAR = 16, 16, 5
FILTER_BITS, PER_FILTER, PROBES = 2048, 128, 5
FLOOR, TYPICAL, LEVELS = 1.2, 3.3, 160
CHANCE = 0.3
_GAP = 128  # zero bytes between texts: more than WINDOW + REACH
_BLOCK = 1 << 18
_SCALE = 1 << 12
_G = np.round(_SCALE * np.array([0, *(n * np.log2(n) for n in range(1, WINDOW + 2))])).astype(np.int32)


def _rank_table() -> np.ndarray:
    """Rank of each entropy level: 0 for the level farthest from TYPICAL; the last for those left out."""
    bits = np.arange(LEVELS + 1) * np.log2(WINDOW) / LEVELS
    order = np.argsort(-np.abs(bits - TYPICAL), kind="stable")
    rank = np.empty(LEVELS + 1, np.uint32)
    rank[order] = np.arange(LEVELS + 1)
    rank[bits < FLOOR] = LEVELS + 1
    return rank


_RANKS = _rank_table()


def _entropy_levels(data: np.ndarray) -> np.ndarray:
    """Level of the window that starts at each byte (the last WINDOW - 1 have none)."""
    n = len(data)
    before, after = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    for lo in range(0, n, _BLOCK):  # so that a block stays in the processor's cache
        hi = min(n, lo + _BLOCK)
        for j in range(1, WINDOW):
            a = max(lo, j)
            if a < hi:
                same = (data[a:hi] == data[a - j : hi - j]).view(np.uint8)
                before[a:hi] += same
                after[a - j : hi - j] += same
    gain = np.diff(_G)
    total = np.cumsum(gain[before], dtype=np.int32)
    lost = gain[after]
    total[WINDOW:] -= np.cumsum(lost[: n - WINDOW], dtype=np.int32)
    s = total[WINDOW - 1 :]
    most = WINDOW * int(np.log2(WINDOW)) * _SCALE
    return np.clip((most - s) * LEVELS // most, 0, LEVELS)


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, 64-bit hash) of the features, in order."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    gap = bytes(_GAP)
    data = np.frombuffer(gap + gap.join(texts) + gap, np.uint8)
    starts = _GAP + np.concatenate([[0], np.cumsum(lengths + _GAP)])[:-1]
    level = _entropy_levels(data)
    rank = np.full(len(data), LEVELS + 1, np.uint32)
    inside = np.zeros(len(data) + 1, np.int8)
    long = lengths >= WINDOW
    inside[starts[long]] += 1
    inside[(starts + lengths - WINDOW + 1)[long]] -= 1
    valid = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    rank[: len(level)][valid[: len(level)]] = _RANKS[level[valid[: len(level)]]]
    low = (rank.astype(np.uint64) << np.uint64(32)) | np.arange(len(data), dtype=np.uint64)
    step = 1
    while step < REACH:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    chosen = low[np.concatenate([[True], low[1:] != low[:-1]])]
    runs = np.diff(np.concatenate([np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]])), [len(low)]]))
    picked = chosen[(runs >= POPULAR) & (chosen >> np.uint64(32) <= LEVELS)]
    at = (picked & np.uint64(0xFFFFFFFF)).astype(np.int64)
    lanes = data[at[:, None] + np.arange(WINDOW)].view("<u8") if len(at) else np.zeros((0, WINDOW // 8), np.uint64)
    h = np.full(len(at), 0x243F6A8885A308D3, np.uint64)
    for k in range(lanes.shape[1]):
        h = (h ^ lanes[:, k]) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(31)
    doc = np.searchsorted(starts, at, "right") - 1
    bare = np.setdiff1d(np.flatnonzero(lengths), doc)
    if len(bare):
        doc = np.concatenate([doc, bare])
        h = np.concatenate([h, np.array([xxhash.xxh64_intdigest(texts[i]) for i in bare], np.uint64)])
        order = np.argsort(doc, kind="stable")
        doc, h = doc[order], h[order]
    return doc, h


def digests(texts: list[bytes]) -> list[np.ndarray]:
    """Chains of Bloom filters: for each text, an array of (filters, FILTER_BITS / 8) bytes."""
    doc, h = features(texts)
    counts = np.bincount(doc, minlength=len(texts))
    filters = -(-counts // PER_FILTER)
    first = np.cumsum(filters) - filters
    place = np.arange(len(doc)) - (np.cumsum(counts) - counts)[doc]
    row = first[doc] + place // PER_FILTER
    bits = np.zeros((int(filters.sum()), FILTER_BITS), bool)
    width = FILTER_BITS.bit_length() - 1
    for k in range(PROBES):
        bits[row, ((h >> np.uint64(k * width)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)] = True
    packed = np.packbits(bits, axis=1) if len(bits) else np.zeros((0, FILTER_BITS // 8), np.uint8)
    return [packed[a : a + n] for a, n in zip(first, filters, strict=True)]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1; symmetric; 1 for equal digests."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if a.shape == b.shape and (a == b).all():
        return 1.0
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):  # one order, whichever comes first
        a, b = sorted((a, b), key=lambda x: x.tobytes())
    x, y = a.view(np.uint64), b.view(np.uint64)
    na, nb = np.bitwise_count(x).sum(axis=1, dtype=np.int64), np.bitwise_count(y).sum(axis=1, dtype=np.int64)
    common_bits = np.bitwise_count(x[:, None, :] & y[None, :, :]).sum(axis=2, dtype=np.int64)
    most = np.minimum(na[:, None], nb[None, :])
    chance = na[:, None] * nb[None, :] / FILTER_BITS
    floor = chance + CHANCE * (most - chance)
    score = np.clip((common_bits - floor) / np.maximum(most - floor, 1e-9), 0, 1)
    return float(score.max(axis=1).mean())


def spell(digest: np.ndarray) -> str:
    """The digest as text: number of filters, then their bytes in hex."""
    return f"{len(digest)}:{digest.tobytes().hex()}"


def fingerprint(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, fingerprint: one row for each input row; no shuffle."""

    def make():
        return lambda ids, texts: {"doc_id": ids, "n_chars": [len(t or "") for t in texts], "fingerprint": [spell(d) for d in digests([(t or "").encode("utf-8", "surrogatepass") for t in texts])]}

    return common.map_texts(docs, make, "doc_id long, n_chars long, fingerprint string", key, text)


def _edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _compare(batches):
    """Rows in order of (part, key): each with the next row of its part; a part's last row only follows."""
    arrow = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
    before = None  # (part, key, text, digest) of the last row
    for batch in batches:
        parts, keys, texts, only_next = (c.to_pylist() for c in batch.columns)
        at = 0
        for ks, ts in common.slices(keys, texts):
            rows = list(zip(parts[at : at + len(ks)], ks, ts, only_next[at : at + len(ks)], strict=True))
            at += len(ks)
            fresh = digests([t.encode("utf-8", "surrogatepass") for _, _, t, _ in rows])
            pairs = []
            for (part, k, t, follows), d in zip(rows, fresh, strict=True):
                if before and before[0] == part and before[4] is False:
                    pairs.append((before, t, d))
                before = (part, k, t, d, follows)
            if not pairs:
                continue
            edited = [_edited(a[2], t) for a, t, _ in pairs]
            raw = [e.encode("utf-8", "surrogatepass") for e in edited]
            new = digests(raw)
            out = [[a[1] for a, _, _ in pairs], [len(a[2]) for a, _, _ in pairs], [hashlib.sha256(e).hexdigest() for e in raw], [spell(a[3]) for a, _, _ in pairs], [spell(d) for d in new], [likeness(a[3], d) for (a, _, _), d in zip(pairs, new, strict=True)], [likeness(a[3], d) for a, _, d in pairs]]
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(out, arrow, strict=True)], schema=arrow)


def edit_study(docs: DataFrame, key: str = "doc_id", text: str = "text", parts_per_task: int = 4) -> DataFrame:
    """Digests of every text and of the text whose last half is the next document's first.

    Documents are cut into ranges of keys; each range is one part, which also
    gets the first document of the next (the last gets the very first), so
    every document meets the next one without a global order. Only the ranges'
    bounds and first keys come to the driver.
    """
    spark = docs.sparkSession
    common.ship(spark)
    rows = docs.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    n = parts_per_task * int(spark.conf.get("spark.sql.shuffle.partitions"))
    marks = rows.agg(F.percentile_approx("k", [i / n for i in range(1, n)], 20 * n)).first()[0] or []
    bounds = np.array(sorted(set(marks)), np.int64)

    @F.pandas_udf("long")
    def part_of(k: pd.Series) -> pd.Series:
        at = np.searchsorted(bounds, k.fillna(0).to_numpy(np.int64), "left")
        return pd.Series(np.where(k.isna(), -1, at))

    ranges = rows.select("k").groupBy(part_of("k").alias("p")).agg(F.min("k").alias("k"), F.count("*").alias("n")).collect()  # a row for each range
    heads, total = {r["p"]: r["k"] for r in ranges}, sum(r["n"] for r in ranges)
    used = sorted(heads)
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    if not used:
        return spark.createDataFrame([], schema)
    # the first key of a part -> the part before it, which it also ends
    before = [(heads[p], used[i - 1]) for i, p in enumerate(used)]
    known = dict((k, p) for k, p in before if k is not None)
    keys = np.array(sorted(known), np.int64)
    ends = np.array([known[k] for k in keys.tolist()], np.int64)
    null_ends = next((p for k, p in before if k is None), None)

    @F.pandas_udf("array<struct<p:long,ends:boolean>>")
    def parts(k: pd.Series) -> pd.Series:
        value, null = k.fillna(0).to_numpy(np.int64), k.isna().to_numpy()
        own = np.where(null, -1, np.searchsorted(bounds, value, "left"))
        at = np.clip(np.searchsorted(keys, value), 0, max(0, len(keys) - 1))
        head = (~null) & (keys[at] == value) if len(keys) else np.zeros(len(k), bool)
        out = []
        for i in range(len(k)):
            more = ends[at[i]] if head[i] else null_ends if null[i] else None
            out.append([{"p": int(own[i]), "ends": False}] + ([{"p": int(more), "ends": True}] if more is not None else []))
        return pd.Series(out)

    dealt = rows.select("k", "t", F.explode(parts("k")).alias("x")).select(F.col("x.p").alias("p"), "k", "t", F.col("x.ends").alias("e"))
    # within a part: its own rows in order, then what ends it
    dealt = common.sized(dealt.repartition("p"), total, common.TEXT_ROWS // 2).sortWithinPartitions("p", "e", F.col("k").asc_nulls_first(), F.xxhash64("t"))
    return dealt.mapInArrow(_compare, schema)
