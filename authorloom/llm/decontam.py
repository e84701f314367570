"""Benchmark decontamination by template windows.

Words become template tokens: numbers, names (capitalised inside a sentence)
and units are replaced by typed placeholders, the rest is lower-cased and
stripped of punctuation. Windows of ``WINDOW`` tokens are hashed twice: as
they are, and, with at least ``PLAIN`` plain tokens (usable ones), as
templates. Documents' windows that pass a fixed-size bit table of the
benchmark's are hash-joined with the benchmark's windows.

A window that is the same word for word counts at once. The other windows on a
diagonal (document place less item place) count as far as one function maps
the item's slot values to the document's: the most windows that one can serve,
so only windows in conflict are dropped.

A document is contaminated by an item if counted windows cover ``SHARE`` of
the item's usable ones or of all, or if ``RUN`` of them lie on one diagonal (13
tokens in a row). Items with fewer tokens than a window are one window of
their length, usable with all but one token plain.

Defined results: null and empty texts have no windows; items of one token
match nothing; a repeated row gives the same pairs once; items with
equal texts each give a pair; rows without a key are ignored; an empty table
gives no rows; other columns of either table are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW, PLAIN = 5, 3
SHARE, RUN = 0.8, 9
#: Bits of the table that windows must pass before the join; its size is fixed.
TABLE_BITS = 22
#: Words for numbers and for units.
NUMBER_WORDS = frozenset("zero one two three four five six seven eight nine ten eleven twelve dozen twenty thirty forty fifty hundred thousand million billion half".split())
UNITS = frozenset("mm cm m km in ft yd mi mg g kg lb oz ml l gal s sec min h hr hour hours minute minutes second seconds day days week weeks month months year years meter meters metre metres kilometer kilometers mile miles inch inches foot feet gram grams kilogram kilograms pound pounds ounce ounces liter liters litre litres dollar dollars cent cents euro euros percent degree degrees mph kmh hz khz mhz ghz w kw v °c °f % $ € £".split())
PLAIN_KIND, NUM, NAME, UNIT, SKIP = 0, 1, 2, 3, 4
_EDGE = re.compile(r"^[^\w%$€£°]+|[^\w%$€£°]+$")
_STOPS = frozenset(".!?:")
_P = np.uint64(0x9E3779B97F4A7C15)
#: Where the hash of a window as it is starts; that of a template starts at 0.
VERBATIM = 0x5851F42D4C957F2D


def _hash(s: str) -> int:
    raw = s.encode("utf-8", "surrogatepass")
    return zlib.crc32(raw) | zlib.crc32(raw, 0x5A17) << 32


PLACEHOLDER = np.array([0, *(_hash(f"\x01{k}") for k in (NUM, NAME, UNIT)), 0], np.uint64)


class Templates:
    """Texts to template tokens; keeps what it has worked out of each word."""

    def __init__(self):
        self.clear()

    def clear(self):
        self.ids = common.WordIds(self._number)
        self.tables = np.zeros(0, np.uint64), np.zeros(0, np.int8), np.zeros(0, bool), np.zeros(0, bool)
        self.new: list[tuple[int, int, bool, bool]] = []

    def _number(self, word: str) -> int:
        core = word[:-1] if word[-1] in ".," else word
        if not core.isalpha():
            core = _EDGE.sub("", word)
        low = core.lower()
        digits = not core.isalpha() and any(x.isdigit() for x in core)
        kind = SKIP if not core.isalpha() and not any(x.isalnum() or x in "%$€£°" for x in core) else NUM if digits or low in NUMBER_WORDS else UNIT if low in UNITS else PLAIN_KIND
        self.new.append((_hash(low), kind, core[:1].isupper() and core[1:].islower(), word.rstrip("\"')]»”’")[-1:] in _STOPS))
        return len(self.tables[0]) + len(self.new) - 1

    def of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(token hash, value hash, kind, text number) of all tokens of the texts."""
        if len(self.ids) > common.CACHE_WORDS:
            self.clear()
        split = [x.split() if x else [] for x in texts]
        counts = np.fromiter(map(len, split), np.int64, len(split))
        get = self.ids.__getitem__
        ids = np.concatenate([np.fromiter(map(get, w), np.int64, len(w)) for w in split]) if split else np.zeros(0, np.int64)
        if self.new:
            self.tables = tuple(np.concatenate([t, np.array(c, t.dtype)]) for t, c in zip(self.tables, zip(*self.new, strict=True), strict=True))
            self.new = []
        value, kind, capital, ends = (t[ids] for t in self.tables)
        doc = np.repeat(np.arange(len(split)), counts)
        opens = np.ones(len(ids), bool)
        if len(ids) > 1:
            opens[1:] = ends[:-1] | (doc[1:] != doc[:-1])
        kind = np.where((kind == PLAIN_KIND) & capital & ~opens, NAME, kind)
        token = np.where(kind == PLAIN_KIND, value, PLACEHOLDER[kind])
        keep = kind != SKIP
        return token[keep], value[keep], kind[keep], doc[keep]

    def windows(self, texts: list[str | None], size: int, table: np.ndarray | None = None):
        """(text number, place in the text, hash, values in slots) of the usable windows that pass the table."""
        return self._windows(self.of(texts), size, table, False)

    def all_windows(self, texts: list[str | None], tables: dict[int, np.ndarray | None]):
        """(size, whether verbatim, windows): usable windows as templates and all windows word for word, of the sizes that pass their tables."""
        tokens = self.of(texts)
        for size, table in tables.items():
            for verbatim in (False, True):
                yield size, verbatim, self._windows(tokens, size, table, verbatim)

    @staticmethod
    def _windows(tokens, size: int, table: np.ndarray | None, verbatim: bool):
        token, value, kind, doc = tokens
        n = len(token) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), []
        h = np.full(n, VERBATIM if verbatim else 0, np.uint64)
        words = value if verbatim else token
        for j in range(size):
            h = h * _P + words[j : j + n]
        h ^= h >> np.uint64(29)
        ok = doc[:n] == doc[size - 1 :]
        if not verbatim:
            plain = np.concatenate([[0], np.cumsum(kind == PLAIN_KIND)])
            least = PLAIN if size == WINDOW else max(1, size - 1)
            ok &= plain[size:] - plain[:-size] >= least
        if table is not None:
            ok &= table[(h & np.uint64(len(table) - 1)).astype(np.int64)]
        at = np.flatnonzero(ok)
        first = np.searchsorted(doc, doc[at])
        slots = [[] for _ in at] if verbatim else [value[i : i + size][kind[i : i + size] != PLAIN_KIND].view(np.int64).tolist() for i in at]
        return doc[at], at - first, h[at].view(np.int64), slots

    def lengths(self, texts: list[str | None]) -> np.ndarray:
        return np.bincount(self.of(texts)[3], minlength=len(texts))


def _item_windows(benchmark: DataFrame, key: str, text: str) -> DataFrame:
    """item_id, size, verbatim, h, place, slots of all windows of the benchmark."""

    def make():
        templates = common.worker_state("templates", Templates)

        def f(ids, texts):
            out = {c: [] for c in ("item_id", "size", "verbatim", "h", "place", "slots")}
            lengths = templates.lengths(texts)
            for k, (i, t, n) in enumerate(zip(ids, texts, lengths, strict=True)):
                size = min(WINDOW, int(n))
                if size < 2:
                    continue
                for _, verbatim, (_, place, h, slots) in templates.all_windows([t], {size: None}):
                    out["item_id"] += [i] * len(place)
                    out["size"] += [size] * len(place)
                    out["verbatim"] += [verbatim] * len(place)
                    out["h"] += h.tolist()
                    out["place"] += place.tolist()
                    out["slots"] += slots
            return out

        return f

    return common.map_texts(benchmark.where(F.col(key).isNotNull()), make, "item_id long, size int, verbatim boolean, h long, place long, slots array<long>", key, text)


def largest(windows: dict[int, frozenset]) -> dict[int, frozenset]:
    """The most windows (place -> pairs of item value and document value) whose pairs are one function."""
    windows = {p: w for p, w in windows.items() if len({b for b, _ in w}) == len(w)}
    seen: dict = {}
    for w in windows.values():
        for b, d in w:
            seen.setdefault(b, {}).setdefault(d, 0)
            seen[b][d] += 1
    torn = {b: ds for b, ds in seen.items() if len(ds) > 1}
    if not torn:
        return windows
    # windows that no torn value connects are settled on their own
    parts: list[tuple[set, dict]] = []
    for p, w in windows.items():
        mine, kept = ({b for b, _ in w if b in torn}, {p: w}), []
        for part in parts:
            if part[0] & mine[0]:
                mine = (mine[0] | part[0], part[1] | mine[1])
            else:
                kept.append(part)
        parts = [*kept, mine]
    out: dict = {}
    for values, part in parts:
        best: dict = {}
        if not values:
            best = part
        else:
            b = max(values, key=lambda x: (sum(torn[x].values()), x))
            for d in sorted(torn[b], key=lambda x: (-torn[b][x], x)):
                fit = {p: w for p, w in part.items() if all(x != b or y == d for x, y in w)}
                if len(fit) > len(best):
                    got = largest(fit)
                    best = got if len(got) > len(best) else best
        out |= best
    return out


def _counted(batches):
    """The places of each diagonal's windows that count."""
    for batch in batches:
        places = []
        for found in batch.column(3).to_pylist():
            by_place: dict = {}
            for w in found:
                by_place.setdefault(w["place"], []).append(frozenset((p["b"], p["d"]) for p in w["pairs"]))
            free = {p for p, ws in by_place.items() if any(all(b == d for b, d in w) for w in ws)}
            places.append(sorted(free | set(largest({p: ws[0] for p, ws in by_place.items() if p not in free}))))
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(places, pa.list_(pa.int64()))], names=["doc_id", "item_id", "diagonal", "places"])


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, n_windows, share, run: one row for each contaminated pair."""
    spark = docs.sparkSession
    items = common.cut(_item_windows(benchmark, item, item_text).distinct(), "items")
    bits = 1 << TABLE_BITS
    got = items.select("size", F.pmod("h", F.lit(bits)).alias("b")).distinct().toPandas()  # TABLE_BITS bounds it for each of WINDOW - 1 sizes
    tables = {}
    for size, rows in got.groupby("size"):
        table = np.zeros(bits, bool)
        table[rows["b"].to_numpy(int)] = True
        tables[int(size)] = np.packbits(table)
    shared = spark.sparkContext.broadcast(tables)

    def make():
        templates = common.worker_state("templates", Templates)
        tables = {k: np.unpackbits(v).astype(bool) for k, v in shared.value.items()}

        def f(ids, texts):
            out = {c: [] for c in ("doc_id", "size", "verbatim", "h", "at", "values")}
            for size, verbatim, (doc, place, h, slots) in templates.all_windows(texts, tables):
                out["doc_id"] += [ids[d] for d in doc]
                out["size"] += [size] * len(doc)
                out["verbatim"] += [verbatim] * len(doc)
                out["h"] += h.tolist()
                out["at"] += place.tolist()
                out["values"] += slots
            return out

        return f

    hits = common.map_texts(docs.where(F.col(key).isNotNull()), make, "doc_id long, size int, verbatim boolean, h long, at long, values array<long>", key, text)
    pairs = F.transform(F.arrays_zip("slots", "values"), lambda x: F.struct(x["slots"].alias("b"), x["values"].alias("d")))
    matched = hits.join(items, ["size", "verbatim", "h"]).select("doc_id", "item_id", (F.col("at") - F.col("place")).alias("diagonal"), F.struct("place", pairs.alias("pairs")).alias("w"))
    lines = matched.groupBy("doc_id", "item_id", "diagonal").agg(F.collect_set("w").alias("found"))
    counted = lines.mapInArrow(_counted, "doc_id long, item_id long, diagonal long, places array<long>").where(F.size("places") > 0)
    sound = counted.groupBy("doc_id", "item_id").agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"), F.max(F.size("places")).alias("run"))
    sizes = items.groupBy("item_id").agg(F.countDistinct("place").alias("of"), F.collect_set(F.when(~F.col("verbatim"), F.col("place"))).alias("usable"))
    of_usable = F.when(F.size("usable") > 0, F.size(F.array_intersect("places", "usable")) / F.size("usable")).otherwise(0.0)
    share = F.greatest(of_usable, F.size("places") / F.col("of"))
    out = sound.join(sizes, "item_id").where((share >= SHARE) | (F.col("run") >= RUN)).select("doc_id", "item_id", F.size("places").cast("long").alias("n_windows"), share.alias("share"), F.col("run").cast("long").alias("run"))
    return common.sized(out, docs.count())


def clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that no item contaminates; rows without a key are kept."""
    name = common.unused("_bad", docs)
    bad = contamination(docs, benchmark, key, text).select(F.col("doc_id").alias(name)).distinct()
    return common.sized(docs.join(bad, docs[key] == bad[name], "left_anti"), docs.count(), common.TEXT_ROWS)
