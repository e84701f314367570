"""Scores where keys meet, in Arrow batches: no row is made for a pair.

Both sides of ``blocking.meetings`` are dealt by key and sorted, a key's authors
before its mentions. A task keeps the authors of one key (at most the candidate
limit) and scores its mentions against all of them as matrices: names once for
each pair of different names, common co-authors and journals by looking a
mention's few up among all of the authors'. Only each mention's best and how
many candidates it has, or counts of bins, go on. Keys of many mentions are dealt to several tasks.

The arithmetic is that of ``scoring.compare`` and ``scoring.scored``, in the same order.
"""

from __future__ import annotations

import bisect
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import storage
from ..config import BINS, MU, WEIGHTS
from ..shipping import ship
from . import blocking

#: Mentions of a key that one task scores, those scored at once, and the longest texts whose edits are counted together.
TASK_ROWS, STEP, WIDE = 50_000, 1_000, 64
FEATURES = ("name", "orcid", "coauthor", "journal", "affiliation")
SIMS = ("name", "coauthor", "journal", "affiliation")
#: What a mode scores by.
NEEDS = {"baseline": ("coauthors", "journals"), "legacy": ("coauthors", "journals"), "fs": ("coauthors", "journals", "affiliations")}


def dealt(mentions: DataFrame, authors: DataFrame, mode: str = "baseline") -> DataFrame:
    """Authors (side 0) and mentions (side 1) by key, as the kernels read them."""
    from . import scoring

    spark = mentions.sparkSession
    ship(spark)
    sets = NEEDS[mode]
    own = ["copies"] if "copies" in mentions.columns else []
    columns = lambda p: [f"{p}_{c}" for c in (*sets, "norm", "orcid")]
    bare = lambda c: (F.coalesce(F.col(c), F.lit("")) == "").alias("bare")
    m = scoring.prepare(mentions, "m", "mention_id", *own).select("mention_id", *own, bare("m_name"), *columns("m"))
    a = scoring.prepare(authors.withColumnRenamed("canonical_name", "name"), "a", "author_id").select("author_id", bare("a_name"), *columns("a"))
    left, right, _ = blocking.meetings(mentions, authors, m, a)
    counted = left.groupBy("key").agg(F.ceil(F.count("*") / TASK_ROWS).cast("int").alias("tasks"))
    keys = storage.cut(counted.join(right.select("key").distinct(), "key"), "met_keys")
    left = left.join(keys, "key").withColumn("task", F.pmod(F.xxhash64("mention_id"), F.col("tasks")).cast("int"))
    right = right.join(keys, "key").withColumn("task", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)))
    kinds = blocking.KINDS[:3]
    kind = dict(left.dtypes)["mention_id"]

    def row(df: DataFrame, side: int, p: str, seen: str):
        others = {"mention_id": kind, "author_id": "string", "last": "string", "copies": "long"}
        plain = [F.col(c).alias(c) if c in df.columns else F.lit(1 if c == "copies" else None).cast(t).alias(c) for c, t in others.items()]
        return df.select("key", "task", F.lit(side).alias("side"), *plain, "bare", *[F.col(c).alias(c[2:]) for c in columns(p)], *[F.col(f"{seen}_{k}").alias(f"k{i}") for i, k in enumerate(kinds)])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    both = row(right, 0, "a", "filed").unionByName(row(left, 1, "m", "probed"))
    both = both.repartition(n, "key", "task").sortWithinPartitions("key", "task", "side", "author_id")
    return both


def rounded(x: np.ndarray, places: int = 9) -> np.ndarray:
    """As Spark rounds doubles: half up of the shortest decimal."""
    scaled = np.abs(x) * 10.0**places
    low = np.floor(scaled)
    part = scaled - low
    out = np.copysign((low + (part >= 0.5)) / 10.0**places, x)
    step = Decimal(1).scaleb(-places)
    for at in zip(*np.nonzero(np.abs(part - 0.5) < 1e-4), strict=True):
        out[at] = float(Decimal(repr(float(x[at]))).quantize(step, ROUND_HALF_UP))
    return out + 0.0


def edits(xs: list[str], ys: list[str]) -> np.ndarray:
    """Levenshtein distances of all of ``xs`` to all of ``ys``."""
    from .incremental import levenshtein

    out = np.zeros((len(xs), len(ys)), np.int64)
    long = [[i for i, t in enumerate(s) if len(t) > WIDE] for s in (xs, ys)]
    for i in range(len(xs)):
        for j in range(len(ys)) if len(xs[i]) > WIDE else long[1]:
            out[i, j] = levenshtein(xs[i], ys[j])
    sides = []
    for s in (xs, ys):
        short = [i for i, t in enumerate(s) if len(t) <= WIDE]
        sizes = np.array([len(s[i]) for i in short], np.int64)
        chars = np.zeros((len(short), int(sizes.max()) if len(short) else 0), np.uint32)
        for r, i in enumerate(short):
            chars[r, : len(s[i])] = np.frombuffer(s[i].encode("utf-32-le", "surrogatepass"), "<u4")
        sides.append((short, sizes, chars))
    (si, ni, ci), (sj, nj, cj) = sides
    if not si or not sj:
        return out
    # one cell of the usual table at a time, for all pairs
    row = [np.full((len(si), len(sj)), j, np.int16) for j in range(cj.shape[1] + 1)]
    found = np.where(ni[:, None] == 0, nj[None, :], 0)
    for i in range(1, ci.shape[1] + 1):
        last, row[0] = row[0], np.full_like(row[0], i)
        for j in range(1, cj.shape[1] + 1):
            differ = (ci[:, i - 1][:, None] != cj[:, j - 1][None, :]).astype(np.int16)
            now = np.minimum(np.minimum(row[j], row[j - 1]) + 1, last + differ)
            last, row[j] = row[j], now
        for r in np.flatnonzero(ni == i):
            found[r] = [row[n][r, c] for c, n in enumerate(nj)]
    out[np.ix_(si, sj)] = found
    return out


def ratios(xs: list[str], ys: list[str]) -> np.ndarray:
    """1 - edits / longer length, 1 for equal."""
    longer = np.maximum(np.array([len(x) for x in xs])[:, None], np.array([len(y) for y in ys])[None, :])
    return np.where(longer == 0, 1.0, np.maximum(0.0, 1.0 - edits(xs, ys) / np.maximum(longer, 1)))


def _distinct(values: list) -> tuple[list, np.ndarray]:
    place: dict = {}
    at = np.array([place.setdefault(v, len(place)) for v in values], np.int64)
    return list(place), at


def _flat(column) -> tuple[np.ndarray, np.ndarray, object]:
    """Sizes, row of each member, members."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return sizes, np.repeat(np.arange(len(sizes)), sizes), column.flatten()


class _Block:
    """One key's authors."""

    def __init__(self, key: str, rows: pa.RecordBatch):
        self.kind = blocking.KINDS.index(key.split(":", 1)[0])
        self.size = rows.num_rows
        self.rows = {c: rows.column(c) for c in rows.schema.names}
        self.ids = self.rows["author_id"].to_pylist()
        self.bare = self.rows["bare"].to_numpy(zero_copy_only=False)
        self.names, self.name_at = _distinct(self.rows["norm"].to_pylist())
        self.sorted = {}
        for c in ("coauthors", "journals"):
            sizes, owner, members = _flat(self.rows[c])
            members = members.to_numpy(zero_copy_only=False)
            order = np.argsort(members, kind="stable")
            self.sorted[c] = sizes, owner[order], members[order]
        self.orcids = np.array(self.rows["orcid"].to_pylist(), object)
        if "affiliations" in self.rows:
            self.places = [self.rows["affiliations"][i].as_py() or [] for i in range(self.size)]
        self.known_names: dict[str, np.ndarray] = {}
        self.known_places: dict[tuple, np.ndarray] = {}

    def name(self, rows) -> np.ndarray:
        names, at = _distinct(rows.column("norm").to_pylist())
        new = [x for x in names if x not in self.known_names]
        if new:
            self.known_names.update(zip(new, ratios(new, self.names)[:, self.name_at], strict=True))
        out = np.stack([self.known_names[x] for x in names])[at]
        return np.where(rows.column("bare").to_numpy(zero_copy_only=False)[:, None] | self.bare[None, :], 0.0, out)

    def overlap(self, rows, c: str, both_empty: float) -> np.ndarray:
        a_size, owner, held = self.sorted[c]
        m_size, row, asked = _flat(rows.column(c))
        asked = asked.to_numpy(zero_copy_only=False)
        low, high = np.searchsorted(held, asked, "left"), np.searchsorted(held, asked, "right")
        times = high - low
        at = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times - low, times)
        shared = np.bincount(np.repeat(row, times) * self.size + owner[at], minlength=len(m_size) * self.size).reshape(len(m_size), self.size)
        m, a = m_size[:, None], a_size[None, :]
        out = np.where((m == 0) | (a == 0), 0.0, shared / np.maximum(m + a - shared, 1))
        return np.where((m == 0) & (a == 0), both_empty, out) if both_empty else out

    def place(self, rows) -> np.ndarray:
        lists, at = _distinct([tuple(x or ()) for x in rows.column("affiliations").to_pylist()])
        new = [x for x in lists if x not in self.known_places]
        if new:
            xs, _ = _distinct([t for x in new for t in x])
            ys, flat = _distinct([t for y in self.places for t in y])
            best = np.zeros((len(xs), self.size))
            if xs and ys:
                sim = ratios(xs, ys)
                sizes = np.array([len(y) for y in self.places])
                some = np.flatnonzero(sizes)
                best[:, some] = np.maximum.reduceat(sim[:, flat], (np.cumsum(sizes) - sizes)[some], axis=1)
            where = {x: i for i, x in enumerate(xs)}
            for x in new:
                self.known_places[x] = best[[where[t] for t in x]].max(axis=0) if x else np.zeros(self.size)
        return np.stack([self.known_places[x] for x in lists])[at]

    def orcid(self, rows) -> np.ndarray:
        asked = np.array(rows.column("orcid").to_pylist(), object)
        return (asked[:, None] == self.orcids[None, :]).astype(bool) & (asked != "")[:, None]

    def met(self, rows) -> np.ndarray:
        """Whether the mention (row) has the author (column) among its candidates and meets it at this key."""
        ids: dict[str, int] = {}
        last = rows.column("last").to_pylist()
        upto = np.array([self.size if x is None else ids.setdefault(x, bisect.bisect_right(self.ids, x)) for x in last])
        out = np.arange(self.size)[None, :] < upto[:, None]
        for i in range(self.kind):
            filed = self.rows[f"k{i}"]
            there = filed.is_valid().to_numpy(zero_copy_only=False)
            filed = pc.fill_null(filed, 0).to_numpy(zero_copy_only=False)
            asked = pc.fill_null(rows.column(f"k{i}"), 0).to_numpy(zero_copy_only=False)
            out &= ~(there[None, :] & (asked[:, None] == filed[None, :]))
        return out


def _bin(feature: str, sim: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """Numbers of bins, and the bins' names."""
    names = [b for b, _ in BINS[feature]] + ["low", "none"]
    out = np.where(sim > 0, len(names) - 2, len(names) - 1)
    for k, (_, least) in reversed(list(enumerate(BINS[feature]))):
        out = np.where(sim >= least, k, out)
    return out, names


def _sims(block: _Block, rows, mode: str) -> dict[str, np.ndarray]:
    empty = 1.0 if mode == "legacy" else 0.0
    out = {"name": block.name(rows), "coauthor": block.overlap(rows, "coauthors", empty), "journal": block.overlap(rows, "journals", empty)}
    if mode == "fs":
        out |= {"affiliation": block.place(rows)}
    return out


def _bins(block: _Block, rows, sims) -> dict[str, tuple[np.ndarray, list[str]]]:
    return {f: (np.where(block.orcid(rows), 0, 1), ["match", "missing"]) if f == "orcid" else _bin(f, sims[f]) for f in FEATURES}


def _score(block: _Block, rows, mode: str, weights: dict, mu: dict) -> np.ndarray:
    from .scoring import log_ratio

    sims = _sims(block, rows, mode)
    if mode != "fs":
        return rounded(sims["name"] * weights["name"] + sims["coauthor"] * weights["coauthors"] + sims["journal"] * weights["journals"])
    total = np.zeros(sims["name"].shape)
    for f, (at, names) in _bins(block, rows, sims).items():
        parts = mu.get(f, {})
        total = total + np.array([log_ratio(*parts[b]) if b in parts else 0.0 for b in names])[at]
    values, at = np.unique(total, return_inverse=True)
    return rounded(values)[at].reshape(total.shape)


def _steps(batches):
    """(authors, some of their mentions) of each key in turn."""
    key, held, block = None, [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, tasks, side = (batch.column(c) for c in ("key", "task", "side"))
        turn = np.ones(batch.num_rows, bool)
        for k, c in enumerate((keys, tasks, side)):
            changed = pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
            turn[1:] = changed if k == 0 else turn[1:] | changed
        starts = np.flatnonzero(turn)
        for start, end in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            here = keys[start].as_py(), tasks[start].as_py()
            if here != key:
                key, held, block = here, [], None
            rows = batch.slice(start, end - start)
            if side[start].as_py() == 0:
                held.append(rows)
                continue
            if block is None and held:
                block = _Block(key[0], pa.Table.from_batches(held).combine_chunks().to_batches(max_chunksize=1 << 40)[0])
            for at in range(0, rows.num_rows if block else 0, STEP):
                yield block, rows.slice(at, STEP)


def tops(sides: DataFrame, mode: str = "baseline", k: int = 1, weights: dict = WEIGHTS, mu: dict = MU) -> DataFrame:
    """mention_id, author_id, score, n: a mention's ``k`` best candidates of each key (highest score, then smallest id), and how many it has there."""
    kind = dict(sides.dtypes)["mention_id"]

    def f(batches):
        for block, rows in _steps(batches):
            met = block.met(rows)
            n = met.sum(axis=1)
            some = np.flatnonzero(n)
            if not len(some):
                continue
            score = np.where(met, _score(block, rows, mode, weights, mu), -np.inf)[some]
            first = score.argmax(axis=1)[:, None] if k == 1 else np.argsort(-score, axis=1, kind="stable")[:, :k]  # authors are in order of their ids
            values = np.take_along_axis(score, first, 1)
            row, column = np.nonzero(values > -np.inf)
            ids = rows.column("mention_id").take(pa.array(some[row]))
            author = pa.array(block.ids, pa.string()).take(pa.array(first[row, column]))
            yield pa.RecordBatch.from_arrays([ids, author, pa.array(values[row, column]), pa.array(n[some][row].astype(np.int64))], names=["mention_id", "author_id", "score", "n"])

    return sides.mapInArrow(f, f"mention_id {kind}, author_id string, score double, n long")


def best(sides: DataFrame, mode: str = "baseline", weights: dict = WEIGHTS, mu: dict = MU) -> DataFrame:
    """mention_id, author_id, score, n as ``scoring.tops`` of all pairs."""
    rows = tops(sides, mode, 1, weights, mu)
    top = rows.groupBy("mention_id").agg(F.min_by(F.struct("author_id", "score"), F.struct((-F.col("score")).alias("s"), "author_id")).alias("top"), F.sum("n").alias("n"))
    return top.select("mention_id", "top.author_id", "top.score", "n")


def bins(sides: DataFrame) -> DataFrame:
    """Bins of all features, pairs and sums of the similarities: some rows a combination."""
    names = [f"{f}_bin" for f in FEATURES]
    shape = tuple(2 if f == "orcid" else len(BINS[f]) + 2 for f in FEATURES)

    def f(batches):
        total = np.zeros((5, int(np.prod(shape))))
        labels = None
        for block, rows in _steps(batches):
            met = block.met(rows)
            if not met.any():
                continue
            sims = _sims(block, rows, "fs")
            found = _bins(block, rows, sims)
            labels = [b for _, b in found.values()]
            code = np.ravel_multi_index([at[met] for at, _ in found.values()], shape)
            copies = np.broadcast_to(rows.column("copies").to_numpy(zero_copy_only=False)[:, None], met.shape)[met]
            for k, w in enumerate((copies, *[sims[s][met] * copies for s in SIMS])):
                total[k] += np.bincount(code, w, minlength=total.shape[1])
        some = np.flatnonzero(total[0])
        if len(some):
            at = np.unravel_index(some, shape)
            columns = [pa.array([labels[i][j] for j in at[i]], pa.string()) for i in range(len(FEATURES))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(total[0][some].astype(np.int64)), *[pa.array(total[k][some]) for k in range(1, 5)]], names=[*names, "pairs", *[f"{s}_sim" for s in SIMS]])

    return sides.mapInArrow(f, ", ".join(f"{x} string" for x in names) + ", pairs long, " + ", ".join(f"{s}_sim double" for s in SIMS))
