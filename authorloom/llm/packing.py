"""Hierarchical multi-length packing.

Documents are routed to context-size tiers (powers of two up to the longest):
whole windows are cut off long documents, and the rest goes to the smallest
tier that holds it. Tiers are packed from the longest down: a window takes one
piece of its tier, then the largest pieces that fit from its own and shorter
tiers, and the last gap is filled by cutting a piece of a shorter tier. So
windows are full at a tier's size, which needs no padding; the last, partly
filled window of a task is padded.

Full windows are dealt to balanced step groups. Windows of one tier that hold
as many ids together as the longest make a unit; units of all tiers take turns
in proportion to their numbers, and ``STEP_UNITS`` units are a group. So every
group has the same number of ids and about the same mixture of lengths. What
fills no group goes back to be packed again; the groups of a task's remainder
can be short and have negative numbers.

A task packs what it reads, ``BUFFER_IDS`` ids at a time, and what is left of
a buffer goes on to the next; there is no shuffle. Sequence numbers start at
the task's number times 2**40, and so do step groups.

Defined results: a null or empty text is its end id alone; a very long text is
cut into whole windows and a rest; repeated rows are packed each; a null key is kept as null; an empty table gives no rows; other
columns of the input are ignored.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, tokens

WINDOW = 2048
TIERS = (256, 512, 1024, 2048)
#: Ids that a task gathers before it packs them.
BUFFER_IDS = 1_000_000
END_ID = 1
#: A step group has as many ids as so many of the longest windows.
STEP_UNITS = 16


class _Pool:
    """Pieces (length, document, start) by length, to take the largest that fits."""

    def __init__(self):
        self.lengths: list[int] = []
        self.by: dict[int, list[tuple[int, int]]] = {}

    def add(self, length: int, doc: int, start: int) -> None:
        if length not in self.by:
            self.by[length] = []
            bisect.insort(self.lengths, length)
        self.by[length].append((doc, start))

    def take(self, most: int) -> tuple[int, int, int] | None:
        """The largest piece of at most ``most`` ids."""
        at = bisect.bisect_right(self.lengths, most) - 1
        if at < 0:
            return None
        length = self.lengths[at]
        doc, start = self.by[length].pop()
        if not self.by[length]:
            del self.by[length]
            self.lengths.pop(at)
        return length, doc, start

    def shortest(self) -> int | None:
        return self.lengths[0] if self.lengths else None


def pack(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> tuple[list[tuple[int, list[tuple[int, int, int]]]], list[tuple[int, int, int]]]:
    """(tier, pieces) of full windows, and the pieces that do not fill one.

    A piece is (document, start, length). Every id of every document is in one piece.
    """
    window, pool, full = tiers[-1], _Pool(), []
    for doc, n in enumerate(lengths):
        whole = n // window * window
        full += [(window, [(doc, at, window)]) for at in range(0, whole, window)]
        if n > whole:
            pool.add(n - whole, doc, whole)
    for k in range(len(tiers) - 1, -1, -1):
        tier, below = tiers[k], tiers[k - 1] if k else 0
        while pool.lengths and pool.lengths[-1] > below:  # a piece routed to this tier is left
            pieces, room = [], tier
            while room:
                got = pool.take(room)
                if got:
                    length, doc, start = got
                    pieces.append((doc, start, length))
                    room -= length
                    continue
                shortest = pool.shortest()
                if shortest is None:
                    break
                length, doc, start = pool.take(shortest)  # all are longer than the gap: cut the shortest
                pieces.append((doc, start, room))
                pool.add(length - room, doc, start + room)
                room = 0
            if room:
                return full, pieces
            full.append((tier, pieces))
    return full, []


def step_groups(windows: list[tuple[int, list]], longest: int, units: int = STEP_UNITS) -> tuple[list[list[tuple[int, list]]], list[tuple[int, list]]]:
    """Groups of windows of ``units`` * ``longest`` ids each, and the windows that fill none."""
    by_tier: dict[int, list] = {}
    for w in windows:
        by_tier.setdefault(w[0], []).append(w)
    turns, left = [], []
    for tier, of in by_tier.items():
        n = longest // tier
        whole = len(of) // n
        turns += [((i + 0.5) / whole, -tier, of[i * n : (i + 1) * n]) for i in range(whole)]
        left += of[whole * n :]
    turns.sort(key=lambda x: x[:2])
    full = len(turns) // units * units
    groups = [[w for _, _, unit in turns[at : at + units] for w in unit] for at in range(0, full, units)]
    return groups, [w for _, _, unit in turns[full:] for w in unit] + left


def pack_documents(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID, tiers: tuple[int, ...] = TIERS, with_ids: bool = False, buffer_ids: int = BUFFER_IDS) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group (and ids): a row for each piece."""
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long" + ", ids array<int>" * with_ids
    common.ship(docs.sparkSession)
    chosen = docs.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = {"tier": pa.int32(), "ids": pa.list_(pa.int32())}

    def run(batches):
        encoder = tokens.encoder_for(tokenizer)
        base = TaskContext.get().partitionId() << 40
        next_id = next_group = base
        held: list[tuple[int | None, np.ndarray, int, int]] = []  # key, ids left, their start, all ids of the document

        def rows(groups):
            """Rows of the windows of numbered groups."""
            nonlocal next_id
            out = {c: [] for c in names}
            for group, windows in groups:
                for tier, pieces in windows:
                    offset = 0
                    for doc, start, n in pieces:
                        k, ids, first, total = held[doc]
                        some = ids[start : start + n]
                        for c, v in zip(names, (k, first + start, n, tokens.crc(some), total, next_id, offset, tier, group), strict=False):
                            out[c].append(v)
                        if with_ids:
                            out["ids"].append(some.astype(np.int32))
                        offset += n
                    next_id += 1
            return pa.RecordBatch.from_pydict({c: pa.array(v, kinds.get(c, pa.int64())) for c, v in out.items()})

        def numbered(groups):
            nonlocal next_group
            first, next_group = next_group, next_group + len(groups)
            return zip(range(first, next_group), groups, strict=True)

        size = 0
        for batch in batches:
            for lo, n in common.spans(batch.column(1)):
                flat, ends = encoder.encode_array(batch.column(1).slice(lo, n))
                at = 0
                for k, end in zip(batch.column(0).slice(lo, n).to_pylist(), ends.tolist(), strict=True):
                    ids = np.append(flat[at:end], np.uint32(end_id))
                    at = end
                    held.append((k, ids, 0, len(ids)))
                    size += len(ids)
                if size >= buffer_ids:
                    full, rest = pack([len(x[1]) for x in held], tiers)
                    groups, left = step_groups(full, tiers[-1])
                    yield rows(numbered(groups))
                    rest = [*rest, *(piece for _, pieces in left for piece in pieces)]
                    held = [(held[d][0], held[d][1][s : s + n].copy(), held[d][2] + s, held[d][3]) for d, s, n in rest]
                    size = sum(len(x[1]) for x in held)
        if held:
            full, rest = pack([len(x[1]) for x in held], tiers)
            groups, left = step_groups(full, tiers[-1])
            left += [(min(t for t in tiers if t >= sum(p[2] for p in rest)), rest)] if rest else []
            left.sort(key=lambda w: -w[0])
            before = np.cumsum([0, *(t for t, _ in left)]) // (STEP_UNITS * tiers[-1])
            yield rows([*numbered(groups), *((-1 - base - int(j), [w]) for j, w in zip(before, left, strict=False))])

    return chosen.mapInArrow(run, schema)
