"""Shared plumbing of the training-data operators.

``map_texts`` maps (id, text) rows in Arrow batches and bounded slices. ``cut``
and the like come from ``storage``: intermediate tables in the shared folder.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from ..storage import TEXT_ROWS, cut, delete, discard, free, owned, reclaim, scratch, sized, tidy

__all__ = ["TEXT_ROWS", "cut", "delete", "discard", "free", "owned", "reclaim", "scratch", "ship", "sized", "tidy", "map_texts", "slices", "spans", "unused", "WordIds", "worker_state"]

#: Characters of text handled at once inside a Python worker; arrays made of them hold some hundred times as many bytes.
SLICE_BYTES = 1 << 20
#: Bytes of text encoded at once; more repeat more words.
SPAN_BYTES = 4 << 20
#: Entries kept by a per-worker word cache before it is dropped.
CACHE_WORDS = 200_000


def slices(ids: list, texts: list, most: int = SLICE_BYTES):
    """Consecutive runs of rows whose texts hold about ``most`` characters."""
    at = held = 0
    for k, text in enumerate(texts):
        held += len(text or "")
        if held >= most:
            yield ids[at : k + 1], texts[at : k + 1]
            at, held = k + 1, 0
    if at < len(ids):
        yield ids[at:], texts[at:]


def spans(texts: pa.Array, most: int = SPAN_BYTES):
    """(first row, rows) of consecutive runs of about ``most`` bytes of an Arrow string column."""
    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(ends):
        done = ends[at - 1] if at else 0
        upto = max(at + 1, int(np.searchsorted(ends, done + most, "right")))
        yield at, upto - at
        at = upto


def map_texts(df: DataFrame, make, schema: str, key: str = "doc_id", text: str = "text", extra: tuple[str, ...] = ()) -> DataFrame:
    """Map rows through ``make()``, called once a task.

    ``make`` returns a function of (ids, texts, *extras) to a dict of output
    columns. Only the key, the text and ``extra`` columns are read. A slice
    is bounded by SLICE_BYTES plus one row.
    """
    ship(df.sparkSession)
    columns = [F.col(key).cast("long").alias("_id"), F.col(text).cast("string").alias("_text"), *[F.col(c) for c in extra]]
    chosen = df.select(*columns)
    target = chosen.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(target)

    def run(batches):
        f = make()
        for batch in batches:
            got = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            at = 0
            for ids, texts in slices(got[0], got[1]):
                n = len(ids)
                out = f(ids, texts, *[x[at : at + n] for x in got[2:]])
                at += n
                if out is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(out[c.name], type=c.type, from_pandas=True) for c in arrow], schema=arrow)

    return chosen.mapInArrow(run, target)


class WordIds(dict):
    """Word -> number, numbered on first sight by ``number(word)``."""

    def __init__(self, number):
        super().__init__()
        self.number = number

    def __missing__(self, word):
        self[word] = out = self.number(word)
        return out


def unused(name: str, df: DataFrame) -> str:
    """A column name like ``name`` that the table does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


_held: list = [None, None]


def worker_state(key, make):
    """What ``make()`` gave for this key in this Python worker, kept over tasks; one key is held at a time.

    The memory of another key's state goes back to the system first.
    """
    if _held[0] != key:
        _held[:] = [None, None]
        release()
        _held[:] = [key, make()]
    return _held[1]


def release() -> None:
    """Give memory that nothing holds back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only with this C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)
