"""Substring deduplication by content-defined chunking.

A gear hash (each byte adds its random number, older ones shift out to the
left) over the last ``SPAN`` bytes marks a chunk's end where ``MASK_BITS`` of
its bits are zero; chunks have at least ``LEAST`` and at most ``MOST`` bytes.
Ends depend on nearby bytes alone, so an insertion moves no later chunk out of
step. Chunks are grouped by a 128-bit digest; all but the earliest (document
key, place) are repeats. Neighbouring repeats make a run while one earlier
document holds them at the same distances: chunks between two that it holds so
count with them, but passages of several documents are not stitched together.
Runs of at least ``RUN_BYTES`` bytes count, and those that are a whole document
at any length. (A shared passage's first and last chunk reach over its ends, so
up to a chunk is left at each.)

Grouping by digest is pre-aggregated, and occurrences are joined with one row
a digest (a skewed join that can be split), so no group is gathered anywhere.
A document's own repeats are gathered by document only.

Defined results: null and empty texts have no chunks; the key names a document,
so rows that repeat a key and text are one document; rows without a key are
ignored by the search and kept unchanged by ``remove_repeats``; of equal texts
the smallest key keeps its text; very long texts are chunked whole; an empty
table gives no rows; other columns of the input, whatever their names, are kept
by ``remove_repeats`` and ignored otherwise.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SPAN, MASK_BITS = 16, 5
LEAST, MOST = 16, 256
RUN_BYTES = 64
GEAR = np.random.default_rng(1_618_033).integers(0, 1 << 32, 256, dtype=np.uint32)


def gear_marks(data: np.ndarray) -> np.ndarray:
    """Places after which a chunk may end; each depends on the SPAN bytes before it."""
    h = GEAR[data]
    step = 1
    while step < SPAN:
        h[step:] += h[:-step].copy() << np.uint32(step)
        step *= 2
    marks = np.flatnonzero((h >> np.uint32(32 - MASK_BITS)) == 0) + 1
    marks = marks[(marks >= SPAN) & (marks < len(data))]
    return marks[(data[marks] & 0xC0) != 0x80]  # not inside a character


def chunk_ends(data: bytes) -> list[int]:
    """Ends of the chunks of one text."""
    n = len(data)
    marks = gear_marks(np.frombuffer(data, np.uint8)).tolist() if n else []
    out, start = [], 0
    for m in [*marks, n]:
        while m - start > MOST:
            start += MOST
            while data[start] & 0xC0 == 0x80:
                start -= 1
            out.append(start)
        if m - start >= LEAST or m == n > start:
            out.append(m)
            start = m
    return out


def chunks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, start, code, d1, d2: byte place, twice the length (and 1 if it is the document's last), and digest of every chunk."""

    def make():
        digest = xxhash.xxh3_128_intdigest

        def f(ids, texts):
            doc, starts, codes, low, high = [], [], [], [], []
            for i, t in zip(ids, texts, strict=True):
                if not t:
                    continue
                data, start = t.encode("utf-8", "surrogatepass"), 0
                for end in chunk_ends(data):
                    d = digest(data[start:end])
                    starts.append(start)
                    codes.append(2 * (end - start) + (end == len(data)))
                    low.append(d & 0xFFFFFFFFFFFFFFFF)
                    high.append(d >> 64)
                    start = end
                doc += [i] * (len(starts) - len(doc))
            signed = lambda x: np.array(x, np.uint64).view(np.int64)
            return {"doc_id": doc, "start": starts, "code": codes, "d1": signed(low), "d2": signed(high)}

        return f

    return common.map_texts(docs.where(F.col(key).isNotNull()), make, "doc_id long, start int, code int, d1 long, d2 long", key, text)


def runs(found: list[dict]) -> list[tuple[int, int, int]]:
    """(start, end, source) of the runs that count; found: a document's repeats (start, code, first document, place there) in order."""
    out, at = [], 0
    while at < len(found):
        upto = at + 1  # of the neighbours that begin here
        while upto < len(found) and found[upto]["start"] == found[upto - 1]["start"] + found[upto - 1]["code"] // 2:
            upto += 1
        held = [(x["first"], x["place"] - x["start"]) for x in found[at:upto]]
        last = {h: k for k, h in enumerate(held)}
        k = 0
        while k < len(held):
            end_chunk = found[at + last[held[k]]]
            start, end = found[at + k]["start"], end_chunk["start"] + end_chunk["code"] // 2
            if end - start >= RUN_BYTES or start == 0 and end_chunk["code"] & 1:
                out.append((start, end, held[k][0]))
            k = last[held[k]] + 1
        at = upto
    return out


def _runs(batches):
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    schema = pa.schema([("doc_id", pa.int64()), ("spans", span), ("first_doc_ids", pa.list_(pa.int64())), ("repeated_bytes", pa.int64())])
    for batch in batches:
        out = {c: [] for c in schema.names}
        for doc, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if got := runs(found):
                out["doc_id"].append(doc)
                out["spans"].append([{"start": a, "end": b} for a, b, _ in got])
                out["first_doc_ids"].append(sorted({s for _, _, s in got}))
                out["repeated_bytes"].append(sum(b - a for a, b, _ in got))
        yield pa.RecordBatch.from_pydict(out, schema=schema)


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, spans (UTF-8 byte ranges), first_doc_ids, repeated_bytes: a row for each document that repeats an earlier passage."""
    all_chunks = common.cut(chunks(docs, key, text), "chunks")
    place = F.struct("doc_id", "start")
    firsts = all_chunks.groupBy("d1", "d2").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("d1", "d2", "first")
    again = all_chunks.join(firsts, ["d1", "d2"]).where(place > F.col("first"))
    found = F.sort_array(F.collect_set(F.struct("start", "code", F.col("first.doc_id").alias("first"), F.col("first.start").alias("place"))))
    by_doc = again.groupBy("doc_id").agg(found.alias("found"))
    return common.sized(by_doc, docs.count(), common.TEXT_ROWS).mapInArrow(_runs, "doc_id long, spans array<struct<start:int,end:int>>, first_doc_ids array<long>, repeated_bytes long")


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with repeated passages cut out of their text."""
    doc, cut = common.unused("_doc", docs), common.unused("_spans", docs)
    spans = repeats(docs, key, text).select(F.col("doc_id").alias(doc), F.col("spans").alias(cut))
    raw = F.encode(F.col(text), "UTF-8")
    # kept ranges: from each span's end (0 first) to the next span's start
    ends = F.concat(F.array(F.lit(0)), F.col(cut)["end"])
    starts = F.concat(F.col(cut)["start"], F.array(F.octet_length(text)))
    kept = F.zip_with(ends, starts, lambda a, b: F.decode(F.substring(raw, a + 1, b - a), "UTF-8"))
    joined = docs.join(spans, docs[key] == spans[doc], "left")
    new = F.when(F.col(cut).isNull(), F.col(text)).otherwise(F.array_join(kept, ""))
    return common.sized(joined.withColumn(text, new).select(*docs.columns), docs.count(), common.TEXT_ROWS)
