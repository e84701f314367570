"""Encoding with a public tokenizer file, and a keyed store of raw token ids.

``Encoder`` encodes chunks between ASCII white space once and joins their ids;
for the tokenizer used here (white space dropped, no token across it) that
equals encoding the whole text: other white space, special tokens' strings and
what else there is stay inside a chunk.

The store (``write_store``) keeps raw ids in shards of ascending document
keys. A shard file is

    magic | header length (uint64) | header (JSON) | sections

with the sections keys, key flags, counts (the documents in order), levels and
ranks (a minimal perfect hash of the keys), slots (fingerprint, first id,
number of ids) and payload (raw uint16 or uint32 ids). A keyed read hashes the
key, checks the slot's fingerprint and reads one run of the payload; the
manifest's key bounds tell which shard to open (``Store.get``). Files are named
by attempt and only those in the manifest count, so retried and speculative
tasks do no harm. Other tokenizer files than those whose first steps are known
are encoded text by text.

Defined results: null text is encoded as empty (its end id alone); a null key
is stored first and found only by scanning; rows that repeat a key are all
stored, in order of their text's hash, and the index finds the first; an empty
table writes no shard; a very long text is encoded like any other, in one go;
other columns of the input are ignored.
"""

from __future__ import annotations

import itertools
import json
import os
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from . import common

END_ID = 2
#: Ids after which a task begins another shard.
SHARD_IDS = 16_000_000
#: Chunks whose ids a worker keeps (about 50 bytes each), and those encoded at once.
CACHE_CHUNKS = 1_200_000
LEARN_CHUNKS = 20_000
#: Ids that a task reads back.
READ_IDS = 16_000_000
MAGIC = b"ALSHARD1"


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: The first steps of the tokenizer files that may be encoded chunk by chunk.
_CHUNKED = {
    "normalizers": ("NFC", "Replace", "Lowercase"),
    "spaces": r"\s+",
    "pattern": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",
}
#: Words of letters that stay one letter in lower case and join with nothing after them; such a word before a stop or comma.
_WORD = "^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+$"
_STOPPED = _WORD[:-1] + "[.,]$"


#: What the last token of a word ends in.
_LAST = "</w>"


def chunked(file: dict) -> bool:
    """Whether no token of a tokenizer file's reaches over white space, words end before stops, and last tokens tell."""
    normal, before = file.get("normalizer") or {}, file.get("pre_tokenizer") or {}
    steps, splits = normal.get("normalizers", []), before.get("pretokenizers", [])
    return (
        tuple(x["type"] for x in steps) == _CHUNKED["normalizers"]
        and steps[1]["pattern"] == {"Regex": _CHUNKED["spaces"]}
        and [x["type"] for x in splits] == ["Split", "ByteLevel"]
        and splits[0]["pattern"] == {"Regex": _CHUNKED["pattern"]}
        and splits[0]["behavior"] == "Removed"
        and splits[0]["invert"]
        and not splits[1]["add_prefix_space"]
        and not file.get("post_processor")
        and file["model"]["type"] == "BPE"
        and file["model"].get("end_of_word_suffix") == _LAST
        and not any(c.isspace() for x in file.get("added_tokens", []) for c in x["content"])
    )


def _hash_strings(names: pa.Array) -> np.ndarray:
    """A 64-bit number of each string, of its bytes and their places."""
    if not len(names):
        return np.zeros(0, np.uint64)
    names = names if names.offset == 0 else pa.concat_arrays([names])
    ends = np.frombuffer(names.buffers()[1], np.int32, len(names) + 1).astype(np.int64)
    size = np.diff(ends)
    data = np.frombuffer(names.buffers()[2] or b"", np.uint8, ends[-1])[ends[0] :]
    first = ends[:-1] - ends[0]
    step = np.uint64(0x9E3779B97F4A7C15)
    place = np.arange(len(data), dtype=np.uint64) - np.repeat(first.astype(np.uint64), size) + np.uint64(1)
    mixed = (data + np.uint64(1)) * (place * step ^ (place * step) >> np.uint64(29))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed, dtype=np.uint64)])
    h = (total[first + size] - total[first]) * step
    return h ^ h >> np.uint64(32)


def _gather(pool: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs pool[start : start + size], one after another."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return pool[np.repeat((start - ends + size).astype(np.int32), size) + np.arange(total, dtype=np.int32)]


class Encoder:
    """Texts to ids; keeps the ids of chunks in one pool, in Arrow and numpy arrays."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.vocab = self.tokenizer.get_vocab_size()
        with open(path, encoding="utf-8") as f:
            self.chunked = chunked(json.load(f))
        self.last = np.zeros(self.vocab, bool)  # tokens that end a word
        for token, i in self.tokenizer.get_vocab().items():
            self.last[i] = token.endswith(_LAST)
        self._forget()

    def _forget(self) -> None:
        self.names = pa.array([], pa.string())
        self.start, self.size, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint32)
        self.hashes, self.order = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # of the names, ascending, and whose they are

    def _raw(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and each text's number of them."""
        got = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        size = np.fromiter(map(len, got), np.int32, len(got))
        return np.fromiter(itertools.chain.from_iterable(got), np.uint32, int(size.sum())), size

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As ``_raw`` for plain words, many in one text: their last tokens tell them apart."""
        ids, _ = self._raw([" ".join(words[lo : lo + 500]) for lo in range(0, len(words), 500)])
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(words) or (len(ends) and ends[-1] != len(ids)):
            return self._raw(words)
        return ids, np.diff(ends, prepend=0).astype(np.int32)

    def _keep(self, names: pa.Array, ids: np.ndarray, size: np.ndarray) -> None:
        new, n = _hash_strings(names), len(self.names)
        order = np.argsort(new, kind="stable")
        at = np.searchsorted(self.hashes, new[order])
        self.hashes, self.order = np.insert(self.hashes, at, new[order]), np.insert(self.order, at, order + n)
        self.names = pa.concat_arrays([self.names, names])
        self.start = np.concatenate([self.start, len(self.pool) + np.cumsum(size, dtype=np.int64) - size])
        self.size = np.concatenate([self.size, size])
        self.pool = np.concatenate([self.pool, ids])

    def _places(self, names: pa.Array) -> np.ndarray:
        """Each name's number, -1 for names not kept (and for those whose hash another has: they are encoded apart)."""
        if not len(self.names) or not len(names):
            return np.full(len(names), -1, np.int64)
        h = _hash_strings(names)
        by_hash = np.argsort(h)  # ascending needles are found faster
        at = np.empty(len(h), np.int64)
        at[by_hash] = np.minimum(np.searchsorted(self.hashes, h[by_hash]), len(self.hashes) - 1)
        places = self.order[at].astype(np.int64)
        return np.where(pc.equal(self.names.take(pa.array(places)), names).to_numpy(zero_copy_only=False), places, -1)

    def _learn(self, names: pa.Array) -> None:
        """Keep the ids of distinct names that are not kept yet."""
        stopped = pc.match_substring_regex(names, _STOPPED)
        words, others = names.filter(stopped), names.filter(pc.invert(stopped))
        cores, stops = pc.utf8_slice_codeunits(words, 0, -1), pc.utf8_slice_codeunits(words, -1)
        plain = pc.unique(pa.concat_arrays([cores, stops, others]))
        plain = plain.filter(pa.array(self._places(plain) < 0))
        letters = pc.match_substring_regex(plain, _WORD)
        got = []
        for some, encode in ((plain.filter(letters), self._words), (plain.filter(pc.invert(letters)), self._raw)):
            for lo in range(0, len(some), LEARN_CHUNKS):
                part = some.slice(lo, LEARN_CHUNKS)
                got.append((part, *encode(part.to_pylist())))
        if got:
            parts, ids, size = zip(*got, strict=True)
            self._keep(pa.concat_arrays(parts), np.concatenate(ids), np.concatenate(size))
        if len(words):  # a word before a stop has the word's ids, then the stop's
            both = np.stack([self._places(cores), self._places(stops)], axis=1).reshape(-1)
            known = np.repeat((both.reshape(-1, 2) >= 0).all(axis=1), 2)
            size = self.size[both[known]]
            self._keep(words.filter(pa.array(known[::2])), _gather(self.pool, self.start[both[known]], size), size.reshape(-1, 2).sum(axis=1, dtype=np.int32))

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids in one array, and where each text's end."""
        if not self.chunked:
            ids, size = self._raw(["" if x is None else x for x in texts.to_pylist()])
            return ids, np.cumsum(size, dtype=np.int64)
        chunks = pc.ascii_split_whitespace(texts)
        words = np.cumsum(pc.list_value_length(chunks).fill_null(0).to_numpy(zero_copy_only=False))
        coded = chunks.flatten().dictionary_encode()
        del chunks
        names, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        places = self._places(names)
        gaps = np.flatnonzero(places < 0)
        if len(gaps):
            missing = names.take(pa.array(gaps))
            self._learn(missing)
            places[gaps] = self._places(missing)
            for i in gaps[places[gaps] < 0]:  # a hash that two names share
                places[i] = len(self.names)
                self._keep(names.slice(i, 1), *self._raw([names[int(i)].as_py()]))
        start, size, pool = self.start[places], self.size[places], self.pool
        if len(self.names) > CACHE_CHUNKS:  # keep what these texts use
            self._forget()
            self._keep(names, pool := _gather(pool, start, size), size)
            start = self.start
        n = size[codes]
        return _gather(pool, start[codes], n), np.concatenate([[0], np.cumsum(n, dtype=np.int64)])[words]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text."""
        ids, ends = self.encode_array(pa.array(texts, pa.string()))
        return np.split(ids, ends[:-1]) if len(texts) else []


def encoder_for(path: str) -> Encoder:
    """This Python worker's encoder: its cache outlasts a task."""
    return common.worker_state(("encoder", path), lambda: Encoder(path))


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """64-bit finaliser over keys and a seed."""
    x = keys.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys.

    Keys that fall alone into a level's bit array own that bit; the others try
    the next level. A key's number is the rank of its bit over all levels.
    """

    ROOM = 2
    BLOCK = 512

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.bases = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        whole = np.zeros(-(-len(bits) // self.BLOCK) * self.BLOCK, np.int64)
        whole[: len(bits)] = bits
        per = whole.reshape(-1, self.BLOCK).sum(axis=1)
        self.ranks = np.concatenate([[0], np.cumsum(per)])
        self.inner = (np.cumsum(whole.reshape(-1, self.BLOCK), axis=1) - whole.reshape(-1, self.BLOCK)).reshape(-1).astype(np.uint16)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        left, sizes, bits = keys, [], []
        while len(left):
            m = max(1, cls.ROOM * len(left))
            at = (_mix(left, len(sizes)) % np.uint64(m)).astype(np.int64)
            alone = np.bincount(at, minlength=m) == 1
            sizes.append(m)
            bits.append(alone)
            left = left[~alone[at]]
        return cls(np.array(sizes, np.int64), np.concatenate(bits) if bits else np.zeros(0, bool))

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """Number of each key; -1 for some keys that were not given to build."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, m in enumerate(self.sizes):
            at = (_mix(keys[left], level) % np.uint64(m)).astype(np.int64) + self.bases[level]
            hit = self.bits[at]
            where = at[hit]
            out[left[hit]] = self.ranks[where // self.BLOCK] + self.inner[where]
            left = left[~hit]
        return out


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (_mix(keys, 1 << 20) >> np.uint64(32)).astype(np.uint32)


def pack_shard(keys: list[int | None], ids: list[np.ndarray], vocab: int) -> bytes:
    """A shard file of documents in ascending order of key."""
    flags = np.array([k is not None for k in keys], np.uint8)
    values = np.array([k or 0 for k in keys], np.int64)
    counts = np.array([len(x) for x in ids], np.uint64)
    starts = np.cumsum(counts) - counts
    known, first = np.unique(values[flags == 1], return_index=True)
    first = np.flatnonzero(flags)[first]
    index = PerfectHash.build(known)
    slots = np.zeros(len(known), np.dtype([("fingerprint", "<u4"), ("count", "<u8"), ("start", "<u8")]))
    numbers = index.numbers(known)
    for name, of in (("fingerprint", fingerprint(known)), ("count", counts[first]), ("start", starts[first])):
        slots[name][numbers] = of
    kind = "<u2" if vocab <= 1 << 16 else "<u4"
    payload = (np.concatenate(ids) if ids else np.zeros(0)).astype(kind)
    sections = {"keys": values.astype("<i8"), "flags": flags, "counts": counts.astype("<u8"), "levels": index.sizes.astype("<i8"), "bits": np.packbits(index.bits), "slots": slots, "payload": payload}
    at, where = 0, {}
    for name, x in sections.items():
        where[name] = (at, x.nbytes)
        at += x.nbytes
    head = json.dumps({"ids": kind, "n_docs": len(keys), "n_ids": int(counts.sum()), "sections": where}).encode()
    return b"".join([MAGIC, struct.pack("<Q", len(head)), head, *(x.tobytes() for x in sections.values())])


class Shard:
    """Reads a shard: in order of its documents, or one document by key."""

    def __init__(self, uri: str):
        system, path = pafs.FileSystem.from_uri(uri)
        self.file = system.open_input_file(path)
        if self.file.read_at(8, 0) != MAGIC:
            raise ValueError(f"not a shard: {uri}")
        (n,) = struct.unpack("<Q", self.file.read_at(8, 8))
        self.head = json.loads(self.file.read_at(n, 16))
        self.base = 16 + n
        self.kind = np.dtype(self.head["ids"])
        levels, bits = self._section("levels", "<i8"), np.unpackbits(self._section("bits", np.uint8)).astype(bool)
        self.index = PerfectHash(levels, bits[: int(levels.sum())])
        self.slots = self._section("slots", np.dtype([("fingerprint", "<u4"), ("count", "<u8"), ("start", "<u8")]))

    def _section(self, name: str, kind) -> np.ndarray:
        at, n = self.head["sections"][name]
        return np.frombuffer(self.file.read_at(n, self.base + at), kind)

    def documents(self) -> tuple[list[int | None], np.ndarray]:
        keys, flags = self._section("keys", "<i8"), self._section("flags", np.uint8)
        return [k if f else None for k, f in zip(keys.tolist(), flags.tolist(), strict=True)], self._section("counts", "<u8").astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first id or -1, number of ids) of each key, in constant time a key."""
        numbers = self.index.numbers(keys)
        known = numbers >= 0
        slot = self.slots[np.where(known, numbers, 0)] if len(self.slots) else np.zeros(len(keys), self.slots.dtype)
        known &= slot["fingerprint"] == fingerprint(keys)
        return np.where(known, slot["start"].astype(np.int64), -1), np.where(known, slot["count"].astype(np.int64), 0)

    def ids(self, start: int, count: int) -> np.ndarray:
        at, _ = self.head["sections"]["payload"]
        width = self.kind.itemsize
        return np.frombuffer(self.file.read_at(count * width, self.base + at + start * width), self.kind)

    def get(self, key: int) -> np.ndarray | None:
        start, count = self.find(np.array([key], np.int64))
        return None if start[0] < 0 else self.ids(int(start[0]), int(count[0]))


MANIFEST = "part long, seq long, path string, first_key long, last_key long, n_docs long, n_ids long"
#: Tasks of the writer whose shards' bases are summed up together.
BLOCK_TASKS = 1000


def write_store(docs: DataFrame, folder: str, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> Store:
    """Write shards and their manifest below ``folder``.

    Documents are dealt by ranges of keys, so shards ascend; a task holds one
    shard at a time. The manifest is a table with a row for each shard: its
    place in order (part, seq), path, base (ids in earlier shards), first and
    last key, n_docs, n_ids.
    """
    common.ship(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")).repartitionByRange("k", F.xxhash64("t"))
    rows = rows.sortWithinPartitions("k", F.xxhash64("t"))

    def run(batches):
        encoder, system, root = encoder_for(tokenizer), *pafs.FileSystem.from_uri(folder)
        kind = np.uint16 if encoder.vocab <= 1 << 16 else np.uint32
        system.create_dir(root, recursive=True)
        part, seq, keys, ids, held = TaskContext.get().partitionId(), 0, [], [], 0

        def flush():
            name = f"shard-{part:06d}-{seq:04d}-{uuid.uuid4().hex}.ids"
            with system.open_output_stream(f"{root}/{name}") as out:
                out.write(pack_shard(keys, ids, encoder.vocab))
            known = [k for k in keys if k is not None] or [None]
            row = {"part": part, "seq": seq, "path": f"{folder}/{name}", "first_key": known[0], "last_key": known[-1], "n_docs": len(keys), "n_ids": held}
            return pa.RecordBatch.from_pydict({c: [v] for c, v in row.items()}, schema=arrow)

        for batch in batches:
            for lo, n in common.spans(batch.column(1)):
                flat, ends = encoder.encode_array(batch.column(1).slice(lo, n))
                flat, at = flat.astype(kind), 0
                for k, end in zip(batch.column(0).slice(lo, n).to_pylist(), ends.tolist(), strict=True):
                    x = np.append(flat[at:end], kind(end_id))
                    at = end
                    keys.append(k)
                    ids.append(x)
                    held += len(x)
                    if held >= shard_ids:
                        yield flush()
                        seq, keys, ids, held = seq + 1, [], [], 0
        if keys:
            yield flush()

    arrow = pa.schema([(x.split()[0], pa.string() if x.endswith("string") else pa.int64()) for x in MANIFEST.split(", ")])
    written = common.cut(rows.mapInArrow(run, MANIFEST).repartition(1), "shards")  # a row for each shard
    # ids before a shard: in its block of tasks, and in the blocks before
    blocks = written.withColumn("block", F.floor(F.col("part") / BLOCK_TASKS))
    earlier = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = blocks.groupBy("block").agg(F.sum("n_ids").alias("n_ids")).select("block", earlier(Window.orderBy("block")).alias("before"))
    inner = blocks.withColumn("base", earlier(Window.partitionBy("block").orderBy("part", "seq")))
    based = inner.join(sums, "block").select(*written.columns, (F.col("base") + F.col("before")).alias("base"))
    based.write.mode("overwrite").parquet(f"{folder}/manifest")
    common.discard(written)
    return Store(docs.sparkSession, folder)


class Store:
    """A written store: one document by key, or all in order."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.manifest = spark.read.schema(f"{MANIFEST}, base long").parquet(f"{folder}/manifest")

    def get(self, key: int) -> np.ndarray | None:
        """The ids of the key's document (of rows that repeat a key, the first); reads the one shard whose keys reach over it."""
        for r in self.manifest.where((F.col("first_key") <= key) & (F.col("last_key") >= key)).orderBy("part", "seq").select("path").limit(2).collect():
            if (ids := Shard(r["path"]).get(key)) is not None:
                return ids
        return None

    def documents(self, with_ids: bool = False) -> DataFrame:
        return read_store(self.spark, self.manifest, with_ids)


def read_store(spark: SparkSession, manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of every stored document, read from the files through their index."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    common.ship(spark)
    n = manifest.agg(F.count("*").alias("shards"), F.sum("n_ids").alias("ids")).first()
    tasks = max(1, min(n["shards"], -(-(n["ids"] or 0) // READ_IDS)))
    shards = manifest.select("path", "base").repartition(tasks)

    def run(batches):
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = Shard(path)
                keys, counts = shard.documents()
                in_order = np.cumsum(counts) - counts
                start, count = shard.find(np.array([k or 0 for k in keys], np.int64))
                again = np.array([k is None or (i > 0 and k == keys[i - 1]) for i, k in enumerate(keys)], bool)
                start, count = np.where(again, in_order, start), np.where(again, counts, count)
                for lo in range(0, len(keys), 1000):
                    got = [shard.ids(int(s), int(n)) for s, n in zip(start[lo : lo + 1000], count[lo : lo + 1000], strict=True)]
                    out = {"doc_id": keys[lo : lo + 1000], "start": start[lo : lo + 1000] + base, "n_tokens": count[lo : lo + 1000], "ids_crc32": [crc(x) for x in got]}
                    if with_ids:
                        out["ids"] = [x.astype(np.int32) for x in got]
                    yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.list_(pa.int32()) if k == "ids" else pa.int64()) for k, v in out.items()})

    return shards.mapInArrow(run, schema)
