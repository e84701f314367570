"""The ten operators against brute-force versions, and their defined results on odd input."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from authorloom.llm import decontam, fingerprints, lang_id, line_dedup, packing, quality, simhash, substring_dedup, tokens, url_filter
from authorloom.llm import queries as Q

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, first string, n int"


def docs_of(spark, rows):
    """Documents with further columns whose names clash with internal ones."""
    return spark.createDataFrame([(k, t, "en", "s", None, 7, "x", 1) for k, t in rows], SCHEMA)


ODD = [(1, None), (2, ""), (3, "   \n\n "), (4, "word"), (5, "two words"), (6, "日本語 テキスト"), (7, "x" * 5000), (8, "same text here, twice"), (8, "same text here, twice"), (9, "a b c " * 4000), (None, "no key at all")]


@pytest.fixture(scope="module")
def odd(spark):
    return docs_of(spark, ODD)


@pytest.fixture(scope="module")
def none(spark):
    return docs_of(spark, [])


# ---- 1: URL filter -----------------------------------------------------------

def test_url_filter_as_of(spark):
    events = spark.createDataFrame([
        ("b", "block", "bad.com", True, "2024-01-10"), ("b", "block", "bad.com", False, "2024-02-10"), ("b", "block", "bad.com", True, "2024-06-01"),
        ("b", "block", "bad.com", True, "2024-06-01"), ("b", "block", "site.org/ads", True, "2024-01-01"), ("a", "allow", "good.bad.com", True, "2024-01-01"),
        ("b", "block", None, True, "2024-01-01"), ("b", "block", "x.com", True, None), ("c", "block", "both.com", True, "2024-01-01"), ("c", "block", "both.com", False, "2024-01-01"),
    ], "list string, action string, pattern string, added boolean, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    captures = spark.createDataFrame([
        (1, "http://bad.com/x", "2024-01-09"), (2, "http://www.BAD.com/x", "2024-01-10"), (3, "http://bad.com/x", "2024-02-10"), (4, "https://u@bad.com:80/y?q", "2024-07-01"),
        (5, "http://site.org/ads/1", "2024-03-01"), (6, "http://site.org/news", "2024-03-01"), (7, "http://good.bad.com/", "2024-01-20"), (8, None, "2024-01-20"),
        (9, "not a url", "2024-01-20"), (10, "http://bad.com", None), (11, "http://notbad.com/", "2024-01-20"), (12, "http://both.com", "2024-03-01"),
    ], "page_id long, url string, ts string").select("page_id", "url", F.col("ts").cast("timestamp").alias("fetch_ts"))
    got = {r["page_id"]: r["action"] for r in url_filter.filter_urls(captures, events).collect()}
    assert got == {1: "none", 2: "block", 3: "none", 4: "block", 5: "block", 6: "none", 7: "allow", 8: "none", 9: "none", 10: "none", 11: "none", 12: "none"}
    assert url_filter.filter_urls(captures.limit(0), events).count() == 0
    assert {r["action"] for r in url_filter.filter_urls(captures, events.limit(0)).collect()} == {"none"}


def test_url_filter_judges_each_capture_at_its_time(spark):
    events = spark.createDataFrame([("b", "block", "bad.com", True, "2024-01-10"), ("b", "block", "bad.com", False, "2024-02-10")], "list string, action string, pattern string, added boolean, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    long = "http://bad.com/" + "x/" * 2000
    rows = [(1, "http://bad.com/a", "2024-01-01"), (1, "http://bad.com/a", "2024-02-01"), (1, "http://bad.com/a", "2024-02-01"), (1, "http://ok.com/a", "2024-02-01"), (None, "http://bad.com/", "2024-02-01"), (2, long, "2024-02-01")]
    captures = spark.createDataFrame(rows, "page_id long, url string, ts string").select("page_id", "url", F.col("ts").cast("timestamp").alias("fetch_ts"), F.lit(1).alias("host"), F.lit(2).alias("pattern"), F.lit(3).alias("h1"), F.lit(4).alias("action"))
    got = sorted((r["page_id"] or 0, r["host"], r["action"]) for r in url_filter.filter_urls(captures, events).collect())
    assert got == [(0, "bad.com", "block"), (1, "bad.com", "block"), (1, "bad.com", "block"), (1, "bad.com", "none"), (1, "ok.com", "none"), (2, "bad.com", "block")]


# ---- 2: language id ----------------------------------------------------------

def plain_viterbi(scores, switch):
    best = list(scores[0])
    back = []
    for row in scores[1:]:
        top = int(np.argmax(best))
        step = [k if best[k] >= best[top] - switch else top for k in range(len(row))]
        best = [max(best[k], best[top] - switch) + row[k] for k in range(len(row))]
        back.append(step)
    state = int(np.argmax(best))
    out = [state]
    for step in reversed(back):
        state = step[state]
        out.append(state)
    return out[::-1]


def test_viterbi_against_plain_version():
    rng = np.random.default_rng(0)
    scores = [rng.normal(0, 3, (n, 3)).astype(np.float32) for n in (1, 40, 0, 7, 40, 300)]
    for got, s in zip(lang_id.viterbi(scores, 2.5), scores, strict=True):
        assert got.tolist() == (plain_viterbi(s.astype(float), 2.5) if len(s) else [])


def test_language_spans_and_scripts(spark, odd, none):
    train = spark.createDataFrame([(i, t * 20, lang) for i, (t, lang) in enumerate([("the cat and the dog ", "en"), ("der hund und die katze ", "de"), ("кот и собака ", "ru"), ("x", None)])], "doc_id long, text string, lang string")
    model = lang_id.train(train)
    labeller = lang_id.Labeller(model)
    assert [s[2] for s in labeller.spans("the dog and the cat and the dog der hund und die katze und der hund")] == ["en", "de"]
    assert [s[2] for s in labeller.spans("собака")] == ["ru"]  # the script leaves one candidate
    got = {(r["doc_id"], r["lang_pred"], r["score"]) for r in lang_id.identify(odd, model).collect()}
    assert {(1, "und", 0.0), (2, "und", 0.0), (3, "und", 0.0)} <= got and len(lang_id.identify(odd, model).collect()) == len(ODD)
    assert all(0 <= s <= 1 for _, _, s in got)
    assert {r["lang_pred"] for r in lang_id.identify(odd, lang_id.train(none)).collect()} == {"und"}
    assert lang_id.identify(none, model).count() == 0


def test_language_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    got = Q.op2_language_id(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL").toPandas()
    assert len(got) > 100 and (got["lang"] == got["lang_pred"]).mean() > 0.95


# ---- 3: SimHash --------------------------------------------------------------

def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fingerprint):
    """doc -> smallest doc reachable, comparing all pairs."""
    root = {d: d for d in fingerprint}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(fingerprint)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (fingerprint[a] ^ fingerprint[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


@pytest.mark.parametrize("limit", [1, 3, 32])
def test_links_against_all_pairs(spark, limit):
    rng = random.Random(limit)
    base = [rng.getrandbits(64) for _ in range(12)]
    values = set(base)
    for _ in range(250):
        x = rng.choice(sorted(values))
        for _ in range(rng.randint(1, 3)):
            x ^= 1 << rng.randrange(64)
        values.add(x)
    values = sorted(values)
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    frame = spark.createDataFrame(signed, "fp long")
    got = simhash.links(frame, len(signed), limit).collect()
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 2 for a, b in got)
    want = plain_components(dict(enumerate(values)))
    from authorloom.operators.components import components

    roots = {r["node"]: r["root"] for r in components(simhash.links(frame, len(signed), limit)).collect()}
    groups = {}
    for k, (v,) in enumerate(signed):
        groups.setdefault(roots.get(v, v), []).append(k)
    assert {d: min(g) for g in groups.values() for d in g} == want


def test_simhash_query_against_brute_force(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    prints = {r["doc_id"]: plain_fingerprint(r["text"]) for r in rows}
    want = {(d, f"{prints[d]:016x}", c) for d, c in plain_components(prints).items()}
    assert {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in Q.op3_simhash(spark, sf_dir).collect()} == want


def test_simhash_odd_input(odd, none):
    got = [tuple(r) for r in simhash.near_duplicates(odd).collect()]
    assert len(got) == len(ODD)
    assert {c for d, f, c in got if f == "0" * 16} == {1}
    assert {f for d, f, _ in got} == {f"{plain_fingerprint(t):016x}" for _, t in ODD}
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.keep_one(odd).collect()
    assert {r["doc_id"] for r in kept} >= {None, 1, 4, 8} and not {2, 3} & {r["doc_id"] for r in kept}
    assert kept[0].asDict().keys() == odd.first().asDict().keys()


# ---- 4 and 6: tokens and packing ---------------------------------------------

def plain_ids(text):
    from tokenizers import Tokenizer

    global _T
    if "_T" not in globals():
        _T = Tokenizer.from_file(tokens.tokenizer_path())
    return _T.encode(text or "", add_special_tokens=False).ids


TRICKY = ["  lead  and trail \n\n", "nb\xa0sp \u2003 em\x85x \u2028.", "It's l'été, don't! we'll.", "Σας. ΑΣ. ", "a<|endoftext|>b <|startoftext|>", "x\x1cy\x1fz ᠎", "é., a.. b,. .", "가. é. ½,", "İstanbul. ǅ.", "a b c", ""]


def test_encoder_equals_the_tokenizer():
    e = tokens.Encoder(tokens.tokenizer_path())
    for _ in range(2):  # with a cold and a warm cache
        for text, raw in zip(TRICKY, e.encode(TRICKY), strict=True):
            assert raw.tolist() == plain_ids(text)


def test_encoder_on_every_character_before_a_stop():
    """Each code point ends a word before a stop and a comma, alone and after letters."""
    points = [c for c in map(chr, range(0x21, 0x30000)) if not 0xD800 <= ord(c) < 0xE000 and not c.isspace()]
    points = [c for c in points if ord(c) < 0x3000 or ord(c) % 97 == 0]
    texts = [f"{c}. x{c}. ab{c}, {c}," for c in points]
    e = tokens.Encoder(tokens.tokenizer_path())
    assert e.chunked
    for lo in range(0, len(texts), 5000):
        some = texts[lo : lo + 5000]
        want = [x.ids for x in e.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
        assert [x.tolist() for x in e.encode(some)] == want


def test_encoder_forgets_and_survives_equal_hashes(monkeypatch):
    words = [f"{a}{b}{c}" for a in ("ab", "Que", "thi") for b in "aeiou" for c in ("", ".", ",", "x9", "'s")]
    want = [plain_ids(w) for w in words]
    monkeypatch.setattr(tokens, "CACHE_CHUNKS", 20)
    e = tokens.Encoder(tokens.tokenizer_path())
    for lo in range(0, len(words), 10):
        assert [x.tolist() for x in e.encode(words[lo : lo + 10])] == want[lo : lo + 10]
    assert len(e.names) <= 60
    monkeypatch.setattr(tokens, "_hash_strings", lambda names: np.array([len(x.as_py()) for x in names], np.uint64))
    e = tokens.Encoder(tokens.tokenizer_path())
    for _ in range(2):
        assert [x.tolist() for x in e.encode([" ".join(words)])] == [[i for x in want for i in x]]


def test_other_tokenizers_encode_whole_texts():
    from tokenizers import Tokenizer

    path = tokens.tokenizer_path("byte_bpe_50k.json")
    e = tokens.Encoder(path)
    assert not e.chunked
    assert [x.tolist() for x in e.encode(TRICKY)] == [Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids for t in TRICKY]


def test_perfect_hash_is_minimal_and_rejects():
    keys = np.unique(np.random.default_rng(1).integers(-(2**60), 2**60, 20_000))
    index = tokens.PerfectHash.build(keys)
    assert sorted(index.numbers(keys)) == list(range(len(keys)))
    assert tokens.PerfectHash.build(keys[:0]).numbers(keys[:3]).tolist() == [-1, -1, -1]


def crc_of(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_store_round_trip(spark, odd, none, tmp_path, monkeypatch):
    rows = odd.union(docs_of(spark, [(20 + i, t) for i, t in enumerate(TRICKY)]))
    store = tokens.write_store(rows, f"file://{tmp_path}/store", tokens.tokenizer_path(), shard_ids=300)
    got = store.documents(with_ids=True).orderBy("start").collect()
    want = sorted([*ODD, *((20 + i, t) for i, t in enumerate(TRICKY))], key=lambda x: (x[0] is not None, x[0] or 0))
    assert [r["doc_id"] for r in got] == [k for k, _ in want]
    start = 0
    for r, (_, text) in zip(got, want, strict=True):
        ids = [*plain_ids(text), tokens.END_ID]
        assert (r["start"], r["n_tokens"], r["ids"], r["ids_crc32"]) == (start, len(ids), ids, crc_of(ids))
        start += len(ids)
    opened = []
    real = tokens.Shard
    monkeypatch.setattr(tokens, "Shard", lambda path: opened.append(path) or real(path))
    assert store.manifest.count() > 1
    assert store.get(22).tolist() == [*plain_ids(TRICKY[2]), 2] and len(opened) == 1
    assert store.get(999) is None and store.get(-5) is None and len(opened) == 1
    assert tokens.Store(spark, store.folder).get(4).tolist() == [*plain_ids("word"), 2]
    empty = tokens.write_store(none, f"file://{tmp_path}/none", tokens.tokenizer_path())
    assert empty.documents().count() == 0 and empty.get(1) is None


def check_pieces(rows, texts):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(texts)
    for k, pieces in by_doc.items():
        ids = [*plain_ids(texts[k]), packing.END_ID]
        at = 0
        for p in sorted(pieces, key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids) and p["ids_crc32"] == crc_of(ids[at : at + p["length"]])
            at += p["length"]
        assert at == len(ids)
    used = waste = 0
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 2048
        used += at
        waste += 0 if at & (at - 1) == 0 else 2048 - at
    return used, waste


def test_packing_query(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    used, waste = check_pieces(Q.op6_packing(spark, sf_dir).collect(), texts)
    assert waste <= 2048 * 4 and waste < 0.02 * used


def test_step_groups_are_equal():
    lengths = np.random.default_rng(5).lognormal(5.5, 1.2, 20_000).astype(int) + 1
    full, _ = packing.pack(lengths.tolist())
    groups, left = packing.step_groups(full, packing.WINDOW)
    assert {sum(t for t, _ in g) for g in groups} == {packing.STEP_UNITS * packing.WINDOW}
    assert sum(t for t, _ in left) < (packing.STEP_UNITS + 3) * packing.WINDOW
    assert sum(len(g) for g in groups) + len(left) == len(full)
    shares = [sum(t for t, _ in g if t == packing.WINDOW) for g in groups]
    assert max(shares) - min(shares) <= 4 * packing.WINDOW  # the mixture is about the same


def test_step_groups_of_the_operator(spark):
    rows = docs_of(spark, [(k, "word next " * (10 + k * 37 % 900)) for k in range(600)]).coalesce(1)
    got = packing.pack_documents(rows, tokens.tokenizer_path(), buffer_ids=60_000).groupBy("step_group").sum("length").collect()
    whole = [r["sum(length)"] for r in got if r["step_group"] >= 0]
    assert len(whole) > 5 and set(whole) == {packing.STEP_UNITS * packing.WINDOW}
    assert all(r["sum(length)"] <= whole[0] for r in got)


def test_packing_odd_input_and_small_buffers(spark, odd, none):
    single = odd.where("doc_id IS NULL OR doc_id <> 8").union(docs_of(spark, [(30, "long text here. " * 3000)]))
    texts = {r["doc_id"]: r["text"] for r in single.collect()}
    check_pieces(packing.pack_documents(single, tokens.tokenizer_path(), buffer_ids=500).collect(), texts)
    assert packing.pack_documents(odd, tokens.tokenizer_path()).count() >= len(ODD)
    assert packing.pack_documents(none, tokens.tokenizer_path()).count() == 0
    ids = packing.pack_documents(single, tokens.tokenizer_path(), with_ids=True).where("doc_id = 4").first()["ids"]
    assert ids == [*plain_ids("word"), 1]


def test_pack_fills_windows():
    rng = random.Random(5)
    lengths = [rng.choice([rng.randint(1, 300), rng.randint(1, 2500), rng.randint(1, 9000)]) for _ in range(500)]
    full, rest = packing.pack(lengths)
    assert all(sum(p[2] for p in pieces) == tier for tier, pieces in full) and sum(p[2] for p in rest) < 2048
    seen = {}
    for d, s, n in [p for _, pieces in full for p in pieces] + rest:
        seen.setdefault(d, []).append((s, n))
    assert all(sorted(v)[0][0] == 0 and sum(n for _, n in v) == lengths[d] for d, v in seen.items()) and len(seen) == len(lengths)


# ---- 5: substring dedup ------------------------------------------------------

def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(["ka", "lo", "mi", "tu", "re", "sha", "on", "ix"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def test_chunks_resist_shifts():
    text = prose(1, 2000).encode()
    ends = substring_dedup.chunk_ends(text)
    assert ends[-1] == len(text) and all(0 < b - a <= substring_dedup.MOST for a, b in zip([0, *ends], ends, strict=False))
    parts = lambda t: {t[a:b] for a, b in zip([0, *substring_dedup.chunk_ends(t)], substring_dedup.chunk_ends(t), strict=False)}
    moved = parts(b"inserted words " + text)
    assert len(parts(text) - moved) <= 3
    slow = []
    for i in range(substring_dedup.SPAN, len(text)):  # the gear hash, byte by byte
        h = 0
        for b in text[i - substring_dedup.SPAN : i]:
            h = ((h << 1) + int(substring_dedup.GEAR[b])) & 0xFFFFFFFF
        if h >> (32 - substring_dedup.MASK_BITS) == 0:
            slow.append(i)
    assert substring_dedup.gear_marks(np.frombuffer(text, np.uint8)).tolist() == slow


def test_repeated_passages_are_found_and_clean_ones_left(spark, odd, none):
    shared = prose(99, 60)
    rows = [(10 + i, f"{prose(i, 80)} {shared} {prose(1000 + i, 80)}") for i in range(5)] + [(50 + i, prose(2000 + i, 150)) for i in range(5)] + [(70, prose(2000, 150))]
    got = {r["doc_id"]: r for r in substring_dedup.repeats(docs_of(spark, rows)).collect()}
    assert set(got) == {11, 12, 13, 14, 70}
    assert all(got[k]["first_doc_ids"] == [10] and got[k]["repeated_bytes"] > 0.6 * len(shared) for k in (11, 12, 13, 14)) and got[70]["first_doc_ids"] == [50]
    clean = {r["doc_id"]: r["text"] for r in substring_dedup.remove_repeats(docs_of(spark, rows)).collect()}
    assert clean[10] == dict(rows)[10] and clean[50] == dict(rows)[50] and clean[70] == "" and len(clean[11]) < len(dict(rows)[11]) - 0.6 * len(shared)
    assert substring_dedup.repeats(none).count() == 0 and substring_dedup.remove_repeats(none).count() == 0
    kept = substring_dedup.remove_repeats(odd)
    assert kept.count() == len(ODD) and kept.columns == odd.columns
    assert {r["text"] for r in kept.where("doc_id IS NULL OR doc_id < 7").collect()} == {t for k, t in ODD if k is None or k < 7}


def plain_chunks(data):
    """Ends of chunks, byte by byte."""
    d = substring_dedup
    mask, ends, start, h = (1 << 32) - 1, [], 0, 0
    for i, byte in enumerate(data, 1):
        if i > d.SPAN:
            h -= int(d.GEAR[data[i - 1 - d.SPAN]]) << (d.SPAN - 1)
        h = ((h << 1) + int(d.GEAR[byte])) & mask
        inside = i < len(data) and data[i] & 0xC0 == 0x80
        marked = i >= d.SPAN and h >> (32 - d.MASK_BITS) == 0 and not inside
        if i == len(data) or (marked and i - start >= d.LEAST):
            while i - start > d.MOST:
                start += d.MOST
                while data[start] & 0xC0 == 0x80:
                    start -= 1
                ends.append(start)
            if i - start >= d.LEAST or i == len(data):
                ends.append(i)
                start = i
    return ends


def test_repeats_query_against_plain_version(spark, sf_dir):
    texts = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    first, want = {}, {}
    for k, t in texts:
        data, start, chunks = t.encode(), 0, []
        for end in plain_chunks(data):
            source = first.setdefault(data[start:end], (k, start))
            chunks.append((start, end, source if source != (k, start) else None))
            start = end
        spans, i = [], 0
        while i < len(chunks):
            if chunks[i][2] is None:
                i += 1
                continue
            j = last = i  # the farthest repeat before the next new chunk that the same document holds at the same distance
            while j < len(chunks) and chunks[j][2]:
                if (chunks[j][2][0], chunks[j][2][1] - chunks[j][0]) == (chunks[i][2][0], chunks[i][2][1] - chunks[i][0]):
                    last = j
                j += 1
            a, z = chunks[i][0], chunks[last][1]
            if z - a >= substring_dedup.RUN_BYTES or (a, z) == (0, len(data)):
                spans.append((a, z))
            i = last + 1
        if spans:
            want[k] = spans
    got = {r["doc_id"]: [(s["start"], s["end"]) for s in r["spans"]] for r in Q.op5_substring_dedup(spark, sf_dir).collect()}
    assert got == want


def test_short_copies_count_and_commonplaces_are_not_stitched(spark):
    parts = [prose(300 + i, 9) for i in range(3)]
    rows = [(i, f"{prose(400 + i, 60)} {p} {prose(500 + i, 60)}") for i, p in enumerate(parts)] + [(10, f"{prose(600, 60)} {' '.join(parts)} {prose(601, 60)}"), (20, "a short text"), (21, "a short text")]
    got = {r["doc_id"]: r for r in substring_dedup.repeats(docs_of(spark, rows)).collect()}
    assert got[21]["repeated_bytes"] == 12 and got[21]["first_doc_ids"] == [20]
    assert 10 not in got or all(s["end"] - s["start"] <= max(map(len, parts)) + 1 for s in got[10]["spans"])


def test_words_are_letters_only():
    assert lang_id.words_of("½ ² Ⅷ ① 12 _x_ ab²c ÇA") == ["x", "ab", "c", "ça"]


def test_scripts_rule_languages_out(spark):
    model = lang_id.Model(["aa", "bb"], np.zeros((lang_id.BUCKETS, 2)), np.array([[True, False]] + [[False, True]] + [[False, False]] * (len(lang_id.NAMES) - 2)))
    scores = model.score_words(["long" * 40, "αβγ", "日本"])
    assert np.isinf(scores[0, 1]) and np.isinf(scores[1, 0]) and np.isfinite(scores[2]).all()
    labels = lang_id.Labeller(model).spans("latin words then αβγ δεζ again")
    assert [x[2] for x in labels] == ["aa", "bb", "aa"]


# ---- 7: quality --------------------------------------------------------------

def test_quality_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    got = Q.op7_quality(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert len(got) > 80 and (got["predicted"] == got["quality"]).mean() > 0.95 and got["score"].between(0, 1).all()


def test_quality_odd_input(spark, odd, none, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(docs, labels.union(labels.limit(5)).union(spark.createDataFrame([(None, 1, 0), (1, None, 0)], labels.schema)))
    got = quality.score(odd, model).collect()
    assert len(got) == len(ODD) and len({r["score"] for r in got if r["doc_id"] in (1, 2, 3)}) == 1
    assert quality.fit(docs, labels.limit(0)) is None and {r["score"] for r in quality.score(odd, None).collect()} == {0.5}
    assert quality.score(none, model).count() == 0 and quality.keep(none, model).count() == 0
    assert quality.keep(odd, None).count() == len(ODD) and quality.keep(odd, model).columns == odd.columns


def test_pooling_and_contexts_against_plain_versions():
    texts = ["The cat, the cat sat. Ünder 9 x9!", None, "", "one", "a a a b"]
    index, t = quality.index_vectors(), quality.Tokens()
    want, pooled = np.zeros((quality.ROWS, quality.SIZE)), []
    for text in texts:
        numbers = [quality._number(w) for w in (text or "").split()]
        words = [n // quality.SHAPES for n in numbers]
        shapes = [quality.WORDS + (quality.REPEAT if i and words[i] == words[i - 1] else n % quality.SHAPES) for i, n in enumerate(numbers)]
        for seq in (words, shapes):
            for i in range(len(seq)):
                for j in range(max(0, i - quality.NEAR), min(len(seq), i + quality.NEAR + 1)):
                    if i != j:
                        want[seq[i]] += index[seq[j]]
        pooled.append(np.concatenate([np.mean([index[w] for w in seq], axis=0) if seq else np.zeros(quality.SIZE) for seq in (words, shapes)]))
    assert np.allclose(quality.contexts(t, texts, index), want)
    assert np.allclose(quality.pooled(t, texts, index), pooled, atol=1e-5)


def test_temperature_goes_both_ways_and_lowers_the_loss():
    draw = np.random.default_rng(3)
    x = draw.normal(size=(400, 6))
    y = (x[:, 0] + 0.1 * draw.normal(size=400) > 0).astype(float)
    n = quality.Network(x, y)
    assert n.losses[1] <= n.losses[0]
    back = (x - n.mean) / n.scale
    for factor in (0.05, 20.0):
        n.p[2], n.p[3] = n.p[2] * factor, n.p[3] * factor
        n.calibrate(back, y)
        assert (n.temperature < 1) == (factor < 1) and n.losses[1] < n.losses[0]
        n.p[2], n.p[3] = n.p[2] / factor, n.p[3] / factor


# ---- 8: decontamination ------------------------------------------------------

ITEM = "If Alice buys 3 apples for 4 dollars each and Alice then sells 2 pears, how much money does she have left over in the end?"


def test_reparameterised_questions_are_caught(spark, odd, none):
    bench = spark.createDataFrame([(1, ITEM), (2, "short item here"), (3, None), (4, ""), (None, ITEM), (5, "5 6 7 8 9")], "item_id long, text string")
    other = ITEM.replace("Alice", "Robert").replace("3", "17").replace("4", "99")
    broken = ITEM.replace("then", "then").replace("and Alice", "and Robert")  # one name for two slots
    rows = [(1, f"Well, some text before. {ITEM} And after."), (2, f"Intro words. {other} Outro."), (3, "nothing of the sort is in this text at all"), (4, "a short item here too"), (5, broken.replace("Alice", "Zoe"))]
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contamination(docs_of(spark, rows), bench).collect()}
    assert {(1, 1), (2, 1), (4, 2)} <= got and not {d for d, _ in got} & {3}
    assert {r["doc_id"] for r in decontam.clean(docs_of(spark, rows), bench).collect()} >= {3}
    assert decontam.contamination(odd, bench).count() == 0 and decontam.clean(odd, bench).count() == len(ODD)
    assert decontam.contamination(none, bench).count() == 0 and decontam.contamination(odd, bench.limit(0)).count() == 0


def test_contamination_query_finds_whole_items(spark):
    d = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()}
    want = {(k, i) for k, t in texts.items() for i, b in items.items() if b in t}
    got = {(r["doc_id"], r["item_id"]) for r in Q.op8_decontamination(spark, d).collect()}
    assert want and want <= got and len(got - want) <= len(want)


def test_contamination_against_plain_version(spark, sf_dir):
    """All windows of all items against all windows of all documents, in plain Python."""
    d = sf_dir
    t = decontam.Templates()
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    want = set()
    windows = lambda text: list(zip(*(x.tolist() if hasattr(x, "tolist") else x for x in t.windows([text], decontam.WINDOW)[1:]), strict=True))
    items = [(r["item_id"], windows(r["text"])) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    index = {}
    for i, ws in items:
        for place, h, slots in ws:
            index.setdefault(h, []).append((i, place, slots))
    for k, text in texts:
        lines = {}
        for at, h, values in windows(text):
            for i, place, slots in index.get(h, ()):
                places, pairs = lines.setdefault((i, at - place), (set(), set()))
                places.add(place)
                pairs.update(zip(slots, values, strict=True))
        sums = {}
        for (i, _), (places, pairs) in lines.items():
            if len(pairs) == len({b for b, _ in pairs}) == len({v for _, v in pairs}):
                sums.setdefault(i, []).append(places)
        sizes = {i: len({w[0] for w in ws}) for i, ws in items}
        want |= {(k, i) for i, p in sums.items() if len(set().union(*p)) / sizes[i] >= decontam.SHARE or max(map(len, p)) >= decontam.RUN}
    assert {(r["doc_id"], r["item_id"]) for r in Q.op8_decontamination(spark, d).collect()} == want


# ---- 9: fingerprints ---------------------------------------------------------

def test_entropy_levels_against_counts():
    data = np.frombuffer((prose(3, 300) + "aaaaaaaaaaaaaaaaaaaaaaaa" + "é" * 30).encode(), np.uint8)
    w = fingerprints.WINDOW
    got = fingerprints._entropy_levels(data)
    for i in range(0, len(data) - w + 1, 7):
        s = sum(int(fingerprints._G[c]) for c in np.unique(data[i : i + w], return_counts=True)[1])
        most = w * int(np.log2(w)) * fingerprints._SCALE
        assert got[i] == min(max((most - s) * fingerprints.LEVELS // most, 0), fingerprints.LEVELS)


def test_digest_depends_on_its_text_alone():
    texts = [prose(i, 30 * i).encode() for i in range(8)] + [b"", b"x", b"short one"]
    together = [fingerprints.spell(d) for d in fingerprints.digests(texts)]
    assert together == [fingerprints.spell(fingerprints.digests([t])[0]) for t in texts]
    a, b = fingerprints.digests([prose(1, 400).encode(), (prose(1, 300) + " " + prose(2, 100)).encode()])
    c = fingerprints.digests([prose(9, 400).encode()])[0]
    assert fingerprints.likeness(a, a) == 1 and fingerprints.likeness(a, b) == fingerprints.likeness(b, a) > 0.3 > fingerprints.likeness(a, c)


def test_edit_study_against_plain_version(spark, sf_dir):
    rows = sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    got = {r["doc_id"]: r for r in Q.op9_fingerprints(spark, sf_dir).collect()}
    assert len(got) == len(rows)
    prints = dict(zip([k for k, _ in rows], fingerprints.digests([t.encode() for _, t in rows]), strict=True))
    for i, (k, t) in enumerate(rows):
        nk, nt = rows[(i + 1) % len(rows)]
        half = len(t) // 2
        edited = t[: len(t) - half] + nt[:half]
        e = fingerprints.digests([edited.encode()])[0]
        r = got[k]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r["fingerprint"] == fingerprints.spell(prints[k]) and r["edited_fingerprint"] == fingerprints.spell(e)
        assert r["near_edited"] == fingerprints.likeness(prints[k], e) and r["near_next"] == fingerprints.likeness(prints[k], prints[nk])


def test_edit_study_odd_input(spark, odd, none):
    got = fingerprints.edit_study(odd).collect()
    assert sorted(r["doc_id"] or 0 for r in got) == sorted(k or 0 for k, _ in ODD)
    assert fingerprints.edit_study(none).count() == 0
    one = fingerprints.edit_study(docs_of(spark, [(1, "abcdef")])).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abcabc").hexdigest() and one["near_next"] == 1
    assert fingerprints.fingerprint(odd).count() == len(ODD)


# ---- 10: line dedup ----------------------------------------------------------

def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i:] == b[i + 1 :]


def plain_drops(rows):
    seen, out = [], set()
    for k, t in sorted(rows):
        for i, line in enumerate(t.split("\n")):
            line = line.strip(" ")
            if not line:
                continue
            long = [x for x in seen if len(x) >= line_dedup.LEAST] if len(line) >= line_dedup.LEAST else []
            if line in seen or any(within_one(line, x) for x in long):
                out.add((k, i))
            seen.append(line)
    return out


def test_line_dedup_against_all_pairs(spark):
    rng = random.Random(11)
    base = [f"the quick brown fox jumps over lazy dog number {i}" for i in range(5)] + ["áé日本 text with letters of all kinds", "x" * 40, "ab" * 20, "1234567890123456", "short", "a", "", "123456789012345"]

    def change(x):
        i = rng.randrange(len(x) + 1)
        return rng.choice([x[:i] + rng.choice("abZé") + x[i:], x[:i] + x[i + 1 :], x[:i] + rng.choice("abZé") + x[i + 1 :], x])

    rows = [(d, "\n".join(change(rng.choice(base)) if rng.random() < 0.5 else change(change(rng.choice(base))) for _ in range(rng.randint(1, 5)))) for d in range(50)]
    got = {(r["doc_id"], r["line"]) for r in line_dedup.dropped_lines(docs_of(spark, rows)).collect()}
    assert got == plain_drops(rows)


def test_line_dedup_of_very_long_lines(spark):
    """Edits in a line of 200,000 characters, at its ends, and next to a sector's edge."""
    rng = random.Random(5)
    line = "".join(rng.choice("abcdefgh ") for _ in range(200_000)).strip() + "z"
    n = len(line)
    cut = n // 32 * 3
    rows = [(1, line), (2, line[:cut] + "Q" + line[cut:]), (3, line[:-1]), (4, line[1:]), (5, line[: n // 2] + "Q" + line[n // 2 + 1 :]), (6, line[:5] + "QQ" + line[5:])]
    assert {(r["doc_id"], r["near"]) for r in line_dedup.dropped_lines(docs_of(spark, rows)).collect()} == {(k, True) for k in (2, 3, 4, 5)}


def test_line_dedup_odd_input(spark, odd, none):
    rows = odd.union(docs_of(spark, [(40, "a line that is quite long enough\nshort\n a line that is quite long enough "), (41, "a line that is quite long enouhg\na line that is quite long enoug\n"), (42, "y" * 60_000), (43, "y" * 60_001), (44, "short\n\nshore")]))
    got = {r["doc_id"]: r["text"] for r in line_dedup.remove(rows).collect()}
    assert got[40] == "a line that is quite long enough\nshort" and got[44] == "\nshore" and got[41] == "a line that is quite long enouhg\n" and got[42] == "y" * 60_000 and got[43] == ""
    assert got[1] is None and got[2] == "" and got[None] == "no key at all" and line_dedup.remove(rows).columns == rows.columns
    assert line_dedup.remove(none).count() == 0 and line_dedup.report(none).count() == 0
    r = {x["doc_id"]: x for x in line_dedup.report(rows).collect()}
    assert (r[41]["n_lines"], r[41]["n_dropped"], r[41]["n_near"], r[41]["dropped"], r[41]["kept_doc_ids"]) == (3, 1, 1, [1], [40]) and r[1]["n_lines"] == 0
