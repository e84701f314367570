"""The pipeline's near-duplicate stage against all pairs."""

import random

import corpus_pipeline
import numpy as np

from authorloom.llm import jaccard, simhash

from .test_operators import ODD, docs_of, prose


def plain_set(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {" ".join(words)} if words else set()


def plain_groups(rows):
    root, sets = {k: k for k, _ in rows}, {k: plain_set(t) for k, t in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sorted(root):
        for b in sorted(root):
            x, y = sets[a], sets[b]
            if a < b and (x == y or 5 * len(x & y) >= 4 * len(x | y)):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {k: find(k) for k in root}


def edited(words, rng, n):
    words = list(words)
    for _ in range(n):
        i = rng.randrange(len(words))
        words[i : i + rng.randrange(2)] = [f"w{rng.randrange(9999)}"]
    return " ".join(words)


def test_groups_against_all_pairs(spark):
    rng = random.Random(3)
    rows = []
    for b in range(6):
        base = prose(b, 30 + 40 * b).split()
        rows += [(len(rows) + i, edited(base, rng, rng.randrange(0, 2 + 2 * b))) for i in range(25)]
    rows += [(900, "a b"), (901, "A  b"), (902, None), (903, " "), (904, "a b c")]
    want = plain_groups(rows)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(docs_of(spark, rows)).collect()}
    assert got == want and 20 < len(set(want.values())) < len(rows) - 20
    assert {r["doc_id"] for r in jaccard.keep_one(docs_of(spark, [*rows, (None, "a b")])).collect()} == set(want.values()) | {None}
    assert jaccard.near_duplicates(docs_of(spark, [])).count() == 0 and jaccard.near_duplicates(docs_of(spark, ODD)).count() == len(ODD)


def test_digests_prune_no_pair_within_the_bound():
    draw = np.random.default_rng(11)
    pruned = 0
    for _ in range(600):
        n, extra = int(draw.integers(1, 700)), [int(x) for x in draw.integers(0, 160, 2)]
        base = draw.integers(0, 2**63, n, dtype=np.uint64)
        a, b = (np.unique(np.concatenate([base, draw.integers(0, 2**63, e, dtype=np.uint64)])) for e in extra)
        differ = len(np.setxor1d(a, b))
        most = (len(a) + len(b)) // 9
        ok = jaccard.within(jaccard.parities(a), jaccard.parities(b), most)
        assert ok or differ > most
        pruned += not ok
    assert pruned > 100


def test_stage_drops_copies_beyond_two_bits(spark, sf_dir):
    text = prose(1, 120)
    other = " ".join([*text.split()[:-3], "quite", "other", "words"])
    a, b = (int(x) for x in simhash.fingerprints_of([text, other]))
    assert (a ^ b).bit_count() > 2 and 5 * len(plain_set(text) & plain_set(other)) >= 4 * len(plain_set(text) | plain_set(other))
    kept = corpus_pipeline.simhash_stage(spark, docs_of(spark, [(1, text), (2, other), (3, prose(2, 120))]), sf_dir)
    assert {r["doc_id"] for r in kept.collect()} == {1, 3}


def test_shared_passage_makes_few_pairs(spark, monkeypatch):
    """Texts that share a long passage, some of them near copies of each other as well, of sizes around the bound."""
    rng = random.Random(7)
    passage, rows = prose(50, 60).split(), []
    for b in range(60):
        own = [f"o{b}x{i}" for i in range(rng.randrange(20, 50))]
        rows.append((len(rows), " ".join(own + passage)))
        for _ in range(b % 3):
            rows.append((len(rows), " ".join([*own, *passage, *(f"e{rng.randrange(999)}" for _ in range(rng.randrange(0, 30)))])))
    tried, linked = [], jaccard._linked

    def counted(pairs, sets):
        tried.append(pairs.count())
        return linked(pairs, sets)

    monkeypatch.setattr(jaccard, "_linked", counted)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(docs_of(spark, rows)).collect()}
    want = plain_groups(rows)
    assert got == want and 60 <= len(set(want.values())) < len(rows)
    assert tried[-1] < 2 * len(rows) < len(rows) * (len(rows) - 1) / 20


def test_sets_are_dealt_out_only_where_they_are_compared(spark, monkeypatch):
    """Of texts that share a common line and are far from alike, no set is dealt out in full; rows that repeat a key are found."""
    line = prose(70, 9)
    rows = [(i, " ".join(f"q{i}x{j}" for j in range(60)) + " " + line) for i in range(40)]
    rows += [(100, rows[0][1] + " other"), (1, rows[3][1] + " more"), (1, rows[1][1])]
    written, cut = {}, jaccard.common.cut

    def counted(df, name, *args):
        out = cut(df, name, *args)
        written.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(jaccard.common, "cut", counted)
    got = jaccard.near_duplicates(docs_of(spark, rows)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] != 1} == {i: {100: 0, 3: 1}.get(i, i) for i in {r[0] for r in rows} - {1}}
    assert max(written["compared"]) <= 4


def test_fingerprints_propose_near_copies(spark, monkeypatch):
    """The first pairs compared in full are those whose SimHash fingerprints link; copies further off are found all the same."""
    rng = random.Random(5)
    rows, near = [], set()
    for b in range(30):
        words = prose(b, 400).split()
        rows += [(10 * b, " ".join(words)), (10 * b + 1, " ".join([*words, f"tail{b}"])), (10 * b + 2, edited(words, rng, 5))]
    fps = {k: int(simhash.fingerprint(jaccard.shingles(t))) for k, t in rows}
    node = {k: jaccard.xxhash.xxh64_intdigest(jaccard.shingles(t).tobytes(), 42) for k, t in rows}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    for a in fps:
        near |= {tuple(sorted((signed(node[a]), signed(node[b])))) for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 2}
    tried, linked = [], jaccard._linked

    def kept(pairs, sets):
        tried.append({tuple(sorted(r)) for r in pairs.collect()})
        return linked(pairs, sets)

    monkeypatch.setattr(jaccard, "_linked", kept)
    stage = corpus_pipeline.simhash_stage(spark, docs_of(spark, rows), "").collect()
    assert {r["doc_id"] for r in stage} == set(plain_groups(rows).values())
    assert 20 < len(tried[0]) and tried[0] <= near  # equal fingerprints are linked to one of them
    assert not tried[0] & tried[1]  # what they linked is not compared again
