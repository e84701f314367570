"""Language identification with script ranges and a Viterbi labelling.

Training gathers character trigram counts per language from a bounded,
hash-ordered sample of labelled rows (``per_lang`` rows a language). A word is
scored under every language by its trigrams' log probabilities; languages that
never use the word's script drop out (a script that no language uses rules out
none). Viterbi over the words with a switching
penalty labels spans, and the language with most labelled letters is the
document's.

Defined results: null text or text without a letter -> ``und``, score 0;
no training rows -> ``und``, score 0; ties go to the alphabetically first
language; very long texts are labelled whole; repeated rows give repeated equal
results; other columns of the input are ignored, so clashing names do no harm.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Rows a language that training may read.
PER_LANG = 3000
BUCKETS = 1 << 16
SWITCH = 6.0
#: First and last code point of the scripts told apart.
SCRIPTS = {
    "latin": ((0x41, 0x24F), (0x1E00, 0x1EFF)),
    "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "cyrillic": ((0x400, 0x52F),),
    "hebrew": ((0x590, 0x5FF),),
    "arabic": ((0x600, 0x6FF), (0x750, 0x77F)),
    "devanagari": ((0x900, 0x97F),),
    "thai": ((0xE00, 0xE7F),),
    "kana": ((0x3040, 0x30FF),),
    "han": ((0x3400, 0x4DBF), (0x4E00, 0x9FFF)),
    "hangul": ((0x1100, 0x11FF), (0xAC00, 0xD7AF)),
}
NAMES = [*SCRIPTS, "other"]
_EDGES = sorted((lo, hi, k) for k, name in enumerate(SCRIPTS) for lo, hi in SCRIPTS[name])
#: Runs of letters, and of numbers that are no decimal digits.
_LETTERS = re.compile(r"[^\W\d_]+")


def script_of(points: np.ndarray) -> np.ndarray:
    """Number of the script of each code point."""
    lows = np.array([x[0] for x in _EDGES])
    highs = np.array([x[1] for x in _EDGES])
    which = np.array([x[2] for x in _EDGES])
    at = np.clip(np.searchsorted(lows, points, "right") - 1, 0, None)
    inside = (points >= lows[at]) & (points <= highs[at])
    return np.where(inside, which[at], len(SCRIPTS))


def _trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed trigrams of padded words, the start of each word's, and each word's script."""
    padded = "".join(f"\x02{w}\x03" for w in words)
    points = np.frombuffer(padded.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.concatenate([[0], np.cumsum(lengths + 2)])[:-1]
    a, b, c = points[:-2], points[1:-1], points[2:]
    mixed = (a * 0x9E3779B1 + b * 0x85EBCA77 + c * 0xC2B2AE3D) & 0xFFFFFFFF
    mixed = ((mixed ^ (mixed >> 15)) * 0x2C1B3C6D) & 0xFFFFFFFF
    grams = ((mixed ^ (mixed >> 13)) & (BUCKETS - 1)).astype(np.int64)
    keep = np.ones(len(points) - 2, bool)  # a word of n letters has n trigrams; those across words go
    ends = starts[1:] - 1
    keep[np.concatenate([ends, ends - 1])] = False
    counts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    return grams[keep], counts, script_of(points[starts + 1])


def words_of(text: str) -> list[str]:
    """Runs of letters, in lower case."""
    out = _LETTERS.findall(text.lower())
    if all(map(str.isalpha, out)):
        return out
    return [x for w in out for x in ([w] if w.isalpha() else "".join(c if c.isalpha() else " " for c in w).split())]


def _count(texts_langs):
    """Trigram and script counts by language over one slice."""
    out = {}
    for text, lang in texts_langs:
        out.setdefault(lang, []).extend(words_of(text or ""))
    rows = {"lang": [], "feature": [], "n": []}
    for lang, words in out.items():
        if not words:
            continue
        grams, _, scripts = _trigrams(words)
        counts = np.bincount(grams, minlength=BUCKETS)
        used = np.bincount(scripts, minlength=len(NAMES))
        for shift, c in ((0, counts), (BUCKETS, used)):
            at = np.flatnonzero(c)
            rows["feature"] += (at + shift).tolist()
            rows["n"] += c[at].tolist()
            rows["lang"] += [lang] * len(at)
    return rows


class Model:
    """Log probabilities by (trigram, language) and scripts by language."""

    def __init__(self, langs: list[str], logp: np.ndarray, scripts: np.ndarray, switch: float = SWITCH):
        self.langs, self.logp, self.scripts, self.switch = langs, logp.astype(np.float32), scripts, switch

    def score_words(self, words: list[str]) -> np.ndarray:
        """Words by languages: summed log probabilities; languages without the word's script are out, unless all are."""
        grams, starts, script = _trigrams(words)
        out = np.add.reduceat(self.logp[grams], starts, axis=0)
        allowed = self.scripts[script]
        allowed |= ~allowed.any(axis=1, keepdims=True)
        return np.where(allowed, out, -np.inf).astype(np.float32)


def train(docs: DataFrame, per_lang: int = PER_LANG, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Fit a Model. Rows without a language or text teach nothing."""
    known = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang")).where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros((len(NAMES), 0), bool))
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, per_lang / n))])
    draw = F.pmod(F.xxhash64(F.lit(17), "id"), F.lit(1 << 30)) / float(1 << 30)
    sample = known.where(draw < share[F.col("lang")])
    counts = common.map_texts(sample, lambda: lambda ids, texts, langs: _count(zip(texts, langs, strict=True)), "lang string, feature int, n long", "id", "text", ("lang",))
    # at most (BUCKETS + scripts) x languages rows, however large the corpus
    got = counts.groupBy("lang", "feature").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(sizes)
    table = np.zeros((BUCKETS + len(NAMES), len(langs)))
    table[got["feature"].to_numpy(int), [langs.index(x) for x in got["lang"]]] = got["n"]
    grams, scripts = table[:BUCKETS], table[BUCKETS:]
    logp = np.log(grams + 0.2) - np.log(grams.sum(axis=0) + 0.2 * BUCKETS)
    return Model(langs, logp, scripts > 0.01 * np.maximum(1, scripts.sum(axis=0)))


def viterbi(scores: list[np.ndarray], switch: float) -> list[np.ndarray]:
    """Best label of each word of each document; all documents advance together."""
    order = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
    out: list = [np.zeros(0, np.int16)] * len(scores)
    for lo in range(0, len(order), 256):
        some = [i for i in order[lo : lo + 256] if len(scores[i])]
        if not some:
            break
        lengths = np.array([len(scores[i]) for i in some])
        longest, k = lengths[0], scores[some[0]].shape[1]
        live = np.searchsorted(-lengths, -np.arange(1, longest + 1), "right")  # documents that reach step t
        first = np.cumsum(live) - live
        flat = np.empty((int(lengths.sum()), k), np.float32)
        for row, i in enumerate(some):
            flat[first[: lengths[row]] + row] = scores[i]
        back = np.empty(flat.shape, np.int16)
        best = flat[: live[0]].copy()
        last = [None] * len(some)
        stay = np.arange(k, dtype=np.int16)
        ended = live[0]
        for t in range(1, longest + 1):
            n = live[t] if t < longest else 0
            if n < ended:
                finals = best[n:ended].argmax(axis=1)
                for row in range(n, ended):
                    last[row] = finals[row - n]
                ended = n
                best = best[:n]
            if not n:
                break
            top = best.argmax(axis=1)
            jump = best[np.arange(n), top] - switch
            moves = jump[:, None] > best
            s = slice(first[t], first[t] + n)
            back[s] = np.where(moves, top[:, None].astype(np.int16), stay)
            best = np.where(moves, jump[:, None], best) + flat[s]
        labels = np.empty(len(flat), np.int16)
        state = np.array(last, np.int64)
        for t in range(longest - 1, -1, -1):
            n = live[t]
            s = first[t]
            labels[s : s + n] = state[:n]
            if t:
                state[:n] = back[s + np.arange(n), state[:n]]
        for row, i in enumerate(some):
            out[i] = labels[first[: lengths[row]] + row]
    return out


class Labeller:
    """Labels slices of texts; keeps scores of words it has seen."""

    def __init__(self, model: Model):
        self.model, self.ids, self.rows = model, {}, np.zeros((0, len(model.langs)), np.float32)
        self.letters = np.zeros(0, np.int32)

    def _numbers(self, words: list[list[str]]) -> list[np.ndarray]:
        if len(self.ids) > common.CACHE_WORDS:
            self.__init__(self.model)
        new = []
        known = self.ids
        for ws in words:
            for w in set(ws):
                if w not in known:
                    known[w] = len(known)
                    new.append(w)
        if new:
            grown = [self.rows]
            for lo in range(0, len(new), 50_000):
                grown.append(self.model.score_words(new[lo : lo + 50_000]))
            self.rows = np.concatenate(grown)
            self.letters = np.concatenate([self.letters, np.fromiter(map(len, new), np.int32, len(new))])
        return [np.fromiter(map(known.__getitem__, ws), np.int64, len(ws)) for ws in words]

    def label(self, texts: list[str | None]) -> list[tuple[list[str], np.ndarray, np.ndarray]]:
        """(words, labels, letters) of each text."""
        words = [words_of(x) if x else [] for x in texts]
        if not self.model.langs:
            return [([], np.zeros(0, np.int16), np.zeros(0, np.int32)) for _ in texts]
        ids = self._numbers(words)
        labels = viterbi([self.rows[i] for i in ids], self.model.switch)
        return [(w, x, self.letters[i]) for w, x, i in zip(words, labels, ids, strict=True)]

    def spans(self, text: str | None) -> list[tuple[int, int, str]]:
        """(first word, end, language) runs of one text."""
        words, labels, _ = self.label([text])[0]
        cuts = [0, *(np.flatnonzero(np.diff(labels)) + 1), len(words)] if len(words) else [0]
        return [(int(a), int(b), self.model.langs[labels[a]]) for a, b in zip(cuts, cuts[1:], strict=False)]


def identify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, n_spans: one row for each input row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages floats

    def make():
        labeller = common.worker_state(("lang", id(shared.value)), lambda: Labeller(shared.value))
        langs = shared.value.langs

        def f(ids, texts):
            pred, score, spans = [], [], []
            for words, labels, letters in labeller.label(texts):
                if not len(words):
                    pred.append("und")
                    score.append(0.0)
                    spans.append(0)
                    continue
                mass = np.bincount(labels, weights=letters, minlength=len(langs))
                pred.append(langs[int(mass.argmax())])
                score.append(float(mass.max() / mass.sum()))
                spans.append(1 + int(np.count_nonzero(np.diff(labels))))
            return {"doc_id": ids, "lang_pred": pred, "score": score, "n_spans": spans}

        return f

    return common.map_texts(docs, make, "doc_id long, lang_pred string, score double, n_spans long", key, text)
