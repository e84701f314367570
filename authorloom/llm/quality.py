"""Quality classifier: random-indexing word vectors, pooled, and a two-layer network.

Fitting reads a bounded, hash-drawn sample of labelled rows (``SAMPLE_ROWS``):
each word has a fixed sparse ternary index vector, and its word vector is the
sum of the index vectors of words near it plus its own. A document is the mean
of its words' vectors and of its tokens' shape vectors (case, punctuation
around, digits, repeats of the word before). A hidden layer of tanh units and a
logistic output are trained with Adam; a temperature fitted on a held-back part
of the sample calibrates the probabilities.

Words share hashed rows, so the model's size is fixed. Scoring reads every
whole text once, without a shuffle.

Defined results: null and empty texts pool to zero vectors and get that
vector's score; very long texts are read whole; labels without a document, or null, teach nothing; rows that
label a document twice teach their mean, rounded up; no usable label gives
score 0.5 throughout; repeated rows get equal scores; other columns of either
table are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SAMPLE_ROWS = 6000
#: Tasks that gather word contexts; each gives one matrix of ROWS x SIZE.
FIT_TASKS = 12
WORDS, SHAPES, SIZE = 1 << 14, 512, 48
ROWS = WORDS + SHAPES
NEAR = 2
REPEAT = 0  # the shape of a token that repeats the word before
HIDDEN, EPOCHS, RATE, DECAY = 32, 60, 0.01, 1e-4
_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


def _shape(lead: str, core: str, tail: str) -> int:
    case = "n" if not core else "A" if core.isupper() and len(core) > 1 else "a" if core.islower() else "T" if core[0].isupper() and core[1:].islower() else "m"
    shape = f"{lead[-2:]}{case}{'9' if any(x.isdigit() for x in core) else ''}{'-' if core and not core.isalnum() else ''}{tail[:2]}"
    return 1 + zlib.crc32(shape.encode("utf-8", "surrogatepass")) % (SHAPES - 1)


#: Shapes of most tokens: lower case or capitalised letters, alone or before a stop or comma.
_USUAL = {(first, tail): _shape("", "Ab" if first else "ab", tail) for first in (False, True) for tail in ("", ".", ",")}


def _number(token: str) -> int:
    """Word row and shape row of a token, as one number."""
    core, tail = (token[:-1], token[-1]) if token[-1] in ".," else (token, "")
    if core.isalpha() and len(core) > 1 and core[1:].islower() and (core[0].isupper() or core[0].islower()):
        shape = _USUAL[core[0].isupper(), tail]
    else:
        core = token.strip(_EDGE)
        at = token.find(core) if core else len(token)
        shape = _shape(token[:at], core, token[at + len(core) :])
    return zlib.crc32(core.lower().encode("utf-8", "surrogatepass")) % WORDS * SHAPES + shape


def index_vectors() -> np.ndarray:
    """Sparse ternary vectors, the same everywhere."""
    draw = np.random.default_rng(20240229)
    out = np.zeros((ROWS, SIZE), np.float32)
    rows = np.arange(ROWS)
    for sign in (1, -1, 1, -1):
        out[rows, draw.integers(0, SIZE, ROWS)] += sign
    return out


class Tokens:
    """Texts to rows of words and shapes, with a cache of tokens."""

    def __init__(self):
        self.ids = common.WordIds(_number)

    def rows(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word rows, shape rows, and the number of tokens of each text."""
        if len(self.ids) > common.CACHE_WORDS:
            self.ids = common.WordIds(_number)
        split = [x.split() if x else [] for x in texts]
        counts = np.fromiter(map(len, split), np.int64, len(split))
        get = self.ids.__getitem__
        codes = np.concatenate([np.fromiter(map(get, w), np.int64, len(w)) for w in split]) if len(split) else np.zeros(0, np.int64)
        words, shapes = codes // SHAPES, codes % SHAPES
        if len(words) > 1:
            same = words[1:] == words[:-1]
            ends = np.cumsum(counts)[:-1]
            same[ends[(ends > 0) & (ends < len(words))] - 1] = False
            shapes[1:][same] = REPEAT
        return words, shapes + WORDS, counts


def contexts(tokens: Tokens, texts: list[str | None], index: np.ndarray) -> np.ndarray:
    """Sum over the texts of the index vectors near each row."""
    out = np.zeros((ROWS, SIZE), np.float32)
    words, shapes, counts = tokens.rows(texts)
    doc = np.repeat(np.arange(len(counts)), counts)
    for seq in (words, shapes):
        for k in range(1, NEAR + 1):
            near = doc[k:] == doc[:-k]
            a, b = seq[:-k][near], seq[k:][near]
            for x, y in ((a, b), (b, a)):
                order = np.argsort(x, kind="stable")
                x, y = x[order], y[order]
                if len(x):
                    first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
                    out[x[first]] += np.add.reduceat(index[y], first, axis=0)
    return out


def pooled(tokens: Tokens, texts: list[str | None], vectors: np.ndarray) -> np.ndarray:
    """Mean word vector and mean shape vector of each text."""
    words, shapes, counts = tokens.rows(texts)
    out = np.zeros((len(texts), 2 * SIZE), np.float32)
    some = np.flatnonzero(counts)
    if len(some):
        starts = (np.cumsum(counts) - counts)[some]
        size = counts[some, None]
        out[some, :SIZE] = np.add.reduceat(vectors[words], starts, axis=0) / size
        doc = np.repeat(np.arange(len(some)), counts[some])
        shares = np.bincount(doc * SHAPES + shapes - WORDS, minlength=len(some) * SHAPES).reshape(-1, SHAPES)
        out[some, SIZE:] = shares @ vectors[WORDS:] / size
    return out


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """tanh hidden layer, logistic output, temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-4
        x = (x - self.mean) / self.scale
        draw = np.random.default_rng(7)
        back = draw.random(len(x)) < 0.2
        if back.all() or not back.any():
            back[:] = False
        fit_x, fit_y = x[~back], y[~back]
        n = x.shape[1]
        p = [draw.normal(0, n**-0.5, (n, HIDDEN)), np.zeros(HIDDEN), draw.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        m, v, t = [np.zeros_like(w) for w in p], [np.zeros_like(w) for w in p], 0
        for _ in range(EPOCHS):
            order = draw.permutation(len(fit_x))
            for lo in range(0, len(order), 128):
                a, b = fit_x[order[lo : lo + 128]], fit_y[order[lo : lo + 128]]
                h = np.tanh(a @ p[0] + p[1])
                e = (_sigmoid(h @ p[2] + p[3]) - b) / len(b)
                d = np.outer(e, p[2]) * (1 - h * h)
                grads = [a.T @ d + DECAY * p[0], d.sum(axis=0), h.T @ e + DECAY * p[2], e.sum(keepdims=True)]
                t += 1
                for i, g in enumerate(grads):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    p[i] = p[i] - RATE * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        self.p = [w.astype(np.float32) for w in p]
        self.temperature, self.losses = 1.0, None
        if back.any():
            self.calibrate(x[back], y[back])

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """Choose the temperature, below or above 1, of least log loss; ``losses`` are those before and after."""
        z = self._logit(x)

        def loss(t: float) -> float:
            q = np.clip(_sigmoid(z / t), 1e-7, 1 - 1e-7)
            return float(-np.mean(y * np.log(q) + (1 - y) * np.log(1 - q)))

        grid = np.exp(np.linspace(-3, 3, 121))
        self.temperature = float(min(grid, key=loss))
        self.losses = loss(1.0), loss(self.temperature)

    def _logit(self, x):
        return np.tanh(x @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self._logit((x - self.mean) / self.scale) / self.temperature).astype(np.float64)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample_rows: int = SAMPLE_ROWS):
    """(word vectors, Network) from the labelled rows given; None without any."""
    spark = docs.sparkSession
    common.ship(spark)
    known = labels.select(F.col(key).cast("long").alias("k"), F.col(label).cast("double").alias("y")).where("k IS NOT NULL AND y IS NOT NULL").groupBy("k").agg((F.avg("y") >= 0.5).cast("double").alias("y"))
    n = known.count()
    if not n:
        return None
    draw = F.pmod(F.xxhash64(F.lit(29), "k"), F.lit(1 << 30)) / float(1 << 30)
    drawn = F.broadcast(known.where(draw < sample_rows / n))  # about SAMPLE_ROWS rows of two numbers
    sample = common.cut(docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).join(drawn, "k").repartition(FIT_TASKS), "quality")
    index = index_vectors()

    def gather(batches):
        tokens, total = Tokens(), np.zeros((ROWS, SIZE), np.float32)
        for batch in batches:
            texts = batch["t"].tolist()
            for _, some in common.slices(texts, texts):
                total += contexts(tokens, some, index)
        yield pd.DataFrame({"m": [total.tobytes()]})

    total = np.zeros((ROWS, SIZE), np.float32)
    for r in sample.coalesce(FIT_TASKS).mapInPandas(gather, "m binary").toLocalIterator():  # FIT_TASKS matrices
        total += np.frombuffer(r["m"], np.float32).reshape(ROWS, SIZE)
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-6)
    vectors = (unit(total) + 0.5 * unit(index)).astype(np.float32)

    def pool(batches):
        tokens = Tokens()
        for batch in batches:
            texts = batch["t"].tolist()
            at = 0
            for _, some in common.slices(texts, texts):
                yield pd.DataFrame({"y": batch["y"].tolist()[at : at + len(some)], "x": list(pooled(tokens, some, vectors).astype(np.float64))})
                at += len(some)

    got = sample.mapInPandas(pool, "y double, x array<double>").toPandas()  # SAMPLE_ROWS short vectors
    common.discard(sample)
    if not len(got):
        return None
    order = np.lexsort(np.array([list(x[:8]) for x in got["x"]]).T)  # rows come in any order
    x, y = np.array(got["x"].tolist())[order], got["y"].to_numpy()[order]
    return vectors, Network(x, y)


def score(docs: DataFrame, model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score, predicted: one row for each input row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # ROWS x SIZE floats and a small network

    def make():
        tokens, model = common.worker_state("quality", Tokens), shared.value

        def f(ids, texts):
            s = np.full(len(ids), 0.5) if model is None else model[1].score(pooled(tokens, texts, model[0]))
            return {"doc_id": ids, "score": s, "predicted": (s >= 0.5).astype(np.int32)}

        return f

    return common.map_texts(docs, make, "doc_id long, score double, predicted int", key, text)


def keep(docs: DataFrame, model, text: str = "text") -> DataFrame:
    """The rows whose text scores 0.5 or more, all columns as they were; no shuffle."""
    common.ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches):
        tokens, model = common.worker_state("quality", Tokens), shared.value
        for batch in batches:
            texts = batch.column(at).to_pylist()
            good = np.ones(len(texts), bool)
            lo = 0
            for _, some in common.slices(texts, texts):
                if model is not None:
                    good[lo : lo + len(some)] = model[1].score(pooled(tokens, some, model[0])) >= 0.5
                lo += len(some)
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
