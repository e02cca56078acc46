"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, discard, map_batches, materialize, mix, parts, span_hash, word_spans

FEATURES = 96
BINS = 256
RIDGE = 1e-3
SEED = 29
STATS = (
    "log_bytes", "log_words", "log_lines", "mean_word", "upper", "digit", "symbol", "punctuation", "exclaim", "pipe", "beyond_ascii", "space",
    "distinct_words", "top_word", "distinct_lines", "repeated_shingles", "words_a_line", "long_words", "capital_words", "empty",
)


def _mask(chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(chars)] = True
    return out


_UPPER, _DIGIT = _mask(bytes(range(65, 91))), _mask(bytes(range(48, 58)))
_SYMBOL, _PUNCT, _EXCL, _PIPE = _mask(b"#*$%&<>~^_=+{}[]\\/@"), _mask(b".,;:?'\"()-"), _mask(b"!"), _mask(b"|")
_HIGH = np.arange(256) >= 128
_SPACE = _mask(b" \t\n\x0b\x0c\r")


def statistics(column: pa.Array) -> np.ndarray:
    """float64 [rows, len(STATS)] of whole texts; null and empty texts are all zero but for `empty`."""
    out = np.zeros((len(column), len(STATS)))
    for first, buf, offsets in blocks(column):
        rows = len(offsets) - 1
        starts, ends, counts = word_spans(buf, offsets)
        low = span_hash(parts(buf, lower=True), starts, ends)
        p = parts(buf)
        share = []
        for m in (_UPPER, _DIGIT, _SYMBOL, _PUNCT, _EXCL, _PIPE, _HIGH, _SPACE):
            c = np.concatenate(([0], np.cumsum(m[buf])))
            share.append(c[offsets[1:]] - c[offsets[:-1]])
        share = np.stack(share, axis=1)
        breaks = np.flatnonzero(buf == 10)
        length = ends - starts
        long_words = np.concatenate(([0], np.cumsum(length > 20)))
        capital = np.concatenate(([0], np.cumsum(_UPPER[buf[starts]])))
        chars = np.concatenate(([0], np.cumsum(length)))
        for r in range(rows):
            a, b, s, e = int(counts[r]), int(counts[r + 1]), int(offsets[r]), int(offsets[r + 1])
            x = out[first + r]
            n, size = b - a, e - s
            x[19] = n == 0
            x[0] = np.log1p(size)
            if not size:
                continue
            upper, digit, symbol, punct, excl, pipe, high, space = share[r] / size
            x[4:12] = upper, digit, symbol, punct, excl, pipe, high, space
            if not n:
                continue
            cut = breaks[np.searchsorted(breaks, s) : np.searchsorted(breaks, e)]
            l0, l1 = np.concatenate(([s], cut + 1)), np.concatenate((cut, [e]))
            w = low[a:b]
            u, c = np.unique(w, return_counts=True)
            lines = span_hash(p, l0, l1)[l1 > l0]
            x[1], x[2] = np.log1p(n), np.log1p(len(lines))
            x[3] = (chars[b] - chars[a]) / n
            x[12], x[13] = len(u) / n, c.max() / n
            x[14] = len(np.unique(lines)) / max(1, len(lines))
            if n >= 5:
                g = w[:-4].copy()
                for k in range(1, 5):
                    g = mix(g) + w[k : n - 4 + k]
                x[15] = 1 - len(np.unique(g)) / len(g)
            x[16] = np.log1p(n / max(1, len(lines)))
            x[17], x[18] = (long_words[b] - long_words[a]) / n, (capital[b] - capital[a]) / n
    return out


def describe(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, stats array<double>) for every row. Null texts are empty, empty texts have statistics too (all counts 0); rows repeat as in docs."""

    def run(batches):
        for b in batches:
            x = statistics(b.column(1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(STATS)), pa.array(x.reshape(-1)))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], names=["k", "stats"])

    src = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    return map_batches(src, run, f"k {src.schema['k'].dataType.simpleString()}, stats array<double>").withColumnRenamed("k", key)


def held_out(key: Column) -> Column:
    return (F.crc32(key.cast("string").cast("binary")) % 3) == 1


class Model:
    """Standardisation, the features' frequencies and phases, ridge weights, and the calibration's steps."""

    def __init__(self, mean, scale, frequencies, phases, weights, x, y):
        self.mean, self.scale, self.frequencies, self.phases, self.weights, self.x, self.y = mean, scale, frequencies, phases, weights, x, y

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -8, 8)
        return np.concatenate([np.sqrt(2 / FEATURES) * np.cos(z @ self.frequencies + self.phases), np.ones((len(z), 1))], axis=1)

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), self.x, self.y), 0, 1)


def _stats_of(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), len(STATS))


def _summed(df: DataFrame, partial, width: int) -> np.ndarray:
    """The sum over all batches of partial(batch), a [rows, width] array, added up row by row in the cluster.

    Each task sends `rows` short vectors, and those meet in a partial aggregate: the driver gets `rows` of them.
    """

    def run(batches):
        total = None
        for b in batches:
            x = partial(b)
            total = x if total is None else total + x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(total.shape[0]), width)), pa.array(np.tile(np.arange(width), total.shape[0])), pa.array(total.reshape(-1))], names=["i", "j", "x"])

    rows = map_batches(df, run, "i long, j long, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).collect()
    out = np.zeros((max((r[0] for r in rows), default=-1) + 1, width))
    for i, j, x in rows:
        out[i, j] = x
    return out


def isotonic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Least-squares nondecreasing fit of y with weights n, by pooling adjacent violators; x is sorted."""
    blocks_: list[list[float]] = []
    for value, weight in zip(y, n):
        blocks_.append([float(value), float(weight), 1])
        while len(blocks_) > 1 and blocks_[-2][0] >= blocks_[-1][0]:
            v, w, k = blocks_.pop()
            p = blocks_[-1]
            p[0], p[1], p[2] = (p[0] * p[1] + v * w) / (p[1] + w), p[1] + w, p[2] + k
    return np.repeat([b[0] for b in blocks_], [int(b[2]) for b in blocks_])


def fit(stats: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality") -> Model:
    """Fit on all labelled rows that are not held out. stats: describe()'s table; labels: (key, label 0 or 1).

    Labels that repeat a key count once, as their mean; null labels and keys are left out. Everything that
    reaches the driver is sums of fixed size. Without labelled rows every score is 0.5.
    """
    y = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key))).groupBy(F.col(key).alias("__k")).agg(F.avg(label).cast("double").alias("y"))
    rows = materialize(stats.join(y, F.col(key) == F.col("__k")).select("y", "stats"), "labelled")
    d = len(STATS)

    def moments(b):
        x = _stats_of(b.column(1))
        return np.stack([np.full(d, len(x), float), x.sum(axis=0), (x * x).sum(axis=0), np.full(d, np.asarray(b.column(0)).sum())])

    m = _summed(rows, moments, d)
    rng = np.random.default_rng(SEED)
    frequencies, phases = rng.normal(size=(d, FEATURES)) / np.sqrt(2.0 * d), rng.uniform(0, 2 * np.pi, FEATURES)
    if not len(m) or not m[0, 0]:
        return Model(np.zeros(d), np.ones(d), frequencies, phases, np.zeros(FEATURES + 1), np.array([0.0]), np.array([0.5]))
    n = m[0, 0]
    mean = m[1] / n
    scale = np.sqrt(np.maximum(m[2] / n - mean**2, 0))
    scale[scale < 1e-9] = 1.0
    # the width of the Gaussian kernel: standardised statistics of two rows lie about sqrt(2 d) apart
    model = Model(mean, scale, frequencies * np.sqrt(2.0), phases, np.zeros(FEATURES + 1), np.array([0.0]), np.array([0.5]))
    share = m[3, 0] / n
    weight = (0.5 / max(share, 1e-9), 0.5 / max(1 - share, 1e-9))

    def normal(b):
        f, t = model.features(_stats_of(b.column(1))), np.asarray(b.column(0))
        w = t * weight[0] + (1 - t) * weight[1]
        return np.concatenate([(f * w[:, None]).T @ f, ((f * (w * t)[:, None]).sum(axis=0))[None]])

    s = _summed(rows, normal, FEATURES + 1)
    model.weights = np.linalg.solve(s[:-1] + RIDGE * n * np.eye(FEATURES + 1), s[-1])

    def bins(b):
        t = np.asarray(b.column(0))
        k = np.clip(((model.raw(_stats_of(b.column(1))) + 0.5) / 2 * BINS).astype(int), 0, BINS - 1)
        return np.stack([np.bincount(k, minlength=BINS), np.bincount(k, t, BINS)]).astype(float)

    c = _summed(rows, bins, BINS)
    discard(rows)
    have = c[0] > 0
    x = ((np.arange(BINS) + 0.5) / BINS * 2 - 0.5)[have]
    # one pseudo-row of each class keeps scores off 0 and 1 in thin bins
    model.x, model.y = x, isotonic(x, (c[1] + 2 * share * 0.5)[have] / (c[0] + 1)[have], c[0][have])
    model.y = model.y + np.linspace(0, 1e-6, len(model.y))
    return model


def predict(stats: DataFrame, model: Model, key: str = "doc_id") -> DataFrame:
    """(key, held_out, score, predicted) for every row of describe()'s table. Equal statistics get equal scores; a null key is not held out; an empty table gives an empty one."""

    def run(batches):
        for b in batches:
            score = model.score(_stats_of(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["k", "score", "predicted"])

    src = stats.select(F.col(key).alias("k"), "stats")
    out = map_batches(src, run, f"k {src.schema['k'].dataType.simpleString()}, score double, predicted int")
    return out.select(F.col("k").alias(key), F.coalesce(held_out(F.col("k")), F.lit(False)).alias("held_out"), "score", "predicted")


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """Statistics once, into a table; fit on its labelled rows; score all rows.

    Null and empty texts have the statistic `empty` alone and a score like others. Rows repeat as in docs, ties and all;
    rows with a null key are scored and never trained on. An empty table, or one without labels, is no error (see fit()).
    Only the key and the text are read, so other columns may have any names.
    """
    stats = materialize(describe(docs, key, text), "statistics")
    return predict(stats, fit(stats, labels, key, label), key)
