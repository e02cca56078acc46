"""Language ID of code-switched text: a linear-chain conditional random field over words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import KEEP, blocks, map_batches, mix, parts, span_hash, text_column

UND = "und"
BUCKETS = 1 << 15
NGRAM = 3
AFFIXES = (1, 2, 3, 4)
LEXICON = 400
SEGMENT = 64
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def word_spans(buf: np.ndarray, offsets: np.ndarray):
    """Runs of letters (A-Z, a-z and all bytes from 128 on) of a block; see common.word_spans."""
    n = len(buf)
    letter = _LETTER[buf]
    cut = np.zeros(n + 1, dtype=bool)
    cut[offsets] = True
    before, after = np.ones(n, dtype=bool), np.ones(n, dtype=bool)
    before[1:], after[:-1] = ~letter[:-1], ~letter[1:]
    starts = np.flatnonzero(letter & (before | cut[:n]))
    ends = np.flatnonzero(letter & (after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets, side="left")


def _slot(x: np.ndarray, size, kind: int) -> np.ndarray:
    """The slot of a feature: the first `size` bytes of the parts x, and its kind."""
    return (mix((x & KEEP[size]) ^ (np.uint64(kind) << np.uint64(56))) & np.uint64(BUCKETS - 1)).astype(np.int32)


def features(buf, starts, ends):
    """Affix slots [words, 2 * len(AFFIXES)], n-gram slots with each n-gram's word, and the words' keys."""
    p = parts(buf, lower=True)
    sizes = ends - starts
    affixes = [_slot(p[starts], np.minimum(k, sizes), 2 * k) for k in AFFIXES]
    affixes += [_slot(p[np.maximum(ends - k, starts)], np.minimum(k, sizes), 2 * k + 1) for k in AFFIXES]
    n = np.maximum(sizes - (NGRAM - 1), 0)
    word = np.repeat(np.arange(len(starts)), n)
    at = np.arange(len(word)) - np.repeat(np.cumsum(n) - n, n) + starts[word]
    return np.stack(affixes, axis=1) if len(starts) else np.zeros((0, 2 * len(AFFIXES)), np.int32), _slot(p[at], NGRAM, 255), word, n, span_hash(p, starts, ends)


class Model:
    """languages; weights of slots [BUCKETS, K]; lexicon keys (sorted) with weights [n, K]; log transitions [K, K]."""

    def __init__(self, languages, slots, lexicon, lexicon_weights, transitions):
        self.languages, self.slots, self.lexicon, self.lexicon_weights, self.transitions = languages, slots, lexicon, lexicon_weights, transitions

    def lexicon_row(self, keys):
        at = np.minimum(np.searchsorted(self.lexicon, keys), max(len(self.lexicon) - 1, 0))
        return np.where(self.lexicon[at] == keys, at, -1) if len(self.lexicon) else np.full(len(keys), -1)

    def emissions(self, buf, starts, ends) -> np.ndarray:
        affixes, grams, word, n, keys = features(buf, starts, ends)
        out = np.zeros((len(starts), len(self.languages)), dtype=np.float32)
        for k in range(affixes.shape[1]):
            out += self.slots[affixes[:, k]]
        has = n > 0
        if len(grams):
            out[has] += np.add.reduceat(self.slots[grams], (np.cumsum(n) - n)[has], axis=0)
        row = self.lexicon_row(keys)
        out[row >= 0] += self.lexicon_weights[row[row >= 0]]
        return out

    def posteriors(self, emissions: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """P(language of word | all words of its text), by forward-backward; text i has words [counts[i], counts[i + 1]).

        Texts are cut into segments whose transfer matrices are multiplied side by side, then joined text by
        text: the same result as word by word, in a number of steps that long texts hardly raise.
        """
        k = len(self.languages)
        lens = np.diff(counts)
        segs = -(-lens // SEGMENT)
        total = int(segs.sum())
        out = np.zeros((len(emissions), k), dtype=np.float32)
        if not total:
            return out
        doc = np.repeat(np.arange(len(lens)), segs)
        rank = np.arange(total) - np.repeat(np.cumsum(segs) - segs, segs)
        at = counts[:-1][doc][:, None] + rank[:, None] * SEGMENT + np.arange(SEGMENT)[None, :]
        real = at < counts[1:][doc][:, None]
        at = np.where(real, at, 0)
        w = np.exp(emissions - emissions.max(axis=1, keepdims=True))[at]
        w[~real] = 1
        a = np.exp(self.transitions - self.transitions.max()).astype(np.float32)
        eye = np.eye(k, dtype=np.float32)
        step = real.T
        p = np.broadcast_to(eye, (total, k, k)).copy()
        for t in range(SEGMENT):
            q = (p @ a) * w[:, t, None, :]
            q /= q.sum(axis=(1, 2), keepdims=True)
            p = q if step[t].all() else np.where(step[t][:, None, None], q, p)
        begin, end = np.full((total, k), 1 / k, np.float32), np.full((total, k), 1 / k, np.float32)
        first = np.cumsum(segs) - segs
        longest = int(segs.max())
        for r in range(1, longest):
            i = (first + r)[segs > r]
            v = np.einsum("ni,nij->nj", begin[i - 1], p[i - 1])
            begin[i] = v / v.sum(axis=1, keepdims=True)
        last = first + segs - 1
        for r in range(1, longest):
            i = (last - r)[segs > r]
            v = np.einsum("nij,nj->ni", p[i + 1], end[i + 1])
            end[i] = v / v.sum(axis=1, keepdims=True)
        f, fs = begin, np.empty((SEGMENT, total, k), np.float32)
        for t in range(SEGMENT):
            g = (f @ a) * w[:, t]
            g /= g.sum(axis=1, keepdims=True)
            f = np.where(step[t][:, None], g, f)
            fs[t] = f
        b = end
        for t in range(SEGMENT - 1, -1, -1):
            post = fs[t] * b
            post /= post.sum(axis=1, keepdims=True)
            out[at[step[t], t]] = post[step[t]]
            g = (w[:, t] * b) @ a.T
            g /= g.sum(axis=1, keepdims=True)
            b = np.where(step[t][:, None], g, b)
        return out


def train(texts: list[str], langs: list[str], epochs: int = 4, seed: int = 3, rate: float = 0.2, sequences: int = 6000) -> Model:
    """Maximum likelihood (Adagrad) on sequences of SEGMENT words, spliced of pieces of texts in random languages.

    The splices stand for code-switching, which the labels of whole texts do not show; the transitions are learned
    from them. Deterministic for given texts in a given order.
    """
    languages = sorted(set(langs))
    k = len(languages)
    rng = np.random.default_rng(seed)
    buf = np.frombuffer("".join(texts).encode(), dtype=np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(t.encode()) for t in texts]))).astype(np.int64)
    starts, ends, counts = word_spans(buf, offsets)
    label = np.repeat(np.array([languages.index(x) for x in langs]), np.diff(counts))
    affixes, grams, _, n, keys = features(buf, starts, ends)
    gram_at = np.cumsum(n) - n
    lexicon = np.unique(np.concatenate([np.zeros(0, np.uint64), *[_top(keys[label == j]) for j in range(k)]]))
    model = Model(languages, np.zeros((BUCKETS, k), np.float32), lexicon, np.zeros((max(len(lexicon), 1), k), np.float32), np.zeros((k, k), np.float32))
    by = [np.flatnonzero(np.array([languages.index(x) for x in langs]) == j) for j in range(k)]
    by = [x[np.diff(counts)[x] > 0] for x in by]
    usable = [j for j in range(k) if len(by[j])]
    if not usable:
        return model
    picks = []
    for _ in range(sequences):
        seq: list[np.ndarray] = []
        size = 0
        while size < SEGMENT:
            d = rng.choice(by[usable[rng.integers(len(usable))]])
            a, b = counts[d], counts[d + 1]
            at = rng.integers(a, b)
            piece = np.arange(at, min(b, at + rng.integers(8, 2 * SEGMENT), at + SEGMENT - size))
            seq.append(piece)
            size += len(piece)
        picks.append(np.concatenate(seq))
    picks = np.stack(picks)
    lex = model.lexicon_row(keys)
    acc_s, acc_l, acc_t = np.full((BUCKETS, k), 1e-6, np.float32), np.full(model.lexicon_weights.shape, 1e-6, np.float32), np.full((k, k), 1e-6, np.float32)
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(sequences), max(1, sequences // 100)):
            words = picks[part]
            flat = words.reshape(-1)
            reps = n[flat]
            g_word = np.repeat(np.arange(len(flat)), reps)
            g_at = np.arange(len(g_word)) - np.repeat(np.cumsum(reps) - reps, reps) + gram_at[flat][g_word]
            slots = np.concatenate([affixes[flat].reshape(-1), grams[g_at]])
            owner = np.concatenate([np.repeat(np.arange(len(flat)), affixes.shape[1]), g_word])
            e = np.stack([np.bincount(owner, model.slots[slots, j], len(flat)) for j in range(k)], axis=1)
            known = lex[flat] >= 0
            e[known] += model.lexicon_weights[lex[flat][known]]
            e = e.reshape(len(part), SEGMENT, k)
            gold = np.eye(k)[label[words]]
            post, pairs = _expect(e, model.transitions)
            grad = ((gold - post) / len(part)).reshape(-1, k)
            gs = np.stack([np.bincount(slots, grad[owner, j], BUCKETS) for j in range(k)], axis=1) - 1e-6 * model.slots
            acc_s += gs**2
            model.slots += (rate * gs / np.sqrt(acc_s)).astype(np.float32)
            gl = np.stack([np.bincount(lex[flat][known], grad[known, j], len(acc_l)) for j in range(k)], axis=1)
            acc_l += gl**2
            model.lexicon_weights += (rate * gl / np.sqrt(acc_l)).astype(np.float32)
            gt = (np.einsum("sti,stj->ij", gold[:, :-1], gold[:, 1:]) - pairs) / len(part) - 1e-4 * model.transitions
            acc_t += gt**2
            model.transitions += (rate * gt / np.sqrt(acc_t)).astype(np.float32)
    return model


def _top(keys: np.ndarray) -> np.ndarray:
    """The LEXICON most frequent keys, ties by key."""
    u, c = np.unique(keys, return_counts=True)
    return u[np.lexsort((u, -c))[:LEXICON]]


def _expect(e: np.ndarray, transitions: np.ndarray):
    """Posteriors [S, T, K] and expected transition counts [K, K] of full sequences."""
    s, t_max, k = e.shape
    w = np.exp(e - e.max(axis=2, keepdims=True))
    a = np.exp(transitions.astype(np.float64))
    f, b = np.empty((s, t_max, k)), np.empty((s, t_max, k))
    v = np.full((s, k), 1 / k)
    for t in range(t_max):
        v = (v @ a) * w[:, t]
        v = v / v.sum(axis=1, keepdims=True)
        f[:, t] = v
    v = np.ones((s, k)) / k
    for t in range(t_max - 1, -1, -1):
        b[:, t] = v
        v = (w[:, t] * v) @ a.T
        v = v / v.sum(axis=1, keepdims=True)
    post = f * b
    post /= post.sum(axis=2, keepdims=True)
    pairs = np.zeros((k, k))
    for t in range(t_max - 1):
        x = f[:, t, :, None] * a[None] * (w[:, t + 1] * b[:, t + 1])[:, None, :]
        pairs += (x / x.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    return post, pairs


def held_out(key: Column) -> Column:
    return (F.crc32(key.cast("string").cast("binary")) % 4) == 2


def fit(docs: DataFrame, sample_docs: int = 1000, sample_chars: int = 20_000, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Train on at most sample_docs labelled rows that are not held out, and on the first sample_chars characters of each.

    They are those of least hashed key, over all rows; of rows that repeat a key one counts, the least. The keys are
    picked without reading texts, from the few whose hash is under a bound, among rows whose text is not null. So what
    reaches the driver is bounded by the two parameters, however often a key repeats. Without any such row the model
    has no language.
    """
    usable = docs.where(F.col(lang).isNotNull() & F.col(key).isNotNull() & F.col(text).isNotNull() & ~held_out(F.col(key)))
    hashed = usable.select(F.col(key).alias("__id"), (F.xxhash64(F.col(key)) / F.lit(2.0**64) + 0.5).alias("__h"))
    share, rows = min(1.0, 4 * sample_docs / max(1, usable.count())), 0
    while True:
        ids = hashed.where(F.col("__h") <= share).distinct().orderBy("__h", "__id").limit(sample_docs)
        rows = ids.count()
        if rows >= sample_docs or share >= 1:
            break
        share = min(1.0, share * 8)
    told = usable.join(F.broadcast(ids.select("__id")), F.col(key) == F.col("__id"), "left_semi")
    one = told.groupBy(F.col(key).alias("__k")).agg(F.min(F.struct(F.col(lang).alias("l"), F.substring(text, 1, sample_chars).alias("t"))).alias("x"))
    found = sorted(((r[0], r[1], r[2]) for r in one.select("__k", "x.t", "x.l").collect()), key=lambda r: str(r[0]))
    return train([r[1] for r in found], [r[2] for r in found])


def judge(column: pa.Array, model: Model) -> tuple[list[str], np.ndarray]:
    """Language and score of each text of a column."""
    column = text_column(column)
    pred, score = [UND] * len(column), np.zeros(len(column))
    for first, buf, offsets in blocks(column) if model.languages else ():
        starts, ends, counts = word_spans(buf, offsets)
        post = model.posteriors(model.emissions(buf, starts, ends), counts)
        ascii_letters = np.concatenate(([0], np.cumsum(_LETTER[buf] & (buf < 128))))
        for r in range(len(offsets) - 1):
            if counts[r + 1] == counts[r]:
                continue
            if ascii_letters[offsets[r + 1]] == ascii_letters[offsets[r]] and not any(map(str.isalpha, column[first + r].as_py())):
                continue
            share = post[counts[r] : counts[r + 1]].mean(axis=0, dtype=np.float64)
            j = int(share.argmax())
            pred[first + r], score[first + r] = model.languages[j], min(1.0, float(share[j]))
    return pred, score


def keep_known(docs: DataFrame, model: Model, min_score: float, text: str = "text") -> DataFrame:
    """docs' rows, all columns, without those whose language is und or has a score under min_score. No join, no shuffle.

    So null and empty texts and texts without a letter go. A model without a language cannot judge a text that has
    letters: that is an error, not an empty result. Rows that repeat stay repeated, null keys do not matter, columns may
    have any names but must not repeat one.
    """
    if not model.languages and not docs.where(F.col(text).rlike(r"\p{L}")).isEmpty():
        raise ValueError("no labelled text was there to learn a language from")
    at = docs.columns.index(text)

    def run(batches):
        for b in batches:
            pred, score = judge(b.column(at), model)
            yield b.filter(pa.array([p != UND and s >= min_score for p, s in zip(pred, score)], pa.bool_()))

    return map_batches(docs, run, docs.schema)


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score) for every row: the language with most word posterior over the whole text, and its share.

    `und` with score 0 for null texts and texts without a letter, and if the model has no language. Extra columns
    do not matter; rows repeat as in docs; equal shares go to the first language by name.
    """

    def run(batches):
        for b in batches:
            pred, score = judge(b.column(1), model)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pred, pa.string()), pa.array(score)], names=["k", "lang_pred", "score"])

    src = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    return map_batches(src, run, f"k {src.schema['k'].dataType.simpleString()}, lang_pred string, score double").withColumnRenamed("k", key)
