"""Toxicity: averaged subword-bag embeddings into a linear softmax.

A word is the bag of its marked character n-grams (3 to 5) and itself, hashed to
BUCKETS vectors; a passage of WINDOW words is the average of its words'
vectors, and a linear softmax scores it. Vectors and softmax are trained jointly
in numpy; only n-grams tied to the labels get a vector. As a few words make a
long text toxic, training lets a toxic text settle on its worst passage. The
text's score weighs three averaged bags by the same softmax: its worst passage,
its worst words and all its words, so neither length nor one stray word decides.
An unseen spelling shares most of its n-grams with a seen one.

Training sees a bounded sample; scoring is a map over all whole texts. As the
softmax of an average is linear, a word counts by one number, which a task
keeps for the words it has met (at most CACHE of them).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, labelled_sample

WINDOW, BUCKETS, DIM, GRAMS = 6, 1 << 17, 8, (3, 4, 5)
SAMPLE_PER_CLASS = 1000             # labelled texts of each class to learn from
SAMPLE_BYTES = 8 << 10              # longer texts are not learned from (all are scored)
EPOCHS, RATE, DECAY, SCALE = 60, 0.5, 0.08, 10.0
FLOOR = 1e-3                        # gradients below it move a vector in proportion only
MIN_Z, MAX_PHI = 3.0, 0.5           # n-grams less tied to the labels than this have no vector (see _telling)
THRESHOLD = 0.3
WORST, RIDGE = 4, 1e-3              # words of the bag of worst words; shrinkage of the bags' weights
CACHE = 400_000

_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def grams_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word index, bucket) of every n-gram of every word, by word. N-grams are of
    UTF-8 bytes of the word between < and >; the whole marked word is one more."""
    data = [b"<" + w.encode("utf-8", "replace") + b">" for w in words]
    lens = np.fromiter(map(len, data), np.int64, len(data))
    flat = np.frombuffer(b"".join(data), np.uint8).astype(np.uint64) + np.uint64(1)
    owner = np.repeat(np.arange(len(data)), lens)
    prime = np.uint64(1099511628211)
    who, what = [], []
    h = np.zeros(len(flat), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        if len(flat) < n:
            break
        h = h[:len(flat) - n + 1] * prime + flat[n - 1:]
        if n in GRAMS:
            ok = owner[n - 1:] == owner[:len(owner) - n + 1]
            who.append(owner[:len(ok)][ok])
            what.append(h[ok] * np.uint64(31) + np.uint64(n))
    powers = np.cumprod(np.r_[np.uint64(1), np.full(int(lens.max(initial=1)) - 1, prime)])
    starts = np.r_[0, np.cumsum(lens)[:-1]]
    place = np.arange(len(flat)) - np.repeat(starts, lens)
    whole = np.add.reduceat(flat * powers[place], starts) if len(flat) else np.zeros(0, np.uint64)
    who.append(np.arange(len(data)))
    what.append(whole * np.uint64(31))
    who, what = np.concatenate(who), np.concatenate(what)
    what = (what ^ (what >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    bucket = ((what >> np.uint64(32)) % np.uint64(BUCKETS)).astype(np.int64)
    by = np.argsort(who, kind="stable")
    return who[by], bucket[by]


def _means(rows: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Mean of rows by owner (sorted, each of 0..n-1 has at least one)."""
    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    return np.add.reduceat(rows, first, axis=0) / np.diff(np.r_[first, len(owner)])[:, None]


def _sum_by(keys_order: np.ndarray, first: np.ndarray, keys: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((n, rows.shape[1]), rows.dtype)
    if len(keys):
        out[keys] = np.add.reduceat(rows[keys_order], first, axis=0)
    return out


def _grouping(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
    return order, first, k[first]


def _sigmoid(v: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(v, -30, 30)))


class Model:
    """Bucket vectors and the softmax's two columns, kept as their difference:
    margin(word) = mean(vectors of its n-grams) . direction. The text's logit is
    ``mix`` of its three bags (see ``bags``) plus ``bias``."""

    def __init__(self, margins: np.ndarray, bias: float, mix: tuple[float, ...] = (0.0, 0.0, 0.0)):
        self.margins, self.bias = margins.astype(np.float32), float(bias)
        self.mix = np.array(mix, np.float64)

    def word_margins(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.zeros(0)
        who, bucket = grams_of(words)
        return _means(self.margins[bucket][:, None].astype(np.float64), who, len(words))[:, 0]

    def logit(self, words: np.ndarray, margins: np.ndarray) -> float:
        return float(bags(words, margins) @ self.mix) + self.bias


def bags(words: np.ndarray, margins: np.ndarray) -> np.ndarray:
    """The margins of a text's worst passage of WINDOW words, of its WORST worst
    words, and of all its words, each averaged over the bag's distinct words.

    ``words`` are ids, ``margins`` their margins. Passages overlap by half; bags of
    fewer words are filled with words of margin zero, so a text without words
    has zeros.
    """
    n = len(margins)
    if n == 0:
        return np.zeros(3)
    half = WINDOW // 2
    # a word counts where it has not occurred in the half passage before, and
    # once in the passage: sums over halves of distinct words, less those in both
    count = -(-n // half)
    which = np.arange(n) // half
    key = which * (int(words.max()) + 1) + words
    key, first = np.unique(key, return_index=True)
    h, w, m = which[first], key % (int(words.max()) + 1), margins[first]
    sums = np.bincount(h, weights=m, minlength=count)
    by = np.lexsort((h, w))
    again = (w[by][1:] == w[by][:-1]) & (h[by][1:] == h[by][:-1] + 1)
    both = np.bincount(h[by][1:][again], weights=m[by][1:][again], minlength=count)
    total = sums[:-1] + sums[1:] - both[1:] if count > 1 else sums
    own = m[by][np.r_[True, w[by][1:] != w[by][:-1]]]       # one of each word
    worst = np.sort(own)[-WORST:]
    return np.array([total.max() / WINDOW, worst.sum() / WORST, own.sum() / max(len(own), WINDOW)])


def _constant(y: np.ndarray) -> Model:
    """Every score is the share of label 1; one half without labels."""
    share = y.mean() if len(y) else 0.5
    return Model(np.zeros(BUCKETS), np.log((share + 1e-6) / (1 - share + 1e-6)))


def _telling(word: np.ndarray, text: np.ndarray, bucket: np.ndarray, per_word: np.ndarray,
             y: np.ndarray) -> np.ndarray:
    """Which buckets get a vector: those whose presence in a text and its label
    correlate by chance hardly ever. The correlation phi times sqrt(n) is the z
    of the two shares' difference; at least MIN_Z, or phi of MAX_PHI if the
    texts are few. The rest would only learn single texts by heart."""
    first = np.r_[0, np.cumsum(per_word)]
    held = np.zeros((2, BUCKETS))
    pairs = np.unique(text * len(per_word) + word)
    ends = np.searchsorted(pairs, np.arange(len(y) + 1) * len(per_word))
    for i, label in enumerate(y.astype(int)):
        grams = [bucket[first[w]:first[w + 1]] for w in (pairs[ends[i]:ends[i + 1]] % len(per_word)).tolist()]
        if grams:
            held[label, np.unique(np.concatenate(grams))] += 1
    n1, n = y.sum(), len(y)
    share = held.sum(axis=0) / n
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (n1 / n) * (1 - n1 / n))
    phi = (held[1] - share * n1) / n / spread
    return np.abs(phi) >= min(MAX_PHI, MIN_Z / np.sqrt(n))


def fit(texts: list[str], labels: list[int], seed: int = 11, epochs: int = EPOCHS) -> Model:
    """Joint training by Adam over all passages at once. A toxic text's passages
    share its label by their softmax over the text, so it settles on the worst;
    a clean text's count half that way, half evenly. Without both classes every
    score is the share of label 1 (one half if there are no labels)."""
    y = np.array(labels, np.float64)
    if len(set(labels)) < 2 or not any(words_of(t) for t in texts):
        return _constant(y)
    ids: dict[str, int] = {}
    word, window, text = [], [], []
    for i, t in enumerate(texts):
        ws = [ids.setdefault(w, len(ids)) for w in words_of(t)]
        for a in range(0, max(1, len(ws) - WINDOW // 2), WINDOW // 2):
            part = list(dict.fromkeys(ws[a:a + WINDOW]))
            if part:
                word += part
                window += [len(text)] * len(part)
                text.append(i)
    word, window, text = np.array(word), np.array(window), np.array(text)
    who, bucket = grams_of(list(ids))
    n_grams = np.bincount(who)
    common = _telling(word, text[window], bucket, n_grams, y)
    if not common.any():
        return _constant(y)
    who, bucket = who[common[bucket]], bucket[common[bucket]]
    # a word none of whose n-grams has a vector adds nothing to its passages
    has, who = np.unique(who, return_inverse=True)
    place = np.full(len(ids), -1)
    place[has] = np.arange(len(has))
    used = place[word] >= 0
    word, window, n_grams = place[word[used]], window[used], n_grams[has]
    compact = np.cumsum(common) - 1
    bucket = compact[bucket]
    by_word, by_bucket = _grouping(word), _grouping(bucket)
    first_gram = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
    r = np.random.default_rng(seed)
    kept = int(common.sum())
    w = {"E": r.normal(0, 0.01, (kept, DIM)).astype(np.float32), "D": r.normal(0, SCALE, DIM).astype(np.float32),
         "b": np.zeros(1, np.float32)}
    n_grams = n_grams[:, None].astype(np.float32)
    m = {k: np.zeros_like(v) for k, v in w.items()}
    v = {k: np.zeros_like(u) for k, u in w.items()}
    first_window = np.flatnonzero(np.r_[True, window[1:] != window[:-1]])
    first_text = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
    per_text = np.diff(np.r_[first_text, len(text)])
    target = y[text]
    even = np.repeat(1 / per_text, per_text)
    for step in range(1, epochs + 1):
        vec = np.add.reduceat(w["E"][bucket], first_gram, axis=0) / n_grams
        bag = np.zeros((len(text), DIM), np.float32)
        bag[window[first_window]] = np.add.reduceat(vec[word], first_window, axis=0) / WINDOW
        z = bag @ w["D"] + w["b"]
        p = _sigmoid(z)
        share = np.exp(z - np.repeat(np.maximum.reduceat(z, first_text), per_text))
        share /= np.repeat(np.add.reduceat(share, first_text), per_text)
        weight = np.where(target == 1, share * (0.5 / y.sum()), (share + even) * (0.25 / (1 - y).sum()))
        d = ((p - target) * weight).astype(np.float32)
        dbag = d[:, None] * w["D"] / WINDOW
        dvec = _sum_by(*by_word, dbag[window], len(has)) / n_grams
        g = {"D": bag.T @ d, "b": np.array([d.sum()]),
             "E": _sum_by(*by_bucket, dvec[who], kept)}
        for k in g:
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
            if k == "E":
                w[k] *= 1 - DECAY
            rate = RATE if k == "E" else 0.1 * RATE
            w[k] -= rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.99 ** step)) + FLOOR)
    margins = np.zeros(BUCKETS, np.float32)
    margins[common] = w["E"] @ w["D"]
    return _mixed(margins, texts, y)


def _words_and_margins(model: Model, text: str) -> tuple[np.ndarray, np.ndarray]:
    ids: dict[str, int] = {}
    at = np.array([ids.setdefault(w, len(ids)) for w in words_of(text)], np.int64)
    return at, model.word_margins(list(ids))[at]


def _text_logit(model: Model, text: str) -> float:
    return model.logit(*_words_and_margins(model, text))


def _mixed(margins: np.ndarray, texts: list[str], y: np.ndarray) -> Model:
    """Weigh the three bags of a text by a logistic regression on the labels; each
    bag is scaled to unit spread and shrunk (RIDGE). All texts weigh the same, so
    a score is a probability under the sample's share of label 1."""
    model = Model(margins, 0.0)
    x = np.array([bags(*_words_and_margins(model, t)) for t in texts])
    scale = x.std(axis=0) + 1e-9
    x = np.c_[x / scale, np.ones(len(y))]
    w, ridge = np.zeros(4), RIDGE * np.array([1, 1, 1, 0]) + 1e-9
    for _ in range(50):
        p = _sigmoid(x @ w)
        h = (x * (p * (1 - p) / len(y))[:, None]).T @ x + np.diag(ridge)
        w -= np.clip(np.linalg.solve(h, x.T @ (p - y) / len(y) + ridge * w), -2, 2)
    return Model(margins, w[3], tuple(w[:3] / scale))


def fit_tables(docs: DataFrame, labels: DataFrame, fold: int = 4, held: int = 2, id_col: str = "doc_id",
               text_col: str = "text", per_class: int = SAMPLE_PER_CLASS) -> Model:
    """Learn from the labelled rows outside the held-out fold; at most
    ``per_class`` rows of each class and SAMPLE_BYTES bytes of each reach the driver."""
    rows = labelled_sample(docs, labels, "toxic", fold, held, per_class, SAMPLE_BYTES, id_col, text_col)
    return fit([t for t, _ in rows], [y for _, y in rows])


def scored(docs: DataFrame, model: Model, fold: int = 4, held: int = 2, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """One row per input row: id, held_out, score, predicted (1 from THRESHOLD on).

    Only the text enters the score. Null, empty and wordless texts score by the
    bias alone; a null id is in no fold (held_out false); repeated rows are
    scored each; other columns are not read; no rows give no rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)     # BUCKETS numbers, whatever the input

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = shared.value, {}          # word -> (id, margin)
        for b in batches:
            texts = [words_of(t) for t in b.column(1).to_pylist()]
            out = np.zeros(len(texts))
            for i, ws in enumerate(texts):
                fresh = list(set(ws).difference(known))
                if len(known) + len(fresh) > CACHE:
                    known, fresh = {}, list(set(ws))
                known.update(zip(fresh, zip(range(len(known), len(known) + len(fresh)),
                                            model.word_margins(fresh).tolist())))
                got = np.array([known[w] for w in ws], np.float64).reshape(-1, 2)
                out[i] = model.logit(got[:, 0].astype(np.int64), got[:, 1])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_sigmoid(out), pa.float64())], names=["_id", "score"])

    kind = dict(docs.dtypes)[id_col]
    got = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text")).mapInArrow(
        of, f"_id {kind}, score double")
    return got.select(
        F.col("_id").alias(id_col),
        F.coalesce(F.crc32(F.col("_id").cast("string")) % fold == held, F.lit(False)).alias("held_out"),
        "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
