"""Quality classifier: attention-based multiple-instance learning.

A text is a bag of passages of PASSAGE bytes. Every passage is encoded (byte
class bigrams, variety of its 4-byte strings, length; then a learned tanh layer),
gated attention weights how much each passage counts, and the weighted sum of
the encodings is scored. Encoder, attention and score are learned together from
document labels alone, in numpy, on a bounded sample; scoring is a map over all
whole texts with the small weights shipped to the tasks.

Reference: Ilse, Tomczak, Welling, "Attention-based Deep Multiple Instance
Learning" (2018), the gated form.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, labelled_sample, runs_of, text_buffers

PASSAGE = 512                       # bytes
SAMPLE_PER_CLASS = 2000             # labelled texts of each class to learn from
SAMPLE_BYTES = 16 << 10             # longer texts are not learned from (all are scored)
EPOCHS, RATE, HIDDEN, GATE = 60, 0.01, 32, 16
THRESHOLD = 0.3
_SPAN = 1 << 20                      # bytes encoded at a time
_SLOTS = 1024                       # hashed 4-byte strings told apart in a passage
FEATURES = 16 * 16 + 2


def _byte_classes() -> np.ndarray:
    """Class 0..15 of every byte value."""
    c = np.full(256, 12, np.uint8)                     # other controls and signs
    c[ord("a"):ord("z") + 1] = 1
    c[ord("A"):ord("Z") + 1] = 2
    c[ord("0"):ord("9") + 1] = 3
    c[ord(" ")], c[ord("\n")] = 0, 4
    c[ord(".")], c[ord(",")] = 5, 6
    for i, chars in ((7, b"!?"), (8, b"#*$%&"), (9, b"|<>"), (10, b"=:;/@_-+"), (11, b"\"'()[]{}")):
        c[list(chars)] = i
    c[128:192], c[192:224], c[224:] = 13, 14, 15       # UTF-8 continuation and lead bytes
    return c


_CLASS = _byte_classes()


def passages(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of several texts, and the passages per text (at
    least one: an empty text has one of zeros)."""
    sizes = np.diff(off)
    per = np.maximum(1, -(-sizes // PASSAGE))
    first = np.r_[0, np.cumsum(per)[:-1]]
    total = int(per.sum())
    x = np.zeros((total, FEATURES), np.float32)
    if len(data):
        text = np.repeat(np.arange(len(sizes)), sizes)
        at = np.arange(len(data)) - off[text]
        which = first[text] + at // PASSAGE
        c = _CLASS[data].astype(np.int64)
        inner = which[1:] == which[:-1]                # pairs within one passage
        pairs = (which[1:] * 256 + c[:-1] * 16 + c[1:])[inner]
        x[:, :256] = np.bincount(pairs, minlength=total * 256).reshape(total, 256)
        length = np.bincount(which, minlength=total)
        grams = data.astype(np.uint32)
        h = (grams[:-3] << 24 | grams[1:-2] << 16 | grams[2:-1] << 8 | grams[3:]) * np.uint32(2654435761) >> np.uint32(22)
        whole = which[3:] == which[:-3]
        seen = np.zeros(total * _SLOTS, bool)
        seen[which[3:][whole] * _SLOTS + h[whole]] = True
        distinct = seen.reshape(total, _SLOTS).sum(axis=1)
        x[:, :256] = np.sqrt(x[:, :256] / np.maximum(1, length - 1)[:, None])
        x[:, 256] = distinct / np.maximum(1, length - 3)
        x[:, 257] = np.log1p(length) / np.log1p(PASSAGE)
    return x, per


def _encoded(col: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Features and passage counts of texts a to b, _SPAN bytes at a time: the
    arrays made on the way take some 60 bytes for each of text. A longer text
    goes in slices of whole passages."""
    data, off = text_buffers(col)
    for a, b in runs_of(np.diff(off), _SPAN):
        part, ends = data[off[a]:off[b]], off[a:b + 1] - off[a]
        if len(part) <= _SPAN:
            yield a, b, *passages(part, ends)
            continue
        step = _SPAN - _SPAN % PASSAGE
        cuts = [passages(x, np.array([0, len(x)])) for x in (part[i:i + step] for i in range(0, len(part), step))]
        yield a, b, np.concatenate([x for x, _ in cuts]), sum(n for _, n in cuts)


def _sigmoid(v: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(v, -30, 30)))


class Model:
    """Weights: x -> h = tanh(x A + a); attention softmax of (tanh(h V) * sigmoid(h U)) w
    over a text's passages; score sigmoid(sum(attention * h) c + b)."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.w = {"A": r.normal(0, FEATURES ** -0.5, (FEATURES, HIDDEN)), "a": np.zeros(HIDDEN),
                  "V": r.normal(0, HIDDEN ** -0.5, (HIDDEN, GATE)), "U": r.normal(0, HIDDEN ** -0.5, (HIDDEN, GATE)),
                  "w": r.normal(0, GATE ** -0.5, GATE), "c": r.normal(0, HIDDEN ** -0.5, HIDDEN), "b": np.zeros(1)}

    def forward(self, x: np.ndarray, per: np.ndarray) -> dict[str, np.ndarray]:
        w, first = self.w, np.r_[0, np.cumsum(per)[:-1]]
        h = np.tanh(x @ w["A"] + w["a"])
        t, s = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
        e = (t * s) @ w["w"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, first), per))
        att = e / np.repeat(np.add.reduceat(e, first), per)
        z = np.add.reduceat(att[:, None] * h, first, axis=0)
        return {"h": h, "t": t, "s": s, "att": att, "z": z, "p": _sigmoid(z @ w["c"] + w["b"]), "first": first}

    def scores(self, x: np.ndarray, per: np.ndarray) -> np.ndarray:
        return self.forward(x, per)["p"]

    def gradient(self, x: np.ndarray, per: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        w, f = self.w, self.forward(x, per)
        d = (f["p"] - y) * weight
        g = {"c": f["z"].T @ d, "b": np.array([d.sum()])}
        dz = np.repeat(d[:, None] * w["c"], per, axis=0)
        datt = (dz * f["h"]).sum(axis=1)
        mean = np.repeat(np.add.reduceat(f["att"] * datt, f["first"]), per)
        de = f["att"] * (datt - mean)
        ts = f["t"] * f["s"]
        g["w"] = ts.T @ de
        dt = de[:, None] * w["w"] * f["s"] * (1 - f["t"] ** 2)
        ds = de[:, None] * w["w"] * f["t"] * f["s"] * (1 - f["s"])
        g["V"], g["U"] = f["h"].T @ dt, f["h"].T @ ds
        dh = f["att"][:, None] * dz + dt @ w["V"].T + ds @ w["U"].T
        da = dh * (1 - f["h"] ** 2)
        g["A"], g["a"] = x.T @ da, da.sum(axis=0)
        return g


def fit(texts: list[str], labels: list[int], seed: int = 7, epochs: int = EPOCHS) -> Model:
    """Learn from texts and 0/1 labels by Adam over mini-batches of whole texts.
    Both classes weigh the same. Without both classes every score is the share
    of label 1 (one half if there are no labels)."""
    model = Model(seed)
    y = np.array(labels, np.float64)
    if len(set(labels)) < 2:
        share = y.mean() if len(y) else 0.5
        model.w["c"][:] = 0
        model.w["b"][0] = np.log((share + 1e-6) / (1 - share + 1e-6))
        return model
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    parts = list(_encoded(pa.array(texts, pa.string())))
    x, per = np.concatenate([p[2] for p in parts]), np.concatenate([p[3] for p in parts])
    del parts
    first = np.r_[0, np.cumsum(per)]
    m = {k: np.zeros_like(v) for k, v in model.w.items()}
    v = {k: np.zeros_like(u) for k, u in model.w.items()}
    r, step = np.random.default_rng(seed), 0
    for _ in range(epochs):
        for pick in np.array_split(r.permutation(len(y)), max(1, len(y) // 256)):
            rows = np.concatenate([np.arange(first[i], first[i + 1]) for i in pick])
            g = model.gradient(x[rows], per[pick], y[pick], weight[pick] / len(pick))
            step += 1
            for k in g:
                gk = g[k] + 1e-4 * model.w[k]
                m[k] = 0.9 * m[k] + 0.1 * gk
                v[k] = 0.999 * v[k] + 0.001 * gk ** 2
                model.w[k] -= RATE * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)
    return model


def fit_tables(docs: DataFrame, labels: DataFrame, fold: int = 5, held: int = 0, id_col: str = "doc_id",
               text_col: str = "text", per_class: int = SAMPLE_PER_CLASS) -> Model:
    """Learn from the labelled rows outside the held-out fold; at most
    ``per_class`` rows of each class and SAMPLE_BYTES bytes of each reach the driver."""
    rows = labelled_sample(docs, labels, "quality", fold, held, per_class, SAMPLE_BYTES, id_col, text_col)
    return fit([t for t, _ in rows], [y for _, y in rows])


def _scorer(model: Model):
    def scores(col: pa.Array) -> np.ndarray:
        out = np.zeros(len(col))
        for a, b, x, per in _encoded(col):
            out[a:b] = model.scores(x, per)
        return out

    return scores


def scored(docs: DataFrame, model: Model, fold: int = 5, held: int = 0, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """One row per input row: id, held_out, score, predicted (1 from THRESHOLD on).

    Only the text enters the score. Null and empty texts score as one passage of
    zeros; a null id is in no fold (held_out false); repeated rows are scored
    each; other columns are not read; no rows give no rows.
    """
    bounded_batches(docs.sparkSession)
    scores = _scorer(model)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores(b.column(1)), pa.float64())],
                                             names=["_id", "score"])

    kind = dict(docs.dtypes)[id_col]
    got = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text")).mapInArrow(
        of, f"_id {kind}, score double")
    return got.select(
        F.col("_id").alias(id_col),
        F.coalesce(F.crc32(F.col("_id").cast("string")) % fold == held, F.lit(False)).alias("held_out"),
        "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text scores at least THRESHOLD, same columns."""
    bounded_batches(docs.sparkSession)
    scores, at = _scorer(model), docs.columns.index(text_col)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(scores(b.column(at)) >= THRESHOLD))

    return docs.mapInArrow(of, docs.schema)
