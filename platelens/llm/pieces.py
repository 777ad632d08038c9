"""SentencePiece encoding and decoding by shared-prefix Viterbi.

A text becomes marked words (white space as a mark before the word). The
distinct marked words of a batch are sorted, which is the depth-first order of
their trie, and a word keeps the forward states of the prefix it shares with the
word before, so each trie node is computed once.

The forward state of a prefix is, for unigram models, the best score and its last
piece. For BPE models, whose result is that of greedy merges, the state is the one
piece that the merges of this prefix end in: a split is the merges' result exactly
if every piece is the result of its own characters and every neighbouring pair is
the result of theirs, so a last piece is tested against the state before it; the ids
equal those of the sentencepiece library. Unigram ids are a split of the highest
score in double precision.

The model file is read by each task; its path is a parameter and must be one that
all executors see. No shuffle: words are encoded where their texts are.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

MARK = "▁"
CACHE = 300_000          # marked words that a worker keeps with their ids
_LONG = 64               # characters of a word from which on prefixes keep no ids of their own
_AT_ONCE = 20_000        # words that the library encodes in one call
_SPAN = 8 << 20          # bytes of text whose words are sorted together
_UNKNOWN, _START = -1, -2    # a character that no piece has, which becomes its bytes; a word's start


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield tag >> 3, data[at:at + size]
            at += size


def _rules(model: bytes) -> tuple[bool, bool, bool]:
    """(unigram, a mark before the text, white space trimmed) of a model file."""
    unigram = prefix = trim = True
    for field, value in _fields(model):
        if field == 2:
            for f, v in _fields(value):
                if f == 3:
                    unigram = v == 1
                    if v not in (1, 2):
                        raise ValueError("only unigram and BPE models are served")
        elif field == 3:
            for f, v in _fields(value):
                if f == 2 and v:
                    raise ValueError("models with a normalisation table are not served")
                prefix = bool(v) if f == 3 else prefix
                trim = bool(v) if f == 4 else trim
    return unigram, prefix, trim


def _word_pattern(vocab: Iterable[str]) -> re.Pattern:
    """Marked words: no piece goes on over a mark, nor over white space that none has."""
    vocab = list(vocab)
    alphabet = set("".join(vocab))
    crossing = any(MARK in p.lstrip(MARK) for p in vocab)
    ends = "" if crossing else "".join(c for c in "\n\t\r" if c not in alphabet)
    return (re.compile(r"(?s).+") if crossing else
            re.compile(f"{MARK}+[^{MARK}{ends}]*|[^{MARK}{ends}]+" + (f"|[{ends}]" if ends else "")))


def _normal(text: str, prefix: bool, trim: bool) -> str:
    if trim:
        text = re.sub(" +", " ", text).strip(" ")
    return (MARK if prefix and text else "") + text.replace(" ", MARK)


class Counts:
    """Numbers of ids of texts, without the ids: the library encodes the distinct
    marked words of some texts, and a text's number is the sum of its words'. Keeps
    nothing from call to call."""

    #: Merged into the model's normaliser (field 3): no mark in front, white space as it
    #: is, so that a marked word is encoded as it stands.
    AS_GIVEN = bytes([0x1A, 4, 0x18, 0, 0x20, 0])

    def __init__(self, model: bytes):
        _, self.prefix, self.trim = _rules(model)
        self.lib = sentencepiece.SentencePieceProcessor(model_proto=model + self.AS_GIVEN)
        lib = self.lib
        kinds = [lib.is_byte(i) for i in range(lib.get_piece_size())]
        if sum(kinds) < 256:
            raise ValueError("only models with byte fallback are served")
        self.words = _word_pattern(lib.id_to_piece(i) for i, byte in enumerate(kinds)
                                   if not (byte or lib.is_control(i) or lib.is_unknown(i)))

    def lengths(self, texts: list[str | None]) -> list[int]:
        split = [self.words.findall(_normal(t, self.prefix, self.trim)) if t else [] for t in texts]
        words = list(set(chain.from_iterable(split)))
        known: dict[str, int] = {}
        for at in range(0, len(words), _AT_ONCE):
            part = words[at:at + _AT_ONCE]
            known.update(zip(part, map(len, self.lib.encode(part, num_threads=1))))
        return [sum(map(known.__getitem__, ws)) for ws in split]


class Pieces:
    """A SentencePiece model: its vocabulary, kind and white-space rules.

    Served: unigram and BPE models with byte fallback, without a normalisation
    table and without user-defined pieces."""

    def __init__(self, model: bytes):
        lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = lib.get_piece_size()
        self.pieces = [lib.id_to_piece(i) for i in range(n)]
        self.byte_ids = {}
        self.vocab: dict[str, int] = {}
        self.score = [lib.get_score(i) for i in range(n)]
        self.raw: list[bytes] = []
        for i, p in enumerate(self.pieces):
            if lib.is_byte(i):
                self.byte_ids[int(p[3:5], 16)] = i
                self.raw.append(bytes([int(p[3:5], 16)]))
            elif lib.is_control(i) or lib.is_unknown(i):
                self.raw.append(b"" if lib.is_control(i) else " ⁇ ".encode())
            else:
                self.vocab[p] = i
                self.raw.append(p.replace(MARK, " ").encode())
        self.unigram, self.prefix, self.trim = _rules(model)
        if len(self.byte_ids) < 256:
            raise ValueError("only models with byte fallback are served")
        self.value = {p: self.score[i] for p, i in self.vocab.items()}
        self.words = _word_pattern(self.vocab)
        # trie of reversed pieces: character -> (children, id or -1)
        self.ends: dict[str, tuple[dict, int]] = {}
        for p, i in self.vocab.items():
            node = self.ends
            for c in p[:0:-1]:
                node = node.setdefault(c, ({}, -1))[0]
            node[p[0]] = (node.get(p[0], ({}, -1))[0], i)
        self.unknown_score = min(self.score[i] for i in self.vocab.values()) - 10.0
        self.pairs: dict[int, bool] = {}

    def normal(self, text: str) -> str:
        return _normal(text, self.prefix, self.trim)

    # ---- forward states -------------------------------------------------

    def _merged(self, text: str) -> list[str]:
        """The greedy merges of a short string: always the best-scored pair, of
        equal ones the leftmost."""
        s, value = list(text), self.value
        none = float("-inf")
        gains = [value.get(a + b, none) for a, b in zip(s, s[1:])]
        while gains:
            best = max(gains)
            if best == none:
                break
            at = gains.index(best)
            s[at:at + 2] = [s[at] + s[at + 1]]
            del gains[at]
            if at < len(gains):
                gains[at] = value.get(s[at] + s[at + 1], none)
            if at:
                gains[at - 1] = value.get(s[at - 1] + s[at], none)
        return s

    def _fits(self, a: int, k: int) -> bool:
        """Whether piece ``k`` may follow what ``a`` names: a piece, the word's
        start, or bytes (nothing merges with those)."""
        b = self.pieces[k]
        ok = self._merged(b) == [b] if a < 0 else self._merged(self.pieces[a] + b) == [self.pieces[a], b]
        if len(self.pairs) > 2_000_000:
            self.pairs.clear()
        self.pairs[a << 24 | k] = ok
        return ok

    def encode_words(self, words: list[str]) -> dict[str, tuple[int, ...]]:
        """Ids of distinct words; the words are walked in sorted order."""
        out: dict[str, tuple[int, ...]] = {}
        # by prefix length: last piece, best score, and the ids of the prefix
        last, best, ids = [_START], [0.0], [()]
        before = ""
        for word in sorted(words):
            if len(word) > _LONG:
                out[word] = self._long_word(word)
                continue
            keep, top = 0, min(len(before), len(word))
            while keep < top and before[keep] == word[keep]:
                keep += 1
            del last[keep + 1:], best[keep + 1:], ids[keep + 1:]
            for i in range(keep + 1, len(word) + 1):
                k, at = self._step(word, i, last, best)
                ids.append(ids[at] + ((k,) if k >= 0 else self._bytes(word[i - 1])))
            out[word] = ids[-1]
            before = word
        return out

    def _step(self, word: str, i: int, last: list[int], best: list[float]) -> tuple[int, int]:
        """Append the forward state of the prefix of length ``i``; returns its last
        piece and where that starts. Pieces that end here come shortest first, by a
        trie of reversed pieces; a character that no piece fits becomes its bytes."""
        node, j, pick, at = self.ends, i, _UNKNOWN, i - 1
        if self.unigram:
            top = best[i - 1] + self.unknown_score
            while j:
                j -= 1
                step = node.get(word[j])
                if step is None:
                    break
                node, k = step
                if k >= 0 and (pick < 0 or best[j] + self.score[k] >= top):   # of equal ones the longest
                    pick, at, top = k, j, best[j] + self.score[k]
            best.append(top)
        else:
            pairs = self.pairs
            while j:
                j -= 1
                step = node.get(word[j])
                if step is None:
                    break
                node, k = step
                if k >= 0:
                    ok = pairs.get(last[j] << 24 | k)
                    if ok is None:
                        ok = self._fits(last[j], k)
                    if ok:
                        pick, at = k, j
                        break
        last.append(pick)
        return pick, at

    def _bytes(self, c: str) -> tuple[int, ...]:
        return tuple(self.byte_ids[x] for x in c.encode("utf-8", "replace"))

    def _long_word(self, word: str) -> tuple[int, ...]:
        """As for short words, with back pointers in place of the ids of every prefix."""
        last, best, back, got = [_START], [0.0], [0], []
        for i in range(1, len(word) + 1):
            back.append(self._step(word, i, last, best)[1])
        i = len(word)
        while i:
            got += (last[i],) if last[i] >= 0 else reversed(self._bytes(word[i - 1]))
            i = back[i]
        return tuple(reversed(got))

    # ---- texts -----------------------------------------------------------

    def encode(self, texts: list[str | None], known: dict[str, tuple[int, ...]] | None = None) -> list[np.ndarray]:
        """Ids of each text; ``known`` is a cache of words that the call fills."""
        known = {} if known is None else known
        split = [self.words.findall(self.normal(t)) if t else [] for t in texts]
        fresh = set(chain.from_iterable(split)).difference(known)
        if len(known) + len(fresh) > CACHE:       # go on with the words of these texts
            kept = {w: known[w] for w in set(chain.from_iterable(split)).difference(fresh)}
            known.clear()
            known.update(kept)
        known.update(self.encode_words(list(fresh)))
        get = known.__getitem__
        return [np.fromiter(chain.from_iterable(map(get, ws)), np.int32) for ws in split]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: pieces joined, marks as spaces, without the space that
        encoding puts in front; bytes that are not UTF-8 become U+FFFD."""
        data = b"".join(map(self.raw.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return data[1:] if self.prefix and data.startswith(" ") else data


@lru_cache(maxsize=1)
def loaded(model_path: str) -> tuple[Pieces, dict[str, tuple[int, ...]]]:
    """The model and a cache of encoded words, kept by a worker from task to task."""
    with open(model_path, "rb") as f:
        return Pieces(f.read()), {}


@lru_cache(maxsize=1)
def counts(model_path: str) -> Counts:
    """The model for counting, kept by a worker from task to task."""
    with open(model_path, "rb") as f:
        return Counts(f.read())


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches joined to about _SPAN bytes: the more words are sorted together, the
    more prefixes they share."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= _SPAN:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_tokens, ids (array of int), round_trip.

    round_trip: decoding the ids gives the text back. Null counts as the empty
    text, which has no ids and is given back; a text that has the mark itself is
    not, as it decodes to a space. Repeated rows come out as often as they go in;
    other columns are not read; no rows give no rows.
    """
    bounded_batches(docs.sparkSession)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = loaded(model_path)
        for b in gathered(batches):
            texts = b.column(1).to_pylist()
            got = model.encode(texts, known)
            offsets = np.r_[0, np.cumsum([len(x) for x in got])].astype(np.int32)
            flat = np.concatenate(got) if got else np.zeros(0, np.int32)
            same = [model.decode(x) == (t or "") for x, t in zip(got, texts)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.diff(offsets), pa.int64()),
                 pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32())), pa.array(same, pa.bool_())],
                names=["_id", "n_tokens", "ids", "round_trip"])

    kind = dict(docs.dtypes)[id_col]
    return (docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
            .mapInArrow(of, f"_id {kind}, n_tokens long, ids array<int>, round_trip boolean")
            .withColumnRenamed("_id", id_col))


def counted(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_tokens as in ``encode``, without the ids, which
    the sentencepiece library counts word by word (the forward pass of ``encode``
    takes several times as long)."""
    bounded_batches(docs.sparkSession)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = counts(model_path)
        for b in gathered(batches):
            n = model.lengths(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=["_id", "n_tokens"])

    kind = dict(docs.dtypes)[id_col]
    return (docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
            .mapInArrow(of, f"_id {kind}, n_tokens long").withColumnRenamed("_id", id_col))


def decode(rows: DataFrame, model_path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``rows`` with the text of their ids as one more column; null ids give null,
    no ids the empty text."""
    bounded_batches(rows.sparkSession)
    at = rows.columns.index(ids_col)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, _ = loaded(model_path)
        for b in batches:
            texts = [None if x is None else model.decode(np.array(x, np.int64)) for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())],
                                             schema=b.schema.append(pa.field(text_col, pa.string())))

    return rows.mapInArrow(of, rows.select("*", F.lit(None).cast("string").alias(text_col)).schema)
