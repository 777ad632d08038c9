"""Periodic runs against a plain search, importance resampling against plain counts."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from llm_cases import LONG, docs, no_docs, rows

from platelens.llm import resampling, runs


def plain_runs(words):
    """Every maximal stretch of smallest period q and at least max(24, 3 q) words."""
    n, out, seen = len(words), [], set()
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(24, 3 * q) and (i, j + q) not in seen:
                seen.add((i, j + q))        # the smallest period of a stretch comes first
                out.append((i, j - i + q, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    words = (text or "").encode().split()
    own = plain_runs(words)
    drop = {w for s, length, q in own for w in range(s + q, s + length)}
    best = max(own, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if own else (None,) * 3
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(own), *best, 1000 * best[1] // best[2] if own else None,
            sha("".join("%d,%d,%d\n" % r for r in own).encode()),
            sha(b" ".join(w for i, w in enumerate(words) if i not in drop)))


COLS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def _texts(seed, many):
    r = random.Random(seed)
    for _ in range(many):
        alphabet = "abcdefgh"[:r.choice([1, 2, 3, 8])]
        out = []
        for _ in range(r.randint(1, 6)):
            unit = [r.choice(alphabet) for _ in range(r.choice([1, 2, 3, 5, 8, 15, 16, 17, 31, 33, 60, 90]))]
            cut = r.randint(0, len(unit))
            out += unit * r.randint(1, 7) + unit[:cut]
            if r.random() < .3 and out:
                out[r.randrange(len(out))] = "zz"
        yield " ".join(out)


def test_runs_equal_a_plain_search(spark):
    data = [(i, t) for i, t in enumerate(_texts(5, 150))]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    assert rows(runs.periodic(df).select(COLS)) == sorted((plain_row(i, t) for i, t in data), key=repr)


def test_runs_of_all_kinds_of_rows(spark):
    want = sorted((plain_row(r.doc_id, r.text) for r in docs(spark).collect() if r.text != LONG), key=repr)
    for clash in (False, True):
        got = rows(runs.periodic(docs(spark, clash)).select(COLS))
        assert [g for g in got if g[0] not in (6, 7)] == want
    long = [r for r in runs.periodic(docs(spark)).collect() if r.doc_id == 6]
    assert [(r.n_runs, r.start, r.length, r.period, r.n_kept) for r in long] == [(1, 0, 20000, 5, 5)]
    assert long[0].collapsed == "lorem ipsum dolor sit amet"
    assert runs.periodic(no_docs(spark)).collect() == []


def test_tiles_carry_every_octave_and_the_z_function_counts():
    x = [1, 1, 2, 1, 1, 2, 1, 3]
    assert runs.z_function(x) == [8, 1, 0, 4, 1, 0, 1, 0] and runs.z_function([]) == []
    assert [s[:2] for s in runs.scales(200)] == [(0, 1), (1, 16), (2, 32), (3, 64)]
    text = np.tile(np.arange(1000, dtype=np.int32), 4)
    at = {k: c for k, _, _, c in runs.anchors(text)}
    assert list(at) == [6] and at[6].tolist() == list(range(0, 2993, 512))


def test_one_long_run_over_many_tiles(spark):
    unit = [f"w{i}" for i in range(700)]
    text = " ".join(["head"] + unit * 30 + ["tail"])
    same = " ".join(["x"] * 60000)
    df = spark.createDataFrame([(1, text), (2, same)], "doc_id long, text string")
    got = {r.doc_id: (r.n_runs, r.start, r.length, r.period) for r in runs.periodic(df).collect()}
    assert got == {1: (1, 1, 21000, 700), 2: (1, 0, 60000, 1)}


# --- resampling ---------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_features(text, max_n):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    return words, [" ".join(words[i:i + n]) for n in range(1, max_n + 1) for i in range(len(words) - n + 1)]


def plain_resampling(data, target, max_n=1, buckets=10000, min_words=20, share=10):
    of = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for _, text in data:
        s.update(map(of, plain_features(text, max_n)[1]))
    for text in target:
        t.update(map(of, plain_features(text, max_n)[1]))
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
    out = []
    for i, text in data:
        words, found = plain_features(text, max_n)
        w = sum(gain(of(f)) for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(found), w, w + math.floor(-1000 * math.log(-math.log((h + .5) / 4294967296))), None, len(words)])
    fit = sorted((r for r in out if r[5] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0]))
    for k, r in enumerate(fit[:len(fit) * share // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


@pytest.mark.parametrize("max_n", [1, 3])
def test_resampling_equals_plain_counts(spark, max_n):
    r = random.Random(3)
    vocabulary = ["Alpha", "beta,", "GAMMA-x", "δελτα", "42", "漢字", "o'k", "ZÄ", "\u0000nul", "e"]
    data = [(i, " ".join(r.choice(vocabulary) for _ in range(r.choice([0, 3, 19, 20, 60])))) for i in range(300)]
    data += [(300, None), (301, ""), (302, "  \n"), (303, " ".join(["Beta 42"] * 40000))]
    target = ["beta 42 beta", "漢字", None, "δελτα e"]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    got = resampling.resampled(df, bench, max_n=max_n).select("doc_id", "n_features", "weight", "score", "rank")
    assert rows(got) == plain_resampling(data, target, max_n)


def test_resampling_of_all_kinds_of_rows(spark):
    bench = spark.createDataFrame([("lorem ipsum",)], "text string")
    cols = ["doc_id", "n_features", "weight", "score", "rank"]
    data = [(x.doc_id, x.text) for x in docs(spark).collect()]
    want = plain_resampling(data, ["lorem ipsum"], min_words=2, share=50)
    for clash in (False, True):
        got = rows(resampling.resampled(docs(spark, clash), bench, min_words=2, share=50).select(cols))
        assert got == want
    assert resampling.resampled(no_docs(spark), bench).collect() == []
    none = spark.createDataFrame([], "text string")
    assert resampling.resampled(docs(spark), none, share=0).where("rank IS NOT NULL").count() == 0


def test_features_never_cross_texts():
    found, owner, words = resampling.features(["a b", None, "c", "\0d\0", "e f g"], max_n=3, buckets=1 << 31)
    assert words.tolist() == [2, 0, 1, 1, 3] and np.bincount(owner, minlength=5).tolist() == [3, 0, 1, 1, 6]
    assert zlib.crc32(b"e f g") % (1 << 31) in found.tolist() and zlib.crc32(b"b c") % (1 << 31) not in found.tolist()
