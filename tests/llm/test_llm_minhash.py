"""MinHash near-duplicates against all pairs compared in a loop."""

import random

import numpy as np
import pytest

from llm_cases import docs, no_docs, rows

from platelens.llm import minhash


def plain_sets(data, size=4):
    out = []
    for _, text in data:
        words = (text or "").encode().lower().split()
        n = max(1, len(words) - size + 1) if words else 0
        out.append({b" ".join(words[i:i + size]) for i in range(n)})
    return out


def plain(data, size=4, percent=80):
    sets = plain_sets(data, size)
    root = list(range(len(data)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                x, y = sorted((top(i), top(j)))
                root[y] = x
    low = {}
    for i, (doc_id, _) in enumerate(data):
        if doc_id is not None:
            low[top(i)] = min(low.get(top(i), doc_id), doc_id)
    out = []
    for i, (doc_id, _) in enumerate(data):
        c = low.get(top(i))
        out.append((doc_id, len(sets[i]), c, doc_id == c))
    return sorted(out, key=repr)


def near_copies(seed, groups, most, words=90):
    """Texts that differ from one another in some words: similarities round 0.8."""
    r = random.Random(seed)
    data = []
    for _ in range(groups):
        base = [f"w{r.randint(0, 4000)}" for _ in range(r.randint(words // 2, words))]
        for _ in range(r.randint(1, most)):
            own = list(base)
            for _ in range(r.choice([0, 1, 1, 2, 2, 3, 4, 6, 9])):
                own[r.randrange(len(own))] = f"x{r.randint(0, 10 ** 6)}"
            data.append((len(data), " ".join(own).replace("w1", "W1")))
    r.shuffle(data)
    return data


def _got(df):
    return rows(minhash.near_duplicates(df).select("doc_id", "n_shingles", "component_id", "kept"))


def test_components_equal_all_pairs(spark):
    data = near_copies(11, 60, 9)
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    assert _got(df) == plain(data)


@pytest.mark.parametrize("sets, block", [(4, 1 << 13), (3, 6)])
def test_large_clusters_and_keys_are_dealt_out_whole(spark, monkeypatch, sets, block):
    monkeypatch.setattr(minhash, "_SETS", sets)
    monkeypatch.setattr(minhash, "_BLOCK", block)
    data = near_copies(23, 6, 40)
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    assert _got(df) == plain(data)


def test_all_kinds_of_rows(spark):
    data = [(r.doc_id, r.text) for r in docs(spark).collect()]
    want = plain(data)
    assert _got(docs(spark)) == want and _got(docs(spark, clash=True)) == want
    assert _got(no_docs(spark)) == []


def test_signatures_within_the_threshold_always_meet(spark):
    r = np.random.default_rng(2)
    base = r.integers(0, 1 << 16, (200, minhash.VALUES)).astype(np.uint16)
    other = base.copy()
    for i, row in enumerate(other):                 # exactly THRESHOLD values differ
        at = r.choice(minhash.VALUES, minhash.THRESHOLD, replace=False)
        row[at] ^= np.uint16(1 + i % 15)
    both = np.concatenate([base, other])
    df = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in enumerate(both)], "node long, sig binary")
    got = {(r.a, r.b) for r in minhash.candidates(df).collect()}
    assert {(i, i + 200) for i in range(200)} <= got


def test_values_differ_as_often_as_the_sets():
    r = random.Random(4)
    base = [f"a{i}" for i in range(400)]
    texts = [" ".join(base)]
    for _ in range(200):
        own = list(base)
        for i in r.sample(range(400), 12):
            own[i] = f"b{r.random()}"
        texts.append(" ".join(own))
    hashes, bounds = minhash.shingle_sets(texts)
    sets = [set(hashes[a:b].tolist()) for a, b in zip(bounds[:-1], bounds[1:])]
    sig = minhash.signatures(hashes, bounds)
    apart = [1 - len(sets[0] & s) / len(sets[0] | s) for s in sets[1:]]
    seen = (sig[1:] != sig[0]).mean(axis=1)
    assert abs(float(np.mean(seen)) - float(np.mean(apart))) < 0.02
    plain_sizes = [len(s) for s in plain_sets([(0, t) for t in texts])]
    assert np.diff(bounds).tolist() == plain_sizes


def test_z_short_texts_keep_their_own_shingle():
    hashes, bounds = minhash.shingle_sets(["a b", "a b c", None, " \n", "A B", "a b c d", "b"])
    assert np.diff(bounds).tolist() == [1, 1, 0, 0, 1, 1, 1]
    assert hashes[0] == hashes[2] and len(set(hashes.tolist())) == 4
