"""Exact and near deduplication against brute force, and the edge tables."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from llm_cases import DOCS, docs, no_docs, rows
from platelens.llm import components, exact_dedup, simhash


def _dedup(data):
    groups = defaultdict(list)
    for i, t in data:
        groups[t or ""].append(i)
    out = []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        sha, left = hashlib.sha256(t.encode()).hexdigest(), True
        for i in sorted(ids, key=lambda x: x != keep):
            out.append((i, keep, len(ids), i == keep and left, sha))
            left = left and i != keep
    return sorted(out, key=repr)


@pytest.mark.parametrize("clash", [False, True])
def test_exact_dedup_edges(spark, clash):
    got = exact_dedup.dedup(docs(spark, clash))
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert rows(got) == _dedup([(r[0], r[1]) for r in DOCS])


def test_exact_dedup_empty_table(spark):
    assert exact_dedup.dedup(no_docs(spark)).collect() == []
    assert exact_dedup.drop_copies(no_docs(spark)).collect() == []


def test_texts_that_differ_in_one_byte_or_share_chunks_are_told_apart(spark):
    r = random.Random(1)
    base = "".join(r.choice("abcdefgh \n") for _ in range(60_000))
    texts = [base, base, base[:-1], base[:30_000] + "x" + base[30_001:], base[20_000:], base + base, "x" + base]
    data = list(enumerate(texts * 2))
    got = exact_dedup.dedup(spark.createDataFrame(data, "doc_id long, text string").repartition(4))
    assert rows(got) == _dedup(data)


def test_drop_copies_keeps_columns_and_one_row_of_each(spark):
    got = exact_dedup.drop_copies(docs(spark, True))
    assert got.columns == docs(spark, True).columns
    texts = [r["text"] or "" for r in got.collect()]
    assert sorted(texts) == sorted({r[1] or "" for r in DOCS})
    assert {r["doc_id"] for r in got.collect()} >= {2, 7, 8, 9}


def test_chunks_move_with_content():
    r = np.random.default_rng(3)
    a = r.integers(0, 256, 200_000, dtype=np.uint8)
    b = np.concatenate([r.integers(0, 256, 777, dtype=np.uint8), a])

    def parts(x):
        ends = exact_dedup.chunk_ends(x)
        assert ends[-1] == len(x)
        return [x[s:e].tobytes() for s, e in zip([0, *ends], ends)]

    pa_, pb = parts(a), parts(b)
    assert len(set(pa_) & set(pb)) > 0.9 * len(pa_)
    assert max(map(len, pa_)) <= exact_dedup.MAX_CHUNK and exact_dedup.chunk_ends(a[:0]) == []


def _fingerprint(text, k=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", low) if w]
    if not words:
        return 0
    grams = [" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    hs = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aBÉ \n\t xy", max_size=60))
def test_fingerprint_by_definition(text):
    assert simhash.fingerprint(text) == _fingerprint(text)


def _components(fps, most=3):
    root = {x: x for x in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    fps = sorted(set(fps))
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= most:
                root[find(a)] = find(b)
    return {x: find(x) for x in fps}


def test_near_duplicate_edges(spark):
    want = [(r[0], _fingerprint(r[1])) for r in DOCS]
    root = _components([f for _, f in want])
    low = defaultdict(list)
    for i, f in want:
        low[root[f]].append(i)
    low = {k: min([i for i in v if i is not None], default=None) for k, v in low.items()}
    got = simhash.near_duplicates(docs(spark, True))
    assert rows(got) == sorted(((i, f"{f:016x}", low[root[f]]) for i, f in want), key=repr)
    assert simhash.near_duplicates(no_docs(spark)).collect() == []
    kept = simhash.one_of_each(docs(spark, True))
    assert kept.columns == docs(spark, True).columns
    assert sorted(root[_fingerprint(r["text"])] for r in kept.collect()) == sorted(set(root.values()))
    assert simhash.one_of_each(no_docs(spark)).collect() == []


@pytest.mark.parametrize("block,pairwise", [(1 << 14, 48), (40, 8), (16, 2)])
def test_links_lose_no_component(spark, monkeypatch, block, pairwise):
    """Dense and sparse fingerprints; small blocks force cells to be split."""
    monkeypatch.setattr(simhash, "_BLOCK", block)
    monkeypatch.setattr(simhash, "_PAIRWISE", pairwise)
    r = random.Random(block)
    fps = {r.getrandbits(64) for _ in range(300)}
    for centre in list(fps)[:6]:
        for _ in range(60):
            x = centre
            for b in r.sample(range(64), r.randint(1, 5)):
                x ^= 1 << b
            fps.add(x)
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in fps]
    found = simhash.links(spark.createDataFrame(signed, "fp long"))
    for a, b in found.collect():
        assert ((a ^ b) & (2 ** 64 - 1)).bit_count() <= 3
    got = {n % 2 ** 64: t % 2 ** 64 for n, t in components.components(found).collect()}
    want = _components(fps)
    groups, mine = defaultdict(set), defaultdict(set)
    for x in fps:
        groups[want[x]].add(x)
        mine[got.get(x, x)].add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def test_components_of_a_chain_a_star_and_nothing(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 40)] + [(5, 5), (None, 3), (7, 6)]
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(1, 61)}, **{1000 + i: 1000 for i in range(1, 40)}}
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_tree_links_join_what_all_owner_links_join():
    r = np.random.default_rng(4)
    for n, owners in ((400, 30), (400, 400), (90, 1), (60, 0)):
        base = r.integers(0, 1 << 63, 12, dtype=np.uint64)
        fp = base[r.integers(0, len(base), n)]
        for _ in range(4):
            fp = fp ^ (np.uint64(1) << r.integers(0, 63, n).astype(np.uint64))
        fp = np.unique(fp)
        r.shuffle(fp)
        own = np.arange(len(fp)) < owners

        def grouped(pairs):
            low = {int(x): int(x) for x in fp}
            while True:
                new = dict(low)
                for a, b in pairs:
                    new[a] = new[b] = min(new[a], new[b])
                if new == low:
                    return low
                low = new

        every = [(int(fp[i]), int(fp[j])) for i in range(len(fp)) for j in range(i + 1, len(fp))
                 if own[i] and simhash._linked(fp[i:i + 1], fp[j:j + 1], 3)[0]]
        src, dst = simhash._tree(fp, own, 3)
        tree = [(int(a), int(b)) for x, y in zip(src, dst) for a, b in zip(x, y)]
        assert set(tree) <= set(every) | {(b, a) for a, b in every} and len(tree) < len(fp)
        assert grouped(tree) == grouped(every)


@pytest.fixture()
def eager_to_split(spark):
    """Skew joins at test sizes, and no broadcasts instead."""
    conf = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "8k",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
            "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false",
            "spark.sql.shuffle.partitions": "16", "spark.sql.files.openCostInBytes": "64m"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _ran(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_copies_of_one_text_are_split(spark, eager_to_split):
    from pyspark.sql import functions as F
    text = F.when(F.col("id") % 10 > 0, F.lit("one text for nearly all of them")).otherwise(F.concat(F.lit("text "), F.col("id")))
    d = spark.range(20000).select(F.col("id").alias("doc_id"), text.alias("text")).repartition(8)
    out = exact_dedup.dedup(d)
    assert "skew=true" in _ran(out)
    assert out.where("kept").count() == 2001 and out.where("group_size = 18000").count() == 18000
