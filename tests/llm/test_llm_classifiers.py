"""Classifiers: gradient check, held-out accuracy, edge tables."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

from conftest import SF01
from llm_cases import DOCS, docs, no_docs
from platelens.llm import quality, queries, toxicity


def test_attention_gradient_by_differences():
    r = np.random.default_rng(0)
    model = quality.Model(3)
    x, per = r.random((9, quality.FEATURES)), np.array([4, 1, 4])
    y, weight = np.array([1.0, 0, 1]), np.array([0.2, 0.5, 0.3])

    def loss():
        p = model.scores(x, per)
        return -(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum()

    g = model.gradient(x, per, y, weight)
    for k, w in model.w.items():
        for at in [tuple(r.integers(0, n) for n in w.shape) for _ in range(4)]:
            old = w[at]
            w[at] = old + 1e-5
            up = loss()
            w[at] = old - 1e-5
            down = loss()
            w[at] = old
            assert g[k][at] == pytest.approx((up - down) / 2e-5, abs=1e-6)


def test_passage_slices_do_not_matter(monkeypatch):
    monkeypatch.setattr(quality, "_SPAN", 5000)      # the long texts go in slices
    texts = [r[1] or "" for r in DOCS]
    whole = np.concatenate([quality.passages(*quality.text_buffers(pa.array([t])))[0] for t in texts])
    parts = list(quality._encoded(pa.array(texts)))
    assert np.allclose(whole, np.concatenate([x for _, _, x, _ in parts]))
    assert [n for *_, per in parts for n in per] == [max(1, -(-len(t.encode()) // quality.PASSAGE)) for t in texts]


@pytest.mark.parametrize("mod,name,label,fold,held,least", [
    (quality, "op3_quality", "quality", 5, 0, 0.95), (toxicity, "op5_toxicity", "toxic", 4, 2, 0.85)])
def test_held_out_accuracy(spark, mod, name, label, fold, held, least):
    got = queries.QUERIES[name](spark, SF01).toPandas()
    assert list(got.columns) == ["doc_id", "held_out", "score", "predicted"] and got.score.between(0, 1).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % fold == held for i in got.doc_id]).all()
    assert (got.predicted == (got.score >= 0.3)).all()
    lab = spark.read.parquet(f"{SF01}/labels.parquet").toPandas()
    both = got[got.held_out].merge(lab, on="doc_id")
    ranks, y = both.score.rank(), both[label] == 1
    auc = (ranks[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum())
    assert auc >= least


@pytest.mark.parametrize("mod", [quality, toxicity])
def test_edge_tables(spark, mod):
    labels = spark.createDataFrame([(1, 1, 0), (8, 0, 1), (9, 0, 1), (2, 1, 0), (2, 1, 0), (None, 1, 1), (6, None, None)],
                                   "doc_id long, quality int, toxic int")
    model = mod.fit_tables(docs(spark, True), labels)
    got = mod.scored(docs(spark, True), model).collect()
    assert len(got) == len(DOCS) and all(0 <= r["score"] <= 1 for r in got)
    assert not any(r["held_out"] for r in got if r["doc_id"] is None)
    empty = {r["score"] for r in got if r["doc_id"] in (3, 4)}
    assert len(empty) == 1                      # null text scores as the empty one
    assert mod.scored(no_docs(spark), mod.fit_tables(no_docs(spark), labels.limit(0))).collect() == []
    assert mod.fit([], []) is not None and mod.fit(["a b c"], [1]) is not None and mod.fit(["", ""], [0, 1]) is not None


def test_training_never_sees_the_held_out_fold(spark):
    d = spark.createDataFrame([(i, f"t{i}") for i in range(200)], "doc_id long, text string")
    lab = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    from platelens.llm.common import labelled_sample
    got = labelled_sample(d, lab, "quality", 5, 0, 1000, 100)
    assert {t for t, _ in got} == {f"t{i}" for i in range(200) if zlib.crc32(str(i).encode()) % 5}
    assert len(labelled_sample(d, lab, "quality", 5, 0, 10, 100)) == 20


def test_misspelt_words_share_their_n_grams():
    r = np.random.default_rng(2)
    plain = ["garden", "window", "market", "yellow", "river", "paper", "stone", "letter", "winter", "music"]
    texts = [" ".join(r.choice(plain, 30)) + (" you horribleidiot " if i % 2 else " fine ") + " ".join(r.choice(plain, 30))
             for i in range(80)]
    model = toxicity.fit(texts, [i % 2 for i in range(80)])
    bad, odd, good = (toxicity._text_logit(model, "garden window " + w + " river paper")
                      for w in ("horribleidiot", "horibleidiott", "musical"))
    assert bad > good and odd > good


def test_bags_by_brute_force():
    r = np.random.default_rng(5)
    for n in (1, 2, 3, 4, 6, 7, 25, 60):
        words = r.integers(0, 12, n)
        of = r.normal(size=12)
        half, size = toxicity.WINDOW // 2, toxicity.WINDOW
        starts = range(0, max(1, (-(-n // half) - 1) * half), half)
        worst = max(sum(of[w] for w in set(words[a:a + size].tolist())) for a in starts) / size
        own = sorted(of[w] for w in set(words.tolist()))
        want = [worst, sum(own[-toxicity.WORST:]) / toxicity.WORST, sum(own) / max(len(own), size)]
        assert np.allclose(toxicity.bags(words, of[words]), want)
    assert (toxicity.bags(np.zeros(0, int), np.zeros(0)) == 0).all()


def test_only_n_grams_tied_to_the_label_get_a_vector():
    r = np.random.default_rng(3)
    plain = [f"{a}{b}{c}" for a in "bdgk" for b in "aeiou" for c in "lmnrst"]
    y = [i % 4 == 0 for i in range(200)]
    texts = [" ".join(r.choice(plain, 40)) + (" zyxwv" if t else "") for t in y]
    model = toxicity.fit(texts, [int(t) for t in y])
    _, telling = toxicity.grams_of(["zyxwv"])
    assert (model.margins[telling] > 0).all()
    assert (model.margins != 0).sum() < len(set(telling.tolist())) + 0.05 * len(set(toxicity.grams_of(plain)[1].tolist()))
    # the same words without a tie to the label: every score is the share of label 1
    shuffled = toxicity.fit([t.replace(" zyxwv", "") for t in texts[:8]], [0, 1] * 4, epochs=2)
    assert all(0 <= 1 / (1 + np.exp(-toxicity._text_logit(shuffled, t))) <= 1 for t in texts)
