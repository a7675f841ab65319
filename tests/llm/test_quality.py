"""Attention over passages: gradients, bounds, held-out accuracy."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

from trustfold.llm import quality


def test_every_byte_lies_in_one_passage():
    lengths = np.array([0, 1, 1023, 1024, 1025, 5000])
    counts, sizes = quality.passage_bounds(lengths)
    assert counts.tolist() == [1, 1, 1, 1, 2, 5] and sizes.sum() == lengths.sum() and sizes.max() <= 1024


def test_chunks_do_not_change_features(monkeypatch):
    texts = pa.array([b"", b"some words here.\n" * 300, "Ünï!! | *** ".encode() * 200, b"x"], pa.binary())
    whole = [np.concatenate(p) for p in zip(*quality.encoded_passages(texts))]
    monkeypatch.setattr(quality, "CHUNK_BYTES", 1500)
    parts = [np.concatenate(p) for p in zip(*quality.encoded_passages(texts.slice(0)))]
    assert np.array_equal(whole[0], parts[0]) and np.allclose(whole[1], parts[1])


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    how = quality.Training(hidden=3, attention=2)
    model = quality.Attention.fresh(how)
    x, of, label = rng.normal(0, 0.3, (12, quality.N_FEATURES)), np.repeat(np.arange(4), 3), np.array([1.0, 0, 1, 0])
    x[:, -1] = 0.9
    weight = np.full(4, 0.25)

    def loss():
        total, weighed = model.sums(x, of, 4)
        p = model.score(total, weighed)
        return -(weight * (label * np.log(p) + (1 - label) * np.log(1 - p))).sum()

    found = model.gradients(x, of, label, weight)
    for name in ("W", "b", "V", "U", "a", "c", "d"):
        flat = model.w[name].reshape(-1)
        for at in (0, len(flat) // 2):
            flat[at] += 1e-6
            above = loss()
            flat[at] -= 2e-6
            below = loss()
            flat[at] += 1e-6
            assert found[name].reshape(-1)[at] == pytest.approx((above - below) / 2e-6, abs=1e-5)


def test_attention_weighs_the_telling_passage():
    """One bad passage among good ones decides; it must get more than its share."""
    rng = np.random.default_rng(2)
    n, per = 300, 6
    x = rng.normal(0, 0.1, (n * per, quality.N_FEATURES)).astype(np.float32)
    x[:, -1] = 1
    of, label = np.repeat(np.arange(n), per), (np.arange(n) % 2).astype(float)
    bad = np.arange(n) * per + rng.integers(0, per, n)
    x[bad[label == 0], 5] = 2.0
    model = quality.train(x, of, label, quality.Training(rounds=200))
    assert ((model.score(*model.sums(x, of, n)) >= 0.5) == (label == 1)).mean() > 0.97
    share = np.exp(model.passages(x)[3])
    share /= np.bincount(of, share)[of]
    assert share[bad[label == 0]].mean() > 1.5 / per


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    rows = {r["doc_id"]: r for r in quality.quality(docs, labels).collect()}
    assert len(rows) == docs.count()
    known = {r["doc_id"]: r["quality"] for r in labels.collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in rows.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows.values())
    held = [rows[i]["predicted"] == q for i, q in known.items() if rows[i]["held_out"]]
    assert np.mean(held) > 0.95


def test_odd_documents(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(5, 1), (5, 0), (7, 1), (8, 0), (None, 1), (6, None), (3, 0), (2, 1)], "doc_id long, quality int")
    rows = quality.quality(odd_docs, labels).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.quality(no_docs, labels).isEmpty()
    none = quality.quality(odd_docs, labels.limit(0)).collect()
    assert {r["predicted"] for r in none} == {1}
    kept = quality.drop_low_quality(odd_docs, labels.limit(0))
    assert kept.columns == odd_docs.columns and sorted(map(str, kept.collect())) == sorted(map(str, odd_docs.collect()))
    assert quality.drop_low_quality(no_docs, labels).isEmpty()
