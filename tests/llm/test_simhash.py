"""Golay keys, links, components, and what is kept."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from trustfold.llm import golay, simhash
from trustfold.llm.components import connected


def test_the_code_is_perfect():
    assert set(np.bincount(golay.key(np.arange(1 << 23)))) == {2048}


def test_neighbours_share_a_key():
    rng = np.random.default_rng(3)
    words = rng.integers(0, 1 << 23, 5000)
    fuzzy = golay.fuzzy_keys(words)
    assert (fuzzy >= 0).sum(1).max() == 6
    for other in (words, words ^ (1 << rng.integers(0, 23, 5000))):
        assert all(k in row for k, row in zip(golay.key(other), fuzzy))


def _plain(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_bit_by_bit():
    for text in (None, "", " \t", "One", "a b", "A b C d É é e", "the same " * 300, " ".join(map(str, range(500)))):
        assert simhash.text_fingerprint(text) & (1 << 64) - 1 == _plain(text)


def _classes(values, most):
    above = {v: v for v in values}

    def top(v):
        while above[v] != v:
            v = above[v]
        return v

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if (a ^ b).bit_count() <= most:
                above[max(top(a), top(b))] = min(top(a), top(b))
    return {v: top(v) for v in values}


@pytest.fixture(scope="module")
def near(spark):
    """Random fingerprints, chains of near ones, and a dense cloud of many within few bits."""
    rng = np.random.default_rng(5)
    values = set(rng.integers(0, 1 << 63, 300).tolist())
    for base in list(values)[:60]:
        for _ in range(4):
            for bit in rng.choice(63, rng.integers(1, 5), replace=False):
                base ^= 1 << int(bit)
            values.add(base)
    centre = int(rng.integers(0, 1 << 62))
    for _ in range(400):
        values.add(centre ^ sum(1 << int(b) for b in rng.choice(14, rng.integers(0, 5), replace=False)))
    return sorted(values)


@pytest.mark.parametrize("most, hot_key", [(3, 256), (3, 3), (3, 0), (2, 256), (0, 256)])
def test_links_connect_what_all_pairs_connect(spark, near, most, hot_key):
    prints = spark.createDataFrame([(v,) for v in near], "fp long")
    found = simhash.links(prints, most, hot_key, block=50)
    assert found.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) > most).isEmpty()
    roots = {r["node"]: r["root"] for r in connected(found).collect()}
    want = _classes(near, most)
    members = {}
    for v, r in want.items():
        members.setdefault(r, []).append(v)
    assert roots == {v: r for v, r in want.items() if len(members[r]) > 1}


def test_components_of_long_chains_and_hubs(spark):
    pairs = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 400)] + [(5000, 5000), (None, 3), (7001, 7000)]
    roots = {r["node"]: r["root"] for r in connected(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert roots == {**{i: 0 for i in range(301)}, **{1000 + i: 1000 for i in range(400)}, 7000: 7000, 7001: 7000}
    assert connected(spark.createDataFrame([], "a long, b long")).isEmpty()


def test_odd_documents(odd_docs, no_docs):
    rows = simhash.near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count() and simhash.near_duplicates(no_docs).isEmpty()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], set()).add((r["fp"], r["component_id"]))
    assert by[1] == by[2] == by[3] == {(0, 1)} and {c for _, c in by[5] | by[6]} == {5}
    kept = simhash.drop_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns and simhash.drop_near_duplicates(no_docs).isEmpty()
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(i) for i in (None, 1, 4, 5, 7, 8, -9, 2**62))


def test_one_of_each_group_stays(spark):
    base = " ".join(f"word{i}" for i in range(400))
    rows = [(10, base), (3, base), (7, base.replace("word200", "other")), (3, base), (20, "something else altogether here")]
    kept = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    near = (simhash.text_fingerprint(rows[0][1]) ^ simhash.text_fingerprint(rows[2][1]) & (1 << 64) - 1)
    want = [3, 20] if (near & (1 << 64) - 1).bit_count() <= 3 else [3, 7, 20]
    assert sorted(r["doc_id"] for r in kept) == sorted(want)
