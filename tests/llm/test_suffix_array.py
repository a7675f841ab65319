"""Repeated strings against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from trustfold.llm import suffix_array
from trustfold.llm.suffix_array import Repeats, anchors_of, multikey_order, repeated_spans, without_repeats


def brute(texts, length):
    """Covered byte places of each text."""
    texts = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        covered = set()
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                covered.update(range(i, i + length))
        out.append(covered)
    return out


def checked(spark, rows, how, hot=1_000):
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, spans string")
    found = without_repeats(df, how, hot).collect()
    wanted = Counter()
    for (d, t), covered in zip(rows, brute([t for _, t in rows], how.length)):
        kept = bytes(b for i, b in enumerate((t or "").encode()) if i not in covered)
        runs = sum(1 for i in covered if i - 1 not in covered)
        wanted[(d, len((t or "").encode()), runs, hashlib.sha256(kept).hexdigest())] += 1
    got = Counter((r.doc_id, r.n_bytes, len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in found)
    assert got == wanted


def planted(seed, n=120):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdeéß😀") for _ in range(draw.randint(1, 7)))
    text = lambda k: " ".join(word() for _ in range(k))
    passages = [text(draw.randint(3, 30)) for _ in range(6)]
    rows = [(None, text(40)), (None, None), (1, ""), (2, "a" * 90), (3, "a" * 37), (4, "ab" * 60), (2, "a" * 90)]
    for d in range(n):
        body = text(draw.randint(0, 30))
        for _ in range(draw.randint(0, 3)):
            passage = draw.choice(passages)
            at = draw.randint(0, len(body))
            if draw.random() < 0.3 and len(passage) > 4:  # an edited copy
                k = draw.randrange(len(passage))
                passage = passage[:k] + "Q" + passage[k + 1 :]
            body = body[:at] + passage + body[at:]
        rows.append((10 + d, body))
    rows += [(900 + k, rows[20][1]) for k in range(9)]
    return rows


@pytest.mark.parametrize("hot", [1_000, 2])
def test_equals_brute_force(spark, hot):
    checked(spark, planted(1), Repeats(40, 12), hot)


def test_boundaries_between_buckets(spark, monkeypatch):
    """Many equal windows over more buckets than there are kinds of them."""
    rows = [(k, f"{k:04d}" + "the very same passage stands here, again and again and again" + f"{k * 7:05d}") for k in range(60)]
    checked(spark, rows, Repeats(24, 8), 2)


def test_chunks_of_long_texts(spark, monkeypatch):
    how = Repeats(40, 12)
    text = bytes(random.Random(3).choices(b"abc ", k=5_000))
    whole = anchors_of(text, how)
    monkeypatch.setattr(suffix_array, "CHUNK_BYTES", 512)
    suffix_array._powers.clear()
    for a, b in zip(whole, anchors_of(text, how)):
        assert np.array_equal(a, b)
    suffix_array._powers.clear()


def test_every_window_has_one_anchor():
    how = Repeats(40, 12)
    text = bytes(random.Random(4).choices(b"ab", k=700))
    _, place, first, last = anchors_of(text, how)
    assert first[0] == 0 and last[-1] == len(text) - 40 and (first[1:] == last[:-1] + 1).all()
    assert (place >= last).all() and (place - first <= how.reach).all()


def test_multikey_order_is_the_sorted_order():
    draw = np.random.default_rng(5)
    words = draw.integers(0, 3, (400, 6)).astype(np.uint64)
    groups = draw.integers(0, 4, 400)
    order, agree = multikey_order(groups, lambda k, items: words[items, k], 6)
    rows = [(groups[i], *words[i]) for i in order]
    assert rows == sorted(rows)
    for k in range(1, 400):
        same = 0
        while same < 6 and rows[k][: same + 2] == rows[k - 1][: same + 2]:
            same += 1
        assert agree[k] == (same if rows[k][0] == rows[k - 1][0] else -1)


def test_odd_rows_and_empty_tables(spark, odd_docs, no_docs):
    found = without_repeats(odd_docs)
    assert found.count() == odd_docs.count()
    removed = {r.doc_id: len(r.spans) for r in found.filter("doc_id in (7, 8)").collect()}
    assert removed[8] == 1  # 50,000 times the same sign
    assert without_repeats(no_docs).count() == 0 and repeated_spans(no_docs).count() == 0


def test_wrong_settings():
    with pytest.raises(ValueError):
        Repeats(200, 201)
