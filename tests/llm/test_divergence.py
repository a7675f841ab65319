"""The audit against a brute-force one."""

import random
import re
from collections import Counter, defaultdict

import numpy as np

from trustfold.llm import divergence
from trustfold.llm.divergence import Audit, skyband, source_audit

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def brute(rows, how=Audit()):
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in TERM.findall(text or "")]
        counts[lang, source].update(words)
        docs[lang].update(set(words))
    out = []
    for (lang, source), own in counts.items():
        kept = [t for t, n in docs[lang].items() if n >= how.least_docs]
        def numbers(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept}
        apart = lambda p, q: (p - q) ** 2 // (p + q)
        mine = numbers(own)
        pairs = []
        for (other_lang, other), c in counts.items():
            if other_lang == lang and other != source:
                theirs = numbers(c)
                pairs.append((-sum(apart(mine[t], theirs[t]) for t in kept), other.encode(), other))
        whole = numbers(sum((c for (x, _), c in counts.items() if x == lang), Counter()))
        terms = [(-apart(mine[t], whole[t]), t.encode(), t) for t in kept if own[t] > 0 and mine[t] > whole[t]]
        for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[: how.ranks])):
            out += [(lang, source, part, item, -value, rank + 1) for rank, (value, _, item) in enumerate(found)]
    return sorted(out)


def checked(spark, rows, how=Audit()):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "text string, lang string, source string, term string, n string")
    assert sorted(tuple(r) for r in source_audit(df, how).collect()) == brute(rows, how)


def texts(seed, n=200, sources=7):
    draw = random.Random(seed)
    vocabulary = ["".join(draw.choice("abcXYZéñ😀") for _ in range(draw.randint(1, 3))) for _ in range(150)]
    rows = []
    for _ in range(n):
        lang, source = draw.choice(["en", "en", "de", None]), draw.choice([f"s{k}" for k in range(sources)] + [None])
        words = draw.choices(vocabulary, weights=[1 / (1 + k) for k in range(150)], k=draw.randint(0, 60))
        rows.append((draw.choice([" ", "\n", "_", "12"]).join(words), lang, source))
    return rows + [(None, "en", "silent"), ("", "xx", "alone"), ("one two", "yy", "a"), ("one", "yy", "b"), rows[3], rows[3]]


def test_equals_brute_force(spark):
    checked(spark, texts(1))


def test_tiles_blocks_and_handed_on_counts(spark, monkeypatch):
    for name, value in (("BLOCK_TERMS", 16), ("TILE_SOURCES", 2), ("HELD_TERMS", 20), ("SKYBAND_CHUNK", 8)):
        monkeypatch.setattr(divergence, name, value)
    checked(spark, texts(2), Audit(3, 4))


def test_skyband_keeps_what_fewer_than_k_dominate():
    draw = np.random.default_rng(1)
    count, common, name = draw.integers(0, 9, 900), draw.integers(0, 9, 900), draw.permutation(900)
    above = ((count[:, None] >= count) & (common[:, None] <= common) & (name[:, None] < name)).sum(axis=0)
    assert set(skyband(count, common, name, 5)) == set(np.flatnonzero(above < 5))


def test_odd_rows_and_empty_tables(spark, odd_docs, no_docs):
    rows = [(r.text, r.lang, r.source) for r in odd_docs.select("text", "lang", "source").collect()]
    assert sorted(tuple(r) for r in source_audit(odd_docs).collect()) == brute(rows)
    assert source_audit(no_docs).count() == 0
