"""Benchmark windows: hits, shares, several sets, spans, odd rows."""

import random
import re

import pytest

from trustfold.llm import decontamination


def _words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def _plain(docs, bench):
    grams = {}
    for item, text in bench:
        w = _words(text)
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            grams.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w, hit, items = _words(text), set(), set()
        for n in {len(g) for g in grams}:
            for i in range(len(w) - n + 1):
                found = grams.get(tuple(w[i : i + n]))
                if found:
                    hit |= set(range(i, i + n))
                    items |= found
        out.append((doc, len(w), len(hit), sorted(items), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


@pytest.fixture(scope="module")
def case(spark):
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choice(["alpha", "Beta", "É", "é", "g4mma", "ΔΣ", "δς", "x"]) + rng.choice(["", ",", " -", "!"]) for _ in range(n))
    bench = [(i, text(rng.choice([2, 3, 13, 14, 30]))) for i in range(12)] + [(90, None), (91, " .. "), (92, "É one"), (12, "ΑΣ.Β word")]
    docs = []
    for doc in range(60):
        item = rng.choice(bench[:12])[1]
        noise = " ".join(f"N{rng.randrange(10**6)}" for _ in range(rng.choice([0, 5, 2000])))
        parts = [noise, text(rng.randrange(0, 9)), rng.choice([item, item.upper(), item.replace("é", "É"), ""]), text(rng.randrange(0, 9))]
        docs.append((doc, "\n".join(parts)))
    docs += [(70, "é one"), (71, "É ONE"), (72, None), (73, ""), (5, docs[5][1]), (74, "ασ β word ΑΣ!Β Word")]
    return docs, bench, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")


@pytest.mark.parametrize("set_grams", [100_000, 7])
def test_equals_brute_force(case, set_grams):
    docs, bench, df, items = case
    got = [(r["doc_id"], r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in decontamination.contamination(df, items, set_grams=set_grams).collect()]
    want = _plain(docs, bench)
    assert sorted(got) == want and any(r[4] for r in want) and any(r[2] and not r[4] for r in want)


def test_documents_or_spans_go(case):
    docs, bench, df, items = case
    clean = sorted(r[0] for r in _plain(docs, bench) if not r[4])
    assert sorted(r["doc_id"] for r in decontamination.drop_contaminated(df, items).collect()) == clean
    cut = {r["doc_id"]: r["text"] for r in decontamination.cut_spans(df, items).collect()}
    hit = {r[0]: r[2] for r in _plain(docs, bench)}
    for doc, text in docs:
        assert cut[doc] == text if not hit[doc] else len(_words(cut[doc])) == len(_words(text)) - hit[doc]


def test_odd_documents(spark, odd_docs, no_docs, case):
    items = case[3]
    rows = decontamination.contamination(odd_docs, items).collect()
    assert len(rows) == odd_docs.count() and not any(r["contaminated"] for r in rows)
    assert decontamination.contamination(no_docs, items).isEmpty()
    assert decontamination.contamination(odd_docs, items.limit(0)).count() == odd_docs.count()
    for kept in (decontamination.drop_contaminated(odd_docs, items), decontamination.cut_spans(odd_docs, items)):
        assert kept.columns == odd_docs.columns and sorted(map(str, kept.collect())) == sorted(map(str, odd_docs.collect()))
    named = items.withColumnRenamed("item_id", "other").selectExpr("CAST(NULL AS LONG) AS item_id", "text", "other AS hash")
    assert decontamination.contamination(odd_docs, named).count() == odd_docs.count()
