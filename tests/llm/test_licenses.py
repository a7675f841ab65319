"""License scans: planted, edited and absent notices."""

import random

import pytest

from trustfold.llm import licenses
from trustfold.llm.license_texts import SHORT_NOTICES, TEMPLATES


@pytest.fixture(scope="module")
def templates(spark):
    return spark.createDataFrame(TEMPLATES, "template_id string, license string, text string")


def test_planted_templates_are_found(spark, templates):
    rng = random.Random(3)
    noise = lambda n: " ".join(f"noise{rng.randrange(10**6)}" for _ in range(n))
    rows, want = [], {}
    for copy in range(6):
        for name, _, text in TEMPLATES:
            words = text.split()
            for kind in ("exact", "edited", "half"):
                body = list(words)
                if kind == "edited" and len(words) > 60:  # one changed word spoils five shingles
                    for at in rng.sample(range(len(words)), max(1, len(words) // 50)):
                        body[at] = "changed"
                if kind == "half":
                    body = body[: len(body) // 2]
                doc = len(rows)
                rows.append((doc, noise(rng.randrange(50)) + " " + " ".join(body).upper() + " " + noise(rng.randrange(300))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {name: licenses_shingles(text) for name, _, text in TEMPLATES}
    for doc, text in rows:
        mine = licenses_shingles(text)
        want[doc] = sorted(n for n, s in sets.items() if len(s & mine) / len(s) >= 0.8)
    got = {r["doc_id"]: [m["template_id"] for m in r["matches"]] for r in licenses.scan(docs, templates).collect()}
    assert got == want and sum(map(len, want.values())) > 100


def licenses_shingles(text):
    import re

    words = [w.lower() for w in re.split(r"[^0-9A-Za-z\x80-\U0010ffff]+", text) if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_odd_documents(spark, odd_docs, no_docs, templates):
    rows = licenses.scan(odd_docs, templates).collect()
    assert len(rows) == odd_docs.count() and not any(r["matches"] for r in rows)
    assert licenses.scan(no_docs, templates).isEmpty()
    assert licenses.scan(odd_docs, templates.limit(0)).count() == odd_docs.count()
    few = spark.createDataFrame([("t", "L", "one"), ("e", "L", ""), ("n", "L", None)], "template_id string, license string, text string")
    found = {r["doc_id"]: r["matches"] for r in licenses.scan(odd_docs, few).collect()}
    assert [m["template_id"] for m in found[4]] == ["t"] and sum(map(bool, found.values())) == 1


def test_short_templates_are_found_inside_longer_texts(spark, sf_dir):
    few = [*SHORT_NOTICES, ("two", "L", "see LICENSE"), ("four", "L", "Some rights are reserved")]
    docs = spark.createDataFrame([
        (1, "A text of its own and more. ALL RIGHTS reserved! And then some."), (2, "all rights reserved"), (3, "All the rights reserved."),
        (4, "some rights are reserved here; see license"), (5, "rights reserved all"), (6, "x" * 40 + " see licenses"),
    ], "doc_id long, text string")
    got = {r["doc_id"]: [m["template_id"] for m in r["matches"]] for r in licenses.scan(docs, spark.createDataFrame(few, "template_id string, license string, text string")).collect()}
    assert got == {1: ["all-rights-notice"], 2: ["all-rights-notice"], 3: [], 4: ["four", "two"], 5: [], 6: []}
    given = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = given.filter("lower(text) rlike '(^|[^0-9a-z\\\\x{80}-\\\\x{10ffff}])all[\\\\s]+rights[\\\\s]+reserved([^0-9a-z\\\\x{80}-\\\\x{10ffff}]|$)'").count()
    every = spark.createDataFrame([*TEMPLATES, *SHORT_NOTICES], "template_id string, license string, text string")
    found = licenses.scan(given, every).filter("exists(matches, m -> m.template_id = 'all-rights-notice')").count()
    assert found == want


def test_edited_whole_texts_are_found(spark, templates):
    rng, long = random.Random(5), [t for t in TEMPLATES if t[0].endswith("-text") and len(t[2]) > 5000]
    rows = []
    for at, (_, _, text) in enumerate(long):
        body = text.split()
        for place in rng.sample(range(len(body)), len(body) // 60):
            body[place] = "changed"
        rows.append((at, " ".join(f"word{rng.randrange(10**6)}" for _ in range(200)) + " " + " ".join(body)))
    got = {r["doc_id"]: {m["template_id"] for m in r["matches"]} for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), templates).collect()}
    assert len(long) == 7 and all(name in got[at] for at, (name, _, _) in enumerate(long))
