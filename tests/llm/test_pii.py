"""Personal data: base spans by brute force, votes, added spans, redaction."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from trustfold.llm import pii, queries

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _luhn(digits):
    return sum(2 * int(c) - 9 * (int(c) > 4) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10 == 0


def _valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    return {
        "email": True, "ip": all(int(p) <= 255 for p in value.split(".")) if kind == "ip" else False,
        "card": 13 <= len(digits) <= 19 and kind == "card" and _luhn(digits), "phone": 9 <= len(digits) <= 15,
    }[kind]


def _spans(text):
    return [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text or "", re.A) if _valid(k, m[0])]


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    odd = [
        (9001, "a@b.c_d@e.f x@y 1.2.3.4.5 256.1.1.1 001.02.3.4 é@é.é mail a@é a@b..c a@b.c.d. "),
        (9002, "4111 1111 1111 1111 and 4111-1111-1111-1112 4111 1111 1111 1111 5 +1 4111 1111 1111 1111 "),
        (9003, "+12 (34) 567-890- x +1 2 3 +123456789012345 +1234567890123456 ++49 30 123456 é😀+49 30 1234567"),
        (9004, " ".join(f"u{i}@x{i}.com" for i in range(1500))), (9005, "9" * 20_000), (9006, "a" * 5000 + "@" + "b." * 500 + "c"),
        (9007, None), (9008, ""), (None, "ssn 123-45-6789 token = \"97ffa88d7c5f5655e365004e29bd123cdabd722a\""),
    ]
    table = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return table.union(spark.createDataFrame(odd, "doc_id long, text string"))


def test_base_spans_equal_brute_force(spark, docs, monkeypatch):
    monkeypatch.setattr(queries, "table", lambda *_: docs)
    want = {r["doc_id"]: _spans(r["text"]) for r in docs.collect()}
    rows = queries.op3_weak_supervision_pii(spark, "").collect()
    assert len(rows) == len(want)
    for r in rows:
        spans = want[r["doc_id"]]
        assert [r[f"n_{k}"] for k in PLAIN] == [sum(s[0] == k for s in spans) for k in PLAIN]
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
        listed = [tuple(s.split(":")) for s in r["spans"].split(",") if s]
        assert [s for s in listed if s[0] in PLAIN] == [(k, str(a), str(b)) for k, a, b in spans]
    assert {s.split(":")[0] for r in rows if r["doc_id"] is None for s in r["spans"].split(",")} == {"secret", "national_id"}


def test_unreliable_labelers_are_found(spark):
    """Candidates that all labelers but one call false are not taken, though one says yes."""
    good, bad = "1111", "0010"
    rows = [(k, v) for k, v, n in (("secret", good, 60), ("secret", bad, 60), ("national_id", "1211", 20), ("secret", "0000", 30)) for _ in range(n)]
    found = spark.createDataFrame(rows, "kind string, votes string").select(F.array(F.struct(
        F.col("kind"), F.lit(0).alias("start"), F.lit(9).alias("end"), F.lit(False).alias("base"), "votes", F.lit(False).alias("longer"))).alias("candidates"))
    weights, learnt = pii.fit(found)
    kept = found.select("candidates", F.size(pii.accepted(F.col("candidates"), weights)).alias("n")).collect()
    assert {(r["candidates"][0]["votes"], r["n"]) for r in kept} == {(good, 1), ("1211", 1), (bad, 0), ("0000", 0)}
    assert learnt["yes"][0] > 0.9 and learnt["no"][0] < 0.1


def test_redaction(spark, odd_docs, no_docs):
    rows = [(1, "write to a.b@c.de or +49 30 1234567, host 10.0.0.1.", 49), (2, "nothing here", 12), (3, None, None)]
    found = {r["doc_id"]: r for r in pii.redact(spark.createDataFrame(rows, "doc_id long, text string, n_chars long")).collect()}
    assert found[1]["text"] == "write to [EMAIL] or [PHONE], host [IP]." and found[1]["n_chars"] == len(found[1]["text"])
    assert (found[2]["text"], found[3]["text"]) == ("nothing here", None)
    same = pii.redact(odd_docs)
    assert same.columns == odd_docs.columns and pii.redact(no_docs).isEmpty()
    assert sorted(map(str, same.collect())) == sorted(map(str, odd_docs.collect()))
    assert pii.find_spans(odd_docs).count() == odd_docs.count() and pii.find_spans(no_docs).isEmpty()


def test_running_folds_and_pieces(spark):
    import random

    from trustfold.llm.columns import between, count_below, pieces_of, running

    draw = random.Random(1)
    rows = [([draw.randint(0, 9) for _ in range(n)],) for n in (0, 1, 127, 128, 129, 1000)]
    df = spark.createDataFrame(rows, "v array<int>")
    sums = df.select("v", running(F.col("v"), lambda a, b: a + b).alias("s")).collect()
    assert all(r["s"] == [sum(r["v"][: k + 1]) for k in range(len(r["v"]))] for r in sums)
    ordered = df.select(F.sort_array("v").alias("v")).select("v", count_below(F.col("v"), F.lit(4)).alias("n")).collect()
    assert all(r["n"] == sum(x < 4 for x in r["v"]) for r in ordered)
    text = "".join(draw.choice("aé😀\n ") for _ in range(5000))
    cuts = [(0, 0), (0, 5), (1020, 1030), (1023, 1024), (1024, 3000), (4990, 5000), (5000, 5001), (7, 3)]
    cut = spark.createDataFrame([(text, a, b) for a, b in cuts], "t string, a int, b int")
    for r in cut.select("a", "b", between(pieces_of(F.col("t")), F.col("a"), F.col("b")).alias("x")).collect():
        assert r["x"] == text[r["a"] : max(r["a"], r["b"])]


def test_texts_with_very_many_spans(spark, monkeypatch):
    """20,000 mails, numbers and tokens in one text: linear work, and the same spans as brute force."""
    import time

    token = "97ffa88d7c5f5655e365004e29bd123cdabd722a"
    text = " ".join(f"é u{i}@x{i}.com token {token} +49 30 1234567, " for i in range(20_000))
    docs = spark.createDataFrame([(1, text), (2, "a quiet text")], "doc_id long, text string")
    monkeypatch.setattr(queries, "table", lambda *_: docs)
    begun = time.perf_counter()
    row = queries.op3_weak_supervision_pii(spark, "").filter("doc_id = 1").first()
    spans = _spans(text)
    assert row["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
    assert row["n_secret"] == 20_000
    clean = pii.redact(docs).filter("doc_id = 1").first()["text"]
    assert clean.count("[PHONE]") == clean.count("[SECRET]") == 20_000 and token not in clean and "@" not in clean
    assert time.perf_counter() - begun < 120


def test_recall_of_planted_secrets(spark, sf_dir):
    """Tokens planted in the given texts are found, nearly all."""
    planted = re.compile(r'token = "([0-9a-f]{40})"')
    rows = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet").select("doc_id", "text")
    spans = {r["doc_id"]: {(s["start"], s["end"]) for s in r["spans"]} for r in pii.find_spans(rows).collect()}
    want = [(r["doc_id"], m.span(1)) for r in rows.collect() for m in planted.finditer(r["text"] or "")]
    assert want and sum(at in spans[d] for d, at in want) >= 0.9 * len(want)
