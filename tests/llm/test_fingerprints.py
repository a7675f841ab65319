"""Fingerprints against a plain version of the same method, and against true likeness."""

import hashlib
import re
import struct

import pytest
from xxhash import xxh64_intdigest

from trustfold.llm import fingerprints

MASK = (1 << 64) - 1


def _hash(*values, kinds):
    seed = 42
    for v, kind in zip(values, kinds):
        seed = xxh64_intdigest(v if kind == "s" else struct.pack("<q" if kind == "l" else "<i", v), seed)
    return seed - (1 << 64) if seed >> 63 else seed


def _shingles(text):
    words = [_hash(w.encode(), kinds="s") for w in re.split("[\x00-\x20]+", text) if w]
    if not words:
        return []
    return [_hash(*run, kinds="l" * len(run)) for run in ([words[i : i + 5] for i in range(len(words) - 4)] or [words])]


def _plain(text):
    hashes = _shingles(text)
    if not hashes:
        return ""
    least = [None] * 256
    for h in sorted(hashes):
        if least[(h >> 56) + 128] is None:
            least[(h >> 56) + 128] = h
    filled = [v for v in least if v is not None]
    out = []
    for i, v in enumerate(least):
        for k in range(6):
            if v is None:
                v = least[_hash(i, k, kinds="ii") & 255]
        if v is None:
            v = filled[min((_hash(i, f >> 56, kinds="il") & -256) | p for p, f in enumerate(filled)) & 255]
        out.append("%x" % (_hash(v, i, kinds="li") & 15))
    return "".join(out)


def _jaccard(a, b):
    a, b = set(_shingles(a)), set(_shingles(b))
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize("rows", [37, 1000])
def test_report_equals_a_plain_version(spark, sf_dir, rows):
    extra = [(5000, None), (5001, ""), (5002, "one"), (5003, "a b c d e f"), (5003, "a b c d e f"), (-7, "x y 😀z w v é q")]
    table = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs = table.union(spark.createDataFrame(extra, "doc_id long, text string")).repartition(3)
    plain = sorted((r["doc_id"], r["text"] or "") for r in docs.collect())
    got = sorted(fingerprints.fingerprint_report(docs, rows).collect(), key=lambda r: r["doc_id"])
    assert len(got) == len(plain)
    errors = []
    for at, (r, (doc, text)) in enumerate(zip(got, plain)):
        following = plain[(at + 1) % len(plain)][1]
        quarter = len(text) // 4
        edited = text[: len(text) - quarter] + following[:quarter]
        assert (r["doc_id"], r["n_chars"], r["edited_sha256"]) == (doc, len(text), hashlib.sha256(edited.encode()).hexdigest())
        if at % 5 == 0 or len(text) < 60:
            assert (r["fingerprint"], r["edited_fingerprint"]) == (_plain(text), _plain(edited))
        errors += [r["near_edited"] - _jaccard(text, edited), r["near_next"] - _jaccard(text, following)]
    assert max(map(abs, errors)) < 0.15 and abs(sum(errors) / len(errors)) < 0.01


def test_odd_documents(odd_docs, no_docs, spark):
    rows = fingerprints.fingerprint_report(odd_docs, 3).collect()
    assert len(rows) == odd_docs.count() and fingerprints.fingerprint_report(no_docs).isEmpty()
    by = {r["n_chars"]: r for r in rows}
    assert by[0]["fingerprint"] == "" and by[0]["near_edited"] == 1.0
    alone = fingerprints.fingerprint_report(spark.createDataFrame([(1, "abcd efgh")], "doc_id long, text string")).collect()
    assert alone[0]["edited_sha256"] == hashlib.sha256(b"abcd efab").hexdigest() and alone[0]["near_next"] == 1.0
