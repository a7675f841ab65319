"""The pipeline's stages against what each should decide on its own input."""

import re

import corpus_pipeline
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from trustfold.functions.storage import durable
from trustfold.llm import decontamination, quality, simhash


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, tables = docs.columns, [docs]
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "SimHash near-dedup", "benchmark decontamination", "personal data", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        tables.append(durable(stage(spark, tables[-1], sf_dir), name.replace(" ", "-")))
        assert name == "packing" or tables[-1].columns == columns
    raw, good, single, clean, private, pieces = (t.collect() for t in tables)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    ids = lambda rows: sorted(r["doc_id"] for r in rows)

    assert ids(good) == sorted(r["doc_id"] for r in quality.quality(docs, labels).collect() if r["predicted"])
    known = {r["doc_id"]: r["quality"] for r in labels.collect()}
    wrong = [d for d, q in known.items() if (d in ids(good)) != bool(q)]
    assert len(wrong) <= 0.05 * len(known)
    prints = sorted((r["doc_id"], simhash.text_fingerprint(r["text"])) for r in good)
    group = {d: d for d, _ in prints}

    def top(d):
        while group[d] != d:
            d = group[d]
        return d

    for at, (a, p) in enumerate(prints):
        for b, q in prints[at + 1 :]:
            if ((p ^ q) & (1 << 64) - 1).bit_count() <= 3:
                group[max(top(a), top(b))] = min(top(a), top(b))
    assert ids(single) == sorted({top(d) for d, _ in prints})
    verdicts = {r["doc_id"]: r["contaminated"] for r in decontamination.contamination(tables[2], bench).collect()}
    assert ids(clean) == sorted(d for d, bad in verdicts.items() if not bad) and any(verdicts.values())
    assert ids(private) == ids(clean)
    assert not any(re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r["text"] or "") for r in private)
    before = {r["doc_id"]: r["text"] for r in clean}
    assert all(r["n_chars"] == len(r["text"]) for r in private if r["text"] != before[r["doc_id"]])
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    by_doc = {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append((p["start"], bytes(p["ids"])))
    assert sorted(by_doc) == ids(private)
    for r in private:
        held = np.frombuffer(b"".join(x for _, x in sorted(by_doc[r["doc_id"]])), "<u4").tolist()
        assert held == [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 2]


def test_empty_table(spark, sf_dir, no_docs):
    docs = no_docs
    for _, stage in corpus_pipeline.STAGES:
        docs = durable(stage(spark, docs, sf_dir), "empty")
        assert docs.isEmpty()


def test_run_starts_from_the_documents(spark, sf_dir):
    found = corpus_pipeline.run(spark, sf_dir)
    assert found.count() > 0 and {"doc_id", "sequence_id", "ids"} <= set(found.columns)
