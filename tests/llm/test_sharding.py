"""Hilbert order, equal shards, pruning."""

import itertools
import zlib

import numpy as np
import pytest

from trustfold.llm import sharding


@pytest.mark.parametrize("dims, bits", [(1, 4), (2, 4), (3, 3), (4, 2)])
def test_the_curve_visits_every_cell_in_single_steps(dims, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    index = sharding.hilbert_index(cells, bits)
    assert sorted(index) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(index)], axis=0)).sum(1) == 1).all()


def test_equal_shards_and_narrow_ranges(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    placed = sharding.hilbert_shards(docs)
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    slots, spans = {}, []
    for r in placed.collect():
        assert (r["size"], r["text_crc32"]) == (len(texts[r["doc_id"]]) + 8, zlib.crc32(texts[r["doc_id"]]))
        slots.setdefault(r["shard"], []).append(r["slot"])
    counts = [len(s) for s in slots.values()]
    assert sorted(slots) == list(range(24)) and max(counts) - min(counts) <= 1 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    for r in sharding.shard_ranges(placed, ["doc_id"]).collect():
        spans.append(r["doc_id_max"] - r["doc_id_min"])
    assert np.mean(spans) < 700  # of 1,000; shards by any one other column span nearly all


def test_odd_documents(spark, odd_docs, no_docs, tmp_path):
    rows = sharding.hilbert_shards(odd_docs, 5).collect()
    assert len(rows) == odd_docs.count() and {r["shard"] for r in rows} == set(range(5))
    assert sharding.hilbert_shards(no_docs).isEmpty()
    few = sharding.hilbert_shards(odd_docs.limit(3), 24).collect()
    assert len({r["shard"] for r in few}) == 3 and {r["slot"] for r in few} == {0}
    plain = odd_docs.select("doc_id", "text", "lang", "source", "n_chars")
    sharding.write_shards(plain, sharding.hilbert_shards(plain, 5), str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == plain.count() and set(plain.columns) < set(back.columns)
