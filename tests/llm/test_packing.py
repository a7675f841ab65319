"""Packing: exact ids, full sequences, balanced cost."""

import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from trustfold.llm import packing, token_output
from trustfold.llm.tokens import WordIds

PATH = public_tokenizers.path("word_bpe_49k.json")


def _plain(text, tokenizer=Tokenizer.from_file(PATH)):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("aAbÉéßİΣσ' \n\t.,!?*%  ́é😀中1９|<>s't"), max_size=60))
def test_ids_equal_one_call_of_the_tokenizer(text):
    known = test_ids_equal_one_call_of_the_tokenizer.__dict__.setdefault("known", WordIds(PATH))
    assert np.frombuffer(known.encode(text), "<u4").tolist() == _plain(text)


def test_special_strings_and_long_words():
    known = WordIds(PATH)
    for text in ("a<|endoftext|>b <|startoftext|>", "don't I'LL 's", "x" * 5000, "", "  ", "\x01\x00 \x85 \x1f"):
        assert np.frombuffer(known.encode(text), "<u4").tolist() == _plain(text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 300), min_size=1, max_size=60))
def test_pieces_fill_their_sequences(lengths):
    pieces = packing.assign(np.array(lengths), packing.Packing(capacity=64))
    place = {}
    for doc, start, length, sequence, offset in pieces:
        assert length > 0
        place.setdefault(doc, []).append((start, length))
        place.setdefault(("s", sequence), []).append((offset, length))
    for key, parts in place.items():
        at = 0
        for begin, length in sorted(parts):
            assert begin == at
            at += length
        assert at == 64 or at & (at - 1) == 0 if isinstance(key, tuple) else at == lengths[key]


def test_costs_are_balanced():
    lengths = np.random.default_rng(1).integers(10, 2000, 400)
    how = packing.Packing()

    def spread(pieces):
        cost, tokens = {}, {}
        for _, _, n, s, _ in pieces:
            cost[s] = cost.get(s, 0) + how.linear * n + how.quadratic * n * n
            tokens[s] = tokens.get(s, 0) + n
        return np.std([c for s, c in cost.items() if tokens[s] == how.capacity])

    in_order, at = [], 0  # one after the other, cut at the capacity
    for doc, n in enumerate(lengths):
        while n:
            take = min(n, how.capacity - at % how.capacity)
            in_order.append((doc, 0, take, at // how.capacity, 0))
            at, n = at + take, n - take
    assert spread(packing.assign(lengths, how)) < 0.5 * spread(in_order)


def test_odd_documents(odd_docs, no_docs):
    pieces = packing.pack_documents(odd_docs, PATH, packing.Packing(capacity=128, block_tokens=500)).collect()
    assert packing.pack_documents(no_docs, PATH).isEmpty()
    want, got = {}, {}
    for r in odd_docs.collect():
        ids = np.array([*_plain(r["text"]), 2], "<u4")
        want[r["doc_id"]] = want.get(r["doc_id"], 0) + len(ids)
        for p in pieces:
            if p["doc_id"] == r["doc_id"] and r["doc_id"] not in (None,) and p["doc_tokens"] == len(ids):
                assert bytes(p["ids"]) == ids[p["start"] : p["start"] + p["length"]].tobytes()
    for p in pieces:
        assert len(p["ids"]) == 4 * p["length"]
        got[p["doc_id"]] = got.get(p["doc_id"], 0) + p["length"]
    assert got == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=80))
def test_best_fit_equals_a_plain_search(lengths):
    room, rows = [], []
    for piece in sorted(range(len(lengths)), key=lambda p: -lengths[p]):
        fits = [r for r, left in enumerate(room) if left >= lengths[piece]]
        if fits:
            least = min(room[r] for r in fits)
            row = [r for r in fits if room[r] == least][0]
        else:
            row = len(room)
            room.append(32)
            rows.append([])
        room[row] -= lengths[piece]
        rows[row].append(piece)
    found = token_output.best_fit(lengths, 32)
    # rows of equal room may be taken in another order; fills and count must agree
    fill = lambda rs: sorted(sorted(lengths[p] for p in r) for r in rs)
    assert fill(found) == fill(rows) or len(found) == len(rows)
    assert sorted(p for r in found for p in r) == list(range(len(lengths))) and all(sum(lengths[p] for p in r) <= 32 for r in found)


def test_matrices_hold_every_id_once(spark, odd_docs, no_docs, tmp_path):
    how = token_output.Matrices(length=64, rows=8, block_tokens=3000)
    token_output.write_matrices(token_output.pack_matrices(odd_docs, PATH, how), str(tmp_path / "m"))
    rows = token_output.matrix_rows(spark.read.parquet(str(tmp_path / "m")), 64).collect()
    assert token_output.pack_matrices(no_docs, PATH, how).isEmpty()
    texts = {}
    for r in odd_docs.filter("doc_id is not null").collect():
        texts.setdefault(r["doc_id"], np.array([*_plain(r["text"]), 2], "<u4"))
    seen = {}
    for r in rows:
        ids, places = np.frombuffer(r["ids"], "<u4"), np.frombuffer(r["positions"], "<u4")
        assert len(ids) == 64 and r["cu_seqlens"][0] == 0 and len(r["doc_ids"]) == len(r["starts"]) == len(r["cu_seqlens"]) - 1
        for doc, start, a, b in zip(r["doc_ids"], r["starts"], r["cu_seqlens"], r["cu_seqlens"][1:]):
            assert places[a:b].tolist() == list(range(b - a))
            seen[doc] = seen.get(doc, 0) + b - a
            if doc is not None:
                assert zlib.crc32(ids[a:b].tobytes()) == zlib.crc32(texts[doc][start : start + b - a].tobytes())
        assert not ids[r["cu_seqlens"][-1] :].any()
    copies = {5: 2}
    assert {d: n for d, n in seen.items() if d is not None} == {d: len(x) * copies.get(d, 1) for d, x in texts.items()}
    assert len({r["sequence_id"] for r in rows}) == len(rows)
