"""Token ids of whole texts, by a public vocabulary file whose path is a parameter.

Texts repeat their words, so a worker encodes each distinct word once and
joins the cached ids. Cutting at spaces and line feeds is safe for vocabularies
that drop white space between words: no normaliser rule and no pattern of
theirs reaches across one. Plain words (Latin letters, then ASCII punctuation)
are merged by ``tiktoken`` over the same merge ranks, which costs a quarter of
a call to ``tokenizers``; every other word goes to ``tokenizers`` itself.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Cached words of one worker (about 30 MB); beyond it the cache starts anew.
CACHE_WORDS = 150_000
#: Longer words are encoded each time they occur.
CACHE_CHARS = 40
#: Bytes of text taken from a batch at once.
CHUNK_BYTES = 1 << 20

#: Latin letters whose lower case is one letter, then ASCII signs other than the apostrophe, digits and spaces.
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]*)([!-&(-/:-@\[-`{-~]*)").fullmatch
#: Byte that no UTF-8 text holds; it stands for the end-of-word mark.
WORD_END = b"\xff"


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of byte-level vocabularies: visible Latin-1 signs for themselves, the rest from U+0100 on."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + at): b for at, b in enumerate(hidden)}


class WordIds(dict):
    """word -> ids as little-endian unsigned 32-bit bytes, filled as words turn up."""

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task slot is one core
        from tiktoken import Encoding
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        suffix = model["end_of_word_suffix"]
        if not suffix:
            raise ValueError("a vocabulary with an end-of-word mark is needed; others may merge across spaces")
        signs = byte_alphabet()
        ranks = {}
        for token, rank in model["vocab"].items():
            closed = token.endswith(suffix) and token != suffix
            body = bytes(signs[c] for c in (token[: -len(suffix)] if closed else token))
            ranks[body + WORD_END * closed] = rank
        self._merge = Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def __missing__(self, word: str) -> bytes:
        if (plain := PLAIN(word)) is not None:
            letters, signs = plain.groups()
            ids = self._merge(letters.lower().encode() + WORD_END) if letters else []
            if signs:
                ids = [*ids, *self._merge(signs.encode() + WORD_END)]
        else:
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        packed = np.array(ids, "<u4").tobytes()
        if len(word) <= CACHE_CHARS:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = packed
        return packed

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, equal to one call of the tokenizer on it."""
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """One cache per worker and vocabulary."""
    return WordIds(path)


def slices(lengths: list[int], most: int = CHUNK_BYTES) -> Iterator[slice]:
    """Runs of neighbouring items whose lengths sum to about ``most``."""
    begin, held = 0, 0
    for at, length in enumerate(lengths):
        held += length
        if held >= most:
            yield slice(begin, at + 1)
            begin, held = at + 1, 0
    if begin < len(lengths):
        yield slice(begin, len(lengths))


def encoded(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids with the end id) per row of (doc_id, text); a null text has the end id only."""
    words = word_ids(path)
    end = np.array([end_id], "<u4").tobytes()
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1)
        for part in slices([n or 0 for n in pc.binary_length(texts).to_pylist()]):
            for doc, text in zip(ids[part], texts[part.start : part.stop].to_pylist()):
                yield doc, np.frombuffer(words.encode(text or "") + end, "<u4")
