"""Cost-balanced packing of documents into sequences of one length.

The cost of a piece of n tokens in a sequence is ``linear * n + quadratic * n^2``
(feed-forward work and attention inside the document). Documents go in
descending order of cost to the sequence of lowest cost that still has room;
where none has room for a whole one, the cheapest open sequence is filled and
the rest of the document goes on in the next.

Documents are packed within blocks of a fixed number of tokens of one Spark
partition, so no row is shuffled and a task holds one block. A block's
sequences take exactly its tokens: all are full but a last handful whose
lengths are powers of two, which need no padding either.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustfold.llm.tokens import encoded

#: Tokens a task packs at once (16 MB of ids, about 1,000 sequences of 4,096).
BLOCK_TOKENS = 1 << 22

PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


@dataclass(frozen=True)
class Packing:
    """Sequence length, cost of a token and of a pair of tokens, and the id that ends a document."""

    capacity: int = 4096
    linear: float = 1.0
    quadratic: float = 1.0 / 4096
    end_id: int = 2
    block_tokens: int = BLOCK_TOKENS


def room(tokens: int, capacity: int) -> np.ndarray:
    """Lengths of the sequences that hold exactly ``tokens``: full ones, then falling powers of two."""
    full, rest = divmod(tokens, capacity)
    powers = [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
    return np.array([capacity] * full + powers, np.int64)


def assign(lengths: np.ndarray, how: Packing) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece of documents of ``lengths`` tokens.

    Whole multiples of the capacity fill sequences of their own. Ties in cost
    go to the earlier document and to the earlier sequence.
    """
    pieces, used = [], 0
    for doc in np.flatnonzero(lengths >= how.capacity):
        for part in range(int(lengths[doc]) // how.capacity):
            pieces.append((int(doc), part * how.capacity, how.capacity, used, 0))
            used += 1
    rests = lengths % how.capacity
    left = room(int(rests.sum()), how.capacity)
    size, cost = left.copy(), np.zeros(len(left))
    for doc in np.argsort(-rests, kind="stable"):
        need, start = int(rests[doc]), int(lengths[doc] - rests[doc])
        while need:
            fits = left >= need
            if not fits.any():
                fits = left > 0
            to = int(np.where(fits, cost, np.inf).argmin())
            take = min(need, int(left[to]))
            pieces.append((int(doc), start, take, used + to, int(size[to] - left[to])))
            left[to] -= take
            cost[to] += how.linear * take + how.quadratic * take * take
            need, start = need - take, start + take
    return pieces


def _block(docs: list[int | None], ids: list[np.ndarray], first: int, how: Packing) -> tuple[pa.RecordBatch, int]:
    lengths = np.array([len(x) for x in ids], np.int64)
    pieces = assign(lengths, how)
    doc, start, length, sequence, offset = (np.array(x, np.int64) for x in zip(*pieces))
    held = [ids[d][s : s + n].tobytes() for d, s, n, _, _ in pieces]
    batch = pa.RecordBatch.from_arrays(
        [pa.array([docs[d] for d in doc], pa.int64()), pa.array(start), pa.array(length), pa.array(lengths[doc]),
         pa.array(sequence + first), pa.array(offset), pa.array(held, pa.binary())],
        names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
    )
    return batch, first + int(sequence.max()) + 1


def pack_documents(docs: DataFrame, vocabulary: str, how: Packing = Packing()) -> DataFrame:
    """One row per piece: its place in its document and in its sequence, and its ids (little-endian, 32 bits).

    A null or empty text is the end id alone. Repeated rows are packed one by
    one. A null doc_id stays null. Extra columns are not carried. No rows give
    no pieces. ``sequence_id`` is the Spark partition (upper bits) and a
    counter in it; ``docs`` should be a table read from files, so that a
    repeated task reads the same rows in the same order.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 33
        held, ids, tokens = [], [], 0
        for doc, found in encoded(batches, vocabulary, how.end_id):
            held.append(doc)
            ids.append(found)
            tokens += len(found)
            if tokens >= how.block_tokens:
                batch, first = _block(held, ids, first, how)
                yield batch
                held, ids, tokens = [], [], 0
        if held:
            yield _block(held, ids, first, how)[0]

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(pack, PIECES)


def packed_texts(pieces: DataFrame, docs: DataFrame) -> DataFrame:
    """Documents' columns with the packing of each: the sequences its pieces went to, in reading order."""
    places = pieces.groupBy("doc_id").agg(
        F.max("doc_tokens").alias("doc_tokens"),
        F.sort_array(F.collect_list(F.struct("start", "length", "sequence_id", "offset"))).alias("pieces"),
    )
    return docs.join(places, docs["doc_id"].eqNullSafe(places["doc_id"]), "left").drop(places["doc_id"])
