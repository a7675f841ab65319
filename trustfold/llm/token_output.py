"""Best-fit-decreasing packing into id matrices for training.

Every document's ids are cut losslessly into pieces of at most the row length;
the pieces go, longest first, to the row with the least room that still takes
them. A segment tree over the possible amounts of room finds that row in
log2(length) steps. Rows come out as matrices of a fixed number of rows, with
the cumulative lengths of the segments and positions that restart in each.
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

MATRICES = (
    "matrix_id long, n_rows int, ids binary, positions binary, "
    "rows array<struct<doc_ids: array<long>, starts: array<long>, cu_seqlens: array<int>>>"
)


@dataclass(frozen=True)
class Matrices:
    """Row length, rows per matrix, id that ends a document, id that pads, tokens a task packs at once."""

    length: int = 2048
    rows: int = 256
    end_id: int = 2
    pad_id: int = 0
    block_tokens: int = 1 << 22


class RoomTree:
    """Rows by the room they have left; node values tell whether any row lies below."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.any = [0] * (2 * self.leaves)  # rows below a node
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        at = self.leaves + room
        while at:
            self.any[at] += 1
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return (room, row) of the least room of at least ``need``."""
        at = self.leaves + need
        if not self.any[at]:
            while at > 1 and (at & 1 or not self.any[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.any[2 * at] else 2 * at + 1
        room = at - self.leaves
        while at:
            self.any[at] -= 1
            at >>= 1
        return room, self.rows[room].pop()


def best_fit(lengths: list[int], most: int) -> list[list[int]]:
    """Pieces of each row, by best fit in descending length; equal lengths keep their order."""
    tree, rows = RoomTree(most), []
    for piece in sorted(range(len(lengths)), key=lambda p: -lengths[p]):
        found = tree.take(lengths[piece])
        if found is None:
            room, row = most, len(rows)
            rows.append([])
        else:
            room, row = found
        rows[row].append(piece)
        if room > lengths[piece]:
            tree.add(room - lengths[piece], row)
    return rows


def _matrices(docs: list[int | None], ids: list[np.ndarray], first: int, how: Matrices) -> Iterator[pa.RecordBatch]:
    pieces = [(d, s) for d, x in enumerate(ids) for s in range(0, len(x), how.length)]
    lengths = [min(how.length, len(ids[d]) - s) for d, s in pieces]
    rows = best_fit(lengths, how.length)
    for begin in range(0, len(rows), how.rows):
        part = rows[begin : begin + how.rows]
        held = np.full((len(part), how.length), how.pad_id, "<u4")
        places = np.zeros((len(part), how.length), "<u4")
        index = []
        for r, row in enumerate(part):
            ends = np.cumsum([0, *(lengths[p] for p in row)])
            for p, at in zip(row, ends):
                d, s = pieces[p]
                held[r, at : at + lengths[p]] = ids[d][s : s + lengths[p]]
                places[r, at : at + lengths[p]] = np.arange(lengths[p])
            index.append({"doc_ids": [docs[pieces[p][0]] for p in row], "starts": [pieces[p][1] for p in row], "cu_seqlens": ends.tolist()})
        yield pa.RecordBatch.from_arrays(
            [pa.array([first + begin // how.rows], pa.int64()), pa.array([len(part)], pa.int32()),
             pa.array([held.tobytes()], pa.binary()), pa.array([places.tobytes()], pa.binary()),
             pa.array([index], pa.list_(pa.struct([("doc_ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64())), ("cu_seqlens", pa.list_(pa.int32()))])))],
            names=["matrix_id", "n_rows", "ids", "positions", "rows"],
        )


def pack_matrices(docs: DataFrame, vocabulary: str, how: Matrices = Matrices()) -> DataFrame:
    """One row per matrix of packed ids (row-major, little-endian, 32 bits), with positions and segment bounds.

    A null or empty text is the end id alone; repeated rows and null ids are
    packed like others; extra columns are not carried; no rows give no matrix.
    ``cu_seqlens`` starts with 0 and ends with the filled length; what follows
    is padding. ``docs`` should be read from files, as ``matrix_id`` holds the
    Spark partition.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 33
        held, ids, tokens = [], [], 0
        for doc, found in encoded(batches, vocabulary, how.end_id):
            held.append(doc)
            ids.append(found)
            tokens += len(found)
            if tokens >= how.block_tokens:
                for batch in _matrices(held, ids, first, how):
                    yield batch
                    first += 1
                held, ids, tokens = [], [], 0
        if held:
            yield from _matrices(held, ids, first, how)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(pack, MATRICES)


def write_matrices(matrices: DataFrame, path: str) -> None:
    """Write the matrices as Parquet with compressed binary columns; a lost task's files are dropped and written again."""
    matrices.write.option("compression", "zstd").parquet(path)


def matrix_rows(matrices: DataFrame, length: int) -> DataFrame:
    """One row per packed sequence: its segments, and its slice of the id and position matrices."""
    size = 4 * length
    rows = matrices.select("matrix_id", "ids", "positions", F.posexplode("rows").alias("row", "segments"))
    cut = lambda c: F.substring(F.col(c), F.col("row") * size + 1, F.lit(size))
    return rows.select(
        (F.shiftleft("matrix_id", 10) + F.col("row")).alias("sequence_id"), "segments.*",
        cut("ids").alias("ids"), cut("positions").alias("positions"),
    )
