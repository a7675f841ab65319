"""Shards cut from a Hilbert curve over several metadata columns.

Each column is quantised to 2^BITS equally filled steps, the steps of a row
are a cell of a grid, and the Hilbert curve through the grid orders the rows.
Runs of that order are the shards, equal in rows. Rows of a shard are near
each other in every column at once, so its files have narrow ranges in all of
them and a reader can skip most files whichever column it filters on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustfold.functions.positions import range_position
from trustfold.functions.sizing import broadcast_if_small
from trustfold.functions.storage import durable
from trustfold.llm.columns import text_key, whole

SHARDS = 24
BITS = 8
#: Bytes of a row besides its text.
ROW_BYTES = 8
#: Bytes of a string, behind what all values share, that place it among the others.
PREFIX_BYTES = 6


def hilbert_index(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of each row of ``cells`` (rows x dimensions, values below 2^bits).

    Works on all rows at once, from the coarsest bit to the finest: every bit
    of an axis either reflects the first axis below that bit or swaps it with
    its own, after which Gray code turns the bits of all axes into the index.
    """
    x = cells.astype(np.int64).copy()
    dims = x.shape[1]
    for bit in range(bits - 1, 0, -1):
        below = (1 << bit) - 1
        for axis in range(dims):
            set_here = x[:, axis] >> bit & 1 == 1
            swap = np.where(set_here, 0, (x[:, 0] ^ x[:, axis]) & below)
            x[:, 0] = np.where(set_here, x[:, 0] ^ below, x[:, 0] ^ swap)
            x[:, axis] ^= swap
    gray = np.bitwise_xor.accumulate(x, axis=1)
    turn = np.zeros(len(x), np.int64)
    for bit in range(bits - 1, 0, -1):
        turn ^= np.where(gray[:, -1] >> bit & 1 == 1, (1 << bit) - 1, 0)
    gray ^= turn[:, None]
    index = np.zeros(len(x), np.int64)
    for bit in range(bits - 1, -1, -1):
        for axis in range(dims):
            index = index << 1 | (gray[:, axis] >> bit & 1)
    return index


def _number(rows: DataFrame, name: str) -> Column:
    """A double in the order of the column's values; strings by the bytes that follow what all of them share."""
    kind = rows.schema[name].dataType.typeName()
    if kind != "string":
        return F.col(name).cast("double")
    ends = rows.agg(F.min(name).alias("a"), F.max(name).alias("b")).first()
    a, b = (ends["a"] or "").encode(), (ends["b"] or "").encode()
    shared = next((at for at, (p, q) in enumerate(zip(a, b)) if p != q), min(len(a), len(b)))
    cut = F.hex(F.substring(F.col(name).cast("binary"), shared + 1, PREFIX_BYTES))
    return F.conv(F.rpad(cut, 2 * PREFIX_BYTES, "0"), 16, 10).cast("double")


def quantised(rows: DataFrame, names: list[str], bits: int = BITS) -> tuple[DataFrame, list[list[float]]]:
    """``rows`` with a double ``_d0``, ``_d1``, ... per column, and the borders of its 2^bits equally filled steps."""
    numbered = rows.select("*", *(_number(rows, n).alias(f"_d{k}") for k, n in enumerate(names)))
    shares = [i / (1 << bits) for i in range(1, 1 << bits)]
    found = numbered.agg(*(F.percentile_approx(f"_d{k}", shares, 100 << bits).alias(f"p{k}") for k in range(len(names)))).first()
    return numbered, [list(p or []) for p in found]


def with_curve(rows: DataFrame, names: list[str], bits: int = BITS) -> DataFrame:
    """``rows`` with ``curve``, the place of their cell; a null stands before all values of its column."""
    kept = rows.columns
    numbered, borders = quantised(rows, names, bits)
    dims = [f"_d{k}" for k in range(len(names))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = np.zeros((batch.num_rows, len(dims)), np.int64)
            for k, (dim, cuts) in enumerate(zip(dims, borders)):
                values = batch.column(dim).fill_null(-np.inf).to_numpy(zero_copy_only=False)
                cells[:, k] = np.searchsorted(np.array(cuts), values, "right")
            columns = [batch.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(hilbert_index(cells, bits))], names=[*kept, "curve"])

    schema = rows.select(*kept).withColumn("curve", F.lit(0).cast("long")).schema
    return numbered.mapInArrow(run, schema)


def hilbert_shards(docs: DataFrame, shards: int = SHARDS, names: tuple[str, ...] = ("size", "lang", "source", "doc_id")) -> DataFrame:
    """(doc_id, text_key, size, text_crc32, the named columns, shard, slot) of every row.

    Shards take equal numbers of rows, at most one apart; ``slot`` counts from
    0 in each. Rows of one cell follow each other by text and id, so equal
    texts stay together there. A null text counts no bytes; nulls in the
    columns come first; repeated rows get a place each; no rows give none.
    """
    text = F.col("text").cast("string")
    given = [n for n in names if n not in ("size", "doc_id")]
    rows = durable(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("text_key"),
        (F.octet_length(whole(text)) + ROW_BYTES).cast("long").alias("size"), F.crc32(whole(text).cast("binary")).alias("text_crc32"),
        *(F.col(n) for n in given),
    ), "sizes")
    count = rows.count()
    order = [F.col("curve"), F.col("text_crc32"), F.col("doc_id")]
    placed = range_position(durable(with_curve(rows, list(names)), "curve"), [], order, "place")
    # the first row of shard s is the least place with place * shards >= s * count
    shard = F.expr(f"cast(place * {shards} div {max(count, 1)} as int)")
    first = F.expr(f"(shard * {count}L + {shards - 1}) div {shards}")
    return placed.withColumn("shard", shard).withColumn("slot", F.col("place") - first).drop("place", "curve")


def shard_ranges(placed: DataFrame, names: list[str]) -> DataFrame:
    """Rows, bytes and the range of each named column of every shard: what a reader prunes by."""
    ranges = [f(n).alias(f"{n}_{k}") for n in names for k, f in (("min", F.min), ("max", F.max))]
    return placed.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"), *ranges)


def write_shards(docs: DataFrame, placed: DataFrame, path: str) -> None:
    """Write the documents in a folder per shard, in slot order.

    Repeated rows share the place of the first of them, so that each is written once.
    """
    places = placed.groupBy("doc_id", "text_key").agg(F.min(F.struct("shard", "slot")).alias("p"))
    match = docs["doc_id"].cast("long").eqNullSafe(places["doc_id"]) & text_key(docs["text"]).eqNullSafe(places["text_key"])
    rows = docs.join(broadcast_if_small(places), match).select(*[docs[c] for c in docs.columns], F.col("p.shard").alias("shard"), F.col("p.slot").alias("slot"))
    rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
