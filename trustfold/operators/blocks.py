"""Updates as blocks of cells: (layer, block_id, values), a few rows per model instead of one per weight."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustfold.constants import ADDITIVE_NOISE, CONSTANT_VALUE, REPLACEMENT_NOISE
from trustfold.functions.hashing import normal
from trustfold.operators.exchange import CELLS_PER_BLOCK, SIGNED_DECIMALS

BLOCK = ["layer", "block_id"]


def vector_blocks(df: DataFrame, classes: int, vector: str = "vector", cells: int = CELLS_PER_BLOCK) -> DataFrame:
    """Rows with a model vector (all biases, then all weights) -> one row per block of it, other columns kept."""
    def of_layer(name: str, part: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(part) - 1, F.lit(cells))
        return F.transform(starts, lambda at, k: F.struct(
            F.lit(name).alias("layer"), k.cast("long").alias("block_id"), F.slice(part, at + 1, cells).alias("values")
        ))

    v = F.col(vector)
    parts = F.concat(of_layer("bias", F.slice(v, 1, classes)), of_layer("weight", F.slice(v, classes + 1, F.size(v) - classes)))
    kept = [c for c in df.columns if c != vector]
    return df.select(*kept, F.explode(parts).alias("_part")).select(*kept, "_part.layer", "_part.block_id", "_part.values")


def block_vectors(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, vector): the blocks of each group as one vector in (layer, block) order; for models that a task trains."""
    parts = F.array_sort(F.collect_list(F.struct(*BLOCK, "values")))
    return blocks.groupBy(*keys).agg(parts.alias("_parts")).select(*keys, F.flatten(F.transform("_parts", lambda p: p["values"])).alias("vector"))


def corrupted(kind: Column, bad: Column, seed: int, round_no: int, cells: int = CELLS_PER_BLOCK) -> Column:
    """Values of a block as its client sends them; ``kind`` as in ``corrupt``, the same draws cell by cell."""
    def noise(i: Column) -> Column:
        return normal(seed, round_no, F.col("client_id"), F.col("layer"), F.col("block_id") * cells + i)

    v = F.col("values")
    changed = (
        F.when(kind == ADDITIVE_NOISE, F.transform(v, lambda x, i: x + noise(i)))
        .when(kind == REPLACEMENT_NOISE, F.transform(v, lambda x, i: noise(i)))
        .when(kind == CONSTANT_VALUE, F.transform(v, lambda x: F.lit(1.0)))
        .otherwise(v)
    )
    return F.when(bad, changed).otherwise(v)


def block_mac(secret: Column, context: list[Column], values: Column) -> Column:
    """Keyed digest of one block in its context (run, round, client, place, number of blocks)."""
    cell = F.transform(values, lambda x: F.coalesce(F.round(x * F.lit(10.0**SIGNED_DECIMALS)).try_cast("bigint").cast("string"), F.lit("nan")))
    parts = [F.hex(secret), *(c.cast("string") for c in context), F.array_join(cell, ",")]
    return F.sha2(F.concat_ws("|", *parts), 256)


def squared_distance(a: Column, b: Column) -> Column:
    """Of two blocks; null where one is missing or shorter."""
    squares = F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda t, x: t + x)
    return F.when(F.size(a) == F.size(b), squares)


def vector_sums(df: DataFrame, keys: list[str], values: str, weight: str) -> DataFrame:
    """(keys, values, weight): weighted sums of equally long arrays, and the sums of the weights.

    Each task adds up its own rows first, so what is shuffled is one array per
    key and task, whatever the number of rows.
    """
    kinds = dict(df.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "values array<double>", "weight double"])
    names = [*keys, "values", "weight"]

    def batch_of(held: dict, like: pa.Schema) -> pa.RecordBatch:
        columns = [pa.array([k[i] for k in held], like.field(i).type) for i in range(len(keys))]
        sums = [pa.array([v.tolist() for v, _ in held.values()], pa.list_(pa.float64())), pa.array([w for _, w in held.values()], pa.float64())]
        return pa.RecordBatch.from_arrays(columns + sums, names=names)

    def added(weighted: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, like = {}, None
            for batch in batches:
                like = batch.schema
                for *key, v, w in zip(*(c.to_pylist() for c in batch.columns)):
                    key = tuple(key)
                    v = np.array(v) * (w if weighted else 1.0)
                    if key in held:
                        v, w = v + held[key][0], w + held[key][1]
                    held[key] = (v, w)
            if held:
                yield batch_of(held, like)
        return run

    rows = df.select(*keys, F.col(values).alias("values"), F.col(weight).cast("double").alias("weight"))
    return rows.mapInArrow(added(True), schema).repartition(*keys).mapInArrow(added(False), schema)
