"""Label-skewed dealing of rows to clients, and per-client sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from trustfold.constants import CLIENTS, DEAL_SEED, DEFAULT_SUBSET_ROWS, SHARDS_PER_CLIENT
from trustfold.functions.hashing import order_key
from trustfold.functions.positions import MOST_CUTS, SLICE_ROWS, cut_of, hex_digits_for, quantile_cuts, sliced_position
from trustfold.functions.sizing import broadcast_if_small
from trustfold.functions.storage import durable

#: Rows per id slice of a label, and slices over all labels, aimed at when sharding.
SHARD_SLICE_ROWS = 100_000
SHARD_SLICES = 200_000
#: Shards whose first rows may stand in an expression; more are looked up in a table.
MOST_STARTS = 256
#: Bits of an id that one more count of a slice tells apart.
REFINE_BITS = 12
#: Rows up to which Spark limits a window's groups before it shuffles them.
GROUP_LIMIT_ROWS = 1_000
#: Leading hex digits of a hash by which a client's rows are counted when sampling: 4,096 slices.
SUBSET_DIGITS = 3


def check_capacity(df: DataFrame, clients: int = CLIENTS, shards_per_client: int = SHARDS_PER_CLIENT) -> DataFrame:
    """One row (required, actual, ok): are there enough rows to fill every shard?"""
    required = clients * shards_per_client
    actual = F.count(F.lit(1))
    return df.agg(
        F.lit(required).cast("bigint").alias("required"),
        actual.alias("actual"),
        (actual >= required).alias("ok"),
    )


def _require_capacity(rows: int, clients: int, shards_per_client: int) -> None:
    if rows < clients * shards_per_client:
        raise ValueError(
            f"need at least {clients * shards_per_client} rows for {clients} clients x "
            f"{shards_per_client} shards, have {rows}"
        )


def _shard_of(rank: str, rows: int, shards: int) -> Column:
    """Shard of a 0-based rank when the first ``rows % shards`` shards hold one row more."""
    base, extra = divmod(rows, shards)
    wide = extra * (base + 1)
    return F.expr(
        f"CASE WHEN {rank} < {wide}L THEN {rank} div {base + 1}L "
        f"ELSE {extra}L + ({rank} - {wide}L) div {base}L END"
    )


def id_stats(df: DataFrame, id_col: str = "row_id", label_col: str = "label") -> Row:
    """Row count, label count and id range, one narrow aggregate; NULL labels or ids raise."""
    stats = df.groupBy(label_col).agg(
        F.count(F.lit(1)).alias("n"), F.count(id_col).alias("ids"), F.min(id_col).alias("lo"), F.max(id_col).alias("hi")
    ).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("labels"),
        F.sum(F.col("n") - F.when(F.col(label_col).isNull(), 0).otherwise(F.col("ids"))).alias("blank"),
        F.min("lo").alias("lo"), F.max("hi").alias("hi"),
    ).first()
    if stats["blank"]:
        raise ValueError(f"{stats['blank']} rows lack a label or an id")
    return stats


def label_shards(
    df: DataFrame, clients: int = CLIENTS, shards_per_client: int = SHARDS_PER_CLIENT,
    id_col: str = "row_id", label_col: str = "label", slice_rows: int = SHARD_SLICE_ROWS, stats: Row | None = None,
) -> DataFrame:
    """Add ``shard``: rows sorted by (label, id), cut into equal contiguous shards.

    Narrow aggregates find the ids at which a shard begins, so that the rows
    take their shard from comparisons alone, without being sorted, joined or
    moved. Only equal rows that a border parts are ranked row by row. More
    than MOST_STARTS shards, or ids that are no integers, go by slices of ids.
    """
    shards = clients * shards_per_client
    stats = id_stats(df, id_col, label_col) if stats is None else stats
    rows = stats["n"]
    _require_capacity(rows, clients, shards_per_client)
    if shards > MOST_STARTS or not isinstance(df.schema[id_col].dataType, IntegralType):
        return _shards_by_slices(df, rows, stats["labels"], shards, id_col, label_col, slice_rows)
    starts = _shard_starts(df, stats, shards, id_col, label_col, slice_rows)
    return _shards_by_starts(df, starts, rows, shards, id_col, label_col)


def _shard_starts(df: DataFrame, stats: Row, shards: int, id_col: str, label_col: str, slice_rows: int) -> list[Row]:
    """(_label, _at, _start, _first, _last) of every id that begins a shard or lies across a border, in order.

    Rows are counted per (label, leading bits of the id). The prefix sums tell
    which of these slices hold a border; only their rows are counted again, by
    more bits, until a slice is one id. Slices of at most ``slice_rows`` rows
    go to single ids at once, so evenly spread ids take two counts. At most
    ``shards`` rows come to the driver.
    """
    rows, lo, hi = stats["n"], stats["lo"], stats["hi"]
    most = max(1, min(-(-rows // slice_rows), SHARD_SLICES // stats["labels"]))
    shift = 0
    while shift < 63 and (hi >> shift) - (lo >> shift) >= most:
        shift += 1
    ids = df.select(F.col(label_col).alias("_label"), F.col(id_col).cast("bigint").alias("_id"))
    part = ids.withColumn("_base", F.lit(0).cast("bigint"))
    # the first window runs over the slice counts, at most max(SHARD_SLICES, labels) rows
    order = Window.orderBy("_label", "_at")
    while True:
        before = F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1))
        counted = (
            part.groupBy("_label", "_base", F.shiftright("_id", shift).alias("_at")).agg(F.count(F.lit(1)).alias("_n"))
            .withColumn("_start", F.col("_base") + F.coalesce(before, F.lit(0)))
            .withColumn("_first", _shard_of("_start", rows, shards))
            .withColumn("_last", _shard_of("(_start + _n - 1)", rows, shards))
        )
        begins = _shard_of("(_start - 1)", rows, shards) != F.col("_last")
        found = durable(counted.filter(begins).drop("_base"), "shard-starts")
        if shift == 0:
            return found.orderBy("_start").collect()
        widest = found.agg(F.max("_n").alias("n")).first()["n"] or 0
        spans = found.select(F.col("_label").alias("_of"), "_at", F.col("_start").alias("_base"))
        part = ids.join(
            F.broadcast(spans), (F.col("_label") == F.col("_of")) & (F.shiftright("_id", shift) == F.col("_at"))
        ).select("_label", "_id", "_base")
        order = Window.partitionBy("_label", "_base").orderBy("_at")
        shift = 0 if widest <= slice_rows else max(0, shift - REFINE_BITS)


def _halved(value: Column, borders: list, at_least: list[Column], before: Column) -> Column:
    """What ``value`` maps to: ``at_least[i]`` from ``borders[i]`` on, ``before`` below the first, by halving comparisons."""
    if not borders:
        return before
    mid = len(borders) // 2
    return F.when(
        value >= F.lit(borders[mid]), _halved(value, borders[mid + 1:], at_least[mid + 1:], at_least[mid])
    ).otherwise(_halved(value, borders[:mid], at_least[:mid], before))


def _shard_at(starts: list[Row], label: Column, row_id: Column) -> Column:
    """Shard of a row; NULL for rows equal to one that lies across a border."""
    def number(shard: int | None) -> Column:
        return F.lit(shard).cast("bigint")

    borders, reached, before = [], [], 0
    for start in starts:
        if not borders or borders[-1] != start["_label"]:
            borders.append(start["_label"])
            reached.append((before, {}))
        parted = start["_first"] != start["_last"]
        reached[-1][1][start["_at"]] = None if parted else start["_last"]
        if parted and start["_at"] < 2**63 - 1:
            reached[-1][1][start["_at"] + 1] = start["_last"]
        before = start["_last"]
    ends = [first for first, _ in reached[1:]] + [before]
    at_least = [
        F.when(label == F.lit(border), _halved(row_id, list(ids), list(map(number, ids.values())), number(first)))
        .otherwise(number(end))
        for border, (first, ids), end in zip(borders, reached, ends)
    ]
    return _halved(label, borders, at_least, number(0))


def _shards_by_starts(
    df: DataFrame, starts: list[Row], rows: int, shards: int, id_col: str, label_col: str
) -> DataFrame:
    placed = df.withColumn("shard", _shard_at(starts, F.col(label_col), F.col(id_col)))
    parted = [s for s in starts if s["_first"] != s["_last"]]
    if not parted:
        return placed
    rank = F.coalesce(*[
        F.when((F.col(label_col) == F.lit(s["_label"])) & (F.col(id_col) == F.lit(s["_at"])), F.lit(s["_start"]))
        for s in parted
    ])
    equal = F.row_number().over(Window.partitionBy(label_col, id_col).orderBy(id_col)) - 1
    ranked = (
        placed.filter(F.col("shard").isNull()).withColumn("_rank", rank + equal)
        .withColumn("shard", _shard_of("_rank", rows, shards)).drop("_rank")
    )
    return placed.filter(F.col("shard").isNotNull()).unionByName(ranked)


def _shards_by_slices(
    df: DataFrame, rows: int, labels: int, shards: int, id_col: str, label_col: str, slice_rows: int
) -> DataFrame:
    """Shards by a lookup of id slices; only slices that a border crosses, at most one per shard, are ranked row by row."""
    cuts = quantile_cuts(df, id_col, rows, slice_rows, max(1, min(MOST_CUTS, SHARD_SLICES // labels)))
    slices = len(cuts)
    sliced = df.withColumn("_slice", cut_of(F.col(id_col), cuts) if slices > 1 else F.lit(0))
    keys = [label_col, "_slice"]

    # the window below runs over the slice counts, at most max(SHARD_SLICES, labels) rows
    before = Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    lookup = (
        sliced.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .select(
            *keys, "_start",
            _shard_of("_start", rows, shards).alias("_first"),
            _shard_of("(_start + _n - 1)", rows, shards).alias("_last"),
        )
    )
    located = sliced.join(broadcast_if_small(lookup, slices * labels), keys)
    rank = F.col("_start") + F.row_number().over(Window.partitionBy(*keys).orderBy(id_col)) - 1

    def ranked(part: DataFrame) -> DataFrame:
        return part.withColumn("_rank", rank).withColumn("shard", _shard_of("_rank", rows, shards)).drop("_rank")

    if slices == 1:
        sharded = ranked(located)
    else:
        inside = F.col("_first") == F.col("_last")
        sharded = located.filter(inside).withColumn("shard", F.col("_first")).unionByName(ranked(located.filter(~inside)))
    return sharded.drop("_slice", "_start", "_first", "_last")


def shard_audit(
    sharded: DataFrame, clients: int = CLIENTS, shards_per_client: int = SHARDS_PER_CLIENT
) -> DataFrame:
    """One row: shard count, total rows, smallest and largest shard, and whether the cut is even."""
    sizes = sharded.groupBy("shard").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(
        F.count(F.lit(1)).alias("shards"),
        F.sum("n").alias("total_rows"),
        F.min("n").alias("smallest"),
        F.max("n").alias("largest"),
    ).withColumn(
        "even",
        (F.col("shards") == clients * shards_per_client) & (F.col("largest") - F.col("smallest") <= 1),
    )


def shard_owners(
    spark, clients: int = CLIENTS, shards_per_client: int = SHARDS_PER_CLIENT, seed: int = DEAL_SEED
) -> DataFrame:
    """(shard, client_id): shards in hashed order, ``shards_per_client`` in a row to each client."""
    shuffled = Window.orderBy(order_key(seed, F.col("shard")), "shard")
    return (
        spark.range(clients * shards_per_client).select(F.col("id").alias("shard"))
        .withColumn("_pos", F.row_number().over(shuffled) - 1)
        .select("shard", F.floor(F.col("_pos") / shards_per_client).cast("bigint").alias("client_id"))
    )


def assign_clients(
    sharded: DataFrame, clients: int = CLIENTS, shards_per_client: int = SHARDS_PER_CLIENT, seed: int = DEAL_SEED
) -> DataFrame:
    owners = shard_owners(sharded.sparkSession, clients, shards_per_client, seed)
    return sharded.join(broadcast_if_small(owners, clients * shards_per_client), "shard")


def client_order(
    dealt: DataFrame, seed: int = DEAL_SEED, id_col: str = "row_id", rows: int | None = None
) -> DataFrame:
    """Add ``ord``, the 0-based place of a row in its client's shuffled order.

    A client may own a third of all rows, so beyond SLICE_ROWS rows in total
    its order is numbered in slices cut by the leading digits of the shuffle key.
    """
    rows = dealt.count() if rows is None else rows
    if rows <= SLICE_ROWS:
        whole = Window.partitionBy("client_id").orderBy(order_key(seed, "order", F.col(id_col)), id_col)
        return dealt.withColumn("ord", (F.row_number().over(whole) - 1).cast("bigint"))
    shuffled = order_key(seed, "order", F.col(id_col))
    cut = F.substring(shuffled, 1, hex_digits_for(rows))
    return sliced_position(dealt, ["client_id"], [F.unhex(shuffled), F.col(id_col)], cut, "ord")


def deal(
    df: DataFrame, clients: int = CLIENTS, shards_per_client: int = SHARDS_PER_CLIENT, seed: int = DEAL_SEED
) -> DataFrame:
    """Whole deal: shard by label, hand shards to clients, shuffle inside each client."""
    stats = id_stats(df)
    sharded = label_shards(df, clients, shards_per_client, stats=stats)
    return client_order(assign_clients(sharded, clients, shards_per_client, seed), seed, rows=stats["n"])


def layout(dealt: DataFrame, rows_per_block: int = SLICE_ROWS) -> DataFrame:
    """Rows of one (client, block) together in one partition; a big client spans many blocks."""
    return dealt.withColumn("block", F.expr(f"ord div {rows_per_block}L")).repartition("client_id", "block")


def client_subset(
    dealt: DataFrame, rows: int = DEFAULT_SUBSET_ROWS, seed: int = 0,
    id_col: str = "row_id", key: str = "client_id",
) -> DataFrame:
    """At most ``rows`` rows per client without replacement; all of them when there are fewer.

    The rows of least hash, in the order of their hashes. Small samples are
    limited inside salted slices of a client, before rows move, and once more
    over the survivors. Beyond GROUP_LIMIT_ROWS, where a window no longer limits
    early, a client's rows are counted by the leading digits of their hashes:
    the counts say which digits can hold a chosen row and how many rows come
    before them, so only chosen rows move, by (client, digits), and no task
    sorts a client or its sample. ``dealt`` is read twice then, so pass a
    materialised table. Adds ``pos``.
    """
    keyed = dealt.withColumn("_key", order_key(seed, "subset", F.col(id_col)))
    return _least_of_salts(keyed, rows, id_col, key) if rows <= GROUP_LIMIT_ROWS else _least_of_slices(keyed, rows, id_col, key)


def _least_of_salts(keyed: DataFrame, rows: int, id_col: str, key: str) -> DataFrame:
    salted = keyed.withColumn("_salt", F.substring("_key", 31, 2))
    place = F.row_number().over(Window.partitionBy(key, "_salt").orderBy("_key", id_col))
    survivors = salted.withColumn("_place", place).filter(F.col("_place") <= rows)
    final = F.row_number().over(Window.partitionBy(key).orderBy("_key", id_col))
    return (
        survivors.withColumn("pos", final).filter(F.col("pos") <= rows)
        .withColumn("pos", (F.col("pos") - 1).cast("bigint"))
        .drop("_key", "_salt", "_place")
    )


def _least_of_slices(keyed: DataFrame, rows: int, id_col: str, key: str) -> DataFrame:
    keyed = keyed.withColumn("_slice", F.substring("_key", 1, SUBSET_DIGITS))
    earlier = Window.partitionBy("_client").orderBy("_digits").rowsBetween(Window.unboundedPreceding, -1)
    slices = durable(
        keyed.groupBy(F.col(key).alias("_client"), F.col("_slice").alias("_digits")).agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .filter(F.col("_before") < rows).drop("_n"),
        "subset-slices",
    )
    chosen = keyed.join(broadcast_if_small(slices), F.col(key).eqNullSafe(F.col("_client")) & (F.col("_slice") == F.col("_digits")))
    place = F.row_number().over(Window.partitionBy(key, "_slice").orderBy("_key", id_col)) - 1
    return (
        chosen.withColumn("pos", (F.col("_before") + place).cast("bigint")).filter(F.col("pos") < rows)
        .drop("_key", "_slice", "_client", "_digits", "_before")
    )


def label_skew(dealt: DataFrame) -> DataFrame:
    """Per client and label: rows and share; per client: labels held."""
    cells = dealt.groupBy("client_id", "label").agg(F.count(F.lit(1)).alias("n"))
    of_client = Window.partitionBy("client_id")  # over the counts: one row per label a client holds
    return (
        cells.withColumn("client_rows", F.sum("n").over(of_client))
        .withColumn("labels_held", F.count(F.lit(1)).over(of_client))
        .withColumn("share", F.col("n") / F.col("client_rows"))
    )
