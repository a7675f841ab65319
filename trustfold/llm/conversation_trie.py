"""Prefix trie of conversations by truncation peeling.

A node is a sequence of first turns; its members are the conversations that
start with it. Peeling descends from the largest depth: at each depth the
conversations that end there join the nodes that survive from below, rows of
equal prefix become one node, and all sums over members, children and subtrees
are made while the node is found. Then every node strips its last turn and is
a row of the next depth. What a single conversation has for itself below some
depth is a chain without sums; it is stripped at once, so the rounds are those
of the deepest prefix that two conversations share.

Prefixes are told apart by 128 bits: two running XORs over hashes of (place,
role, text). A conversation of any length is cut into blocks for that, and the
member lists are hashed as a stream of sorted blocks, so no group is gathered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trustfold.functions.positions import position
from trustfold.functions.storage import durable, fresh_path

#: Turns of a conversation whose running hashes one window makes; longer ones carry on from block to block.
BLOCK_TURNS = 4_096
#: Members of one node that are joined to one text at a time.
BLOCK_MEMBERS = 1_000
#: A conversation shares its first turns with the first of every so many, and fewer than so many of them.
SHARING, MOST_SHARED = 5, 9

NODE = ["depth", "k1", "k2"]


def placed_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, h1, h2, bytes): every turn's place from 0, two hashes of (role, text), and the size of its text.

    Order is by turn, null first, then by role and text, so that ties and
    repeated rows have a defined order; null roles and texts are empty. Rows
    without a conv_id are no conversation and are left out. Extra columns are
    not carried. No rows give none.
    """
    said = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")),
    )
    placed = position(said, ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")], "pos")
    return placed.select(
        "conv_id", "pos", F.xxhash64("role", "text").alias("h1"), F.xxhash64(F.lit("2"), "text", "role").alias("h2"),
        F.octet_length("text").cast("long").alias("bytes"),
    )


def _shared_turns(conv_id: Column) -> Column:
    return F.crc32(conv_id.cast("string").cast("binary")) % MOST_SHARED


def with_shared_starts(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, roster): conversations that begin with another's first turns.

    Conversation c begins with the first h turns of conversation c - c % 5
    (all if it has fewer, none if there is none) and goes on with its own turns
    from place h on; h is the unsigned CRC-32 of the decimal c, modulo 9. The
    roster (conv_id, turns) holds conversations left without turns as well.
    """
    own = F.col("conv_id") % SHARING == 0
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    plan = sizes.withColumn("base", F.col("conv_id") - F.col("conv_id") % SHARING).withColumn("h", _shared_turns(F.col("conv_id")))
    bases = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    plan = durable(
        plan.join(bases, "base", "left").select(
            "conv_id", "base", "n", "h", F.least("h", F.coalesce("base_n", F.lit(0))).cast("long").alias("taken")
        ),
        "shared-starts",
    )
    tail = turns.filter(own | (F.col("pos") >= _shared_turns(F.col("conv_id"))))
    tail = tail.join(plan.select("conv_id", "h", "taken"), "conv_id").select(
        "conv_id", F.when(own, F.col("pos")).otherwise(F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "h1", "h2", "bytes"
    )
    heads = turns.filter(own & (F.col("pos") < MOST_SHARED - 1)).withColumnRenamed("conv_id", "base")
    takers = plan.filter(F.col("base") != F.col("conv_id")).select("conv_id", "base", "h")  # at most four a base
    heads = heads.join(takers, "base").filter(F.col("pos") < F.col("h")).select("conv_id", "pos", "h1", "h2", "bytes")
    rest = F.greatest(F.col("n") - F.col("h"), F.lit(0))
    roster = plan.select("conv_id", F.when(own, F.col("n")).otherwise(F.col("taken") + rest).cast("long").alias("turns"))
    return tail.union(heads), roster


def prefixes(turns: DataFrame, roster: DataFrame) -> DataFrame:
    """(conv_id, depth, k1, k2, p1, p2, bytes, turns): key of every conversation's first ``depth`` turns and of all but the last.

    Laid out by depth, so that a depth is read without the others.
    """
    cells = turns.select(
        "conv_id", (F.col("pos") + 1).alias("depth"), F.xxhash64("pos", "h1").alias("x1"), F.xxhash64("h2", "pos").alias("x2"), "bytes",
        F.expr(f"pos div {BLOCK_TURNS}L").alias("block"),
    )
    inside = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    running = cells.select("*", *(F.bit_xor(x).over(inside).alias(y) for x, y in (("x1", "y1"), ("x2", "y2"))))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        cells.groupBy("conv_id", "block").agg(F.bit_xor("x1").alias("t1"), F.bit_xor("x2").alias("t2"))
        .select("conv_id", "block", F.bit_xor("t1").over(before).alias("c1"), F.bit_xor("t2").over(before).alias("c2"))
        .filter("block > 0")
    )
    zero = F.lit(0).cast("long")
    whole = running.join(carried, ["conv_id", "block"], "left")
    for i in ("1", "2"):
        whole = whole.withColumn(f"k{i}", F.col(f"y{i}").bitwiseXOR(F.coalesce(f"c{i}", zero)))
        whole = whole.withColumn(f"p{i}", F.col(f"k{i}").bitwiseXOR(F.col(f"x{i}")))
    whole = whole.join(roster, "conv_id").select("conv_id", "depth", "k1", "k2", "p1", "p2", "bytes", "turns")
    return durable(whole, "prefixes")


def _alone(known: DataFrame) -> DataFrame:
    """Nodes of one member, each with all its sums: a chain that ends in one leaf and saves nothing."""
    whole = known.groupBy(*NODE).agg(
        F.count(F.lit(1)).alias("n"), *(F.min(c).alias(c) for c in ("conv_id", "p1", "p2")), F.max("turns").alias("turns")
    )
    return whole.filter("n = 1").select(
        *NODE, "conv_id", "p1", "p2", "n", (F.col("depth") < F.col("turns")).cast("long").alias("children"),
        F.lit(1).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved"),
    )


def _peeled(rows: DataFrame, *keys: str) -> DataFrame:
    """Nodes of one depth from the rows that end there or come from below."""
    found = rows.groupBy(*keys).agg(
        F.min("conv_id").alias("conv_id"), F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.max("bytes").alias("bytes"),
        *(F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved")),
    )
    return found.select(
        *keys, "conv_id", "p1", "p2", "n", "children",
        F.when(F.col("children") == 0, F.lit(1).cast("long")).otherwise(F.col("leaves")).alias("leaves"),
        (F.col("saved") + (F.col("n") - 1) * F.col("bytes")).alias("saved"),
    )


def _entering(rows: DataFrame) -> DataFrame:
    """Conversations as they join a depth: those that end there, and, as children, those that go on alone (``tail``)."""
    tail = F.col("tail").cast("long")
    return rows.select(
        "conv_id", "k1", "k2", "p1", "p2", "bytes", F.lit(1).cast("long").alias("n"), tail.alias("children"), tail.alias("leaves"),
        F.lit(0).cast("long").alias("saved"),
    )


def _stripped(rows: DataFrame) -> DataFrame:
    """Nodes of the depth below that have stripped a turn."""
    return rows.select("conv_id", "k1", "k2", "p1", "p2", "bytes", "n", F.lit(1).cast("long").alias("children"), "leaves", "saved")


def member_digests(ends: DataFrame) -> DataFrame:
    """(depth, k1, k2, digest): SHA-256 of the decimal conv_ids that end at a node, ascending, joined by commas.

    Ids are sorted over the whole cluster and joined in blocks; what then meets
    in one task for a node is a stream of blocks, of which one is held at a time.
    """
    schema = pa.schema([("depth", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("first", pa.int64()), ("ids", pa.string())])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held, ids = [], None, []
            for *node, conv in zip(*(c.to_pylist() for c in batch.columns)):
                if node != held or len(ids) >= BLOCK_MEMBERS:
                    if ids:
                        rows.append((*held, ids[0], ",".join(map(str, ids))))
                    held, ids = node, []
                ids.append(conv)
            if ids:
                rows.append((*held, ids[0], ",".join(map(str, ids))))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state = None, None
        for batch in batches:
            out = []
            for *node, ids in zip(*(batch.column(c).to_pylist() for c in (*NODE, "ids"))):
                if node != held:
                    if held is not None:
                        out.append((*held, state.hexdigest()))
                    held, state = node, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if out:
                yield _named(out)
        if held is not None:
            yield _named([(*held, state.hexdigest())])

    def _named(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.int64()] * 3 + [pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=[*NODE, "digest"])

    node = "depth long, k1 long, k2 long"
    by_id = ends.select(*NODE, "conv_id").repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id")
    joined = by_id.mapInArrow(blocks, f"{node}, first long, ids string")
    return joined.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(digests, f"{node}, digest string")


def prefix_trie(turns: DataFrame, roster: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved, digest.

    ``turns`` (conv_id, pos, h1, h2, bytes) are numbered from 0 without gaps,
    ``roster`` (conv_id, turns) holds every conversation and its length, which
    may be 0. A node is named by its smallest member and its depth; the root
    has depth 0 and no parent. ``saved`` sums, over the node's subtree, the
    bytes of a last text times its members but one. ``digest`` covers the
    members that end at the node. An empty roster gives no rows. There are as
    many small rounds as turns in the deepest prefix of two conversations.
    """
    spark = turns.sparkSession
    known = prefixes(turns, roster)
    alone = durable(_alone(known), "alone")
    tops = alone.groupBy("conv_id").agg(F.min("depth").alias("top"))
    shared = known.join(tops, "conv_id", "left").filter("top is null or depth < top").select(
        *known.columns, F.coalesce(F.col("top") - 1, "turns").alias("joins"), F.col("top").isNotNull().alias("tail")
    )
    shared = durable(shared.repartitionByRange("depth", "conv_id").sortWithinPartitions("depth", "conv_id"), "shared")
    deepest = shared.agg(F.max("depth")).first()[0] or 0
    path = fresh_path(spark, "trie")
    columns = ["k1", "k2", "conv_id", "p1", "p2", "n", "children", "leaves", "saved"]
    schema = ", ".join(f"{c} long" for c in columns)

    def written(nodes: DataFrame, depth: int) -> DataFrame:
        nodes.select(*columns).write.parquet(f"{path}/depth={depth}")
        return spark.read.schema(schema).parquet(f"{path}/depth={depth}")

    below = None
    for depth in range(deepest, 0, -1):
        here = shared.filter(F.col("depth") == depth)
        rows = _entering(here.filter("joins = depth"))
        if below is not None:
            rows = rows.union(_stripped(here.join(below.select("conv_id", "n", "leaves", "saved"), "conv_id")))
        below = written(_peeled(rows, "k1", "k2"), depth)
    zero = F.lit(0).cast("long")
    at_root = [zero.alias(c) for c in ("k1", "k2", "p1", "p2", "bytes")]
    strangers = roster.join(tops, "conv_id", "left").filter("turns = 0 or top = 1")
    rows = _entering(strangers.select("conv_id", *at_root, (F.col("turns") > 0).alias("tail")))
    if below is not None:
        rows = rows.union(_stripped(below.select("conv_id", *at_root, "n", "leaves", "saved")))
    written(_peeled(rows, "k1", "k2"), 0)

    silent = roster.filter("turns = 0")
    nodes = spark.read.schema(f"{schema}, depth long").parquet(path).unionByName(alone)
    ends = known.filter("turns = depth").select(*NODE, "conv_id").union(silent.select(zero, zero, zero, "conv_id"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return (
        nodes.join(parents, ["depth", "p1", "p2"], "left")
        .withColumn("parent_conv_id", F.when(F.col("depth") > 0, F.col("parent_conv_id")))
        .join(member_digests(ends), NODE, "left")
        .select(
            "conv_id", "depth", "parent_conv_id", F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
            F.col("leaves").alias("n_leaves"), "saved", F.coalesce("digest", nothing).alias("digest"),
        )
    )
