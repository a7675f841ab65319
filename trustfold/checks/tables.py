"""How the given tables map onto the tables the operators expect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trustfold.functions.hashing import uniform
from trustfold.functions.positions import position
from trustfold.sources.labeled import load_labeled

EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
EVENT_THRESHOLD = 100.0
RUN_THRESHOLD = 50.0
IMAGE_SIDE = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(value, digits: int):
    """Rounded for comparison, in plain double arithmetic and without a negative zero."""
    return F.floor(value * F.lit(10.0**digits) + F.lit(0.5)) / F.lit(10.0**digits)


def embedding_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_labeled(spark, f"{sf_dir}/embeddings.parquet", "vec_id", "embedding", "label")


#: Order lines have no unique key below these columns together.
LINE_KEY = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "CAST(floor(l_quantity * 100 + 0.5) AS BIGINT)",
    "CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT)", "CAST(floor(l_discount * 100 + 0.5) AS BIGINT)",
    "CAST(floor(l_tax * 100 + 0.5) AS BIGINT)",
]


def line_id(days: str) -> str:
    """SQL of a 62-bit id: two polynomial hashes of the line key, modulo two primes, in plain integers.

    ``days`` is the dialect's expression for the ship date as days since 1970.
    """
    halves = []
    for prime, factor in ((2147483647, 1103515245), (2147483629, 1664525)):
        value = "CAST(0 AS BIGINT)"
        for part in [*LINE_KEY, days]:
            value = f"(({value} * {factor} + {part}) % {prime})"
        halves.append(value)
    return f"({halves[0]} * 2147483648 + {halves[1]})"


def lineitem_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled rows of four features and six classes."""
    label = (F.expr("instr('ANR', l_returnflag)") - 1) * 2 + F.expr("instr('FO', l_linestatus)") - 1
    return table(spark, sf_dir, "lineitem").select(
        F.expr(line_id("unix_date(CAST(l_shipdate AS DATE))")).alias("row_id"),
        F.array(
            F.col("l_quantity") / 50.0, F.col("l_extendedprice") / 100000.0,
            F.col("l_discount") * 10.0, F.col("l_tax") * 10.0,
        ).alias("features"),
        label.cast("int").alias("label"),
    )


def event_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(client_id, round, dist, secure): a user's events in time order are its rounds."""
    events = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("client_id"), "ts", "event_id", F.col("value").alias("dist"),
        (F.col("event_type") != "error").alias("secure"),
    )
    placed = position(events, ["client_id"], [F.col("ts"), F.col("event_id")], "round")
    return placed.select("client_id", (F.col("round") + 1).alias("round"), "dist", "secure")


def run_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five runs (event types) of ten clients over days; run and client packed in ``client_id``."""
    kinds = F.array(*[F.lit(k) for k in EVENT_TYPES])
    events = table(spark, sf_dir, "events").select(
        ((F.array_position(kinds, F.col("event_type")) - 1) * 10 + F.col("user_id") % 10).cast("bigint").alias("client_id"),
        (F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")) + 1).cast("bigint").alias("round"),
        "value",
    )
    return events.groupBy("client_id", "round").agg(
        rounded(F.avg("value"), 6).alias("dist"), (F.max("value") < 300.0).alias("secure")
    )


def unpack_run(history: DataFrame) -> DataFrame:
    """(run_id, round, client_id, score) from packed client ids."""
    return history.select(
        F.concat(F.lit("run"), F.expr("client_id div 10")).alias("run_id"), "round",
        (F.col("client_id") % 10).alias("client_id"), "score",
    )


def run_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, round, accuracy): share of an event type's readings within the threshold, by day."""
    kinds = F.array(*[F.lit(k) for k in EVENT_TYPES])
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("run"), F.array_position(kinds, F.col("event_type")) - 1).alias("run_id"),
        (F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")) + 1).cast("bigint").alias("round"),
        F.when(F.col("value") <= RUN_THRESHOLD, 100.0).otherwise(0.0).alias("hit"),
    ).groupBy("run_id", "round").agg(rounded(F.avg("hit"), 6).alias("accuracy"))


def supplier_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(client_id, score): a score in [0, 1) per supplier, about a third of them distrusted."""
    draw = uniform("score", F.col("s_suppkey"))
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("client_id"),
        F.when(draw < 0.3, draw * 0.03).otherwise(draw).alias("score"),
    )


def supplier_updates(spark: SparkSession, sf_dir: str, part: int | None = None) -> DataFrame:
    """(client_id, layer, idx, value): per supplier and class the mean of each feature of its order lines.

    ``part`` 1 or 2 takes one of two hashed halves of the lines.
    """
    raw = table(spark, sf_dir, "lineitem")
    if part is not None:
        half = uniform("half", F.col("l_orderkey"), F.col("l_linenumber")) < 0.5
        raw = raw.filter(half if part == 1 else ~half)
    means = [F.avg(c).alias(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")]
    wide = raw.groupBy(F.col("l_suppkey").alias("client_id"), F.concat("l_returnflag", "l_linestatus").alias("layer")).agg(*means)
    return wide.select(
        "client_id", "layer",
        F.posexplode(F.array("l_quantity", "l_extendedprice", "l_discount", "l_tax")).alias("pos", "value"),
    ).select("client_id", "layer", F.col("pos").cast("bigint").alias("idx"), "value")


def customer_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("client_id"), ((F.col("c_acctbal") + 1000.0) / 11000.0).alias("score")
    )


def embedding_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(client_id, layer, idx, value): each embedding is one client's update."""
    return embedding_rows(spark, sf_dir).select(
        F.col("row_id").alias("client_id"), F.lit("embedding").alias("layer"), F.posexplode("features").alias("pos", "value")
    ).select("client_id", "layer", F.col("pos").cast("bigint").alias("idx"), "value")


def secrets(clients: DataFrame, seed: str = "secret") -> DataFrame:
    """(client_id, secret) for every distinct client of ``clients``."""
    return clients.select("client_id").distinct().select(
        "client_id", F.unhex(F.sha2(F.concat_ws("|", F.lit(seed), F.col("client_id")), 256)).alias("secret")
    )
