"""Sealed samples, signed updates and proof flags as column operators.

Clients hold symmetric secrets (32 bytes) handed in as a table. That gives
confidentiality and integrity among holders of a secret; it is not a
signature a third party could check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trustfold.functions.sizing import broadcast_if_small

CHUNK_ROWS = 512
CELLS_PER_BLOCK = 4096
#: Cells are signed as integers of this many decimals, so both sides hash the same text.
SIGNED_DECIMALS = 9
#: Hexadecimal digits of a SHA-256 digest.
DIGEST_CHARS = 64
PAYLOAD = "array<struct<pos:bigint,row_id:bigint,features:array<double>,label:int>>"


def deliver(subsets: DataFrame, pairing: DataFrame, clients: int | None = None) -> DataFrame:
    """(verifier, prover, pos, row_id, features, label): each verifier gets its prover's sample.

    ``clients`` here and below is the number of clients where the caller knows it.
    """
    sent = subsets.withColumnRenamed("client_id", "prover")
    return sent.join(broadcast_if_small(pairing.select("verifier", "prover"), clients), "prover").select(
        "verifier", "prover", "pos", "row_id", "features", "label"
    )


def with_key(
    df: DataFrame, keys: DataFrame, client: str, out: str = "secret", clients: int | None = None
) -> DataFrame:
    """Add the secret of the client named in column ``client``."""
    named = keys.select(F.col("client_id").alias(client), F.col("secret").alias(out))
    return df.join(broadcast_if_small(named, clients), client)


def _seal_digest(payload: str, round_no: Column) -> Column:
    """Hex digest that only a holder of the data key can make; it is checked before the rows are read."""
    parts = [F.hex("_data_key"), round_no.cast("string"), "verifier", "prover", "chunk", payload]
    return F.sha2(F.concat_ws("|", *parts), 256)


def seal(
    delivered: DataFrame, keys: DataFrame, round_no: int = 1, chunk_rows: int = CHUNK_ROWS, clients: int | None = None
) -> DataFrame:
    """(round, verifier, prover, chunk, m_t, m_tilde_t, iv): samples under AES-256-CBC.

    A fresh data key per chunk, derived from the prover's secret, encrypts
    the rows; the data key travels wrapped under the verifier's secret. The
    plain text begins with a digest of data key, round, pair, chunk and rows.
    """
    payload = F.to_json(F.array_sort(F.collect_list(F.struct("pos", "row_id", "features", "label"))))
    packed = (
        delivered.withColumn("chunk", F.expr(f"cast(pos div {chunk_rows}L as int)"))
        .groupBy("verifier", "prover", "chunk").agg(payload.alias("payload"))
    )
    keyed = with_key(packed, keys, "prover", "_sender", clients)
    keyed = with_key(keyed, keys, "verifier", "_recipient", clients)
    context = F.concat_ws("|", F.hex("_sender"), F.lit(str(round_no)), "verifier", "prover", "chunk")
    keyed = keyed.withColumn("_data_key", F.unhex(F.sha2(context, 256)))
    keyed = keyed.withColumn("iv", F.unhex(F.md5(F.concat(F.lit("iv|"), F.hex("_data_key")))))
    return keyed.select(
        F.lit(round_no).alias("round"), "verifier", "prover", "chunk",
        F.aes_encrypt(F.concat(_seal_digest("payload", F.lit(round_no)), "payload"), "_data_key", F.lit("CBC"), F.lit("PKCS"), "iv").alias("m_t"),
        F.aes_encrypt("_data_key", "_recipient", F.lit("GCM"), F.lit("DEFAULT"), F.substring("iv", 1, 12)).alias(
            "m_tilde_t"
        ),
        "iv",
    )


def open_packages(packages: DataFrame, keys: DataFrame, clients: int | None = None) -> DataFrame:
    """Packages with ``rows``: the decrypted sample, NULL where key or data do not fit."""
    keyed = with_key(packages, keys, "verifier", "_recipient", clients)
    data_key = F.try_aes_decrypt("m_tilde_t", "_recipient", F.lit("GCM"), F.lit("DEFAULT"))
    keyed = keyed.withColumn("_data_key", data_key)
    text = F.try_aes_decrypt("m_t", "_data_key", F.lit("CBC"), F.lit("PKCS")).cast("string")
    keyed = keyed.withColumn("_text", text).withColumn("_payload", F.substring("_text", DIGEST_CHARS + 1, 2**31 - 1))
    genuine = F.substring("_text", 1, DIGEST_CHARS) == _seal_digest("_payload", F.col("round"))
    rows = F.when(genuine, F.from_json("_payload", PAYLOAD))
    return keyed.withColumn("rows", rows).drop("_recipient", "_data_key", "_text", "_payload")


def open_(packages: DataFrame, keys: DataFrame, clients: int | None = None) -> DataFrame:
    """The delivered rows again; a pair with an unreadable package gives none, as part of a sample is no sample."""
    opened = open_packages(packages, keys, clients)
    # a pair's packages are one sample, whose size is a parameter of the delivery
    whole = F.min(F.col("rows").isNotNull()).over(Window.partitionBy("verifier", "prover"))
    return opened.withColumn("_whole", whole).filter("_whole").select("verifier", "prover", F.inline("rows"))


def attest(
    updates: DataFrame, keys: DataFrame, cells_per_block: int = CELLS_PER_BLOCK, clients: int | None = None
) -> DataFrame:
    """(client_id, digest): keyed digest of all cells in (layer, idx) order.

    Blocks of cells are hashed first and the ordered block hashes next, so
    no task holds a whole model.
    """
    cell = F.round(F.col("value") * F.lit(10.0 ** SIGNED_DECIMALS)).try_cast("bigint")
    text = F.concat_ws(":", F.col("idx"), F.coalesce(cell.cast("string"), F.lit("nan")))
    blocks = (
        updates.select("client_id", "layer", "idx", text.alias("text"))
        .withColumn("block", F.expr(f"idx div {cells_per_block}L"))
        .groupBy("client_id", "layer", "block")
        .agg(F.array_sort(F.collect_list(F.struct("idx", "text"))).alias("cells"))
        .withColumn("hash", F.sha2(F.array_join(F.transform("cells", lambda c: c["text"]), ","), 256))
    )
    roots = blocks.groupBy("client_id").agg(
        F.array_sort(F.collect_list(F.struct("layer", "block", "hash"))).alias("hashes")
    )
    root = F.array_join(
        F.transform("hashes", lambda h: F.concat_ws(":", h["layer"], h["block"].cast("string"), h["hash"])), ","
    )
    return with_key(roots, keys, "client_id", clients=clients).select(
        "client_id", F.sha2(F.concat_ws("|", F.hex("secret"), F.sha2(root, 256)), 256).alias("digest")
    )


def verify(
    updates: DataFrame, attestations: DataFrame, keys: DataFrame, cells_per_block: int = CELLS_PER_BLOCK,
    clients: int | None = None,
) -> DataFrame:
    """(client_id, secure): true only where the recomputed digest equals the one sent."""
    fresh = attest(updates, keys, cells_per_block, clients).withColumnRenamed("digest", "_fresh")
    sent = attestations.select("client_id", "digest")
    joined = sent.join(fresh, "client_id", "full_outer")
    return joined.select("client_id", F.coalesce(F.col("digest") == F.col("_fresh"), F.lit(False)).alias("secure"))


def proof_ok(proof: str | Column, flag: str = "zkp_status") -> Column:
    """False for a missing package or flag, else the flag."""
    package = F.col(proof) if isinstance(proof, str) else proof
    return F.coalesce(F.try_element_at(package, F.lit(flag)), F.lit(False))
