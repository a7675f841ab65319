"""Sealing, signing, verifying, proof flags."""

import pytest
from pyspark.sql import functions as F

from trustfold.operators import exchange


@pytest.fixture(scope="module")
def keys(spark):
    return spark.range(4).select(F.col("id").alias("client_id"), F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("secret"))


@pytest.fixture(scope="module")
def delivered(spark):
    pos = F.col("id") % 10
    return spark.range(40).select(
        F.floor(F.col("id") / 10).alias("verifier"), ((F.floor(F.col("id") / 10) + 1) % 4).alias("prover"),
        pos.alias("pos"), F.col("id").alias("row_id"),
        F.array(F.col("id") / 7.0, F.lit(0.1) + F.col("id"), F.lit(float("-inf"))).alias("features"),
        (F.col("id") % 3).cast("int").alias("label"),
    )


def _plain(df):
    return sorted(tuple(map(str, r)) for r in df.select("verifier", "prover", "pos", "row_id", "features", "label").collect())


def test_round_trip(delivered, keys):
    packages = exchange.seal(delivered, keys, chunk_rows=4)
    assert packages.count() == 12
    assert _plain(exchange.open_(packages, keys)) == _plain(delivered)


def test_wrong_key_or_damaged_package_gives_nothing(delivered, keys):
    packages = exchange.seal(delivered, keys)
    other = keys.withColumn("secret", F.unhex(F.sha2(F.concat(F.lit("x"), F.col("client_id")), 256)))
    assert exchange.open_packages(packages, other).filter(F.col("rows").isNotNull()).isEmpty()
    damaged = packages.withColumn("m_tilde_t", F.reverse(F.col("m_tilde_t").cast("string")).cast("binary"))
    assert exchange.open_(damaged, keys).isEmpty()


def test_rounds_use_different_data_keys(delivered, keys):
    one, two = [exchange.seal(delivered, keys, r).select("verifier", F.hex("m_t")).collect() for r in (1, 2)]
    assert not set(r[1] for r in one) & set(r[1] for r in two)


@pytest.fixture(scope="module")
def updates(spark):
    return spark.range(400).select(
        (F.col("id") % 4).alias("client_id"), F.when(F.col("id") < 100, "bias").otherwise("weight").alias("layer"),
        F.floor(F.col("id") / 4).alias("idx"), (F.col("id") / 3.0).alias("value"),
    )


def _secure(updates, sent, keys):
    return {r["client_id"]: r["secure"] for r in exchange.verify(updates, sent, keys).collect()}


def test_verification_catches_every_change(updates, keys):
    sent = exchange.attest(updates, keys)
    assert _secure(updates.repartition(9), sent, keys) == dict.fromkeys(range(4), True)
    changed = updates.withColumn(
        "value", F.when((F.col("client_id") == 0) & (F.col("idx") == 5), F.col("value") + 1e-6).otherwise(F.col("value"))
    ).filter(~((F.col("client_id") == 1) & (F.col("idx") == 7)))
    wrong = keys.withColumn("secret", F.when(F.col("client_id") == 2, F.unhex(F.lit("00"))).otherwise(F.col("secret")))
    assert _secure(changed, sent, wrong) == {0: False, 1: False, 2: False, 3: True}
    assert _secure(updates, sent.filter("client_id <> 3"), keys)[3] is False
    assert _secure(updates.filter("client_id <> 3"), sent, keys)[3] is False


def test_values_that_are_no_numbers_can_be_signed(spark, keys):
    odd = spark.createDataFrame([(0, "w", 0, float("nan")), (0, "w", 1, float("inf"))], "client_id bigint, layer string, idx bigint, value double")
    assert _secure(odd, exchange.attest(odd, keys), keys) == {0: True}


def test_proof_flags(spark):
    df = spark.createDataFrame(
        [(0, None), (1, {}), (2, {"zkp_status": True}), (3, {"zkp_status": False})], "i int, p map<string,boolean>"
    )
    assert [r[0] for r in df.orderBy("i").select(exchange.proof_ok("p")).collect()] == [False, False, True, False]


def test_one_bad_chunk_voids_the_whole_sample(delivered, keys):
    packages = exchange.seal(delivered, keys, chunk_rows=4)
    bad = (F.col("verifier") == 2) & (F.col("chunk") == 1)
    broken = packages.withColumn("m_tilde_t", F.when(bad, F.lit(b"x")).otherwise(F.col("m_tilde_t")))
    assert {r["verifier"] for r in exchange.open_(broken, keys).collect()} == {0, 1, 3}


def test_a_flipped_bit_is_noticed_where_the_text_still_parses(delivered, keys):
    packages = exchange.seal(delivered, keys)
    # the message begins with the initial vector, of which one bit flips one bit of the first plain block and nothing else
    first = F.conv(F.hex(F.substring("m_t", 1, 1)), 16, 10).cast("int").bitwiseXOR(F.lit(1))
    altered = packages.withColumn("m_t", F.concat(F.unhex(F.hex(first)), F.substring("m_t", 2, 2**31 - 1)))
    assert exchange.open_packages(altered, keys).filter(F.col("rows").isNotNull()).isEmpty()
