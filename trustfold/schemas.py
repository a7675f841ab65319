"""Declared schemas of the tables the operators exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def _table(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


LABELED = _table(("row_id", T.LongType()), ("features", T.ArrayType(T.DoubleType())), ("label", T.IntegerType()))
DEALT = _table(
    ("row_id", T.LongType()), ("features", T.ArrayType(T.DoubleType())), ("label", T.IntegerType()),
    ("shard", T.LongType()), ("client_id", T.LongType()), ("ord", T.LongType()),
)
PARAMS = _table(("layer", T.StringType()), ("idx", T.LongType()), ("value", T.DoubleType()))
CLIENT_PARAMS = _table(
    ("client_id", T.LongType()), ("layer", T.StringType()), ("idx", T.LongType()), ("value", T.DoubleType())
)
PAIRING = _table(("verifier", T.LongType()), ("prover", T.LongType()))
PAIR_HISTORY = _table(("seq", T.LongType()), ("verifier", T.LongType()), ("prover", T.LongType()))
KEYS = _table(("client_id", T.LongType()), ("secret", T.BinaryType()))
OBSERVATIONS = _table(
    ("client_id", T.LongType()), ("round", T.LongType()), ("dist", T.DoubleType()), ("secure", T.BooleanType())
)
CREDIBILITY = _table(("client_id", T.LongType()), ("score", T.DoubleType()))
HISTORY = _table(
    ("run_id", T.StringType()), ("segment", T.IntegerType()), ("round", T.IntegerType()),
    ("client_id", T.LongType()), ("score", T.DoubleType()),
)
ACCURACY_LOG = _table(("round", T.IntegerType()), ("accuracy", T.DoubleType()), ("credibility_c0", T.DoubleType()))


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project ``df`` onto ``schema``; name every missing column at once."""
    missing = [f.name for f in schema.fields if f.name not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; have {df.columns}")
    return df.select([df[f.name].cast(f.dataType).alias(f.name) for f in schema.fields])
