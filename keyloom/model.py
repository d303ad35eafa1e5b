"""Schemas of the typed keyspace tables. Every table is keyed by (db, key)."""

from __future__ import annotations

from pyspark.sql import types as T

KEY = ["db", "key"]

_BASE = [T.StructField("db", T.IntegerType(), False), T.StructField("key", T.StringType(), False)]


def _table(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([*_BASE, *(T.StructField(n, t) for n, t in fields)])


SCHEMAS = {
    "ks_meta": _table(("type", T.StringType()), ("expire_at", T.TimestampNTZType()), ("version", T.LongType()), ("last_access", T.TimestampNTZType()), ("freq", T.IntegerType()), ("size", T.LongType())),
    "ks_string": _table(("value", T.StringType())),
    "ks_hash": _table(("field", T.StringType()), ("value", T.StringType())),
    "ks_list": _table(("pos", T.LongType()), ("value", T.StringType())),
    "ks_set": _table(("member", T.StringType())),
    "ks_zset": _table(("member", T.StringType()), ("score", T.DoubleType())),
    "ks_stream": _table(("ms", T.LongType()), ("seq", T.LongType()), ("fields", T.MapType(T.StringType(), T.StringType()))),
    "ks_group": _table(("grp", T.StringType()), ("last_ms", T.LongType()), ("last_seq", T.LongType())),
    "ks_pending": _table(("grp", T.StringType()), ("consumer", T.StringType()), ("ms", T.LongType()), ("seq", T.LongType()), ("delivered_at", T.TimestampNTZType())),
    "ks_bitmap": _table(("bit", T.LongType())),
    "ks_hll": _table(("sketch", T.BinaryType())),
    "ks_geo": _table(("member", T.StringType()), ("lon", T.DoubleType()), ("lat", T.DoubleType()), ("score", T.LongType())),
    "changelog": _table(("seq", T.LongType()), ("op", T.StringType()), ("value", T.StringType())),
}
