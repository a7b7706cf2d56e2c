"""AES column functions and the text forms in which ciphertext is stored."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEY_SCHEMA = pa.schema([("key_id", pa.string()), ("key", pa.binary())])


def key_table(spark: SparkSession, **hex_keys: str) -> DataFrame:
    """Named 256-bit keys, given as 64 hex digits, as a table."""
    rows: list[dict] = []
    for name, digits in hex_keys.items():
        key = bytes.fromhex(digits)
        if len(key) != 32:
            raise ValueError(f"key {name!r} must have 64 hex digits")
        rows.append({"key_id": name, "key": key})
    return spark.createDataFrame(pa.Table.from_pylist(rows, KEY_SCHEMA))


def key_column(keys: DataFrame, key_id: str) -> Column:
    """One key as a scalar subquery: the plan names the table, never the key."""
    return keys.where(F.col("key_id") == key_id).select("key").scalar()


def _bound_to(bound: Column | None) -> list[Column]:
    return [] if bound is None else [F.lit("DEFAULT"), bound]


def encrypt(text: Column, key: Column, bound: Column | None = None) -> Column:
    """AES-256-GCM as ``hex(iv):hex(tag):hex(ciphertext)``; the iv is random, so equal texts differ.

    ``bound`` is authenticated but not stored: only with the same value can the payload be read.  The pieces are cut with one
    regex so that the random value is drawn only once.
    """
    more = [F.lit("DEFAULT"), F.lit("").cast("binary"), bound] if bound is not None else []
    sealed = F.lower(F.hex(F.aes_encrypt(text, key, F.lit("GCM"), *more)))
    return F.regexp_replace(sealed, r"^(.{24})(.*)(.{32})$", "$1:$3:$2")


def _gcm_bytes(payload: Column) -> Column:
    parts = r"^([0-9a-fA-F]{24}):([0-9a-fA-F]{32}):([0-9a-fA-F]+)$"
    return F.when(F.rlike(payload, F.lit(parts)), F.unhex(F.regexp_replace(payload, parts, "$1$3$2")))


def decrypt(payload: Column, key: Column, bound: Column | None = None) -> Column:
    """The text; a malformed payload, a wrong key or another ``bound`` is an error."""
    data = F.coalesce(_gcm_bytes(payload), F.when(
        payload.isNotNull(), F.raise_error(F.lit("invalid ciphertext format")).cast("binary")))
    return F.aes_decrypt(data, key, F.lit("GCM"), *_bound_to(bound)).cast("string")


def try_decrypt(payload: Column, key: Column, bound: Column | None = None) -> Column:
    """The text, or NULL for a malformed payload, a wrong key or another ``bound``."""
    return F.try_aes_decrypt(_gcm_bytes(payload), key, F.lit("GCM"), *_bound_to(bound)).cast("string")


def encrypt_cbc(text: Column, key: Column) -> Column:
    """The older form: AES-256-CBC as ``hex(iv):hex(ciphertext)``."""
    sealed = F.lower(F.hex(F.aes_encrypt(text, key, F.lit("CBC"))))
    return F.regexp_replace(sealed, r"^(.{32})(.*)$", "$1:$2")


def decrypt_cbc(payload: Column, key: Column) -> Column:
    """The text, or an empty JSON object if it cannot be read."""
    parts = r"^([0-9a-fA-F]{32}):([0-9a-fA-F]+)$"
    data = F.when(F.rlike(payload, F.lit(parts)), F.unhex(F.regexp_replace(payload, parts, "$1$2")))
    return F.coalesce(F.try_aes_decrypt(data, key, F.lit("CBC")).cast("string"), F.lit("{}"))
