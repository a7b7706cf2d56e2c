"""The vault: originals behind tokens, encrypted row by row."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.crypto import encrypt, key_column, try_decrypt
from ..operators.parse import cases_of
from ..operators.redact import MAPPINGS_TYPE
from ..session import staged
from .commits import read_batches, write_batch
from .store import write_case_store

VAULT_SCHEMA = "case_id string, ingest_seq bigint, key_id string, payload string, batch_id string"

MAX_BROADCAST_KEYS = 10_000


def owner() -> Column:
    """What a payload is bound to: its case and the write that made it."""
    return F.concat_ws("\n", F.col("case_id"), F.coalesce(F.col("ingest_seq").cast("string"), F.lit("")))


def seal(vault: DataFrame, keys: DataFrame, key_id: str) -> DataFrame:
    """(case_id, ingest_seq, mappings) with the mappings as an encrypted ``payload``.

    A payload is bound to its case and write: in another row it cannot be read.
    """
    payload = encrypt(F.to_json("mappings"), key_column(keys, key_id), owner())
    return vault.select("case_id", "ingest_seq", F.lit(key_id).alias("key_id"), payload.alias("payload"))


def unseal(sealed: DataFrame, keys: DataFrame) -> DataFrame:
    """Mappings of sealed rows; ``readable`` is false where the key is unknown or wrong, or the payload is damaged or another
    row's."""
    # Nearly all rows name the same key: a key table too long to be sent whole is repeated once per part of the rows.
    if keys.limit(MAX_BROADCAST_KEYS + 1).count() <= MAX_BROADCAST_KEYS:
        with_key = sealed.join(F.broadcast(keys), "key_id", "left")
    else:
        parts = int(sealed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        repeated = keys.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        dealt = sealed.withColumn("_part", F.pmod(F.xxhash64("case_id", "ingest_seq"), F.lit(parts)).cast("int"))
        with_key = dealt.join(repeated, ["key_id", "_part"], "left")
    opened = with_key.withColumn("_json", try_decrypt(F.col("payload"), F.col("key"), owner()))
    return opened.select("case_id", "ingest_seq", F.from_json("_json", MAPPINGS_TYPE).alias("mappings"),
                         F.col("_json").isNotNull().alias("readable"))


def write_vault(vault: DataFrame, path: str, keys: DataFrame, key_id: str, batch: str | None = None) -> None:
    """Seal mappings and add them as one batch; a repeated batch replaces its rows."""
    write_batch(seal(vault, keys, key_id), path, batch)


def write_ingested(done: DataFrame, store: str, vault: str, keys: DataFrame, key_id: str, batch: str | None = None) -> DataFrame:
    """Write an ingest to a case store and a sealed vault as one batch; returns the written case rows with ``tokens``.

    Texts are parsed, redacted and sealed once, into a table of the shared folder from which both are taken: no original is
    on any disk unsealed.  A batch that failed half-way is repeated under its name and leaves nothing twice.
    """
    batch = batch or uuid.uuid4().hex
    tokens = F.coalesce(F.size("mappings"), F.lit(0))
    payload = F.when(tokens > 0, encrypt(F.to_json("mappings"), key_column(keys, key_id), owner()))
    # Raw text is not among the kept columns.
    once = staged(done.select(*cases_of(done).columns, tokens.alias("tokens"), payload.alias("payload")), "ingested")
    # Originals first: a failure between the two leaves no case without them.
    write_batch(once.filter(F.col("payload").isNotNull()).select("case_id", "ingest_seq", F.lit(key_id).alias("key_id"), "payload"),
                vault, batch)
    write_case_store(cases_of(once), store, batch)
    return once.drop("payload")


def read_sealed(spark: SparkSession, path: str) -> DataFrame:
    return read_batches(spark, path, VAULT_SCHEMA).drop("batch_id")


def read_vault(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    return unseal(read_sealed(spark, path), keys)


def unreadable_count(vault: DataFrame) -> int:
    """Rows that could not be decrypted: reported, not hidden."""
    return vault.filter(~F.col("readable")).count()


def transfer(sealed: DataFrame, keys: DataFrame, to_key_id: str) -> DataFrame:
    """The same mappings under another key, for handing a vault to another team.  Unreadable rows are an error."""
    opened = unseal(sealed, keys)
    checked = opened.select("case_id", "ingest_seq", F.when(F.col("readable"), F.col("mappings")).otherwise(
        F.raise_error(F.concat(F.lit("cannot decrypt the vault entry of "), F.col("case_id"))).cast(MAPPINGS_TYPE)
    ).alias("mappings"))
    return seal(checked, keys, to_key_id)


def rotate(sealed: DataFrame, keys: DataFrame, chain: Sequence[str]) -> DataFrame:
    """All rows under the last key of ``chain``: those under an earlier one are sealed anew, in one pass over them.

    Rows under keys outside the chain stay as they are.  The keys of the chain must be in ``keys`` until this is written.
    """
    old = F.coalesce(F.col("key_id").isin(list(chain[:-1])), F.lit(False))
    return transfer(sealed.filter(old), keys, chain[-1]).unionByName(sealed.filter(~old))


def merge(own: DataFrame, imported: DataFrame) -> DataFrame:
    """Own and imported vault rows as one history; a write may be in both, and the joins reduce it to one row."""
    return own.unionByName(imported)
