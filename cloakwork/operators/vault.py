"""The vault: token maps encrypted per document, whose keys can be destroyed.

A document's map is sealed with AES-256-GCM under a key of its own, which is
sealed under a master key. Both tables live apart: forgetting a document
deletes its row of keys, and the sealed map is then of no use.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lineage import cut

#: Cost of deriving a master key from a passphrase.
SCRYPT = {"n": 1 << 14, "r": 8, "p": 1, "dklen": 32}


def derive_key(passphrase: str, salt: bytes) -> bytes:
    return hashlib.scrypt(passphrase.encode(), salt=salt, **SCRYPT)


def master_key(passphrase: str | None = None, salt: bytes = b"cloakwork-vault", keyring: dict[str, bytes] | None = None, key_file: str | None = None, variable: str | None = None) -> bytes:
    """32 bytes from the first source that is given: passphrase, keyring, environment variable, key file (made with mode 600 if missing)."""
    if passphrase is not None:
        return derive_key(passphrase, salt)
    if keyring and "vault" in keyring:
        return keyring["vault"]
    if variable is not None:
        if not os.environ.get(variable):
            raise ValueError(f"{variable} holds no key")
        return bytes.fromhex(os.environ[variable])
    if key_file is None:
        raise ValueError("no source of a vault key")
    if not os.path.exists(key_file):
        with os.fdopen(os.open(key_file, os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o600), "wb") as file:
            file.write(os.urandom(32))
    with open(key_file, "rb") as file:
        return file.read()


def _aad(doc_id: Column) -> Column:
    return doc_id.cast("string")


def _drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.append_column("key", pa.array([os.urandom(32) for _ in range(batch.num_rows)], pa.binary()))


def data_keys(documents: DataFrame, master: bytes) -> DataFrame:
    """(doc_id, sealed_key): a fresh random key for each document, sealed with the master key.

    The keys cannot be made again. They are drawn and sealed once, into a
    checkpoint, so that every use and every retried task sees the same ones; keep
    the table, since maps sealed with other keys stay closed.
    """
    ids = documents.select("doc_id").distinct()
    drawn = ids.mapInArrow(_drawn, f"doc_id {ids.schema['doc_id'].dataType.simpleString()}, key binary")
    sealed = F.aes_encrypt("key", F.lit(master), F.lit("GCM"), F.lit("DEFAULT"), F.expr("CAST('' AS BINARY)"), _aad(F.col("doc_id")))
    return cut(drawn.select("doc_id", sealed.alias("sealed_key")))


def _opened(sealed: Column, master: bytes, doc_id: Column) -> Column:
    return F.try_aes_decrypt(sealed, F.lit(master), F.lit("GCM"), F.lit("DEFAULT"), _aad(doc_id))


def store(tokens: DataFrame, keys: DataFrame, master: bytes, created_at: Column, ttl_days: int = 90) -> DataFrame:
    """(doc_id, ciphertext, created_at, ttl_days): each document's token map, sealed."""
    entries = F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("token", "original")))))
    maps = tokens.groupBy("doc_id").agg(entries.alias("__plain")).join(keys, "doc_id")
    key = _opened(F.col("sealed_key"), master, F.col("doc_id"))
    sealed = F.aes_encrypt(F.encode("__plain", "UTF-8"), key, F.lit("GCM"), F.lit("DEFAULT"), F.expr("CAST('' AS BINARY)"), _aad(F.col("doc_id")))
    return maps.select("doc_id", sealed.alias("ciphertext"), created_at.alias("created_at"), F.lit(ttl_days).alias("ttl_days"))


def load(vault: DataFrame, keys: DataFrame, master: bytes) -> DataFrame:
    """(doc_id, token, original) of the documents whose keys are still there and open with ``master``."""
    key = _opened(F.col("sealed_key"), master, F.col("doc_id"))
    joined = vault.join(keys, "doc_id").withColumn("__key", key).where(F.col("__key").isNotNull())
    plain = F.decode(F.try_aes_decrypt("ciphertext", F.col("__key"), F.lit("GCM"), F.lit("DEFAULT"), _aad(F.col("doc_id"))), "UTF-8")
    return joined.select("doc_id", F.explode(F.from_json(plain, "map<string,string>")).alias("token", "original"))


def forget(keys: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """The keys that are left when those of ``doc_ids`` are destroyed."""
    return keys.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_anti")


def purge_expired(vault: DataFrame, now: Column) -> DataFrame:
    """The rows of ``vault`` whose time is up at ``now``."""
    return vault.where(F.col("created_at") + F.make_dt_interval(F.col("ttl_days")) < now)
