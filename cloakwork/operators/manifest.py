"""Signed manifests: what was done to a document, with declared limits."""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import _constant_pads, _hmac_hex
from .policy import Policy

SCHEMA_ID = "cloakwork-manifest/1"
#: Declared in every artefact.
LIMITS = (
    "Detection does not find everything; some personal data may be left.",
    "Pseudonymised text can still identify people by inference from what is left.",
    "Pseudonymised data are still personal data.",
    "Text within images is not covered.",
)
AGENT_INSTRUCTION = "Tokens in brackets stand for personal data. Keep them exactly as they are, don't guess what they stand for, and don't make up new ones."


def sha256_of_file(path: str) -> str:
    with open(path, "rb") as file:
        return hashlib.file_digest(file, "sha256").hexdigest()


def manifests(results: DataFrame, policy: Policy, version: str) -> DataFrame:
    """(doc_id, manifest): a struct of facts and limits of each row of ``plans.pipeline.process``."""
    document = F.struct(F.col("doc_id").cast("string").alias("doc_id"), F.col("source_name").alias("source_name"), F.col("source_sha256").alias("source_sha256"), F.col("pages").alias("pages"))
    pipeline = F.struct(F.lit("cloakwork").alias("tool"), F.lit(version).alias("version"), F.lit("none").alias("egress"))
    rules = F.struct(F.lit(policy.sha256).alias("sha256"), F.lit(policy.profile).alias("profile"), F.lit(policy.mode).alias("mode"))
    outcome = F.struct("decision", "reasons", F.col("n_spans").alias("entities"), F.col("tokens_issued").alias("tokens_issued"), F.round("quality", 3).alias("quality"))
    whole = F.struct(F.lit(SCHEMA_ID).alias("schema"), document.alias("document"), pipeline.alias("pipeline"), rules.alias("policy"), outcome.alias("outcome"), F.sha2("safe_text", 256).alias("output_sha256"), F.array(*map(F.lit, LIMITS)).alias("limits"))
    return results.select("doc_id", whole.alias("manifest"))


def key_id(key: bytes) -> str:
    return hashlib.sha256(key).hexdigest()[:16]


def sign(documents: DataFrame, key: bytes) -> DataFrame:
    """``documents`` (with manifest) plus canonical, signature, algorithm and key_id. The signed string is stored, so checks never serialise again."""
    canonical = F.to_json("manifest", {"ignoreNullFields": "false"})
    signed = documents.withColumn("canonical", canonical)
    return signed.withColumn("signature", _hmac_hex(*_constant_pads(key), F.col("canonical"))).withColumn("algorithm", F.lit("HMAC-SHA256")).withColumn("key_id", F.lit(key_id(key)))


def verify(signed: DataFrame, key: bytes) -> DataFrame:
    """(doc_id, valid, reason)."""
    good = F.col("signature") == _hmac_hex(*_constant_pads(key), F.col("canonical"))
    reason = F.when(F.col("key_id") != key_id(key), "key").when(~good, "content")
    return signed.select("doc_id", reason.isNull().alias("valid"), reason.alias("reason"))


def sign_with_ed25519(message: bytes, private_key) -> bytes:
    """For installations with the ``cryptography`` package: a public-key signature of one manifest."""
    return private_key.sign(message)


def signature_of(message: str, key: bytes) -> str:
    return hmac.new(key, message.encode(), hashlib.sha256).hexdigest()


def source_sha256(content: Column) -> Column:
    return F.sha2(content, 256)
