"""Canonical forms, keyed tokens and generalisation, as column expressions.

A token is the start of HMAC-SHA-256 over type and canonical form. Spark has no
``hmac``; it is ``sha2`` twice over padded keys. The key of a document is
derived from a master key and its id, so a recomputed task gives the same
tokens and no table of keys is needed; a constant key can be given instead.
"""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import ABBREVIATIONS, lookup
from .checksums import decode_omocodia, normalize
from .strings import digits_of, squeeze, strip, without_accents

OPEN, CLOSE = "⟦", "⟧"
OMITTED = {"year": "[data]", "month": "[data]", "region": "[località]", "domain": "[email]", "other": "[omissis]"}
IPAD, OPAD = 0x36, 0x5C


def canonical_form(text: Column, entity_type: Column) -> Column:
    """What different spellings of one value have in common."""
    value = strip(text)
    plain = F.upper(without_accents(value))
    spaced = squeeze(F.regexp_replace(plain, r"(?U)[^\w\s]", " "))
    digits = digits_of(value)
    return (
        F.when(entity_type == "IT_CODICE_FISCALE", decode_omocodia(value))
        .when(entity_type.isin("IT_PARTITA_IVA", "IBAN", "CREDIT_CARD", "IT_TARGA", "IT_TESSERA_SANITARIA"), normalize(value))
        .when(entity_type == "EMAIL", F.lower(value))
        .when(entity_type == "PHONE", F.when(F.length(digits) > 10, F.substring(digits, -10, 10)).otherwise(digits))
        .when(entity_type.isin("PERSON", "ORGANIZATION"), F.array_join(F.array_sort(F.split(spaced, " ")), " "))
        .when(entity_type.isin("ADDRESS", "LOCATION"), spaced)
        .when(entity_type.isin("DATE", "DATE_OF_BIRTH"), digits)
        .otherwise(strip(plain))
    )


def _hmac_hex(inner: Column, outer: Column, message: Column) -> Column:
    """``inner`` and ``outer`` are the padded keys (binary)."""
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))), 256)


def _constant_pads(key: bytes) -> tuple[Column, Column]:
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    return tuple(F.unhex(F.lit(bytes(b ^ pad for b in key).hex())) for pad in (IPAD, OPAD))


def _derived_pads(key_hex: Column) -> tuple[Column, Column]:
    """Pads of a 32-byte key given in hex: XOR in four longs, then 32 bytes of bare padding."""
    out = []
    for pad in (IPAD, OPAD):
        word = F.lit(int.from_bytes(bytes([pad]) * 8, "big"))
        parts = [F.lpad(F.hex(F.conv(F.substring(key_hex, 1 + 16 * k, 16), 16, -10).cast("bigint").bitwiseXOR(word)), 16, "0") for k in range(4)]
        out.append(F.unhex(F.concat(*parts, F.lit(bytes([pad]).hex() * 32))))
    return tuple(out)


def document_salt(master: bytes, doc_id: Column) -> Column:
    """The key of one document, in hex."""
    return _hmac_hex(*_constant_pads(master), doc_id.cast("string"))


def canonical_digest(canonical: Column, entity_type: Column, salt: bytes | Column) -> Column:
    """64 hex digits of a canonical form; ``salt`` is a constant key or a column of 32-byte keys in hex."""
    pads = _constant_pads(salt) if isinstance(salt, bytes) else _derived_pads(salt)
    return _hmac_hex(*pads, F.concat(entity_type, F.lit("\0"), canonical))


def token_digest(text: Column, entity_type: Column, salt: bytes | Column) -> Column:
    return canonical_digest(canonical_form(text, entity_type), entity_type, salt)


def token_of(digest: Column, entity_type: Column, length: Column | int = 4, ascii_only: bool = False) -> Column:
    left, right = ("[[", "]]") if ascii_only else (OPEN, CLOSE)
    short = F.coalesce(lookup(ABBREVIATIONS, entity_type), F.substring(entity_type, 1, 4))
    return F.concat(F.lit(left), short, F.lit("_"), F.substring(digest, F.lit(1), F.lit(length) if isinstance(length, int) else length), F.lit(right))


def make_token(text: Column, entity_type: Column, salt: bytes | Column, length: int = 4, ascii_only: bool = False) -> Column:
    return token_of(token_digest(text, entity_type, salt), entity_type, length, ascii_only)


def token_hmac(message: bytes, key: bytes) -> str:
    """The same digest on the driver, for tests and keys."""
    return hmac.new(key, message, hashlib.sha256).hexdigest()


def generalize(text: Column, target: Column) -> Column:
    """A value of less precision."""
    year = F.regexp_extract(text, r"((?:19|20)[0-9]{2})", 1)
    numbers = F.regexp_extract_all(text, F.lit(r"[0-9]+"), F.lit(0))
    return (
        F.when(target == "year", F.when(year != "", year).otherwise(OMITTED["year"]))
        .when(target == "month", F.when(F.size(numbers) >= 3, F.concat_ws("/", F.get(numbers, F.lit(1)), F.get(numbers, F.lit(2)))).otherwise(OMITTED["month"]))
        .when(target == "municipality", strip(F.regexp_replace(text, r"(?U)[,\s]+n?\.?\s*\d+[/\w]*\s*\z", "")))
        .when(target == "region", F.lit(OMITTED["region"]))
        .when(target == "domain", F.when(F.instr(text, "@") > 0, F.concat(F.lit("[utente]@"), F.regexp_extract(text, r"(?s)@(.*)", 1))).otherwise(OMITTED["domain"]))
        .otherwise(F.lit(OMITTED["other"]))
    )
