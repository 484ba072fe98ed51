"""Checksum validators as column expressions; each takes the value as written."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .strings import remove

ALNUM = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# What a character of ALNUM counts at an odd place of a tax code.
ODD = (1, 0, 5, 7, 9, 13, 15, 17, 19, 21, 1, 0, 5, 7, 9, 13, 15, 17, 19, 21, 2, 4, 18, 20, 11, 3, 6, 8, 12, 14, 16, 10, 22, 25, 24, 23)
EVEN = (0, 1, 2, 3, 4, 5, 6, 7, 8, 9, *range(26))
MONTHS = "ABCDEHLMPRST"
OMOCODIA_FROM, OMOCODIA_TO = "LMNPQRSTUV", "0123456789"
OMOCODIA_PLACES = (6, 7, 9, 10, 12, 13, 14)  # from 0
# Lengths of bank account numbers by country.
IBAN_LENGTHS = {
    "IT": 27, "SM": 27, "FR": 27, "DE": 22, "ES": 24, "PT": 25, "NL": 18, "BE": 16, "AT": 20, "IE": 22, "LU": 20,
    "FI": 18, "GR": 27, "CH": 21, "GB": 22, "PL": 28, "SE": 24, "DK": 18, "NO": 15, "CZ": 24, "HR": 21, "SI": 19,
    "SK": 24, "RO": 24, "BG": 22, "HU": 28, "LT": 20, "LV": 21, "EE": 20, "MT": 31, "CY": 28,
}
PLATE = "[ABCDEFGHJKLMNPRSTVWXYZ]"


def normalize(value: Column) -> Column:
    """Capitals without spaces, hyphens and dots."""
    return F.upper(remove(value, r"(?U)[\s\-.]"))


def normalize_iban(value: Column) -> Column:
    return F.upper(remove(value, r"(?U)[\s\-]"))


def _at(text: Column, i: Column | int) -> Column:
    """The place of a character in ALNUM, from 0 (-1: none)."""
    return F.call_function("instr", F.lit(ALNUM), F.substring(text, i if isinstance(i, Column) else F.lit(i), F.lit(1))) - 1


def cf_check_char(first15: Column) -> Column:
    """The check letter of a tax code's first 15 characters; null for another length or character."""
    tables = F.array(*map(F.lit, EVEN)), F.array(*map(F.lit, ODD))
    total = F.aggregate(F.sequence(F.lit(1), F.lit(15)), F.lit(0), lambda a, i: a + F.when(i % 2 == 1, F.get(tables[1], _at(first15, i))).otherwise(F.get(tables[0], _at(first15, i))))
    return F.when(first15.rlike(r"\A[0-9A-Z]{15}\z"), F.chr(F.lit(65) + total % 26))


def validate_cf(value: Column) -> Column:
    cf = normalize(value)
    day = F.substring(cf, 10, 2).cast("int")
    shaped = cf.rlike(rf"\A[A-Z]{{6}}[0-9]{{2}}[{MONTHS}][0-9]{{2}}[A-Z][0-9]{{3}}[A-Z]\z")
    good_day = day.between(1, 31) | day.between(41, 71)
    return F.coalesce(F.when(shaped, good_day & (cf_check_char(F.substring(cf, 1, 15)) == F.substring(cf, 16, 1))), F.lit(False))


def decode_omocodia(value: Column) -> Column:
    """The digits that letters stand for in a tax code of 16 characters; others are only normalised."""
    cf = normalize(value)
    each = [F.translate(F.substring(cf, i + 1, 1), OMOCODIA_FROM, OMOCODIA_TO) if i in OMOCODIA_PLACES else F.substring(cf, i + 1, 1) for i in range(16)]
    return F.when(F.length(cf) == 16, F.concat(*each)).otherwise(cf)


def validate_piva(value: Column) -> Column:
    """Eleven digits whose weights are those of the Luhn sum."""
    piva = remove(value, r"(?U)[\s\-.]")
    return F.coalesce(F.when(piva.rlike(r"\A[0-9]{11}\z"), F.call_function("luhn_check", piva)), F.lit(False))


def validate_iban(value: Column) -> Column:
    iban = normalize_iban(value)
    length = F.try_element_at(F.create_map(*[F.lit(x) for pair in IBAN_LENGTHS.items() for x in pair]), F.substring(iban, 1, 2))
    turned = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))

    def step(rest: Column, i: Column) -> Column:
        v = _at(turned, i)
        return F.when(v < 10, (rest * 10 + v) % 97).otherwise((rest * 100 + v) % 97)

    mod = F.aggregate(F.sequence(F.lit(1), F.length(iban)), F.lit(0), step)
    return F.coalesce(F.when(iban.rlike(r"\A[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}\z") & F.coalesce(F.length(iban) == length, F.lit(True)), mod == 1), F.lit(False))


def validate_luhn(value: Column) -> Column:
    digits = remove(value, r"(?U)[\s\-]")
    return F.coalesce(F.when(digits.rlike(r"\A[0-9]{12,19}\z"), F.call_function("luhn_check", digits)), F.lit(False))


def validate_targa(value: Column) -> Column:
    return F.coalesce(normalize(value).rlike(rf"\A{PLATE}{{2}}[0-9]{{3}}{PLATE}{{2}}\z"), F.lit(False))


def validate_ts(value: Column) -> Column:
    return F.coalesce(remove(value, r"(?U)[\s\-]").rlike(r"\A80380[0-9]{15}\z"), F.lit(False))


VALIDATORS: dict[str, Callable[[Column], Column]] = {
    "IT_CODICE_FISCALE": validate_cf,
    "IT_PARTITA_IVA": validate_piva,
    "IBAN": validate_iban,
    "CREDIT_CARD": validate_luhn,
    "IT_TARGA": validate_targa,
    "IT_TESSERA_SANITARIA": validate_ts,
}
