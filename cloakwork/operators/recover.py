"""Repair of identifiers that optical recognition damaged, guided by their checksum.

Only candidates whose checksum failed come here, through one Arrow UDF: the
search over possible readings has no form in built-in expressions. Characters
outside their place's class must change; where the text around supports the
type, one or two characters inside their class may change as well.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations, islice, product

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..functions.checksums import ALNUM, EVEN, MONTHS, ODD
from ..types import OCR_RECOVERY, UNVALIDATED
from . import detect
from .detect import any_of

# What a character may have been, by the class that its place needs.
TO_DIGIT = {
    "O": "0", "Q": "0", "D": "0", "U": "0", "I": "1", "L": "1", "J": "1", "|": "1", "!": "1", "T": "71", "Z": "2", "R": "2",
    "E": "3", "A": "4", "S": "5", "G": "69", "?": "7", "B": "8",
}
TO_LETTER = {"0": "OQD", "1": "ILT", "2": "ZR", "3": "EB", "4": "A", "5": "S", "6": "GC", "7": "TI", "8": "B", "9": "GQ", "|": "I"}
DIGIT_DIGIT = {"0": "869", "1": "74", "2": "7", "3": "895", "4": "91", "5": "683", "6": "850", "7": "12", "8": "0639", "9": "0843"}
LETTER_LETTER = {
    "A": "RH", "B": "RPE", "C": "GOE", "D": "OBP", "E": "FBC", "F": "EPT", "G": "COQ", "H": "NMA", "I": "LJT", "J": "IL", "K": "RX", "L": "IC", "M": "NHW",
    "N": "MHW", "O": "QDCG", "P": "RFD", "Q": "OG", "R": "BPK", "S": "G", "T": "IYF", "U": "VO", "V": "UYW", "W": "VMN", "X": "KY", "Y": "VTX", "Z": "S",
}
SHAPES = {"IT_CODICE_FISCALE": "LLLLLLDDLDDLDDDL", "IT_PARTITA_IVA": "D" * 11, "IT_TARGA": "LLDDDLL"}
HINTS = {
    "IT_CODICE_FISCALE": ("codice fiscale", "cod. fiscale", "cod.fiscale", "cod. fisc", "c.f.", "cf ", "cf:", "codfisc"),
    "IT_PARTITA_IVA": ("partita iva", "p. iva", "p.iva", "partita i.v.a", "vat"),
    "IT_TARGA": ("targa", "veicolo", "autoveicolo", "immatricolazione"),
}
MAX_PLACES, MAX_EDITS, MAX_VARIANTS, MAX_BASES = 6, 2, 50_000, 512
RESULT = "corrected string, edits int, ambiguous boolean, note string"

_ODD, _EVEN = dict(zip(ALNUM, ODD, strict=True)), dict(zip(ALNUM, EVEN, strict=True))


def _tax_code(v: str) -> bool:
    day = v[9:11]
    fits = v[8] in MONTHS and (1 <= int(day) <= 31 or 41 <= int(day) <= 71)
    return fits and ALNUM[10 + (sum(map(_ODD.get, v[0:15:2])) + sum(map(_EVEN.get, v[1:15:2]))) % 26] == v[15]


def _vat(v: str) -> bool:
    return (sum(map(int, v[::2])) + sum(sum(divmod(2 * int(d), 10)) for d in v[1::2])) % 10 == 0


def _plate(v: str) -> bool:
    return not set("IOQU") & set(v)


#: Validity of a value that already has its type's shape.
_CHECKS: dict[str, Callable[[str], bool]] = {"IT_CODICE_FISCALE": _tax_code, "IT_PARTITA_IVA": _vat, "IT_TARGA": _plate}


def _fits(ch: str, kind: str) -> bool:
    return ("0" <= ch <= "9") if kind == "D" else ("A" <= ch <= "Z")


def plain_validator(entity_type: str) -> Callable[[str], bool]:
    """Shape and checksum in plain Python, for the search."""
    shape, check = SHAPES[entity_type], _CHECKS[entity_type]
    return lambda v: len(v) == len(shape) and all(map(_fits, v, shape)) and check(v)


def _readings(value: str, swaps: dict[int, str], limit: int) -> Iterator[str]:
    """``value`` with each place of ``swaps`` replaced by one of its characters."""
    places = list(swaps)
    for chosen in islice(product(*swaps.values()), limit):
        out = list(value)
        for at, ch in zip(places, chosen, strict=True):
            out[at] = ch
        yield "".join(out)


def repair(value: str, entity_type: str, with_context: bool, max_places: int = MAX_PLACES, max_edits: int = MAX_EDITS) -> tuple[str, int, bool, str] | None:
    """(corrected, edits, ambiguous, note), or None if the value can't be repaired or needs no repair."""
    value = "".join(c for c in value if not (c.isspace() or c in "-.")).upper()
    shape = SHAPES.get(entity_type)
    if shape is None or len(value) != len(shape):
        return None
    good = plain_validator(entity_type)
    if good(value):
        return None
    forced = {}
    for at, (ch, kind) in enumerate(zip(value, shape, strict=True)):
        if not _fits(ch, kind):
            forced[at] = (TO_DIGIT if kind == "D" else TO_LETTER).get(ch, "")
            if not forced[at]:
                return None
    if len(forced) > max_places:
        return None
    found = {v for v in _readings(value, forced, MAX_VARIANTS) if good(v)}
    extra = 0
    while not found and with_context and extra < max_edits:
        extra += 1
        for base in _readings(value, forced, MAX_BASES):
            free = {at: swaps for at, ch in enumerate(base) if at not in forced and (swaps := (DIGIT_DIGIT | LETTER_LETTER).get(ch))}
            left = MAX_VARIANTS
            for places in combinations(free, extra):
                swaps = {at: free[at] for at in places}
                found.update(filter(good, _readings(base, swaps, left)))
                left -= min(left, len(list(product(*swaps.values()))))
    if not found:
        return None
    kind = "shape" if not extra else f"shape and {extra} within class"
    return min(found), len(forced) + extra, len(found) > 1, f"{kind}; {len(found)} valid reading(s)"


def _repair_batch(raw: pd.Series, entity_type: pd.Series, with_context: pd.Series) -> pd.DataFrame:
    none = (None, None, None, None)
    rows = [(repair(r, t, bool(c)) if r else None) or none for r, t, c in zip(raw, entity_type, with_context, strict=True)]
    return pd.DataFrame(rows, columns=["corrected", "edits", "ambiguous", "note"]).astype({"edits": "Int32", "ambiguous": "boolean"})


def repaired(raw: Column | str, entity_type: Column | str, with_context: Column) -> Column:
    """``repair`` as a column (struct of corrected, edits, ambiguous and note; all null without a repair)."""
    return pandas_udf(_repair_batch, RESULT)(raw, entity_type, with_context)


def context_supports() -> Column:
    """Whether words around a candidate allow the wider search."""
    around = F.concat_ws(" ", "left", "right")
    out = F.lit(False)
    for name, words in HINTS.items():
        out = F.when(F.col("entity_type") == name, any_of(around, words)).otherwise(out)
    return out


def recovery_confidence(edits: Column, ambiguous: Column) -> Column:
    return F.when(ambiguous, 0.55).otherwise(F.round(F.greatest(F.lit(0.6), 1.0 - 0.12 * edits), 10))


def _span() -> list[Column]:
    """A span from a candidate with its repair in ``fix``."""
    return [
        F.col("start"), F.col("end"), F.col("raw").alias("text"), F.col("entity_type"), F.lit(OCR_RECOVERY).alias("layer"),
        recovery_confidence(F.col("fix.edits"), F.col("fix.ambiguous")).alias("confidence"), F.lit(True).alias("ocr_corrected"),
        F.col("fix.corrected").alias("corrected_text"), F.col("fix.note").alias("correction_note"), F.col("fix.edits").alias("edits"),
        F.col("fix.ambiguous").alias("ambiguous"), (F.lit(100) + F.col("ord")).alias("ord"),
    ]


def recovered_spans(failed: DataFrame) -> DataFrame:
    """Spans of the candidates (``detect.unvalidated``) that can be repaired; types without a shape never are."""
    asked = failed.where(F.col("entity_type").isin(*SHAPES)).withColumn("fix", repaired("raw", "entity_type", context_supports()))
    return asked.where(F.col("fix.corrected").isNotNull()).select("doc_id", *_span())


def all_spans(checked: DataFrame, with_failed: bool = False) -> DataFrame:
    """Plain and repaired spans of the candidates of ``detect.validated`` in one pass; only failed ones are searched.

    ``with_failed`` adds a row of layer "unvalidated" for each candidate whose checksum fails.
    """
    failed = ~F.coalesce("valid", F.lit(True)) & F.col("entity_type").isin(*SHAPES)
    fixed = checked.withColumn("fix", repaired(F.when(failed, F.col("raw")), "entity_type", failed & context_supports()))
    plain = F.when(detect.emitted(), F.struct(*detect._span()))
    mended = F.when(F.col("fix.corrected").isNotNull(), F.struct(*_span()))
    found = [plain, mended]
    if with_failed:
        found.append(F.when(~F.col("valid"), F.struct(*[F.lit(UNVALIDATED).alias("layer") if name == "layer" else c for name, c in zip(detect.SPAN, detect._span(), strict=True)])))
    return fixed.select("doc_id", F.inline(F.array_compact(F.array(*found))))
