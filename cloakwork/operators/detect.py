"""Recognizers: text to rows of candidates and spans.

Every recognizer's pattern runs once over a text, in Catalyst, less the middle of
long runs of plain words (``strings.windows``), in which none has a match; all
matches leave the document in one explode, each with the 60 characters to its
left and right.
What follows (validators, context, confidence) are plain expressions on small
rows, and the text itself is not carried along. No shuffle is needed.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.checksums import VALIDATORS
from ..functions.strings import matches, unwindowed, windows
from ..lineage import once, spread
from ..types import CHECKSUM, REGEX, SPANS_DDL

WINDOW = 60
BOOST = 0.25


@dataclass(frozen=True)
class Recognizer:
    entity_type: str
    pattern: str
    confidence: float
    context: tuple[str, ...] = ()
    emit_unvalidated: bool = False


_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_SEP = r"[ .\-]?"
# Shapes, words of context and confidences of the recognizers, in their order. A look at the first character comes before slower ones to the left.
RECOGNIZERS: tuple[Recognizer, ...] = (
    Recognizer("IT_CODICE_FISCALE", r"(?<![A-Za-z0-9])[A-Za-z0-9]{16}(?![A-Za-z0-9])", 0.5, ("codice fiscale", "c.f.", "cod. fisc", "cf:", "cod.fisc")),
    Recognizer("IT_PARTITA_IVA", r"(?iU)(?<![0-9])(?:IT[\s\-]?)?\d{11}(?![0-9])", 0.5, ("partita iva", "p. iva", "p.iva", "vat", "partita i.v.a")),
    Recognizer("IBAN", r"(?U)(?<![A-Za-z0-9])[A-Za-z]{2}\d{2}(?:[ \-]?[A-Za-z0-9]){11,30}(?![A-Za-z0-9])", 0.5, ("iban", "coordinate bancarie", "bonifico", "conto corrente")),
    Recognizer("CREDIT_CARD", r"(?U)(?<![0-9])(?:\d[ \-]?){12,19}(?![0-9])", 0.4, ("carta", "card", "visa", "mastercard", "pagamento")),
    Recognizer("IT_TESSERA_SANITARIA", r"(?U)(?<![0-9])80380\d{15}(?![0-9])", 0.7, ("tessera sanitaria", "team", "assistito"), True),
    Recognizer("IT_TARGA", r"(?U)(?<![A-Za-z0-9])[A-Za-z]{2}[ \-]?\d{3}[ \-]?[A-Za-z]{2}(?![A-Za-z0-9])", 0.45, ("targa", "veicolo", "autoveicolo", "immatricolazione")),
    Recognizer("EMAIL", r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}(?![A-Za-z])", 0.95, (), True),
    Recognizer(
        "PHONE",
        rf"(?U)(?=[+03])(?<![0-9])(?:(?:\+|00)39{_SEP}(?:0\d{{1,3}}{_SEP}\d{{5,8}}|3\d{{2}}{_SEP}\d{{3}}{_SEP}\d{{3,4}})|0\d{{1,3}}[ .\-]\d{{5,8}}|3\d{{2}}{_SEP}\d{{3}}{_SEP}\d{{3,4}})(?![0-9])",
        0.6, ("tel", "telefono", "cell", "cellulare", "fax", "mobile"), True,
    ),
    Recognizer("IP_ADDRESS", rf"(?=[0-9])(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?[0-9])", 0.85, (), True),
    Recognizer("MAC_ADDRESS", r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}(?![0-9A-Fa-f:])", 0.9, (), True),
    Recognizer(
        "ADDRESS",
        r"(?iuU)\b(?:via|viale|v\.le|piazza|p\.zza|corso|c\.so|largo|vicolo|strada|località|localita|contrada)"
        r"\s+[A-ZÀ-Ü][\w'À-ü.\-]*(?:\s+(?:[A-ZÀ-Ü][\w'À-ü.\-]*|d[ei']|degli|della|delle|del)){0,4}[,\s]+n?\.?\s*\d+[/\w]*\b",
        0.7, ("residente", "domicilio", "sede", "abitazione", "indirizzo"), True,
    ),
    Recognizer(
        "DATE",
        r"(?iuU)(?=\d)(?<![0-9])(?:[0-3]?\d[/\-.][01]?\d[/\-.](?:19|20)\d{2}|(?:19|20)\d{2}[/\-.][01]?\d[/\-.][0-3]?\d"
        r"|[0-3]?\d\s+(?:gennaio|febbraio|marzo|aprile|maggio|giugno|luglio|agosto|settembre|ottobre|novembre|dicembre)\s+(?:19|20)\d{2})(?![0-9])",
        0.8, ("nato", "nata", "data di nascita", "nascita"), True,
    ),
)
#: Cheap patterns without which the costly ones can't match.
GATES = {
    "IT_CODICE_FISCALE": "[A-Za-z0-9]{16}", "IT_PARTITA_IVA": r"(?U)\d{11}", "IBAN": r"(?U)[A-Za-z]{2}\d{2}[ \-]?[A-Za-z0-9]", "CREDIT_CARD": r"(?U)\d[ \-]?\d[ \-]?\d[ \-]?\d",
    "IT_TESSERA_SANITARIA": "80380", "IT_TARGA": r"(?U)[A-Za-z]{2}[ \-]?\d{3}", "EMAIL": "@", "PHONE": r"(?U)\d{2}", "IP_ADDRESS": r"[0-9]\.[0-9]",
    "MAC_ADDRESS": "[0-9A-Fa-f]{2}:", "ADDRESS": r"(?U)\d", "DATE": r"(?U)(?:19|20)\d{2}",
}
BIRTH = ("nato il", "nata il", "data di nascita", "nato a", "nata a", "n. il")

_registry: list[Recognizer] = list(RECOGNIZERS)


def recognizers() -> tuple[Recognizer, ...]:
    return tuple(_registry)


def register_recognizer(recognizer: Recognizer) -> None:
    """Add a recognizer of your own; it comes after the built-in ones."""
    _registry.append(recognizer)


def any_of(text: Column, words: tuple[str, ...]) -> Column:
    return text.rlike("|".join(re.escape(w) for w in words))


def candidates(documents: DataFrame, only: tuple[str, ...] = (), patterns: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, ord, entity_type, start, end, raw, left, right): every match of every recognizer.

    ``left`` and ``right`` are the lower-cased 60 characters on either side.
    ``patterns`` stand in for those of the recognizers of these types.
    """
    patterns = patterns or {}

    whole, near = F.col("text"), F.col("near.text")

    def numbered(k: int, r: Recognizer) -> Column:
        # Recognizers that were added may match anything, so they read the whole text.
        own = k < len(RECOGNIZERS)
        text, pattern = near if own else whole, patterns.get(r.entity_type, r.pattern)
        found = matches(text, pattern) if r.entity_type not in GATES or not own else F.when(text.rlike(GATES[r.entity_type]), matches(text, pattern))

        def row(m: Column) -> Column:
            start = unwindowed(m["start"], F.col("near.at"), F.col("near.by")) if own else m["start"]
            return F.struct(F.lit(k).alias("ord"), start.alias("start"), F.length(m["raw"]).alias("n"), m["raw"].alias("raw"))

        return F.transform(found, row)

    chosen = [(k, r) for k, r in enumerate(recognizers()) if not only or r.entity_type in only]
    found = [numbered(k, r) for k, r in chosen]
    none = F.array().cast("array<struct<ord:int,start:int,n:int,raw:string>>")
    rows = once(spread(documents.select("doc_id", "text")), near=windows(whole))
    each = rows.select("doc_id", "text", F.explode(F.flatten(F.array(*[F.coalesce(f, none) for f in found]))).alias("m"))
    each = each.select("doc_id", "text", F.struct("m.ord", "m.start", (F.col("m.start") + F.col("m.n")).alias("end"), "m.raw").alias("m"))
    left = F.lower(F.expr("substring(text, greatest(m.start - 60, 0) + 1, m.start - greatest(m.start - 60, 0))"))
    right = F.lower(F.expr("substring(text, m.end + 1, 60)"))
    name = F.element_at(F.array(*[F.lit(r.entity_type) for r in recognizers()]), F.col("m.ord") + 1)
    return each.select("doc_id", F.col("m.ord").alias("ord"), name.alias("entity_type"), F.col("m.start").alias("start"), F.col("m.end").alias("end"), F.col("m.raw").alias("raw"), left.alias("left"), right.alias("right"))


def _by_recognizer(value) -> Column:
    """A column that depends on which recognizer matched."""
    out = None
    for k, r in enumerate(recognizers()):
        v = value(r)
        if v is not None:
            out = F.when(F.col("ord") == k, v) if out is None else out.when(F.col("ord") == k, v)
    return out


def validated(found: DataFrame) -> DataFrame:
    """``found`` with ``valid``: true or false by the type's checksum, null for types without one."""
    check = {r.entity_type for r in recognizers()} & set(VALIDATORS)
    return once(found, valid=_by_recognizer(lambda r: VALIDATORS[r.entity_type](F.col("raw")) if r.entity_type in check else None))


def refined_type() -> Column:
    """A date after a phrase of birth is a date of birth."""
    return F.when((F.col("entity_type") == "DATE") & any_of(F.col("left"), BIRTH), F.lit("DATE_OF_BIRTH")).otherwise(F.col("entity_type"))


def in_context() -> Column:
    around = F.concat_ws(" ", "left", "right")
    return F.coalesce(_by_recognizer(lambda r: any_of(around, r.context) if r.context else None), F.lit(False))


def unvalidated(found: DataFrame) -> DataFrame:
    """Candidates of the right shape whose checksum fails: the input of recovery."""
    return validated(found).where(~F.col("valid"))


SPAN = ("start", "end", "text", "entity_type", "layer", "confidence", "ocr_corrected", "corrected_text", "correction_note", "edits", "ambiguous", "ord")


def _span() -> list[Column]:
    """A span from a candidate: a proven one with confidence 1, others by shape and context."""
    base = _by_recognizer(lambda r: F.lit(r.confidence))
    proven = F.coalesce("valid", F.lit(False))
    confidence = F.when(proven, 1.0).otherwise(F.least(F.lit(1.0), base + F.when(in_context(), BOOST).otherwise(0.0)))
    return [
        F.col("start"), F.col("end"), F.col("raw").alias("text"), refined_type().alias("entity_type"),
        F.when(proven, CHECKSUM).otherwise(REGEX).alias("layer"), F.round(confidence, 10).alias("confidence"),
        F.lit(False).alias("ocr_corrected"), F.lit(None).cast("string").alias("corrected_text"), F.lit(None).cast("string").alias("correction_note"),
        F.lit(0).alias("edits"), F.lit(False).alias("ambiguous"), F.col("ord"),
    ]


def emitted() -> Column:
    """Whether a candidate is a span: proven, or of a type that needs no proof."""
    return F.coalesce("valid", _by_recognizer(lambda r: F.lit(r.emit_unvalidated)))


def spans_of(found: DataFrame) -> DataFrame:
    """Spans from candidates."""
    return validated(found).where(emitted()).select("doc_id", *_span())


def no_spans(spark) -> DataFrame:
    return spark.createDataFrame([], SPANS_DDL)
