"""The data model: entity types, layers, actions, and the schemas of the long tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Entity type, abbreviation in tokens, label.
ENTITY_TYPES = (
    ("IT_CODICE_FISCALE", "CF", "Italian tax code"),
    ("IT_PARTITA_IVA", "PIVA", "Italian VAT number"),
    ("IT_TESSERA_SANITARIA", "TS", "Italian health card"),
    ("IBAN", "IBAN", "Bank account"),
    ("CREDIT_CARD", "CARD", "Payment card"),
    ("IT_TARGA", "TARGA", "Number plate"),
    ("EMAIL", "EML", "E-mail address"),
    ("PHONE", "TEL", "Phone number"),
    ("IP_ADDRESS", "IP", "IP address"),
    ("MAC_ADDRESS", "MAC", "MAC address"),
    ("PERSON", "PER", "Person"),
    ("ORGANIZATION", "ORG", "Organisation"),
    ("ADDRESS", "ADR", "Address"),
    ("LOCATION", "LOC", "Place"),
    ("DATE", "DAT", "Date"),
    ("DATE_OF_BIRTH", "DOB", "Date of birth"),
    ("GDPR_ART9_HEALTH", "A9H", "Health"),
    ("GDPR_ART9_BIOMETRIC", "A9B", "Biometric data"),
    ("GDPR_ART9_GENETIC", "A9G", "Genetic data"),
    ("GDPR_ART9_RELIGION", "A9R", "Religion"),
    ("GDPR_ART9_POLITICAL", "A9P", "Political opinion"),
    ("GDPR_ART9_SEXUAL", "A9S", "Sexual orientation"),
    ("GDPR_ART9_UNION", "A9U", "Union membership"),
)
NAMES = tuple(name for name, _, _ in ENTITY_TYPES)
ABBREVIATIONS = {name: short for name, short, _ in ENTITY_TYPES}
LABELS = {name: label for name, _, label in ENTITY_TYPES}
#: Types that win overlaps because a checksum can prove them.
CHECKSUM_TYPES = ("IT_CODICE_FISCALE", "IT_PARTITA_IVA", "IBAN", "CREDIT_CARD")
SPECIAL_PREFIX = "GDPR_ART9_"

REGEX, CHECKSUM, OCR_RECOVERY, NER = "regex", "checksum", "ocr_recovery", "ner"
UNVALIDATED = "unvalidated"  # no layer of spans: candidates whose checksum fails, where figures need them
ACTIONS = ("pseudonymize", "generalize", "block", "review", "keep")
DECISIONS = ("allow", "review", "block")  # by severity
RELIABLE = 0.75

SPANS_DDL = (
    "doc_id long, start int, end int, text string, entity_type string, layer string, confidence double, "
    "ocr_corrected boolean, corrected_text string, correction_note string, edits int, ambiguous boolean, ord int"
)


def is_special(entity_type: Column) -> Column:
    return entity_type.startswith(SPECIAL_PREFIX)


def is_checksum(entity_type: Column) -> Column:
    return entity_type.isin(*CHECKSUM_TYPES)


def lookup(values: dict[str, str], key: Column) -> Column:
    """A constant map's value for ``key``, or null."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), key)


def entity_types(spark: SparkSession) -> DataFrame:
    """The 23-row dimension (name, abbrev, label, is_special, is_checksum)."""
    rows = [(n, a, lab, n.startswith(SPECIAL_PREFIX), n in CHECKSUM_TYPES) for n, a, lab in ENTITY_TYPES]
    return spark.createDataFrame(rows, "name string, abbrev string, label string, is_special boolean, is_checksum boolean")


def span_problems(spans: DataFrame) -> DataFrame:
    """Rows of ``spans`` that break an invariant: offsets in order and not negative, confidence from 0 to 1, a known type."""
    bad = (F.col("start") < 0) | (F.col("end") < F.col("start")) | ~F.col("confidence").between(0, 1) | ~F.col("entity_type").isin(*NAMES)
    return spans.where(F.coalesce(bad, F.lit(True)))
