"""Plausibility of extracted text, from 0 to 1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .strings import let, strip

MIN_CHARS = 20
# Weights of the signals and characters that engines emit when in doubt.
WEIGHTS = {"alpha_density": 0.20, "suspect_chars": 0.15, "word_ratio": 0.20, "word_length": 0.15, "isolated_chars": 0.10, "repetitions": 0.05, "vowels": 0.15}
SUSPECT = "�□■▪◆♦¶§~^`¬"
VOWELS = "aeiouàèéìòùAEIOUÀÈÉÌÒÙ"
LETTER = "A-Za-zÀ-ÿ"


def _without(text: Column, characters: str) -> Column:
    """How many of these characters a text has."""
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("double")


def _count(text: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).cast("double")


def _signals(t: Column) -> Column:
    """A struct of the signals of a stripped text; each figure of the text is computed once."""
    figures = F.struct(
        F.length(t).cast("double").alias("total"),
        F.size(F.split(t, r"(?U)\s+", -1)).cast("double").alias("tokens"),  # a stripped text neither begins nor ends with white space
        let(F.regexp_extract_all(t, F.lit(f"[{LETTER}]{{2,}}"), F.lit(0)), lambda w: F.struct(F.size(w).cast("double").alias("n"), F.length(F.array_join(w, "")).alias("chars"))).alias("words"),
        F.length(F.regexp_replace(t, r"\P{L}+", "")).cast("double").alias("letters"),
        _without(t, VOWELS).alias("vowels"),
        F.when(t.rlike(f"[{SUSPECT.replace('^', '')}^]"), _without(t, SUSPECT)).otherwise(0.0).alias("suspect"),
        _count(t, r"(?U)[^\p{L}\p{Nd}\p{P}\s]").alias("other"),
        _count(t, rf"(?U)(?<!\S)[{LETTER}](?!\S)").alias("isolated"),
        _count(t, r"(?d)(.)\1{4,}").alias("repeated"),
    )
    one_less = lambda x: 1.0 - F.least(F.lit(1.0), x)

    def signals(f: Column) -> Column:
        words = f["words"]["n"]
        average = F.when(words > 0, f["words"]["chars"] / words).otherwise(0.0)
        share = f["vowels"] / f["letters"]
        return F.struct(
            ((f["total"] - f["other"]) / f["total"]).alias("alpha_density"),
            one_less(f["suspect"] / f["total"] * 20).alias("suspect_chars"),
            (words / f["tokens"]).alias("word_ratio"),
            F.when(words == 0, 0.0).when(average < 2.5, 0.4).when(average > 14, 0.5).otherwise(1.0).alias("word_length"),
            one_less(f["isolated"] / f["tokens"] * 3).alias("isolated_chars"),
            one_less(f["repeated"] / 10).alias("repetitions"),
            F.when(f["letters"] == 0, 0.0).when(share.between(0.2, 0.65), 1.0).otherwise(0.45).alias("vowels"),
            average.alias("avg_word_length"),
        )

    return let(figures, signals)


def quality_signals(text: Column) -> dict[str, Column]:
    """The seven weighted signals, and avg_word_length, of a text that passes the guards."""
    found = let(strip(text), _signals)
    return {name: found[name] for name in (*WEIGHTS, "avg_word_length")}


def _guard(t: Column) -> Column:
    n = F.length(t)
    return F.when(n == 0, 0.0).when(n < MIN_CHARS, 0.35)


def guard(text: Column) -> Column:
    """The score of an empty or very short text; null for others."""
    return _guard(strip(F.coalesce(text, F.lit(""))))


def quality_score(text: Column) -> Column:
    def total(s: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), sum((s[k] * w for k, w in WEIGHTS.items()), F.lit(0.0))))

    return let(strip(F.coalesce(text, F.lit(""))), lambda t: F.coalesce(_guard(t), let(_signals(t), total)))


def quality_notes(text: Column) -> Column:
    """Short names of what is wrong with a text."""
    s, t = quality_signals(text), strip(text)
    n = F.length(t)
    notes = F.array(
        F.when(n == 0, F.lit("empty")),
        F.when((n > 0) & (n < MIN_CHARS), F.lit("short")),
        *[F.when((n >= MIN_CHARS) & c, F.lit(name)) for name, c in (
            ("suspect_chars", s["suspect_chars"] < 1), ("word_length", s["word_length"] < 1), ("isolated_chars", s["isolated_chars"] < 0.4),
            ("repetitions", s["repetitions"] < 1), ("vowels", s["vowels"] < 1), ("below_threshold", quality_score(text) < 0.75),
        )],
    )
    return F.array_compact(notes)
