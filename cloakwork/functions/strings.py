"""String helpers whose results equal those of code-point based string handling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK = 64
#: Letters with one accent or more, and what is left without them.
ACCENTED = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿŠšŽžĆćČčŃńŘřŚśŹźŻż"
PLAIN = "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyySsZzCcCcNnRrSsZzZz"


def strip(text: Column) -> Column:
    """Without white space of any kind at the ends; a text that has none there is not gone through."""
    ends = F.concat(F.substring(text, 1, 1), F.substring(text, -1, 1))
    return F.when(ends.rlike(r"(?U)\s"), F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")).otherwise(text)


def squeeze(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def without_accents(text: Column) -> Column:
    """Accents go, composed or combining."""
    return F.regexp_replace(F.translate(text, ACCENTED, PLAIN), r"\p{M}+", "")


def remove(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, pattern, "")


def digits_of(text: Column) -> Column:
    return remove(text, r"(?U)\D")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once; a lambda that mentions an outer expression computes it for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _running(values: Column) -> Column:
    """The sum of the ints before each element, in two levels. ``values`` must be cheap to mention."""
    add = lambda start, xs: F.aggregate(xs, F.array(start), lambda a, x: F.array_append(a, F.element_at(a, -1) + x))

    def joined(parts: Column) -> Column:
        totals = F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda a, x: a + x))
        return let(add(F.lit(0), totals), lambda starts: F.flatten(F.zip_with(parts, F.slice(starts, 1, F.size(parts)), lambda p, s: F.slice(add(s, p), 1, F.size(p)))))

    firsts = F.sequence(F.lit(0), F.greatest(F.size(values) - 1, F.lit(0)), F.lit(CHUNK))
    return let(F.transform(firsts, lambda c: F.slice(values, c + 1, CHUNK)), joined)


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, raw>> of a pattern's matches, offsets in code points; null where there is none.

    ``regexp_extract_all`` gives the matches and ``split`` what lies between
    them, so offsets are sums of code-point lengths and lookarounds see the
    whole text.
    """
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    raw = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(v: Column) -> Column:
        steps = F.zip_with(v["raw"], F.slice(v["gaps"], 1, F.size(v["raw"])), lambda m, g: F.length(m) + g)
        # What a match starts at is the sum of the steps before it and the gap in front of it.
        ends = let(steps, lambda x: F.zip_with(x, _running(x), lambda own, before: own + before))
        return F.zip_with(v["raw"], ends, lambda m, end: F.struct((end - F.length(m)).alias("start"), end.alias("end"), m.alias("raw")))

    return let(raw, lambda m: F.when(F.size(m) > 0, let(F.struct(m.alias("raw"), gaps.alias("gaps")), placed)))


#: What stands for what was cut out; no recognizer matches it.
MARK = "\ue000"
HEAD, TAIL = 72, 160
_LETTERS = "".join(c for c in map(chr, range(0x41, 0x100)) if c.isalpha() and c not in "ªµº")
# A plain word of at most 15 characters and the white space behind it. Each character is named, since Java looks such classes up in one table.
_PLAIN = rf"[{_LETTERS}|&%$#*][{_LETTERS}|&%$#*.,;'\"!?)(\-]{{0,14}}+[ \n]{{1,2}}+"
_PIECES = rf"(?:{_PLAIN})++|[^ \n]*+[ \n]*+"


def windows(text: Column) -> Column:
    """A struct of ``text`` without the middle of its long runs of plain words, and ``at`` and ``by``: from which offset on how many characters are missing.

    A run has no digit, no "@" or ":", no word of more than 15 characters and no
    letters beyond Latin-1. It keeps its first 72 and last 160 characters (9
    words at least) with MARK between them. So what holds a match is whole, if a
    match has something that no run has, and reaches from there at most 70
    characters to the right and 8 words to the left: an account number, the
    longest to the right, 60 from its digits; an address 7 words before its number.
    """
    def cut(pieces: Column) -> Column:
        long = lambda p: (F.length(p) > HEAD + TAIL + 1) & p.rlike(rf"\A{_PLAIN}")
        kept = F.transform(pieces, lambda p: F.when(long(p), F.concat(F.substring(p, 1, HEAD), F.lit(MARK), F.substring(p, -TAIL, TAIL))).otherwise(p))
        gone = F.transform(F.filter(pieces, long), lambda p: F.length(p) - (HEAD + TAIL + 1))
        return let(F.struct(F.array_join(kept, "").alias("text"), gone.alias("gone")), placed)

    def placed(v: Column) -> Column:
        starts = let(F.transform(F.split(v["text"], MARK, -1), F.length), lambda n: F.transform(_running(n), lambda x, k: x + k))
        by = let(v["gone"], lambda g: F.zip_with(g, _running(g), lambda own, before: own + before))
        return F.struct(v["text"].alias("text"), F.slice(starts, 2, F.size(v["gone"])).alias("at"), by.alias("by"))

    none = F.array().cast("array<int>")
    return F.when(F.instr(text, MARK) > 0, F.struct(text.alias("text"), none.alias("at"), none.alias("by"))).otherwise(let(F.regexp_extract_all(text, F.lit(_PIECES), F.lit(0)), cut))


def unwindowed(start: Column, at: Column, by: Column) -> Column:
    """The offset in the whole text of one in ``windows``; ``at`` is searched by halves."""
    n = F.size(at)
    step = lambda low, k: F.when(F.get(at, low + F.call_function("shiftleft", F.lit(1), k) - 1) <= start, low + F.call_function("shiftleft", F.lit(1), k)).otherwise(low)
    found = F.aggregate(F.sequence(F.length(F.bin(n.cast("long"))) - 1, F.lit(0), F.lit(-1)), F.lit(0), step)
    return F.when(n == 0, start).otherwise(start + F.coalesce(F.get(by, found - 1), F.lit(0)))
