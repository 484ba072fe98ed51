"""Pages of documents: tiers, assembly, cleaning, layout and quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.quality import quality_score
from ..functions.strings import strip
from ..types import RELIABLE

THRESHOLD = 50
SEPARATOR = "\n\n---\n\n"
MAX_MB, MAX_PAGES = 50, 100
# What shows that an engine gave its prompt back, what looks like a formula, and signs that fonts garble.
ECHOES = (
    "text recognition:", "formula recognition:", "table recognition:", "mathematical formulas →", "tables → markdown", "output only extracted",
    "describe in detail", "parabola, hyperbola, ellipse", "graph axes: x-axis, y-axis", "<|begin_of_image|>",
)
FORMULA = r"[∫∑∂∇∈∉≤≥≠±∞∀∃√Δ]|\\frac|\\int|\\sum|\\prod|\\lim|\\nabla|\\partial|\$[^$]+\$|[a-z]\([a-z]\)|\bE\[|Var\(|P\(|\blim_"
GLYPHS = ("✏↵↤⇢⌘", "εα·ρ≡")
CLEANING = (
    (r"(?iU)<\s*l\s*a\s*t\s*e\s*x\s*i\s*t[\s\S]*?<\s*/\s*l\s*a\s*t\s*e\s*x\s*i\s*t\s*>", ""),
    (r"(?i)<latexit[^>]*>[\s\S]*?</latexit>", ""),
    (r"(?i)</latexit>", ""),
    (r"(?mU)(?:^|(?<=\s))[A-Za-z0-9+/]{40,}={0,2}(?=\s|$)", ""),
    (r"(\d)\1{5,}\d?", ""),
)
REWRITES = (
    (r"(?<![A-Za-z0-9])@([A-Za-z])", "∂$1"),
    (r"(?U)\brg\(", "∇g("),
    (r"(?U)(?<=[\w\)]) 2 (?=[A-Z\[{\\])", " ∈ "),
    (r"(?U)(\w)\s*!\s*([0-9A-Za-z∞])", "$1 → $2"),
    (r"(?U)(?<!\w)k([^k\n]+(?:\([^)\n]*\))[^k\n]*?)k(\d?)(?!\w)", "‖$1‖$2"),
    (r"(?U)(w\([^)]+\))\s{2,}(w\()", "$1 ← $2"),
    (r"(?mdU)^(\s*)t\s{2,}(t\s*\+\s*1)\s*$", "$1t ← $2"),
    (r"\n{3,}", "\n\n"),
)


def tier(text: Column, threshold: int = THRESHOLD) -> Column:
    """``text`` where a page has enough of its own, else ``needs_ocr``."""
    return F.when(F.length(strip(F.coalesce(text, F.lit("")))) >= threshold, "text").otherwise("needs_ocr")


def task(text: Column, has_table: Column, threshold: int = THRESHOLD) -> Column:
    """text, table, formula or visual, in this order."""
    own = strip(F.coalesce(text, F.lit("")))
    return F.when(F.length(own) >= threshold, "text").when(has_table, "table").when(own.rlike(FORMULA), "formula").otherwise("visual")


def assemble(pages: DataFrame) -> DataFrame:
    """(doc_id, text): the pages (doc_id, index, text) that aren't blank, stripped, in order."""
    rows = pages.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("index", strip(F.coalesce("text", F.lit(""))).alias("t")))).alias("p"))
    return rows.select("doc_id", F.array_join(F.filter(F.transform("p", lambda x: x["t"]), lambda t: t != ""), SEPARATOR).alias("text"))


def page_quality(pages: DataFrame) -> DataFrame:
    """(doc_id, mean_quality, pages_below): the mean score and the numbers, from 1, of the pages below the threshold."""
    scored = pages.withColumn("__q", quality_score(F.col("text")))
    below = F.sort_array(F.collect_list(F.when(F.col("__q") < RELIABLE, (F.col("index") + 1).cast("long"))))
    return scored.groupBy("doc_id").agg(F.avg("__q").alias("mean_quality"), below.alias("pages_below"))


def documents_of(pages: DataFrame) -> DataFrame:
    """Documents for ``process``, of the pages (source_name, source_sha256, index, text, error) of files.

    Texts are cleaned page by page and assembled; ``quality`` is the pages' mean
    and ``pages_below`` names the bad ones. A file that could not be read has no
    pages and its error as ``detection_error``. The id is a hash of the file's path.
    """
    named = pages.withColumn("doc_id", F.xxhash64("source_name")).withColumn("text", clean_native_text(F.coalesce("text", F.lit(""))))
    files = named.groupBy("doc_id").agg(F.first(F.element_at(F.split("source_name", "/"), -1)).alias("source_name"), F.first("source_sha256").alias("source_sha256"), F.count_if(F.col("error").isNull()).alias("pages"), F.max("error").alias("detection_error"))
    readable = named.where(F.col("error").isNull())
    figures = page_quality(readable).withColumnRenamed("mean_quality", "quality")
    whole = files.join(assemble(readable), "doc_id", "left").join(figures, "doc_id", "left")
    return whole.withColumns({"text": F.coalesce("text", F.lit("")), "quality": F.coalesce("quality", F.lit(0.0)), "pages_below": F.coalesce("pages_below", F.array().cast("array<long>"))})


def extraction_stats(pages: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    kind = tier(F.col("text"), threshold)
    return pages.groupBy("doc_id").agg(F.count("*").alias("pages"), F.count_if(kind == "text").alias("native_pages"), F.count_if(kind == "needs_ocr").alias("ocr_pages"), F.round(F.avg(quality_score(F.col("text"))), 3).alias("mean_quality"))


def clean_ocr_output(raw: Column) -> Column:
    """Without a code fence around it; nothing where the prompt came back."""
    text = F.regexp_replace(strip(raw), r"(?i)\A```(?:markdown)?\n?", "")
    text = strip(F.regexp_replace(strip(text), r"\n?```\z", ""))
    head = F.lower(F.substring(text, 1, 400))
    echo = F.lit(False)
    for marker in ECHOES:
        echo = echo | (F.instr(head, marker) > 0)
    return F.when(echo, "").otherwise(text)


def clean_native_text(text: Column) -> Column:
    """Without embedded source blobs, and with garbled signs put right."""
    for pattern, new in CLEANING:
        text = F.regexp_replace(text, pattern, new)
    text = F.translate(text, *GLYPHS)
    for pattern, new in REWRITES:
        text = F.regexp_replace(text, pattern, new)
    return text


def within_limits(documents: DataFrame, size_bytes: Column, pages: Column) -> DataFrame:
    return documents.where((size_bytes <= MAX_MB * 1024 * 1024) & (pages <= MAX_PAGES))


def chunked(index: Column, size: int) -> Column:
    """The batch that a page belongs to."""
    return F.floor(index / size)


def layout_summary(pages: DataFrame, has_table: Column) -> DataFrame:
    """(doc_id, pages, chars, and a count for each task)."""
    kind = task(F.col("text"), has_table)
    counts = [F.count_if(kind == k).alias(k) for k in ("text", "table", "formula", "visual")]
    return pages.groupBy("doc_id").agg(F.count("*").alias("pages"), F.sum(F.length(strip(F.coalesce("text", F.lit("")))).cast("long")).alias("chars"), *[c.alias(f"n_{k}") for k, c in zip(("text", "table", "formula", "visual"), counts, strict=True)])
