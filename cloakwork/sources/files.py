"""Sources: text files, page extraction, policies, settings, audit logs and vaults."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.emit import FOLDERS
from ..operators.policy import Policy
from ..types import lookup

AUDIT_DDL = "log_id string, seq long, timestamp string, event string, payload string, prev_hash string, hash string"
VAULT_DDL = "doc_id long, ciphertext string, created_at timestamp, ttl_days int"
PAGES_DDL = "source_name string, source_sha256 string, index int, text string, error string"
#: Bytes of a file to the texts of its pages.
PageReader = Callable[[bytes], list[str]]


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, source_name, text): each file whole. The id is a hash of the path, so it stays when a job is repeated."""
    files = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("p"), F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B"))).alias("source_name"))
    return files.select(F.xxhash64("p").alias("doc_id"), "source_name", F.col("value").alias("text"))


def pdf_backend(wanted: str = "auto") -> PageReader:
    """The first PDF library that is installed; none of them is needed for text."""
    for name in (("pypdfium2", "pymupdf") if wanted == "auto" else (wanted,)):
        try:
            library = __import__(name)
        except ModuleNotFoundError:
            continue
        if name == "pypdfium2":
            return lambda data, lib=library: [page.get_textpage().get_text_range() for page in lib.PdfDocument(data)]
        return lambda data, lib=library: [page.get_text() for page in lib.open(stream=data, filetype="pdf")]
    raise RuntimeError("no PDF library is installed (pypdfium2 or pymupdf)")


def read_pages(spark: SparkSession, path: str, reader: PageReader | None = None) -> DataFrame:
    """(source_name, source_sha256, index, text, error): the pages of binary files, each file opened once.

    A file that can't be read or has no pages gives one row with ``error``, so
    that it is blocked later on and not lost. The hash is that of the file's bytes.
    Files of no bytes are not listed by Spark and give no row.
    """
    read = reader or pdf_backend()
    schema = pa.schema([("source_name", pa.string()), ("source_sha256", pa.string()), ("index", pa.int32()), ("text", pa.string()), ("error", pa.string())])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, digest, content in zip(*batch.columns, strict=True):
                own = (name.as_py(), digest.as_py())
                try:
                    rows = [(*own, k, text, None) for k, text in enumerate(read(content.as_py()))]
                except Exception as error:  # noqa: BLE001
                    rows = [(*own, 0, None, str(error) or type(error).__name__)]
                rows = rows or [(*own, 0, None, "no pages")]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("source_name"), F.sha2("content", 256).alias("sha256"), "content")
    return files.mapInArrow(extract, PAGES_DDL)


def inline(spark: SparkSession, texts: list[str], base64: bool = False) -> DataFrame:
    """Documents from texts at hand, given as they are or as base64 of UTF-8."""
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return rows.withColumn("text", F.decode(F.unbase64("text"), "UTF-8")) if base64 else rows


def read_policy(path: str | None = None) -> Policy:
    """A policy from YAML, or the built-in one. Unknown entity types and actions are errors."""
    if path is None:
        return Policy()
    import yaml

    with open(path, encoding="utf-8") as file:
        return Policy.from_dict(yaml.safe_load(file) or {})


@dataclass(frozen=True)
class Settings:
    input_dir: str = "input"
    output_dir: str = "output"
    archive_dir: str = "archive"
    policy_path: str | None = None
    ner_backend: str = "none"
    text_threshold: int = 50
    sealed: bool = True


def read_settings(paths: tuple[str, ...] = ("config.env",)) -> Settings:
    """Settings from the first of ``paths`` that exists (KEY=VALUE lines); names are those of ``Settings`` in capitals."""
    found: dict[str, str] = {}
    for path in paths:
        if os.path.exists(path):
            with open(path, encoding="utf-8") as file:
                lines = [x.strip() for x in file]
            pairs = [x.split("=", 1) for x in lines if "=" in x and not x.startswith("#")]
            found = {k.strip().lower(): v.strip().strip("\"'") for k, v in pairs}
            break
    kinds = {f.name: f.type for f in fields(Settings)}
    read = lambda k, v: v.lower() in ("1", "true", "yes", "on") if kinds[k] == "bool" else int(v) if kinds[k] == "int" else v
    return Settings(**{k: read(k, v) for k, v in found.items() if k in kinds})


def _write_files(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = []
            for route, name, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                path = os.path.join(folder, route, name)
                os.makedirs(os.path.dirname(path), exist_ok=True)
                with open(f"{path}.part", "w", encoding="utf-8") as file:
                    file.write(text)
                os.replace(f"{path}.part", path)  # a task that is tried again writes the same file anew
                paths.append(path)
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string())], names=["path"])

    return run


def write_markdown(rendered: DataFrame, folder: str) -> int:
    """Each row (doc_id, source_name, decision, markdown) as a file ``stem.doc_id.safe.md`` in the folder of its decision; how many there are.

    ``folder`` must be one that all executors share.
    """
    stem = F.regexp_replace(F.regexp_replace(F.col("source_name"), r"^.*/|\.[^.]*\z", ""), r"[^\w.-]+", "_")
    name = F.concat(stem, F.lit("."), F.hex("doc_id"), F.lit(".safe.md"))
    rows = rendered.select(lookup(FOLDERS, F.col("decision")).alias("route"), name.alias("name"), "markdown")
    return rows.mapInArrow(_write_files(os.path.abspath(folder)), "path string").count()


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(AUDIT_DDL).json(path)


def write_audit(log: DataFrame, path: str) -> None:
    """Append to a log of JSON lines."""
    log.write.mode("append").json(path)


def write_vault(vault: DataFrame, path: str) -> None:
    vault.withColumn("ciphertext", F.base64("ciphertext")).write.mode("append").json(path)


def read_vault(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(VAULT_DDL).json(path).withColumn("ciphertext", F.unbase64("ciphertext"))
