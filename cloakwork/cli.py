"""Command line: ``python -m cloakwork.cli COMMAND``; a thin layer over the tables' operators.

All state lies in one folder (``--state``): the master key, sealed token maps and
their keys, the audit log and the signed manifests. ``ingest`` ends with code 2
if a document is blocked, checks with 1 if something is broken.
"""

from __future__ import annotations

import argparse
import os
import shutil
import sys
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import __version__
from .lineage import cut
from .operators import audit, manifest, rehydrate, screen, vault
from .operators.pages import documents_of
from .plans.pipeline import process
from .sources import files

LOG = "log"


class State:
    """The tables in the state folder; a missing one is None."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        os.makedirs(folder, exist_ok=True)

    def path(self, name: str) -> str:
        return os.path.join(self.folder, name)

    @property
    def master(self) -> bytes:
        return vault.master_key(key_file=self.path("master.key"))

    def read(self, name: str) -> DataFrame | None:
        if not os.path.exists(self.path(name)):
            return None
        readers = {"audit": files.read_audit, "vault": files.read_vault}
        return readers.get(name, lambda spark, path: spark.read.parquet(path))(self.spark, self.path(name))

    def replace(self, name: str, table: DataFrame) -> None:
        """Write a table anew; the old one goes once the new one is whole."""
        fresh = self.path(f"{name}-{uuid.uuid4().hex}")
        table.write.parquet(fresh)
        shutil.rmtree(self.path(name), ignore_errors=True)
        os.replace(fresh, self.path(name))

    def log(self, events: DataFrame) -> None:
        so_far = self.read("audit")
        files.write_audit(cut(audit.chain(events, None if so_far is None else audit.heads(so_far))), self.path("audit"))


def _now() -> str:
    return datetime.now(UTC).isoformat(timespec="seconds")


def _documents(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    if args.text is not None:
        return files.inline(spark, [sys.stdin.read() if args.text == "-" else args.text]).select(F.xxhash64("text").alias("doc_id"), F.lit("inline.txt").alias("source_name"), "text")
    if args.pdf:
        return cut(documents_of(files.read_pages(spark, args.path, args.reader)))
    return files.read_texts(spark, args.path)


def ingest(spark: SparkSession, args: argparse.Namespace) -> int:
    state, policy = State(spark, args.state), files.read_policy(args.policy)
    documents = _documents(spark, args)
    done = process(documents, policy, master=state.master, quality=F.col("quality") if args.pdf else None, timestamp=_now())
    rows = cut(done.documents)
    done.documents = rows
    files.write_markdown(done.rendered(policy).join(rows.select("doc_id", "source_name"), "doc_id"), args.output)
    if done.tokens is not None:
        keys = vault.data_keys(done.tokens, state.master)
        old = state.read("keys")
        if old is not None:  # a document that is taken in again keeps its key
            keys = cut(old.unionByName(keys.join(old, "doc_id", "left_anti")))
        sealed = vault.store(done.tokens, keys, state.master, F.current_timestamp(), args.ttl_days)
        files.write_vault(cut(sealed), state.path("vault"))
        state.replace("keys", keys)
    done.manifests(policy, state.master).drop("manifest").write.mode("append").parquet(state.path("manifests"))
    state.log(done.events)
    for row in rows.select("doc_id", "source_name", "decision", "n_spans").toLocalIterator():
        print(row.doc_id, row.decision, row.n_spans, row.source_name)
    return 0 if rows.where("decision = 'block'").isEmpty() else 2


def scan(spark: SparkSession, args: argparse.Namespace) -> int:
    for row in screen.counts_by(screen.screen(_documents(spark, args)), "entity_type").toLocalIterator():
        print(*row)
    return 0


def restore(spark: SparkSession, args: argparse.Namespace) -> int:
    state = State(spark, args.state)
    sealed, keys = state.read("vault"), state.read("keys")
    tokens = None if sealed is None or keys is None else vault.load(sealed.where(F.col("doc_id") == args.doc_id), keys, state.master).distinct()
    if tokens is None or tokens.isEmpty():
        print("no token map opens for this document", file=sys.stderr)
        return 1
    with open(args.response, encoding="utf-8") as file:
        answer = spark.createDataFrame([(args.doc_id, file.read())], "doc_id long, response string")
    row = rehydrate.rehydrate(answer, tokens, args.strict).first()
    print(row.text)
    for warning in row.warnings:
        print(warning, file=sys.stderr)
    return 0


def verify(spark: SparkSession, args: argparse.Namespace) -> int:
    state = State(spark, args.state)
    signed = state.read("manifests")
    bad = [] if signed is None else manifest.verify(signed, state.master).where("NOT valid").collect()
    for row in bad:
        print(row.doc_id, row.reason)
    return 1 if signed is None or bad else 0


def show_audit(spark: SparkSession, args: argparse.Namespace) -> int:
    log = State(spark, args.state).read("audit")
    if log is None:
        return 1
    if args.verify:
        row = audit.verify(log).first()
        print("valid" if row.valid else f"broken at {row.broken_at}: {row.reason}", row.entries)
        return 0 if row.valid else 1
    rows = audit.for_document(log, args.doc_id) if args.doc_id else log
    for row in audit.tail(rows, args.limit).orderBy("seq").toLocalIterator():
        print(row.seq, row.timestamp, row.event, row.payload)
    return 0


def forget(spark: SparkSession, args: argparse.Namespace) -> int:
    state = State(spark, args.state)
    keys, ids = state.read("keys"), spark.createDataFrame([(args.doc_id,)], "doc_id long")
    if keys is None or keys.join(ids, "doc_id").isEmpty():
        print("no key of this document is held", file=sys.stderr)
        return 1
    state.replace("keys", vault.forget(keys, ids))
    payload = F.to_json(F.struct(F.col("doc_id").cast("string").alias("doc_id")))
    state.log(ids.select(F.lit(LOG).alias("log_id"), F.lit(0).alias("ord"), F.lit(_now()).alias("timestamp"), F.lit("forget").alias("event"), payload.alias("payload")))
    return 0


def doctor(spark: SparkSession, args: argparse.Namespace) -> int:
    print("version", __version__)
    print("spark", spark.version)
    try:
        files.pdf_backend()
        print("pdf yes")
    except RuntimeError as error:
        print("pdf no:", error)
    return 0


def prompt(spark: SparkSession | None, args: argparse.Namespace) -> int:
    print(manifest.AGENT_INSTRUCTION)
    return 0


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="cloakwork", description=__doc__)
    commands = out.add_subparsers(dest="command", required=True)

    def command(name: str, run, state: bool = True) -> argparse.ArgumentParser:
        own = commands.add_parser(name)
        own.set_defaults(run=run)
        if state:
            own.add_argument("--state", default="state")
        return own

    for name, run in (("ingest", ingest), ("scan", scan)):
        own = command(name, run)
        own.add_argument("path", nargs="?")
        own.add_argument("--text", help="a text, or - for standard input")
        own.add_argument("--pdf", action="store_true", help="the path holds PDF files")
        own.set_defaults(reader=None)
        own.add_argument("--policy")
        own.add_argument("--output", default="output")
        own.add_argument("--ttl-days", type=int, default=90)
    own = command("rehydrate", restore)
    own.add_argument("doc_id", type=int)
    own.add_argument("response")
    own.add_argument("--strict", action="store_true")
    command("verify", verify)
    own = command("audit", show_audit)
    own.add_argument("--verify", action="store_true")
    own.add_argument("--doc-id")
    own.add_argument("--limit", type=int, default=20)
    command("forget", forget).add_argument("doc_id", type=int)
    command("doctor", doctor, False)
    command("prompt", prompt, False)
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command in ("ingest", "scan") and (args.path is None) == (args.text is None):
        parser().error("give either a path or --text")
    if args.command != "prompt" and spark is None:
        spark = SparkSession.builder.appName("cloakwork").getOrCreate()
    return args.run(spark, args)


if __name__ == "__main__":
    sys.exit(main())
