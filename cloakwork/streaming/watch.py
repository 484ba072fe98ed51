"""A watched folder as a stream: each new file is processed once, then moved away."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import audit, emit
from ..operators.policy import Policy
from ..plans.pipeline import process


def watched(spark: SparkSession, folder: str, archive: str | None = None, max_files: int = 1000) -> DataFrame:
    """(doc_id, source_name, text) of the files that arrive in ``folder``; read ones go to ``archive`` if one is named.

    Files should be moved into the folder whole; only then are they listed complete.
    """
    reader = spark.readStream.format("text").option("wholetext", "true").option("maxFilesPerTrigger", max_files)
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    files = reader.load(folder).select("value", F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_name").alias("source_name"))
    return files.select(F.xxhash64("p").alias("doc_id"), "source_name", F.col("value").alias("text"))


def sink(output: str, audit_path: str, policy: Policy, master: bytes) -> Callable[[DataFrame, int], None]:
    """Writes one batch: artefacts by decision, and the batch's own log of audit events.

    A batch that is repeated after a failure overwrites its own folders, so
    nothing is written twice.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        done = process(batch, policy, master=master)
        emit.write_routed(done.rendered(policy), f"{output}/batch={batch_id}")
        log = audit.chain(done.events.withColumn("log_id", F.lit(f"batch-{batch_id}")))
        log.write.mode("overwrite").json(f"{audit_path}/batch={batch_id}")

    return write


def watch(spark: SparkSession, folder: str, output: str, audit_path: str, checkpoint: str, master: bytes, policy: Policy | None = None, archive: str | None = None, once: bool = False) -> StreamingQuery:
    """Start watching; with ``once`` what is there is processed and the stream ends."""
    writer = watched(spark, folder, archive).writeStream.foreachBatch(sink(output, audit_path, policy or Policy(), master)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()

