"""What the operators share: checkpoints in the shared folder and Arrow batches of bounded size."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text that a Python worker handles at once.
BATCH_BYTES = 2 << 20


def _folder(spark: SparkSession) -> str | None:
    """What ``spark.checkpoint.dir`` names, or the folder that was set for this session's tests."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return named


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share, below the one that ``spark.checkpoint.dir`` names.

    Only a local session (tests) may go without that setting; it then gets a
    temporary folder.
    """
    return f"{_folder(spark) or tempfile.mkdtemp(prefix='cloakwork-')}/{name}-{uuid.uuid4().hex}"


def shared_checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` in the folder that ``spark.checkpoint.dir`` names."""
    spark = df.sparkSession
    if _folder(spark) is None:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="cloakwork-checkpoint-"))
    return df.checkpoint()


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small: whole texts have no length limit."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > 1000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def regroup(batches: Iterable[pa.RecordBatch], size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Join small record batches and cut large ones until each holds about ``size`` bytes.

    A single row larger than that stays whole.
    """
    held: list[pa.RecordBatch] = []
    total = 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        if batch.nbytes > 2 * size and batch.num_rows > 1:
            step = max(1, batch.num_rows * size // batch.nbytes)
            pieces = [batch.slice(i, step) for i in range(0, batch.num_rows, step)]
        else:
            pieces = [batch]
        for piece in pieces:
            held.append(piece)
            total += piece.nbytes
            if total >= size:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, total = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(text: Column | str = "text") -> Column:
    """A null text counts as an empty one."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the size of ``df``; no job runs."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
