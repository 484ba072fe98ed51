"""Tables that are worth writing once, and columns that are worth computing once."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """``df`` from a checkpoint in the folder that ``spark.checkpoint.dir`` names, which all executors share.

    Only a local session (tests) may go without that setting; it then gets a
    temporary folder.
    """
    spark = df.sparkSession
    if spark.conf.get("spark.checkpoint.dir", None) is None and spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="cloakwork-"))
    return df.checkpoint()


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with more columns that the optimizer does not repeat wherever they are used.

    Adjacent projections are merged, and with them a costly expression is
    computed again at each mention. A generator of one row stands in between.
    """
    values = F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))
    return df.select("*", F.inline(values))


#: Input up to this much for each core is dealt out anew, since a small file may be one split.
SPREAD_BYTES = 64 << 20


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where it is small; a large input comes in splits enough and isn't shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size <= cores * SPREAD_BYTES else df
