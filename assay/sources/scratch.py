"""Results that several jobs of a run read, computed once."""

from __future__ import annotations

from pyspark.sql import DataFrame


def kept(df: DataFrame) -> DataFrame:
    """df, computed once and read from the folder in ``spark.checkpoint.dir``, which all executors share; df itself where none is set."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder:
            return df
        context.setCheckpointDir(folder)
    return df.checkpoint()
