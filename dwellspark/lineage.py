"""The shared folder, and cutting lineage through checkpoints in it."""

from __future__ import annotations

from pyspark.sql import DataFrame


def shared_folder(spark) -> str:
    """Where checkpoints and other shared intermediate files go.

    The cluster names it in `spark.checkpoint.dir`; where it is unset it lies beside the
    warehouse tables."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the DataFrame to the shared folder and read it back."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
