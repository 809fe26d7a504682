"""Small helpers around data frames that several operators need."""

from __future__ import annotations

from pyspark.sql import DataFrame

from shelfspark.session import scratch_path

FREE = "__"


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that the frame doesn't hold yet."""
    taken = {c.lower() for c in df.columns}
    name = f"{FREE}{stem}"
    while name.lower() in taken:
        name = f"{FREE}{name}"
    return name


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame, written to the shared folder and read back: later steps start from there."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
