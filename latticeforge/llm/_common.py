"""Helpers shared by the corpus operators."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _set_folder(spark: SparkSession) -> None:
    """Use the folder that the session names in spark.checkpoint.dir.

    A temporary one is made only where none is set and Spark runs in this process.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if context.master != "local" and not context.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="checkpoint-")
        context.setCheckpointDir(folder)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    _set_folder(spark)
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it from there: lost executors cost no recomputation."""
    _set_folder(df.sparkSession)
    out = df.checkpoint(eager=True)
    release(df.sparkSession)
    return out


@contextmanager
def tables(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Gives a function like ``cut`` that writes compressed tables; they are deleted at the end of the block."""
    _set_folder(spark)
    paths: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
        paths.append(path)
        df.write.option("compression", "zstd").parquet(path)
        release(spark)
        return spark.read.schema(df.schema).parquet(path)

    try:
        yield keep
    finally:
        for path in paths:
            delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def text_or_empty(df: DataFrame, column: str = "text") -> Column:
    return F.coalesce(df[column].cast("string"), F.lit(""))


def size_of(array: Column) -> Column:
    """Elements of an array, none in a null one, whatever spark.sql.ansi.enabled says."""
    return F.when(array.isNotNull(), F.size(array)).otherwise(0)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, case ignored."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
