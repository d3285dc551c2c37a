"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Column names like the wanted ones that no column of ``df`` uses (Spark compares case-insensitively)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def named(name: str) -> Column:
    """A column by its literal name, dots and all."""
    return F.col(f"`{name.replace('`', '``')}`")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares: spark.checkpoint.dir. Where that is unset a temporary one serves a single machine; a cluster is refused."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named_dir = spark.conf.get("spark.checkpoint.dir", None)
        if named_dir is None and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named_dir or tempfile.mkdtemp(prefix="folioscope-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder; smaller than a checkpoint where values repeat."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def kept(df: DataFrame) -> tuple[DataFrame, str]:
    """Like ``written``, with the table's place, for ``discard`` once nothing reads it any more."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, even where body uses it inside the lambda of a higher-order function."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def valid_text(column: Column) -> Column:
    """The text with null as empty and malformed UTF-8 replaced, so that Arrow and Python can read it."""
    return F.make_valid_utf8(F.coalesce(column.cast("string"), F.lit("")))


def beside_text(df: DataFrame, text_col: str) -> tuple[Column, str | None]:
    """A column that holds the valid text where the text itself is not that, and the column to be read elsewhere; so a batch does not hold every text twice. None if the column holds them all."""
    valid = valid_text(named(text_col))
    if text_col not in df.columns or df.schema[text_col].dataType != T.StringType():
        return valid, None
    return F.when(named(text_col) == valid, F.lit(None).cast("string")).otherwise(valid), text_col


def texts_of(batch: pa.RecordBatch, beside: str, own: str | None) -> pa.Array:
    """The valid texts of a batch that has the column of ``beside_text``."""
    column = lambda name: batch.column(batch.schema.names.index(name))
    return column(beside) if own is None else pc.coalesce(column(beside), column(own))


def release() -> None:
    """Hands memory that a task has freed back to the machine: Spark keeps its worker, idle, through later stages that have no Python."""
    gc.collect()
    for pool in (pa.default_memory_pool(), pa.system_memory_pool()):
        pool.release_unused()


def slices(texts: pa.Array, size: int) -> Iterator[tuple[int, int]]:
    """Places at which rows with about ``size`` bytes of text begin and end."""
    place = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) // size
    ends = [*np.flatnonzero(np.diff(place, prepend=-1)).tolist(), len(place)]
    return zip(ends, ends[1:])
