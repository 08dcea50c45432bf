"""Written tables that cut lineage, in the folder which all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StringType, StructType

#: Tables of up to this many bytes, counted on their rows, are broadcast; larger ones are joined by a shuffle.
BROADCAST_BYTES = 40 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only where that is unset, and only on a local master, a temporary folder is chosen and kept in the
    session; a cluster without the setting is an error, since a machine's own folder is not shared.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="sableframe-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


#: Bytes of rows that a kernel gets at a time. Spark's own bound is 64 MB, which executor and worker hold several times over.
BATCH_BYTES = 1 << 20
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_OPEN: list[list[tuple[SparkSession, str]]] = []


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """A block in which the session has these settings."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def small_batches(spark: SparkSession) -> AbstractContextManager[None]:
    """A block in which kernels get at most ``BATCH_BYTES`` of rows at a time, or one row."""
    return settings(spark, {_BATCH: str(BATCH_BYTES)})


def staged(df: DataFrame, keep: bool = False) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again.

    The copy survives lost executors and is computed once, however often it is read. The shuffle files that
    the write needed are removed when it is done, and kernels get :func:`small_batches`. The copy is removed at the end of the :func:`scratch`
    block around it, unless ``keep`` is given, and at the latest when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/staged-{uuid.uuid4().hex}"
    with settings(spark, {_CLEANUP: "true"}), small_batches(spark):
        df.write.parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    if _OPEN and not keep:
        _OPEN[-1].append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch() -> Iterator[None]:
    """A block at whose end the copies staged in it are removed: what it returns must be staged with ``keep``."""
    mine: list[tuple[SparkSession, str]] = []
    _OPEN.append(mine)
    try:
        yield
    finally:
        _OPEN.remove(mine)
        for spark, path in mine:
            dropped(spark, path)


def dropped(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _bytes(value: Column, kind: DataType) -> Column:
    """About how many bytes a value takes in a row."""
    if isinstance(kind, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)) + 16
    if isinstance(kind, ArrayType):
        inner = 8 if not isinstance(kind.elementType, (StringType, BinaryType, ArrayType, StructType, MapType)) else 64
        return F.greatest(F.size(value), F.lit(0)) * inner + 32
    if isinstance(kind, StructType):
        return sum((_bytes(value[f.name], f.dataType) for f in kind.fields), F.lit(16))
    return F.lit(8)


def small_enough(df: DataFrame, most: int | None = None) -> bool:
    """Whether the rows of ``df``, all of them counted, take at most ``most`` bytes."""
    size = sum((_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(40))
    total = df.agg(F.sum(size.cast("long"))).first()[0] or 0
    return total <= (BROADCAST_BYTES if most is None else most)


def broadcast_if_small(df: DataFrame, most: int | None = None) -> DataFrame:
    """``df``, marked for broadcast if it is :func:`small_enough`."""
    return F.broadcast(df) if small_enough(df, most) else df
