"""Intermediate tables in the shared folder.

Tables that are used more than once, or that cut lineage in a loop, are written as Parquet below
``spark.checkpoint.dir`` (a folder that every executor and the driver share), so a lost executor costs
only the tasks it was running.
"""

from __future__ import annotations

import atexit
import contextvars
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A side is broadcast only when its measured size is at most this.
BROADCAST_BYTES = 32 << 20
#: What a row costs in a broadcast hash table besides its values.
ROW_BYTES = 32

_runs: dict[str, str] = {}
#: Scopes of the running context, innermost last; a thread has its own unless it is run in a copied context.
_scopes: contextvars.ContextVar[tuple[list[str], ...]] = contextvars.ContextVar("scopes", default=())


def shared_dir(spark: SparkSession) -> str:
    """Folder of this run in ``spark.checkpoint.dir``, as a full URI. Where that is unset, a temporary
    folder serves a local master; a cluster is refused, as its executors would each write their own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = _runs.get("own") or _runs.setdefault("own", "file://" + tempfile.mkdtemp(prefix="mnemolith-"))
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
    base = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()
    base = "file://" + base.removeprefix("file:") if base.startswith("file:/") and not base.startswith("file://") else base
    key = f"{spark.sparkContext.applicationId}|{base}"
    if key not in _runs:
        _runs[key] = f"{base.rstrip('/')}/mnemolith-{uuid.uuid4().hex[:12]}"
        atexit.register(_remove_at_exit, spark, _runs[key])
    return _runs[key]


def remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _remove_at_exit(spark: SparkSession, path: str) -> None:
    """Drop the run's folder when the driver's interpreter ends; a stopped session keeps it."""
    try:
        remove(spark, path)
    except Exception:  # the gateway may be gone at exit
        pass


class Scratch:
    """Tables materialized inside the block are deleted at its end, but for those given to ``keep``. What other
    threads materialize meanwhile isn't touched."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self) -> Scratch:
        self.mine: list[str] = []
        self.token = _scopes.set((*_scopes.get(), self.mine))
        return self

    def keep(self, df: DataFrame) -> DataFrame:
        """The table written so that it outlives the block."""
        token = _scopes.set(_scopes.get()[:-1])
        try:
            return materialize(df)
        finally:
            _scopes.reset(token)

    def __exit__(self, *error) -> None:
        _scopes.reset(self.token)
        for path in self.mine:
            remove(self.spark, path)


def materialize(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it again: computed once, lineage cut."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    if _scopes.get():
        _scopes.get()[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def value_bytes(value: Column, kind: T.DataType) -> Column:
    """Bytes that a value takes in a row, by its real length."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        size = 16 + F.octet_length(value)
    elif isinstance(kind, T.StructType):
        size = sum((value_bytes(value.getField(f.name), f.dataType) for f in kind.fields), F.lit(8))
    elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.NumericType):
        size = 16 + 8 * F.size(value)
    elif isinstance(kind, T.ArrayType):
        size = 16 + F.aggregate(value, F.lit(0).cast("long"), lambda a, e: a + value_bytes(e, kind.elementType))
    else:
        size = F.lit(8)
    return F.coalesce(size.cast("long"), F.lit(8).cast("long"))


def table_bytes(df: DataFrame) -> int:
    """Measured size of all rows as a broadcast would hold them."""
    row = sum((value_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(ROW_BYTES))
    return df.agg(F.sum(row.cast("long"))).first()[0] or 0


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Mark a materialized table for broadcast if its measured size is at most ``limit``; else leave the
    join to a shuffle."""
    return F.broadcast(df) if table_bytes(df) <= limit else df
