"""Tables in the folder that all executors share, and the size checks for broadcasts."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes up to which a side is broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 64 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in `spark.checkpoint.dir`, which driver and executors share.

    Where none is set, a local session takes a temporary folder, and any other fails: a folder of the driver's machine is no use there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = _local_folder()
    return folder.rstrip("/")


@functools.cache
def _local_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="siftwork-")


def fresh(df: DataFrame, name: str) -> str:
    """`name`, with underscores after it until no column of `df` has it (letter case aside)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def spill(df: DataFrame, name: str) -> DataFrame:
    """Writes `df` to a fresh shared folder and reads it back: cuts the lineage and outlives lost executors."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _bytes_of(df: DataFrame) -> Column:
    """About the bytes of a row."""
    total = F.lit(16)
    for field in df.schema.fields:
        column, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, T.StringType | T.BinaryType):
            size = F.octet_length(column)
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType | T.BinaryType):
            size = F.aggregate(column, F.lit(0), lambda n, x: n + F.coalesce(F.octet_length(x), F.lit(0)) + 16)
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.NumericType):
            size = F.size(column) * 8
        elif isinstance(kind, T.ArrayType | T.MapType | T.StructType):
            size = F.octet_length(F.to_json(F.struct(column)))
        else:
            size = F.lit(8)
        total = total + F.coalesce(size, F.lit(0))
    return total.cast("long")


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """`df`, marked for broadcast if a count proves that it has at most `rows` rows and BROADCAST_BYTES bytes; else as it is, to be shuffled."""
    n, size = df.limit(rows + 1).agg(F.count(F.lit(1)), F.sum(_bytes_of(df))).first()
    return F.broadcast(df) if n <= rows and (size or 0) <= BROADCAST_BYTES else df
