"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Sequence
from contextlib import nullcontext

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.session import RunFolder, passing_shuffles


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


# Spark's own limit for the buckets of a table.
MOST_BUCKETS = 100_000


def bucket_count(rows: DataFrame) -> int:
    """Buckets for rows that a scan gives: as many as it has partitions, or a shuffle would have."""
    return max(partitions(rows.sparkSession), min(rows.rdd.getNumPartitions(), MOST_BUCKETS))


def bucketed(rows: DataFrame, run: RunFolder, name: str, key: str, buckets: int, dealt: bool = False) -> DataFrame:
    """A written table that lies by ``key``, so that groups by it meet other rows without being moved again.

    ``dealt``: the rows come from groups by the same key in as many buckets, and need no shuffle either. The name
    in the catalogue is given up at once; the files stay.
    """
    spark = rows.sparkSession
    held = f"{name}_{uuid.uuid4().hex}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    spark.sql(f"CREATE TABLE {held} ({columns}) USING parquet CLUSTERED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{run.path}/{name}'")
    # an insert is one action of its own, so that its shuffle can pass; creating a table from rows hides it
    with passing_shuffles(spark) if run.passing else nullcontext():
        (rows if dealt else rows.repartition(buckets, key)).write.insertInto(held)
    table = spark.table(held)
    table.schema  # resolved before the name goes
    spark.sql(f"DROP TABLE {held}")
    return table


def remainder(doc_ids: Sequence[int | None], divisor: int) -> np.ndarray:
    """crc32 of each id as text, modulo ``divisor``; -1 for a null id."""
    return np.array([-1 if i is None else zlib.crc32(str(i).encode()) % divisor for i in doc_ids], np.int64)


def pack(values: np.ndarray, level: int = 1) -> bytes:
    """Compressed bytes of an array; its length travels in front."""
    raw = np.ascontiguousarray(values).tobytes()
    return len(raw).to_bytes(8, "little") + (pa.Codec("zstd", level).compress(raw, asbytes=True) if raw else b"")


def unpack(data: bytes, dtype) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    if not size:
        return np.zeros(0, dtype)
    return np.frombuffer(pa.decompress(data[8:], decompressed_size=size, codec="zstd", asbytes=True), dtype)


def pack_fields(*arrays: np.ndarray, level: int = 1) -> bytes:
    """Several arrays in one value; see :func:`unpack_fields`."""
    parts = [pack(a, level) for a in arrays]
    return b"".join(len(p).to_bytes(8, "little") + p for p in parts)


def unpack_fields(data: bytes, *dtypes) -> list[np.ndarray]:
    out, at = [], 0
    for dtype in dtypes:
        size = int.from_bytes(data[at : at + 8], "little")
        out.append(unpack(data[at + 8 : at + 8 + size], dtype))
        at += 8 + size
    return out


def ids(frame: DataFrame, column: str):
    return F.col(column).cast("bigint").alias(column)
