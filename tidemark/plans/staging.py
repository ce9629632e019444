"""Cutting lineage through the cluster's shared folder, and broadcasts of sides whose bytes were measured."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes in memory that a broadcast side may have.
MEMORY_BYTES = 64 << 20

_own_dir: list[str] = []


class NoSharedFolder(RuntimeError):
    """The executors of a cluster have no folder in common that this session names."""


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors reach.

    Where that is unset, a local session, whose driver is its only executor, gets a folder of its own; on a cluster
    NoSharedFolder is raised, since every machine would write to its own disk.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise NoSharedFolder(f"set spark.checkpoint.dir to a folder that all executors of {master} reach")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="tidemark-"))
    return _own_dir[0]


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, removed when this process ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path below the shared folder; the files of a dropped table stay otherwise."""
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session is gone already; the cluster's own retention applies
        pass


def stage(df: DataFrame, name: str) -> DataFrame:
    """`df` written once as a table in the shared folder and read from there.

    The result has no lineage, so a lost executor costs a re-read and not a recomputation, and a table used
    twice is computed once. Unlike Dataset.checkpoint() it does not run the last stage twice and stays columnar.
    Catalyst knows its bytes, so an equi-join with a small one is planned as a broadcast from the start.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage_counted(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """stage, and the number of rows; they are counted as they are written."""
    seen = Observation()
    return stage(df.observe(seen, F.count(F.lit(1)).alias("rows")), name), seen.get["rows"]


def row_bytes(schema: T.StructType) -> Column:
    """About how many bytes a row takes in memory: 8 a field, and what texts and nested values hold."""
    total = F.lit(16 + 8 * len(schema)).cast("bigint")
    for f in schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            total = total + F.coalesce(F.octet_length(c), F.lit(0))
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.NumericType):
            total = total + 8 * F.greatest(F.size(c), F.lit(0))
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            total = total + F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0))
    return total


def measured_side(df: DataFrame, name: str = "side", memory_bytes: int = MEMORY_BYTES) -> DataFrame:
    """`df` staged, as one side of a join: broadcast if its rows take at most `memory_bytes`, else merged after a shuffle.

    The executors add up the rows' bytes as they write them; the driver sees one number. Written again after a
    lost executor, rows may count twice, which only errs towards the shuffle. The join's result is the same either way.
    """
    seen = Observation()
    staged = stage(df.observe(seen, F.sum(row_bytes(df.schema)).alias("bytes")), name)
    return F.broadcast(staged) if (seen.get["bytes"] or 0) <= memory_bytes else staged.hint("merge")


def measured_parts(df: DataFrame, by: str, name: str = "side", memory_bytes: int = MEMORY_BYTES) -> list[DataFrame]:
    """`df` staged and cut by a hash of `by` into as many parts as its measured bytes need, each for a broadcast of at most about `memory_bytes`.

    For a join whose other side is cheaper to read again for each part than to shuffle; the parts' results add up to the whole.
    """
    seen = Observation()
    staged = stage(df.observe(seen, F.sum(row_bytes(df.schema)).alias("bytes")), name)
    n = max(1, -(-(seen.get["bytes"] or 0) // memory_bytes))
    return [F.broadcast(staged.where(F.pmod(F.xxhash64(by), F.lit(n)) == i) if n > 1 else staged) for i in range(n)]


def join_same(left: DataFrame, right: DataFrame, columns: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on `columns` with NULL equal to NULL, keeping the left side's copy of them."""
    names = {c: f"__r_{i}_{c}" for i, c in enumerate(columns)}
    renamed = right.withColumnsRenamed(names)
    condition = F.lit(True)
    for c, r in names.items():
        condition = condition & F.col(c).eqNullSafe(F.col(r))
    joined = left.join(renamed, condition, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*names.values())
