"""Sparse JSON-stat cubes: values by flat row-major offset, decoded to one row per published cell."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def cube_schema(dims: Sequence[str]) -> str:
    index = ", ".join(f"`{d}`: struct<category: struct<index: map<string, int>>>" for d in dims)
    return f"id array<string>, size array<int>, value map<string, double>, status map<string, string>, dimension struct<{index}>"


def read_cubes(spark: SparkSession, path: str, dims: Sequence[str]) -> DataFrame:
    """Cached payloads, one JSON document per file, with a declared schema."""
    return spark.read.schema(cube_schema(dims)).json(path, multiLine=True)


def ordered_codes(index: Column) -> Column:
    """The codes of a dimension in the order of their positions."""
    return F.array_sort(F.map_keys(index), lambda a, b: index[a] - index[b])


def tidy(cubes: DataFrame, dims: Sequence[str], with_status: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """One row per published cell: a column per dimension, value and, if asked for, status.

    `dims` is the order of the cube's own ids. The last dimension varies fastest. Cells that aren't in the sparse map
    have no row; a shift of values onto other regions can't happen, as positions come from offsets alone.
    """
    cells = cubes.select(*keep, *(ordered_codes(F.col(f"dimension.`{d}`.category.index")).alias(f"__c_{d}") for d in dims), "size", "status", F.explode(F.map_entries("value")).alias("cell")).withColumn("__left", F.col("cell.key").cast("bigint"))
    out: dict[str, Column] = {}
    stride = F.lit(1).cast("bigint")
    for i in reversed(range(len(dims))):
        size = F.element_at("size", i + 1).cast("bigint")
        position = F.pmod(F.floor(F.col("__left") / stride).cast("bigint"), size)
        out[dims[i]] = F.element_at(f"__c_{dims[i]}", (position + 1).cast("int"))
        stride = stride * size
    extra = [F.element_at("status", F.col("cell.key")).alias("status")] if with_status else []
    return cells.select(*keep, *(out[d].alias(d) for d in dims), F.col("cell.value").alias("value"), *extra)


def build_cube(df: DataFrame, dims: Sequence[str], value: str) -> DataFrame:
    """One cube of a long table with one row per cell; a cube is one document, so it is for tables of a document's size."""
    codes = df.agg(*(F.array_sort(F.collect_set(F.col(d).cast("string"))).alias(d) for d in dims))
    sized = df.crossJoin(F.broadcast(codes.select(*(F.col(d).alias(f"__c_{d}") for d in dims))))  # one row of codes
    offset = F.lit(0).cast("bigint")
    for d in dims:
        offset = offset * F.size(f"__c_{d}") + (F.array_position(f"__c_{d}", F.col(d).cast("string")) - 1)
    cells = sized.where(F.col(value).isNotNull()).agg(F.map_from_entries(F.collect_list(F.struct(offset.cast("string"), F.col(value)))).alias("value"))
    index = lambda d: F.struct(F.struct(F.map_from_arrays(F.col(d), F.sequence(F.lit(0), F.size(d) - 1)).alias("index")).alias("category")).alias(d)
    return codes.crossJoin(cells).select(F.array(*(F.lit(d) for d in dims)).alias("id"), F.array(*(F.size(d) for d in dims)).alias("size"), "value", F.lit(None).cast("map<string,string>").alias("status"), F.struct(*(index(d) for d in dims)).alias("dimension"))
