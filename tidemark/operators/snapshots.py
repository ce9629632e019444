"""What changed between consecutive full snapshots of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.values import row_hash
from tidemark.plans.staging import measured_side


def snapshot_changes(df: DataFrame, snapshot: str, key: Column, compare: Sequence[Column], version: str | None = None, key_name: str = "key") -> DataFrame:
    """Rows (`snapshot`, `key_name`, change_kind) with change_kind added, removed or changed against the next lower snapshot present.

    Every row is tagged twice, as the present side of its own snapshot and as the past side of the next one;
    one grouping by snapshot and key then holds both sides, each reduced to the hash of its latest `version`.
    That is one shuffle with partial aggregation, whatever the number of snapshots, and a key or snapshot that
    holds most rows is reduced before it is sent.

    NULL equals NULL and differs from any value, in the key as in `compare`. Of equal versions the larger hash
    counts, so repeats and ties give one result; a NULL version is the oldest. Rows whose snapshot is NULL are
    in no snapshot. The first snapshot, and an empty table, have no changes.
    """
    present = df.filter(F.col(snapshot).isNotNull())
    numbers = present.select(F.col(snapshot).alias("__at")).distinct()
    steps = measured_side(numbers.select("__at", F.lead("__at").over(Window.orderBy("__at")).alias("__next"), (F.row_number().over(Window.orderBy("__at")) == 1).alias("__first")))
    state = F.struct(F.col(version) if version else F.lit(0), row_hash(compare))
    tagged = present.join(steps, F.col(snapshot).eqNullSafe(F.col("__at"))).select(
        key.alias("__key"),
        state.alias("__state"),
        F.explode(F.filter(F.array(F.struct(F.when(~F.col("__first"), F.col("__at")).alias("at"), F.lit(True).alias("now")), F.struct(F.col("__next").alias("at"), F.lit(False).alias("now"))), lambda s: s["at"].isNotNull())).alias("__side"),
    )
    sides = tagged.groupBy(F.col("__side.at").alias("__at"), "__key").agg(F.max(F.when(F.col("__side.now"), F.col("__state"))).alias("now"), F.max(F.when(~F.col("__side.now"), F.col("__state"))).alias("past"))
    kind = F.when(F.col("past").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("now.col2") != F.col("past.col2"), "changed")
    return sides.select(F.col("__at").alias(snapshot), F.col("__key").alias(key_name), kind.alias("change_kind")).filter("change_kind IS NOT NULL")
