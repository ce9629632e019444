"""Guards that refuse a plausible wrong answer. Each has a lazy report of the offenders, and a check that raises if there are any."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Names of a frame's country column, in order of preference.
COUNTRY_COLUMNS = ("country", "CNTR_CODE")


class Refused(ValueError):
    """The data answer another question than the one asked."""


def refuse(offenders: DataFrame, why: str, shown: int = 5) -> None:
    """Refused if there are offenders, with the first few."""
    if rows := offenders.limit(shown).collect():
        raise Refused(f"{why}: {[r.asDict() for r in rows]}")


def country_column(df: DataFrame) -> str:
    for name in COUNTRY_COLUMNS:
        if name in df.columns:
            return name
    raise Refused(f"no country column among {COUNTRY_COLUMNS}")


def require_several_countries(df: DataFrame, column: str | None = None) -> DataFrame:
    """`df`; Refused if it holds fewer than two countries, since then nothing in it can be shared across a border."""
    column = column or country_column(df)
    if df.where(F.col(column).isNotNull()).select(column).distinct().limit(2).count() < 2:
        raise Refused(f"one country in {column}: whether a basin is shared can't be told from it")
    return df


def require_one_of(value: object, allowed: Sequence[object], what: str) -> object:
    if value not in allowed:
        raise Refused(f"unknown {what} {value!r}; there are {list(allowed)}")
    return value


def disagreements(df: DataFrame, by: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """(*by, field, n_values, least, greatest): the fields that have several values within a group; NULL is a value."""
    shown = lambda f: F.coalesce(F.col(f).cast("string"), F.lit("NULL"))
    long = df.select(*by, F.inline(F.array(*(F.struct(F.lit(f).alias("field"), shown(f).alias("__v")) for f in fields))))
    one = long.groupBy(*by, "field", "__v").agg(F.lit(1).alias("__one"))  # each value once, before groups are brought together
    return one.groupBy(*by, "field").agg(F.count(F.lit(1)).alias("n_values"), F.min("__v").alias("least"), F.max("__v").alias("greatest")).where("n_values > 1")


def repeated(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(*keys, n): keys that occur more than once; a second file of the same simulation is no second opinion."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def require_one_question(files: DataFrame, fields: Sequence[str], member: Sequence[str]) -> DataFrame:
    """`files`; Refused if they differ in one of `fields` or describe the same member twice, or if there are none."""
    if files.isEmpty():
        raise Refused("an ensemble of nothing has no median")
    refuse(disagreements(files, [], fields), "the files disagree")
    refuse(repeated(files, member), "the same member twice")
    return files


def grid_gaps(cells: DataFrame, layer: str, cell: Sequence[str]) -> DataFrame:
    """(*cell, n_layers, n_all): cells that some layer (a year, say) lacks. Layers on one grid have none."""
    seen = cells.select(layer, *cell).distinct()
    n_all = seen.select(layer).distinct().agg(F.count(F.lit(1)).alias("n_all"))
    return seen.groupBy(*cell).agg(F.count(F.lit(1)).alias("n_layers")).crossJoin(F.broadcast(n_all)).where("n_layers < n_all")  # one row


def require_same_grid(cells: DataFrame, layer: str, cell: Sequence[str]) -> DataFrame:
    """`cells`; Refused if the layers don't have the same cells."""
    refuse(grid_gaps(cells, layer, cell), f"the grids of {layer} differ")
    return cells


def require_same_shape(**masks: DataFrame) -> tuple[int, int, int]:
    """(rows, columns, cells) of masks given as cells (row, col); Refused unless all have the same, since compared cell by cell they'd be about different places."""
    shapes = {name: tuple(m.agg(F.max("row") + 1, F.max("col") + 1, F.count(F.lit(1))).first()) for name, m in masks.items()}
    if len(set(shapes.values())) != 1:
        raise Refused(f"masks on different grids: {shapes}")
    return next(iter(shapes.values()))


def several_owners(df: DataFrame, item: str, owner: str) -> DataFrame:
    """(item, owners): items that more than one owner claims; a district drains into one basin."""
    pairs = df.where(F.col(item).isNotNull() & F.col(owner).isNotNull()).select(item, owner).distinct()
    return pairs.groupBy(item).agg(F.array_sort(F.collect_list(owner)).alias("owners")).where(F.size("owners") > 1)


def require_one_owner(df: DataFrame, item: str, owner: str) -> DataFrame:
    refuse(several_owners(df, item, owner), f"{item} claimed by several {owner}")
    return df
