"""Selections and readings of columns: code levels, years, texts, members, orders, labels, dates, numbers, citations."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.values import identifier

#: Members of the union, prefixes of its outermost regions, length of a climate normal, and the largest
#: upstream area in square kilometres that can be meant.
EU27 = tuple("AT BE BG HR CY CZ DK EE FI FR DE EL HU IE IT LV LT LU MT NL PL PT RO SK SI ES SE".split())
OUTERMOST = ("FRY", "PT20", "PT30", "ES70", "NO0B")
NORMAL_YEARS, LARGEST_KM2 = 30, 1e7


def of_level(df: DataFrame, code: str, length: int) -> DataFrame:
    """Rows whose code has exactly `length` characters: 2 a country, 4 a NUTS2, 5 a NUTS3 region. Levels repeat each other, so only one may be summed."""
    return df.where(F.length(code) == length)


def within_years(df: DataFrame, year: Column, first: int, last: int | None = None) -> DataFrame:
    """Rows of one year, or of a range with both ends."""
    return df.where(year.between(first, first if last is None else last))


def same_text(column: Column | str, value: str) -> Column:
    """Equal without regard to case and to white space around it; a service's own filter may be ignored, so it is applied here."""
    return identifier(column) == F.lit(value.strip().lower())


def member_of(column: Column, members: Iterable[str] = EU27) -> Column:
    """Whether the value is one of a list; NULL is none of it."""
    return F.coalesce(column.isin(list(members)), F.lit(False))


def known_ids(df: DataFrame, key: str, ids: Sequence[str]) -> DataFrame:
    """(key, known, n_rows): one row per id asked for, those that the table lacks included."""
    asked = F.broadcast(df.sparkSession.createDataFrame([(i,) for i in dict.fromkeys(ids)], f"{key} string"))  # the request itself
    counts = df.where(F.col(key).isin(list(ids))).groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"))
    return asked.join(counts, key, "left").select(key, F.col("n_rows").isNotNull().alias("known"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"))


def indicator_columns(df: DataFrame, other: Iterable[str]) -> list[str]:
    """The numeric columns that aren't in `other` (keys, years, counts), in the order of the table."""
    left_out = set(other)
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in left_out]


def columns_with_prefix(df: DataFrame, prefix: str) -> dict[str, str]:
    """Column by what stands behind the prefix, in the order of the table: the periods or scenarios that a wide table has."""
    return {c[len(prefix) :]: c for c in df.columns if c.startswith(prefix)}


def top(df: DataFrame, order: Sequence[Column], k: int, place: str = "place") -> DataFrame:
    """The first k rows of a total order, numbered from 1. Each task keeps k rows, and one numbers the k that are left."""
    first = df.orderBy(*order).limit(k)
    return first.withColumn(place, F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))


def missing_last(column: str, descending: bool, text: bool = False) -> Column:
    """For tables shown to people: missing values last both ways, texts without regard to case."""
    c = F.lower(column) if text else F.col(column)
    return c.desc_nulls_last() if descending else c.asc_nulls_last()


def worst_first(column: str) -> Column:
    """Ascending, what isn't measured before everything else."""
    return F.col(column).asc_nulls_first()


def to_number(column: Column | str) -> Column:
    """The number that a text holds, NULL for any other text."""
    c = F.col(column) if isinstance(column, str) else column
    return F.trim(c).try_cast("double")


def upstream_km2(value: Column, largest: Column, unit: str = "") -> Column:
    """An upstream area in square kilometres: from its unit, or, without one, taken for square metres where the field's `largest` value can't be square kilometres."""
    bare = unit.lower().replace(" ", "")
    if bare in ("km2", "km**2", "km^2", "km-2"):
        return value
    if bare in ("m2", "m**2", "m^2"):
        return value / 1e6
    if bare:
        raise ValueError(f"unknown unit of an area {unit!r}")
    return F.when(largest > LARGEST_KM2, value / 1e6).otherwise(value)


def _first_number(value: Column) -> Column:
    return F.regexp_extract(value.cast("string"), r"(\d+(?:\.\d+)?)", 1).try_cast("double")


def warming_label(value: Column) -> Column:
    """1.5, "+1.5C" or "gwl_1.5" as 1p5, 2.0 as 2; NULL for what holds no number."""
    n = _first_number(value)
    text = F.when(n == F.floor(n), n.cast("bigint").cast("string")).otherwise(n.cast("string"))
    return F.replace(text, F.lit("."), F.lit("p"))


def quantile_percent(value: Column) -> Column:
    """0.5, "q50" or "50th" as 50; a number up to 1 is a fraction."""
    n = _first_number(value)
    return F.bround(F.when(n <= 1, n * 100).otherwise(n)).cast("int")


def period_label(value: Column) -> Column:
    """A reference period as 1991-2020: of two years as they stand, of one the normal that begins there; any other text as it is."""
    text = value.cast("string")
    years = F.regexp_extract_all(text, F.lit(r"(?<!\d)((?:18|19|20)\d{2})(?!\d)"), F.lit(1))
    first = F.get(years, F.lit(0)).cast("int")
    return F.when(F.size(years) >= 2, F.concat_ws("-", F.slice(years, 1, 2))).when(F.size(years) == 1, F.concat_ws("-", first.cast("string"), (first + NORMAL_YEARS - 1).cast("string"))).otherwise(text)


def token(value: Column) -> Column:
    """Lower-case letters and digits alone, so that spellings of one name become one."""
    return F.regexp_replace(F.lower(value), "[^a-z0-9]", "")


def holds_token(whole: Column, part: Column) -> Column:
    """Whether a name, in whatever spelling, stands within another."""
    return F.contains(token(whole), token(part))


def field_mismatches(fields: Mapping[str, Column], exact: Mapping[str, str], within: Mapping[str, str]) -> Column:
    """The names of the fields that differ from a request, in order: some must be equal, of others the request's spelling must stand within."""
    wrong = [F.when(F.coalesce(fields[k] != F.lit(v), F.lit(True)), k) for k, v in exact.items()]
    wrong += [F.when(~F.coalesce(holds_token(fields[k], F.lit(v)), F.lit(False)), k) for k, v in within.items()]
    return F.array_compact(F.array(*wrong))


def date_of(year: Column, month: Column, day: Column) -> Column:
    """The date of three numbers, NULL where there is no such day."""
    return F.try_make_timestamp(year, month, day, F.lit(0), F.lit(0), F.lit(0)).cast("date")


def year_of(text: Column, otherwise: Column) -> Column:
    """The year of a time in ISO form, of `otherwise` where that is missing; NULL where it can't be read."""
    return F.year(F.try_to_timestamp(F.coalesce(F.nullif(F.trim(text), F.lit("")), otherwise)))


def outermost(column: Column, prefixes: Sequence[str] = OUTERMOST) -> Column:
    """Whether a code is of a region outside the usual frame of a map."""
    hit = F.lit(False)
    for p in prefixes:
        hit = hit | F.startswith(column, F.lit(p))
    return F.coalesce(hit, F.lit(False))


def citation(short: Column, article: Column, url: Column) -> Column:
    """<short>, Art. <article> — <url>, without the article where there is none."""
    return F.concat(short, F.when(article.isNull(), "").otherwise(F.concat(F.lit(", Art. "), article)), F.lit(" — "), url)


def cited(df: DataFrame, instrument: str, article: str, registry: DataFrame, out: str = "citation") -> DataFrame:
    """`df` with the citation by a registry (instrument, short, url, articles ARRAY<STRING>); the query fails for an instrument or article that the registry lacks, rather than print one nobody checked."""
    known = registry.select(F.col(instrument).alias("__i"), F.col("short").alias("__s"), F.col("url").alias("__u"), F.col("articles").alias("__a"))
    joined = df.join(known, F.col(instrument) == F.col("__i"), "left")
    fine = F.col("__i").isNotNull() & (F.col(article).isNull() | F.coalesce(F.array_contains("__a", F.col(article)), F.lit(False)))
    text = F.when(fine, citation(F.col("__s"), F.col(article), F.col("__u"))).otherwise(F.raise_error(F.concat(F.lit("not in the registry: "), F.coalesce(F.col(instrument), F.lit("NULL")), F.lit(" "), F.coalesce(F.col(article), F.lit("")))))
    return joined.withColumn(out, text).drop("__i", "__s", "__u", "__a")


def signed_percent(value: Column) -> Column:
    """+12% or -3%."""
    return F.format_string("%+.0f%%", value)


def grouped_digits(value: Column) -> Column:
    """Whole numbers with a comma between thousands."""
    return F.format_number(value, 0)


def markdown_row(*cells: Column) -> Column:
    """One row of a Markdown table: line breaks become spaces, bars are escaped; NULL is an empty cell."""
    tidy = [F.replace(F.trim(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"(?U)\s+", " ")), F.lit("|"), F.lit("\\|")) for c in cells]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *tidy), F.lit(" |"))


def without_local_links(text: Column) -> Column:
    """Markdown links to other .md files reduced to their text; links with http stay."""
    return F.regexp_replace(text, r"\[([^\]]+)\]\((?!https?:)[^)]*\.md[^)]*\)", "$1")
