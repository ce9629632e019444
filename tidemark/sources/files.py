"""Files as tables: provenance from names, corpora of documents, GeoJSON layers, cell tables, paged services, legacy names."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidemark.operators.evidence import html_to_text
from tidemark.operators.grid import laea_europe

#: Names that the tables had before, and names of the variables of a gridded file.
LEGACY = {"poverty_rate": "poverty_rate_pct", "poverty_rate_year": "poverty_rate_pct_year", "poverty_rate_level": "poverty_rate_pct_level"}
SPATIAL = {"lat": ("lat", "latitude", "y"), "lon": ("lon", "longitude", "x")}


def with_current_names(df: DataFrame, names: Mapping[str, str] = LEGACY) -> DataFrame:
    """Old column names made current; a table that has both keeps both as they are."""
    there = set(df.columns)
    return df.withColumnsRenamed({old: new for old, new in names.items() if old in there and new not in there})


def by_alias(df: DataFrame, aliases: Mapping[str, Sequence[str]] = SPATIAL) -> DataFrame:
    """Columns renamed to the name they are an alias of; ValueError if one has none or several."""
    renamed = {}
    for name, others in aliases.items():
        found = [c for c in df.columns if c.lower() in others]
        if len(found) != 1:
            raise ValueError(f"{name}: expected one of {others}, found {found}")
        renamed[found[0]] = name
    return df.withColumnsRenamed(renamed)


def name_fields(path: Column, pattern: str, names: Sequence[str]) -> Column:
    """A struct of the fields that a file's name carries, by the groups of a pattern; NULL if the name hasn't that form."""
    name = F.element_at(F.split(path, "/"), -1)
    whole = name.rlike(pattern)
    return F.when(whole, F.struct(*(F.regexp_extract(name, pattern, i + 1).alias(n) for i, n in enumerate(names))))


def discover(spark: SparkSession, path: str, pattern: str, names: Sequence[str]) -> DataFrame:
    """(path, length, <names>) of the files whose names have the form; content isn't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    return files.withColumn("__f", name_fields(F.col("path"), pattern, names)).where("__f IS NOT NULL").select("path", "length", "__f.*")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of every file below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """(source, text): text and Markdown files as they are, HTML without its markup, other files as empty texts."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("content").cast("string").alias("raw"))
    suffix, name = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)), F.element_at(F.split("path", "/"), -1)
    plain = files.where(suffix.isin("txt", "md")).select(name.alias("source"), F.col("raw").alias("text"))
    pages = files.where(suffix.isin("html", "htm")).select(name.alias("source"), html_to_text("raw").alias("text"))
    rest = files.where(~suffix.isin("txt", "md", "html", "htm")).select(name.alias("source"), F.lit("").alias("text"))
    return plain.unionByName(pages).unionByName(rest)


def geojson(spark: SparkSession, path: str, properties: Mapping[str, str]) -> DataFrame:
    """Polygons of GeoJSON files: the properties (name to type) and rings ARRAY<ARRAY<STRUCT<x, y>>>, several parts of one feature together.

    Coordinates are read as text and parsed by the geometry's own type, as polygons and multipolygons nest differently.
    """
    fields = ", ".join(f"`{n}`: {t}" for n, t in properties.items())
    features = spark.read.schema(f"features array<struct<properties: struct<{fields}>, geometry: struct<type: string, coordinates: string>>>").json(path, multiLine=True).select(F.explode("features").alias("f"))
    points = lambda ring: F.transform(ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    one = F.transform(F.from_json("f.geometry.coordinates", "array<array<array<double>>>"), points)
    many = F.transform(F.flatten(F.from_json("f.geometry.coordinates", "array<array<array<array<double>>>>")), points)
    opened = lambda ring: F.when(ring[0] == F.element_at(ring, -1), F.slice(ring, 1, F.size(ring) - 1)).otherwise(ring)
    rings = F.transform(F.when(F.col("f.geometry.type") == "Polygon", one).otherwise(many), opened)
    return features.select("f.properties.*", rings.alias("rings"))


def reference_of(spark: SparkSession, path: str) -> str:
    """The name of the reference system that a GeoJSON file declares; ValueError if it declares none, since guessing one moves every region."""
    names = spark.read.schema("crs struct<properties: struct<name: string>>").json(path, multiLine=True).select("crs.properties.name").distinct().limit(2).collect()
    if len(names) != 1 or names[0][0] is None:
        raise ValueError(f"{path}: expected one declared reference system, found {[n[0] for n in names]}")
    return names[0][0]


def in_metres(polygons: DataFrame) -> DataFrame:
    """Polygons in longitude and latitude with their rings in the metres of the equal-area projection of Europe; empty ones are dropped."""

    def moved(p: Column) -> Column:
        x, y = laea_europe(p["x"], p["y"])
        return F.struct(x.alias("x"), y.alias("y"))

    there = polygons.where(F.size("rings") > 0)
    return there.withColumn("rings", F.transform("rings", lambda ring: F.transform(ring, moved)))


def cells_from_grid(df: DataFrame, values: str, x0: float, y0: float, step: float, nodata: float | None = None) -> DataFrame:
    """Rows (row, values ARRAY) of a raster as cells (row, col, x, y, value) with centres; nodata and NaN become NULL."""
    cells = df.select("row", F.posexplode(values).alias("col", "raw"))
    raw = F.col("raw").cast("double")
    value = F.when(~F.isnan(raw) & (F.lit(True) if nodata is None else raw != nodata), raw)
    return cells.select("row", "col", (x0 + (F.col("col") + 0.5) * step).alias("x"), (y0 - (F.col("row") + 0.5) * step).alias("y"), value.alias("value"))


class Page(InputPartition):
    def __init__(self, offset: int) -> None:
        self.offset = offset


class PagedSource(DataSource):
    """A paged service as a source: one partition per page, so pages are fetched in parallel and a lost task fetches its page again.

    Options: `total` rows, `page_size`, and the page reader, given once per process with `PagedSource.reading(fetch)`:
    fetch(offset, limit) returns (rows, more), rows being tuples in the order of the schema. A page that says there
    is more after the last one, or less before it, is an error, as the layer would be cut short without a sign.
    """

    fetch: Callable[[int, int], tuple[Sequence[tuple], bool]] | None = None
    shape = "value string"

    @classmethod
    def reading(cls, fetch: Callable, shape: str, name: str = "paged") -> type[PagedSource]:
        return type("Paged", (cls,), {"fetch": staticmethod(fetch), "shape": shape, "name": classmethod(lambda _: name)})

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return self.shape

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(type(self).fetch, int(self.options["total"]), int(self.options["page_size"]))


class PagedReader(DataSourceReader):
    def __init__(self, fetch: Callable, total: int, size: int) -> None:
        self.fetch, self.total, self.size = fetch, total, size

    def partitions(self) -> list[InputPartition]:
        return [Page(i) for i in range(0, max(self.total, 1), self.size)]

    def read(self, partition: Page) -> Iterator[tuple]:
        rows, more = self.fetch(partition.offset, self.size)
        last = partition.offset + self.size >= self.total
        if more and last or not more and not last:
            raise RuntimeError(f"the service ends at another page than its total says (offset {partition.offset})")
        yield from rows


