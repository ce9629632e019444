"""Queries and SQL of joins onto regions, guards, selections, labels and dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.values import identifier, measured, nan_to_null
from tidemark.operators import agreement, composite, ensemble, evidence, exposure, guards, hierarchy, layers, selection, star
from tidemark.queries.relational import _N, _R, _regions
from tidemark.queries.text_and_series import SQL as TEXT_SQL
from tidemark.queries.text_and_series import bm25_topk
from tidemark.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return register


_WS = r"[\s\v\x{85}\p{Z}]"
_TRIM = lambda c: f"regexp_replace(lower({c}), '^{_WS}+|{_WS}+$', '', 'g')"
_DENSITY = "CASE WHEN pop_density_per_km2 BETWEEN 0.5 AND 40000 AND NOT isnan(pop_density_per_km2) THEN pop_density_per_km2 END"
_CHANGE = "CASE WHEN v BETWEEN -80 AND 150 AND NOT isnan(v) THEN v END"
_LAYERS = f"d AS (SELECT nuts_id, avg({_DENSITY}) AS density FROM (SELECT DISTINCT * FROM demographics) GROUP BY 1)"


def _density(spark: SparkSession, d: str) -> DataFrame:
    """One row per region: its mean density over all releases."""
    valid = F.when(F.col("pop_density_per_km2").between(0.5, 40_000) & ~F.isnan("pop_density_per_km2"), F.col("pop_density_per_km2"))
    return table(spark, d, "demographics").distinct().groupBy("nuts_id").agg(F.avg(valid).alias("density"))


def _area(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nuts_regions").select("nuts_id", "area_km2")


@query(f"WITH {_LAYERS} SELECT e.load_no, e.nuts_id, e.return_period, {_N('e.exposed_pop')} AS exposed_pop, area_km2, density FROM exposure e LEFT JOIN nuts_regions r ON e.nuts_id = r.nuts_id LEFT JOIN d ON e.nuts_id = d.nuts_id")
def indicators_joined(spark, d) -> DataFrame:
    """Indicators onto the long table of scenarios, many to one, checked."""
    e = nan_to_null(table(spark, d, "exposure").select("load_no", "nuts_id", "return_period", "exposed_pop"))
    return layers.onto(layers.onto(e, _area(spark, d), "nuts_id"), _density(spark, d), "nuts_id")


@query(f"""WITH {_LAYERS}, p AS (SELECT nuts_id, count(v) AS n_changes FROM (SELECT DISTINCT record_id, nuts_id, {_CHANGE.replace('v', 'pluvial_rx5day_change_pct_gwl2_0_p50')} AS v FROM pluvial) GROUP BY 1)
SELECT r.nuts_id, r.area_km2, density, n_changes FROM nuts_regions r LEFT JOIN d USING (nuts_id) LEFT JOIN p USING (nuts_id)""")
def context_assembled(spark, d) -> DataFrame:
    """Layers side by side on the regions."""
    v = F.col("pluvial_rx5day_change_pct_gwl2_0_p50")
    changes = table(spark, d, "pluvial").select("record_id", "nuts_id", F.when(v.between(-80, 150) & ~F.isnan(v), v).alias("v")).distinct().groupBy("nuts_id").agg(F.count("v").alias("n_changes"))
    return layers.assemble(_area(spark, d), [_density(spark, d), changes], "nuts_id")


@query(f"WITH {_LAYERS}, k AS (SELECT nuts_id FROM exposure WHERE nuts_id IS NOT NULL UNION SELECT 'ZZ999') SELECT k.nuts_id, density FROM k LEFT JOIN d USING (nuts_id)")
def reindexed(spark, d) -> DataFrame:
    """The values of a list of keys, NULL for those that have none."""
    keys = table(spark, d, "exposure").select("nuts_id").where("nuts_id IS NOT NULL").union(spark.createDataFrame([("ZZ999",)], "nuts_id string"))
    return layers.reindex(keys, _density(spark, d), "nuts_id")


@query(f"WITH {_LAYERS}, p AS (SELECT nuts2_id, sum(area_km2) AS parent_area FROM nuts_regions GROUP BY 1) SELECT r.nuts_id, density, parent_area FROM nuts_regions r LEFT JOIN d USING (nuts_id) LEFT JOIN p ON substr(r.nuts_id, 1, 4) = p.nuts2_id")
def own_and_parent_values(spark, d) -> DataFrame:
    """A region's own value, and another one of its parent."""
    r = table(spark, d, "nuts_regions")
    parents = r.groupBy("nuts2_id").agg(F.sum("area_km2").alias("parent_area"))
    return layers.own_and_parent(r, "nuts_id", F.substring("nuts_id", 1, 4), _density(spark, d), parents, "nuts2_id")


#: Test groups of nations.
GROUPS = {"1": "north", "2": "north", "3": "south"}


@query("SELECT CASE CAST(n_nationkey AS VARCHAR) WHEN '1' THEN 'north' WHEN '2' THEN 'north' WHEN '3' THEN 'south' ELSE 'district:' || n_nationkey END AS basin, count(*) AS n FROM nation GROUP BY 1")
def declared_groups(spark, d) -> DataFrame:
    """Units by their declared group, the others each a group of its own."""
    return table(spark, d, "nation").groupBy(layers.group_of(F.col("n_nationkey").cast("string"), GROUPS).alias("basin")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT n_name, r_name, count(*) AS n, sum(c_acctbal) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def star_joined(spark, d) -> DataFrame:
    """A fact table with its dimension, whose every key it has."""
    nations = layers.star(table(spark, d, "nation").withColumnRenamed("n_regionkey", "key"), table(spark, d, "region").withColumnRenamed("r_regionkey", "key"), "key").drop("key")
    sales = layers.star(table(spark, d, "customer").withColumnRenamed("c_nationkey", "n_nationkey"), nations, "n_nationkey")
    return sales.groupBy("n_name", "r_name").agg(F.count(F.lit(1)).alias("n"), F.sum("c_acctbal").alias("balance"))


_PIECES = "p AS (SELECT l_suppkey AS region, p_brand AS grp, s_nationkey::VARCHAR AS country, sum(l_quantity) AS area FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey WHERE p_size > 20 GROUP BY ALL)"


@query(f"""WITH {_PIECES}, a AS (SELECT grp, country FROM p GROUP BY ALL HAVING sum(area) >= 1500), g AS (SELECT grp, count(*) AS n FROM a GROUP BY 1),
j AS (SELECT p.*, n FROM p LEFT JOIN g USING (grp)), o AS (SELECT j.region, list_sort(list(DISTINCT a.country)) AS shared_with FROM j JOIN a USING (grp) WHERE n > 1 AND a.country <> j.country GROUP BY 1)
SELECT j.region, count(*) AS groups, coalesce(max(n), 0) AS countries_max, coalesce(any_value(shared_with), []) AS shared_with, coalesce(list(grp ORDER BY area DESC, grp) FILTER (WHERE n > 1), []) AS shared_names FROM j LEFT JOIN o USING (region) GROUP BY j.region""")
def shared_group_sets(spark, d) -> DataFrame:
    """The countries of groups over a floor of area, the other countries of a region's shared groups, their names by area."""
    li = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).where("p_size > 20")
    pieces = li.groupBy(F.col("l_suppkey").alias("region"), F.col("p_brand").alias("grp"), F.col("s_nationkey").cast("string").alias("country")).agg(F.sum("l_quantity").alias("area"))
    return layers.shared_groups(pieces, "region", "grp", "country", "area", 1_500.0)



_FIELDS = ("return_period", "provider", "key_name")


@query(" UNION ALL ".join(f"SELECT load_no, '{f}' AS field, count(DISTINCT coalesce({f}::VARCHAR, 'NULL')) AS n_values, min(coalesce({f}::VARCHAR, 'NULL')) AS least, max(coalesce({f}::VARCHAR, 'NULL')) AS greatest FROM answers GROUP BY 1 HAVING count(DISTINCT coalesce({f}::VARCHAR, 'NULL')) > 1" for f in _FIELDS))
def disagreeing_fields(spark, d) -> DataFrame:
    """H6, U4: fields on which the members of a group should agree and don't."""
    return guards.disagreements(table(spark, d, "answers"), ["load_no"], _FIELDS)


@query(f"SELECT snapshot_no, {_TRIM('source_id')} AS source, count(*) AS n FROM fetch_results GROUP BY ALL HAVING count(*) > 1")
def repeated_members(spark, d) -> DataFrame:
    """H6: members that are there twice."""
    return guards.repeated(table(spark, d, "fetch_results").select("snapshot_no", identifier("source_id").alias("source")), ["snapshot_no", "source"])


@query("WITH s AS (SELECT DISTINCT load_no, nuts_id FROM exposure) SELECT nuts_id, count(*) AS n_layers, (SELECT count(DISTINCT load_no) FROM s) AS n_all FROM s GROUP BY 1 HAVING count(*) < (SELECT count(DISTINCT load_no) FROM s)")
def grid_gaps(spark, d) -> DataFrame:
    """H7: cells that some layer lacks."""
    return guards.grid_gaps(table(spark, d, "exposure"), "load_no", ["nuts_id"])


@query(f"SELECT {_TRIM('source_id')} AS source, list_sort(list(DISTINCT url)) AS owners FROM fetch_results WHERE source_id IS NOT NULL AND url IS NOT NULL GROUP BY 1 HAVING count(DISTINCT url) > 1")
def claimed_twice(spark, d) -> DataFrame:
    """Sources that more than one address claims to hold."""
    return guards.several_owners(table(spark, d, "fetch_results").select(identifier("source_id").alias("source"), F.col("url").alias("owner")), "source", "owner")


@query("SELECT nuts_id, count(*) AS n FROM exposure WHERE length(nuts_id) = 5 GROUP BY 1")
def level_by_code_length(spark, d) -> DataFrame:
    """Regions of one level, told by the length of their codes."""
    return selection.of_level(table(spark, d, "exposure"), "nuts_id", 5).groupBy("nuts_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'range' AS kind, year(o_orderdate) AS y, count(*) AS n FROM orders WHERE year(o_orderdate) BETWEEN 1994 AND 1996 GROUP BY ALL UNION ALL SELECT 'one', year(o_orderdate), count(*) FROM orders WHERE year(o_orderdate) = 1995 GROUP BY ALL")
def orders_within_years(spark, d) -> DataFrame:
    """A range of years with both ends, and one year."""
    o, year = table(spark, d, "orders"), F.year("o_orderdate")
    one = lambda kind, *span: selection.within_years(o, year, *span).groupBy(F.lit(kind).alias("kind"), year.alias("y")).agg(F.count(F.lit(1)).alias("n"))
    return one("range", 1994, 1996).unionByName(one("one", 1995))


@query(f"SELECT source, count(*) AS n FROM documents WHERE {_TRIM('source')} = 'delta_hearings' GROUP BY 1")
def trimmed_case_free(spark, d) -> DataFrame:
    """A filter that the service ignored, applied here without regard to case and white space."""
    return table(spark, d, "documents").where(selection.same_text("source", " Delta_Hearings ")).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


_OTHER = ("load_no", "return_period", "annual_probability", "cells_counted")


@query(f"""SELECT 'indicator' AS kind, column_name AS name FROM (DESCRIBE exposure) WHERE column_type IN ('DOUBLE', 'BIGINT', 'INTEGER') AND column_name NOT IN {_OTHER!r}
UNION ALL SELECT 'prefix', replace(column_name, 'pluvial_', '') FROM (DESCRIBE pluvial) WHERE starts_with(column_name, 'pluvial_')""")
def columns_found(spark, d) -> DataFrame:
    """Columns found by their kind and by a prefix."""
    rows = [("indicator", c) for c in selection.indicator_columns(table(spark, d, "exposure"), _OTHER)]
    rows += [("prefix", p) for p in selection.columns_with_prefix(table(spark, d, "pluvial"), "pluvial_")]
    return spark.createDataFrame(rows, "kind string, name string")


MEMBERS = ("XD", "XQ", "XA")


@query(f"SELECT coalesce(country IN {MEMBERS!r}, false) AS member, count(*) AS n FROM exposure GROUP BY 1")
def member_flag(spark, d) -> DataFrame:
    """Members of a list and the others."""
    return table(spark, d, "exposure").groupBy(selection.member_of(F.col("country"), MEMBERS).alias("member")).agg(F.count(F.lit(1)).alias("n"))


_COVER = "SELECT o_custkey, count(*) AS n, sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS part FROM orders GROUP BY 1"


@query(f"""WITH c AS ({_COVER}), v AS (SELECT 'worst' AS view, o_custkey, row_number() OVER (ORDER BY part ASC NULLS FIRST, o_custkey) AS place FROM c
UNION ALL SELECT 'largest', o_custkey, row_number() OVER (ORDER BY part DESC NULLS LAST, o_custkey) FROM c UNION ALL SELECT 'keys', o_custkey, row_number() OVER (ORDER BY n DESC, part ASC NULLS LAST, o_custkey) FROM c)
SELECT * FROM v WHERE place <= 7 UNION ALL SELECT 'names', c_custkey, row_number() OVER (ORDER BY lower(c_mktsegment) DESC NULLS LAST, c_custkey) AS place FROM customer QUALIFY place <= 7""")
def ordered_views(spark, d) -> DataFrame:
    """Worst first with what isn't measured, largest first, by several keys, and texts with missing ones last."""
    c = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))).alias("part"))
    key, last = F.col("o_custkey"), selection.missing_last
    names = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    views = [("worst", c, [selection.worst_first("part"), key]), ("largest", c, [last("part", True), key]), ("keys", c, [F.desc("n"), last("part", False), key]), ("names", names, [last("c_mktsegment", True, text=True), key])]
    parts = [selection.top(df, order, 7).select(F.lit(name).alias("view"), "o_custkey", "place") for name, df, order in views]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("SELECT passage_id, row_number() OVER (ORDER BY ordinal, passage_id) AS place FROM (SELECT DISTINCT passage_id, ordinal FROM passages WHERE source = 'consolidated_register.md') QUALIFY place <= 5")
def first_in_order(spark, d) -> DataFrame:
    """T4: the first rows in the order that the table carries itself."""
    p = table(spark, d, "passages").where("source = 'consolidated_register.md'").select("passage_id", "ordinal").distinct()
    return selection.top(p, [F.col("ordinal"), F.col("passage_id")], 5).select("passage_id", "place")


@query("SELECT share_over_65_year AS text, try_cast(trim(share_over_65_year) AS DOUBLE) AS number, count(*) AS n FROM exposure GROUP BY ALL")
def numbers_read(spark, d) -> DataFrame:
    """texts as numbers, where they are."""
    return table(spark, d, "exposure").groupBy(F.col("share_over_65_year").alias("text"), selection.to_number("share_over_65_year").alias("number")).agg(F.count(F.lit(1)).alias("n"))


@query("WITH m AS (SELECT event_type, max(value * 200000) AS top FROM events GROUP BY 1) SELECT e.event_type, sum(CASE WHEN top > 1e7 THEN value * 200000 / 1e6 ELSE value * 200000 END) AS km2, sum(value / 1e6) AS from_m2 FROM events e JOIN m USING (event_type) GROUP BY 1")
def upstream_areas(spark, d) -> DataFrame:
    """areas whose unit follows from the largest, or is given."""
    e = table(spark, d, "events")
    largest = e.groupBy("event_type").agg(F.max(F.col("value") * 200_000).alias("top"))
    return e.join(largest, "event_type").groupBy("event_type").agg(F.sum(selection.upstream_km2(F.col("value") * 200_000, F.col("top"))).alias("km2"), F.sum(selection.upstream_km2(F.col("value"), F.lit(0.0), "m ** 2")).alias("from_m2"))


@query("""SELECT DISTINCT pluvial_ref_period AS given, array_to_string(regexp_extract_all(pluvial_ref_period, '(18|19|20)\\d{2}'), '-') AS label, regexp_replace(lower(pluvial_ref_period), '[^a-z0-9]', '', 'g') AS token FROM pluvial
UNION ALL SELECT DISTINCT provider, provider, regexp_replace(lower(provider), '[^a-z0-9]', '', 'g') FROM answers""")
def labels_normalised(spark, d) -> DataFrame:
    """periods and names in one form."""
    one = lambda df, c: df.select(F.col(c).alias("given"), selection.period_label(F.col(c)).alias("label"), selection.token(F.col(c)).alias("token")).distinct()
    return one(table(spark, d, "pluvial"), "pluvial_ref_period").unionByName(one(table(spark, d, "answers"), "provider"))


@query(f"""SELECT snapshot_no, count(*) FILTER (WHERE contains(regexp_replace(lower(url), '[^a-z0-9]', '', 'g'), regexp_replace(lower(source_id), '[^a-z0-9]', '', 'g'))) AS n_within,
count(*) FILTER (WHERE status IS NULL OR status <> 200) AS n_status FROM fetch_results GROUP BY 1""")
def request_matches(spark, d) -> DataFrame:
    """whether an address holds the name of its source, and which fields of a delivery differ from what was asked."""
    f = table(spark, d, "fetch_results")
    wrong = selection.field_mismatches({"status": F.col("status").cast("string"), "url": F.col("url")}, {"status": "200"}, {"url": "example"})
    return f.groupBy("snapshot_no").agg(F.count_if(selection.holds_token(F.col("url"), F.col("source_id"))).alias("n_within"), F.count_if(F.array_contains(wrong, "status")).alias("n_status"))


@query("SELECT o_orderkey, try_cast(printf('%04d-%02d-%02d', year(o_orderdate), month(o_orderdate), day(o_orderdate) + 3) AS DATE) AS moved, year(coalesce(CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderdate END, TIMESTAMP '1990-05-05 00:00:00')) AS year FROM orders")
def dates_read(spark, d) -> DataFrame:
    """dates from their parts, NULL for a day that isn't, and years with a fallback."""
    o, at = table(spark, d, "orders"), F.col("o_orderdate")
    text = F.when(F.col("o_orderstatus") == "F", "").otherwise(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"))
    return o.select("o_orderkey", selection.date_of(F.year(at), F.month(at), F.day(at) + 3).alias("moved"), selection.year_of(text, F.lit("1990-05-05")).alias("year"))


@query("SELECT nuts_id FROM nuts_regions WHERE starts_with(nuts_id, 'XQ') OR starts_with(nuts_id, 'XA1')")
def outermost_regions(spark, d) -> DataFrame:
    """regions outside the frame of a map, by prefix."""
    return table(spark, d, "nuts_regions").where(selection.outermost(F.col("nuts_id"), ("XQ", "XA1"))).select("nuts_id")


@query("SELECT c_custkey, n_name || CASE WHEN c_acctbal > 5000 THEN '' ELSE ', Art. ' || c_mktsegment END || ' — https://example.invalid/' || n_nationkey AS citation FROM customer JOIN nation ON c_nationkey = n_nationkey")
def citations_rendered(spark, d) -> DataFrame:
    """citations by a registry that must know them."""
    c = table(spark, d, "customer")
    articles = c.groupBy("c_nationkey").agg(F.collect_set("c_mktsegment").alias("articles"))
    registry = table(spark, d, "nation").join(articles, F.col("n_nationkey") == F.col("c_nationkey")).select(F.col("n_nationkey").alias("instrument"), F.col("n_name").alias("short"), F.concat(F.lit("https://example.invalid/"), F.col("n_nationkey").cast("string")).alias("url"), "articles")
    asked = c.select("c_custkey", F.col("c_nationkey").alias("instrument"), F.when(F.col("c_acctbal") <= 5_000, F.col("c_mktsegment")).alias("article"))
    return selection.cited(asked, "instrument", "article", registry).select("c_custkey", "citation")


@query(f"""SELECT DISTINCT passage_id, '| ' || passage_id || ' | ' || coalesce(replace(trim(regexp_replace(source, '{_WS}+', ' ', 'g')), '|', '\\|'), '') || ' | ' || coalesce(replace(trim(regexp_replace(text, '{_WS}+', ' ', 'g')), '|', '\\|'), '') || ' |' AS line FROM passages""")
def markdown_rows(spark, d) -> DataFrame:
    """Rows of a Markdown table."""
    return table(spark, d, "passages").select("passage_id", selection.markdown_row(F.col("passage_id"), F.col("source"), F.col("text")).alias("line")).distinct()


@query("SELECT c_custkey, printf('%+.0f%%', c_acctbal) AS percent, format('{:,}', cast(round(c_acctbal) AS BIGINT)) AS digits FROM customer WHERE abs(c_acctbal - floor(c_acctbal) - 0.5) > 0.01")
def formatted_values(spark, d) -> DataFrame:
    """F32: signed per cent and digits in groups."""
    c = table(spark, d, "customer").where(F.abs(F.col("c_acctbal") - F.floor("c_acctbal") - 0.5) > 0.01)
    return c.select("c_custkey", selection.signed_percent(F.col("c_acctbal")).alias("percent"), selection.grouped_digits(F.col("c_acctbal")).alias("digits"))


@query(f"SELECT substr(nuts_id, 1, 4) AS nuts2, avg({_DENSITY}) AS mean_density, count(*) FILTER (WHERE {_TRIM('pop_density_flag')} = 'b') AS n_break FROM (SELECT DISTINCT * FROM demographics) WHERE length(nuts_id) = 5 GROUP BY 1")
def mean_by_group(spark, d) -> DataFrame:
    """The mean of a published rate by group, at one level, with its flags."""
    v = F.col("pop_density_per_km2")
    valid = F.when(v.between(0.5, 40_000) & ~F.isnan(v), v)
    return selection.of_level(table(spark, d, "demographics").distinct(), "nuts_id", 5).groupBy(F.substring("nuts_id", 1, 4).alias("nuts2")).agg(F.avg(valid).alias("mean_density"), F.count_if(selection.same_text("pop_density_flag", "b")).alias("n_break"))


@query(f"SELECT load_no, nuts_id, {_N('exposed_pop')} AS exposed_pop, return_period, 1.0 / return_period AS annual_probability FROM exposure WHERE return_period IN (10, 100, 500)")
def stacked_scenarios(spark, d) -> DataFrame:
    """Frames of single scenarios stacked, with their probability."""
    e = nan_to_null(table(spark, d, "exposure").select("load_no", "nuts_id", "exposed_pop", "return_period"))
    return exposure.stacked({p: e.where(F.col("return_period") == p).drop("return_period") for p in (10, 100, 500)})


_WET = "(SELECT l_suppkey, l_quantity / 10 > 2.5 AS m, l_discount * 100 > 5 AS o, l_linestatus = 'F' AS s, l_returnflag = 'R' AS r, l_tax > 0.01 AS dm FROM lineitem)"


@query(f"""WITH c AS (SELECT l_suppkey, count(*) AS n_cells, count(*) FILTER (WHERE s AND m AND o) AS hits, count(*) FILTER (WHERE s AND NOT m AND o) AS misses, count(*) FILTER (WHERE s AND m AND NOT o) AS false_alarms,
count(*) FILTER (WHERE s AND NOT m AND o AND r) AS misses_in_runoff, count(*) FILTER (WHERE s AND NOT m AND o AND NOT r) AS misses_outside_runoff, count(*) FILTER (WHERE s AND m AND o AND NOT r) AS ho, count(*) FILTER (WHERE s AND NOT dm) AS outside_domain FROM {_WET} GROUP BY 1)
SELECT l_suppkey, n_cells, hits, misses, false_alarms, misses_in_runoff, misses_outside_runoff, outside_domain, CASE WHEN hits + misses >= 25 THEN hits / nullif(hits + misses, 0) END AS hit_rate, CASE WHEN hits + misses >= 25 THEN false_alarms / nullif(hits + false_alarms, 0) END AS false_alarm_ratio,
CASE WHEN hits + misses >= 25 THEN hits / nullif(hits + misses + false_alarms, 0) END AS overlap, CASE WHEN hits + misses >= 25 THEN ho / nullif(ho + misses_outside_runoff, 0) END AS hit_rate_outside_runoff,
CASE WHEN hits + misses >= 25 AND hits + misses > 0 THEN 'hit rate ' || printf('%.1f', 100 * hits / (hits + misses)) || ' %' ELSE 'hit rate not defined' END || ' of ' || (hits + misses) || ' observed cells' AS headline FROM c""")
def agreement_by_unit(spark, d) -> DataFrame:
    """Modelled against observed with the runoff split, cells outside the model, and a sentence."""
    li = table(spark, d, "lineitem")
    modelled, observed = agreement.modelled_wet(F.col("l_quantity") / 10, 2.5), agreement.observed_wet(F.col("l_discount") * 100, 0.05)
    scores = agreement.confusion(li, ["l_suppkey"], modelled, observed, F.col("l_linestatus") == "F", runoff=F.col("l_returnflag") == "R", domain=agreement.modelled_domain(F.col("l_tax") - 0.02, -0.02) & (F.col("l_tax") > 0.01))
    return agreement.headline(scores)


@query("""WITH a AS (SELECT s_nationkey, sum(s_acctbal) AS area, sum(CASE WHEN s_acctbal > 5000 THEN s_acctbal ELSE 0 END) AS flooded FROM supplier GROUP BY 1), c AS (SELECT DISTINCT CASE n_regionkey WHEN 3 THEN 2 ELSE n_regionkey END AS k FROM nation WHERE n_regionkey IN (0, 1, 3)),
j AS (SELECT n_nationkey, n_regionkey, CASE WHEN k IS NOT NULL THEN coalesce(area, 0) END AS area, CASE WHEN k IS NOT NULL THEN coalesce(flooded, 0) END AS flooded FROM nation LEFT JOIN a ON n_nationkey = s_nationkey LEFT JOIN c ON k = n_regionkey)
SELECT n_nationkey AS key, area, flooded, flooded / nullif(area, 0) AS share FROM j""")
def shares_where_reported(spark, d) -> DataFrame:
    """A share that is NULL where the country reports nothing, 0 where it reports and the region has none; one country is renamed."""
    regions = table(spark, d, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_regionkey").cast("string").alias("country"))
    areas = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("key")).agg(F.sum("s_acctbal").alias("area"), F.sum(F.when(F.col("s_acctbal") > 5_000, F.col("s_acctbal")).otherwise(0.0)).alias("flooded"))
    return agreement.shares_where_reported(regions, areas, regions.where(F.col("country").isin("0", "1", "3")), "key", "country", "area", "flooded", {"3": "2"})


@query(f"SELECT load_no, country, sum(CASE WHEN x IS NOT NULL AND t IS NOT NULL THEN x END) AS exposed_pop, sum(CASE WHEN x IS NOT NULL AND t IS NOT NULL THEN t END) AS total_pop, count(*) FILTER (WHERE x IS NOT NULL AND t IS NOT NULL) AS n_both, sum(CASE WHEN x IS NOT NULL AND t IS NOT NULL THEN x END) / nullif(sum(CASE WHEN x IS NOT NULL AND t IS NOT NULL THEN t END), 0) AS share FROM (SELECT load_no, country, {_N('exposed_pop')} AS x, {_N('total_pop')} AS t FROM exposure WHERE return_period = 100) GROUP BY ALL")
def both_measured_share(spark, d) -> DataFrame:
    """Totals over the rows where both sides are measured, and their ratio."""
    e = nan_to_null(table(spark, d, "exposure")).where("return_period = 100")
    return agreement.both_measured_share(e, ["load_no", "country"], "exposed_pop", "total_pop")


@query("SELECT nuts_id AS region_code, region, country, country_name, nuts2_id, area_km2 FROM nuts_regions WHERE area_km2 IS NOT NULL")
def tidied_long(spark, d) -> DataFrame:
    """The region column found by its content, rows that aren't measured dropped."""
    return ensemble.tidy_long(table(spark, d, "nuts_regions"), "area_km2")


@query(f"SELECT nuts_id, {', '.join(f'quantile_cont(CASE WHEN release_no = {r} THEN x END, 0.5) AS m{r}' for r in (1, 2))} FROM (SELECT nuts_id, release_no, {_CHANGE} AS x FROM (SELECT *, pluvial_extreme_precip_days_change_pct_gwl2_0_p50 AS v FROM pluvial)) GROUP BY 1")
def medians_side_by_side(spark, d) -> DataFrame:
    """Medians of several members as columns."""
    v = F.col("pluvial_extreme_precip_days_change_pct_gwl2_0_p50")
    p = table(spark, d, "pluvial").select("nuts_id", "release_no", F.when(v.between(-80, 150) & ~F.isnan(v), v).alias("x"))
    return ensemble.medians_side_by_side(p, "nuts_id", {f"m{r}": F.col("release_no") == r for r in (1, 2)}, "x")


@query(f"SELECT load_no, country, sum(CASE WHEN poverty > 15 THEN exposed END) AS exposed_shared, sum(CASE WHEN poverty > 15 THEN exposed END) / nullif(sum(exposed), 0) AS shared_share, sum(pop) AS expected_annual, count(*) FILTER (WHERE o65 > 0.2) AS regions_declared, count(*) AS regions, count(*) FILTER (WHERE poverty > 15) AS regions_shared FROM {_R} GROUP BY ALL")
def bi_shared_basins(spark, d) -> DataFrame:
    """Measures over shared regions; which those are stands in for a column that these tables lack."""
    return _regions(spark, d).groupBy("load_no", "country").agg(*star.shared_measures("exposed", "pop", F.col("poverty") > 15, F.col("o65") > 0.2))


@query(f"""WITH p AS (SELECT load_no, return_period, sum({_N('exposed_pop')}) AS v FROM exposure GROUP BY ALL)
SELECT 'none' AS filter, '1-in-100-year river flood' AS label, 100 AS selected, load_no, max(CASE WHEN return_period = 100 THEN v END) AS v FROM p GROUP BY load_no
UNION ALL SELECT 'one', '1-in-500-year river flood', 500, load_no, max(CASE WHEN return_period = 500 THEN v END) FROM p GROUP BY load_no
UNION ALL SELECT 'two', 'Pick one return period', NULL, load_no, NULL FROM p GROUP BY load_no""")
def bi_filter_context(spark, d) -> DataFrame:
    """The measure, the scenario and its label under no choice, one, and several, which leave it blank."""
    e, parts = table(spark, d, "exposure"), []
    for name, chosen in (("none", None), ("one", [500]), ("two", [10, 500])):
        one = star.chosen_scenario(chosen, 100)
        v = star.selected_scenario(e, "return_period", ["load_no"], "exposed_pop", 100, chosen)
        parts.append(v.select(F.lit(name).alias("filter"), F.lit(star.scenario_label(chosen, 100)).alias("label"), F.lit(one).cast("int").alias("selected"), "load_no", F.col("exposed_pop_selected").alias("v")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"SELECT query_id, 'S' || rank AS id, b.doc_id, substr(text, 1, 600) AS text, round(score, 3) AS score FROM ({TEXT_SQL['bm25_topk']}) b JOIN documents d ON b.doc_id = d.doc_id")
def evidence_ids(spark, d) -> DataFrame:
    """Hits as numbered sources with excerpts."""
    return evidence.evidence_rows(bm25_topk(spark, d), table(spark, d, "documents"), "query_id", "doc_id", "text")


@query("WITH p AS (SELECT n_regionkey, sum(c_acctbal) AS v FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1), t AS (SELECT sum(c_acctbal) AS v FROM customer) SELECT n_regionkey, p.v AS value, p.v / nullif(t.v, 0) AS ratio FROM p CROSS JOIN t")
def ratio_to_parent_level(spark, d) -> DataFrame:
    """A3: a unit's total against that of the level above."""
    c = table(spark, d, "customer")
    units = layers.onto(c.withColumnRenamed("c_nationkey", "n_nationkey"), table(spark, d, "nation"), "n_nationkey").groupBy("n_regionkey").agg(F.sum("c_acctbal").alias("value"))
    return hierarchy.ratio_to_total(units, c.agg(F.sum("c_acctbal").alias("total")), "value")


@query(f"SELECT request_id, lau_id, s FROM (SELECT request_id, lau_id, {_N('share_over_65')} AS s, row_number() OVER (PARTITION BY request_id ORDER BY {_N('share_over_65')} DESC NULLS LAST, lau_id) AS rn FROM (SELECT DISTINCT request_id, lau_id, share_over_65 FROM vulnerability_units)) WHERE rn = 1")
def first_by_score(spark, d) -> DataFrame:
    """The first unit of each request, by an aggregation."""
    u = table(spark, d, "vulnerability_units").select("request_id", "lau_id", measured("share_over_65").alias("s")).distinct()
    best = u.groupBy("request_id").agg(F.min(F.struct(F.coalesce(-F.col("s"), F.lit(float("inf"))).alias("k"), "lau_id", "s")).alias("b"))
    return best.select("request_id", "b.lau_id", "b.s")
