"""Queries and SQL of the relational operators: specifications, levels, scenarios, indices, star measures, pivots, classes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.values import identifier, measured, nan_to_null, safe_ratio
from tidemark.operators import checks, composite, ensemble, exposure, hierarchy, selection, shaping, star
from tidemark.operators.query_spec import Filter, Plan, ask, with_share
from tidemark.plans.ordered import quantiles
from tidemark.plans.staging import join_same, stage
from tidemark.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    """Register the query under its name, with the SQL that DuckDB runs beside it."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


#: Columns that a specification may name, and what they mean.
DEFINITIONS = {
    "nuts_id": "code of the region", "region": "name of the region", "country": "code of the country", "country_name": "name of the country", "total_pop": "people", "hazard_coverage": "share of the cells that the hazard map covers", "exposed_pop": "people in the flooded area",
    "exposed_share": "exposed_pop / total_pop", "return_period": "years", "annual_probability": "chance per year", "share_over_65": "share of people over 65", "share_over_65_year": "year", "poverty_rate_pct": "per cent", "poverty_rate_pct_year": "year", "poverty_rate_pct_level": "level of the value",
}
TOP_SPEC = {"columns": ["region", "exposed_share"], "filters": [{"column": "country", "op": "==", "value": "XD"}, {"column": "exposed_share", "op": "<=", "value": 1.0}], "sort": {"column": "exposed_share", "descending": True}, "limit": 5, "return_period": 100}
NULL_SPEC = {"columns": ["exposed_pop"], "filters": [{"column": "poverty_rate_pct", "op": ">=", "value": 10}, {"column": "exposed_pop", "op": "not_null"}], "return_period": 500}


def _ask(spark: SparkSession, d: str, spec: dict):
    return ask(spec, table(spark, d, "exposure"), list(DEFINITIONS), beside={"exposed_pop": "hazard_coverage"}, ties=["load_no"], definitions=DEFINITIONS)


_N = lambda c: f"CASE WHEN isnan({c}) THEN NULL ELSE {c} END"


@query(f"""SELECT nuts_id, region, s AS exposed_share FROM (SELECT *, {_N('exposed_pop')} / nullif({_N('total_pop')}, 0) AS s FROM exposure WHERE return_period = 100)
WHERE country = 'XD' AND s <= 1.0 ORDER BY s DESC NULLS LAST, load_no, nuts_id LIMIT 5""")
def ask_spec_topn(spark, d) -> DataFrame:
    """The regions of a country with the largest share exposed, in one scenario."""
    return _ask(spark, d, TOP_SPEC).rows


@query(f"""SELECT count(*) FILTER (WHERE p >= 10 AND e IS NOT NULL) AS matched, count(*) FILTER (WHERE p IS NULL AND NOT coalesce(p >= 10 AND e IS NOT NULL, false)) AS null_excluded
FROM (SELECT {_N('poverty_rate_pct')} AS p, {_N('exposed_pop')} AS e FROM exposure WHERE return_period = 500)""")
def ask_null_excluded(spark, d) -> DataFrame:
    """How many rows match and how many fall out because a filtered column is NULL."""
    return _ask(spark, d, NULL_SPEC).counts


MATRIX = [("==", "c_mktsegment", "BUILDING"), ("!=", "c_mktsegment", "BUILDING"), ("<", "bal", 100.0), ("<=", "bal", 100.0), (">", "bal", 9_000.0), (">=", "bal", 9_000.0), ("in", "c_mktsegment", ["BUILDING", "MACHINERY"]), ("not_in", "c_mktsegment", ["BUILDING", "MACHINERY"]), ("is_null", "bal", None), ("not_null", "bal", None), ("contains", "c_mktsegment", "hold")]


def _matrix_sql() -> str:
    forms = {"==": "= 'BUILDING'", "!=": "<> 'BUILDING'", "<": "< 100", "<=": "<= 100", ">": "> 9000", ">=": ">= 9000", "in": "IN ('BUILDING', 'MACHINERY')", "not_in": "NOT IN ('BUILDING', 'MACHINERY')", "is_null": "IS NULL", "not_null": "IS NOT NULL", "contains": "ILIKE '%hold%'"}
    rows = [f"SELECT '{op}' AS op, count(*) FILTER (WHERE {c} {forms[op]}) AS matched, {'0' if 'null' in op else f'count(*) FILTER (WHERE {c} IS NULL)'} AS null_excluded FROM c" for op, c, _ in MATRIX]
    return "WITH c AS (SELECT CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS bal, CASE WHEN c_custkey % 11 <> 0 THEN c_mktsegment END AS c_mktsegment FROM customer) " + " UNION ALL ".join(rows)


@query(_matrix_sql())
def ask_spec_filters_matrix(spark, d) -> DataFrame:
    """Every operator over columns with NULLs, in one pass."""
    c = table(spark, d, "customer").select(F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")).alias("bal"), F.when(F.col("c_custkey") % 11 != 0, F.col("c_mktsegment")).alias("c_mktsegment"))
    plans = [Plan("bal", (), (Filter(column, op, value),)) for op, column, value in MATRIX]
    keep = [F.coalesce(p.keep(), F.lit(False)) for p in plans]
    one = c.agg(*(F.count_if(k).alias(f"m{i}") for i, k in enumerate(keep)), *(F.count_if(p.null_hit() & ~k).alias(f"n{i}") for i, (p, k) in enumerate(zip(plans, keep))))
    return one.select(F.inline(F.array(*(F.struct(F.lit(op).alias("op"), F.col(f"m{i}").alias("matched"), F.col(f"n{i}").alias("null_excluded")) for i, (op, _, _) in enumerate(MATRIX)))))


@query("""WITH f AS (SELECT unnest(from_json(json_extract(spec, '$.filters'), '["JSON"]')) AS x FROM answers)
SELECT json_extract_string(x, '$.column') AS column_name, json_extract_string(x, '$.op') AS op, count(*) AS n FROM f GROUP BY ALL""")
def answer_spec_filters(spark, d) -> DataFrame:
    """Which columns and operators the stored specifications filter on."""
    spec = F.from_json("spec", "filters array<struct<column: string, op: string>>")
    return table(spark, d, "answers").select(F.explode(spec["filters"]).alias("f")).groupBy(F.col("f.column").alias("column_name"), F.col("f.op").alias("op")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT load_no, return_period, count(*) AS n_rows, count(*) FILTER (WHERE {_N('exposed_pop')} IS NULL) AS n_unmeasured, coalesce(sum({_N('exposed_pop')}), 0) AS exposed_pop_sum FROM exposure GROUP BY ALL")
def scenario_summary(spark, d) -> DataFrame:
    """Per load and scenario, never across."""
    return exposure.scenario_summary(table(spark, d, "exposure"), ["load_no", "return_period"])


@query("SELECT count(*) AS n_rows, count(DISTINCT nuts_id) AS n_regions, count(DISTINCT return_period) AS n_scenarios, count(*) FILTER (WHERE hazard_coverage >= 0.9 AND NOT isnan(hazard_coverage)) AS n_well_covered FROM exposure")
def meta_counts(spark, d) -> DataFrame:
    """A39, A40."""
    return table(spark, d, "exposure").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("nuts_id").alias("n_regions"), F.count_distinct("return_period").alias("n_scenarios"), F.count_if(measured("hazard_coverage") >= 0.9).alias("n_well_covered"))


@query(f"""SELECT load_no, nuts_id, exposed_share FROM (SELECT load_no, nuts_id, s AS exposed_share, row_number() OVER (PARTITION BY load_no ORDER BY s DESC NULLS LAST, nuts_id) AS rn FROM (SELECT DISTINCT load_no, nuts_id, {_N('exposed_pop')} / nullif({_N('total_pop')}, 0) AS s FROM exposure WHERE return_period = 100 AND upper(nuts_id) LIKE 'XD%')) WHERE rn <= 10""")
def key_prefix_rank(spark, d) -> DataFrame:
    """In every load the ten first of the regions with a prefix, by share."""
    e = with_share(nan_to_null(table(spark, d, "exposure"))).where((F.col("return_period") == 100) & F.startswith(F.upper("nuts_id"), F.lit("XD"))).select("load_no", "nuts_id", "exposed_share").distinct()
    line = Window.partitionBy("load_no").orderBy(F.col("exposed_share").desc_nulls_last(), "nuts_id")
    return e.withColumn("rn", F.row_number().over(line)).where("rn <= 10").drop("rn")


ASKED = ["XD111", "XD112", "ZZ999", "XQ100"]


@query(f"SELECT a.nuts_id, count(e.nuts_id) > 0 AS known, count(e.nuts_id) AS n_rows FROM (SELECT unnest({ASKED!r}) AS nuts_id) a LEFT JOIN exposure e ON a.nuts_id = e.nuts_id GROUP BY a.nuts_id")
def profile_ids_with_unknown(spark, d) -> DataFrame:
    """Ids asked for, and which of them the table doesn't know."""
    return selection.known_ids(table(spark, d, "exposure"), "nuts_id", ASKED)


@query("SELECT c_nationkey, sum(c_acctbal) AS c_acctbal, count(*) AS n_rows, count(DISTINCT c_mktsegment) AS n_events, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS c_mktsegment FROM customer GROUP BY 1")
def level_totals(spark, d) -> DataFrame:
    """A1: sums, distinct events and sorted sets at one level."""
    return hierarchy.totals_by_unit(table(spark, d, "customer"), "c_nationkey", "c_acctbal", events="c_mktsegment", sets=["c_mktsegment"])


@query("SELECT p_brand, sum(p_retailprice) AS p_retailprice, count(*) AS n_rows, array_to_string(list_sort(list_distinct(flatten(list(string_split(p_type, ' '))))), ' ') AS p_type FROM part GROUP BY 1")
def delimited_union(spark, d) -> DataFrame:
    """A2: union of delimited lists."""
    return hierarchy.totals_by_unit(table(spark, d, "part"), "p_brand", "p_retailprice", lists=["p_type"], separator=" ")


@query("""WITH p AS (SELECT c_nationkey AS k, sum(o_totalprice) AS parent_total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1), c AS (SELECT s_nationkey AS k, sum(l_extendedprice) AS child_total, count(DISTINCT s_suppkey) AS n_children FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1)
SELECT coalesce(p.k, c.k) AS nationkey, parent_total, coalesce(child_total, 0) AS child_total, coalesce(n_children, 0) AS n_children, parent_total - coalesce(child_total, 0) AS unattributed, coalesce(child_total, 0) / nullif(parent_total, 0) AS coverage_ratio FROM p FULL OUTER JOIN c ON p.k = c.k""")
def level_coverage_outer(spark, d) -> DataFrame:
    """What the children of a unit carry of its own total, orphans kept on both sides."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    parents = o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("nationkey")).agg(F.sum("o_totalprice").alias("total"))
    units = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.sum("l_extendedprice").alias("total"))
    children = units.join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return hierarchy.level_coverage(parents, children, "nationkey", "s_nationkey", "total")


@query("SELECT r.nuts_id, p.area AS parent_area_km2 FROM nuts_regions r LEFT JOIN (SELECT nuts2_id, sum(area_km2) AS area FROM nuts_regions GROUP BY 1) p ON substr(r.nuts_id, 1, 4) = p.nuts2_id")
def parent_prefix_lookup(spark, d) -> DataFrame:
    """The parent's value by the first four characters of the code."""
    r = table(spark, d, "nuts_regions")
    parents = r.groupBy("nuts2_id").agg(F.sum("area_km2").alias("area"))
    return hierarchy.parent_value(r.select("nuts_id"), parents, "nuts_id", F.substring("nuts_id", 1, 4), "nuts2_id", "area", "parent_area_km2")


_OK = "pop_density_per_km2 BETWEEN 0.5 AND 40000 AND NOT isnan(pop_density_per_km2)"


@query(f"""WITH v AS (SELECT DISTINCT * FROM demographics), o AS (SELECT nuts_id, release_no, substr(nuts_id, 1, 4) AS nuts2, avg(CASE WHEN {_OK} THEN pop_density_per_km2 END) AS d FROM v GROUP BY ALL),
p AS (SELECT nuts2, release_no, avg(d) AS pd FROM o GROUP BY ALL)
SELECT nuts_id, release_no, coalesce(d, pd) AS density, CASE WHEN d IS NOT NULL THEN 'own' WHEN pd IS NOT NULL THEN 'parent' END AS level FROM o LEFT JOIN p USING (nuts2, release_no)""")
def own_else_parent(spark, d) -> DataFrame:
    """A region's own density, else its parent's, and which it is."""
    valid = F.when(F.col("pop_density_per_km2").between(0.5, 40_000) & ~F.isnan("pop_density_per_km2"), F.col("pop_density_per_km2"))
    own = table(spark, d, "demographics").distinct().groupBy("nuts_id", "release_no").agg(F.avg(valid).alias("density")).withColumn("unit", F.concat_ws("/", F.substring("nuts_id", 1, 4), "release_no"))
    parents = own.groupBy("unit").agg(F.avg("density").alias("density"))
    return hierarchy.own_else_parent(own, parents, "unit", ["density"]).select("nuts_id", "release_no", "density", "level")


@query("""WITH n AS (SELECT o_orderpriority, year(o_orderdate) AS y, count(DISTINCT o_custkey) AS k FROM orders GROUP BY ALL), l AS (SELECT *, lag(k) OVER (PARTITION BY o_orderpriority ORDER BY y) AS p FROM n)
SELECT o_orderpriority, max(y) AS y, max_by(k, y) AS n_units FROM l WHERE p IS NULL OR k >= 0.9 * p GROUP BY 1""")
def latest_substantial_year(spark, d) -> DataFrame:
    """The newest year that is substantially there."""
    return hierarchy.latest_full_period(table(spark, d, "orders").withColumn("y", F.year("o_orderdate")), "y", "o_custkey", by=["o_orderpriority"])


@query("""WITH s AS (SELECT o_custkey, sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN o_totalprice END) AS part, count(DISTINCT CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN o_orderpriority END) AS n_buckets, sum(o_totalprice) AS whole FROM orders GROUP BY 1)
SELECT o_custkey, n_buckets, CASE WHEN n_buckets = 2 THEN part END AS part, whole, CASE WHEN n_buckets = 2 THEN part / nullif(whole, 0) END AS share FROM s""")
def disjoint_bucket_share(spark, d) -> DataFrame:
    """Share of disjoint buckets, only where all of them are there."""
    o = table(spark, d, "orders").select("o_custkey", F.inline(F.array(F.struct(F.col("o_orderpriority").alias("bucket"), F.col("o_totalprice").alias("v")), F.struct(F.lit("TOTAL").alias("bucket"), F.col("o_totalprice").alias("v")))))
    return hierarchy.bucket_share(o, "o_custkey", "bucket", "v", "TOTAL", ["1-URGENT", "2-HIGH"])


_E = f"(SELECT DISTINCT load_no, nuts_id, return_period, annual_probability AS p, {_N('exposed_pop')} AS x FROM exposure)"


@query(f"""WITH s AS (SELECT *, lag(x) OVER w AS lx, lag(p) OVER w AS lp FROM {_E} WINDOW w AS (PARTITION BY load_no, nuts_id ORDER BY p)),
a AS (SELECT load_no, nuts_id, count(*) AS n, count(*) FILTER (WHERE x IS NULL) AS gaps, sum((x + lx) / 2 * (p - lp)) AS area, min(p) AS lo, max(p) AS hi, max_by(x, p) AS last FROM s GROUP BY ALL),
g AS (SELECT *, CASE WHEN gaps > 0 THEN 'missing_exposure' WHEN n < 2 THEN 'insufficient_return_periods' ELSE 'integrated' END AS status, 0.5 * last * greatest(1 - hi, 0) AS tail FROM a)
SELECT load_no, nuts_id, n AS n_return_periods, CASE WHEN status = 'integrated' THEN area END AS expected_annual_exposure, CASE WHEN status = 'integrated' THEN tail END AS frequent_tail_exposure,
CASE WHEN status = 'integrated' THEN area + tail END AS expected_annual_exposure_closed, CASE WHEN status = 'integrated' THEN lo END AS probability_band_low, CASE WHEN status = 'integrated' THEN hi END AS probability_band_high, status FROM g""")
def trapezoid_expected_exposure(spark, d) -> DataFrame:
    """Expected annual exposure of every region in every load."""
    e = table(spark, d, "exposure").select("load_no", "nuts_id", "return_period", "annual_probability", measured("exposed_pop").alias("exposed_pop")).distinct()
    return exposure.expected_annual_exposure(e, ["load_no", "nuts_id"])


@query(f"SELECT load_no, nuts_id, max(CASE WHEN return_period = 10 THEN {_N('exposed_pop')} END) AS exposed_pop_rp10, max(CASE WHEN return_period = 100 THEN {_N('exposed_pop')} END) AS exposed_pop_rp100, max(CASE WHEN return_period = 500 THEN {_N('exposed_pop')} END) AS exposed_pop_rp500 FROM exposure GROUP BY ALL")
def pivot_scenario_wide(spark, d) -> DataFrame:
    """One column per scenario."""
    return exposure.wide_by_scenario(table(spark, d, "exposure"), ["load_no", "nuts_id"], "return_period", "exposed_pop", [10, 100, 500], "exposed_pop_rp")


@query(f"""SELECT load_no, country, return_period, sum(e) AS observed, sum(t) AS people, sum(t * h) AS covered_people, avg(h) AS mean_coverage, count(*) AS n_cells, sum(e) * sum(t) / nullif(sum(t * h), 0) AS extrapolated
FROM (SELECT load_no, country, return_period, {_N('exposed_pop')} AS e, {_N('total_pop')} AS t, {_N('hazard_coverage')} AS h FROM exposure) GROUP BY ALL""")
def extrapolated_exposure(spark, d) -> DataFrame:
    """Additive sums first, one division at the end."""
    return exposure.extrapolated(table(spark, d, "exposure"), ["load_no", "country", "return_period"], "exposed_pop", "total_pop", "hazard_coverage")


_UNITS = ("share_over_65", "share_low_income", "poverty_rate_pct")


@query("SELECT request_id, " + ", ".join(f"min({c}) AS low_{c}, max({c}) AS high_{c}" for c in _UNITS) + " FROM vulnerability_units GROUP BY 1")
def minmax_bounds(spark, d) -> DataFrame:
    """Bounds of each indicator, by request."""
    return composite.indicator_bounds(table(spark, d, "vulnerability_units"), list(_UNITS), ["request_id"])


def _scaled_sql(c: str) -> str:
    return f"CASE WHEN u.{c} IS NULL THEN NULL WHEN high_{c} = low_{c} THEN 0 ELSE least(greatest((u.{c} - low_{c}) / (high_{c} - low_{c}), 0), 1) END"


@query(f"""WITH u AS (SELECT DISTINCT request_id, lau_id, computed_at, {', '.join(_UNITS)} FROM vulnerability_units), b AS ({SQL['minmax_bounds']}), s AS (SELECT u.request_id, lau_id, computed_at, {', '.join(f'{_scaled_sql(c)} AS s_{c}' for c in _UNITS)} FROM u JOIN b USING (request_id))
SELECT request_id, lau_id, computed_at, ({' + '.join(f'coalesce(s_{c} * {w}, 0)' for c, w in zip(_UNITS, (1.0, 2.0, 1.0)))}) / nullif({' + '.join(f'CASE WHEN s_{c} IS NULL THEN 0 ELSE {w} END' for c, w in zip(_UNITS, (1.0, 2.0, 1.0)))}, 0) AS vulnerability,
({' + '.join(f'CASE WHEN s_{c} IS NULL THEN 0 ELSE {w} END' for c, w in zip(_UNITS, (1.0, 2.0, 1.0)))}) / 4.0 AS indicator_coverage FROM s""")
def composite_index(spark, d) -> DataFrame:
    """Index over what is measured, and how much that is."""
    u = table(spark, d, "vulnerability_units").select("request_id", "lau_id", "computed_at", *_UNITS).distinct()
    return composite.composite_index(u, dict(zip(_UNITS, (1.0, 2.0, 1.0))), ["request_id"]).select("request_id", "lau_id", "computed_at", "vulnerability", "indicator_coverage")


_W = {"price": 1.0, "quantity": 1.0, "n_items": 0.5}


def _suppliers(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.min("l_extendedprice").alias("price"), F.sum("l_quantity").alias("quantity"), F.count(F.lit(1)).cast("double").alias("n_items"))


def _stability_sql() -> str:
    draws = ", ".join("(" + ", ".join([str(i), *map(repr, row)]) + ")" for i, row in enumerate(composite.draw_weights(_W, 0.3, 200, 0)))
    s = ", ".join(f"({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) AS s_{c}" for c in _W)
    mean = lambda ws: f"({' + '.join(f's_{c} * {w}' for c, w in zip(_W, ws))}) / ({' + '.join(ws)})"
    return f"""WITH u AS (SELECT l_suppkey, min(l_extendedprice) AS price, sum(l_quantity) AS quantity, count(*)::DOUBLE AS n_items FROM lineitem GROUP BY 1), s AS (SELECT l_suppkey, {s} FROM u),
w(draw, w0, w1, w2) AS (VALUES {draws}), x AS (SELECT l_suppkey, draw, {mean(['w0', 'w1', 'w2'])} AS score FROM s CROSS JOIN w),
r AS (SELECT l_suppkey, count(*) OVER (PARTITION BY draw ORDER BY score DESC RANGE UNBOUNDED PRECEDING) AS rk FROM x), h AS (SELECT l_suppkey, avg(CASE WHEN rk <= 10 THEN 1.0 ELSE 0.0 END) AS f FROM r GROUP BY 1)
SELECT l_suppkey, {mean([repr(w) for w in _W.values()])} AS vulnerability, 1.0 AS indicator_coverage, f AS top_n_frequency, CASE WHEN f >= 0.8 THEN 'robust' ELSE 'indicative' END AS confidence FROM s JOIN h USING (l_suppkey)"""


@query(_stability_sql())
def rank_stability_montecarlo(spark, d) -> DataFrame:
    """How often a unit is among the first ten under perturbed weights."""
    return composite.rank_stability(_suppliers(spark, d), "l_suppkey", _W)


@query("SELECT o_orderkey, o_orderpriority, count(*) OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC RANGE UNBOUNDED PRECEDING) AS pessimistic_rank FROM orders")
def pessimistic_rank(spark, d) -> DataFrame:
    """Ties take their last rank."""
    return composite.pessimistic_ranks(table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), ["o_orderpriority"], "o_totalprice").drop("o_totalprice")


@query("SELECT l_suppkey, count(*) AS n_points, " + ", ".join(f"CASE WHEN count(*) >= 10 THEN quantile_cont(l_extendedprice, {p}) END AS {n}" for p, n in ((0.25, "p25"), (0.5, "median"), (0.75, "p75"))) + " FROM lineitem GROUP BY 1")
def quartiles_with_min_points(spark, d) -> DataFrame:
    """Exact quartiles, NULL under ten points."""
    return ensemble.quartiles(table(spark, d, "lineitem"), ["l_suppkey"], "l_extendedprice")


_PL = "(SELECT DISTINCT nuts_id, release_no, CASE WHEN v BETWEEN -80 AND 150 AND NOT isnan(v) THEN v END AS v, CASE WHEN x BETWEEN -80 AND 150 AND NOT isnan(x) THEN x END AS x FROM (SELECT *, pluvial_rx5day_change_pct_gwl2_0_p50 AS v, pluvial_extreme_precip_days_change_pct_gwl2_0_p50 AS x FROM pluvial))"


def _pluvial(spark, d) -> DataFrame:
    within = lambda c: F.when(F.col(c).between(-80, 150) & ~F.isnan(c), F.col(c))
    return table(spark, d, "pluvial").select("nuts_id", "release_no", within("pluvial_rx5day_change_pct_gwl2_0_p50").alias("v"), within("pluvial_extreme_precip_days_change_pct_gwl2_0_p50").alias("x")).distinct()


@query(f"""SELECT nuts_id, quantile_cont(v, 0.5) AS ensemble_median, min(v) AS ensemble_min, max(v) AS ensemble_max, quantile_cont(v, 0.25) AS ensemble_p25, quantile_cont(v, 0.75) AS ensemble_p75, count(v) AS ensemble_members,
count(v) >= 2 AND (count(*) FILTER (WHERE v > 0) = count(v) OR count(*) FILTER (WHERE v < 0) = count(v)) AS ensemble_agrees_on_sign FROM {_PL} GROUP BY 1""")
def ensemble_sign_agreement(spark, d) -> DataFrame:
    """A10: members side by side, with agreement on the sign."""
    return ensemble.ensemble(_pluvial(spark, d), ["nuts_id"], "v")


@query(f"SELECT nuts_id, CASE WHEN count(*) = count(v) THEN min(sign(v)) = max(sign(v)) AND min(sign(v)) <> 0 END AS models_agree FROM {_PL} GROUP BY 1")
def models_agree(spark, d) -> DataFrame:
    """Three-valued agreement."""
    return ensemble.models_agree(_pluvial(spark, d), ["nuts_id"], "v")


@query(f"SELECT nuts_id, release_no, coalesce(greatest(v, x) - least(v, x) > 10, false) AS size_uncertain FROM (SELECT nuts_id, release_no, max(v) AS v, max(x) AS x FROM {_PL} GROUP BY ALL)")
def size_uncertain_flag(spark, d) -> DataFrame:
    """P20."""
    p = _pluvial(spark, d).groupBy("nuts_id", "release_no").agg(F.max("v").alias("v"), F.max("x").alias("x"))
    return p.select("nuts_id", "release_no", ensemble.size_uncertain(F.least("v", "x"), F.greatest("v", "x"), 10.0).alias("size_uncertain"))


@query(f"""WITH w AS (SELECT nuts_id, release_no % 2 AS h, count(v) AS members, median(v) AS m, min(v) AS lo, max(v) AS hi, count(v) >= 2 AND (count(*) FILTER (WHERE v > 0) = count(v) OR count(*) FILTER (WHERE v < 0) = count(v)) AS agrees FROM {_PL} GROUP BY ALL)
SELECT CASE WHEN h = 0 THEN 'even' ELSE 'odd' END AS period, max(members) AS members, count(m) AS n_measured, median(m) AS median_change, count(*) FILTER (WHERE agrees) AS n_agreeing, count(*) FILTER (WHERE hi - lo > 100) AS n_size_uncertain FROM w GROUP BY 1""")
def period_summary_unpivot(spark, d) -> DataFrame:
    """Wide columns by period, unpivoted and summed up."""
    p = _pluvial(spark, d)
    wide = None
    for name, half in (("even", 0), ("odd", 1)):
        e = ensemble.ensemble(p.where(F.col("release_no") % 2 == half), ["nuts_id"], "v").select("nuts_id", *(F.col(c).alias(f"{c}_{name}") for c in ("ensemble_members", "ensemble_median", "ensemble_min", "ensemble_max", "ensemble_agrees_on_sign")))
        wide = e if wide is None else wide.join(e, "nuts_id", "full_outer")
    return ensemble.period_summary(wide, ["even", "odd"], {"members": "ensemble_members", "median": "ensemble_median", "low": "ensemble_min", "high": "ensemble_max", "agrees": "ensemble_agrees_on_sign"})


@query("SELECT o_orderpriority, count(DISTINCT CASE WHEN year(o_orderdate) = 1996 THEN o_custkey END) AS \"1996\", count(DISTINCT CASE WHEN year(o_orderdate) = 1997 THEN o_custkey END) AS \"1997\", count(DISTINCT CASE WHEN year(o_orderdate) = 1996 THEN o_custkey END) + count(DISTINCT CASE WHEN year(o_orderdate) = 1997 THEN o_custkey END) AS total FROM orders GROUP BY 1")
def pivot_group_year(spark, d) -> DataFrame:
    """Distinct items by group and year."""
    return shaping.pivot_counts(table(spark, d, "orders").withColumn("y", F.year("o_orderdate")), "o_orderpriority", "y", [1996, 1997], "o_custkey")


@query("""WITH p AS (SELECT p_brand, s_nationkey, sum(l_quantity) AS q FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)
SELECT p_brand, list_sort(list(n_name)) AS nations, count(*) AS n_nations FROM p JOIN nation ON s_nationkey = n_nationkey WHERE q >= 500 GROUP BY 1""")
def group_country_sets(spark, d) -> DataFrame:
    """Members over a floor, gathered as a sorted set of names."""
    q = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).groupBy("p_brand", "s_nationkey").agg(F.sum("l_quantity").alias("q")).where("q >= 500")
    named = q.join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return named.groupBy("p_brand").agg(F.array_sort(F.collect_list("n_name")).alias("nations"), F.count(F.lit(1)).alias("n_nations"))


@query(f"""WITH p AS (SELECT load_no, country, return_period, sum({_N('exposed_pop')}) AS v FROM exposure GROUP BY ALL)
SELECT load_no, country, count(*) AS n_scenarios, CASE WHEN count(*) = 1 THEN max(v) ELSE max(CASE WHEN return_period = 100 THEN v END) END AS exposed_pop_selected FROM p GROUP BY ALL""")
def bi_exposed_population(spark, d) -> DataFrame:
    """M1: one scenario, never a sum of several."""
    return star.selected_scenario(table(spark, d, "exposure"), "return_period", ["load_no", "country"], "exposed_pop", 100)


_R = "(SELECT load_no, nuts_id, min(country) AS country, max(return_period) AS rp, max(total_pop) AS pop, max(CASE WHEN return_period = 100 THEN CASE WHEN isnan(exposed_pop) THEN NULL ELSE exposed_pop END END) AS exposed, max(CASE WHEN isnan(share_over_65) THEN NULL ELSE share_over_65 END) AS o65, max(CASE WHEN isnan(poverty_rate_pct) THEN NULL ELSE poverty_rate_pct END) AS poverty FROM exposure GROUP BY ALL)"


def _regions(spark, d) -> DataFrame:
    """The dimension: one row per load and region, so that people aren't counted once per scenario."""
    e = nan_to_null(table(spark, d, "exposure"))
    return e.groupBy("load_no", "nuts_id").agg(F.min("country").alias("country"), F.max("total_pop").alias("pop"), F.max(F.when(F.col("return_period") == 100, F.col("exposed_pop"))).alias("exposed"), F.max("share_over_65").alias("o65"), F.max("poverty_rate_pct").alias("poverty"))


@query(f"SELECT load_no, country, sum(pop) AS population, sum(exposed) / nullif(sum(pop), 0) AS share_exposed, count(exposed) AS regions_measured FROM {_R} GROUP BY ALL")
def bi_share_exposed(spark, d) -> DataFrame:
    """People are summed over the dimension and not over the fact."""
    return _regions(spark, d).groupBy("load_no", "country").agg(F.sum("pop").alias("population"), star.share(F.sum("exposed"), F.sum("pop")).alias("share_exposed"), F.count("exposed").alias("regions_measured"))


@query(f"SELECT load_no, country, sum(pop * o65) / nullif(sum(CASE WHEN o65 IS NOT NULL THEN pop END), 0) AS weighted_over_65, sum(pop * poverty) / nullif(sum(CASE WHEN poverty IS NOT NULL THEN pop END), 0) AS weighted_poverty FROM {_R} GROUP BY ALL")
def bi_weighted_rates(spark, d) -> DataFrame:
    """M13, M14."""
    return _regions(spark, d).groupBy("load_no", "country").agg(star.weighted_rate("o65", "pop").alias("weighted_over_65"), star.weighted_rate("poverty", "pop").alias("weighted_poverty"))


@query(f"SELECT load_no, country, sum(pop) AS population, sum(exposed) AS exposed, (CASE WHEN grouping(load_no) = 0 THEN 1 ELSE 0 END) + (CASE WHEN grouping(country) = 0 THEN 1 ELSE 0 END) AS level FROM {_R} GROUP BY ROLLUP (load_no, country)")
def bi_rollup_drill(spark, d) -> DataFrame:
    """Every level of the hierarchy and the total."""
    return star.drill(_regions(spark, d), ["load_no", "country"], [F.sum("pop").alias("population"), F.sum("exposed").alias("exposed")])


@query(f"""SELECT load_no, country, median(poverty) AS median_poverty, quantile_cont(poverty, 0.25) AS lower_quartile, quantile_cont(poverty, 0.75) AS upper_quartile, CASE WHEN count(DISTINCT nuts_id) = 1 THEN min(nuts_id) END AS only_region,
CASE count(DISTINCT nuts_id) WHEN 0 THEN 'none' WHEN 1 THEN min(nuts_id) ELSE 'several' END AS region_shown, printf('%d of %d', count(*) FILTER (WHERE poverty > 15), count(poverty)) AS agreeing FROM {_R} GROUP BY ALL""")
def bi_medians(spark, d) -> DataFrame:
    """M8, M15-M21."""
    r, by = stage(_regions(spark, d), "regions"), ["load_no", "country"]
    shown = r.groupBy(*by).agg(star.only_value("nuts_id").alias("only_region"), star.label_of("nuts_id").alias("region_shown"), star.n_of_m(F.col("poverty") > 15, F.col("poverty").isNotNull()).alias("agreeing"))
    q = join_same(shown, quantiles(r, by, {"q": F.col("poverty")}, [0.25, 0.5, 0.75]), by, "left")
    at = lambda i: F.get("q", F.lit(i))
    return q.select(*by, at(1).alias("median_poverty"), at(0).alias("lower_quartile"), at(2).alias("upper_quartile"), "only_region", "region_shown", "agreeing")


@query("""WITH b AS (SELECT o_orderpriority, list_sort(list_distinct([quantile_disc(o_totalprice, 1/6.0), quantile_disc(o_totalprice, 2/6.0), quantile_disc(o_totalprice, 3/6.0), quantile_disc(o_totalprice, 4/6.0), quantile_disc(o_totalprice, 5/6.0), max(o_totalprice)])) AS breaks FROM orders GROUP BY 1)
SELECT o_orderpriority, least(len(list_filter(breaks, lambda x: x < o_totalprice)), len(breaks) - 1) AS class, count(*) AS n, max(o_totalprice) AS highest FROM orders JOIN b USING (o_orderpriority) GROUP BY ALL""")
def quantile_classes(spark, d) -> DataFrame:
    """Nearest-rank classes."""
    return shaping.quantile_classes(table(spark, d, "orders"), "o_totalprice", 6, ["o_orderpriority"]).groupBy("o_orderpriority", "class").agg(F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("highest"))


@query("SELECT p_brand, p_partkey, rn AS model_rank FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rn, count(*) OVER (PARTITION BY p_brand) AS n FROM part) WHERE rn > floor(n * 0.5)")
def blind_spots_bottom_share(spark, d) -> DataFrame:
    """The lower half of each ranking."""
    return shaping.bottom_share(table(spark, d, "part"), ["p_brand"], "p_retailprice", "p_partkey", 0.5).select("p_brand", "p_partkey", "model_rank")


@query("SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn = 1")
def first_per_key(spark, d) -> DataFrame:
    """W3."""
    return shaping.first_per_key(table(spark, d, "orders"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderdate")


_TOON = """'  ' || c_custkey::VARCHAR || ',' || CASE WHEN c_name ~ '[,:"\\n\\\\\\[\\]{}]' THEN '"' || c_name || '"' ELSE c_name END || ',' || CASE WHEN c_acctbal = floor(c_acctbal) THEN c_acctbal::BIGINT::VARCHAR ELSE regexp_replace(printf('%.4f', c_acctbal), '0+$', '') END || ',' || c_mktsegment"""


@query(f"SELECT c_custkey, {_TOON} AS line FROM customer")
def toon_rows(spark, d) -> DataFrame:
    """Rows as compact text."""
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    return c.select("c_custkey", shaping.toon_lines(c).alias("line"))


@query(f"""WITH l AS (SELECT c_custkey, {_TOON} AS line FROM customer), s AS (SELECT line, row_number() OVER (ORDER BY c_custkey) - 1 AS ordinal, sum(length(line) + 1) OVER (ORDER BY c_custkey) AS body FROM l)
SELECT ordinal, line, body + length('customer[' || (ordinal + 1)::VARCHAR || ']{{c_custkey,c_name,c_acctbal,c_mktsegment}}:') AS chars FROM s WHERE body + length('customer[' || (ordinal + 1)::VARCHAR || ']{{c_custkey,c_name,c_acctbal,c_mktsegment}}:') <= 11000""")
def budgeted_prefix(spark, d) -> DataFrame:
    """The longest head within a budget of characters."""
    return shaping.toon_budget(table(spark, d, "customer"), "c_custkey", ["c_custkey", "c_name", "c_acctbal", "c_mktsegment"], "customer", 11_000)


@query("""WITH g AS (SELECT * FROM (SELECT unnest(['AUTOMOBILE', 'BUILDING', 'SPACE']) AS c_mktsegment) CROSS JOIN (SELECT unnest([0, 1, 99]) AS c_nationkey)) SELECT g.* FROM g WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_mktsegment = g.c_mktsegment AND c.c_nationkey = g.c_nationkey)""")
def cartesian_coverage_check(spark, d) -> DataFrame:
    """Combinations of a request that aren't there."""
    return checks.missing_combinations(spark, {"c_mktsegment": ["AUTOMOBILE", "BUILDING", "SPACE"], "c_nationkey": [0, 1, 99]}, table(spark, d, "customer"))


_ID = lambda c: rf"regexp_replace(lower({c}), '^[\s\v\x{{85}}\p{{Z}}]+|[\s\v\x{{85}}\p{{Z}}]+$', '', 'g')"


@query("SELECT path, list_sort(list(DISTINCT source_id)) AS owners FROM fetch_results WHERE path IS NOT NULL GROUP BY 1 HAVING count(DISTINCT source_id) > 1")
def path_collisions(spark, d) -> DataFrame:
    """Paths that several sources, as they are spelled, write to."""
    f = table(spark, d, "fetch_results").where("path IS NOT NULL").select("path", F.col("source_id").alias("owner"))
    return checks.collisions(f, "path", "owner")


@query(f"""WITH a AS (SELECT DISTINCT {_ID('source')} AS source FROM mix_targets), b AS (SELECT DISTINCT {_ID('source')} AS source FROM documents WHERE source IS NOT NULL)
SELECT coalesce(a.source, b.source) AS source, CASE WHEN b.source IS NULL THEN 'missing' WHEN a.source IS NULL THEN 'undeclared' ELSE 'ok' END AS state FROM a FULL OUTER JOIN b ON a.source = b.source""")
def declared_against_present(spark, d) -> DataFrame:
    """Declared sources and those that are there."""
    one = lambda n: table(spark, d, n).where("source IS NOT NULL").select(identifier("source").alias("source"))
    return checks.declared_against_present(one("mix_targets"), one("documents"), "source")


@query("SELECT snapshot_no, CASE WHEN coalesce(error, '') LIKE '%Access Denied%' THEN 'refused by the server' WHEN bytes < 2000 THEN 'only ' || bytes || ' bytes' END AS reason, count(*) AS n FROM fetch_results GROUP BY ALL")
def unusable_documents(spark, d) -> DataFrame:
    """Downloads that are no documents."""
    f = table(spark, d, "fetch_results").select("snapshot_no", checks.why_not_a_document(F.coalesce("error", F.lit("")), F.col("bytes")).alias("reason"))
    return f.groupBy("snapshot_no", "reason").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT nuts_id, country_name, area_km2, CASE WHEN area_km2 IS NULL THEN NULL ELSE area_km2 * 100 END AS hectares, coalesce(map_extract_value(MAP {'XD': 'first'}, country), country) AS label FROM nuts_regions")
def labelled_regions(spark, d) -> DataFrame:
    """Codes with names, or themselves."""
    r = table(spark, d, "nuts_regions")
    return r.select("nuts_id", "country_name", "area_km2", (F.col("area_km2") * 100).alias("hectares"), hierarchy.label(F.col("country"), {"XD": "first"}).alias("label"))


@query(f"""WITH e AS (SELECT load_no, country, return_period, {_N('exposed_pop')} AS x, coalesce(cells_counted % 4 * 50 >= return_period, false) AS held FROM exposure)
SELECT load_no, country, return_period, sum(x) AS exposed_pop_all, sum(CASE WHEN held AND x IS NOT NULL THEN 0 ELSE x END) AS exposed_pop_residual, count(*) FILTER (WHERE held) AS n_held FROM e GROUP BY ALL""")
def residual_exposure(spark, d) -> DataFrame:
    """What is left behind defences; the standard is made up from a column of the table."""
    e = table(spark, d, "exposure").withColumn("standard", F.col("cells_counted") % 4 * 50)
    return exposure.residual(e, ["load_no", "country"], "return_period", "exposed_pop", "standard")


@query("SELECT return_period, CASE WHEN return_period < 100 THEN 'frequent' WHEN return_period = 100 THEN 'named' WHEN return_period > 100 THEN 'rare' END AS class, count(*) AS n_rows FROM exposure GROUP BY ALL")
def scenario_classes(spark, d) -> DataFrame:
    """P21."""
    return table(spark, d, "exposure").select("return_period", exposure.scenario_class("return_period").alias("class")).groupBy("return_period", "class").agg(F.count(F.lit(1)).alias("n_rows"))


@query(f"SELECT count(*) AS n_checks, CASE WHEN count(*) FILTER (WHERE state = 'missing') > 0 THEN 'not ready' WHEN count(*) FILTER (WHERE state = 'undeclared') > 0 THEN 'ready with gaps' ELSE 'ready' END AS verdict FROM ({SQL['declared_against_present']})")
def readiness(spark, d) -> DataFrame:
    """The verdict over all checks."""
    return checks.verdict(declared_against_present(spark, d), [], "state")


@query("SELECT user_id, greatest(count(*) FILTER (WHERE event_type = 'view'), count(*) FILTER (WHERE event_type = 'click')) AS articles, greatest(count(*) FILTER (WHERE event_type = 'view'), count(*) FILTER (WHERE event_type = 'click')) >= 20 AS censored FROM events GROUP BY 1")
def news_signal(spark, d) -> DataFrame:
    """The larger of overlapping counts, and whether a cap was met."""
    counts = table(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "view").alias("a"), F.count_if(F.col("event_type") == "click").alias("b"))
    most, capped = checks.news_signal([F.col("a"), F.col("b")], 20)
    return counts.select("user_id", most.alias("articles"), capped.alias("censored"))
