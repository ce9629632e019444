"""Queries and SQL of the general data-quality operators: snapshots, profiles, filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.values import identifier
from tidemark.operators.fill import fill_missing, filled_long
from tidemark.operators.profile import Rule, column_stats, drift, exact_quantiles, findings, profile, profile_of_counts, value_counts
from tidemark.operators.snapshots import snapshot_changes
from tidemark.plans.staging import stage, stage_counted
from tidemark.sources.tables import table

#: The texts of a NUTS level that count as given, the bounds of the five filled fields, forms of codes.
LEVELS = ("NUTS3", "NUTS2, applied to its NUTS3 children")
INCOME, DENSITY, CHANGE = (2_000, 90_000), (0.5, 40_000), (-80, 150)
NUTS_CODE, YEAR = "[A-Z]{2}[A-Z0-9]{3}", "[0-9]{4}"

EXPOSURE_RULES = {
    "exposed_pop": Rule(low=0, high="total_pop"),
    "hazard_coverage": Rule(low=0, high=1),
    "nuts_id": Rule(pattern=NUTS_CODE),
    "share_over_65_year": Rule(pattern=YEAR),
    "poverty_rate_pct_year": Rule(pattern=YEAR),
}
ANSWER_RULES = {"null_excluded": Rule(low=0, high=1_000)}
#: Every column but the load key.
EXPOSURE_COLUMNS = ["loaded_at", "nuts_id", "region", "country", "country_name", "total_pop", "cells_counted", "hazard_coverage", "exposed_pop", "return_period", "annual_probability", "share_over_65", "share_over_65_year", "poverty_rate_pct", "poverty_rate_pct_year", "poverty_rate_pct_level"]
ANSWER_COLUMNS = ["answer_id", "asked_at", "spec", "key_name", "return_period", "defaulted_return_period", "matched", "null_excluded", "provider", "fallback_reason"]


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return snapshot_changes(table(spark, d, "fetch_results"), "snapshot_no", identifier("source_id"), [F.col("bytes"), F.lower("sha256")], "fetched_at", "source_id")


def p2_change_counts(spark: SparkSession, d: str) -> DataFrame:
    return p2_found(spark, d).groupBy("snapshot_no", "change_kind").agg(F.count(F.lit(1)).alias("n_sources"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    parts = []
    for name, columns, rules in (("exposure", list(EXPOSURE_RULES), EXPOSURE_RULES), ("answers", list(ANSWER_RULES), ANSWER_RULES)):
        found = findings(profile(table(spark, d, name), "load_no", columns, rules), "load_no")
        compared = [c for c, r in rules.items() if r.pattern is None]
        found = found.filter(F.col("column_name").isin(compared) | (F.col("finding") == "pattern"))
        parts.append(found.select(F.lit(name).alias("table_name"), "load_no", "column_name", "finding"))
    return parts[0].unionByName(parts[1])


def p3_profile(spark: SparkSession, d: str) -> DataFrame:
    parts = []
    for name, columns, rules in (("exposure", EXPOSURE_COLUMNS, EXPOSURE_RULES), ("answers", ANSWER_COLUMNS, ANSWER_RULES)):
        counts, most = stage_counted(value_counts(table(spark, d, name), "load_no", columns, rules), "value_counts")
        profiled = stage(profile_of_counts(counts, "load_no", rules, classes=True, most=most), "profile")
        moved = drift(counts, "load_no", profiled)
        joined = profiled.join(moved, ["load_no", "column_name"], "left")
        q = lambda i: F.try_element_at("quantiles", F.lit(i))
        parts.append(joined.select(F.lit(name).alias("table_name"), "load_no", "column_name", "n_rows", "n_null", "n_nan", "n_distinct", "min_num", "max_num", "min_whole", "max_whole", "min_txt", "max_txt", "n_outside", "n_pattern", q(1).alias("q25"), q(2).alias("q50"), q(3).alias("q75"), "n_classes", "psi", "chi_square"))
    return parts[0].unionByName(parts[1])


def number_within(column: str, bounds: tuple[float, float]) -> Column:
    return F.when(F.col(column).between(*bounds) & ~F.isnan(column), F.col(column))


def known_level(column: str) -> Column:
    """The level text in its own spelling, NULL for everything else."""
    bare = lambda c: F.lower(F.regexp_replace(c, r"(?U)\s+", ""))
    out = F.lit(None).cast("string")
    for text in LEVELS:
        out = F.when(bare(F.col(column)) == "".join(text.lower().split()), text).otherwise(out)
    return out


_FIELDS = {
    "demographics": ({"household_income_pps_per_hab": INCOME, "pop_density_per_km2": DENSITY}, ["household_income_level"]),
    "pluvial": ({"pluvial_rx5day_change_pct_gwl2_0_p50": CHANGE}, ["pluvial_level"]),
}


def filled(spark: SparkSession, d: str, name: str) -> DataFrame:
    numbers, levels = _FIELDS[name]
    return fill_missing(table(spark, d, name), "record_id", "nuts_id", "release_no", F.substring("nuts_id", 1, 4), {c: number_within(c, b) for c, b in numbers.items()}, {c: known_level(c) for c in levels})


def p5_filled(spark: SparkSession, d: str) -> DataFrame:
    parts = [filled_long(filled(spark, d, name), "record_id", list(numbers), levels, name) for name, (numbers, levels) in _FIELDS.items()]
    return parts[0].unionByName(parts[1])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_filled(spark, d).filter((F.col("method") != "observed") & (F.col("donors") > 0)).select("table_name", "record_id", "field_name")


QUERIES = {f.__name__: f for f in (p2_found, p2_change_counts, p3_found, p3_profile, p5_found, p5_filled)}

_WS = r"[\s\v\x{85}\p{Z}]"
_P2 = rf"""
WITH latest AS (
  SELECT snapshot_no, regexp_replace(lower(source_id), '^{_WS}+|{_WS}+$', '', 'g') AS source_id, bytes, lower(sha256) AS sha256,
    row_number() OVER (PARTITION BY snapshot_no, regexp_replace(lower(source_id), '^{_WS}+|{_WS}+$', '', 'g') ORDER BY fetched_at DESC) AS rn
  FROM fetch_results),
one AS (SELECT * FROM latest WHERE rn = 1),
steps AS (SELECT snapshot_no, lag(snapshot_no) OVER (ORDER BY snapshot_no) AS past FROM (SELECT DISTINCT snapshot_no FROM fetch_results)),
now AS (SELECT o.*, past FROM one o JOIN steps s ON o.snapshot_no = s.snapshot_no WHERE past IS NOT NULL),
old AS (SELECT s.snapshot_no, o.source_id, o.bytes, o.sha256 FROM one o JOIN steps s ON o.snapshot_no = s.past),
found AS (
  SELECT coalesce(n.snapshot_no, o.snapshot_no) AS snapshot_no, coalesce(n.source_id, o.source_id) AS source_id,
    CASE WHEN o.snapshot_no IS NULL THEN 'added' WHEN n.snapshot_no IS NULL THEN 'removed'
         WHEN n.bytes IS DISTINCT FROM o.bytes OR n.sha256 IS DISTINCT FROM o.sha256 THEN 'changed' END AS change_kind
  FROM now n FULL OUTER JOIN old o ON n.snapshot_no = o.snapshot_no AND n.source_id = o.source_id)
"""
_P3 = """
WITH e AS (SELECT DISTINCT * FROM exposure), a AS (SELECT DISTINCT * FROM answers),
v AS (
  SELECT 'exposure' AS table_name, load_no, 'exposed_pop' AS column_name, exposed_pop AS v, total_pop AS top FROM e
  UNION ALL SELECT 'exposure', load_no, 'hazard_coverage', hazard_coverage, 1 FROM e
  UNION ALL SELECT 'answers', load_no, 'null_excluded', null_excluded, 1000 FROM a),
m AS (SELECT table_name, load_no, column_name, CASE WHEN isnan(v) THEN NULL ELSE v END AS v, top FROM v),
s AS (SELECT table_name, load_no, column_name, count(*) AS n, count(v) AS k, count(DISTINCT v) AS d, count(*) FILTER (WHERE v < 0 OR v > top) AS bad,
        quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS q2, quantile_cont(v, 0.75) AS q3 FROM m GROUP BY ALL),
p AS (SELECT *, lag(n) OVER w AS pn, lag(k) OVER w AS pk, lag(d) OVER w AS pd, lag(q1) OVER w AS p1, lag(q2) OVER w AS p2, lag(q3) OVER w AS p3
      FROM s WINDOW w AS (PARTITION BY table_name, column_name ORDER BY load_no)),
t AS (SELECT load_no, 'nuts_id' AS column_name, nuts_id AS x, '[A-Z]{2}[A-Z0-9]{3}' AS form FROM e
  UNION ALL SELECT load_no, 'share_over_65_year', share_over_65_year, '[0-9]{4}' FROM e
  UNION ALL SELECT load_no, 'poverty_rate_pct_year', poverty_rate_pct_year, '[0-9]{4}' FROM e)
SELECT table_name, load_no, column_name, 'range' AS finding FROM p WHERE bad > 0
UNION ALL SELECT table_name, load_no, column_name, 'nulls' FROM p WHERE abs((n - k) * pn - (pn - pk) * n) * 10 > n * pn
UNION ALL SELECT table_name, load_no, column_name, 'distinct' FROM p WHERE d > 2 * pd OR 2 * d < pd
UNION ALL SELECT table_name, load_no, column_name, 'shift' FROM p
  WHERE abs(q1) > 1.5 * abs(p1) OR 1.5 * abs(q1) < abs(p1) OR abs(q2) > 1.5 * abs(p2) OR 1.5 * abs(q2) < abs(p2) OR abs(q3) > 1.5 * abs(p3) OR 1.5 * abs(q3) < abs(p3)
UNION ALL SELECT DISTINCT 'exposure', load_no, column_name, 'pattern' FROM t WHERE NOT regexp_matches(x, '^(' || form || ')$')
"""


def _p5_sql() -> str:
    bare = lambda c: f"regexp_replace(lower({c}), '{_WS}+', '', 'g')"
    level = lambda c: f"{bare(c)} IN ({', '.join(repr(''.join(t.lower().split())) for t in LEVELS)})"
    parts = []
    for name, (numbers, levels) in _FIELDS.items():
        for field, has in [*((c, f"coalesce({c} BETWEEN {b[0]} AND {b[1]} AND NOT isnan({c}), false)") for c, b in numbers.items()), *((c, f"coalesce({level(c)}, false)") for c in levels)]:
            parts.append(f"SELECT table_name, record_id, field_name FROM (SELECT '{name}' AS table_name, record_id, '{field}' AS field_name, {has} AS has, max(CASE WHEN {has} THEN 1 ELSE 0 END) OVER (PARTITION BY release_no, substr(nuts_id, 1, 4)) AS donor FROM (SELECT DISTINCT * FROM {name})) WHERE NOT has AND donor = 1")
    return "\nUNION ALL ".join(parts)


def _long_sql(name: str, columns: dict[str, str], rules: dict[str, Rule]) -> str:
    """One row per distinct row and column: the value in the slot of its kind, and whether it is outside or breaks the pattern."""
    parts = []
    for c, kind in columns.items():
        slot = {"num": "NULL::DOUBLE", "whole": "NULL::BIGINT", "txt": "NULL::VARCHAR"} | {kind.split(":")[0]: {"whole:time": f"epoch_us({c})", "whole": f"{c}::BIGINT"}.get(kind, c)}
        rule = rules.get(c, Rule())
        top = rule.high if isinstance(rule.high, str) else repr(rule.high)
        outside = f"({c} < {rule.low} OR {c} > {top}) AND NOT isnan({c}::DOUBLE)" if rule.low is not None else "false"
        broken = f"NOT regexp_matches({c}, '^({rule.pattern})$')" if rule.pattern else "false"
        parts.append(f"SELECT load_no, '{c}' AS c, {slot['num']} AS num, {slot['whole']} AS whole, {slot['txt']} AS txt, coalesce({outside}, false) AS outside, coalesce({broken}, false) AS broken FROM (SELECT DISTINCT * FROM {name})")
    return " UNION ALL ".join(parts)


def _profile_sql(name: str, columns: dict[str, str], rules: dict[str, Rule]) -> str:
    deciles = ", ".join(f"{i / 10}" for i in range(1, 10))
    return f"""
WITH l AS ({_long_sql(name, columns, rules)}), m AS (SELECT *, coalesce(isnan(num), false) AS nan, CASE WHEN isnan(num) THEN NULL ELSE num END AS x, coalesce(CASE WHEN isnan(num) THEN NULL ELSE num END, whole::DOUBLE) AS v FROM l),
s AS (SELECT load_no, c, count(*) AS n_rows, count(*) FILTER (WHERE num IS NULL AND whole IS NULL AND txt IS NULL) AS n_null, count(*) FILTER (WHERE nan) AS n_nan, count(DISTINCT x) + count(DISTINCT whole) + count(DISTINCT txt) AS n_distinct,
  min(x) AS min_num, max(x) AS max_num, min(whole) AS min_whole, max(whole) AS max_whole, min(txt) AS min_txt, max(txt) AS max_txt, count(*) FILTER (WHERE outside) AS n_outside, count(*) FILTER (WHERE broken) AS n_pattern,
  quantile_cont(v, 0.25) AS q25, quantile_cont(v, 0.5) AS q50, quantile_cont(v, 0.75) AS q75, list_distinct(quantile_cont(v, [{deciles}])) AS edges FROM m GROUP BY ALL),
p AS (SELECT *, lead(load_no) OVER (PARTITION BY c ORDER BY load_no) AS step FROM s),
t AS (SELECT m.load_no AS step, m.c, true AS now, m.* EXCLUDE (load_no, c) FROM m UNION ALL SELECT p.step, m.c, false, m.* EXCLUDE (load_no, c) FROM m JOIN p ON m.load_no = p.load_no AND m.c = p.c WHERE p.step IS NOT NULL),
k AS (SELECT t.step, t.c, now, CASE WHEN t.num IS NULL AND t.whole IS NULL AND t.txt IS NULL OR nan THEN 'missing' WHEN t.txt IS NOT NULL THEN '=' || t.txt WHEN t.whole IS NOT NULL AND p.min_whole IS NOT NULL AND p.n_distinct <= 20 THEN '=' || t.whole
  WHEN p.q50 IS NOT NULL THEN 'above ' || len(list_filter(p.edges, lambda e: e < t.v)) ELSE 'new' END AS label FROM t JOIN p ON t.step = p.step AND t.c = p.c),
g AS (SELECT step, c, label, count(*) FILTER (WHERE now) AS a, count(*) FILTER (WHERE NOT now) AS b FROM k GROUP BY ALL),
w AS (SELECT *, sum(a) OVER (PARTITION BY step, c) AS ta, sum(b) OVER (PARTITION BY step, c) AS tb FROM g),
f AS (SELECT step, c, count(*) AS n_classes, sum((greatest(a, 0.5) / ta - greatest(b, 0.5) / tb) * ln((greatest(a, 0.5) / ta) / (greatest(b, 0.5) / tb))) AS psi, sum((a - greatest(b, 0.5) * ta / tb) ** 2 / (greatest(b, 0.5) * ta / tb)) AS chi_square FROM w GROUP BY ALL)
SELECT '{name}' AS table_name, load_no, s.c AS column_name, n_rows, n_null, n_nan, n_distinct, min_num, max_num, min_whole, max_whole, min_txt, max_txt, n_outside, n_pattern, q25, q50, q75, n_classes, psi, chi_square FROM s LEFT JOIN f ON s.load_no = f.step AND s.c = f.c"""


#: The slot that each column of the two tables goes to.
_EXPOSURE_SLOTS = dict.fromkeys(EXPOSURE_COLUMNS, "txt") | dict.fromkeys(("total_pop", "hazard_coverage", "exposed_pop", "annual_probability", "share_over_65", "poverty_rate_pct"), "num") | {"cells_counted": "whole", "return_period": "whole", "loaded_at": "whole:time"}
_ANSWER_SLOTS = dict.fromkeys(ANSWER_COLUMNS, "txt") | dict.fromkeys(("answer_id", "return_period", "defaulted_return_period", "matched", "null_excluded"), "whole") | {"asked_at": "whole:time"}


def _filled_sql() -> str:
    bare = lambda c: f"regexp_replace(lower({c}), '{_WS}+', '', 'g')"
    parts = []
    for name, (numbers, levels) in _FIELDS.items():
        level = lambda c: "CASE " + " ".join(f"WHEN {bare(c)} = '{''.join(t.lower().split())}' THEN '{t}'" for t in LEVELS) + " END"
        base = f"SELECT record_id, nuts_id AS e, release_no AS t, substr(nuts_id, 1, 4) AS g, {', '.join([f'CASE WHEN {c} BETWEEN {b[0]} AND {b[1]} AND NOT isnan({c}) THEN {c} END AS {c}' for c, b in numbers.items()] + [f'{level(c)} AS {c}' for c in levels])} FROM (SELECT DISTINCT * FROM {name})"
        for c in [*numbers, *levels]:
            number = c in numbers
            mode = lambda keys: f"SELECT {keys}, avg(v) AS v FROM r GROUP BY ALL" if number else f"SELECT {keys}, arg_min(v, (-n, v)) AS v FROM (SELECT {keys}, v, count(v) AS n FROM r GROUP BY ALL) GROUP BY ALL"  # noqa: B023, E731
            value = "coalesce(v, CASE WHEN pv IS NOT NULL AND nv IS NOT NULL THEN pv + (nv - pv) * (t - pt) / (nt - pt)::DOUBLE END, gv, near)" if number else "coalesce(v, near, gv)"
            method = ("CASE WHEN v IS NOT NULL THEN 'observed' WHEN pv IS NOT NULL AND nv IS NOT NULL THEN 'interpolated' WHEN gv IS NOT NULL THEN 'group' WHEN near IS NOT NULL THEN 'carried' ELSE 'none' END" if number else "CASE WHEN v IS NOT NULL THEN 'observed' WHEN near IS NOT NULL THEN 'carried' WHEN gv IS NOT NULL THEN 'group' ELSE 'none' END")
            parts.append(f"""SELECT * FROM (WITH r AS (SELECT record_id, e, t, g, {c} AS v FROM ({base})), s AS ({mode('e, t')}),
w AS (SELECT e, t, last_value(v IGNORE NULLS) OVER b AS pv, last_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER b AS pt, first_value(v IGNORE NULLS) OVER a AS nv, first_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER a AS nt
  FROM s WINDOW b AS (PARTITION BY e ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS (PARTITION BY e ORDER BY t ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
d AS ({mode('g, t').replace(' AS v ', ' AS gv ')}), n AS (SELECT g, t, count(v) AS donors FROM r GROUP BY ALL),
j AS (SELECT r.*, pv, pt, nv, nt, gv, donors, CASE WHEN pv IS NOT NULL AND t - pt <= 4 AND (nv IS NULL OR t - pt <= nt - t) THEN pv WHEN nv IS NOT NULL AND nt - t <= 4 THEN nv END AS near,
  CASE WHEN pv IS NOT NULL AND t - pt <= 4 AND (nv IS NULL OR t - pt <= nt - t) THEN t - pt WHEN nv IS NOT NULL AND nt - t <= 4 THEN nt - t END AS dist FROM r JOIN w USING (e, t) JOIN d USING (g, t) JOIN n USING (g, t))
SELECT '{name}' AS table_name, record_id, '{c}' AS field_name, {value if number else 'NULL::DOUBLE'} AS number, {'NULL::VARCHAR' if number else value} AS text, {method} AS method, CASE {method} WHEN 'observed' THEN 0 WHEN 'group' THEN 0 WHEN 'interpolated' THEN least(t - pt, nt - t) WHEN 'carried' THEN dist END AS distance, donors FROM j)""")
    return "\nUNION ALL ".join(parts)


SQL = {
    "p2_found": _P2 + "SELECT * FROM found WHERE change_kind IS NOT NULL",
    "p2_change_counts": _P2 + "SELECT snapshot_no, change_kind, count(*) AS n_sources FROM found WHERE change_kind IS NOT NULL GROUP BY ALL",
    "p3_found": _P3,
    "p3_profile": f"SELECT * FROM ({_profile_sql('exposure', _EXPOSURE_SLOTS, EXPOSURE_RULES)}) UNION ALL SELECT * FROM ({_profile_sql('answers', _ANSWER_SLOTS, ANSWER_RULES)})",
    "p5_found": _p5_sql(),
    "p5_filled": _filled_sql(),
}
