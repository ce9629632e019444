"""Queries and SQL of the text, time-series, grid and stream operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.values import nan_to_null
from tidemark.operators import agreement, evidence, grid, series
from tidemark.plans.staging import new_path
from tidemark.sources import files, jsonstat
from tidemark.sources.tables import table
from tidemark.streaming import streams

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


_STOP = "[" + ", ".join(f"'{w}'" for w in evidence.STOPWORDS) + "]"
_TOK = lambda c: rf"list_filter(regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}]+'), lambda w: length(w) > 2 AND NOT list_contains({_STOP}, w))"


@query(f"WITH t AS (SELECT doc_id, unnest({_TOK('text')}) AS term FROM documents) SELECT term, count(*) AS n, count(DISTINCT doc_id) AS df FROM t GROUP BY 1")
def tokens_and_df(spark, d) -> DataFrame:
    """terms with their counts and document frequencies."""
    return evidence.term_counts(table(spark, d, "documents"), "doc_id", "text").groupBy("term").agg(F.sum("tf").alias("n"), F.count(F.lit(1)).alias("df"))


_WS = r"[\s\v\x{85}\p{Z}]"
_SENTENCES = rf"string_split(regexp_replace(trim(regexp_replace(text, '{_WS}+', ' ', 'g')), '([.!?])\s+', '\1' || chr(31), 'g'), chr(31))"


@query(f"""WITH f AS (SELECT doc_id, list_reduce(list_transform({_SENTENCES}, lambda s: {{'done': []::VARCHAR[], 'open': s}}), lambda a, b: CASE WHEN length(a.open) > 0 AND length(a.open) + length(b.open) > 900 THEN {{'done': list_append(a.done, rtrim(a.open)), 'open': b.open || ' '}}
ELSE {{'done': a.done, 'open': a.open || b.open || ' '}} END, {{'done': []::VARCHAR[], 'open': ''}}) AS r FROM documents WHERE text IS NOT NULL), p AS (SELECT doc_id, list_filter(list_append(r.done, trim(r.open)), lambda x: x <> '') AS parts FROM f)
SELECT doc_id, unnest(range(0, len(parts)))::INT AS ordinal, unnest(parts) AS text FROM p""")
def sentence_chunks(spark, d) -> DataFrame:
    """Whole sentences packed into passages."""
    return evidence.passages(table(spark, d, "documents"), "doc_id", "text")


@query(rf"""WITH q AS (SELECT doc_id AS query_id, {_TOK("coalesce(title, '')")} AS a FROM documents WHERE doc_id % 20 = 0), t AS (SELECT doc_id, {_TOK('text')} AS t FROM documents),
z AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM t), p AS (SELECT doc_id, len(t) AS len, unnest(t) AS term FROM t), c AS (SELECT doc_id, len, term, count(*) AS tf FROM p GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM c GROUP BY 1), w AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest(a) AS term FROM q) GROUP BY ALL),
s AS (SELECT query_id, doc_id, sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / mean))) AS score, count(*) AS k FROM w JOIN c USING (term) JOIN f USING (term) CROSS JOIN z GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s)
SELECT r.query_id, r.doc_id, score, rank, k / len(list_distinct(a))::DOUBLE AS coverage FROM r JOIN q ON q.query_id = r.query_id WHERE rank <= 5""")
def bm25_topk(spark, d) -> DataFrame:
    """The five best documents for the titles of the documents whose id is divisible by 20."""
    docs = table(spark, d, "documents")
    asked = docs.where(F.col("doc_id") % 20 == 0).select(F.col("doc_id").alias("query_id"), F.coalesce("title", F.lit("")).alias("question"))
    return evidence.bm25(docs, "doc_id", "text", asked, "query_id", "question")


@query("SELECT query_id, count(*) AS n FROM (" + SQL["bm25_topk"] + ") GROUP BY 1 HAVING max(CASE WHEN rank = 1 THEN score END) >= 1.5 AND max(CASE WHEN rank = 1 THEN coverage END) >= 0.4")
def bm25_gate(spark, d) -> DataFrame:
    """Queries that the corpus can answer."""
    return evidence.gated(bm25_topk(spark, d), "query_id").groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH x AS (SELECT doc_id, list_distinct({_TOK("regexp_replace(coalesce(title, ''), '\\[S(\\d+)\\]', ' ', 'g')")}) AS a, list_distinct({_TOK('text')}) AS b FROM documents)
SELECT doc_id, CASE WHEN len(a) > 0 THEN len(list_intersect(a, b)) / len(a)::DOUBLE ELSE 0 END AS grounding FROM x""")
def grounding_score(spark, d) -> DataFrame:
    """Share of the words of a title that its text has."""
    return table(spark, d, "documents").select("doc_id", evidence.grounding(F.coalesce("title", F.lit("")), F.array("text")).alias("grounding"))


@query(r"""SELECT DISTINCT passage_id, list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(text, '\[S(\d+)\]', 1), lambda x: x::INT), lambda x: x < 1 OR x > 30))) AS invalid FROM passages""")
def invalid_citations(spark, d) -> DataFrame:
    """markers that point past the list of sources."""
    return table(spark, d, "passages").select("passage_id", evidence.invalid_citations(F.col("text"), F.lit(30)).alias("invalid")).distinct()


@query(r"""SELECT DISTINCT passage_id, list_transform(regexp_extract_all(regexp_replace(text, '\[S\d+\]', ' ', 'g'), '\d+(?:[ .,\x{a0}\x{202f}]\d+)*'), lambda x: regexp_replace(x, '\D', '', 'g')) AS figures FROM passages""")
def digit_sequences(spark, d) -> DataFrame:
    """the figures of a text, as digits."""
    return table(spark, d, "passages").select("passage_id", evidence.figures(F.col("text")).alias("figures")).distinct()


_FIG = lambda c: rf"list_transform(regexp_extract_all(regexp_replace({c}, '\[S\d+\]', ' ', 'g'), '\d+(?:[ .,\x{{a0}}\x{{202f}}]\d+)*'), lambda x: regexp_replace(x, '\D', '', 'g'))"


@query(f"SELECT DISTINCT passage_id, {_FIG('text')} = {_FIG("replace(text, '199', '18')")} AS kept FROM passages WHERE text IS NOT NULL")
def figures_kept(spark, d) -> DataFrame:
    """A copy in which some figures were altered, which the check must tell from the others."""
    return table(spark, d, "passages").where("text IS NOT NULL").select("passage_id", evidence.figures_kept(F.col("text"), F.regexp_replace("text", "199", "18")).alias("kept")).distinct()


@query(f"SELECT doc_id, trim(regexp_replace(text, '{_WS}+', ' ', 'g')) AS text FROM documents")
def html_to_text(spark, d) -> DataFrame:
    """text of pages, without script."""
    page = F.concat(F.lit("<html><script>var x = 1;</script><p>"), F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("</p></html>"))
    return table(spark, d, "documents").select("doc_id", evidence.html_to_text(page).alias("text"))


@query()
def fenced_passages(spark, d) -> DataFrame:
    """F25."""
    return table(spark, d, "passages").select("passage_id", evidence.fenced("text", "source").alias("fenced")).distinct()


_MAX = "SELECT o_custkey, year(o_orderdate) AS year, max(o_totalprice) AS annual_max, avg(o_totalprice) AS annual_mean, count(*) AS n_steps FROM orders GROUP BY ALL"
_PAIRS = f"m AS ({_MAX}), p AS (SELECT a.o_custkey, (b.annual_max - a.annual_max) / (b.year - a.year) AS slope, sign(b.annual_max - a.annual_max) AS sg FROM m a JOIN m b ON a.o_custkey = b.o_custkey AND b.year > a.year), n AS (SELECT o_custkey, count(*)::DOUBLE AS n FROM m GROUP BY 1), s AS (SELECT o_custkey, median(slope) AS slope, sum(sg) AS s FROM p GROUP BY 1)"
_TREND = f"WITH {_PAIRS} SELECT n.o_custkey, n::INT AS n_years, slope AS sen_slope, coalesce(s, 0) AS mk_s, CASE WHEN n > 1 THEN CASE WHEN s > 0 THEN (s - 1) / sqrt(n * (n - 1) * (2 * n + 5) / 18) WHEN s < 0 THEN (s + 1) / sqrt(n * (n - 1) * (2 * n + 5) / 18) ELSE 0 END END AS mk_z FROM n LEFT JOIN s USING (o_custkey)"


@query(_MAX)
def annual_extremes(spark, d) -> DataFrame:
    """A28."""
    return series.yearly_extremes(table(spark, d, "orders"), ["o_custkey"], "o_orderdate", "o_totalprice")


@query(_TREND)
def sen_slope(spark, d) -> DataFrame:
    """Slope and test by customer."""
    return series.trends(annual_extremes(spark, d), ["o_custkey"], "year", "annual_max")


@query(f"""WITH t AS ({_TREND}), m AS (SELECT o_custkey, avg(o_totalprice) AS mean FROM orders GROUP BY 1)
SELECT c_nationkey, median(sen_slope * 1000 / mean) AS pct_per_decade, avg(CASE WHEN mk_z IS NOT NULL THEN CASE WHEN mk_z > 1.96 THEN 1.0 ELSE 0.0 END END) AS share_increasing, count(*) AS n_cells FROM t JOIN m USING (o_custkey) JOIN customer ON o_custkey = c_custkey GROUP BY 1""")
def trend_by_group(spark, d) -> DataFrame:
    """Trends by nation."""
    means = table(spark, d, "orders").groupBy("o_custkey").agg(F.avg("o_totalprice").alias("mean"))
    cells = sen_slope(spark, d).join(means, "o_custkey").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return series.regional_trends(cells, "c_nationkey", "sen_slope", "mk_z", "mean")


@query("SELECT o_custkey, count(*) AS n_years, avg(m) AS mean_value FROM (SELECT o_custkey, year(o_orderdate) AS y, avg(o_totalprice) AS m FROM orders GROUP BY ALL) GROUP BY 1 HAVING count(*) = 5 AND avg(m) >= 1000")
def complete_series(spark, d) -> DataFrame:
    """P17."""
    return series.complete_series(annual_extremes(spark, d), ["o_custkey"], "year", "annual_max", "annual_mean", 5, 1_000)


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 50 WHEN o_totalprice > 100000 THEN 10 WHEN o_totalprice > 50000 THEN 2 ELSE 0 END AS highest, CASE WHEN year(o_orderdate) % 4 = 0 THEN 1464 ELSE 1460 END AS steps FROM orders")
def highest_level(spark, d) -> DataFrame:
    """The highest of rising thresholds that is passed."""
    levels = F.array(*(F.struct(F.lit(n).alias("level"), F.lit(float(t)).alias("threshold")) for n, t in ((2, 50_000), (10, 100_000), (50, 200_000))))
    return table(spark, d, "orders").select("o_orderkey", series.highest_level(F.col("o_totalprice"), levels).alias("highest"), series.expected_steps(F.year("o_orderdate")).alias("steps"))


@query("""WITH c AS (SELECT l_suppkey, count(*) AS n_cells, count(*) FILTER (WHERE m AND o) AS hits, count(*) FILTER (WHERE NOT m AND o) AS misses, count(*) FILTER (WHERE m AND NOT o) AS false_alarms FROM (SELECT l_suppkey, l_quantity / 10 > 2.5 AS m, l_discount * 100 > 5 AS o FROM lineitem) GROUP BY 1)
SELECT l_suppkey, n_cells, hits, misses, false_alarms, CASE WHEN hits + misses >= 25 THEN hits / nullif(hits + misses, 0) END AS hit_rate, CASE WHEN hits + misses >= 25 THEN false_alarms / nullif(hits + false_alarms, 0) END AS false_alarm_ratio, CASE WHEN hits + misses >= 25 THEN hits / nullif(hits + misses + false_alarms, 0) END AS overlap FROM c""")
def confusion_by_unit(spark, d) -> DataFrame:
    """Modelled against observed, by unit."""
    return agreement.confusion(table(spark, d, "lineitem"), ["l_suppkey"], agreement.modelled_wet(F.col("l_quantity") / 10, 2.5), agreement.observed_wet(F.col("l_discount") * 100, 0.05))


@query("""SELECT l_suppkey, sum(CASE WHEN l_tax > 0 THEN l_quantity END) AS area, sum(CASE WHEN l_tax > 0 AND l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS returned_area, sum(CASE WHEN l_tax > 0 AND l_returnflag = 'R' THEN l_quantity ELSE 0 END) / nullif(sum(CASE WHEN l_tax > 0 THEN l_quantity END), 0) AS returned_share, avg(CASE WHEN l_tax > 0 THEN 1.0 ELSE 0.0 END) AS coverage FROM lineitem GROUP BY 1""")
def weighted_area_share(spark, d) -> DataFrame:
    """Weighted share of the valid cells."""
    return agreement.weighted_shares(table(spark, d, "lineitem"), ["l_suppkey"], F.col("l_quantity"), {"returned": F.col("l_returnflag") == "R"}, F.col("l_tax") > 0)


@query("""WITH o AS (SELECT o_orderpriority, o_custkey, max(CASE WHEN year(o_orderdate) = 1996 THEN o_totalprice END) AS a, max(CASE WHEN year(o_orderdate) = 1998 THEN o_totalprice END) AS b, max(o_custkey % 5 + 1) AS w FROM orders GROUP BY ALL), s AS (SELECT o_orderpriority, sum(CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN a * w END) AS sa, sum(CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN b * w END) AS sb, sum(CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN w END) AS sw, avg(CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN 1.0 ELSE 0.0 END) AS coverage FROM o GROUP BY 1)
SELECT o_orderpriority, sa / sw AS share_first, sb / sw AS share_last, (sb / sw - sa / sw) * 100 AS change_pp, coverage FROM s""")
def weighted_change(spark, d) -> DataFrame:
    """Change over the cells measured at both times."""
    o = table(spark, d, "orders").withColumn("y", F.year("o_orderdate"))
    return agreement.weighted_mean_change(o, ["o_orderpriority"], "o_custkey", "y", F.col("o_totalprice"), F.col("o_custkey") % 5 + 1, 1996, 1998)


@query("SELECT l_suppkey, count(*) AS n_valid, avg(l_extendedprice) AS mean_all, count(*) FILTER (WHERE l_quantity > 40) AS n_inside, avg(l_extendedprice) FILTER (WHERE l_quantity > 40) AS mean_inside FROM lineitem GROUP BY 1")
def conditional_mean_share(spark, d) -> DataFrame:
    """A24."""
    return agreement.conditional_means(table(spark, d, "lineitem"), ["l_suppkey"], F.col("l_extendedprice"), F.col("l_quantity") > 40)


@query("""WITH c AS (SELECT s_nationkey, count(*) AS n, count(*) FILTER (WHERE s_acctbal > 8000) AS rich, sum(s_acctbal) AS w FROM supplier GROUP BY 1), j AS (SELECT n_nationkey, n_regionkey, n, rich, w, max(coalesce(n, 0)) OVER (PARTITION BY n_regionkey) > 0 AS covered FROM nation LEFT JOIN c ON n_nationkey = s_nationkey)
SELECT n_nationkey, n_regionkey, CASE WHEN covered THEN coalesce(n, 0) END AS n_total, CASE WHEN covered THEN coalesce(rich, 0) END AS n_rich, w AS weight_total FROM j""")
def counts_with_uncovered_null(spark, d) -> DataFrame:
    """0 in a covered country, NULL in one without any."""
    points = table(spark, d, "supplier").withColumnRenamed("s_nationkey", "n_nationkey")
    return agreement.facility_counts(points, table(spark, d, "nation"), "n_nationkey", "n_regionkey", {"rich": F.col("s_acctbal") > 8_000}, "s_acctbal")


@query("SELECT year(o_orderdate)::VARCHAR AS year, o_orderpriority AS priority, sum(o_totalprice) AS value FROM orders GROUP BY ALL")
def jsonstat_decode(spark, d) -> DataFrame:
    """A cube encoded by offsets and decoded again."""
    long = table(spark, d, "orders").groupBy(F.year("o_orderdate").cast("string").alias("year"), F.col("o_orderpriority").alias("priority")).agg(F.sum("o_totalprice").alias("v"))
    return jsonstat.tidy(jsonstat.build_cube(long, ["year", "priority"], "v"), ["year", "priority"])


_XY = "(event_id * 37 % 1000) / 10.0 + 0.013 AS x, (event_id * 91 % 997) / 10.0 + 0.017 AS y"
#: Two test polygons, one with a hole.
POLYGONS = {"kite": [[(10.0, 50.0), (45.0, 5.0), (90.0, 50.0), (45.0, 95.0)]], "frame": [[(5.0, 5.0), (60.0, 5.0), (60.0, 60.0), (5.0, 60.0)], [(20.0, 20.0), (40.0, 20.0), (40.0, 40.0), (20.0, 40.0)]]}


def _points(spark, d, *more: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select("event_id", *more, ((F.col("event_id") * 37 % 1000) / 10.0 + 0.013).alias("x"), ((F.col("event_id") * 91 % 997) / 10.0 + 0.017).alias("y"), F.col("value"))


def _polygons(spark) -> DataFrame:
    return spark.createDataFrame([(k, [[{"x": x, "y": y} for x, y in ring] for ring in rings]) for k, rings in POLYGONS.items()], "region string, rings array<array<struct<x: double, y: double>>>")


def _edges_sql() -> str:
    rows = [f"('{k}', {a[0]}, {a[1]}, {b[0]}, {b[1]})" for k, rings in POLYGONS.items() for ring in rings for a, b in zip(ring, ring[1:] + ring[:1])]
    return f"e(region, x1, y1, x2, y2) AS (VALUES {', '.join(rows)}), pt AS (SELECT event_id, {_XY}, value FROM events), i AS (SELECT event_id, region, any_value(value) AS value FROM pt JOIN e ON (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 GROUP BY event_id, region HAVING count(*) % 2 = 1)"


@query(f"WITH {_edges_sql()} SELECT event_id, region FROM i")
def point_in_polygon(spark, d) -> DataFrame:
    """Points in polygons with holes."""
    return grid.points_in_polygons(_points(spark, d), _polygons(spark), "region", 20.0).select("event_id", "region")


@query(f"WITH {_edges_sql()} SELECT pt.event_id, min(region) AS region FROM pt LEFT JOIN i USING (event_id) GROUP BY 1")
def first_polygon(spark, d) -> DataFrame:
    """One region per point, or none."""
    return grid.first_polygon(_points(spark, d), _polygons(spark), "event_id", "region", 20.0)


@query(f"WITH {_edges_sql()} SELECT r.region, sum(value) AS zonal_sum, count(value) AS n_cells, avg(value) AS zonal_mean FROM (SELECT DISTINCT region FROM e) r LEFT JOIN i USING (region) GROUP BY 1")
def zonal_sum(spark, d) -> DataFrame:
    """Sums of cells by polygon."""
    return grid.zonal(_points(spark, d), _polygons(spark), "region", 20.0)


@query(f"SELECT floor(x / 7)::BIGINT AS gx, floor(y / 7)::BIGINT AS gy, avg(CASE WHEN value > 20 THEN 1.0 ELSE 0.0 END) AS mean_value, max(CASE WHEN value > 20 THEN 1.0 ELSE 0.0 END) AS max_value, count(*) AS n_cells FROM (SELECT {_XY}, value FROM events) GROUP BY ALL")
def resample_average(spark, d) -> DataFrame:
    """A threshold at fine resolution, averaged onto a coarser grid."""
    return grid.resample(_points(spark, d), 7.0, (F.col("value") > 20).cast("double"))


@query(f"""WITH pt AS (SELECT event_id, event_type, {_XY} FROM events), g AS (SELECT floor(x / 5 + 0.5)::BIGINT AS ix, floor(y / 5 + 0.5)::BIGINT AS iy, max(event_id) AS v FROM pt WHERE event_type = 'signup' GROUP BY ALL) SELECT event_id, v AS threshold FROM pt LEFT JOIN g ON ix = floor(x / 5 + 0.5)::BIGINT AND iy = floor(y / 5 + 0.5)::BIGINT""")
def nearest_cell_join(spark, d) -> DataFrame:
    """The value of the cell that a point lies nearest to.

    Only events of one type make cells, so the grid has holes; points there get NULL.
    """
    p = _points(spark, d, "event_type")
    step = lambda c: (F.floor(F.col(c) / 5.0 + 0.5) * 5.0).alias(c)
    cells = p.where("event_type = 'signup'").groupBy(step("x"), step("y")).agg(F.max("event_id").alias("threshold"))
    return grid.nearest_cell(p, cells, 5.0, "threshold").select("event_id", "threshold")


@query("""WITH c AS (SELECT event_id AS cell, user_id AS region, 1.0 + event_id % 3 AS km2 FROM events), u AS (SELECT DISTINCT event_id AS cell FROM events WHERE event_type = 'view' UNION SELECT event_id FROM events WHERE value > 30)
SELECT region, sum(km2) AS area, sum(CASE WHEN u.cell IS NOT NULL THEN km2 ELSE 0 END) AS covered, least(sum(CASE WHEN u.cell IS NOT NULL THEN km2 ELSE 0 END) / sum(km2), 1) AS share FROM c LEFT JOIN u USING (cell) GROUP BY 1""")
def union_cell_share(spark, d) -> DataFrame:
    """Overlapping covers count once."""
    e = table(spark, d, "events")
    cells = e.select(F.col("event_id").alias("cell"), F.col("user_id").alias("region"), (1.0 + F.col("event_id") % 3).alias("km2"))
    covers = e.where("event_type = 'view'").select(F.col("event_id").alias("cell")).unionAll(e.where("value > 30").select(F.col("event_id").alias("cell")))
    return grid.union_share(covers, cells, "region", "cell", "km2")


@query(f"""WITH b AS (SELECT event_id, greatest(least(x + 4, 60) - greatest(x, 20), 0) * greatest(least(y + 4, 60) - greatest(y, 20), 0) AS area FROM (SELECT event_id, {_XY} FROM events)) SELECT event_id, 'square' AS name, area FROM b WHERE area > 0""")
def polygon_overlay(spark, d) -> DataFrame:
    """Areas of overlaps of polygons with a convex window."""
    box = F.array(F.array(*(F.struct((F.col("x") + a).alias("x"), (F.col("y") + b).alias("y")) for a, b in ((0, 0), (4, 0), (4, 4), (0, 4)))))
    window = F.array(F.array(*(F.struct(F.lit(float(a)).alias("x"), F.lit(float(b)).alias("y")) for a, b in ((20, 20), (60, 20), (60, 60), (20, 60)))))
    squares = _points(spark, d).select("event_id", box.alias("rings"))
    frames = spark.range(1).select(F.lit("square").alias("name"), window.alias("rings"))
    return grid.overlay(squares, frames, "event_id", "name", 20.0)


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, sum(value) AS total, max(value) AS highest FROM events GROUP BY ALL")
def hourly_tumbling(spark, d) -> DataFrame:
    """Hourly windows."""
    return streams.tumbling(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 hour", ["event_type"], "value").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n, sum(value) AS total, max(value) AS highest FROM events GROUP BY ALL")
def daily_stream(spark, d) -> DataFrame:
    """Daily windows of a replayed stream."""
    like = table(spark, d, "events")
    stream = streams.events(spark, f"{d}/events.parquet*", like)
    days = streams.tumbling(stream, "ts", "1 day", ["event_type"], "value", late="2 days")
    out = streams.replayed(days, new_path(spark, "daily"), ["window_start", "event_type"])
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("""WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM s)
SELECT min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, user_id, count(*) AS n FROM g GROUP BY user_id, k""")
def user_sessions(spark, d) -> DataFrame:
    """Sessions with a gap of half an hour."""
    s = streams.sessions(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "30 minutes", ["user_id"])
    return s.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")})


@query(r"SELECT DISTINCT path, regexp_extract(path, '([^/]+)$', 1) AS name, regexp_extract(path, 'file_(\d+)\.([a-z]+)$', 1) AS number, regexp_extract(path, 'file_(\d+)\.([a-z]+)$', 2) AS form FROM fetch_results WHERE regexp_matches(path, '/file_(\d+)\.([a-z]+)$')")
def provenance_fields(spark, d) -> DataFrame:
    """What a file's name says about it."""
    p = table(spark, d, "fetch_results").select("path").distinct().withColumn("f", files.name_fields(F.col("path"), r"^(file_(\d+)\.([a-z]+))$", ["name", "number", "form"]))
    return p.where("f IS NOT NULL").select("path", "f.*")


@query("SELECT record_id, release_no, nuts_id, CASE WHEN isnan(household_income_pps_per_hab) THEN NULL ELSE household_income_pps_per_hab END AS household_income_pps_per_hab, household_income_year, household_income_flag, household_income_level, CASE WHEN isnan(pop_density_per_km2) THEN NULL ELSE pop_density_per_km2 END AS pop_density_per_km2, pop_density_year, pop_density_flag, received_at FROM demographics")
def legacy_names(spark, d) -> DataFrame:
    """Old names made current; NaN is NULL, as wherever values are read."""
    old = nan_to_null(table(spark, d, "demographics")).withColumnRenamed("household_income_year", "income_vintage")
    return files.with_current_names(old, {"income_vintage": "household_income_year"})


@query(f"WITH {_edges_sql()}, s AS (SELECT i.region, max(CASE WHEN pt.x < 95 THEN pt.value END) AS max_level, count(*) FILTER (WHERE pt.x < 95 AND pt.value >= 30) AS n_over, count(*) FILTER (WHERE pt.x < 95) AS n_cells, avg(CASE WHEN pt.x < 95 THEN 1.0 ELSE 0.0 END) AS box_share FROM i JOIN pt USING (event_id) GROUP BY 1) SELECT region, box_share, CASE WHEN box_share >= 0.99 THEN max_level END AS max_level, CASE WHEN box_share >= 0.99 THEN n_over END AS n_over, CASE WHEN box_share >= 0.99 THEN n_cells END AS n_cells FROM s")
def levels_by_region(spark, d) -> DataFrame:
    """Highest level by region, where enough of it was looked at."""
    return grid.levels_by_region(_points(spark, d), _polygons(spark), "region", 20.0, "value", 30.0, F.col("x") < 95)
