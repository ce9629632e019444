"""Queries and SQL of the training-data operators: ranking, splitting, containers, mixtures, shared spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.values import identifier, measured
from tidemark.llm.mixing import Mixture, mix_sources
from tidemark.llm.packing import fill_containers
from tidemark.llm.ranking import CENTRE, MIDDLE, TAIL, leading_group, rank_bounds, rank_items
from tidemark.llm.spans import Shared, SpanIndex
from tidemark.llm.splitting import plan_pieces, split_texts
from tidemark.plans.staging import join_same, stage
from tidemark.sources.tables import table

#: The indicators that may be asked for, the old name of one, and the sizes of problems 4, 6 and 8.
INDICATORS = ("exposed_pop", "share_over_65", "share_low_income", "critical_infra_count", "poverty_rate_pct", "pop_density_per_km2")
RENAMED = {"poverty_rate": "poverty_rate_pct"}
PIECE_CHARS, OVERLAP_CHARS, CONTAINER_TOKENS, SPAN_CHARS = 900, 100, 4_096, 200
#: One batch more than are compacted, so that the last one meets a compacted run.
BATCHES = SpanIndex.fanout + 1


def tokens(text: str = "text") -> Column:
    """A token is one byte of the UTF-8 text."""
    return F.octet_length(text)


def ranking_input(spark: SparkSession, d: str) -> DataFrame:
    """One row per request and unit: the latest version, with the indicators that the request doesn't name made NULL."""
    requests = table(spark, d, "vulnerability_requests")
    named = F.col("indicators")
    renamed = F.create_map(*(F.lit(x) for pair in RENAMED.items() for x in pair))
    named = F.transform(named, lambda x: F.coalesce(renamed[x], x))
    asked = requests.select("request_id", F.array_distinct(named).alias("asked"), "perturbation", "top_n").distinct()
    units = table(spark, d, "vulnerability_units")
    latest = units.groupBy("request_id", "lau_id").agg(F.max(F.struct("computed_at", *INDICATORS)).alias("u"))
    joined = latest.join(asked, "request_id")
    return stage(joined.select("request_id", "lau_id", "perturbation", "top_n", *(F.when(F.array_contains("asked", c), measured(F.col(f"u.{c}").cast("double"))).alias(c) for c in INDICATORS)), "ranking_input")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    items = ranking_input(spark, d)
    ranked = rank_items(items, ["request_id"], "lau_id", INDICATORS, unique=True)
    return leading_group(items, ranked, ["request_id"], "lau_id", INDICATORS, "top_n").select("request_id", "lau_id")


def p1_ranking(spark: SparkSession, d: str) -> DataFrame:
    items = ranking_input(spark, d)
    return rank_bounds(rank_items(items, ["request_id"], "lau_id", INDICATORS, perturbation="perturbation", unique=True), ["request_id"])


def p1_scores(spark: SparkSession, d: str) -> DataFrame:
    """The mean normal score of every unit."""
    return rank_items(ranking_input(spark, d), ["request_id"], "lau_id", INDICATORS, unique=True).select("request_id", "lau_id", "score")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    planned = plan_pieces(table(spark, d, "passages").select("passage_id", "text"), "text", PIECE_CHARS, OVERLAP_CHARS)
    cases = F.array_compact(F.array(F.when(F.size("plan.starts") > 1, "over_limit"), F.when(F.col("plan.longest_sentence") > PIECE_CHARS, "long_sentence")))
    return planned.select("passage_id", F.explode(cases).alias("finding")).distinct()


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split_texts(table(spark, d, "passages"), "passage_id", "source", "ordinal", "text", PIECE_CHARS, OVERLAP_CHARS)


def p4_rebuilt(spark: SparkSession, d: str) -> DataFrame:
    """What the pieces of each passage are together: its text again, of so many characters, by pieces none of which is too long or repeats too much."""
    pieces = stage(p4_pieces(spark, d), "pieces")
    line = Window.partitionBy("passage_id").orderBy("piece")  # the pieces of one text
    end = F.col("start") + F.length("text")
    before = F.lag(end).over(line)
    placed = pieces.withColumns({"gap": F.col("start") - before, "fresh": F.substring(F.col("text"), F.greatest(before - F.col("start"), F.lit(0)) + 1, F.length("text"))})
    joint = F.when(F.col("gap") == 1, F.lit(" ")).otherwise(F.lit(""))
    parts = F.array_sort(F.collect_list(F.struct("piece", F.concat(F.coalesce(joint, F.lit("")), F.col("fresh")).alias("t"))))
    fits = (F.max(F.length("text")) <= PIECE_CHARS) & (F.coalesce(F.min("gap"), F.lit(0)) >= -OVERLAP_CHARS) & (F.coalesce(F.max("gap"), F.lit(0)) <= 1)
    return placed.groupBy("passage_id").agg(F.array_join(F.transform(parts, lambda p: p["t"]), "").alias("text"), fits.alias("fits"), (F.count(F.lit(1)) == F.max("piece") + 1).alias("numbered")).select("passage_id", F.md5("text").alias("digest"), F.length("text").alias("n_chars"), "fits", "numbered")


def p4_ordinals(spark: SparkSession, d: str) -> DataFrame:
    """By source, whether the new ordinals run from 0 without a gap, and how many passages they cover."""
    o = p4_pieces(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("ordinal").alias("k"), F.min("ordinal").alias("low"), F.max("ordinal").alias("high"), F.count_distinct("passage_id").alias("n_passages"))
    return o.select("source", "n_passages", ((F.col("n") == F.col("k")) & (F.col("low") == 0) & (F.col("high") == F.col("n") - 1)).alias("without_gaps"))


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    return fill_containers(table(spark, d, "documents"), "doc_id", tokens(), CONTAINER_TOKENS)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """The documents whose parts the packing put into more than one container."""
    return p6_containers(spark, d).groupBy("doc_id").agg(F.min("container").alias("first"), F.max("container").alias("last")).filter("first <> last").select("doc_id")


def p6_parts(spark: SparkSession, d: str) -> DataFrame:
    """By document, how many tokens were packed, in how many parts, and whether all its containers hold what they can."""
    packed = stage(p6_containers(spark, d), "packed")
    full = packed.groupBy("container").agg(F.sum("tokens").alias("load")).filter(F.col("load") > CONTAINER_TOKENS)
    joined = packed.join(full, "container", "left")
    return joined.groupBy("doc_id").agg(F.sum("tokens").alias("n_tokens"), F.count(F.lit(1)).alias("n_parts"), F.count_if(F.col("load").isNotNull()).alias("n_over"))


def p6_space(spark: SparkSession, d: str) -> DataFrame:
    """How many tokens there are, and whether the containers number at most 3 % (and one) more than the tokens would fill without a gap."""
    packed = p6_containers(spark, d).agg(F.sum("tokens").alias("n_tokens"), F.count_distinct("container").alias("n"))
    return packed.select("n_tokens", (F.col("n") <= F.ceil(F.col("n_tokens") / CONTAINER_TOKENS * 1.03) + 1).alias("tight"))


def mixture(spark: SparkSession, d: str) -> Mixture:
    return mix_sources(table(spark, d, "documents"), "doc_id", "source", tokens(), table(spark, d, "mix_targets"), seed=17)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return mixture(spark, d).shares.filter("falls_short").select("mix_id", "source")


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixture(spark, d).shares


def p7_budgets(spark: SparkSession, d: str) -> DataFrame:
    """What was asked of each source, and whether what was reached is proved the nearest and at most one document from what could be."""
    docs = table(spark, d, "documents").groupBy(identifier("source").alias("__s")).agg(F.max(tokens()).alias("largest"))
    joined = join_same(mixture(spark, d).shares.withColumn("__s", identifier("source")), docs, ["__s"], "left")
    could = F.least("budget", F.col("available") * F.col("max_repeats"))
    near = F.col("reached").between(could - F.coalesce("largest", F.lit(0)), could)
    return joined.select("mix_id", "source", "target_share", "max_repeats", "available", "mix_tokens", "budget", "proved", near.alias("near"), "falls_short")


def p7_chosen(spark: SparkSession, d: str) -> DataFrame:
    return mixture(spark, d).chosen


def p7_totals(spark: SparkSession, d: str) -> DataFrame:
    """By mix and source, what the chosen documents come to, over the rows that chose any."""
    m = mixture(spark, d)
    chosen = m.chosen.groupBy("mix_id", "source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("n_tokens"), F.max("copies").alias("most"))
    given = m.shares.select("mix_id", identifier("source").alias("source"), "reached", "budget", "max_repeats")
    joined = join_same(chosen, given, ["mix_id", "source"])
    return joined.select("mix_id", "source", (F.col("n_tokens") == F.col("reached")).alias("adds_up"), (F.col("n_tokens") <= F.col("budget")).alias("within"), (F.col("most") <= F.col("max_repeats")).alias("repeats_kept"))


def shared_spans(spark: SparkSession, d: str) -> tuple[Shared, DataFrame]:
    """All documents, taken in by order of publication in BATCHES batches; those without a date come first."""
    documents = table(spark, d, "documents")
    marks = documents.select(F.unix_micros(F.col("published_at").cast("timestamp")).alias("t")).agg(F.percentile_approx("t", [i / BATCHES for i in range(1, BATCHES)])).first()[0] or []
    texts = documents.select(F.col("doc_id").alias("doc"), "text")
    number = F.lit(0)
    for mark in marks:
        number = number + F.when(F.unix_micros(F.col("published_at").cast("timestamp")) > mark, 1).otherwise(0)
    index = SpanIndex(spark, SPAN_CHARS)
    index.add_batches(documents.select(F.col("doc_id").alias("doc"), "text", number.alias("batch")), "batch", BATCHES)
    shared = index.shared(texts)
    index.close()  # what is shared stands in tables of its own
    return shared, texts


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return shared_spans(spark, d)[0].pairs()


def p8_spans(spark: SparkSession, d: str) -> DataFrame:
    return shared_spans(spark, d)[0].spans()


def p8_coverage(spark: SparkSession, d: str) -> DataFrame:
    shared, texts = shared_spans(spark, d)
    return shared.coverage(texts)


QUERIES = {f.__name__: f for f in (p1_found, p1_ranking, p1_scores, p4_found, p4_pieces, p4_rebuilt, p4_ordinals, p6_found, p6_containers, p6_parts, p6_space, p7_found, p7_shares, p7_budgets, p7_chosen, p7_totals, p8_found, p8_spans, p8_coverage)}

_WS = r"[\s\v\x{85}\p{Z}]"


def _p1_sql() -> str:
    masked = ", ".join(f"CASE WHEN list_contains(asked, '{c}') THEN CASE WHEN isnan({c}::DOUBLE) THEN NULL ELSE {c}::DOUBLE END END AS {c}" for c in INDICATORS)
    wins = " + ".join(f"CASE WHEN a.{c} > b.{c} THEN 1 ELSE 0 END" for c in INDICATORS)
    both = " + ".join(f"CASE WHEN a.{c} IS NOT NULL AND b.{c} IS NOT NULL THEN 1 ELSE 0 END" for c in INDICATORS)
    return f"""
WITH r AS (SELECT request_id, top_n, list_transform(indicators, lambda x: CASE WHEN x = 'poverty_rate' THEN 'poverty_rate_pct' ELSE x END) AS asked FROM vulnerability_requests),
l AS (SELECT *, row_number() OVER (PARTITION BY request_id, lau_id ORDER BY computed_at DESC) AS rn FROM vulnerability_units),
u AS (SELECT l.request_id, lau_id, top_n, {masked}, count(*) OVER (PARTITION BY l.request_id) AS n FROM l JOIN r ON l.request_id = r.request_id WHERE rn = 1)
SELECT a.request_id, a.lau_id FROM u a LEFT JOIN u b ON a.request_id = b.request_id AND a.lau_id <> b.lau_id
GROUP BY a.request_id, a.lau_id, a.n, a.top_n HAVING coalesce(sum(CASE WHEN 2 * ({wins}) > ({both}) THEN 1 ELSE 0 END), 0) >= a.n - a.top_n
"""


def _scores_sql() -> str:
    """Percentiles by two ranks and the quantile function by the published coefficients, score by score."""

    def ratio(x: str, both) -> str:
        poly = lambda terms: " + ".join(f"{t!r}::DOUBLE * ({x}) ** {i}" for i, t in enumerate(terms))
        return f"(({poly(both[0])}) / ({poly(both[1])}))"

    masked = " UNION ALL ".join(f"SELECT l.request_id, lau_id, '{c}' AS k, CASE WHEN list_contains(asked, '{c}') AND NOT isnan({c}::DOUBLE) THEN {c}::DOUBLE END AS v FROM l JOIN r ON l.request_id = r.request_id WHERE rn = 1" for c in INDICATORS)
    far = f"CASE WHEN t <= 5 THEN {ratio('t - 1.6', MIDDLE)} ELSE {ratio('t - 5.0', TAIL)} END"
    return f"""
WITH r AS (SELECT DISTINCT request_id, list_transform(indicators, lambda x: CASE WHEN x = 'poverty_rate' THEN 'poverty_rate_pct' ELSE x END) AS asked FROM vulnerability_requests),
l AS (SELECT *, row_number() OVER (PARTITION BY request_id, lau_id ORDER BY computed_at DESC) AS rn FROM vulnerability_units),
u AS ({masked}), n AS (SELECT *, CASE WHEN v IS NOT NULL THEN (rank() OVER (PARTITION BY request_id, k ORDER BY v NULLS LAST) - 1 + count(*) OVER (PARTITION BY request_id, k, v) / 2.0) / nullif(count(v) OVER (PARTITION BY request_id, k), 0) END AS p FROM u),
q AS (SELECT *, p - 0.5 AS d, sqrt(-ln(least(p, 1 - p))) AS t FROM n)
SELECT request_id, lau_id, avg(CASE WHEN abs(d) <= 0.425 THEN d * {ratio('0.180625 - d * d', CENTRE)} ELSE sign(d) * {far} END) AS score FROM q GROUP BY ALL"""


_P7_SOURCES = rf"""
WITH s AS (SELECT regexp_replace(lower(source), '^{_WS}+|{_WS}+$', '', 'g') AS source, sum(octet_length(encode(text)))::BIGINT AS available, min(nullif(octet_length(encode(text)), 0)) AS smallest FROM documents GROUP BY 1),
m AS (SELECT t.*, smallest, coalesce(available, 0) AS available, sum(coalesce(available, 0)) OVER (PARTITION BY mix_id)::BIGINT AS mix_tokens FROM mix_targets t LEFT JOIN s ON lower(t.source) = s.source)
"""
_P7 = f"{_P7_SOURCES} SELECT mix_id, source FROM m WHERE available * max_repeats < target_share * mix_tokens"

_P8 = f"""WITH w AS (SELECT doc_id, text, unnest(range(1, length(text) - {SPAN_CHARS - 2})) AS i FROM documents WHERE length(text) >= {SPAN_CHARS}),
h AS (SELECT doc_id, i, substr(text, i, {SPAN_CHARS}) AS s FROM w), g AS (SELECT s, count(DISTINCT doc_id) AS n FROM h GROUP BY s HAVING count(DISTINCT doc_id) > 1), m AS (SELECT h.*, n FROM h JOIN g ON h.s = g.s)"""
_P8_SPANS = f"""{_P8}, l AS (SELECT *, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {SPAN_CHARS} THEN 1 ELSE 0 END AS gap FROM m),
k AS (SELECT *, sum(gap) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM l), sp AS (SELECT doc_id, min(i) - 1 AS start, max(i) - 1 + {SPAN_CHARS} AS stop, max(n) AS n_docs FROM k GROUP BY doc_id, island)"""

SQL = {
    "p1_found": _p1_sql(),
    "p4_found": rf"""
WITH t AS (SELECT DISTINCT passage_id, trim(regexp_replace(text, '{_WS}+', ' ', 'g')) AS x FROM passages),
o AS (SELECT passage_id, x FROM t WHERE length(x) > {PIECE_CHARS}),
s AS (SELECT passage_id, string_split(regexp_replace(x, '([.!?…][)\]"”’»'']*) ([(\["“‘«'']*\p{{Lu}})', '\1' || chr(31) || '\2', 'g'), chr(31)) AS parts FROM o)
SELECT passage_id, 'over_limit' AS finding FROM o
UNION SELECT passage_id, 'long_sentence' FROM s WHERE list_max(list_transform(parts, lambda p: length(p))) > {PIECE_CHARS}
""",
    "p1_scores": _scores_sql(),
    "p4_rebuilt": rf"SELECT passage_id, md5(x) AS digest, length(x) AS n_chars, true AS fits, true AS numbered FROM (SELECT DISTINCT passage_id, trim(regexp_replace(text, '{_WS}+', ' ', 'g')) AS x FROM passages) WHERE x <> ''",
    "p4_ordinals": rf"SELECT source, count(DISTINCT passage_id) AS n_passages, true AS without_gaps FROM passages WHERE trim(regexp_replace(text, '{_WS}+', ' ', 'g')) <> '' GROUP BY 1",
    "p6_parts": f"SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT AS n_tokens, greatest(ceil(coalesce(octet_length(encode(text)), 0) / {CONTAINER_TOKENS}), 1)::BIGINT AS n_parts, 0 AS n_over FROM documents",
    "p6_space": "SELECT sum(octet_length(encode(text)))::BIGINT AS n_tokens, true AS tight FROM documents",
    "p6_found": f"SELECT doc_id FROM documents WHERE octet_length(encode(text)) > {CONTAINER_TOKENS}",
    "p7_found": _P7,
    "p7_budgets": f"{_P7_SOURCES} SELECT mix_id, source, target_share, max_repeats, available, mix_tokens, floor(target_share * mix_tokens)::BIGINT AS budget, true AS proved, true AS near, available * max_repeats < target_share * mix_tokens AS falls_short FROM m",
    "p7_totals": f"{_P7_SOURCES} SELECT mix_id, lower(source) AS source, true AS adds_up, true AS within, true AS repeats_kept FROM m WHERE least(floor(target_share * mix_tokens), available * max_repeats) >= smallest",
    "p8_found": f"{_P8} SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b FROM m a JOIN m b ON a.s = b.s AND a.doc_id < b.doc_id",
    "p8_spans": f'{_P8_SPANS} SELECT doc_id AS doc, start, stop AS "end", n_docs FROM sp',
    "p8_coverage": f"{_P8_SPANS}, c AS (SELECT doc_id, count(*) AS n_spans, sum(stop - start) AS shared FROM sp GROUP BY 1) SELECT d.doc_id AS doc, length(text) AS n_chars, coalesce(n_spans, 0) AS n_spans, coalesce(shared, 0) AS shared_chars, coalesce(shared, 0) / nullif(length(text), 0)::DOUBLE AS shared_share FROM documents d LEFT JOIN c ON d.doc_id = c.doc_id",
}
