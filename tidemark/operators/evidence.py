"""Text evidence: tokens, sentence passages, BM25 retrieval behind a gate, grounding, citations, figures, HTML to text, fences."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import reduce
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.plans.staging import join_same, measured_parts, measured_side, stage

#: Words that don't count, thresholds of the gate, and the parameters of BM25.
STOPWORDS = """
the a an and or of to in on at by for with from as is are was were be been it its this that these those which who
what when where how not do does did has have had can could will would should may might also than then there
le la les un une des du de et ou mais au aux en dans par pour avec sur sous est sont ete etre qui que quoi dont ce
cette ces il elle ils elles leur pas
""".split()
LEAST_SCORE, LEAST_COVERAGE, K1, B, PASSAGE_CHARS, EXCERPT_CHARS = 1.5, 0.4, 1.5, 0.75, 900, 600

#: More than two scores equal to nine decimals, or two orders of adding one, can differ by.
_ROUNDING = 1e-8

_CITE = r"\[S(\d+)\]"


def spread(docs: DataFrame) -> DataFrame:
    """`docs` dealt out over all cores where the scan has fewer partitions, as one file of texts is one task; tokenising costs more than sending them."""
    cores, plan = docs.sparkSession.sparkContext.defaultParallelism, docs._jdf.queryExecution()
    if "Exchange" in plan.executedPlan().toString():  # its partitions aren't known before it runs
        return docs
    return docs.repartition(cores) if plan.toRdd().getNumPartitions() < cores else docs


def tokens(text: Column) -> Column:
    """Lower-case content words: runs of letters and digits of any script, over two characters, without stop words."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]{3,}"), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(STOPWORDS))


def sentences(text: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")), r"(?<=[.!?])\s+")


def passages(docs: DataFrame, source: str, text: str, most: int = PASSAGE_CHARS) -> DataFrame:
    """(source, ordinal, text): whole sentences packed in order while they fit; a longer sentence is a passage of its own.

    A fold over the row's own sentences inside the JVM; nothing is shuffled.
    """
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(a: Column, s: Column) -> Column:
        full = (F.length(a["open"]) > 0) & (F.length(a["open"]) + F.length(s) > most)
        return F.struct(F.when(full, F.array_append(a["done"], F.rtrim(a["open"]))).otherwise(a["done"]).alias("done"), F.concat(F.when(full, F.lit("")).otherwise(a["open"]), s, F.lit(" ")).alias("open"))

    packed = F.aggregate(sentences(F.col(text)), start, step, lambda a: F.filter(F.array_append(a["done"], F.trim(a["open"])), lambda x: x != ""))
    return docs.select(source, F.posexplode(packed).alias("ordinal", "text"))


def term_counts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf, length): how often each term stands in each document, and how many terms that has."""
    split = spread(docs.select(key, text)).select(key, tokens(F.col(text)).alias("__t")).withColumn("length", F.size("__t"))
    return split.select(key, "length", F.explode("__t").alias("term")).groupBy(key, "length", "term").agg(F.count(F.lit(1)).alias("tf"))


def asked_postings(docs: DataFrame, key: str, text: str, vocabulary: DataFrame) -> DataFrame:
    """(key, found): one row a document, with (__id, length, tf) of each term of `vocabulary` (term, __id) that it has.

    One entry more, whose __id is NULL, stands for the document itself, so lengths come from the same pass over the texts. Only
    terms of the vocabulary leave the scan; they are shuffled once.
    """
    sized = spread(docs.select(key, text)).select(key, F.coalesce(tokens(F.col(text)), F.array().cast("array<string>")).alias("__t")).withColumn("length", F.size("__t"))
    exploded = sized.select(key, "length", F.explode(F.array_append("__t", F.lit(None).cast("string"))).alias("term"))
    counts = join_same(exploded, vocabulary, ["term"]).select(key, "length", "__id").repartition(key).groupBy(key, "length", "__id").agg(F.count(F.lit(1)).alias("tf"))
    return stage(counts.groupBy(key).agg(F.collect_list(F.struct("__id", "length", "tf")).alias("found")), "postings")


def term_weights(postings: DataFrame, key: str, totals: DataFrame, k1: float, b: float) -> DataFrame:
    """(key, ids, ws, ns): the terms of a document, their weights before idf, and how many postings each has: more than one where a key has texts of several lengths."""

    def part(e: Column) -> Column:
        return e["tf"] * (k1 + 1) / (e["tf"] + k1 * (1 - b + b * e["length"] / F.when(F.col("mean") > 0, F.col("mean")).otherwise(1.0)))

    def same(i: Column) -> Column:
        return F.filter("own", lambda e: e["__id"] == i)

    terms = postings.crossJoin(F.broadcast(totals)).withColumn("own", F.filter("found", lambda e: e["__id"].isNotNull()))  # totals are one row
    one, ids = F.size("found") - F.size("own") == 1, F.array_distinct("own.__id")
    ws = F.when(one, F.transform("own", part)).otherwise(F.transform(ids, lambda i: F.aggregate(same(i), F.lit(0.0), lambda a, e: a + part(e))))
    ns = F.when(one, F.array_repeat(F.lit(1), F.size("own"))).otherwise(F.transform(ids, lambda i: F.size(same(i))))
    return terms.select(key, F.when(one, F.col("own.__id")).otherwise(ids).alias("ids"), ws.alias("ws"), ns.alias("ns"))


def term_bounds(weights: DataFrame, totals: DataFrame, k: int, k1: float) -> DataFrame:
    """(__id, idf, top, kth, deep): idf, greatest weight, and weights that k and 4 k documents at least reach, 0 where there are fewer.

    From counts by classes of weights, so no term's postings are gathered.
    """
    each = weights.select(F.explode(F.arrays_zip("ids", "ws", "ns")).alias("e")).select(F.col("e.ids").alias("__id"), F.col("e.ws").alias("w"), F.col("e.ns").alias("n"))
    classes = each.groupBy("__id", F.floor(F.col("w") * 256 / (k1 + 1)).alias("class")).agg(F.sum("n").alias("df"), F.count(F.lit(1)).alias("docs"), F.min("w").alias("least"), F.max("w").alias("most"))
    seen = classes.withColumn("seen", F.sum("docs").over(Window.partitionBy("__id").orderBy(F.col("class").desc())))
    reach = lambda n: F.coalesce(F.max(F.when(F.col("seen") >= n, F.col("least"))), F.lit(0.0))
    terms = seen.groupBy("__id").agg(F.sum("df").alias("df"), F.max("most").alias("top"), reach(k).alias("kth"), reach(4 * k).alias("deep"))
    return terms.crossJoin(F.broadcast(totals)).select("__id", F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"), "top", "kth", "deep")


def scored(weights: DataFrame, key: str, entries: DataFrame, query: str) -> DataFrame:
    """(query, key, score, n_terms) of the documents in which a term of `entries` (query, __id, need, theta, terms) weighs `need` or more and whose whole score is `theta` or more.

    Scores come from the document's own row, so only those rows leave the scan that reach theta. A document may occur once for each such term.
    """
    value = lambda column, t: F.coalesce(F.get(column, F.array_position("ids", t["__id"]).cast("int") - 1), F.lit(0))
    score = F.aggregate("terms", F.lit(0.0), lambda a, t: a + t["weight"] * value("ws", t))
    n_terms = F.aggregate("terms", F.lit(0), lambda a, t: a + value("ns", t))
    each, parts = weights.select(key, "ids", "ws", "ns", F.posexplode("ids").alias("__at", "__id")), []
    for part in measured_parts(entries, query, "entries"):
        least = part.groupBy("__id").agg(F.min("need").alias("__least"))  # a light posting of a common term meets none of the many queries that ask for it
        met = each.join(F.broadcast(least), "__id").where(F.get("ws", F.col("__at")) >= F.col("__least")).join(part, "__id").where(F.get("ws", F.col("__at")) >= F.col("need"))
        parts.append(met.select(query, key, "theta", score.alias("score"), n_terms.alias("n_terms")).where("score >= theta").drop("theta"))
    return reduce(DataFrame.unionByName, parts).dropDuplicates([query, key])


def bm25(docs: DataFrame, key: str, text: str, queries: DataFrame, query: str, question: str, k: int = 5, k1: float = K1, b: float = B) -> DataFrame:
    """(query, key, score, rank, coverage): the k best documents of each query.

    idf is ln(1 + (N - df + 0.5) / (df + 0.5)); a term asked twice counts twice. Ties, scores equal to nine decimals, go to the
    lesser key, so the order in which terms were added decides nothing.

    Documents that can't be among the k best are never paired with a query. `theta` is a score that k documents reach: first by one
    term alone, then in whole, from the heaviest postings of each term. Of a query's terms, the strongest first, a posting counts only
    if its weight and the greatest ones of the terms after it reach theta. Whoever scores theta or more has such a posting, its
    strongest, so nothing is lost.
    """
    asked = stage(queries.select(query, tokens(F.col(question)).alias("asked")), "asked")
    wanted = asked.select(query, F.explode("asked").alias("term")).groupBy(query, "term").agg(F.count(F.lit(1)).alias("times"))
    marked = wanted.select("term").unionByName(wanted.sparkSession.createDataFrame([(None,)], "term string")).distinct()
    vocabulary = measured_side(marked.select("term", F.when(F.col("term").isNotNull(), F.monotonically_increasing_id()).alias("__id")), "terms")
    postings = asked_postings(docs, key, text, vocabulary)
    own = postings.select(F.explode(F.filter("found", lambda e: e["__id"].isNull())).alias("e")).select("e.length", "e.tf")
    totals = stage(own.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("n"), F.coalesce(F.try_divide(F.sum(F.col("length") * F.col("tf")), F.sum("tf")), F.lit(0.0)).alias("mean")), "totals")
    weights = term_weights(postings, key, totals, k1, b)
    terms = wanted.join(vocabulary, "term").join(term_bounds(weights, totals, k, k1), "__id").withColumn("weight", F.col("times") * F.col("idf"))
    whole, most = Window.partitionBy(query), F.col("weight") * F.col("top")
    after = whole.orderBy(most.desc(), "__id").rowsBetween(1, Window.unboundedFollowing)
    bounds = terms.select(query, "__id", "weight", "top", "deep", F.coalesce(F.sum(most).over(after), F.lit(0.0)).alias("rest"), F.max(F.col("weight") * F.col("kth")).over(whole).alias("theta"), F.collect_list(F.struct("__id", "weight")).over(whole).alias("terms"))
    entries = stage(bounds.withColumn("theta", F.col("theta") - _ROUNDING), "bounds")
    line = Window.partitionBy(query).orderBy(F.round("score", 9).desc(), key)
    ranked = lambda found: found.where("score > 0").withColumn("rank", F.row_number().over(line)).where(F.col("rank") <= k)
    heavy = scored(weights, key, entries.select(query, "__id", "terms", "theta", F.col("deep").alias("need")), query)
    reached = ranked(heavy).where(F.col("rank") == k).select(query, (F.col("score") - _ROUNDING).alias("reached"))
    closer = entries.join(reached, query, "left").withColumn("theta", F.greatest("theta", "reached")).withColumn("need", (F.col("theta") - F.col("rest")) / F.col("weight"))
    best = ranked(scored(weights, key, closer.where("top >= need").select(query, "__id", "terms", "theta", "need"), query))
    return best.join(asked.select(query, F.size(F.array_distinct("asked")).alias("n_asked")), query).select(query, key, "score", "rank", F.try_divide(F.col("n_terms").cast("double"), F.col("n_asked").cast("double")).alias("coverage"))


def gated(hits: DataFrame, query: str, least_score: float = LEAST_SCORE, least_coverage: float = LEAST_COVERAGE) -> DataFrame:
    """Hits of the queries whose best one scores enough and covers enough of the words asked; of the others none, so that the caller refuses."""
    hits = stage(hits, "hits")  # they are read twice
    good = hits.where((F.col("rank") == 1) & (F.col("score") >= least_score) & (F.col("coverage") >= least_coverage)).select(query)
    return hits.join(good, query, "left_semi")


def evidence_rows(hits: DataFrame, docs: DataFrame, query: str, key: str, text: str, most: int = EXCERPT_CHARS) -> DataFrame:
    """(query, id, key, text, score): the hits of a query as numbered sources S1, S2 .. with the head of their text and the score to three decimals.

    The few hits meet the texts; the excerpt is what the caller shows, while the scores are of whole texts.
    """
    heads = docs.select(key, F.substring(text, 1, most).alias("text"))
    return heads.join(measured_side(hits.select(query, key, "rank", "score"), "hits"), key).select(query, F.concat(F.lit("S"), F.col("rank").cast("string")).alias("id"), key, "text", F.bround("score", 3).alias("score"))


def without_citations(text: Column) -> Column:
    return F.regexp_replace(text, _CITE, " ")


def grounding(answer: Column, evidence: Column) -> Column:
    """Share of the answer's distinct content words that stand in the evidence (an array of texts); 0 for an answer without any."""
    said = F.array_distinct(tokens(without_citations(answer)))
    known = F.flatten(F.transform(evidence, lambda t: F.array_distinct(tokens(t))))
    return F.when(F.size(said) > 0, F.size(F.array_intersect(said, known)) / F.size(said)).otherwise(0.0)


def citations(text: Column) -> Column:
    """The numbers of the markers [S1], in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(_CITE), F.lit(1)), lambda x: x.try_cast("int"))


def invalid_citations(text: Column, n_sources: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(citations(text), lambda x: (x < 1) | (x > n_sources))))


def figures(text: Column) -> Column:
    """Every number of the text as its digits, in order: separators between digits dropped, markers left out."""
    found = F.regexp_extract_all(without_citations(text), F.lit(r"(\d+(?:[ .,\u00a0\u202f]\d+)*)"), F.lit(1))
    return F.transform(found, lambda x: F.regexp_replace(x, r"\D", ""))


def figures_kept(source: Column, target: Column) -> Column:
    """Both texts have the same numbers and the same markers in the same order."""
    return (figures(source) == figures(target)) & (citations(source) == citations(target))


class _Text(HTMLParser):
    """Text outside script and style, entities resolved."""

    hidden = ("script", "style")

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.depth = 0

    def handle_starttag(self, tag, attrs) -> None:
        self.depth += tag in self.hidden

    def handle_endtag(self, tag) -> None:
        self.depth -= tag in self.hidden and self.depth > 0

    def handle_data(self, data) -> None:
        if not self.depth:
            self.parts.append(data)


def html_text(html: str | None) -> str | None:
    if html is None:
        return None
    parser = _Text()
    parser.feed(html)
    parser.close()
    return " ".join(" ".join(parser.parts).split())


@F.pandas_udf(T.StringType())
def html_to_text(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Text of HTML pages, in Arrow batches; a parser, because patterns can't tell script from text."""
    for batch in pages:
        yield batch.map(html_text)


@F.pandas_udf(T.StringType())
def fenced(text: pd.Series, source: pd.Series) -> pd.Series:
    """A passage between tags, in compatibility form, that can't close its own tag or break the attribute."""

    def one(t: str | None, s: str | None) -> str | None:
        if t is None:
            return None
        t = unicodedata.normalize("NFKC", t).replace("</passage", "<\\/passage")
        s = unicodedata.normalize("NFKC", s or "").replace("&", "&amp;").replace('"', "&quot;").replace("<", "&lt;")
        return f'<passage source="{s}">{t}</passage>'

    return pd.Series([one(t, s) for t, s in zip(text, source)])
