"""Texts over a size limit cut into pieces at natural boundaries, with an overlap."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.ordered import ROWS_PER_BUCKET, running_sum
from tidemark.plans.staging import join_same, measured_side, stage

#: The Unicode characters that are white space, and the signs around the end of a sentence.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
LINE_BREAKS, PARAGRAPH_BREAKS = "\n\x85\u2028", "\u2029"
ENDS, CLOSERS, OPENERS = ".!?…", ")]\"”’»'", "([\"“‘«'"

#: Strength of a boundary; the strongest one near a target is cut at.
PARAGRAPH, SENTENCE, ITEM, CLAUSE, SPACE, NONE = 5, 4, 3, 2, 1, 0

_white = re.compile(f"[{re.escape(WHITE)}]+")
_lines = re.compile(f"([{re.escape(WHITE)}]*[{LINE_BREAKS}{PARAGRAPH_BREAKS}\r][{re.escape(WHITE)}]*)")
_sentence = re.compile(f"[{re.escape(ENDS)}][{re.escape(CLOSERS)}]*(?= [{re.escape(OPENERS)}]*([^\\W\\d_]))")
_clause = re.compile(r"[;:,–—] ")
_item = re.compile(r"(?:[-*•–]|\(?\w{1,3}[.)]) ")


def tidy(text: str) -> tuple[str, list[int], list[int]]:
    """The text with every run of white space made one space, and the places of the spaces that were a blank line, or began a list item."""
    parts = _lines.split(text)
    out, paragraphs, items, at = [], [], [], 0
    for i in range(0, len(parts), 2):
        words = _white.sub(" ", parts[i]).strip(" ")
        if not words:
            continue
        if out:
            gap = parts[i - 1]
            if sum(gap.count(c) for c in LINE_BREAKS) + 2 * gap.count(PARAGRAPH_BREAKS) > 1:
                paragraphs.append(at)
            elif _item.match(words):
                items.append(at)
            at += 1
        out.append(words)
        at += len(words)
    return " ".join(out), paragraphs, items


def sentence_ends(text: str) -> list[int]:
    """The places of the spaces behind the sentences of a tidy text."""
    return [m.end() for m in _sentence.finditer(text) if unicodedata.category(m.group(1)) == "Lu"]


def longest_sentence(text: str, ends: list[int]) -> int:
    return max((b - a for a, b in zip([0, *(e + 1 for e in ends)], [*ends, len(text)])), default=0)


def _strongest(text: str, strong: dict[int, list[int]], low: int, high: int, target: int) -> tuple[int, int]:
    """The place in low..high to cut at and its strength: the strongest boundary, of equal ones the nearest to the target."""
    for strength in (PARAGRAPH, SENTENCE, ITEM):
        places = strong[strength]
        inside = places[bisect_left(places, low) : bisect_right(places, high)]
        if inside:
            return min(inside, key=lambda p: abs(p - target)), strength
    inside = [m.start() + 1 for m in _clause.finditer(text, max(low - 1, 0), min(high + 1, len(text)))]
    if inside := [p for p in inside if low <= p <= high]:
        return min(inside, key=lambda p: abs(p - target)), CLAUSE
    before, after = text.rfind(" ", low, target + 1), text.find(" ", target, high + 1)
    near = [p for p in (before, after) if p >= 0]
    if near:
        return min(near, key=lambda p: abs(p - target)), SPACE
    return target, NONE


def _overlap_start(text: str, strong: dict[int, list[int]], previous: int, cut: int, begins: int, overlap: int) -> int:
    """Where the next piece starts: behind the strongest boundary in the last `overlap` characters before the cut, of equal ones the earliest."""
    low = max(cut - overlap - 1, previous)
    if overlap <= 0 or low >= cut - 1:
        return begins
    for strength in (PARAGRAPH, SENTENCE, ITEM):
        places = strong[strength]
        k = bisect_left(places, low)
        if k < len(places) and places[k] < cut - 1:
            return places[k] + 1
    space = text.find(" ", low, cut - 1)
    return space + 1 if space >= 0 else max(cut - overlap, previous)


def _cuts(text: str, strong: dict[int, list[int]], limit: int, overlap: int, k: int, hold: bool) -> list[tuple[int, int, int]] | None:
    """Pieces at the boundaries nearest to k equal targets, or None where a limit fails.

    Without `hold`, a cut may go anywhere within a quarter of a part. It fails if some piece, usually the last, comes out
    over the limit. With `hold`, no cut goes so far back that the pieces left couldn't take the rest with full
    overlaps, so the limit always holds, and a nearer, maybe weaker boundary is taken instead. Both fail where
    the limit leaves a cut without any boundary although there is one within a quarter of a part.
    """
    n, part, pieces, start, fresh = len(text), len(text) / k, [], 0, 0
    reach = max(1, int(part / 4))
    for i in range(1, k):
        if hold and n - start <= limit:
            break
        target = round(i * part)
        ahead = min(target + reach, start + limit, n - 1)
        floor = max(fresh + 1, n - (k - i) * (limit - overlap)) if hold else fresh + 1
        low = max(target - reach, floor)
        high = max(ahead, min(low, start + limit, n - 1)) if hold else ahead
        low = min(low, high) if hold else low
        if low > high or low <= fresh:
            return None
        cut, strength = _strongest(text, strong, low, high, min(max(target, low), high))
        wide = max(target - reach, fresh + 1), min(target + reach, n - 1)
        if strength == NONE and (wide[0] < low or high < wide[1]) and _strongest(text, strong, *wide, target)[1] != NONE:
            return None
        pieces.append((start, cut, strength))
        fresh = cut + 1 if text[cut] == " " else cut
        start = max(_overlap_start(text, strong, start + 1, cut, fresh, overlap), fresh + 1 - limit)
    return [*pieces, (start, n, NONE)] if fresh < n and n - start <= limit else None


def split_points(text: str, paragraphs: list[int], items: list[int], ends: list[int], limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """(start, end, strength of the boundary at the end) of each piece of a tidy text.

    The least number of pieces k is what the limit and full overlaps allow. k equal parts give the targets; each
    is moved to the strongest boundary within a quarter of a part. If a limit fails, nearer boundaries are tried
    with the same k, and only where they fail too k grows, by one. So the number of pieces is the least for which
    every cut within reach of a boundary is at one; without any boundary the text is cut at the targets.
    """
    n = len(text)
    if n <= limit:
        return [(0, n, NONE)]
    strong = {PARAGRAPH: paragraphs, SENTENCE: ends, ITEM: items}
    k = max(2, -(-(n - overlap) // (limit - overlap)))
    while True:
        for hold in (False, True):
            if pieces := _cuts(text, strong, limit, overlap, k, hold):
                return pieces
        k += 1


def _plan(texts: pd.Series, limit: int, overlap: int) -> pd.DataFrame:
    rows = []
    for text in texts:
        if text is None:
            rows.append(([], [], [], 0))
            continue
        words, paragraphs, items = tidy(text)
        ends = sentence_ends(words)
        pieces = split_points(words, paragraphs, items, ends, limit, overlap)
        rows.append(([p[0] for p in pieces], [p[1] for p in pieces], [p[2] for p in pieces], longest_sentence(words, ends)))
    return pd.DataFrame(rows, columns=["starts", "ends", "strengths", "longest_sentence"])


def plan_pieces(df: DataFrame, text: str, limit: int = 900, overlap: int = 100) -> DataFrame:
    """`df` with tidy_text, n_chars_tidy and, for texts over the limit, plan STRUCT<starts, ends, strengths, longest_sentence>.

    Lengths are in code points. White space is reduced inside the JVM; only texts over the limit cross to Python,
    in Arrow batches, and only numbers come back. NULL texts have NULL in all three; empty ones have length 0.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than limit")

    @F.pandas_udf("starts array<int>, ends array<int>, strengths array<int>, longest_sentence int")
    def planned(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield _plan(texts, limit, overlap)

    spaces = F.regexp_replace(F.col(text), r"(?U)\s+", " ")
    tidied = df.withColumn("tidy_text", F.trim(spaces)).withColumn("n_chars_tidy", F.length("tidy_text"))
    over = F.col("n_chars_tidy") > limit
    return tidied.withColumn("plan", planned(F.when(over, F.col(text)))).withColumn("plan", F.when(over, F.col("plan")))


def split_texts(df: DataFrame, item: str, source: str, ordinal: str, text: str, limit: int = 900, overlap: int = 100, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Rows (`item`, `source`, ordinal, piece, start, text, cut_strength): the pieces of every text, numbered anew within their source.

    `start` counts from 0 in the text with reduced white space. New ordinals run from 0 within a source, by old
    ordinal, item and piece; NULL is a source like any other and NULL ordinals come first. Items delivered twice
    count once: ids that occur again are found on the narrow id column, and of those rows alone the text is
    shuffled and compared; rows of one id that differ all stay. Empty and NULL texts have no pieces. Only counts
    go into the running numbers, in buckets where a source is too large for one task.
    """
    base = df.select(F.col(item).alias("item"), F.col(source).alias("source"), F.col(ordinal).alias("ordinal"), F.col(text).alias("text"))
    again = measured_side(base.groupBy("item").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("item"), "again")
    once = join_same(base, again, ["item"], "left_anti").unionByName(join_same(base, again, ["item"], "left_semi").distinct())
    whole = F.array(F.lit(0)), F.array(F.col("n_chars_tidy")), F.array(F.lit(NONE))
    pick = lambda i, name: F.coalesce(F.col(f"plan.{name}"), whole[i])
    planned = plan_pieces(once, "text", limit, overlap).filter("n_chars_tidy > 0").select("item", "source", "ordinal", "tidy_text", F.arrays_zip(pick(0, "starts").alias("s"), pick(1, "ends").alias("e"), pick(2, "strengths").alias("k")).alias("pieces"))
    planned = stage(planned.withColumn("__row", F.xxhash64("tidy_text")), "pieces")
    counts = planned.groupBy("source", F.coalesce("ordinal", F.lit(-(2**31))).alias("__o"), "item", "__row").agg(F.sum(F.size("pieces")).alias("n"))
    offsets = running_sum(counts, ["source"], ["__o", "item", "__row"], "n", "__offset", rows_per_bucket=rows_per_bucket).drop("n")
    numbered = join_same(planned.withColumn("__o", F.coalesce("ordinal", F.lit(-(2**31)))), measured_side(offsets, "offsets"), ["source", "__o", "item", "__row"])
    exploded = numbered.select("item", "source", "__offset", "tidy_text", F.posexplode("pieces").alias("piece", "p"))
    return exploded.select(F.col("item").alias(item), F.col("source").alias(source), (F.col("__offset") + F.col("piece")).alias("ordinal"), "piece", F.col("p.s").alias("start"), F.substring("tidy_text", F.col("p.s") + 1, F.col("p.e") - F.col("p.s")).alias("text"), F.col("p.k").alias("cut_strength"))
