import random
from pathlib import Path

import numpy as np
import pytest

from tidemark.llm import queries, spans
from tidemark.llm.spans import SpanIndex, rolling, select_fingerprints, window_hashes

SPAN, GRAM = 20, 9


def corpus(seed=0, n=40):
    r = random.Random(seed)
    word = lambda k: "".join(r.choice("abcdé😀 ") for _ in range(k))
    common = [word(r.randint(15, 45)) for _ in range(8)] + ["ab" * 20, "z" * 30]
    texts = []
    for _ in range(n):
        parts = [word(r.randint(0, 60))]
        for _ in range(r.randint(0, 3)):
            piece = r.choice(common)
            a = r.randint(0, 6)
            parts += [piece[a : len(piece) - r.randint(0, 6)], word(r.randint(0, 40))]
        texts.append("".join(parts))
    return texts + [None, "", "short", texts[0], texts[1]]


def truth(texts):
    where = {}
    for i, t in enumerate(texts):
        for s in range(len(t or "") - SPAN + 1):
            where.setdefault(t[s : s + SPAN], set()).add((i, s))
    shared = [w for w in where.values() if len({i for i, _ in w}) > 1]
    pairs = {(a, b) for w in shared for a, _ in w for b, _ in w if a < b}
    covered = {}
    for w in shared:
        for i, s in w:
            covered.setdefault(i, set()).update(range(s, s + SPAN))
    return pairs, covered


def test_rolling_hash_depends_on_the_stretch_alone():
    codes = np.array([5, 6, 7, 8, 9, 5, 6, 7, 8, 9, 1], dtype=np.uint32)
    for k in (1, 2, 3, 5):
        h = rolling(codes, k)
        assert len(h) == len(codes) - k + 1 and h[0] == h[5]
        for i in range(len(h)):
            assert h[i] == rolling(codes[i : i + k], k)[0]
    assert len(rolling(codes, 12)) == 0


def test_every_shared_stretch_has_a_common_gram():
    texts = corpus(3)
    number, place, value = select_fingerprints(texts, GRAM, SPAN)
    chosen = {}
    for n, p, h in zip(number, place, value):
        chosen.setdefault(n, {})[p] = h
    for i, t in enumerate(texts):
        for s in range(len(t or "") - SPAN + 1):
            inside = [h for p, h in chosen[i].items() if s <= p <= s + SPAN - GRAM]
            assert inside


def test_long_texts_are_the_same_in_parts(monkeypatch):
    texts = corpus(5)
    places = [np.arange(0, len(t or ""), 7) for t in texts]
    whole = select_fingerprints(texts, GRAM, SPAN), window_hashes(texts, places, GRAM, SPAN)
    monkeypatch.setattr(spans, "CHUNK", 50)
    parts = select_fingerprints(texts, GRAM, SPAN), window_hashes(texts, places, GRAM, SPAN)
    for a, b in zip(whole, parts):
        rows = lambda x: sorted(set(zip(*(c.tolist() for c in x))))
        assert rows(a) == rows(b)


@pytest.mark.parametrize("batches,fanout", [(1, 4), (3, 4), (5, 2)])
def test_pairs_and_coverage_against_brute_force(spark, batches, fanout):
    texts = corpus(batches)
    df = spark.createDataFrame(list(enumerate(texts)), "doc bigint, text string")
    index = SpanIndex(spark, SPAN, GRAM, buckets=3, fanout=fanout)
    for b in range(batches):
        index.add_batch(df.where(f"doc % {batches} = {b}"))
    assert len(index.runs) < fanout + 3
    shared = index.shared(df)
    pairs, covered = truth(texts)
    for chunk in (1_000, 2):
        assert {tuple(r) for r in shared.pairs(chunk).collect()} == pairs
    found = {}
    for r in shared.spans().collect():
        found.setdefault(r.doc, set()).update(range(r.start, r.end))
    assert found == covered
    got = {r.doc: r for r in shared.coverage(df).collect()}
    assert {d: len(c) for d, c in covered.items()} == {d: r.shared_chars for d, r in got.items() if r.shared_chars}
    assert len(got) == len(texts) and got[len(texts) - 5].shared_share is None


def test_runs_are_joined_without_a_shuffle(spark):
    df = spark.createDataFrame([(i, "some text that is long enough " * 3 + str(i)) for i in range(20)], "doc bigint, text string")
    index = SpanIndex(spark, SPAN, GRAM, buckets=3)
    for b in range(2):
        index.add_batch(df.where(f"doc % 2 = {b}"))
    a, b = (spark.table(r.table) for r in index.runs)
    plan = a.join(b.withColumnsRenamed({"low": "l2", "high": "h2"}).hint("merge"), "h")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_empty(spark):
    df = spark.createDataFrame([], "doc bigint, text string")
    index = SpanIndex(spark, SPAN, GRAM, buckets=2)
    assert index.shared(df).pairs().count() == 0
    index.add_batch(df)
    shared = index.shared(df)
    assert shared.pairs().count() == 0 and shared.spans().count() == 0 and shared.coverage(df).count() == 0


def test_a_common_footer_is_one_set(spark):
    footer = "this footer stands below very many texts"
    df = spark.createDataFrame([(i, f"{i:030d}" + footer) for i in range(60)], "doc bigint, text string")
    index = SpanIndex(spark, SPAN, GRAM, buckets=2)
    index.add_batch(df)
    shared = index.shared(df)
    assert shared.pairs(7).count() == 60 * 59 // 2
    assert {r.n_docs for r in shared.spans().collect()} == {60}


def test_query_meets_a_compacted_run(spark, data, monkeypatch):
    """The last batch is joined with a compacted run, and the runs that went into it leave no files."""
    seen, take_in = [], SpanIndex._take_in

    def watched(self, path):
        before = list(self.runs)
        take_in(self, path)
        seen.append(([r.level for r in before], [r.heads for r in before if r not in self.runs]))

    monkeypatch.setattr(SpanIndex, "_take_in", watched)
    tables = spark.catalog.listTables()
    queries.shared_spans(spark, data)
    assert 1 in seen[-1][0]
    gone = [p for _, paths in seen for p in paths]
    assert gone and not any(Path(p.removeprefix("file://")).exists() for p in gone)
    assert spark.catalog.listTables() == tables


def test_a_later_session_goes_on(spark, tmp_path):
    """Two batches by one index, three by others that open its folder; the same pairs as all at once."""
    texts = corpus(8)
    df = spark.createDataFrame(list(enumerate(texts)), "doc bigint, text string")
    folder = f"file://{tmp_path}/index"
    for batch in ((0, 1), (2,), (3, 4)):
        index = SpanIndex(spark, SPAN, GRAM, buckets=3, fanout=2, folder=folder)
        assert [r.level for r in index.runs] == {0: [], 2: [1], 3: [1, 0]}[batch[0]]
        for b in batch:
            index.add_batch(df.where(f"doc % 5 = {b}"))
        if batch[-1] < 4:
            index.close()
    assert {tuple(r) for r in index.shared(df).pairs().collect()} == truth(texts)[0]
    with pytest.raises(ValueError):
        SpanIndex(spark, SPAN + 1, GRAM, folder=folder)
    index.close()
    assert len([n for n in (tmp_path / "index").iterdir() if n.name.startswith("manifest-")]) == 1


def test_batches_in_one_pass(spark):
    texts = corpus(4)
    df = spark.createDataFrame([(i, t, i % 3) for i, t in enumerate(texts)], "doc bigint, text string, batch int")
    index = SpanIndex(spark, SPAN, GRAM, fanout=2)
    index.add_batches(df, "batch", 5)
    shared = index.shared(df.drop("batch"))
    index.close()
    assert {tuple(r) for r in shared.pairs().collect()} == truth(texts)[0]
