"""Retrieval where every query has words that most documents have."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.operators import evidence
from tidemark.plans.staging import measured_parts

N = 400


@pytest.fixture(scope="module")
def corpus(spark):
    docs = [(i, "flood walls of " * (1 + i % 3) + f"place{i % 40} code{i % 80} " + "near water levels " * (i % 7)) for i in range(N)]
    asked = [(i, f"Flood walls in place{i % 40} (code{i % 80})") for i in range(0, N, 2)]
    return spark.createDataFrame(docs, "id int, text string").repartition(4), spark.createDataFrame(asked, "q int, question string")


def shuffled(spark, run) -> int:
    """Rows that the stages of `run` write to shuffles."""
    sc = spark.sparkContext
    store, doubles = sc._jsc.sc().statusStore(), sc._gateway.new_array(sc._jvm.double, 0)

    def written() -> int:
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        stages = store.stageList(None, False, False, doubles, sc._jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = written()
    run()
    return written() - before


def test_evidence_ids_shuffles_no_pairs(spark, corpus):
    docs, asked = corpus
    rows = []
    moved = shuffled(spark, lambda: rows.extend(evidence.evidence_rows(evidence.bm25(docs, "id", "text", asked, "q", "question"), docs, "q", "id", "text").collect()))
    assert len(rows) == 5 * N // 2 and moved < N * N // 8  # of N x N / 2 pairs with a word in common


def test_gate_shuffles_no_pairs(spark, corpus):
    docs, asked = corpus
    rows = []
    moved = shuffled(spark, lambda: rows.extend(evidence.gated(evidence.bm25(docs, "id", "text", asked, "q", "question"), "q").groupBy("q").count().collect()))
    assert {r["count"] for r in rows} == {5} and len(rows) == N // 2 and moved < N * N // 8


@pytest.mark.parametrize("memory", [64 << 20, 4096])
def test_bm25_shuffles_no_pairs_and_loses_none(spark, corpus, memory, monkeypatch):
    """Against all pairs; also with a key whose texts have two lengths, and with queries broadcast in parts."""
    docs, asked = corpus
    docs = docs.unionByName(spark.createDataFrame([(7, "code7 flood flood walls")], docs.schema))
    asked = asked.unionByName(spark.createDataFrame([(1, "walls flood walls"), (3, "code7"), (5, "unicorn")], asked.schema))
    monkeypatch.setattr(evidence, "measured_parts", lambda df, by, name: measured_parts(df, by, name, memory))
    found = []
    moved = shuffled(spark, lambda: found.extend(evidence.bm25(docs, "id", "text", asked, "q", "question").collect()))
    texts = [(r.id, Counter(r.t)) for r in docs.select("id", evidence.tokens(F.col("text")).alias("t")).collect()]
    mean, df = sum(t.total() for _, t in texts) / len(texts), Counter(w for _, t in texts for w in t)
    expected = {}
    for r in asked.select("q", evidence.tokens(F.col("question")).alias("t")).collect():
        scores = Counter()
        for i, t in texts:
            for w, times in Counter(r.t).items():
                if t[w]:
                    scores[i] += times * math.log(1 + (len(texts) - df[w] + 0.5) / (df[w] + 0.5)) * t[w] * 2.5 / (t[w] + 1.5 * (0.25 + 0.75 * t.total() / mean))
        for rank, (s, i) in enumerate(sorted((-round(s, 9), i) for i, s in scores.items())[:5], 1):
            expected[r.q, rank] = i, pytest.approx(-s, abs=1e-8)
    assert {(r.q, r["rank"]): (r.id, r.score) for r in found} == expected
    assert moved < N * N // 8
