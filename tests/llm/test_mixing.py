import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.llm.mixing import SEARCH_STATES, best_subset, fit_subset, mix_sources


@pytest.mark.parametrize("states", [40, SEARCH_STATES])
def test_fit_is_the_best_from_below(states):
    """Against all sums of all subsets."""
    r = random.Random(2)
    unproved = 0
    for _ in range(400):
        unit = r.choice([1, 1, 6])
        counts = Counter(unit * r.randint(1, r.choice([5, 30, 90])) for _ in range(r.randint(1, 20)))
        budget = r.randint(0, sum(n * c for n, c in counts.items()) + 5)
        taken, proved = best_subset(dict(counts), budget, r.randint(0, 99), states)
        assert all(0 <= taken.get(n, 0) <= counts[n] for n in counts)
        got = sum(n * c for n, c in taken.items())
        sums = {0}
        for n, c in counts.items():
            for _ in range(c):
                sums |= {s + n for s in sums}
        best = max(s for s in sums if s <= budget)
        assert got <= best and (got == best or not proved)
        unproved += not proved
    assert unproved == 0 if states == SEARCH_STATES else unproved > 0


def test_items_taken_first_are_given_back():
    counts = {16: 1, 34: 1, 27: 4, 3: 4, 20: 2}
    assert sum(n * c for n, c in fit_subset(counts, 152, 0).items()) == 151


def test_large_budgets_are_met_exactly():
    r = random.Random(5)
    counts = Counter(int(r.lognormvariate(7, 0.7)) + 50 for _ in range(20_000))
    budget = int(sum(n * c for n, c in counts.items()) * 0.377)
    assert sum(n * c for n, c in fit_subset(dict(counts), budget, 1).items()) == budget


@pytest.fixture(scope="module")
def mixed(spark):
    r = random.Random(7)
    docs = [(i, r.choice([" Big", "big", "BIG\n", "mid ", "small", None]), "w" * r.choice([0, 3, 17, r.randint(1, 60)]), 9) for i in range(800)] + [(900, "big", None, 9)]
    targets = [(1, "big", 0.5, 1), (1, "mid", 0.3, 4), (1, "small", 0.1, 2), (1, "absent", 0.1, 3), (2, "small", 0.9, 2), (2, "mid", 0.1, 1), (3, "absent", 1.0, 1)]
    d = spark.createDataFrame(docs, "id bigint, source string, text string, copies int")
    t = spark.createDataFrame(targets, "mix_id bigint, source string, target_share double, max_repeats int")
    return docs, d, t


@pytest.mark.parametrize("limit", [1_000_000, 6])
def test_mixture(mixed, limit):
    docs, d, t = mixed
    m = mix_sources(d, "id", "source", F.octet_length("text"), t, seed=3, rows_per_bucket=limit)
    size = {i: len(x or "") for i, _, x, _ in docs}
    of = {i: s.strip().lower() for i, s, _, _ in docs if s}
    available = Counter()
    for i, s in of.items():
        available[s] += size[i]
    shares = {(r.mix_id, r.source): r for r in m.shares.collect()}
    chosen = m.chosen.collect()
    reached = Counter()
    for c in chosen:
        assert c.source == of[c.id] and 1 <= c.copies <= shares[c.mix_id, c.source].max_repeats
        reached[c.mix_id, c.source] += c.copies * size[c.id]
    assert len({(c.mix_id, c.id) for c in chosen}) == len(chosen)
    for key, r in shares.items():
        assert r.reached == reached[key] and r.available == available[r.source]
        assert r.falls_short == (r.available * r.max_repeats < r.target_share * r.mix_tokens)
        want = min(r.budget, r.available * r.max_repeats)
        assert r.reached <= want + 1e-9 and r.reached >= want - 60
    assert shares[1, "absent"].falls_short and not shares[3, "absent"].falls_short
    again = mix_sources(d.repartition(7), "id", "source", F.octet_length("text"), t, seed=3).chosen.collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, chosen))


def test_nothing_to_mix(mixed):
    _, d, t = mixed
    m = mix_sources(d.limit(0), "id", "source", F.octet_length("text"), t)
    assert m.chosen.count() == 0 and m.shares.where("reached > 0").count() == 0 and m.shares.count() == 7
    assert mix_sources(d, "id", "source", F.octet_length("text"), t.limit(0)).shares.count() == 0
