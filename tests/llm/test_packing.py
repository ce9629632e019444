import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm.packing import combinations, fill_containers, nonnegative_least_squares, plan_containers


def used(slots):
    room, given = defaultdict(int), Counter()
    places = defaultdict(list)
    for n, first, count, at, _ in slots:
        given[n] += count
        places[n].append((first, first + count))
        for c in range(at, at + count):
            room[c] += n
    return room, given, places


@pytest.mark.parametrize("capacity,sizes", [(4096, lambda r: min(4096, int(r.lognormvariate(7.2, 0.8)) + 1)), (100, lambda r: r.randint(1, 100)), (100, lambda r: r.randint(51, 100)), (64, lambda r: 64), (50, lambda r: r.randint(1, 4))])
def test_plan_places_every_item_once_and_fills_well(capacity, sizes):
    r = random.Random(3)
    histogram = Counter(sizes(r) for _ in range(6_000))
    slots, containers = plan_containers(histogram, capacity)
    room, given, places = used(slots)
    assert given == histogram and max(room.values()) <= capacity and set(room) == set(range(containers))
    for n, spans in places.items():
        assert sorted(spans)[0][0] == 0 and all(a[1] == b[0] for a, b in zip(sorted(spans), sorted(spans)[1:]))
    tokens, halves = sum(n * c for n, c in histogram.items()), sum(c for n, c in histogram.items() if 2 * n > capacity)
    assert containers <= max(tokens / capacity, halves) * 1.03 + 2


def test_nothing_to_pack():
    assert plan_containers({}, 10) == ([], 0)


def test_combinations_fill_the_window():
    got = {tuple(x) for x in combinations(6, 2, 3)}
    want = {tuple(sorted((a, b, c), reverse=True)) for a in range(7) for b in range(7) for c in range(7) if a + b + c in (5, 6)}
    assert got == want


def test_least_squares_solves_a_consistent_system():
    combos = combinations(8, 1, 2)
    x = np.array([3.0 + i for i in range(len(combos))])
    target = np.zeros(10)
    for row, n in zip(combos, x):
        for b in row[row > 0]:
            target[b] += n
    assert nonnegative_least_squares(combos, target, 2_000) == pytest.approx(x, abs=1e-3)


@pytest.mark.parametrize("limit", [1_000_000, 5])
def test_containers(spark, limit):
    r = random.Random(1)
    texts = ["x" * r.choice([0, 1, 7, 10, 25, r.randint(1, 40)]) for _ in range(300)] + [None, "é" * 5]
    df = spark.createDataFrame([(i, t, "e") for i, t in enumerate(texts)], "id bigint, text string, size string")
    got = fill_containers(df, "id", F.octet_length("text"), 10, limit, bins=10).collect()
    room, parts = Counter(), defaultdict(list)
    for g in got:
        room[g.container] += g.tokens
        parts[g.id].append(g)
    assert max(room.values()) <= 10 and set(parts) == set(range(len(texts)))
    for i, t in enumerate(texts):
        size, mine = len((t or "").encode()), sorted(parts[i], key=lambda g: g.part)
        assert sum(g.tokens for g in mine) == size and all(g.is_split == (size > 10) for g in mine) and (len(mine) == 1 or size > 10)
        assert [g.start for g in mine] == [10 * k for k in range(len(mine))] and [g.part for g in mine] == list(range(len(mine)))
    assert len({g.container for g in got if g.tokens}) <= sum(len((t or "").encode()) for t in texts) / 10 * 1.1 + 2
    assert fill_containers(df.limit(0), "id", F.octet_length("text"), 10).count() == 0
