"""The partition join against all pairs, and the work that groups of near copies cost."""

import random

import numpy as np
import pytest

from hearthlog.llm import linking, near_dup, set_join
from hearthlog.llm.tokens import mix
from tests.llm.test_near_dup import near_copies, words


def plain_classes(rows, k, threshold):
    sets = []
    for _, text in rows:
        w = words(text)
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set()))
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and None not in (rows[i][0], rows[j][0]):
                both = len(sets[i] & sets[j])
                if 100 * both >= threshold * (len(sets[i]) + len(sets[j]) - both):
                    label[root(i)] = root(j)
    smallest = {}
    for i, (id_, _) in enumerate(rows):
        if id_ is not None:
            smallest[root(i)] = min(smallest.get(root(i), id_), id_)
    return [(id_, len(sets[i]), smallest[root(i)] if id_ is not None and sets[i] else id_) for i, (id_, _) in enumerate(rows)]


@pytest.mark.parametrize("threshold", [60, 85])
def test_classes_match_all_pairs(spark, threshold):
    rng = random.Random(threshold)
    texts = []
    for length in (8, 11, 14, 30, 60, 200):
        texts += near_copies(rng, 14, length, 3)
        # Copies that are longer or shorter by a few words.
        texts += [" ".join(t.split()[: -rng.randrange(1, 5)]) for t in texts[-6:]]
    texts += [None, "", " \n", "one", "ONE", "one two", "one  TWO", "one two three four five", "solo words here too " * 4000]
    rows = [(i * 3 % 211, t) for i, t in enumerate(texts)]
    rows += [rows[3], (rows[4][0], "other text under the same id"), (None, texts[0]), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS node", "2 AS bucket", "3 AS side", "4 AS id")
    got = set_join.classes(df, threshold=threshold).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, plain_classes(rows, 4, threshold)))
    assert set_join.classes(df.limit(0)).collect() == []


def meeting(s, l, both):
    """The group that answers for two sizes: their band, or the border between them."""
    (group,) = [g for g in both if (g % 2 == 0) == (s.bit_length() == l.bit_length())]
    return group


@pytest.mark.parametrize("threshold", [50, 80, 85, 95])
@pytest.mark.parametrize("count", [1, 10**4, 10**9])
def test_linked_sets_gain_enough(threshold, count):
    """Every pair at the threshold shares enough allotments, whatever plan the costs choose."""
    rng = np.random.default_rng(threshold)
    planner = set_join.Planner(threshold, {c: count for c in range(120)})
    for _ in range(400):
        size = int(rng.integers(1, 300))
        pool = mix(rng.integers(0, 1 << 62, 2 * size, dtype=np.uint64))
        x, y = pool[:size], pool[:size]
        # Move as far apart as the threshold allows: drop elements from either, add others.
        for k in range(size):
            u, v = (x[1:], y) if rng.random() < 0.5 else (x, np.append(y, pool[size + k]))
            both = len(np.intersect1d(u, v))
            if 100 * both < threshold * (len(u) + len(v) - both) or not both:
                break
            x, y = u, v
        x, y = np.sort(x), np.sort(y)
        if len(x) == len(y) and (x == y).all():
            continue
        groups = set(set_join.groups_of(len(x), threshold)) & set(set_join.groups_of(len(y), threshold))
        k = meeting(len(x), len(y), groups)
        total = set_join.extent(k, threshold)[2] + 1
        forced = [set_join.Plan(total + q - w, w, q) for q in (0, 3) for w in (1, total // 2, (total + q) // 2)]
        for plan in (planner.plan(k), *forced):
            a, b = (set_join.signatures(s, k, plan) for s in (x, y))
            gain = np.where((np.arange(len(a)) >= plan.wide) & (np.arange(len(a)) < plan.segments), 1, 2)
            assert int(gain[np.isin(a, b)].sum()) >= plan.slack + 1


def test_costs_choose_deletions_for_many_small_sets():
    plans = lambda n: [set_join.Planner(85, {c: n for c in range(120)}).plan(g) for g in range(4, 12)]
    assert all(p.wide == 0 for p in plans(0)) and any(p.wide for p in plans(10**8))


@pytest.mark.parametrize("threshold", [50, 80, 85, 99])
def test_groups_hold_all_partners(threshold):
    for size in range(1, 2000):
        own = set(set_join.groups_of(size, threshold))
        for other in {size, size + 1, 100 * size // threshold, (size + 100 * size // threshold) // 2}:
            if other * threshold <= 100 * size:
                both = own & set(set_join.groups_of(other, threshold))
                assert both
                for g in own:
                    first, last, _ = set_join.extent(g, threshold)
                    assert first <= size <= last
                # The largest difference such a pair can have is within that of the group they are to meet in.
                differ = (100 - threshold) * (size + other) // (100 + threshold)
                assert set_join.extent(meeting(size, other, both), threshold)[2] >= differ


@pytest.mark.parametrize("module", [near_dup, set_join])
def test_a_large_group_of_near_copies_costs_rows_in_proportion(spark, monkeypatch, module):
    """Two thousand near copies: pairs tried stay a small multiple of the copies."""
    rng = random.Random(2)
    base = [f"w{rng.randrange(3000)}" for _ in range(300)]
    texts = []
    for _ in range(2000):
        copy = base[:]
        for _ in range(rng.randrange(3)):
            copy[rng.randrange(300)] = f"w{rng.randrange(3000)}"
        texts.append(" ".join(copy))
    tried, plain = [], linking._confirmed

    def counted(pairs, sets, threshold):
        tried.append(pairs.count())
        return plain(pairs, sets, threshold)

    monkeypatch.setattr(linking, "_confirmed", counted)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.component_id for r in module.classes(df).collect()}
    assert len(found) < 10 and sum(tried) < 20 * len(set(texts))


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(3)
    for _ in range(200):
        pool = mix(rng.integers(0, 1 << 62, 3000, dtype=np.uint64))
        x, y = (np.unique(rng.choice(pool, rng.integers(1, 3000))) for _ in range(2))
        differ = len(np.setxor1d(x, y))
        assert linking.least_difference(linking.sketch(x), linking.sketch(y)) <= differ
    x = np.unique(mix(np.arange(5000, dtype=np.uint64)))
    assert linking.least_difference(linking.sketch(x), linking.sketch(x)) == 0
    # Unrelated sets are told apart whatever their size.
    for n in (10, 1000, 50_000):
        a, b = (np.unique(mix(np.arange(k, k + n, dtype=np.uint64))) for k in (0, 10**6))
        assert linking.least_difference(linking.sketch(a), linking.sketch(b)) > 0.5 * n


def test_buckets_with_equal_members_are_one(spark):
    rows = [(b, n) for b, nodes in enumerate([(1, 2), (2, 1), (1, 2, 3), (4,), (1, 3), (3, 2, 1)]) for n in nodes]
    got = linking._unlike_buckets(spark.createDataFrame(rows, "bucket long, node long")).collect()
    lists = {}
    for r in got:
        lists.setdefault(r.bucket, set()).add(r.node)
    assert lists == {0: {1, 2}, 2: {1, 2, 3}, 4: {1, 3}}
    # Two lists of two met twice each, two of three met twice.
    assert {r.node: r.weight for r in got} == {1: 4 + 6 + 2, 2: 4 + 6, 3: 6 + 2}


def test_the_bitmap_is_fetched_in_one_go(spark):
    """Jobs do not grow with the number of partitions, and every bucket is in the bitmap."""
    context, settings = spark.sparkContext, {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    buckets = [int(b) for b in mix(np.arange(300, dtype=np.uint64)).view(np.int64)]
    df = spark.createDataFrame([(b,) for b in buckets], "bucket long")
    for k, v in settings.items():
        spark.conf.set(k, v)
    context.setJobGroup("bitmap", "bitmap")
    try:
        bits = np.frombuffer(set_join._bitmap_of(df).value, dtype=np.uint8)
        jobs = context.statusTracker().getJobIdsForGroup("bitmap")
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    assert 1 <= len(jobs) < 10
    places = [b & (set_join.MAP_BITS - 1) for b in buckets]
    assert all(bits[p >> 3] >> (p & 7) & 1 for p in places) and int(np.bitwise_count(bits).sum()) == len(set(places))
