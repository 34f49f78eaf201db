import random
from collections import Counter

from codequarry.llm.packing import best_fit, bin_completion, fill_containers, fillings, lower_bound
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F


def optimum(sizes, capacity):
    """Fewest containers, by trying all ways."""
    best = len(sizes)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for k in range(len(rooms)):
            if rooms[k] >= sizes[i]:
                go(i + 1, rooms[:k] + [rooms[k] - sizes[i]] + rooms[k + 1 :])
        go(i + 1, [*rooms, capacity - sizes[i]])

    go(0, [])
    return best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=9))
def test_optimal_on_small_cases(sizes):
    bins = bin_completion(sizes, 20)
    assert Counter(s for b in bins for s in b) == Counter(sizes) and all(sum(b) <= 20 for b in bins)
    assert len(bins) == (optimum(sorted(sizes, reverse=True), 20) if sizes else 0)


def test_fillings_are_full_and_undominated():
    ways = fillings(Counter({7: 1, 6: 2, 5: 1, 3: 3}), 13)
    assert sum(ways[0]) == 13 and all(sum(w) <= 13 for w in ways)


def test_close_to_the_bound_on_many_sizes():
    r = random.Random(5)
    sizes = [min(2047, int(r.lognormvariate(5, 1)) + 1) for _ in range(3000)]
    assert len(bin_completion(sizes, 2048)) <= lower_bound(sizes, 2048) + 1 <= len(best_fit(sizes, 2048)) + 1


def test_whole_table(spark):
    r = random.Random(2)
    rows = [(f"d{i}", r.choice([0, None, 1, 7, 40, 64, 65, 200, r.randrange(1, 300)]), "clash") for i in range(900)]
    got = fill_containers(spark.createDataFrame(rows, "id string, n int, container_id string"), "id", "n", capacity=64, block=128)
    out = got.collect()
    per = Counter()
    for x in out:
        per[x.container_id] += x.tokens
    assert max(per.values()) <= 64
    pieces = {}
    for x in out:
        pieces.setdefault(x.id, []).append((x.piece_no, x.start, x.tokens))
    for i, n, _ in rows:
        ps = sorted(pieces[i])
        assert sum(p[2] for p in ps) == (n or 0) and len(ps) == max(1, -(-(n or 0) // 64)) and all(s == k * 64 for k, s, _ in ps)
    total = sum(n or 0 for _, n, _ in rows)
    assert len(per) <= -(-total // 64) * 1.02 + 2


def test_empty_table(spark):
    assert fill_containers(spark.createDataFrame([], "id string, n int"), "id", "n").count() == 0


def test_all_empty_items_share_a_container(spark):
    got = fill_containers(spark.range(5).select("id", F.lit(0).alias("n")), "id", "n")
    assert got.count() == 5 and got.select("container_id").distinct().count() == 1


def test_alternatives_to_a_perfect_filling():
    sizes = [46, 45, 41, 39, 34, 30, 24, 21, 20]
    bins = bin_completion(sizes, 100)
    assert Counter(s for b in bins for s in b) == Counter(sizes) and all(sum(b) <= 100 for b in bins)
    assert len(best_fit(sizes, 100)) == 4 and len(bins) == 3


def test_fillings_of_equal_totals_come():
    ways = fillings(Counter({45: 1, 41: 1, 39: 1, 34: 1, 30: 1, 24: 1, 21: 1, 20: 1}), 54)
    assert {(34, 20), (30, 24)} <= set(ways)


def test_sizes_that_do_not_pair_stay_in_blocks_of_the_same_size(spark):
    """Nothing closes: one round, and no task gets more than its block."""
    rows = spark.range(1200).select("id", F.lit(55).alias("n"))
    got = fill_containers(rows, "id", "n", capacity=100, block=128).collect()
    blocks = Counter(x.container_id.rsplit("-", 1)[0] for x in got)
    assert len({x.container_id for x in got}) == 1200 and len(blocks) == 10 and max(blocks.values()) < 200


def test_bounds_and_hard_sizes():
    r = random.Random(7)
    assert lower_bound([60, 60, 50, 50, 50], 100) == 4 and lower_bound([], 100) == 0
    for low, high, gap in ((500, 1300, 1.03), (300, 700, 1.02), (1045, 2007, 1.0)):
        sizes = [r.randint(low, high) for _ in range(2000)]
        bins = bin_completion(sizes, 2048)
        assert Counter(s for b in bins for s in b) == Counter(sizes) and all(sum(b) <= 2048 for b in bins)
        assert len(bins) <= lower_bound(sizes, 2048) * gap and len(bins) <= len(best_fit(sizes, 2048))
