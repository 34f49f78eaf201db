"""Filling containers of fixed capacity with items, with little room left unused.

Items are hashed into blocks of bounded size and every block is packed by bin completion in its own task. What a
block cannot pack tightly goes on to a further round, mixed anew in blocks of the same size. After a fixed number
of rounds, or one that closes nothing, containers stay as they are: then it is the sizes that leave room.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.session import shared_dir

#: Tokens of a container; items packed by one task, at every size of the corpus; room (a fraction of the capacity) from
#: which a container is opened again in the next round; rounds.
CAPACITY, BLOCK, LOOSE, ROUNDS = 2048, 4096, 1 / 64, 4
#: Steps of one listing of fillings, and listings for each container of the block: what branch and bound spends, not what
#: it packs. Beyond them the incumbent stands; the README has how often that is so, and the gap to the lower bound.
FILL_STEPS, SEARCH_STEPS = 1000, 2


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: each size goes where the least room is left. The first incumbent of the search."""
    rooms: list[tuple[int, int]] = []
    bins: list[list[int]] = []
    for size in sorted(sizes, reverse=True):
        at = bisect_left(rooms, (size, -1))
        if at == len(rooms):
            bins.append([size])
            insort(rooms, (capacity - size, len(bins) - 1))
        else:
            room, b = rooms.pop(at)
            bins[b].append(size)
            insort(rooms, (room - size, b))
    return bins


def lower_bound(sizes: list[int], capacity: int) -> int:
    """Containers that any packing needs (Martello and Toth's second bound).

    For every size k: items over half a container lie alone among such, and those of k or more that are at most
    half fit only beside the big ones that leave k or more.
    """
    rising = sorted(sizes)
    sums = list(accumulate(rising, initial=0))
    half, n = bisect_right(rising, capacity // 2), len(rising)
    best = max(-(-sums[n] // capacity), n - half)
    for i in range(half):
        if i == 0 or rising[i] != rising[i - 1]:
            beside = bisect_right(rising, capacity - rising[i])  # the big ones before leave room for this size
            room = max(beside - half, 0) * capacity - (sums[max(beside, half)] - sums[half])
            best = max(best, n - half - (-max(sums[half] - sums[i] - room, 0) // capacity))
    return best


def each_filling(left: Counter, room: int, waste: int, steps: list[int]) -> Iterator[tuple[int, ...]]:
    """Undominated ways to fill ``room`` from the sizes left, one after another: bands of rising waste, larger sizes first.

    Every maximal filling that leaves at most ``waste`` unused comes, those of equal totals included, but for the
    dominated (Martello and Toth): one in which an unused larger size could take the place of a chosen one.
    Each step is taken from ``steps[0]``; when none is left no more come.
    """
    sizes = sorted((s for s, n in left.items() if n and 0 < s <= room), reverse=True)
    tails = [0] * (len(sizes) + 1)
    for i in range(len(sizes) - 1, -1, -1):
        tails[i] = tails[i + 1] + sizes[i] * left[sizes[i]]
    rising, counts = sizes[::-1], {s: left[s] for s in sizes}

    def undominated(chosen: tuple[int, ...], free: int) -> bool:
        used = Counter(chosen)
        for y in (0, *used):  # 0: a size that could be added, so that the filling isn't maximal
            for x in rising[bisect_right(rising, y) : bisect_right(rising, y + free)]:
                if counts[x] > used[x]:
                    return False
        return True

    lowest, highest = -1, 0
    while lowest < min(waste, room):
        highest = min(highest, waste)
        # where to go on, room, what is chosen; and the next number of that size to be tried: many come first
        stack: list[tuple[int, int, tuple[int, ...], int]] = [(0, room, (), -1)]
        while stack:
            if steps[0] <= 0:
                return
            steps[0] -= 1
            i, free, chosen, n = stack.pop()
            if n < 0:
                i = max(i, len(sizes) - bisect_right(rising, free))  # sizes that still fit
                if free - min(free, tails[i]) > highest:
                    continue
                if i == len(sizes) or free == 0:
                    if free > lowest and undominated(chosen, free):
                        yield chosen
                    continue
                n = min(counts[sizes[i]], free // sizes[i])
            if n > 0:
                stack.append((i, free, chosen, n - 1))
            stack.append((i + 1, free - n * sizes[i], chosen + (sizes[i],) * n, -1))
        lowest, highest = highest, 2 * highest + 1


def fillings(left: Counter, room: int) -> list[tuple[int, ...]]:
    """The undominated ways to fill ``room`` that ``FILL_STEPS`` find, the fullest bands first."""
    return list(each_filling(left, room, room, [FILL_STEPS]))


def descent(sizes: list[int], capacity: int) -> list[list[int]]:
    """The first descent of the search, nothing cut off: around each largest size the fullest filling found."""
    left, bins = Counter(sizes), []
    for largest in sorted(left, reverse=True):
        while left[largest] > 0:
            left[largest] -= 1
            chosen = fullest(left, capacity - largest)
            left.subtract(chosen)
            bins.append([largest, *chosen])
    return bins


def fullest(left: Counter, room: int) -> tuple[int, ...]:
    """The fullest filling of ``room`` that ``FILL_STEPS`` find, larger sizes first."""
    sizes = sorted((s for s, n in left.items() if 0 < s <= room and n > 0), reverse=True)
    tails = list(accumulate((s * left[s] for s in reversed(sizes)), initial=0))[::-1]
    negative, best, way = [-s for s in sizes], -1, ()
    stack: list[tuple[int, int, tuple[int, ...]]] = [(0, room, ())]
    for _ in range(FILL_STEPS):
        if not stack or best == room:
            break
        i, free, chosen = stack.pop()
        i = max(i, bisect_left(negative, -free))  # sizes that still fit
        if room - free > best:
            best, way = room - free, chosen
        if i < len(sizes) and room - free + min(free, tails[i]) > best:
            for n in range(min(left[sizes[i]], free // sizes[i]) + 1):  # last in, first out: many come first
                stack.append((i + 1, free - n * sizes[i], chosen + (sizes[i],) * n))
    return way


def bin_completion(sizes: list[int], capacity: int) -> list[list[int]]:
    """Branch and bound over containers: each is built around the largest size left.

    A branch is cut as soon as its wasted room exceeds what a packing with one container less than the
    incumbent could waste. The incumbent starts as the better of best-fit and the first descent and is returned if setting out
    ``SEARCH_STEPS`` times for each of its containers finds no better.
    """
    incumbent = best_fit(sizes, capacity)
    if len(incumbent) > lower_bound(sizes, capacity):
        incumbent = min(incumbent, descent(sizes, capacity), key=len)
    lower, total, steps = lower_bound(sizes, capacity), sum(sizes), SEARCH_STEPS * len(incumbent)
    while len(incumbent) > lower and steps > 0:
        allowed = (len(incumbent) - 1) * capacity - total
        left, done, waste = Counter(sizes), [], 0
        stack: list[tuple[int, Iterator[tuple[int, ...]]]] = []
        better = None
        while steps > 0:
            steps -= 1
            largest = max((s for s, n in left.items() if n), default=0)
            if not largest:
                better = [list(b) for b in done]
                break
            others = left.copy()
            others[largest] -= 1
            stack.append((largest, each_filling(others, capacity - largest, allowed - waste, [FILL_STEPS])))
            while stack:
                way = next(stack[-1][1], None)
                if way is not None:
                    break
                stack.pop()
                if done:
                    last = done.pop()
                    waste -= capacity - sum(last)
                    left.update(last)
            else:
                break
            chosen = (stack[-1][0], *way)
            left.subtract(chosen)
            left += Counter()  # without sizes that are used up
            done.append(chosen)
            waste += capacity - sum(chosen)
        if better is None:
            break
        incumbent = better
    return incumbent


def pack_block(block: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Adds ``bin`` (within the block) and ``room`` (left in it) to the rows ``doc, piece, size`` of one block."""
    block = block.sort_values(["size", "doc", "piece"], ascending=[False, True, True], ignore_index=True)
    waiting: dict[int, list[int]] = {}
    for i, s in enumerate(block["size"]):
        waiting.setdefault(int(s), []).append(i)
    free = waiting.pop(0, [])
    bins = bin_completion([s for s, rows in waiting.items() for _ in rows], capacity) or ([[]] if free else [])
    where, room = [0] * len(block), [0] * len(block)
    for b, chosen in enumerate(bins):
        rest = capacity - sum(chosen)
        for s in chosen:
            i = waiting[s].pop()
            where[i], room[i] = b, rest
    for i in free:  # items without size need no room
        where[i] = len(bins) - 1
        room[i] = capacity - sum(bins[-1])
    return block.assign(bin=where, room=room)


def fill_containers(items: DataFrame, key: str, size: str, capacity: int = CAPACITY, block: int = BLOCK, rounds: int = ROUNDS) -> DataFrame:
    """``key, piece_no, start, tokens, container_id``: every item in a container, no container over ``capacity``.

    Items larger than the capacity are cut into pieces of exactly the capacity, each a container of its own,
    and a rest that is packed like any item; all others stay whole. A null size counts as 0; items of size 0
    lie in a container that is there anyway. Keys are taken as unique and without null. An empty table gives no
    rows.

    Blocks hold about ``block`` items however many there are, and there are at most ``rounds`` rounds. Only counts go
    to the driver. Each round is written to the shared folder, so a lost executor costs the blocks it held.
    """
    spark = items.sparkSession
    shared_dir(spark)
    sized = items.select(F.col(key).alias("doc"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("n"))
    pieces = sized.select(
        "doc",
        F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("n") / capacity) - 1, F.lit(0)))).alias("piece"),
        "n",
    ).select("doc", "piece", F.least(F.col("n") - F.col("piece") * capacity, F.lit(capacity)).alias("size"))
    pieces = pieces.checkpoint()
    full = pieces.where(F.col("size") == capacity).withColumn("container", F.concat_ws("-", F.lit("full"), "doc", "piece"))
    rest, packed = pieces.where(F.col("size") < capacity), [full]
    left = rest.count()
    for number in range(rounds):
        if not left:
            break
        blocks = -(-left // block)
        spread = rest.withColumn("block", F.pmod(F.xxhash64("doc", "piece", F.lit(number)), F.lit(blocks)))
        done = (
            spread.groupBy("block")
            .applyInPandas(lambda pdf: pack_block(pdf, capacity), spread.schema.simpleString()[7:-1] + ",bin:long,room:long")
            .withColumn("loose", F.col("room") > capacity * LOOSE)
            .checkpoint()
        )
        named = done.withColumn("container", F.concat_ws("-", F.lit(f"r{number}"), "block", "bin"))
        loose = 0 if blocks == 1 or number == rounds - 1 else done.where("loose").count()
        closed = named if loose in (0, left) else named.where("not loose")
        packed.append(closed.select("doc", "piece", "size", "container"))
        rest, left = done.where("loose").select("doc", "piece", "size"), 0 if loose == left else loose
    result = packed[0]
    for p in packed[1:]:
        result = result.unionByName(p)
    return result.select(
        F.col("doc").alias(key),
        F.col("piece").cast("int").alias("piece_no"),
        (F.col("piece") * capacity).alias("start"),
        F.col("size").alias("tokens"),
        F.col("container").alias("container_id"),
    )
