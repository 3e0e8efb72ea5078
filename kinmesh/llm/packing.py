"""Problem 9: containers of fixed capacity filled with whole items.

Items longer than the capacity give full containers of their own and one remainder; everything else is packed whole. Items
are spread at random over blocks of about BLOCK items, and each block is packed by bin completion: the largest item left is
placed, all undominated fillings of the rest of its container are enumerated lazily in order of waste (the sums that the
items left can make are known, so no step is in vain), a branch is cut when the waste so far can no longer beat the
incumbent, and best-fit-decreasing gives the first incumbent. A block's search is bounded by NODES, or by what DESCENTS
whole packings take if that is more; when they are used up the best packing so far stands, so the bound affects waste, never
which items are packed. search() tells whether a block ended so.

Scale: the number of blocks grows with the items, every task holds one block, and a block wastes at most about one container
in BLOCK items. Defined edge cases: items of size null count as 0; items of size 0 take no room and join the first container
of their block; an empty table gives an empty result; repeated keys are packed once each.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY, BLOCK, NODES, DESCENTS = 2048, 4000, 20_000, 4


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit-decreasing: each size into the fullest container that still has room."""
    room: dict[int, list[list[int]]] = {}
    out: list[list[int]] = []
    for s in sorted(sizes, reverse=True):
        at = next((r for r in range(s, capacity + 1) if room.get(r)), None)
        if at is None:
            box: list[int] = []
            out.append(box)
            left = capacity
        else:
            box, left = room[at].pop(), at
        box.append(s)
        room.setdefault(left - s, []).append(box)
    return out


def _covers(big: tuple[int, ...], small: tuple[int, ...]) -> bool:
    """Whether the items of `small` fit into rooms of the sizes of `big`, so that filling `big` is never worse."""
    if len(big) > len(small) or len(small) > 5:
        return False
    rooms = list(big)

    def place(k: int) -> bool:
        if k == len(small):
            return True
        for i, r in enumerate(rooms):
            if r >= small[k]:
                rooms[i] -= small[k]
                if place(k + 1):
                    return True
                rooms[i] += small[k]
        return False

    return place(0)


def _sums(left: Counter, order: list[int], room: int) -> list[int]:
    """For each place in order, the sums up to room that the sizes from there on can make, as bits."""
    out = [1] * (len(order) + 1)
    mask = (1 << (room + 1)) - 1
    for k in range(len(order) - 1, -1, -1):
        bits, n, step = out[k + 1], min(left[order[k]], room // order[k]), 1
        while n > 0:
            bits |= bits << (order[k] * min(step, n))
            n, step = n - step, step * 2
        out[k] = bits & mask
    return out


def fillings(left: Counter, order: list[int], room: int, waste: int, nodes: list[int]) -> Iterator[tuple[int, tuple[int, ...]]]:
    """(waste, sizes) of every undominated filling of `room`, least waste first, none that wastes more than `waste`."""
    order = [s for s in order if s <= room]
    can = _sums(left, order, room)

    def made(k: int, target: int, chosen: tuple[int, ...]) -> Iterator[tuple[int, ...]]:
        nodes[0] -= 1
        while target and nodes[0] > 0:
            s = order[k]
            k += 1
            for n in range(min(left[s], target // s), 0, -1):
                if can[k] >> (target - n * s) & 1:
                    yield from made(k, target - n * s, (*chosen, *[s] * n))
            if not can[k] >> target & 1:
                return
        if not target:
            yield chosen

    kept: list[tuple[int, ...]] = []
    for over in range(min(waste, room) + 1):
        if nodes[0] <= 0:
            return
        if can[0] >> (room - over) & 1:
            for f in made(0, room - over, ()):
                # what still fits makes a filling of less waste
                more = any(s <= over and left[s] > f.count(s) for s in reversed(order))
                if not more and not any(_covers(g, f) for g in kept):
                    kept.append(f)
                    yield over, f


def least_containers(sizes: list[int], capacity: int) -> int:
    """A bound from below: by volume, by sizes of more than half, by how many of the smallest fit into one container."""
    fit, room = 0, capacity
    for s in sorted(sizes):
        room -= s
        if room < 0:
            break
        fit += 1
    return max(-(-sum(sizes) // capacity), sum(s * 2 > capacity for s in sizes), -(-len(sizes) // max(fit, 1)))


def search(sizes: list[int], capacity: int = CAPACITY, nodes: int = NODES) -> tuple[list[list[int]], bool]:
    """Containers as lists of sizes, and whether the budget ended the search; no size exceeds the capacity."""
    best = best_fit(sizes, capacity)
    total = sum(sizes)
    bound = least_containers(sizes, capacity)
    left, budget = Counter(sizes), [max(nodes, DESCENTS * (len(sizes) + len(best)))]
    used: list[tuple[int, ...]] = []
    stack: list[tuple[int, Iterator[tuple[int, tuple[int, ...]]]]] = []
    waste = 0
    # depth first without recursion: a level holds the largest size left and the fillings still to be tried with it
    down = True
    while len(best) > bound and budget[0] > 0:
        if down:
            budget[0] -= 1
            order = sorted((s for s, n in left.items() if n), reverse=True)
            top, options = 0, iter(())
            if order:
                top = order[0]
                allowed = (len(best) - 1) * capacity - total - waste
                # its own copy, as lower levels change what is left
                rest = Counter({s: left[s] - (s == top) for s in order})
                options = fillings(rest, [s for s in order if rest[s]], capacity - top, allowed, budget)
            elif len(used) < len(best):
                best = [list(u) for u in used]
            stack.append((top, options))
        top, options = stack[-1]
        # the incumbent may have become better since the level began
        over, rest_of = next(options, (0, None))
        if rest_of is not None and over <= (len(best) - 1) * capacity - total - waste:
            take = (top, *rest_of)
            left.subtract(take)
            used.append(take)
            waste += over
            down = True
        else:
            stack.pop()
            if not stack:
                break
            last = used.pop()
            left.update(last)
            waste -= capacity - sum(last)
            down = False
    return best, len(best) > bound and budget[0] <= 0


def bin_completion(sizes: list[int], capacity: int = CAPACITY, nodes: int = NODES) -> list[list[int]]:
    """Containers as lists of sizes; no size exceeds the capacity."""
    return search(sizes, capacity, nodes)[0]


def _packer(capacity: int, nodes: int):
    def pack_block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "key", "part"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        rows: dict[int, list[int]] = {}
        for i, s in enumerate(pdf["size"]):
            rows.setdefault(int(s), []).append(i)
        box_of = [0] * len(pdf)
        for n, box in enumerate(bin_completion([int(s) for s in pdf["size"] if s > 0], capacity, nodes)):
            for s in box:
                box_of[rows[s].pop()] = n
        block = int(pdf.block.iloc[0])
        return pd.DataFrame({"key": pdf["key"], "part": pdf.part, "tokens": pdf["size"], "container": [f"b{block}-{n}" for n in box_of]})

    return pack_block


def pack(items: DataFrame, capacity: int = CAPACITY, block: int = BLOCK, nodes: int = NODES) -> DataFrame:
    """(key, part, tokens, container) from (key bigint, tokens): part counts the pieces of an item beyond the capacity."""
    items = items.select("key", F.coalesce("tokens", F.lit(0)).cast("bigint").alias("tokens"), F.monotonically_increasing_id().alias("row"))
    blocks = max(1, -(-items.count() // block))
    full = F.floor(F.col("tokens") / capacity).cast("int")
    pieces = items.withColumn("full", full).withColumn("rest", F.col("tokens") - F.col("full") * capacity)
    alone = pieces.where("full > 0").select("key", F.explode(F.sequence(F.lit(0), F.col("full") - 1)).alias("part"), F.lit(capacity).cast("bigint").alias("tokens"))
    alone = alone.withColumn("container", F.concat_ws("-", F.lit("f"), "key", "part"))
    rest = pieces.where("rest > 0 or full = 0").select("key", F.col("full").alias("part"), F.col("rest").alias("size"), F.pmod(F.xxhash64("row"), F.lit(blocks)).alias("block"))
    packed = rest.groupBy("block").applyInPandas(_packer(capacity, nodes), "key bigint, part int, tokens bigint, container string")
    return alone.unionByName(packed)
