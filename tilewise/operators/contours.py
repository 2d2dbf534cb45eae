"""Outlines of the parts of a pixel table, as rings of pixel corners.

A set pixel has four sides, walked clockwise (y grows downwards) with the pixel on the right. A side is on an outline if
the pixel across it isn't set, and two pixels tell which side comes next, so outlines are followed without a search. Each
square of pixels is a task's work, whatever the parts' sizes; it gets the pixels around its rim as well. Rings that lie in
one square are done there. The others fall into chains, one for each stay in a square, and chains are numbered along
their rings by doubling: a ring of n chains takes log2(n) rounds of a join. No ring is ever in one place as a whole;
what comes out of it is its length, its area and at most so many of its corners.

Pixels that touch at a corner alone are two outlines (the background is what hangs together over corners). A ring around
a part goes clockwise and has a positive area, a ring around a hole the other way round and a negative one; the areas of all
rings together are the number of pixels.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut_lineage, sized

#: Of the sides east (above the pixel), south, west and north: the way ahead, and what lies across.
AHEAD, ACROSS = ((0, 1), (1, 0), (0, -1), (-1, 0)), ((-1, 0), (0, 1), (1, 0), (0, -1))
#: Where a side of pixel (y, x) begins.
CORNER = ((0, 0), (0, 1), (1, 1), (1, 0))
SIDES = "y long, x long, side int, chain long, place long, length long, next long, doubled long"


def _name(y, x, side):
    """A side as a number, in the order of (y, x, side); coordinates within 29 bits."""
    return (((y + (1 << 28)) << 30) + (x + (1 << 28))) * 4 + side


def _follow(after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(last, steps) of each element: the end of its path and the steps to it; after: the next element, or itself at an end."""
    jump, steps = after.copy(), (after != np.arange(len(after))).astype(np.int64)
    for _ in range(max(1, len(after)).bit_length()):
        steps += steps[jump]
        jump = jump[jump]
    return jump, steps


def _outline(block: pd.DataFrame, size: int) -> pd.DataFrame:
    """SIDES of the pixels of one square (_py, _px); block: y, x of its pixels and of those around it."""
    y0, x0 = int(block["_py"].iloc[0]) * size - 1, int(block["_px"].iloc[0]) * size - 1
    grid = np.zeros((size + 2, size + 2), bool)
    grid[block["py"].to_numpy() - y0, block["px"].to_numpy() - x0] = True
    inner = np.zeros_like(grid)
    inner[1:-1, 1:-1] = grid[1:-1, 1:-1]
    parts = []
    for side in range(4):
        y, x = np.nonzero(inner)
        (ay, ax), (oy, ox) = AHEAD[side], ACROSS[side]
        open_ = ~grid[y + oy, x + ox]
        y, x = y[open_], x[open_]
        ahead, corner = grid[y + ay, x + ax], grid[y + ay + oy, x + ax + ox]
        # a pixel ahead and across: round it; ahead alone: straight on; none ahead: round this pixel
        turn = np.where(~ahead, 0, np.where(~corner, 1, 2))
        ny, nx = y + np.where(turn > 0, ay, 0) + np.where(turn == 2, oy, 0), x + np.where(turn > 0, ax, 0) + np.where(turn == 2, ox, 0)
        parts.append(np.stack([y, x, np.full(len(y), side), ny, nx, (side + np.array([1, 0, 3]))[turn] % 4]))
    y, x, side, ny, nx, nside = np.concatenate(parts, 1)
    own, other = _name(y + y0, x + x0, side), _name(ny + y0, nx + x0, nside)
    order = np.argsort(own)
    y, x, side, own, other = y[order] + y0, x[order] + x0, side[order], own[order], other[order]
    at = np.minimum(np.searchsorted(own, other), max(0, len(own) - 1))
    inside = own[at] == other if len(own) else np.zeros(0, bool)
    here = np.arange(len(own))
    after = np.where(inside, at, here)
    last, steps = _follow(after)
    # a path that doesn't end is a ring: its first side is made the end, by the smallest number met on the way round
    low, jump = here.copy(), after.copy()
    for _ in range(max(1, len(own)).bit_length()):
        low = np.minimum(low, low[jump])
        jump = jump[jump]
    ring = inside[last]
    first = ring & (low == here)
    cut = np.where(ring & first[after], here, after)
    last, steps = _follow(cut)
    # what has no side before it in this square begins a chain
    begins = first | ~np.isin(here, after[inside & ~ring])
    begins &= ~ring | first
    head = np.zeros(len(own), np.int64)
    head[last[begins]] = here[begins]
    head = head[last]
    length = steps[head] + 1
    cy, cx = y + np.array([c[0] for c in CORNER])[side], x + np.array([c[1] for c in CORNER])[side]
    ey, ex = cy + np.array([a[0] for a in AHEAD])[side], cx + np.array([a[1] for a in AHEAD])[side]
    return pd.DataFrame({"y": cy, "x": cx, "side": side.astype(np.int32), "chain": own[head], "place": length - 1 - steps, "length": length, "next": other[last], "doubled": cx * ey - ex * cy})


def _along(chains: DataFrame) -> DataFrame:
    """(chain, ring, before): the ring of each chain (its smallest chain) and the sides of the ring that lie before it, from that chain on."""
    # every chain points at the one before it; jumps double and carry the smallest chain that was passed
    state = cut_lineage(chains.select(F.col("next").alias("chain"), F.col("chain").alias("jump"), F.least("chain", "next").alias("ring")))
    while True:
        step = state.select(F.col("chain").alias("jump"), F.col("jump").alias("_jump"), F.col("ring").alias("_ring"))
        moved = cut_lineage(state.join(sized(step), "jump").select("chain", F.col("_jump").alias("jump"), F.least("ring", "_ring").alias("ring"), (F.col("_ring") < F.col("ring")).alias("lower")))
        state, lower = moved.drop("lower"), not moved.where("lower").isEmpty()
        if not lower:
            break
    named = chains.select("chain", "length", "next").join(state.select("chain", "ring"), "chain")
    # now from the ring's first chain on: what lies before, doubling until no chain has one before it that isn't counted
    before = named.where("next <> ring").select(F.col("next").alias("chain"), F.col("chain").alias("jump"), F.col("length").alias("before"))
    state = cut_lineage(named.select("chain", "ring").join(before, "chain", "left").withColumn("before", F.coalesce("before", F.lit(0))))
    while not state.where("jump is not null").isEmpty():
        step = state.select(F.col("chain").alias("jump"), F.col("jump").alias("_jump"), F.col("before").alias("_before"))
        state = cut_lineage(state.join(sized(step), "jump", "left").select("chain", "ring", F.col("_jump").alias("jump"), (F.col("before") + F.coalesce("_before", F.lit(0))).alias("before")))
    return state.select("chain", "ring", "before")


def rings(pixels: DataFrame, keys: tuple[str, ...] = (), most: int = 64, size: int = 256) -> DataFrame:
    """keys, ring, n_sides, area, n_points, points: the outlines of the set pixels (keys, py, px).

    ring: its smallest side as a number, so that it is the same however pixels are dealt out; area: in pixels, holes
    negative; points: closed, [x, y] of pixel corners from that side on, every ceil(n_sides / most)-th of them and the
    first again. Pixels that repeat count once, those with a null coordinate not at all; keys may be null.
    """
    names = {k: f"_k{i}" for i, k in enumerate(keys)}
    rows = pixels.select(*[F.col(k).alias(v) for k, v in names.items()], F.col("py").cast("long"), F.col("px").cast("long")).where("py is not null and px is not null").distinct()
    keys_ = list(names.values())
    # rim pixels go to the squares beside and across as well
    near = lambda c: F.array_distinct(F.array(*[F.floor((F.col(c) + d) / size).cast("long") for d in (-1, 0, 1)]))
    sent = rows.withColumn("_py", F.explode(near("py"))).withColumn("_px", F.explode(near("px")))
    schema = "".join(f"{k} {rows.schema[k].dataType.simpleString()}, " for k in keys_)

    def trace(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        out = _outline(block, size)
        for name, value in zip(keys_, key, strict=False):
            out.insert(0, name, pd.Series([value] * len(out), dtype=block[name].dtype))
        return out[[*keys_, *(c.split()[0] for c in SIDES.split(", "))]]

    sides = cut_lineage(sent.groupBy(*keys_, "_py", "_px").applyInPandas(trace, schema + SIDES))
    # a chain's name is unique within its keys
    chains = sides.where("place = 0").select(*keys_, "chain", "length", "next")
    whole = chains.where("next = chain").select(*keys_, "chain", F.col("chain").alias("ring"), F.lit(0).cast("long").alias("before"))
    parts = cut_lineage(chains.where("next <> chain"))
    if not parts.isEmpty():
        if keys_:
            number = cut_lineage(parts.select(*keys_, "chain").withColumn("_id", F.monotonically_increasing_id()))
            same = lambda a, b: [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys_] + [F.col(a) == F.col(b)]
            to = parts.alias("a").join(number.alias("b"), same("a.next", "b.chain")).select(*[F.col(f"a.{k}") for k in keys_], "a.chain", "a.length", F.col("b._id").alias("next"))
            to = to.alias("a").join(number.alias("b"), same("a.chain", "b.chain")).select(F.col("b._id").alias("chain"), "a.length", "a.next")
            along = _along(cut_lineage(to)).join(number.select(F.col("_id").alias("chain"), *keys_, F.col("chain").alias("_name")), "chain")
            # the numbers depend on how rows are dealt; the ring's name is set below
            along = along.select(*keys_, F.col("_name").alias("chain"), "ring", "before")
        else:
            along = _along(parts).select("chain", "ring", "before")
        whole = whole.unionByName(along)
    found = sides.alias("s").join(whole.alias("w"), [F.col(f"s.{k}").eqNullSafe(F.col(f"w.{k}")) for k in keys_] + [F.col("s.chain") == F.col("w.chain")])
    found = cut_lineage(found.select(*[F.col(f"s.{k}") for k in keys_], "w.ring", "s.y", "s.x", "s.side", "s.doubled", (F.col("w.before") + F.col("s.place")).alias("at")))
    # the side of a corner, back as a number
    offset = lambda i: F.element_at(F.array(*[F.lit(c[i]) for c in CORNER]), F.col("side") + 1)
    number = F.shiftleft(F.col("y") - offset(0) + (1 << 28), 30) * 4 + (F.col("x") - offset(1) + (1 << 28)) * 4 + F.col("side")
    sums = found.groupBy(*keys_, "ring").agg(F.min(F.struct(number.alias("name"), F.col("at"))).alias("first"), F.count("*").alias("n_sides"), (F.sum("doubled") / 2).cast("long").alias("area"))
    sums = sums.select(*keys_, F.col("ring").alias("_ring"), F.col("first.name").alias("name"), F.col("first.at").alias("start"), "n_sides", "area")
    placed = found.alias("s").join(sized(cut_lineage(sums)).alias("w"), [F.col(f"s.{k}").eqNullSafe(F.col(f"w.{k}")) for k in keys_] + [F.col("s.ring") == F.col("w._ring")])
    place = F.pmod(F.col("s.at") - F.col("w.start"), F.col("w.n_sides"))
    few = placed.withColumn("place", place).where(F.col("place") % F.ceil(F.col("n_sides") / most) == 0)
    point = F.struct("place", F.array(F.col("s.x").cast("double"), F.col("s.y").cast("double")).alias("p"))
    out = few.groupBy(*[F.col(f"s.{k}") for k in keys_], F.col("w.name").alias("ring"), "n_sides", "area").agg(F.transform(F.array_sort(F.collect_list(point)), lambda x: x["p"]).alias("open"))
    return out.select(*[F.col(v).alias(k) for k, v in names.items()], "ring", "n_sides", "area", F.size("open").alias("n_points"), F.concat("open", F.slice("open", 1, 1)).alias("points"))


def largest(found: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Of the rings of each key the longest, on a tie the first."""
    return found.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n_sides"), "ring"))).where("_rn = 1").drop("_rn")
