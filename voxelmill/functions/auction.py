"""Matchings of most weight as an auction in rounds over tables, for graphs that no task holds."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelmill.functions.tables import Tables

#: Arcs of the bidders in one task, about; a bidder's own arcs stay together.
BLOCK_ARCS = 500_000
#: Steps from nodes without an object to whom they compete with, when these are gathered in one task.
HOPS = 3
#: Divisor of the bids' least raise from one phase to the next.
FINER = 8


def _auction(raise_: int):
    """Bids of one block of nodes until each holds an object, as far as the block can see.

    A node bids on its best object so much that it is no worse off than with its second best. Prices
    that other blocks have raised meanwhile only make bids too low, never wrong. A node that would
    rather hold another object by more than the raise gives its object up first.
    """

    def run(arcs: pd.DataFrame, seats: pd.DataFrame) -> pd.DataFrame:
        price = dict(zip(seats["o"].tolist(), seats["price"].tolist(), strict=True))
        holder = {o: p for o, p in zip(seats["o"].tolist(), seats["p"].tolist(), strict=True) if p >= 0}
        own: dict[int, list[tuple[int, int]]] = {}
        for p, o, w in zip(arcs["p"].tolist(), arcs["o"].tolist(), arcs["w"].tolist(), strict=True):
            own.setdefault(p, []).append((o, w))
        seated = {p: o for o, p in holder.items() if p in own}
        changed: dict[int, int] = {}
        waiting = []
        for p, choices in own.items():
            if p in seated:
                if dict(choices)[seated[p]] - price[seated[p]] >= max(w - price[o] for o, w in choices) - raise_:
                    continue
                del holder[seated[p]]
                changed[seated[p]] = -1
            waiting.append(p)
        heapq.heapify(waiting)
        while waiting:
            p = heapq.heappop(waiting)
            best = second = None
            at = -1
            for o, w in own[p]:
                value = w - price[o]
                if best is None or value > best:
                    best, second, at = value, best, o
                elif second is None or value > second:
                    second = value
            price[at] += best - (best if second is None else second) + raise_
            before = holder.get(at)
            holder[at] = changed[at] = p
            if before is not None and before in own:
                heapq.heappush(waiting, before)
        return pd.DataFrame({"o": list(changed), "p": list(changed.values()), "price": [price[o] for o in changed]}, dtype="int64")

    return run


def _gathered(arcs: DataFrame, state: DataFrame, block_arcs: int, tables: Tables) -> DataFrame | None:
    """Arcs of the nodes without an object and of the nodes they compete with, if one task may hold them.

    These are who holds what the former may want, and so on for as many steps as fit.
    """
    held = state.where("p >= 0").select("p", F.col("o").alias("seat"))
    free = arcs.select("p").distinct().join(held, "p", "left_anti")
    active = tables.keep(free.withColumn("step", F.lit(0)))
    out = None
    for step in range(1, HOPS + 1):
        own = arcs.join(active.select("p"), "p")
        if own.count() > block_arcs:
            break
        out = own
        if step == HOPS:
            break
        rivals = own.select(F.col("o").alias("seat")).distinct().join(held, "seat").select("p", F.lit(step).alias("step"))
        active = tables.keep(active.unionByName(rivals).groupBy("p").agg(F.min("step").alias("step")))
    return out


def heaviest_matching(edges: DataFrame, tables: Tables, block_arcs: int = BLOCK_ARCS) -> DataFrame:
    """``i, j``: a matching of the greatest total weight over ``edges(i, j, weight)``, weights whole and positive.

    Every node of either side is a bidder and an object: it may hold a neighbour or itself, which
    weighs nothing. So a full assignment always exists, and where it pairs an i with a j it is
    an optimal matching (both directions weigh the same). Bidders are dealt to blocks near their best
    neighbours. In a round each block settles its own bidders against the prices it was told
    (Bertsekas and Castanon, 1991: bids may be outdated); an object goes to its highest bid, and whoever
    loses bids again. Once the losers and their rivals fit one block, these are settled together.
    Phases go on with smaller raises from the prices so far; weights are multiplied by more than the
    number of nodes, so with raises of 1 the last phase is exact. Prices stay whole
    numbers within a long for a million nodes with weights up to two million.
    """
    edges = tables.keep(edges.groupBy("i", "j").agg(F.max("weight").alias("w")))
    sides = [edges.select((F.col("i") * 2).alias("p"), (F.col("j") * 2 + 1).alias("o"), "w")]
    sides.append(sides[0].select(F.col("o").alias("p"), F.col("p").alias("o"), "w"))
    both = sides[0].unionByName(sides[1])
    nodes = both.select("p").distinct()
    n, top = nodes.count(), edges.agg(F.max("w")).first()[0]
    if not n:
        return edges.select("i", "j")
    total = 2 * edges.count() + n
    blocks = max(1, -(-total // block_arcs))
    # a node's home is its best neighbour on the j side, unless too many nodes have the same
    home = both.groupBy("p").agg(F.max_by("o", F.struct("w", "o")).alias("best"), F.count("*").alias("arcs"))
    home = home.withColumn("home", F.when(F.col("p") % 2 == 0, F.col("best")).otherwise(F.col("p")))
    crowded = home.groupBy("home").agg(F.sum("arcs").alias("all")).where(F.col("all") > block_arcs / 4)
    home = home.join(crowded, "home", "left").select("p", F.pmod(F.xxhash64(F.when(F.col("all").isNull(), F.col("home")).otherwise(F.col("p"))), F.lit(blocks)).alias("block"))
    arcs = both.unionByName(nodes.select("p", F.col("p").alias("o"), F.lit(0).cast("long").alias("w")))
    arcs = tables.keep(arcs.join(home, "p").select("block", "p", "o", (F.col("w") * (n + 1)).alias("w")))
    told = tables.keep(arcs.select(F.col("block").alias("at"), F.col("o").alias("seat")).distinct())
    state = tables.keep(nodes.select(F.col("p").alias("o"), F.lit(0).cast("long").alias("price"), F.lit(-1).cast("long").alias("p")))
    raises = [1]
    while raises[-1] * FINER * 4 < top * (n + 1):
        raises.append(raises[-1] * FINER)
    for raise_ in reversed(raises):
        few = None  # a phase begins with all blocks, which also give up what no longer suits
        while True:
            bidders = arcs if few is None else few.withColumn("block", F.lit(0).cast("long"))
            seats = told if few is None else bidders.select(F.col("block").alias("at"), F.col("o").alias("seat")).distinct()
            seats = seats.join(state, F.col("seat") == F.col("o")).select("at", "o", "price", "p")
            bids = bidders.groupBy("block").cogroup(seats.groupBy("at")).applyInPandas(_auction(raise_), "o long, p long, price long")
            won = bids.groupBy("o").agg(F.max_by(F.struct("price", "p"), F.struct("price", -F.col("p"))).alias("won"))
            after = state.join(won, "o", "left").select("o", F.coalesce("won.price", "price").alias("price"), F.coalesce("won.p", "p").alias("p"))
            before, state = state, tables.keep(after)
            tables.drop(before)
            if not state.where("p < 0").limit(1).count():
                break
            few = _gathered(arcs, state, block_arcs, tables)
    return state.where("p % 2 = 0 and o % 2 = 1").select((F.col("p") / 2).cast("long").alias("i"), ((F.col("o") - 1) / 2).cast("long").alias("j"))
