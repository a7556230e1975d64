"""Graph steps as joins and partial aggregates over edge tables."""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelmill.functions.tables import Tables

#: Rounds between counts of what is open, and edges of a component that one task decides.
ROUNDS, MOST_EDGES = 4, 500_000


def connected(edges: DataFrame, nodes: DataFrame, tables: Tables) -> DataFrame:
    """``node, group``: every node of ``nodes(node)`` with the least node it reaches by ``edges(i, j)``.

    Each round takes the least label among neighbours, then follows labels to their own labels, which
    halves paths. A node's neighbours are never gathered, only their minimum.
    """
    ways = (F.struct(F.col(a).alias("i"), F.col(b).alias("j")) for a, b in (("i", "j"), ("j", "i")))
    both = edges.select(F.inline(F.array(*ways)))  # a union would compute the edges twice
    both = tables.keep(both.where("i != j").distinct())
    state = tables.keep(nodes.select("node", F.col("node").alias("group")))
    while True:
        low = both.join(state.select("node", "group"), F.col("j") == F.col("node")).groupBy("i").agg(F.min("group").alias("low"))
        hooked = state.join(low, F.col("node") == F.col("i"), "left").select("node", "group", F.least("group", "low").alias("next"))
        hooked = tables.keep(hooked)
        of = hooked.select(F.col("node").alias("parent"), F.col("next").alias("grand"))
        before, state = state, tables.keep(
            hooked.join(of, F.col("next") == F.col("parent")).select("node", F.col("group").alias("old"), F.least("next", "grand").alias("group"))
        )
        tables.drop(before, hooked)
        if not state.where("group != old").limit(1).count():
            return state.select("node", "group")


def split_components(edges: DataFrame, i: Column, j: Column, tables: Tables, most: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges of components with ``most`` edges or fewer, with their ``group``; those of larger ones; and the kept table of both.

    ``i`` and ``j`` are an edge's ends in one id space. Larger components are few, as each has more edges than that.
    """
    links = edges.select(i.alias("i"), j.alias("j"))
    nodes = links.select(F.col("i").alias("node")).unionByName(links.select(F.col("j").alias("node"))).distinct()
    parts = connected(links, nodes, tables).withColumnsRenamed({"node": "_node", "group": "_group"})
    grouped = tables.keep(edges.join(parts, i == F.col("_node")).drop("_node").withColumnRenamed("_group", "group"))
    large = tables.keep(grouped.groupBy("group").count().where(F.col("count") > most).select("group"))
    small = grouped.join(F.broadcast(large), "group", "left_anti")
    return small, grouped.join(F.broadcast(large), "group", "left_semi").drop("group"), grouped


def together(parts: list[DataFrame], tables: Tables, most: int = 8) -> list[DataFrame]:
    """Kept tables as one when there are many, so that no plan grows with the rounds."""
    if len(parts) < most:
        return parts
    whole = tables.keep(functools.reduce(DataFrame.unionByName, parts))
    tables.drop(*parts)
    return [whole]


def _founders(pdf: pd.DataFrame) -> pd.DataFrame:
    """The serial loop within one component: whether a node founds a group."""
    i, j = pdf["i"].to_numpy(), pdf["j"].to_numpy()
    order = np.argsort(i, kind="stable")
    nodes = np.unique(np.concatenate([i, j]))
    i, j = np.searchsorted(nodes, i[order]), np.searchsorted(nodes, j[order])
    ends, blocked = np.searchsorted(i, np.arange(len(nodes) + 1)), np.zeros(len(nodes), bool)
    for k in range(len(nodes)):
        if not blocked[k]:
            blocked[j[ends[k] : ends[k + 1]]] = True
    return pd.DataFrame({"node": nodes, "founder": ~blocked})


def greedy_seeds(edges: DataFrame, nodes: DataFrame, tables: Tables, rounds: int = ROUNDS, most: int = MOST_EDGES) -> DataFrame:
    """``node, group``: nodes in ascending order either found a group or join the least adjacent founder.

    The founders are the lexicographically first maximal independent set, found in parallel rounds
    (Blelloch, Fineman and Shun, 2012): an open node without a lower open neighbour is a founder, and
    its open neighbours are taken. ``edges(i, j)`` may hold either direction. After every ``rounds``
    rounds the components of what is still open are counted, and those of ``most`` edges or fewer are
    decided by the serial loop, one in a task; only larger ones go on by rounds.
    """
    up = edges.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).where("i < j").distinct()
    up = tables.keep(up)
    free, live, spent, seeds, done = nodes.select("node"), up, [], [], 0
    while True:
        blocked = live.select(F.col("j").alias("node")).distinct()
        new = tables.keep(free.join(blocked, "node", "left_anti"))
        taken = live.join(new, F.col("i") == F.col("node")).select(F.col("j").alias("node")).distinct()
        free = tables.keep(free.join(new, "node", "left_anti").join(taken, "node", "left_anti"))
        seeds.append(new)
        if not free.limit(1).count():
            break
        live = tables.keep(
            live.join(free.withColumnRenamed("node", "i"), "i", "left_semi").join(free.withColumnRenamed("node", "j"), "j", "left_semi")
        )
        tables.drop(*spent)
        spent, done, seeds = [free, live], done + 1, together(seeds, tables)
        if done % rounds == 0 and live.limit(1).count():
            small, large, grouped = split_components(live, F.col("i"), F.col("j"), tables, most)
            decided = tables.keep(small.groupBy("group").applyInPandas(_founders, "node long, founder boolean"))
            seeds.append(tables.keep(decided.where("founder").select("node")))
            free, live = tables.keep(free.join(decided, "node", "left_anti")), tables.keep(large)
            tables.drop(*spent, decided, grouped)
            spent = [free, live]
            if not free.limit(1).count():
                break
    seeds = functools.reduce(DataFrame.unionByName, seeds)
    joined = up.join(seeds, F.col("i") == F.col("node")).groupBy("j").agg(F.min("i").alias("group"))
    joined = joined.join(seeds, F.col("j") == F.col("node"), "left_anti").select(F.col("j").alias("node"), "group")
    return joined.unionByName(seeds.select("node", F.col("node").alias("group")))
