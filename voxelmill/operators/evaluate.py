"""Scores against ground truth: optimal assignment, greedy proposals, temporal accuracy."""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelmill.functions.auction import BLOCK_ARCS, heaviest_matching
from voxelmill.functions.graph import MOST_EDGES, ROUNDS, connected, split_components, together
from voxelmill.functions.tables import Tables
from voxelmill.operators import pairs


#: Nodes of a component's smaller side up to which its edges are thinned out first.
FEW = 256
#: Cells of the cost table that one task may hold (32 MB).
MOST_CELLS = 4_000_000


def assign(cost: np.ndarray) -> np.ndarray:
    """Column of each row in an assignment of least cost (shortest augmenting paths); rows at most columns."""
    n, m = cost.shape
    u, v, of = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        of[0], j = i, 0
        least, prev, seen = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while of[j]:
            seen[j] = True
            reduced = cost[of[j] - 1] - u[of[j]] - v[1:]
            better = ~seen[1:] & (reduced < least[1:])
            least[1:][better], prev[1:][better] = reduced[better], j
            free = np.flatnonzero(~seen[1:]) + 1
            k = free[least[free].argmin()]
            step = least[k]
            u[of[seen]] += step
            v[seen] -= step
            least[~seen] -= step
            j = k
        while j:
            of[j] = of[prev[j]]
            j = prev[j]
    out = np.full(n, -1)
    for j in range(1, m + 1):
        if of[j]:
            out[of[j] - 1] = j - 1
    return out


def _matched(pdf: pd.DataFrame) -> pd.DataFrame:
    i, j = np.unique(pdf["i"]), np.unique(pdf["j"])
    cost = np.full((len(i), len(j)), 2.0)
    cost[np.searchsorted(i, pdf["i"]), np.searchsorted(j, pdf["j"])] = pdf["distance"]
    wide = cost if len(i) <= len(j) else cost.T
    rows = np.arange(len(wide))
    cols = assign(wide)
    if len(i) > len(j):
        rows, cols = cols, rows
    ok = cost[rows, cols] < 1
    return pd.DataFrame({"i": i[rows[ok]], "j": j[cols[ok]], "distance": cost[rows[ok], cols[ok]]})


def match_jaccard(
    found: DataFrame, truth: DataFrame, most: float, tables: Tables, most_cells: int = MOST_CELLS, block_arcs: int = BLOCK_ARCS
) -> DataFrame:
    """``i, j, distance``: the assignment of least total Jaccard distance, where pairs beyond ``most`` cost 2.

    It is that of ``match_least`` over the pairs within ``most``.
    """
    edges = pairs.jaccard_distance(found, truth).where((F.col("distance") <= most) & (F.col("distance") < 1))
    return match_least(edges, tables, most_cells, block_arcs)


def match_least(edges: DataFrame, tables: Tables, most_cells: int = MOST_CELLS, block_arcs: int = BLOCK_ARCS, unit: int = 1_000_000) -> DataFrame:
    """``i, j, distance``: the assignment of least total cost over ``edges(i, j, distance)``, where all other pairs cost 2.

    It falls apart into the components of the edges. Of a component with k nodes on its smaller side,
    the k cheapest edges of each of these suffice: the others can take no more than k - 1 of their ends.
    Components whose cost table has ``most_cells`` cells at most are solved in one task each; the others
    together by an auction in rounds, which holds no more than about ``block_arcs`` arcs in a task and
    takes distances in ``unit`` parts of one.
    """
    edges = tables.keep(edges)
    links = edges.select((F.col("i") * 2).alias("i"), (F.col("j") * 2 + 1).alias("j"))  # both sides in one id space
    nodes = links.select(F.col("i").alias("node")).unionByName(links.select(F.col("j").alias("node"))).distinct()
    parts = connected(links, nodes, tables)
    grouped = tables.keep(edges.join(parts, F.col("i") * 2 == F.col("node")).select("group", "i", "j", "distance"))
    sides = parts.groupBy("group").agg(F.sum((F.col("node") % 2 == 0).cast("long")).alias("n"), F.count("*").alias("all"))
    least = F.least("n", F.col("all") - F.col("n"))
    sides = tables.keep(sides.select("group", least.alias("k"), (F.col("n") == least).alias("of_i")))
    few = grouped.join(sides.where(F.col("k") <= FEW), "group").withColumn("end", F.when(F.col("of_i"), F.col("i")).otherwise(F.col("j")))
    cheapest = Window.partitionBy("group", "end").orderBy("distance", "i", "j")
    few = few.withColumn("place", F.row_number().over(cheapest)).where(F.col("place") <= FEW).where(F.col("place") <= F.col("k"))
    many = grouped.join(sides.where(F.col("k") > FEW), "group", "left_semi")
    before, grouped = grouped, tables.keep(few.select("group", "i", "j", "distance").unionByName(many))
    tables.drop(before)
    cells = grouped.groupBy("group").agg((F.countDistinct("i") * F.countDistinct("j")).alias("cells"))
    large = tables.keep(cells.where(F.col("cells") > most_cells).select("group"))
    small = grouped.join(large, "group", "left_anti").groupBy("group").applyInPandas(_matched, "i long, j long, distance double")
    if not large.limit(1).count():
        return small
    rest = grouped.join(large, "group", "left_semi")
    weight = F.round((2 - F.col("distance")) * unit).cast("long").alias("weight")
    matched = heaviest_matching(rest.select("i", "j", weight), tables, block_arcs)
    return small.unionByName(rest.join(matched, ["i", "j"]).select("i", "j", "distance"))


def scores(matches: DataFrame, found: DataFrame, truth: DataFrame) -> DataFrame:
    """One row ``tp, n_found, n_truth, precision, recall, f1``; ratios without a denominator are 0."""
    names = ("tp", "n_found", "n_truth")
    rows = None
    for k, one in enumerate((matches.select("i"), found.select("mask_id").distinct(), truth.select("mask_id").distinct())):
        part = one.select(*[F.lit(int(k == m)).alias(c) for m, c in enumerate(names)])
        rows = part if rows is None else rows.unionByName(part)
    one = rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names])

    def ratio(a, b):
        return F.when(b == 0, 0.0).otherwise(a / b)

    return one.select(
        "tp",
        "n_found",
        "n_truth",
        ratio(F.col("tp"), F.col("n_found")).alias("precision"),
        ratio(F.col("tp"), F.col("n_truth")).alias("recall"),
        ratio(2 * F.col("tp"), F.col("n_found") + F.col("n_truth")).alias("f1"),
    )


def _proposals(pdf: pd.DataFrame) -> pd.DataFrame:
    """The rounds of proposals within one component; each i passes over its edges once."""
    offers: dict[int, list] = {}
    for i, j, iou in pdf[["i", "j", "iou"]].itertuples(index=False):
        offers.setdefault(i, []).append((iou, -j))
    for own in offers.values():
        own.sort()  # the best is last
    closed, out = set(), []
    while offers:
        asked: dict[int, tuple] = {}
        for i in list(offers):
            own = offers[i]
            while own and -own[-1][1] in closed:
                own.pop()
            if not own:
                del offers[i]
                continue
            j, bid = -own[-1][1], (-own[-1][0], i)
            asked[j] = min(asked.get(j, bid), bid)
        for j, (_, i) in asked.items():
            out.append((i, j))
            closed.add(j)
            del offers[i]
    return pd.DataFrame(out, columns=["i", "j"])


def match_greedy(edges: DataFrame, tables: Tables, rounds: int = ROUNDS, most: int = MOST_EDGES) -> DataFrame:
    """``i, j``: rounds of proposals over ``edges(i, j, iou)``.

    Every free i proposes to its best open j (the lowest of equals); a j keeps its best proposer (the
    lowest of equals) and closes. Rounds end when nobody can propose. After every ``rounds`` rounds
    components with ``most`` open edges or fewer are finished, one in a task.
    """
    edges, done, k = tables.keep(edges.select("i", "j", "iou")), [], 0
    while edges.limit(1).count():
        offers = edges.groupBy("i").agg(F.min_by("j", F.struct(-F.col("iou"), "j")).alias("j"), F.max("iou").alias("iou"))
        taken = tables.keep(offers.groupBy("j").agg(F.min_by("i", F.struct(-F.col("iou"), "i")).alias("i")).select("i", "j"))
        before, edges = edges, tables.keep(edges.join(taken.select("i"), "i", "left_anti").join(taken.select("j"), "j", "left_anti"))
        tables.drop(before)
        done, k = together([*done, taken], tables), k + 1
        if k % rounds == 0 and edges.limit(1).count():
            small, large, grouped = split_components(edges, F.col("i") * 2, F.col("j") * 2 + 1, tables, most)
            done.append(tables.keep(small.groupBy("group").applyInPandas(_proposals, "i long, j long")))
            before, edges = edges, tables.keep(large)
            tables.drop(before, grouped)
    return functools.reduce(DataFrame.unionByName, done) if done else edges.select("i", "j")


def euclid_edges(found: DataFrame, truth: DataFrame, w: int, pixel_size: float, least_iou: float, most_distance: float) -> DataFrame:
    """``i, j, iou`` of pairs above an IoU whose integer centroids are nearer than a distance."""
    from voxelmill.operators.features import centroid_int

    a, b = (m.groupBy("mask_id").agg(F.sum("val").alias("area")) for m in (found, truth))
    both = pairs.overlap(found, truth)
    both = both.join(a.select(F.col("mask_id").alias("i"), F.col("area").alias("ai")), "i").join(b.select(F.col("mask_id").alias("j"), F.col("area").alias("aj")), "j")
    ratio = F.col("overlap") / (F.col("ai") + F.col("aj") - F.col("overlap"))
    ci = centroid_int(found, a.select("mask_id"), w).select(F.col("mask_id").alias("i"), F.col("com_h").alias("h1"), F.col("com_w").alias("w1"))
    cj = centroid_int(truth, b.select("mask_id"), w).select(F.col("mask_id").alias("j"), F.col("com_h").alias("h2"), F.col("com_w").alias("w2"))
    distance = F.sqrt(F.pow(F.col("h1") - F.col("h2"), 2) + F.pow(F.col("w1") - F.col("w2"), 2)) * pixel_size
    kept = both.withColumn("iou", ratio).where(F.col("iou") > least_iou).join(ci, "i").join(cj, "j")
    return kept.where(distance < most_distance).select("i", "j", "iou")


def activity_overlap(truth: DataFrame, foreground: DataFrame) -> DataFrame:
    """``neuron, t, overlap``: foreground pixels of each frame in each neuron's footprint."""
    return truth.join(foreground, "pixel").groupBy("neuron", "t").agg(F.count("*").alias("overlap"))


def temporal_accuracy(truth: DataFrame, active: DataFrame, foreground: DataFrame, times: DataFrame, on: float = 0.2, off: float = 0.8) -> DataFrame:
    """``neuron, sta``: share of frames judged right.

    A frame is right if the covered share of the footprint is at least ``on`` while active, or at
    most ``off`` while not. Frames without overlap or activity are right and need no row: only their
    number counts.
    """
    size = truth.groupBy("neuron").agg(F.count("*").alias("area"))
    total = times.select("t").distinct().count()
    seen = activity_overlap(truth, foreground).join(active.withColumn("on", F.lit(True)), ["neuron", "t"], "full")
    share = F.coalesce("overlap", F.lit(0)) / F.col("area")
    judged = seen.join(size, "neuron").withColumn("ok", F.when(F.coalesce("on", F.lit(False)), share >= on).otherwise(share <= off))
    counts = judged.groupBy("neuron").agg(F.sum((~F.col("ok")).cast("long")).alias("wrong"))
    return size.join(counts, "neuron", "left").select("neuron", ((total - F.coalesce("wrong", F.lit(0))) / F.lit(float(total))).alias("sta"))


def _numbered(rows: DataFrame, order: list, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """A sorted table with ``part`` (of the sort) and ``place`` in it, and the parts' row counts."""
    kept = tables.keep(rows.sort(*order).withColumn("_sorted", F.monotonically_increasing_id()))
    kept = kept.withColumns({"part": F.shiftright("_sorted", 33).cast("int"), "place": F.col("_sorted").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_sorted")
    return kept, kept.groupBy("part").agg(F.count("*").alias("rows"))


def in_order(rows: DataFrame, order: list, tables: Tables) -> DataFrame:
    """``rows`` with ``number``, gapless from 0 in the given order; a row's number is its place in a part of the sort plus the rows before."""
    kept, counts = _numbered(rows, order, tables)
    before, total = [], 0
    for r in counts.orderBy("part").collect():  # a row for each partition of the sort
        before.append((r["part"], total))
        total += r["rows"]
    offsets = F.broadcast(rows.sparkSession.createDataFrame(before, "part int, before long"))
    return kept.join(offsets, "part").withColumn("number", F.col("before") + F.col("place")).drop("part", "place", "before")


def running_sum(rows: DataFrame, key: str, order: list[str], value: str, tables: Tables) -> DataFrame:
    """``rows`` with ``before``: the sum of a whole-number column over the key's earlier rows, however many a key has."""
    kept, _ = _numbered(rows, [key, *order], tables)
    base = kept.groupBy(key, "part").agg(F.sum(value).alias("own"))
    earlier = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = base.select(F.col(key).alias("base_key"), F.col("part").alias("base_part"), F.coalesce(F.sum("own").over(earlier), F.lit(0)).alias("base"))
    so_far = Window.partitionBy(key, "part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    both = kept.withColumn("inside", F.coalesce(F.sum(value).over(so_far), F.lit(0)))
    both = both.join(base, F.col(key).eqNullSafe(F.col("base_key")) & (F.col("part") == F.col("base_part")))
    return both.withColumn("before", F.col("base") + F.col("inside")).drop("part", "place", "base_key", "base_part", "base", "inside")


def running_mean(rows: DataFrame, key: str, order: str, value: str, weight: str) -> DataFrame:
    """Weighted mean so far, by key. A key's rows lie in the parts of one global sort; sums of earlier parts are added."""
    product = (F.col(value) * F.col(weight)).alias("xw")
    kept, _ = _numbered(rows.select(key, order, product, F.col(weight).alias("w")), [key, order], Tables(rows.sparkSession))
    earlier = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = kept.groupBy(key, "part").agg(F.sum("xw").alias("bx"), F.sum("w").alias("bw"))
    base = base.select(key, "part", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in ("bx", "bw")])
    base = base.withColumnsRenamed({key: "base_key", "part": "base_part"})
    own = Window.partitionBy(key, "part").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    both = kept.withColumns({"sx": F.sum("xw").over(own), "sw": F.sum("w").over(own)})
    both = both.join(base, F.col(key).eqNullSafe(F.col("base_key")) & (F.col("part") == F.col("base_part")))
    return both.select(key, order, ((F.col("sx") + F.col("bx")) / (F.col("sw") + F.col("bw"))).alias("mean"))


def shards(rows: DataFrame, key: str, world: int, seed: int, tables: Tables) -> DataFrame:
    """``key, shard, place``: an epoch's seeded permutation dealt to ``world`` readers, with equal shares.

    Row k of the permutation (by the digest of key and seed) goes to shard ``k mod world``. The last
    round is filled by showing rows again from the start, over and over where there are too few.
    Numbers come from a sort and one count per partition of it.
    """
    digest = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))
    kept = in_order(rows.select(key, digest.alias("digest")), ["digest", key], tables)
    total = rows.count()
    places = F.sequence(F.col("number"), F.lit(max(-(-total // world) * world - 1, 0)).cast("long"), F.lit(max(total, 1)).cast("long"))
    numbered = kept.select(key, F.explode(places).alias("k"))
    return numbered.select(key, (F.col("k") % world).alias("shard"), F.call_function("div", "k", F.lit(world)).alias("place"))
