"""Hard negatives by threshold joins over a pruned inverted index of whole-number vectors.

A search looks for the highest products inside windows: an anchor's positives have any product with
rows of its label; each positive's negatives have products between a share of the positive's and the
positive's, with rows of other labels. A window asks for a threshold that lies high at first (the best
product in a sample) and is lowered to what is sure to suffice (the sample's k-th best, or the
window's floor) only if the window hasn't been filled.

Blocks of rows hold groups of dimensions by falling energy. Against a set of anchors, a row's trailing
groups are left out of the index where their norm can't lift a product over any threshold (L2AP,
Anastasiu and Karypis, 2014); rows whose whole norm can't aren't in it at all. Products accumulate
group by group, and a pair is dropped when the product so far and the remaining norms stay under the
anchor's threshold. What survives is computed in full, in whole numbers.

Anchors visit all blocks in passes of a bounded number of windows. Each task keeps no more than k rows
a window and raises the window's threshold as it fills, so the rows that leave tasks are few.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelmill.llm._spark import Scratch, thinned
from voxelmill.llm._vectors import best, chunked, matrix, single, usable, whole

#: Rows of the sample that first thresholds and the order of dimensions come from, about. All rows are searched.
SAMPLE = 8192
#: Windows that visit all blocks at once; their anchors are sent to every executor.
PASS = 32_768
#: Anchors whose products with a block are held at once, and pairs that are computed in full at once.
ANCHORS, PAIRS = 256, 32_768
#: Groups of dimensions, and the share of living pairs below which pairs are followed one by one.
GROUPS, SPARSE = 4, 0.05
#: Beyond all products.
FAR = 1 << 62

BLOCK = "dim int, ids binary, labels binary, q binary"
WINDOW = "anchor_id long, label long, dim int, q binary, positive_id long, positive_score long, floor long, cap long, first long, second long"
FOUND = "anchor_id long, positive_id long, positive_score long, id long, score long"


def _by_energy(x: np.ndarray, dim: int, orders: dict[int, np.ndarray]) -> np.ndarray:
    return x[:, orders[dim]] if dim in orders else x


def _blocks(orders):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, rows in chunked(batches, "vec"):
            ids, labels = (rows[c].to_numpy() for c in ("id", "label"))
            order = np.lexsort((ids, labels))
            q = _by_energy(whole(matrix(rows["vec"].combine_chunks(), dim)), dim, orders.value).astype(np.int32)
            held = [x[order].tobytes() for x in (ids, labels, q)]
            yield pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32())} | {c: pa.array([v], pa.binary()) for c, v in zip(("ids", "labels", "q"), held)})

    return run


def _anchors(orders):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, rows in chunked(batches, "vec"):
            q = _by_energy(whole(matrix(rows["vec"].combine_chunks(), dim)), dim, orders.value).astype(np.int32)
            yield pa.RecordBatch.from_pydict(
                {"anchor_id": rows["id"].combine_chunks(), "label": rows["label"].combine_chunks(), "dim": pa.array(np.full(len(q), dim, np.int32)), "q": pa.array([v.tobytes() for v in q], pa.binary())}
            )

    return run


def _safe(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether products in double precision are exact whole numbers."""
    return bool(a.size and b.size) and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2.0**53


def _levels(sample, same: bool, k: int):
    """A window's first threshold is the sample's best product inside it; its second one is the k-th best, or the floor."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            floor, cap = batch["floor"].to_numpy(), batch["cap"].to_numpy()
            first, second = floor.copy(), floor.copy()
            for dim in np.unique(batch["dim"]):
                if dim not in sample.value:
                    continue
                ids, labels, rows = sample.value[dim]
                at = np.flatnonzero(batch["dim"] == dim)
                for some in np.array_split(at, -(-len(at) // ANCHORS)):
                    x = np.frombuffer(b"".join(batch["q"].iloc[some]), np.int32).reshape(len(some), dim).astype(np.float64)
                    if not _safe(x, rows):
                        continue
                    scores = x @ rows.T
                    fits = (batch["label"].to_numpy()[some, None] == labels) == same
                    fits &= batch["anchor_id"].to_numpy()[some, None] != ids
                    fits &= (scores >= floor[some, None]) & (scores <= cap[some, None])
                    scores[~fits] = -np.inf
                    n = scores.shape[1]
                    top = np.partition(scores, [max(0, n - k), n - 1], axis=1)
                    for out, value, there in ((first, top[:, -1], True), (second, top[:, max(0, n - k)], n >= k)):
                        good = np.isfinite(value) & there
                        out[some[good]] = value[good].astype(np.int64)
            yield batch.assign(first=first, second=second)

    return run


def rests(x: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Norms of what is left of rows from each cut on; the last is 0."""
    squares = np.stack([(x[:, a:b] ** 2).sum(1) for a, b in zip(cuts, cuts[1:])], axis=1)
    return np.sqrt(np.c_[np.cumsum(squares[:, ::-1], axis=1)[:, ::-1], np.zeros(len(x))])


def survivors(a: np.ndarray, low: np.ndarray, x: np.ndarray, x_rest: np.ndarray, cuts: np.ndarray, barred: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of ``a`` and ``x`` that may reach the thresholds ``low`` of ``a``."""
    a_rest = rests(a, cuts)
    least = float(np.min(low / np.maximum(a_rest[:, 0], 1e-300)))
    groups = len(cuts) - 1
    indexed = (x_rest[:, :groups] >= least * (1 - 1e-9)).sum(1) if least > 0 else np.full(len(x), groups)
    order = np.argsort(-indexed, kind="stable")[: int((indexed > 0).sum())]
    x, x_rest, indexed = x[order], x_rest[order], indexed[order]
    lists = [int((indexed > g).sum()) for g in range(groups)]
    bar = low - 1e-6
    scores, alive = np.zeros((len(a), len(x))), ~barred[:, order]
    g = 0
    while g < groups and lists[g] and (not g or alive.mean() > SPARSE):
        n, own = lists[g], slice(cuts[g], cuts[g + 1])
        scores[:, :n] += a[:, own] @ x[:n, own].T
        bound = np.outer(a_rest[:, g + 1] + 1e-9 * a_rest[:, 0], x_rest[:n, g + 1] + 1e-9 * x_rest[:n, 0])
        alive[:, :n] &= scores[:, :n] + bound >= bar[:, None]
        g += 1
    i, j = np.nonzero(alive)
    score = scores[i, j]
    for g in range(g, groups):
        own = slice(cuts[g], cuts[g + 1])
        for start in range(0, len(i), PAIRS):
            some = slice(start, start + PAIRS)
            listed = np.flatnonzero(j[some] < lists[g]) + start
            score[listed] += np.einsum("ij,ij->i", a[i[listed], own], x[j[listed], own])
        bound = (a_rest[i, g + 1] + 1e-9 * a_rest[i, 0]) * (x_rest[j, g + 1] + 1e-9 * x_rest[j, 0])
        stay = (score + bound >= bar[i]) | (j >= lists[g])
        i, j, score = i[stay], j[stay], score[stay]
    return i, order[j]


def _scan(shared, same: bool, k: int):
    """The best rows of one task for each window of the pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lows = {dim: w["low"].copy() for dim, w in shared.value.items()}
        state: dict[int, tuple] = {}
        for batch in batches:
            for r in range(batch.num_rows):
                dim = batch["dim"][r].as_py()
                if dim not in shared.value:
                    continue
                w, low = shared.value[dim], lows[dim]
                ids, labels = (np.frombuffer(batch[c][r].as_buffer(), np.int64) for c in ("ids", "labels"))
                q = np.frombuffer(batch["q"][r].as_buffer(), np.int32).reshape(-1, dim)
                x = q.astype(np.float64)
                cuts = np.unique(np.linspace(0, dim, GROUPS + 1).astype(int))
                x_rest, a_of = rests(x, cuts), w["q"]
                met = [state[dim]] if dim in state else []
                for label in np.intersect1d(labels, w["labels"]) if same else [None]:
                    rows = slice(0, len(ids)) if label is None else slice(*np.searchsorted(labels, [label, label + 1]))
                    anchors = np.arange(len(a_of)) if label is None else np.arange(*np.searchsorted(w["labels"], [label, label + 1]))
                    for at in np.array_split(anchors, -(-len(anchors) // ANCHORS)):
                        own = w["windows"][at]
                        threshold = np.where(own >= 0, low[own], FAR).min(1)
                        barred = w["ids"][at, None] == ids[rows]
                        if not same:
                            barred |= w["labels"][at, None] == labels[rows]
                        i, j = survivors(a_of[at], threshold.astype(np.float64), x[rows], x_rest[rows], cuts, barred)
                        scores = np.concatenate(
                            [(w["whole"][at[i[p : p + PAIRS]]] * q[rows][j[p : p + PAIRS]]).sum(1) for p in range(0, len(i), PAIRS)] or [np.zeros(0, np.int64)]
                        )
                        some = []
                        for column in own[i].T:
                            fits = (column >= 0) & (scores >= low[column]) & (scores <= w["cap"][column])
                            some.append((column[fits], scores[fits], ids[rows][j[fits]]))
                        met.append(best(k, *(np.concatenate(c) for c in zip(*some))))
                window, score, row_id = state[dim] = best(k, *(np.concatenate(c) for c in zip(*met)))
                full, first = np.unique(window, return_index=True)
                last = first + k - 1
                there = last < len(window)
                there[there] = window[last[there]] == full[there]
                low[full[there]] = np.maximum(low[full[there]], score[last[there]])
        for dim, (window, score, row_id) in state.items():
            w = shared.value[dim]
            columns = [w[c][window] for c in ("anchor_id", "positive_id", "positive_score")]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (*columns, row_id, score)], names=["anchor_id", "positive_id", "positive_score", "id", "score"])

    return run


def _packed(windows: pd.DataFrame, low: str) -> dict[int, dict[str, np.ndarray]]:
    """Windows of a pass by the length of their vectors, with each anchor once."""
    packed = {}
    for dim, own in windows.groupby("dim"):
        anchors = own.drop_duplicates("anchor_id").sort_values(["label", "anchor_id"])
        place = pd.Series(np.arange(len(anchors)), anchors["anchor_id"])[own["anchor_id"]].to_numpy()
        turn = own.groupby("anchor_id").cumcount().to_numpy()
        table = np.full((len(anchors), turn.max() + 1), -1)
        table[place, turn] = np.arange(len(own))
        q = np.frombuffer(b"".join(anchors["q"]), np.int32).reshape(len(anchors), dim).astype(np.int64)
        packed[int(dim)] = {"ids": anchors["anchor_id"].to_numpy(), "labels": anchors["label"].to_numpy(), "q": q.astype(np.float64), "whole": q, "windows": table}
        packed[int(dim)] |= {"low": own[low].to_numpy()} | {c: own[c].to_numpy() for c in ("cap", "anchor_id", "positive_id", "positive_score")}
    return packed


def _search(windows: DataFrame, blocks: DataFrame, sample, same: bool, k: int, scratch: Scratch) -> DataFrame:
    """``anchor_id, positive_id, positive_score, id, score, rank``: the k best rows inside each window."""
    spark = windows.sparkSession
    windows = windows.select(*[c.split()[0] for c in WINDOW.split(", ")])
    windows = scratch.save(windows.mapInPandas(_levels(sample, same, k), WINDOW), "windows")
    passes = -(-windows.count() // PASS)
    part = F.pmod(F.xxhash64("anchor_id"), F.lit(max(passes, 1)))
    tables = []

    def scan(some: pd.DataFrame, low: str) -> DataFrame:
        shared = spark.sparkContext.broadcast(_packed(some, low))
        found = scratch.save(blocks.mapInArrow(_scan(shared, same, k), FOUND), "found")
        tables.append(found._scratch_path)
        shared.unpersist()
        return found

    for p in range(passes):
        some = windows.where(part == p).toPandas()
        if some.empty:
            continue
        filled = scan(some, "first").groupBy("anchor_id", "positive_id").count().where(F.col("count") >= k).toPandas()
        keys = pd.MultiIndex.from_frame(some[["anchor_id", "positive_id"]])
        more = some[(some["first"] > some["second"]).to_numpy() & ~keys.isin(pd.MultiIndex.from_frame(filled[["anchor_id", "positive_id"]]))]
        if len(more):
            scan(more, "second")
    found = spark.read.schema(FOUND).parquet(*tables) if tables else spark.createDataFrame([], FOUND)
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "id")
    return found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(
    vectors: DataFrame,
    anchors: Column,
    label: Column,
    positives: int = 5,
    negatives: int = 5,
    low: int = 80,
    high: int = 100,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Components become floor(256 * x), within +-2^27; a score is the whole-number product with the
    anchor. ``anchors`` says which rows are anchors. An anchor's positives are the best other rows of its
    ``label`` (a whole number); a positive's negatives are the best rows of other labels that score from ``low`` to ``high``
    hundredths of its score, ties to smaller ids. Every row is searched, and what is returned is exact.
    Rows without an id or label and vectors that are null, empty or hold null or non-finite components
    take no part; vectors of different lengths don't meet. Repeated rows count once, and of an id with
    several rows the one with the least label and vector. Positives without negatives give no rows,
    nor do empty tables. Other columns are ignored.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vec_col).alias("vec"), anchors.alias("is_anchor"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("vec")))
    some = single(thinned(rows, rows.count(), SAMPLE, "id").select("id", "label", "vec")).toPandas().sort_values("id")
    samples, orders = {}, {}
    for dim, own in some.groupby(some["vec"].map(len)):
        q = whole(np.stack(own["vec"]).astype(np.float64))
        orders[dim] = np.argsort(-(q.astype(np.float64) ** 2).sum(0), kind="stable")
        samples[dim] = own["id"].to_numpy(), own["label"].to_numpy(), q[:, orders[dim]].astype(np.float64)
    orders, sample = spark.sparkContext.broadcast(orders), spark.sparkContext.broadcast(samples)
    blocks = scratch.save(single(rows.drop("is_anchor")).mapInArrow(_blocks(orders), BLOCK), "blocks")
    chosen = single(rows.where("is_anchor").drop("is_anchor")).mapInArrow(_anchors(orders), "anchor_id long, label long, dim int, q binary")
    chosen = scratch.save(chosen, "anchors")
    far, unset = F.lit(FAR), {c: F.lit(0).cast("long") for c in ("positive_id", "positive_score", "first", "second")}
    start = chosen.withColumns(unset | {"floor": -far, "cap": far})
    near = _search(start, blocks, sample, True, positives, scratch).select("anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    near = scratch.save(near, "positives")
    # low * p <= 100 * n <= high * p in whole numbers
    least = -F.expr(f"floor(-cast(positive_score as decimal(38,0)) * {low} / 100)").cast("long")
    most = F.expr(f"floor(cast(positive_score as decimal(38,0)) * {high} / 100)").cast("long")
    windows = chosen.join(near, "anchor_id").withColumns({"floor": least, "cap": most, "first": unset["first"], "second": unset["second"]})
    found = _search(windows.where("floor <= cap"), blocks, sample, False, negatives, scratch)
    return found.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def mine_sql(anchor: str, label: str, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> str:
    """The same over ``embeddings``, by all products with the anchors."""
    return f"""
with rows as (
  select vec_id, {label} label, list_transform(embedding, lambda x: cast(floor(256 * x::double) as bigint)) q from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
products as (
  select a.vec_id anchor_id, a.label = b.label same, b.vec_id,
    cast(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) as bigint) score
  from rows a join rows b on a.vec_id <> b.vec_id and len(a.q) = len(b.q) where {anchor}),
positives as (
  select anchor_id, vec_id positive_id, score positive_score from products where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= {positives})
select anchor_id, positive_id, cast(row_number() over (partition by anchor_id, positive_id order by score desc, vec_id) as integer) as rank,
  vec_id negative_id, positive_score, score negative_score
from products join positives using (anchor_id)
where not same and {low} * positive_score <= 100 * score and 100 * score <= {high} * positive_score
qualify row_number() over (partition by anchor_id, positive_id order by score desc, vec_id) <= {negatives}
"""
