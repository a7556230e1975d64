"""Approximate nearest neighbours by multi-index hashing of learned binary codes.

A code has 64 bits: the signs of vectors turned by rotations that are learned on a bounded sample, so
that signs lose little (ITQ, Gong and Lazebnik, 2011). It is cut into four substrings, and each block
of rows has a table of buckets for each substring. All codes within a Hamming radius of a query's are
retrieved by the pigeonhole principle: a code within radius r differs in one of the substrings by no
more than its share of r, so only buckets within that share are opened (Norouzi, Punjani and Fleet, 2012).
What is retrieved is ranked by cosines of the vectors themselves.

A query's radius follows from a cosine that its k-th neighbour is sure to reach: its k-th best in the
sample at first, then what a task has found already. The radius for a cosine is calibrated on the
sample, so that a partner at exactly that cosine lies inside with the target recall. Queries visit all
blocks in passes of a bounded number; a task returns k rows a query at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelmill.llm._spark import Scratch, thinned
from voxelmill.llm._vectors import best, chunked, matrix, single, usable

#: Rows that rotations, radii and first cosines are fitted on, about. All rows are indexed.
SAMPLE = 8192
#: Queries that visit all blocks at once; they are sent to every executor.
PASS = 32_768
#: Queries that are probed in a block at once, and pairs whose cosines are computed at once.
QUERIES, PAIRS = 256, 32_768
#: Bits of a code, and of each of its substrings.
BITS, SUB = 64, 16
SUBS = BITS // SUB
#: Vectors of a length with fewer sampled rows have no codes; all of them are retrieved.
LEAST = 256
#: Steps of cosines for which radii are calibrated.
GRID = 200
#: If probing opens less than this share of a block's pairs, pairs are listed; otherwise they are marked in a map of the block.
LISTED = 1 / 16

BLOCK = "dim int, ids binary, units binary, codes binary, orders binary, values array<binary>, counts array<binary>"
FOUND = "query_id long, vec_id long, score double"


def learn_rotations(x: np.ndarray, rounds: int = 20, seed: int = 7) -> np.ndarray:
    """Directions of ``BITS`` bits; short vectors get several rotations."""
    rng, dim, turned = np.random.default_rng(seed), x.shape[1], []
    values, axes = np.linalg.eigh(x.T @ x)
    axes = axes[:, np.argsort(-values)][:, :BITS]
    v = x @ axes
    for _ in range(-(-BITS // axes.shape[1])):
        r = np.linalg.qr(rng.standard_normal((v.shape[1], v.shape[1])))[0]
        for _ in range(rounds):
            left, _, right = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
            r = (left @ right).T
        turned.append(axes @ r)
    return np.concatenate(turned, axis=1)[:, :BITS].reshape(dim, BITS)


def encode(x: np.ndarray, model) -> np.ndarray:
    """Codes as rows of substrings."""
    if model is None:
        return np.zeros((len(x), SUBS), np.uint16)
    mean, turn, _ = model
    return np.packbits((x - mean) @ turn >= 0, axis=1).view(np.uint16)


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def fit(x: np.ndarray, recall: float, seed: int = 7):
    """Mean, rotations, and the radius by cosine that holds ``recall`` of partners at that cosine."""
    mean = x.mean(0)
    model = mean, learn_rotations(x - mean, seed=seed), None
    rng = np.random.default_rng(seed)
    base = x[rng.integers(0, len(x), 4096)]
    side = rng.standard_normal(base.shape)
    side -= (side * base).sum(1, keepdims=True) * base
    side /= np.maximum(np.linalg.norm(side, axis=1, keepdims=True), 1e-300)
    own, radii = encode(base, model), []
    for c in np.linspace(-1, 1, GRID + 1):
        gap = differing(own, encode(c * base + np.sqrt(max(0.0, 1 - c * c)) * side, model)).sum(1)
        radii.append(int(np.quantile(gap, recall, method="higher")))
    return *model[:2], np.minimum.accumulate(np.array(radii))


def radius(model, cosine: np.ndarray) -> np.ndarray:
    """Radii for cosines that neighbours are sure to reach; -1 stands for nothing known."""
    if model is None:
        return np.zeros(len(cosine), np.int64)
    near = model[2][np.clip(np.floor((cosine + 1) * GRID / 2).astype(int), 0, GRID)]
    return np.where(cosine > -1, near, BITS)


def units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of pairs of unit vectors; equal pairs have equal values."""
    return np.einsum("ij,ij->i", a, b)


def _blocks(models):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, rows in chunked(batches, "vec"):
            x = units(matrix(rows["vec"].combine_chunks(), dim))
            codes = encode(x, models.value.get(dim))
            orders = np.argsort(codes, axis=0, kind="stable")
            tables = [np.unique(codes[:, s], return_counts=True) for s in range(SUBS)]
            columns = {"ids": rows["id"].to_numpy(), "units": x, "codes": codes, "orders": orders.T.astype(np.int32)}
            held = {c: pa.array([v.tobytes()], pa.binary()) for c, v in columns.items()}
            held |= {"values": pa.array([[v.tobytes() for v, _ in tables]]), "counts": pa.array([[n.astype(np.int32).tobytes() for _, n in tables]])}
            yield pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32())} | held)

    return run


def probe(code: np.ndarray, reach: np.ndarray, values: list[np.ndarray], counts: list[np.ndarray], orders: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Query and row of all codes of the block within ``reach`` of the queries' codes."""
    n = len(codes)
    share, extra = np.divmod(reach, SUBS)
    opened = [differing(code[:, s, None], values[s]) <= (share - (s > extra))[:, None] for s in range(SUBS)]
    n_opened = sum(int((o @ c).sum()) for o, c in zip(opened, counts))
    if n_opened < LISTED * n * len(code):
        found = []
        for s in range(SUBS):
            start = np.cumsum(counts[s]) - counts[s]
            i, bucket = np.nonzero(opened[s])
            size = counts[s][bucket]
            inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            found.append(np.repeat(i, size) * n + orders[s][np.repeat(start[bucket], size) + inside])
        i, j = np.divmod(np.unique(np.concatenate(found)), n)
    else:
        met = np.zeros((len(code), n), bool)
        for s in range(SUBS):
            met[:, orders[s]] |= np.repeat(opened[s], counts[s], axis=1)
        i, j = np.nonzero(met)
    whole = code.view(np.uint64)[:, 0], np.ascontiguousarray(codes).view(np.uint64)[:, 0]
    near = np.bitwise_count(whole[0][i] ^ whole[1][j]) <= reach[i]
    return i[near], j[near]


def _scan(shared, models, k: int):
    """The nearest rows of one task for each query of the pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reached = {dim: q["cosine"].copy() for dim, q in shared.value.items()}
        state: dict[int, tuple] = {}
        for batch in batches:
            for r in range(batch.num_rows):
                dim = batch["dim"][r].as_py()
                if dim not in shared.value:
                    continue
                q, model, cosine = shared.value[dim], models.value.get(dim), reached[dim]
                read = lambda c, kind: np.frombuffer(batch[c][r].as_buffer(), kind)  # noqa: B023, E731
                ids, x = read("ids", np.int64), read("units", np.float64).reshape(-1, dim)
                codes, orders = read("codes", np.uint16).reshape(-1, SUBS), read("orders", np.int32).reshape(SUBS, -1)
                values = [np.frombuffer(v, np.uint16) for v in batch["values"][r].as_py()]
                counts = [np.frombuffer(v, np.int32).astype(np.int64) for v in batch["counts"][r].as_py()]
                met = [state[dim]] if dim in state else []
                for at in np.array_split(np.arange(len(q["ids"])), -(-len(q["ids"]) // QUERIES)):
                    reach = np.minimum(radius(model, cosine[at]), BITS) if q["bounded"] else np.full(len(at), BITS)
                    i, j = probe(q["codes"][at], reach, values, counts, orders, codes)
                    other = q["ids"][at[i]] != ids[j]
                    i, j = i[other], j[other]
                    for p in range(0, len(i), PAIRS):
                        some = slice(p, p + PAIRS)
                        score = cosines(q["units"][at[i[some]]], x[j[some]])
                        good = score >= cosine[at[i[some]]] - 1e-9 if q["bounded"] else np.ones(len(score), bool)
                        met.append(best(k, at[i[some]][good], score[good], ids[j[some]][good]))
                if not met:
                    continue
                query, score, row_id = state[dim] = best(k, *(np.concatenate(c) for c in zip(*met)))
                full, first = np.unique(query, return_index=True)
                last = first + k - 1
                there = last < len(query)
                there[there] = query[last[there]] == full[there]
                cosine[full[there]] = np.maximum(cosine[full[there]], score[last[there]])
        for dim, (query, score, row_id) in state.items():
            own = shared.value[dim]["ids"][query]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(row_id, pa.int64()), pa.array(score, pa.float64())], names=["query_id", "vec_id", "score"])

    return run


def _queries(sample, models, k: int):
    """Queries with their codes, and the cosine that k rows of the sample reach (-1 where they don't)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, rows in chunked(batches, "vec"):
            x, ids = units(matrix(rows["vec"].combine_chunks(), dim)), rows["id"].to_numpy()
            cosine = np.full(len(x), -1.0)
            own_ids, own = sample.value.get(dim, (ids[:0], x[:0]))
            if len(own) > k:
                for at in np.array_split(np.arange(len(x)), -(-len(x) // QUERIES)):
                    near = x[at] @ own.T
                    near[ids[at, None] == own_ids] = -1.0
                    cosine[at] = np.partition(near, len(own) - k, axis=1)[:, len(own) - k]
            codes = encode(x, models.value.get(dim))
            yield pa.RecordBatch.from_pydict(
                {"query_id": pa.array(ids, pa.int64()), "dim": pa.array(np.full(len(x), dim, np.int32)), "unit": pa.array([v.tobytes() for v in x], pa.binary()), "code": pa.array([v.tobytes() for v in codes], pa.binary()), "cosine": pa.array(cosine)}
            )

    return run


def _packed(rows: pd.DataFrame, bounded: bool) -> dict:
    packed = {}
    for dim, own in rows.groupby("dim"):
        held = {"ids": own["query_id"].to_numpy(), "cosine": own["cosine"].to_numpy().copy(), "bounded": bounded}
        held["units"] = np.frombuffer(b"".join(own["unit"]), np.float64).reshape(len(own), int(dim))
        held["codes"] = np.frombuffer(b"".join(own["code"]), np.uint16).reshape(len(own), SUBS)
        packed[int(dim)] = held
    return packed


def search(vectors: DataFrame, queries: Column, k: int = 5, recall: float = 0.98, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest rows by cosine that are found for every query.

    ``queries`` says which rows are queries; candidates are all other rows. About ``recall`` of the true
    neighbours at the edge of a query's radius are found, and more of nearer ones; scores are exact
    cosines in double precision, ties go to smaller ids. Queries that find fewer than k rows search
    again with every code inside the radius, so they return k rows, or all there are. Rows without an id
    and vectors that are null, empty, zero or hold null or non-finite components take no part; vectors of different
    lengths don't meet. Repeated rows count once, and of an id with several vectors the least counts.
    An empty table gives no rows. Other columns are ignored.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"), queries.alias("is_query"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("vec")) & F.exists("vec", lambda x: x != 0))
    some = single(thinned(rows, rows.count(), SAMPLE, "id").select("id", "vec")).toPandas().sort_values("id")
    samples, models = {}, {}
    for dim, own in some.groupby(some["vec"].map(len)):
        x = units(np.stack(own["vec"]).astype(np.float64))
        samples[dim] = own["id"].to_numpy(), x
        if len(x) >= LEAST:
            models[dim] = fit(x, recall)
    models, sample = spark.sparkContext.broadcast(models), spark.sparkContext.broadcast(samples)
    blocks = scratch.save(single(rows.select("id", "vec")).mapInArrow(_blocks(models), BLOCK), "blocks")
    asked = single(rows.where("is_query").select("id", "vec"))
    asked = scratch.save(asked.mapInArrow(_queries(sample, models, k), "query_id long, dim int, unit binary, code binary, cosine double"), "queries")
    passes = -(-asked.count() // PASS)
    part = F.pmod(F.xxhash64("query_id"), F.lit(max(passes, 1)))
    tables = []
    for p in range(passes):
        own = asked.where(part == p).toPandas()
        for bounded in (True, False):
            if own.empty:
                break
            shared = spark.sparkContext.broadcast(_packed(own, bounded))
            found = scratch.save(blocks.mapInArrow(_scan(shared, models, k), FOUND), "found")
            tables.append(found._scratch_path)
            shared.unpersist()
            if bounded:
                full = found.groupBy("query_id").count().where(F.col("count") >= k).toPandas()["query_id"]
                own = own[~own["query_id"].isin(full)]
    found = spark.read.schema(FOUND).parquet(*tables) if tables else spark.createDataFrame([], FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
