"""Embedding near-duplicates by an inverted multi-index.

Each half of a unit vector has a codebook of its own; the pairs of codes are the cells of a product
grid. A vector lies in one cell and visits the cells nearest to it in the order of the multi-sequence
algorithm (ascending sum of both halves' distances) until the sum exceeds the nearest cell's by a
margin. The margin is calibrated so that the target recall is met for partners exactly at the
threshold, the hardest ones. Pairs that meet in a cell are verified by exact cosines in blocks, and
count for both of their vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelmill.llm._spark import Scratch, components, thinned

#: Vectors that codebooks and margin are fitted on, about: this many at least, and so many for each code.
#: All vectors are indexed.
SAMPLE, PER_CODE = 8192, 16
#: Aimed members of a cell, and the least size of a codebook.
PER_CELL, LEAST_CODES = 512, 4
#: Vectors of a length that is too rare for an index; they are one cell.
ALONE = 2048
#: Vectors of a cell that one task compares with as many others.
BLOCK = 2048


def fit_codebook(half: np.ndarray, codes: int, seed: int, rounds: int = 8) -> np.ndarray:
    """Lloyd's algorithm over the sample."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(half, axis=0)
    book = distinct[rng.permutation(len(distinct))[:codes]].copy()
    for _ in range(rounds):
        near = ((book**2).sum(1) - 2 * half @ book.T).argmin(1)
        for k in range(len(book)):
            if (own := near == k).any():
                book[k] = half[own].mean(0)
    return book


def thin(sample: np.ndarray, threshold: float) -> np.ndarray:
    """The sample without vectors near an earlier one, so that a crowd doesn't draw codes to itself."""
    kept = sample[:0]
    for start in range(0, len(sample), 256):
        block = sample[start : start + 256]
        block = block[~(block @ kept.T >= threshold).any(1)] if len(kept) else block
        close = np.tril(block @ block.T >= threshold, -1)
        alone = np.ones(len(block), bool)
        for k in range(len(block)):
            alone[k] = not (close[k] & alone).any()
        kept = np.concatenate([kept, block[alone]])
    return kept


def distances(half: np.ndarray, book: np.ndarray) -> np.ndarray:
    return np.maximum((half**2).sum(1)[:, None] + (book**2).sum(1) - 2 * half @ book.T, 0)


def _visited(excess_one: np.ndarray, excess_two: np.ndarray, margin: float) -> np.ndarray:
    """Whether two halves' distances, less the nearest codes', are within the margin together."""
    return excess_two <= margin - excess_one


def multi_sequence(first: np.ndarray, second: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and both codes of every visited cell, for rows of distances to the codes of either half.

    By row, in ascending sum of the codes' distances, while the sum is within ``margin`` of the least.
    """
    one, two = first - first.min(1, keepdims=True), second - second.min(1, keepdims=True)
    row, a = np.nonzero(one <= margin)
    k, b = np.nonzero(_visited(one[row, a][:, None], two[row], margin))
    row, a = row[k], a[k]
    order = np.lexsort((one[row, a] + two[row, b], row))
    return row[order], a[order], b[order]


def fit_index(sample: np.ndarray, codes: int, threshold: float, recall: float, seed: int = 5) -> tuple[np.ndarray, np.ndarray, float]:
    """Both codebooks, and the margin within which ``recall`` of partners at the threshold are visited.

    Partners are drawn at a cosine of exactly the threshold in random directions from the sample's
    vectors; nearer partners are visited more surely.
    """
    sample = thin(sample, threshold)
    half = sample.shape[1] // 2
    books = fit_codebook(sample[:, :half], codes, seed), fit_codebook(sample[:, half:], codes, seed + 1)
    rng = np.random.default_rng(seed)
    base = sample[rng.integers(0, len(sample), 20_000)]
    side = rng.standard_normal(base.shape)
    side -= (side * base).sum(1, keepdims=True) * base
    side /= np.maximum(np.linalg.norm(side, axis=1, keepdims=True), 1e-300)
    partner = threshold * base + np.sqrt(1 - threshold**2) * side
    excess = np.zeros(len(base))
    for cols, book in ((slice(None, half), books[0]), (slice(half, None), books[1])):
        own, other = distances(base[:, cols], book), distances(partner[:, cols], book)
        excess += own[np.arange(len(base)), other.argmin(1)] - own.min(1)
    return (*books, float(np.quantile(excess, recall)) + 1e-9)


def _units(raw: pd.Series, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), dim)


def unit_bytes(vectors: pd.Series) -> list[bytes | None]:
    """Unit vectors in double precision; None for what has no direction."""
    out = []
    for v in vectors:
        x = None if v is None else np.array([np.nan if c is None else c for c in v] if getattr(v, "dtype", None) == object else v, np.float64)
        if x is None or not len(x) or not np.isfinite(x).all() or not x.any():
            out.append(None)
            continue
        x = x / np.abs(x).max()
        out.append((x / np.sqrt((x * x).sum())).tobytes())
    return out


CELL = "dim int, cell long, side int, id long, weight long, home long, vec binary"


def _cells(reps: DataFrame, index) -> DataFrame:
    names = [c.split()[0] for c in CELL.split(", ")]

    def rows(part: pd.DataFrame, dim: int, side: int, cell, home, row) -> pd.DataFrame:
        out = {"dim": dim, "cell": cell, "side": side, "home": home} | {c: part[c].to_numpy()[row] for c in ("id", "weight", "vec")}
        return pd.DataFrame(out, columns=names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        books = index.value
        for batch in batches:
            sizes = batch["vec"].map(len).to_numpy() // 8
            for dim in np.unique(sizes):
                part = batch[sizes == dim]
                if int(dim) not in books:  # one cell holds all vectors of a rare length
                    none = np.zeros(len(part), np.int64)
                    yield from (rows(part, dim, side, none, none, np.arange(len(part))) for side in (0, 1))
                    continue
                one, two, margin = books[int(dim)]
                step = int(np.clip(4_000_000 // (len(one) * len(two)), 16, 4096))
                for k in range(0, len(part), step):
                    some = part.iloc[k : k + step]
                    x = _units(some["vec"], dim)
                    d1, d2 = distances(x[:, : len(one[0])], one), distances(x[:, len(one[0]) :], two)
                    home = d1.argmin(1).astype(np.int64) * len(two) + d2.argmin(1)
                    yield rows(some, dim, 0, home, home, np.arange(len(some)))
                    row, a, b = multi_sequence(d1, d2, margin)
                    yield rows(some, dim, 1, a.astype(np.int64) * len(two) + b, home[row], row)

    return reps.select("id", "weight", "vec").mapInPandas(run, CELL)


def _match(threshold: float, index):
    """Links of one block of members with one block of visitors: counts, and star edges.

    A visitor counts the members it links with. A member counts a visitor only if it doesn't visit
    the visitor's own cell, where it would count that link itself.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        members, visitors = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        none = pd.DataFrame({"id": [], "n": [], "low": []})
        if members.empty or visitors.empty:
            return none
        dim = len(members["vec"].iloc[0]) // 8
        x, y = _units(visitors["vec"], dim), _units(members["vec"], dim)
        linked = x @ y.T >= threshold
        mine, theirs = visitors["id"].to_numpy(), members["id"].to_numpy()
        linked &= mine[:, None] != theirs[None, :]
        some, met = linked.any(1), linked.any(0)
        if not some.any():
            return none
        linked, mine, theirs = linked[np.ix_(some, met)], mine[some], theirs[met]
        n = linked @ members["weight"].to_numpy()[met]
        back = np.zeros(len(theirs), np.int64)
        if dim in index.value:
            one, two, margin = index.value[dim]
            home, y = visitors["home"].to_numpy()[some], y[met]
            e1, e2 = distances(y[:, : len(one[0])], one), distances(y[:, len(one[0]) :], two)
            e1, e2 = e1 - e1.min(1, keepdims=True), e2 - e2.min(1, keepdims=True)
            theirs_too = _visited(e1[:, home // len(two)], e2[:, home % len(two)], margin)
            back = (linked.T & ~theirs_too) @ visitors["weight"].to_numpy()[some]
        top = np.iinfo(np.int64).max
        low_v, low_m = mine.copy(), theirs.copy()
        while True:
            new_m = np.minimum(low_m, np.where(linked, low_v[:, None], top).min(0))
            new_v = np.minimum(low_v, np.where(linked, new_m[None, :], top).min(1))
            if (new_m == low_m).all() and (new_v == low_v).all():
                break
            low_v, low_m = new_v, new_m
        return pd.DataFrame({"id": np.concatenate([mine, theirs]), "n": np.concatenate([n, back]), "low": np.concatenate([low_v, low_m])})

    return run


def near_duplicates_sql(threshold: float = 0.95) -> str:
    """The same over ``embeddings`` by all cosines, for tables whose ids are distinct."""
    return f"""
with recursive units as (
  select vec_id, list_transform(embedding, lambda x: x::double) v, sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))) n from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
links as (
  select a.vec_id a, b.vec_id b from units a join units b on a.vec_id <> b.vec_id and len(a.v) = len(b.v) and a.n > 0 and b.n > 0
  where list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) / (a.n * b.n) >= {threshold}),
reach as (select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a),
found as (select a, min(b) low from reach group by a), counts as (select a, count(*) n from links group by a)
select vec_id, coalesce(counts.n, 0)::bigint n_links, least(vec_id, coalesce(low, vec_id)) component_id, component_id = vec_id kept
from embeddings left join counts on counts.a = vec_id left join found on found.a = vec_id
"""


def near_duplicates(
    vectors: DataFrame, threshold: float = 0.95, recall: float = 0.999, id_col: str = "vec_id", vec_col: str = "embedding"
) -> DataFrame:
    """``vec_id, n_links, component_id, kept``: one row per id.

    Links are pairs of different ids with cosine >= threshold in double precision, found with about
    ``recall`` or more; no other pairs link. Vectors that are null, empty, zero or hold null or
    non-finite components link with nothing, nor do vectors of different lengths with each other.
    Every length with more than ``ALONE`` vectors has an index of its own. A link counts at both ends. Equal vectors are compared once and counted for each id. Repeated rows count once; of an id with
    several vectors the smallest counts. Rows without an id give one row with nothing but no links.
    An empty table gives no rows. Other columns are ignored.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)

    def normalise(batches):
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"].astype("Int64"), "vec": unit_bytes(batch["vec"])})

    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"))
    units = rows.mapInPandas(normalise, "id long, vec binary")
    units = scratch.save(units.groupBy("id").agg(F.min("vec").alias("vec")), "units")
    live = units.where("id is not null and vec is not null")
    reps = scratch.save(live.groupBy("vec").agg(F.min("id").alias("id"), F.count("*").alias("weight")), "reps")
    length = (F.octet_length("vec") / 8).cast("int")
    dims = {r[0]: r[1] for r in reps.groupBy(length).count().where(F.col("count") > ALONE).collect()}
    books = {}
    for dim, n in dims.items():
        if dim < 2:
            continue
        codes = max(LEAST_CODES, int(np.sqrt(n / PER_CELL)))
        sample = thinned(reps.where(F.octet_length("vec") == 8 * dim), n, max(SAMPLE, PER_CODE * codes), "id").select("vec").toPandas()
        sample = sample.sort_values("vec")  # the same order in every run
        books[dim] = fit_index(_units(sample["vec"], dim), codes, threshold, recall)
    index = spark.sparkContext.broadcast(books)
    cells = scratch.save(_cells(reps, index), "cells")

    # a crowded cell is dealt to pairs of blocks; no task gets more than two blocks
    sizes = cells.groupBy("dim", "cell").agg(
        F.ceil(F.sum((F.col("side") == 0).cast("int")) / BLOCK).cast("long").alias("member_blocks"),
        F.ceil(F.sum((F.col("side") == 1).cast("int")) / BLOCK).cast("long").alias("visitor_blocks"),
    )
    own = F.pmod(F.xxhash64("id"), F.when(F.col("side") == 0, F.col("member_blocks")).otherwise(F.col("visitor_blocks")))
    others = F.when(F.col("side") == 0, F.col("visitor_blocks")).otherwise(F.col("member_blocks"))
    dealt = (
        cells.join(sizes.where("member_blocks > 0 and visitor_blocks > 0"), ["dim", "cell"])
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), others - 1)))
        .withColumn("m", F.when(F.col("side") == 0, F.col("own")).otherwise(F.col("other")))
        .withColumn("v", F.when(F.col("side") == 0, F.col("other")).otherwise(F.col("own")))
    )
    found = dealt.select("dim", "cell", "m", "v", "side", "id", "weight", "home", "vec")
    found = scratch.save(found.groupBy("dim", "cell", "m", "v").applyInPandas(_match(threshold, index), "id long, n long, low long"), "matches")
    scratch.drop(cells)
    links = found.groupBy("id").agg(F.sum("n").alias("n"))
    joined = components(found.select(F.col("id").alias("a"), F.col("low").alias("b")), scratch)
    named = (
        reps.join(links, "id", "left")
        .join(joined, F.col("id") == F.col("node"), "left")
        .select("vec", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    )
    out = live.join(named, "vec").select("id", "n_links", "component_id")
    rest = units.where("id is null or vec is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return out.unionByName(rest).select(
        F.col("id").alias("vec_id"), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept")
    )
