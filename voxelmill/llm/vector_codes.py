"""Product codes of vectors, with codebooks fitted to all rows by exact whole-number rounds.

Vectors are cut into equal parts; each part position has a codebook. Every task writes its rows in
chunks, and in a chunk every position's parts lie sorted along a Hilbert curve in flat blocks that
carry a min/max box, a count and sums. A round compares boxes with the codebook first: an entry whose
least distance to the box exceeds another entry's greatest can't be nearest to any of its parts. What
is left is the block's shortlist. A shortlist of one assigns the block by its stored sums; others are
settled by whole-number distances of the block's parts to the shortlist only.

Blocks are cut inside tasks, so rows are never shuffled: how parts are grouped changes how long the
shortlists are, but no result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelmill.llm._spark import Scratch
from voxelmill.llm._vectors import chunked, matrix, usable, whole

#: Parts in a block.
BLOCK = 64
#: Labels whose sums are sent to every executor; more are joined by a shuffle.
FEW_LABELS = 200_000
#: Cells of the temporary tables of one step of the kernel.
STEP = 4_000_000


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Positions along the Hilbert curve of points with components of ``bits`` bits (Skilling, 2004)."""
    x = points.T.copy()
    axes = len(x)
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        for k in range(axes):
            high = (x[k] & q) != 0
            swapped = np.where(high, 0, (x[0] ^ x[k]) & (q - 1))
            x[0] ^= np.where(high, q - 1, swapped)
            x[k] ^= swapped
    for k in range(1, axes):
        x[k] ^= x[k - 1]
    turn = np.zeros_like(x[0])
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        turn ^= np.where((x[-1] & q) != 0, q - 1, 0)
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for k in range(axes):
            key = key << 1 | x[k] >> b & 1
    return key


def curve_order(parts: np.ndarray) -> np.ndarray:
    """Order of the rows of ``parts`` along the curve; of very long parts the first 31 components count."""
    some = parts[:, :31]
    bits = min(10, 62 // some.shape[1])
    low, high = some.min(0), some.max(0)
    return np.argsort(hilbert((some - low) * ((1 << bits) - 1) // np.maximum(high - low, 1), bits), kind="stable")


def flat_blocks(parts: np.ndarray, block: int) -> tuple[np.ndarray, ...]:
    """Order, points, low and high corners, and sums of one position's blocks; the last block repeats its last part."""
    n, width = parts.shape
    order = curve_order(parts)
    n_blocks = -(-n // block)
    points = parts[order[np.minimum(np.arange(n_blocks * block), n - 1)]].reshape(n_blocks, block, width)
    sums = np.add.reduceat(parts[order], np.arange(0, n, block), axis=0)
    return order.astype(np.int32), points.astype(np.int32), points.min(1).astype(np.int32), points.max(1).astype(np.int32), sums


def shortlists(low: np.ndarray, high: np.ndarray, book: np.ndarray) -> np.ndarray:
    """By block and entry: whether the entry may be nearest to a part inside the block's box."""
    below, above = low[:, None] - book, book - high[:, None]
    near = (np.maximum(np.maximum(below, above), 0) ** 2).sum(-1)
    far = (np.maximum(np.abs(book - low[:, None]), np.abs(high[:, None] - book)) ** 2).sum(-1)
    return near <= far.min(1, keepdims=True)


def nearest(points: np.ndarray, listed: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry and squared distance of every part of every block, among its block's shortlist; ties to the lower entry."""
    entry = np.zeros(points.shape[:2], np.int64)
    square = np.zeros(points.shape[:2], np.int64)
    sizes = listed.sum(1)
    for size in np.unique(sizes):
        blocks = np.flatnonzero(sizes == size)
        step = max(1, STEP // (points.shape[1] * int(size) * points.shape[2]))
        for k in range(0, len(blocks), step):
            some = blocks[k : k + step]
            entries = np.argsort(~listed[some], axis=1, kind="stable")[:, :size]
            gaps = ((points[some][:, :, None] - book[entries][:, None]) ** 2).sum(-1)
            best = gaps.argmin(2)
            entry[some] = np.take_along_axis(entries, best, 1)
            square[some] = np.take_along_axis(gaps, best[:, :, None], 2)[:, :, 0]
    return entry, square


CHUNKED = ("orders", "points", "lows", "highs", "sums")


def _write(parts: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, rows in chunked(batches, "vec"):
            x = whole(matrix(rows["vec"].combine_chunks(), dim)).reshape(len(rows), parts, dim // parts)
            made = list(zip(*[flat_blocks(x[:, p], block) for p in range(parts)], strict=True))
            columns = {"n": pa.array([len(rows)], pa.int32())}
            columns |= {name: pa.array([np.stack(a).tobytes()], pa.binary()) for name, a in zip(CHUNKED, made, strict=True)}
            for name in ("id", "label"):
                columns[name] = pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows[name].combine_chunks())
            yield pa.RecordBatch.from_pydict(columns)

    return run


def _read(batch: pa.RecordBatch, k: int, parts: int, width: int, block: int) -> dict[str, np.ndarray]:
    n = batch["n"][k].as_py()
    n_blocks = -(-n // block)
    shapes = {"orders": (n,), "points": (n_blocks, block, width), "lows": (n_blocks, width), "highs": (n_blocks, width), "sums": (n_blocks, width)}
    held = {}
    for name, shape in shapes.items():
        if name not in batch.schema.names:
            continue
        raw = np.frombuffer(batch[name][k].as_buffer(), np.int64 if name == "sums" else np.int32)
        held[name] = raw.reshape(parts, *shape).astype(np.int64)
    return held | {"n": n, "counts": np.minimum(block, n - block * np.arange(n_blocks))}


def _totals(books, block: int):
    """Counts and sums by part, entry and component: partial sums of a task, in one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = books.value
        parts, entries, width = book.shape
        total = np.zeros((parts, entries, width + 1), np.int64)
        for batch in batches:
            for k in range(batch.num_rows):
                c = _read(batch, k, parts, width, block)
                for p in range(parts):
                    listed = shortlists(c["lows"][p], c["highs"][p], book[p])
                    whole_blocks = listed.sum(1) == 1
                    entry = listed[whole_blocks].argmax(1)
                    np.add.at(total[p], (entry, slice(0, width)), c["sums"][p][whole_blocks])
                    np.add.at(total[p, :, width], entry, c["counts"][whole_blocks])
                    rest = np.flatnonzero(~whole_blocks)
                    real = (np.arange(block) < c["counts"][rest, None]).ravel()
                    points = c["points"][p][rest]
                    entry = nearest(points, listed[rest], book[p])[0].ravel()[real]
                    points = points.reshape(-1, width)[real]
                    order = np.argsort(entry, kind="stable")
                    found, first = np.unique(entry[order], return_index=True)
                    if len(found):
                        total[p, found, :width] += np.add.reduceat(points[order], first, axis=0)
                        total[p, found, width] += np.diff(np.append(first, len(entry)))
        used = np.flatnonzero(np.repeat(total[:, :, width] > 0, width + 1))
        yield pa.RecordBatch.from_pydict({"at": pa.array(used, pa.int64()), "total": pa.array(total.ravel()[used], pa.int64())})

    return run


def _codes(books, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = books.value
        parts, _, width = book.shape
        for batch in batches:
            for k in range(batch.num_rows):
                c = _read(batch, k, parts, width, block)
                code, error = np.zeros((c["n"], parts), np.uint8), np.zeros(c["n"], np.int64)
                for p in range(parts):
                    entry, square = nearest(c["points"][p], shortlists(c["lows"][p], c["highs"][p], book[p]), book[p])
                    order = c["orders"][p]
                    code[order, p] = entry.ravel()[: c["n"]]
                    error[order] += square.ravel()[: c["n"]]
                digits = code.tobytes().hex()
                hexed = [digits[i : i + 2 * parts] for i in range(0, len(digits), 2 * parts)]
                own = {name: batch[name].slice(k, 1).flatten() for name in ("id", "label")}
                yield pa.RecordBatch.from_pydict({"id": own["id"], "code": pa.array(hexed, pa.string()), "error": pa.array(error), "label": own["label"]})

    return run


def first_entries(rows: DataFrame, parts: int, entries: int) -> np.ndarray | None:
    """The starting codebooks by part and entry: the parts of the smallest ids' vectors."""
    ids = [r[0] for r in rows.where("id is not null").select("id").distinct().orderBy("id").limit(entries).collect()]
    if not ids:
        return None
    chosen = rows.where(F.col("id").isin(ids)).groupBy("id").agg(F.min("vec").alias("vec")).orderBy("id").collect()
    x = whole(np.array([r["vec"] for r in chosen], np.float64))
    return x.reshape(len(x), parts, -1).transpose(1, 0, 2)


def compress(
    vectors: DataFrame,
    parts: int = 16,
    entries: int = 64,
    rounds: int = 2,
    block: int = BLOCK,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256``: one row per row with a usable vector.

    Components become floor(256 * x), within +-2^27. Codebooks start from the smallest ids' vectors;
    each round assigns all parts to the nearest entries and replaces entries by the floor of their
    parts' mean. Ties go to the lower entry, unused entries stay. Null, empty and non-finite vectors
    are dropped, as are vectors whose length differs from that of the smallest id with a usable vector
    of a length divisible by ``parts``. Repeated rows are coded and counted as often as they occur; of an
    id with several vectors the smallest starts the codebook; rows without an id start none (if no row
    has an id, there is no result). An empty table gives no rows. Label sums stop at the largest long.
    Other columns are ignored.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hexadecimal digits a part: 1 to 256 entries")
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).alias("vec")).where(usable(F.col("vec")))
    id_type, label_type = (rows.schema[c].dataType.simpleString() for c in ("id", "label"))
    rows = rows.where(F.size("vec") % parts == 0)
    least = rows.where("id is not null").agg(F.min_by(F.size("vec"), F.struct("id", "vec"))).first()[0]
    rows = rows.where(F.size("vec") == F.lit(least))
    book = first_entries(rows, parts, entries) if least else None
    if book is None:
        return spark.createDataFrame([], f"vec_id {id_type}, code string, error long, label_error long, codebooks_sha256 string")
    kinds = f"n int, {', '.join(f'{c} binary' for c in CHUNKED)}, id array<{id_type}>, label array<{label_type}>"
    chunks = scratch.save(rows.mapInArrow(_write(parts, block), kinds), "chunks")
    numbers = chunks.select("n", "points", "lows", "highs", "sums")
    width = book.shape[2]
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(book)
        totals = np.zeros((*book.shape[:2], width + 1), np.int64)
        for at, total in numbers.mapInArrow(_totals(shared, block), "at long, total long").groupBy("at").agg(F.sum("total")).collect():
            totals.reshape(-1)[at] = total
        counts = totals[:, :, width:]
        book = np.where(counts > 0, totals[:, :, :width] // np.maximum(counts, 1), book)
    shared = spark.sparkContext.broadcast(book)
    digest = hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()
    kinds = f"id {id_type}, code string, error long, label {label_type}"
    coded = scratch.save(chunks.mapInArrow(_codes(shared, block), kinds), "codes")
    scratch.drop(chunks)
    top = F.lit((1 << 63) - 1).cast("decimal(38,0)")
    sums = coded.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(20,0)")).cast("decimal(38,0)"), top).cast("long").alias("label_error"))
    sums = scratch.save(sums.withColumnRenamed("label", "of"), "labels")
    if sums.count() <= FEW_LABELS:
        sums = F.broadcast(sums)
    out = coded.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return out.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def compress_sql(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """The same over ``embeddings``, by distances to all entries."""
    steps = []
    for k in range(rounds + 1):
        steps.append(
            f"near{k} as (select i, p, e, d from (select r.i, r.p, b.e, list_sum(list_transform(list_zip(r.q, b.q), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) d,"
            f" row_number() over (partition by r.i, r.p order by d, b.e) n from parts r join book{k} b using (p)) where n = 1)"
        )
        if k < rounds:
            steps.append(
                f"moved{k} as (select p, e, list(m order by c) q from (select n.p, n.e, u.c, cast(floor(sum(r.q[u.c]) / count(*)) as bigint) m"
                f" from near{k} n join parts r using (i, p), (select unnest(range(1, 1 + (select max(len(q)) from parts))) c) u group by all) group by p, e)"
            )
            steps.append(f"book{k + 1} as (select b.p, b.e, coalesce(m.q, b.q) q from book{k} b left join moved{k} m using (p, e))")
    return f"""
with kept as (
  select vec_id, label, list_transform(embedding, lambda x: cast(floor(256 * x::double) as bigint)) q, row_number() over () i from embeddings
  where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
parts as (select i, p, q[p * len(q) // {parts} + 1 : (p + 1) * len(q) // {parts}] q from kept, (select unnest(range({parts})) p)),
book0 as (select p, e, r.q from parts r join (select i, row_number() over (order by vec_id) - 1 e from kept) using (i) where e < {entries}),
{", ".join(steps)},
done as (select i, string_agg(printf('%02x', e), '' order by p) code, cast(sum(d) as bigint) error from near{rounds} group by i),
sums as (select label, cast(sum(error) as bigint) label_error from kept join done using (i) group by label)
select vec_id, code, error, label_error,
  (select sha256(string_agg(x::varchar, ',' order by p, e, c)) from (select p, e, unnest(q) x, unnest(range(len(q))) c from book{rounds})) codebooks_sha256
from kept join done using (i) join sums on kept.label is not distinct from sums.label
"""
