"""Length buckets that minimise padding, and token-budget batches inside each bucket."""

from __future__ import annotations

import bisect

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelmill.llm._spark import Scratch, running

#: A bucket is ordered in slices of its rows' hash: this many at least, and one for so many rows in all.
SLICES, SLICE = 64, 50_000
#: Turns whose batches are told to every executor; a later turn has less than this part of all rows.
FIRST_TURNS = 1000


def word_count(text: Column) -> Column:
    """Words of a text between ASCII white space; 0 for null or blank texts.

    Where words are one blank apart, counting blanks is enough; only other texts need the pattern.
    """
    blank = F.coalesce(text, F.lit(""))
    for c in "\t\n\x0b\x0c\r":
        blank = F.replace(blank, F.lit(c), F.lit(" "))

    def count(t: Column) -> Column:
        single = F.octet_length(t) - F.octet_length(F.replace(t, F.lit(" "))) + 1
        return F.when(t == "", 0).when(F.contains(t, F.lit("  ")), F.regexp_count(t, F.lit("[^ ]+"))).otherwise(single)

    # the array makes the trimmed text one value, computed once
    return F.transform(F.array(F.trim(blank)), count)[0].cast("long")


def optimal_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` runs of ascending lengths with the least total padding.

    ``cost(i, j) = lengths[j] * count(i..j)`` is the padded size of a bucket from i to j; the sizes
    before padding don't depend on the bounds. One row of the table per bucket. The cost satisfies
    the quadrangle inequality, so the best cut never falls as j rises and a row takes O(h log h): the
    middle of every open range of j is solved at once, and its cut bounds those on either side.
    """
    h = len(lengths)
    if not h:
        return []
    lengths = lengths.astype(np.int64)
    total = np.concatenate([[0], np.cumsum(counts.astype(np.int64))])
    best = lengths * total[1:]
    back = []
    for _ in range(1, min(buckets, h)):
        new, cut = best.copy(), np.full(h, -1)
        # open ranges of j, and the cuts that they may have
        first, last, low, high = (np.array([x]) for x in (1, h - 1, 0, h - 2))
        while len(first):
            j = (first + last) // 2
            top = np.minimum(high, j - 1)
            size = top - low + 1
            start = np.cumsum(size) - size
            of = np.repeat(np.arange(len(j)), size)
            i = np.arange(len(of)) - start[of] + low[of]
            costs = best[i] + lengths[j[of]] * (total[j[of] + 1] - total[i + 1])
            least = np.minimum.reduceat(costs, start)
            hit = np.flatnonzero(costs == least[of])
            where = i[hit[np.searchsorted(hit, start)]]  # the first of the cheapest cuts
            better = least < new[j]
            new[j[better]], cut[j[better]] = least[better], where[better]
            first, last = np.concatenate([first, j + 1]), np.concatenate([j - 1, last])
            low, high = np.concatenate([low, where]), np.concatenate([where, high])
            left = first <= last
            first, last, low, high = first[left], last[left], low[left], high[left]
        back.append(cut)
        best = new
    bounds, j = [], h - 1
    for cut in reversed(back):
        if cut[j] >= 0:
            bounds.append(int(lengths[j]))
            j = cut[j]
    return [*bounds, int(lengths[j])][::-1]


def _turns(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """``turn``: how often a row's id has come before; 0 for rows without an id."""
    again = rows.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("times")).where("times > 1")
    again = scratch.save(again, "again")
    slices = F.greatest(F.lit(1), F.expr(f"times div {SLICE}"))
    counted = running(rows.join(again, "doc_id"), ["doc_id"], F.xxhash64("row"), ["row"], slices, {"turn": F.lit(1).cast("long")})
    counted = counted.select(*rows.columns, "turn")
    return rows.join(again, "doc_id", "left_anti").withColumn("turn", F.lit(0).cast("long")).unionByName(counted)


def pack(
    docs: DataFrame,
    buckets: int = 12,
    token_budget: int = 65_536,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: Column | None = None,
) -> DataFrame:
    """``doc_id, n_tokens, bucket, padded_len, batch, slot``: one row per row of ``docs``.

    The bounds are optimal for the histogram of all lengths, one entry for each. The driver holds it:
    d distinct lengths need d * d / 2 tokens in all, so 10^13 tokens have 4.5 million at most. A batch
    is ``budget div padded_len`` rows of one bucket (one at least, so that texts beyond the budget
    still go somewhere), numbered in an order that hashes ids. Rows that repeat an id take turns, and
    every turn has batches of its own, so no batch holds a document twice. Places in a bucket are counted
    by slices of the hash, never by ordering a whole bucket. Null and empty texts have length 0 and go
    to the first bucket; texts are counted whole, however long. Ties, repeated rows and rows without an
    id are ordered by their place in the table. An empty table gives no rows. Other columns, whatever
    their names, are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    n = word_count(F.col(text_col)) if length is None else length
    rows = docs.select(F.col(id_col).alias("doc_id"), n.alias("n_tokens"), F.monotonically_increasing_id().alias("row"))
    rows = scratch.save(rows, "lengths")
    hist = rows.groupBy("n_tokens").agg(F.count("*").alias("n")).toArrow().sort_by("n_tokens")
    lengths, counts = (hist.column(c).to_numpy() for c in ("n_tokens", "n"))
    bounds = optimal_bounds(lengths, counts, buckets)
    cases = [(F.col("n_tokens") <= b, k, b) for k, b in enumerate(bounds)]
    bucket = F.coalesce(*[F.when(c, F.lit(k)) for c, k, _ in cases]) if cases else F.lit(0)
    padded = F.coalesce(*[F.when(c, F.lit(b).cast("long")) for c, _, b in cases]) if cases else F.lit(0).cast("long")
    dealt = _turns(rows, scratch).withColumns({"bucket": bucket, "padded_len": padded})
    per_batch = F.greatest(F.lit(1), F.expr(f"{token_budget} div greatest(padded_len, 1)")).cast("long")
    # rows of a turn have ids of their own, but for rows without an id
    own = F.when(F.col("doc_id").isNull(), F.xxhash64(F.lit(1), "row")).otherwise(F.xxhash64("doc_id", F.lit(1)))
    slices = max(SLICES, int(counts.sum()) // SLICE)
    placed = running(dealt, ["bucket", "padded_len", "turn"], own, ["doc_id", "row"], slices, {"place": F.lit(1).cast("long")})
    turns = dealt.groupBy("bucket", "padded_len", "turn").agg(F.ceil(F.count("*") / per_batch).cast("long").alias("batches"))
    before = running(turns, ["bucket"], F.xxhash64("turn"), ["turn"], slices, {"before": F.col("batches")}).select("bucket", "turn", "before")
    before = scratch.save(before, "turns")
    early = placed.where(F.col("turn") < FIRST_TURNS).join(F.broadcast(before.where(F.col("turn") < FIRST_TURNS)), ["bucket", "turn"])
    late = placed.where(F.col("turn") >= FIRST_TURNS).join(before.where(F.col("turn") >= FIRST_TURNS), ["bucket", "turn"])
    return early.unionByName(late).select(
        "doc_id",
        "n_tokens",
        "bucket",
        "padded_len",
        (F.col("before") + F.call_function("div", "place", per_batch)).alias("batch"),
        (F.col("place") % per_batch).alias("slot"),
    )


def bucket_of(bounds: list[int], n: int) -> int:
    """The bucket of a length; the plain rule that the query's column follows."""
    return bisect.bisect_left(bounds, n)
