"""Reproducible shuffles into shards by a Feistel permutation of global row numbers.

Only DataFrame functions: a global sort gives each row its number, the permutation sends number
``x`` to ``y``, and the row goes to shard ``y mod shards`` at slot ``y div shards``. Shard and slot
of any row number can be computed without the data.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelmill.llm._spark import Scratch

ROUNDS = 4


def _round_value(seed: int, k: int, half: Column, modulus: int) -> Column:
    """A keyed 60-bit digest of one half, reduced to the other half's range."""
    digest = F.md5(F.concat(F.lit(f"{seed}:{k}:"), half.cast("string")))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % F.lit(modulus)


def sides(n: int) -> tuple[int, int]:
    """The two radices of the Feistel halves: the smallest near-square grid of at least n cells."""
    a = max(1, math.isqrt(max(n, 1) - 1) + 1)
    return a, max(1, -(-max(n, 1) // a))


def feistel(x: Column, n: int, seed: int) -> Column:
    """One pass of the permutation of ``0 .. a*b-1``, where a*b is at least n."""
    a, b = sides(n)
    right = x % F.lit(b)
    left = F.call_function("div", x, F.lit(b))
    for k in range(ROUNDS):
        if k % 2 == 0:
            left = (left + _round_value(seed, k, right, a)) % F.lit(a)
        else:
            right = (right + _round_value(seed, k, left, b)) % F.lit(b)
    return left * F.lit(b) + right


def permute(df: DataFrame, n: int, seed: int, scratch: Scratch) -> DataFrame:
    """``pi``: the place of ``row_no`` under the permutation of 0 .. n-1, by cycle walking.

    The grid exceeds n by less than its side, so few rows fall outside, and these walk on until
    they are inside. Each walk is a step of the same expression on those rows alone.
    """
    done = df.withColumn("pi", feistel(F.col("row_no"), n, seed))
    a, b = sides(n)
    if a * b == n:
        return done
    walking = scratch.save(done.where(F.col("pi") >= n), "walk")
    inside = done.where(F.col("pi") < n)
    while walking.limit(1).count():
        walking = scratch.save(walking.withColumn("pi", feistel(F.col("pi"), n, seed)), "walk")
        inside = inside.unionByName(walking.where(F.col("pi") < n))
        walking = walking.where(F.col("pi") >= n)
    return inside


def number_rows(df: DataFrame, order: list[str], scratch: Scratch) -> tuple[DataFrame, int]:
    """``row_no``: gapless numbers from 0 in the order of the given columns, and the row count.

    The sort writes one table; a row's number is its place in its partition plus the rows of the
    partitions before it. Only one count per partition is summed, never a global window.
    """
    # rows alike in all columns of the order are spread by where they come from, so no partition holds all of them
    spread = df.withColumn("_mid", F.monotonically_increasing_id()).sort(*order, "_mid")
    sorted_rows = scratch.save(spread.withColumn("_mid", F.monotonically_increasing_id()), "numbered")
    part, place = F.shiftright("_mid", 33).alias("_part"), F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    counts = sorted_rows.groupBy(part).agg(F.count("*").alias("n")).orderBy("_part").collect()
    before, total = [], 0
    for r in counts:  # one entry for each partition of the sort
        before.append((r["_part"], total))
        total += r["n"]
    offsets = F.broadcast(df.sparkSession.createDataFrame(before, "_part int, _before long"))
    numbered = sorted_rows.withColumn("_part", part.cast("int")).join(offsets, "_part")
    return numbered.select(*df.columns, (F.col("_before") + place).alias("row_no")), total


def shard(docs: DataFrame, shards: int = 24, seed: int = 17, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row with its shard and slot; rows are spread so that shard counts differ by one at most.

    Rows are numbered by id, then size and checksum of the text; rows alike in all of these are
    interchangeable. Null texts count as empty (size 8, checksum 0); null ids come first. Repeated rows
    are numbered one by one. An empty table gives no rows. Other columns are ignored, so clashing
    names don't matter. ``grown_shard`` is null: this law moves rows when shards are added.
    """
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 8).alias("size"),
        F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    numbered, n = number_rows(rows, ["doc_id", "size", "text_crc32"], scratch)
    placed = permute(numbered, n, seed, scratch)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        (F.col("pi") % shards).cast("int").alias("shard"),
        F.call_function("div", "pi", F.lit(shards)).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def shard_of(row_no: int, n: int, shards: int = 24, seed: int = 17) -> tuple[int, int]:
    """Shard and slot of one row number, computed without the data."""
    import hashlib

    a, b = sides(n)
    x = row_no
    while True:
        left, right = divmod(x, b)
        for k in range(ROUNDS):
            half, m = (right, a) if k % 2 == 0 else (left, b)
            v = int(hashlib.md5(f"{seed}:{k}:{half}".encode()).hexdigest()[:15], 16) % m
            left, right = ((left + v) % a, right) if k % 2 == 0 else (left, (right + v) % b)
        x = left * b + right
        if x < n:
            return x % shards, x // shards
