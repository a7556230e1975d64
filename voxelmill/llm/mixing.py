"""Temperature mixing of sources: exponentiated token shares, realised as budgeted block permutations."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelmill.llm._spark import Scratch, fresh, running
from voxelmill.llm.packing import word_count

#: Exponents that one pass over the source totals tries; each pass halves the interval six times.
GRID = 64
PASSES = 6
#: Blocks are ordered in slices of their source's hash range: this many at least, and one for so many blocks.
SLICES, SLICE = 16, 50_000
#: Tables of sources or blocks up to so many rows are broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 100_000


@dataclass(frozen=True)
class Target:
    """What the exponent has to meet: at least this entropy (in bits), and at most so many repetitions.

    The budget is the least that shows every document once. With ``max_repeat`` the exponent is the
    smallest (flattest) in [0, 1] at which no source is repeated more often than that. With
    ``entropy`` it is the largest at which the weights have that entropy, but no flatter than
    ``max_repeat`` allows; where both can't be met, the limit of repetitions counts. With neither the
    weights are the sources' shares.
    """

    max_repeat: float | None = 2.0
    entropy: float | None = None


def source_totals(docs: DataFrame, tokens: Column) -> DataFrame:
    return docs.groupBy("source").agg(F.sum(tokens).alias("tokens"), F.count("*").alias("rows"))


def solve_exponent(totals: DataFrame, target: Target) -> float:
    """Bisect the exponent over [0, 1]; each pass is one aggregate over the table of source totals.

    Measures only need sums over sources, so the table stays distributed however many sources there
    are. Sources without tokens have no share and are left out. No sources: exponent 1.
    """
    live = totals.where("tokens > 0").select(F.col("tokens").cast("double").alias("t"))
    top = live.agg(F.max("t"), F.min("t")).first()
    if top[0] is None or (target.max_repeat is None and target.entropy is None):
        return 1.0
    least = 0.0
    if target.max_repeat is not None:
        # weight / tokens is largest for the smallest source, (min / max) ** (exponent - 1) times the largest's
        lo, least = 0.0, 1.0
        if (top[0] / top[1]) <= target.max_repeat:
            least = 0.0
        while least - lo > 64**-PASSES:
            middle = (lo + least) / 2
            lo, least = (lo, middle) if (top[1] / top[0]) ** (middle - 1) <= target.max_repeat else (middle, least)
    if target.entropy is None:
        return least
    lo, hi = 0.0, 1.0
    for _ in range(PASSES):
        grid = [lo + (hi - lo) * k / GRID for k in range(GRID + 1)]
        # shares relative to the largest source keep powers within (0, 1]
        power = [F.pow(F.col("t") / F.lit(top[0]), F.lit(a)) for a in grid]
        sums = live.agg(
            *[F.sum(p).alias(f"z{k}") for k, p in enumerate(power)],
            *[F.sum(p * F.log2(p)).alias(f"e{k}") for k, p in enumerate(power)],
        ).first()
        meets = [math.log2(sums[f"z{k}"]) - sums[f"e{k}"] / sums[f"z{k}"] >= target.entropy for k in range(GRID + 1)]
        last = max((k for k, x in enumerate(meets) if x), default=0)
        lo, hi = grid[last], grid[min(last + 1, GRID)]
    return max(lo, least)


def schedule(
    docs: DataFrame,
    target: Target = Target(),
    block_tokens: int = 10_000,
    seed: int = 29,
    text_col: str = "text",
    tokens: Column | None = None,
) -> DataFrame:
    """Schedule of the mixture: a row for each showing of a row of ``docs``.

    Returns the columns of ``docs`` and, with the prefix ``mix_`` (one more ``_`` before it as long as
    a column of ``docs`` starts so), ``tokens``, ``weight`` (of its source), ``epoch``, ``block`` and
    ``rank`` (place of the block in that epoch's permutation). ``tokens`` counts a row's tokens; by
    default the words of the whole text, however long, which are counted once.

    A source's budget is weight times total budget. Its rows are dealt by the hash of their id to
    blocks of about ``block_tokens`` tokens (or rows, where there are more of these); each epoch
    permutes the blocks, and blocks are taken whole until the budget is reached, the last one
    included. Every row appears in all whole epochs of its source. A null source is a source of its
    own. Rows of sources without tokens (null or empty texts only) appear once. Rows that repeat an
    id share a block and are shown equally often, and so do rows without an id that are alike in all columns. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession)
    p = fresh(docs, "mix_")
    count = word_count(F.col(text_col)) if tokens is None else tokens
    key = F.struct(F.col("source").isNull().alias("none"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("name"))
    own = [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]
    # rows without an id are told apart by all they hold (maps and variants can't be hashed)
    told = [c for c, (_, kind) in zip(own, docs.dtypes, strict=True) if "map<" not in kind and "variant" not in kind]
    hashed = F.when(F.col("doc_id").isNull(), F.xxhash64(*told, F.lit(seed))).otherwise(F.xxhash64("doc_id", F.lit(seed)))
    light = scratch.save(docs.select(key.alias("k"), hashed.alias("h"), count.alias("n")), "counted")
    totals = scratch.save(source_totals(light.withColumnRenamed("k", "source"), F.col("n")), "totals")
    alpha = solve_exponent(totals, target)
    live = totals.where("tokens > 0").select(F.col("tokens").cast("double").alias("t"))
    most, norm = live.agg(F.max("t"), F.sum(F.pow("t", F.lit(alpha)))).first()
    most, norm = most or 1.0, norm or 1.0
    plan = totals.select(
        F.col("source").alias("k"),
        F.col("tokens").alias("source_tokens"),
        (F.pow(F.col("tokens").cast("double"), F.lit(alpha)) / norm).alias("weight"),
        # tokens^alpha * most^(1 - alpha): weight times the budget that shows the largest source once
        F.round(F.pow(F.col("tokens").cast("double"), F.lit(alpha)) * F.lit(most ** (1 - alpha))).cast("long").alias("budget"),
        F.greatest(F.lit(1), F.expr(f"greatest(tokens, rows) div {block_tokens}")).cast("long").alias("n_blocks"),
    )
    few = totals.count() <= BROADCAST_ROWS
    blocks = (
        light.join(F.broadcast(plan) if few else plan, "k")
        .groupBy("k", "source_tokens", "weight", "budget", "n_blocks", F.pmod("h", "n_blocks").alias("block"))
        .agg(F.sum("n").alias("n"))
    )
    whole = F.expr("if(source_tokens > 0, budget div source_tokens, 1)")
    rest = F.expr("if(source_tokens > 0, budget % source_tokens, 0)")
    blocks = scratch.save(blocks.withColumns({"epochs": F.greatest(whole, F.lit(1)), "rest": F.when(whole >= 1, rest).otherwise(F.lit(0))}), "dealt")
    slices = F.greatest(F.lit(SLICES), F.expr(f"n_blocks div {SLICE}"))
    ranked = running(blocks, ["k"], F.xxhash64("block", F.lit(seed), "epochs"), ["block"], slices, {"before": F.col("n")})
    ranked = ranked.withColumn("shown", F.col("epochs") + (F.col("before") < F.col("rest")).cast("long"))
    epochs = ranked.select("k", "block", "weight", "n_blocks", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shown") - 1)).alias("epoch"))
    epochs = running(epochs, ["k", "epoch"], F.xxhash64("block", F.lit(seed), "epoch"), ["block"], slices, {"rank": F.lit(1).cast("long")})
    names = {"k": "k3", "block": "b3", "weight": "weight", "epoch": "epoch", "rank": "rank"}
    epochs = scratch.save(epochs.select(*[F.col(old).alias(p + new) for old, new in names.items()]), "blocks")
    small = epochs.count() <= BROADCAST_ROWS
    # from here on names start with the prefix, as the columns of docs may have any other
    counts = plan.select(F.col("k").alias(p + "k2"), F.col("n_blocks").alias(p + "n"))
    placed = docs.select(*own, key.alias(p + "k"), hashed.alias(p + "h"), count.alias(p + "tokens"))
    placed = placed.join(F.broadcast(counts) if few else counts, F.col(p + "k") == F.col(p + "k2")).withColumn(p + "block", F.pmod(p + "h", p + "n"))
    joined = placed.join(F.broadcast(epochs) if small else epochs, (F.col(p + "k") == F.col(p + "k3")) & (F.col(p + "block") == F.col(p + "b3")))
    return joined.select(*own, *[p + c for c in ("tokens", "weight", "epoch", "block", "rank")])


def mix(docs: DataFrame, target: Target = Target(), block_tokens: int = 10_000, seed: int = 29) -> DataFrame:
    """The showings of ``schedule`` with the columns of ``docs`` alone."""
    return schedule(docs, target, block_tokens, seed).select(*["`" + c.replace("`", "``") + "`" for c in docs.columns])
