"""Exact Jaccard self-join of word shingles by token-combination prefixes.

Tokens (shingles) have one global order: rare ones first, then uncounted ones, then frequent ones,
by digest within each. A document of n tokens may miss ``t = n - ceil(s n)`` of them in a partner.
Its prefix is extended until ``single tokens + sum over groups of (tokens - k + 1) > t``: then two
similar documents share a rare token of both prefixes or k tokens of one group, since each group
they match in fewer than k tokens leaves all but k - 1 of its prefix tokens unmatched. So rare
tokens are indexed one by one, and groups of the other classes by k-token combinations.

Candidates are verified on whole sets. Copies are compared with one leader first; what is already
in one component isn't compared again. Combinations that many documents share mark clusters, whose
documents are compared by blocks inside tasks; only the edges of spanning stars leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelmill.llm._shingles import mix, shingles
from voxelmill.llm._spark import Scratch, components

#: A third of all tokens, by digest, are counted; the rest are a class of unknown frequency.
COUNTED = np.uint64(3)
#: Counted tokens in more documents than this are frequent.
RARE = 32
#: Frequent tokens are sent to tasks as a table of bits: so many bits for each, and 2^30 (128 MB) at most.
#: A rare token that meets a set bit is taken for a frequent one; any fixed split of tokens into classes
#: keeps the join exact.
BITS_PER_TOKEN, MOST_BITS, CHUNK_BITS = 16, 30, 23
#: A class of copies with more than this part of all rows is told to every executor (so many at most); others are joined by a shuffle.
HOT_CLASSES = 250_000
#: Ids, and ends of pairs, up to so many are broadcast to the scan of texts (about 50 MB); more are joined by a shuffle.
MAX_BROADCAST_IDS, MAX_BROADCAST_ENDS = 2_000_000, 1_000_000
#: Partners of a document that one row of its routes names, at most; a document of more has several rows.
ROUTES = 4096
#: Documents and tokens of a block that a task compares with another, and members sent with one copy of a leader.
BLOCK, BLOCK_TOKENS, SALT = 256, 2_000_000, 256
#: Token combinations of uncounted and of frequent tokens, and documents too short for groups (by level).
K_UNCOUNTED, K_FREQUENT, SINGLES_BELOW = 2, 3, 4


@dataclass(frozen=True)
class Rule:
    """Similar if ``den * intersection >= num * union``."""

    num: int = 80
    den: int = 100
    width: int = 5

    def missing(self, n):
        """Tokens of a set of n that a similar partner may lack."""
        return n - -(-(self.num * n) // self.den)

    def fits(self, a, b):
        """Sizes that similar sets can have."""
        return (self.den * np.minimum(a, b)) >= (self.num * np.maximum(a, b))


def _arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "boolean": pa.bool_()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")])


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def _pieces(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    for k in range(0, batch.num_rows, rows):
        yield batch.slice(k, rows)


SET_SCHEMA = "doc_id long, n long, d1 long, d2 long, counted array<long>"


def token_sets(docs: DataFrame, rule: Rule) -> DataFrame:
    """Size, 128-bit digest and counted tokens of every document's set."""
    schema, width = _arrow(SET_SCHEMA), rule.width

    def run(batches):
        for big in batches:
            for batch in _pieces(big, 512):
                sets = list(shingles(batch.column("text").to_pylist(), width))
                d1 = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64)
                d2 = np.array([mix(s).sum(dtype=np.uint64) for s in sets], np.uint64)
                counted = [_signed(s[s % COUNTED == 0]) for s in sets]
                ends = np.concatenate([[0], np.cumsum([len(c) for c in counted])]).astype(np.int32)
                flat = np.concatenate(counted) if counted else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(_signed(d1)),
                        pa.array(_signed(d2)),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
                    ],
                    schema=schema,
                )

    return docs.select("doc_id", "text").mapInArrow(run, SET_SCHEMA)


@dataclass(frozen=True)
class Often:
    """The class of frequent tokens: a table of bits, indexed by the leading bits of a token."""

    bits: np.ndarray

    def __contains__(self, token: int) -> bool:
        return bool(self.of(np.array([token], np.uint64))[0])

    def of(self, tokens: np.ndarray) -> np.ndarray:
        at = tokens >> np.uint64(64 - (8 * len(self.bits)).bit_length() + 1)
        return (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1


def frequent_tokens(sets: DataFrame, scratch: Scratch) -> Often:
    """Counted tokens in more than ``RARE`` documents, as bits: the driver gets the table of bits alone."""
    counts = scratch.save(
        sets.select(F.explode("counted").alias("token")).groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") > RARE).select("token"),
        "frequent",
    )
    wide = min(MOST_BITS, max(10, (BITS_PER_TOKEN * counts.count()).bit_length()))
    chunk = min(wide, CHUNK_BITS)
    at = F.shiftrightunsigned("token", 64 - wide)
    words = counts.groupBy(F.shiftright(at, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(token, {64 - wide}) & 63 as int))")).alias("set"))

    def pack(pdf):
        import pandas as pd

        out = np.zeros((1 << chunk) // 64, "<i8")
        out[pdf["word"].to_numpy() % len(out)] = pdf["set"]
        return pd.DataFrame({"chunk": pdf["chunk"].iloc[:1], "bits": [out.tobytes()]})

    chunks = words.withColumn("chunk", F.shiftright("word", chunk - 6)).groupBy("chunk").applyInPandas(pack, "chunk long, bits binary").collect()
    scratch.drop(counts)
    bits = np.zeros((1 << wide) // 8, np.uint8)
    for r in chunks:  # at most 2^(MOST_BITS - CHUNK_BITS) chunks
        bits[r["chunk"] * (1 << chunk) // 8 : (r["chunk"] + 1) * (1 << chunk) // 8] = np.frombuffer(r["bits"], np.uint8)
    return Often(bits)


#: One more token in so many is indexed beyond the shortest prefix, and as many more have to be shared.
EXTRA = 20
POSTING = "sig long, doc_id long, n long, spare long"


def rare_postings(sets: DataFrame, frequent, rule: Rule, hard: bool) -> DataFrame:
    """Index entries of the rare tokens of prefixes; or (``hard``) ids of documents that have too few.

    A prefix is longer than it must be by ``spare - 1`` tokens, as far as rare ones last. Of two
    similar documents, that with the earlier end of its prefix misses no more tokens than it may, so
    both share the lesser spare at least.
    """
    schema = _arrow("doc_id long" if hard else POSTING)

    def run(batches):
        table = frequent.value
        for batch in batches:
            ids, n = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            lists = batch.column(2)
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            tokens = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            of = np.repeat(np.arange(len(ids)), sizes)
            rare = ~table.of(tokens)
            tokens, of = tokens[rare], of[rare]
            have = np.bincount(of, minlength=len(ids))
            may = rule.missing(n)
            if hard:
                yield pa.RecordBatch.from_arrays([pa.array(ids[have <= may])], schema=schema)
                continue
            take = np.minimum(have, may + 1 + n // EXTRA)
            spare = np.maximum(take - may, 1)
            rank = np.arange(len(of)) - (np.cumsum(have) - have)[of]
            keep = rank < take[of]
            of = of[keep]
            cols = [_signed(tokens[keep]), ids[of], n[of], spare[of]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], schema=schema)

    return sets.select("doc_id", "n", "counted").mapInArrow(run, "doc_id long" if hard else POSTING)


BUCKET = "sig long, size long, leader long, leader_n long, leader_spare long, doc_id long, n long, spare long"


def bucket_rows(postings: DataFrame, partitions: int) -> DataFrame:
    """Each further member of a bucket of two documents or more, with the bucket's leader (smallest id).

    Only for buckets of a bounded size: a task holds one partition of the index.
    """
    schema = _arrow(BUCKET)

    def run(batches):
        parts = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches if b.num_rows]
        if not parts:
            return
        sig, doc, n, spare = (np.concatenate([p[k] for p in parts]) for k in range(4))
        del parts
        order = np.lexsort((n, doc, sig))
        sig, doc, n, spare = sig[order], doc[order], n[order], spare[order]
        fresh = np.concatenate([[True], (sig[1:] != sig[:-1])])
        # a repeated row of an id; its rows of other sizes are other sets
        again = np.concatenate([[False], (doc[1:] == doc[:-1]) & (n[1:] == n[:-1]) & ~fresh[1:]])
        sig, doc, n, spare, fresh = sig[~again], doc[~again], n[~again], spare[~again], fresh[~again]
        start = np.maximum.accumulate(np.where(fresh, np.arange(len(sig)), 0))
        group = np.cumsum(fresh) - 1
        size = np.bincount(group)[group]
        keep = ~fresh
        lead = start[keep]
        cols = [sig[keep], size[keep], doc[lead], n[lead], spare[lead], doc[keep], n[keep], spare[keep]]
        for k in range(0, len(lead), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[k : k + 100_000].astype(np.int64)) for c in cols], schema=schema)

    return postings.repartition(partitions, "sig").mapInArrow(run, BUCKET)


def _level(n: int) -> int:
    return int(n).bit_length() - 1


def schemes(n: int, rule: Rule) -> list[int]:
    """Levels whose grouping a set of n tokens has to follow: its own, and that of the least partner."""
    least = -(-(rule.num * n) // rule.den)
    return sorted({_level(n), _level(max(least, 1))})


def combination_signatures(tokens: np.ndarray, frequent: Often, rule: Rule, level: int) -> np.ndarray:
    """Signatures of the classes after the rare one, for the grouping of one level."""
    n = len(tokens)
    counted = tokens % COUNTED == 0
    often = np.zeros(n, bool)
    often[counted] = frequent.of(tokens[counted])
    rest = np.concatenate([tokens[~counted], tokens[often]])
    k = np.where(np.arange(len(rest)) < np.count_nonzero(~counted), K_UNCOUNTED, K_FREQUENT)
    groups = max(1, (1 << level) // 8)
    if level < SINGLES_BELOW:
        k[:] = 1
    group = (mix(rest) % np.uint64(groups)).astype(np.int64) * 8 + k
    order = np.argsort(group, kind="stable")
    ordered = group[order]
    fresh = np.concatenate([[True], ordered[1:] != ordered[:-1]]) if len(ordered) else np.zeros(0, bool)
    rank = np.empty(len(rest), np.int64)
    rank[order] = np.arange(len(rest)) - np.maximum.accumulate(np.where(fresh, np.arange(len(rest)), 0))
    gain = np.cumsum(rank >= k - 1)
    need = rule.missing(n) + 1 - np.count_nonzero(counted & ~often)
    size = int(np.searchsorted(gain, need)) + 1  # the shortest prefix that gains enough
    assert size <= len(rest), (n, level)
    rest, group = rest[:size], group[:size]
    out = []
    for g in np.unique(group):
        own, width = np.sort(rest[group == g]), int(g % 8)
        if len(own) < width:
            continue
        picks = np.fromiter((x for c in combinations(range(len(own)), width) for x in c), np.int64, comb(len(own), width) * width)
        value = np.full(len(picks) // width, np.uint64(level * 1009 + g))
        for j in range(width):
            value = mix(value * np.uint64(0x9E3779B97F4A7C15) + own[picks[j::width]])
        out.append(value)
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


HARD = "doc_id long, n long, tokens binary, sigs array<long>"


def _once(rows: DataFrame, several: DataFrame | None, *told: str) -> DataFrame:
    """``rows`` with those of ids that have several once for each value of the columns ``told``."""
    if several is None:
        return rows
    many = _keep_ids(rows, several, "left_semi").dropDuplicates(["doc_id", *told])
    return _keep_ids(rows, several, "left_anti").unionByName(many)


def hard_sets(docs: DataFrame, frequent, rule: Rule) -> DataFrame:
    """Whole sets and combination signatures of documents with too few rare tokens."""
    schema = _arrow(HARD)

    def run(batches):
        table = frequent.value
        for big in batches:
            for batch in _pieces(big, 64):
                sets = list(shingles(batch.column("text").to_pylist(), rule.width))
                sigs = [
                    np.unique(np.concatenate([combination_signatures(s, table, rule, v) for v in schemes(len(s), rule)])) if len(s) else s
                    for s in sets
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([s.tobytes() for s in sets], pa.binary()),
                        pa.array([_signed(s) for s in sigs], pa.list_(pa.int64())),
                    ],
                    schema=schema,
                )

    return docs.select("doc_id", "text").mapInArrow(run, HARD)


def _keep_ids(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Semi or anti join on the columns of ``ids``; they are broadcast only when few."""
    few = ids.count() <= MAX_BROADCAST_IDS // len(ids.columns)
    return docs.join(F.broadcast(ids) if few else ids, ids.columns, how)


def _join_classes(rows: DataFrame, classes: DataFrame, hot: Column) -> DataFrame:
    """``rows`` joined with their classes of copies; the rows of hot classes stay where they are.

    ``hot`` is a condition on ``classes`` that no more than ``HOT_CLASSES`` of them meet.
    """
    key = ["n", "d1", "d2"]
    more = [c for c in classes.columns if c not in key]
    met = rows.join(F.broadcast(classes.where(hot).select(*key, F.lit(True).alias("_hot"), *more)), key, "left")
    own = met.where("_hot").drop("_hot")
    return own.unionByName(met.where("_hot is null").select(*rows.columns).join(classes.where(~hot), key))


def verify(pairs: DataFrame, docs: DataFrame, rule: Rule, partitions: int, scratch: Scratch) -> DataFrame:
    """The similar ones of distinct ``pairs(leader, doc_id)`` as edges ``a, b``.

    Sets are computed from the texts once for each document and sent to where their leaders are;
    a leader goes once to each ``SALT`` of its members.
    """
    counts = pairs.groupBy("leader").agg(F.ceil(F.count("*") / SALT).cast("long").alias("salts"))
    members = pairs.join(counts, "leader").select(
        "doc_id", F.struct("leader", F.pmod(F.xxhash64("doc_id"), F.col("salts")).alias("salt"), F.lit(1).cast("long").alias("last")).alias("r")
    )
    leaders = counts.select(
        F.col("leader").alias("doc_id"), F.struct("leader", F.lit(-1).cast("long").alias("salt"), F.col("salts").alias("last")).alias("r")
    )
    ends = scratch.save(members.unionByName(leaders), "ends")
    heavy = ends.groupBy("doc_id").agg(F.ceil(F.count("*") / ROUTES).cast("long").alias("lots")).where("lots > 1")
    lot = F.pmod(F.xxhash64("r.leader", "r.salt"), F.coalesce("lots", F.lit(1).cast("long"))).alias("lot")
    routes = ends.join(heavy, "doc_id", "left").select("doc_id", lot, "r").groupBy("doc_id", "lot").agg(F.collect_list("r").alias("routes"))
    routes = scratch.save(routes.select("doc_id", "routes"), "routes")
    few = ends.count() <= MAX_BROADCAST_ENDS
    routed = docs.select("doc_id", "text").join(F.broadcast(routes) if few else routes, "doc_id")

    def add_sets(batches):
        for big in batches:
            for batch in _pieces(big):
                sets = [s.tobytes() for s in shingles(batch.column("text").to_pylist(), rule.width)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("routes"), pa.array(sets, pa.binary())], names=["doc_id", "routes", "tokens"]
                )

    kind = routes.schema["routes"].dataType.simpleString()
    each = routed.select("doc_id", "routes", "text").mapInArrow(add_sets, f"doc_id long, routes {kind}, tokens binary")
    each = each.select("doc_id", "tokens", F.explode("routes").alias("r"))
    each = each.select(
        F.col("r.leader").alias("leader"),
        F.explode(F.when(F.col("r.salt") < 0, F.sequence(F.lit(0).cast("long"), F.col("r.last") - 1)).otherwise(F.array("r.salt"))).alias("salt"),
        (F.col("r.salt") >= 0).cast("int").alias("member"),
        "doc_id",
        "tokens",
    )
    dealt = each.repartition(partitions, "leader", "salt").sortWithinPartitions("leader", "salt", "member", "doc_id")

    def compare(batches):
        key, lead, told, last, seen = None, [], set(), None, set()
        for big in batches:
            for batch in _pieces(big, 4096):
                a, b = [], []
                cols = (batch.column(k).to_pylist() for k in range(4))
                for (leader, salt, member, doc), raw in zip(zip(*cols, strict=True), batch.column(4), strict=True):
                    tokens = np.frombuffer(raw.as_buffer(), np.uint64)
                    if (leader, salt) != key:
                        key, lead, told, last = (leader, salt), [], set(), None
                    if not member:  # more than one where an id has several sets
                        if (own := raw.as_py()) not in told:
                            told.add(own)
                            lead.append(tokens)
                        continue
                    if last is not None and last[0] == doc:  # an id's further rows are compared once for each set
                        seen = seen or {last[1].as_py()}
                        if (own := raw.as_py()) in seen:
                            continue
                        seen.add(own)
                    else:
                        last, seen = (doc, raw), set()
                    for x in lead:
                        if rule.fits(len(x), len(tokens)):
                            both = len(np.intersect1d(x, tokens, assume_unique=True))
                            if rule.den * both >= rule.num * (len(x) + len(tokens) - both):
                                a.append(leader)
                                b.append(doc)
                                break
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return scratch.save(dealt.mapInArrow(compare, "a long, b long"), "links")


def _star_edges(ids: np.ndarray, similar: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges to the smallest id of each component of a boolean matrix of links."""
    label = ids.copy()
    while True:
        low = np.where(similar, label[None, :], np.iinfo(np.int64).max).min(1)
        new = np.minimum(label, low)
        if (new == label).all():
            return ids[new != ids], new[new != ids]
        label = new


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sorted sets, by products of incidence matrices."""
    flat = np.concatenate([*left, *right]) if left or right else np.zeros(0, np.uint64)
    _, index, times = np.unique(flat, return_inverse=True, return_counts=True)
    of = np.repeat(np.arange(len(left) + len(right)), [len(s) for s in (*left, *right)])
    shared = np.flatnonzero(times > 1)
    column = np.full(len(times), -1)
    column[shared] = np.arange(len(shared))
    column = column[index]
    of, column = of[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    of, column = of[order], column[order]
    total = np.zeros((len(left), len(right)), np.float32)
    for start in range(0, len(shared), 8192):
        a, b = np.searchsorted(column, [start, start + 8192])
        m = np.zeros((len(left) + len(right), 8192), np.float32)
        m[of[a:b], column[a:b] - start] = 1
        total += m[: len(left)] @ m[len(left) :].T
    return total.astype(np.int64)


def _compare_blocks(ids, sets, side, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """Star edges of the links between documents of side 0 and side 1 (or among all where side is None)."""
    ids = np.asarray(ids, np.int64)
    if side is None:
        left = right = np.arange(len(ids))
    else:
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    if not len(left) or not len(right):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    n = np.array([len(s) for s in sets])
    both = _overlaps([sets[k] for k in left], [sets[k] for k in right])
    ok = rule.den * both >= rule.num * (n[left][:, None] + n[right][None, :] - both)
    if side is None:
        return _star_edges(ids, ok)
    similar = np.zeros((len(ids), len(ids)), bool)
    similar[np.ix_(left, right)] = ok
    return _star_edges(ids, similar | similar.T)


def _block_edges(rows: DataFrame, keys: list[str], rule: Rule, sided: bool) -> DataFrame:
    def run(pdf):
        import pandas as pd

        sets = [np.frombuffer(x, np.uint64) for x in pdf["tokens"]]
        a, b = _compare_blocks(pdf["doc_id"].to_numpy(), sets, pdf["side"].to_numpy() if sided else None, rule)
        return pd.DataFrame({"a": a, "b": b})

    return rows.groupBy(*keys).applyInPandas(run, "a long, b long")


def cluster_links(hard: DataFrame, heavy: DataFrame, links: DataFrame, rule: Rule, scratch: Scratch) -> DataFrame:
    """Links among documents that share a combination with many others.

    ``heavy(sig, leader)`` are the crowded combinations. Documents they connect form a cluster.
    First random blocks of a cluster are compared within; then every document outside the cluster's
    largest component so far is compared with all blocks of the cluster. Pairs within a component
    need no comparison, and any other pair has one document outside the largest.
    """
    spark = hard.sparkSession
    if not heavy.limit(1).count():
        return spark.createDataFrame([], "a long, b long")
    stars = hard.select(F.explode("sigs").alias("sig"), "doc_id").join(heavy, "sig").select(F.col("doc_id").alias("a"), F.col("leader").alias("b"))
    cluster = scratch.save(components(stars.distinct(), scratch).select(F.col("node").alias("doc_id"), F.col("component").alias("cluster")), "clusters")
    members = scratch.save(hard.select("doc_id", "n", "tokens").join(cluster, "doc_id"), "members")
    sizes = members.groupBy("cluster").agg(
        F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_TOKENS)).cast("long").alias("blocks")
    )
    sizes = scratch.save(sizes, "sizes")
    sized = members.join(sizes, "cluster")
    blocked = sized.withColumn("block", F.pmod(F.xxhash64("doc_id", "tokens"), F.col("blocks")))
    within = scratch.save(_block_edges(blocked.select("cluster", "block", "doc_id", "tokens"), ["cluster", "block"], rule, False), "within")
    found = components(links.unionByName(within), scratch).select(F.col("node").alias("doc_id"), "component")
    state = scratch.save(
        members.select("doc_id", "cluster").join(found, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id")), "state"
    )
    by = state.groupBy("cluster", "component").agg(F.count("*").alias("m"))
    largest = by.groupBy("cluster").agg(F.max_by("component", F.struct("m", "component")).alias("largest"))
    outside = scratch.save(state.join(largest, "cluster").where("component != largest").select("doc_id").distinct(), "outside")
    out = blocked.join(outside, "doc_id")
    counts = out.groupBy("cluster").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("lots"))
    counts = scratch.save(counts, "lots")
    if not counts.limit(1).count():
        return within
    lots = (
        out.join(counts, "cluster")
        .withColumn("lot", F.pmod(F.xxhash64("doc_id", "tokens", F.lit(7)), F.col("lots")))
        .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select("cluster", "lot", "block", "doc_id", "tokens", F.lit(0).alias("side"))
    )
    all_of = (
        blocked.join(counts, "cluster")
        .withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("lots") - 1)))
        .select("cluster", "lot", "block", "doc_id", "tokens", F.lit(1).alias("side"))
    )
    across = scratch.save(_block_edges(lots.unionByName(all_of), ["cluster", "lot", "block"], rule, True), "across")
    return within.unionByName(across)


def _partitions(spark: SparkSession, rows: int) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // 1_000_000)


def near_duplicates(
    docs: DataFrame, rule: Rule = Rule(), id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None
) -> DataFrame:
    """``doc_id, n_shingles, component_id``: one row per row of ``docs``.

    Two documents link at ``den * intersection >= num * union`` of their shingle sets, and the
    component is the smallest id reached by links, the own id included. Texts are compared whole, however
    long; a task holds the sets of a few hundred texts at once. Null and empty texts and
    texts without words have no shingles and link with nothing. Rows that repeat an id are parts of
    one node: each has its own set, and their component is the id's; equal rows of an id are compared once. Rows without an id aren't
    compared; their component is null. An empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sets = scratch.save(token_sets(docs, rule), "sets")
    meta = sets.select("doc_id", "n", "d1", "d2")
    total = sets.agg(F.sum("n"), F.count("*")).first()
    partitions = _partitions(spark, (total[0] or 0) // 5)

    # equal sets: one document stands for them
    live = meta.where("n > 0 and doc_id is not null")
    classes = scratch.save(live.groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("m")), "classes")
    hot = F.col("m") > max(1, (total[1] or 0) // HOT_CLASSES)
    copied = _join_classes(live, classes.where("m > 1"), hot)
    spare = scratch.save(copied.where("doc_id != rep").select("doc_id", "n", "d1", "d2").distinct(), "spare")
    # an id with several sets: their classes are one node
    several = scratch.save(live.groupBy("doc_id").agg(F.count("*").alias("m")).where("m > 1").select("doc_id"), "several")
    of_id = _keep_ids(live, several, "left_semi").distinct().join(classes.select("n", "d1", "d2", "rep"), ["n", "d1", "d2"])
    same = of_id.join(of_id.groupBy("doc_id").agg(F.min("rep").alias("b")), "doc_id").select(F.col("rep").alias("a"), "b")
    several = several if several.limit(1).count() else None
    docs = _once(docs, several, "text")
    alone = _once(_keep_ids(sets.where("n > 0 and doc_id is not null"), spare, "left_anti"), several, "n", "d1", "d2")

    frequent = spark.sparkContext.broadcast(frequent_tokens(sets, scratch))
    buckets = bucket_rows(rare_postings(alone, frequent, rule, False), partitions)

    hard_ids = scratch.save(rare_postings(alone, frequent, rule, True).distinct(), "hard_ids")
    hard = scratch.save(hard_sets(_keep_ids(docs, hard_ids, "left_semi"), frequent, rule), "hard")
    hard = _once(hard, several, "tokens")
    entries = hard.select(F.explode("sigs").alias("sig"), "doc_id", "n")
    crowd = scratch.save(
        entries.groupBy("sig").agg(F.count("*").alias("size"), F.min("doc_id").alias("leader")).where("size > 1"), "combinations"
    )
    heavy = crowd.where(F.col("size") > RARE).select("sig", "leader")
    shared = entries.join(crowd.where(F.col("size") <= RARE).select("sig"), "sig", "left_semi")
    shared = shared.select("sig", "doc_id", "n", F.lit(1).cast("long").alias("spare"))
    table = scratch.save(buckets.unionByName(bucket_rows(shared, partitions)), "buckets")

    fits = f"{rule.den} * least(leader_n, n) >= {rule.num} * greatest(leader_n, n)"
    need = F.min(F.least("leader_spare", "spare")).alias("need")
    stars = scratch.save(table.where(fits).groupBy("leader", "doc_id").agg(F.count("*").alias("hits"), need), "stars")
    # the hits with a leader are only those of the buckets it leads, so this passes over some pairs; they come again below
    best = stars.where("hits >= need").groupBy("doc_id").agg(F.max_by("leader", F.struct("hits", -F.col("leader"))).alias("leader"))
    best = scratch.save(best.select("leader", "doc_id"), "best")
    links = verify(best, docs, rule, partitions, scratch).unionByName(same)

    # whatever the first links left apart
    found = scratch.save(components(links, scratch).select(F.col("node").alias("doc_id"), "component"), "found")
    few = found.count() <= MAX_BROADCAST_IDS
    names = found.select(F.col("doc_id").alias("x"), F.col("component").alias("cx"))
    names = F.broadcast(names) if few else names

    def apart(pairs: DataFrame) -> DataFrame:
        labelled = pairs.join(names, F.col("leader") == F.col("x"), "left").withColumn("ca", F.coalesce("cx", "leader")).drop("x", "cx")
        labelled = labelled.join(names, F.col("doc_id") == F.col("x"), "left").withColumn("cb", F.coalesce("cx", "doc_id"))
        return labelled.where("ca != cb").select("leader", "doc_id", "hits", "need")

    # every bucket that two documents share gives one row: as its leader's, or as one of its other pairs
    larger = table.where("size > 2").select("sig", "doc_id", "n", "spare")
    other = larger.select("sig", F.col("doc_id").alias("leader"), F.col("n").alias("leader_n"), F.col("spare").alias("leader_spare"))
    inner = larger.join(other, "sig").where("leader < doc_id").where(fits)
    inner = inner.select("leader", "doc_id", F.lit(1).cast("long").alias("hits"), F.least("leader_spare", "spare").alias("need"))
    rest = apart(inner).unionByName(apart(stars)).groupBy("leader", "doc_id").agg(F.sum("hits").alias("hits"), F.min("need").alias("need"))
    rest = rest.where("hits >= need").join(best, ["leader", "doc_id"], "left_anti").select("leader", "doc_id")
    rest = scratch.save(rest, "rest")
    links = links.unionByName(verify(rest, docs, rule, partitions, scratch))
    links = scratch.save(links, "all_links")

    links = links.unionByName(cluster_links(hard, heavy, links, rule, scratch))
    final = components(links, scratch)
    named = classes.join(final, F.col("rep") == F.col("node"), "left").select("n", "d1", "d2", "m", F.coalesce("component", "rep").alias("component_id"))
    known = _join_classes(live, named, hot).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    none = meta.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return known.unionByName(none)


def near_duplicates_sql(rule: Rule = Rule()) -> str:
    """The same over ``documents`` by all shared shingles, for tables whose ids are distinct."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
with recursive split as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^ \\t-\\r]+') w from documents),
sets as (select doc_id, unnest(list_distinct(case when len(w) = 0 then [] when len(w) < {rule.width} then [hash(w)]
  else list_transform(range(1, len(w) - {rule.width - 2}), lambda k: hash(w[k : k + {rule.width - 1}])) end)) s from split),
sizes as (select doc_id, count(*) n from sets group by doc_id),
alike as (select min(doc_id) rep, list(doc_id) ids from (select doc_id, list(s order by s) all_s from sets group by doc_id) group by all_s),
one as (select s.doc_id, s.s, n from sets s join alike on s.doc_id = rep join sizes on sizes.doc_id = rep),
links as (
  select a.doc_id a, b.doc_id b from one a join one b on a.s = b.s and a.doc_id <> b.doc_id and {rule.den} * least(a.n, b.n) >= {rule.num} * greatest(a.n, b.n)
  group by a.doc_id, b.doc_id, a.n, b.n having {rule.den} * count(*) >= {rule.num} * (a.n + b.n - count(*))),
reach as (select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a),
low as (select rep, least(rep, coalesce(min(b), rep)) low from alike left join reach on a = rep group by rep),
named as (select unnest(ids) doc_id, low from alike join low using (rep))
select doc_id, coalesce(n, 0)::bigint n_shingles, coalesce(low, doc_id) component_id
from documents left join sizes using (doc_id) left join named using (doc_id)
"""


def distinct_documents(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """The rows of ``docs``, all columns included, whose id is its component's smallest.

    Links are those of ``near_duplicates``: null and empty texts link with nothing, very long texts
    count whole, equal texts link. Rows that repeat an id stay or go together; rows without an id stay; an empty
    table stays empty.
    """
    scratch = Scratch(docs.sparkSession)
    gone = near_duplicates(docs, rule, scratch=scratch).where("doc_id != component_id").select("doc_id").distinct()
    gone = Scratch(docs.sparkSession).save(gone, "gone")
    scratch.close()
    return _keep_ids(docs, gone, "left_anti")
