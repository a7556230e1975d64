"""URL filters: host and path rules, and per-host trees of path templates for what no rule decides.

Paths become shapes by the form of their segments (numbers, hex ids, file endings) and are counted
per host, with the verdicts of rules as labels. The tree is then built on these counts level by
level: rare values become wildcards; siblings with alike subtrees are merged unless their labelled
urls disagree. A template's purity is the share of blocked urls among its labelled ones, smoothed by
its parent's, and so on up to the host's and to that of all hosts; a template of a branch with labels
is rejected when its purity is high enough.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelmill.llm._spark import Scratch
from voxelmill.llm.licenses import LOWER, UPPER

RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Shape tables up to so many rows are broadcast to the urls; larger ones are joined by a shuffle.
BROADCAST_ROWS = 200_000


@dataclass(frozen=True)
class Tree:
    """``depth`` levels of single segments, and one of the whole rest; a value keeps its name from
    ``literal`` of its parent's rows on; siblings merge up to a ``distance`` (Jensen-Shannon, 0 to 1);
    ``weight`` of the parent's share in smoothing; to be rejected a template needs a ``purity``, and its
    branch (all below the same first node) so many ``labelled`` urls."""

    depth: int = 4
    literal: float = 0.01
    distance: float = 0.1
    weight: float = 4.0
    labelled: int = 5
    purity: float = 0.7


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; both null where none does."""
    hits = []
    for rule, verdict in sorted(rules, key=lambda r: -len(r[0])):
        domain, slash, rest = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + rest)
        hits.append((fits, rule, verdict))
    if not hits:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    return (
        F.coalesce(*[F.when(fits, F.lit(rule)) for fits, rule, _ in hits]),
        F.coalesce(*[F.when(fits, F.lit(verdict)) for fits, _, verdict in hits]),
    )


def shape_of(path: Column, depth: int) -> Column:
    """Segments with numbers as ``#`` and long hex ids as ``@``; all beyond ``depth`` are one last segment."""
    parts = F.split(F.regexp_replace(path, "^/", ""), "/")
    parts = F.transform(
        parts, lambda s: F.regexp_replace(F.regexp_replace(F.lower(s), r"(?<![0-9a-z])(?=[0-9a-f-]*[0-9])[0-9a-f-]{12,}(?![0-9a-z])", "@"), "[0-9]+", "#")
    )
    rest = F.array(F.array_join(F.slice(parts, depth + 1, F.greatest(F.size(parts), F.lit(1))), "/"))
    none = F.array().cast("array<string>")
    return F.when(path == "", none).otherwise(F.concat(F.slice(parts, 1, depth), F.when(F.size(parts) > depth, rest).otherwise(none)))


def _merge(distance: float):
    """Names for the siblings below one node: alike ones share the name of their set.

    The largest come first (the first in the alphabet of equals), and each joins the first set whose
    subtree it resembles and whose labelled urls don't contradict its own. A node has at most 1 /
    ``literal`` values and paths below it by name, and one of all others.
    """

    def js(p: np.ndarray, q: np.ndarray) -> float:
        m = (p + q) / 2
        with np.errstate(divide="ignore", invalid="ignore"):
            kl = [np.nansum(np.where(x > 0, x * np.log2(x / m), 0)) for x in (p, q)]
        return float(sum(kl) / 2)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        counts = pdf.pivot_table(index="value", columns="child", values="n", aggfunc="sum", fill_value=0).sort_index()
        labels = pdf.groupby("value")[["b", "a"]].sum().sort_index()
        rows = [(c, v) for c, v in zip(counts.to_numpy(float), labels.to_numpy(float), strict=True)]
        groups: list[list] = []
        for name, (child, label) in sorted(zip(counts.index, rows, strict=True), key=lambda x: (-x[1][0].sum(), x[0])):
            for g in groups:
                agree = not label.sum() or not g[1].sum() or js(label / label.sum(), g[1] / g[1].sum()) <= distance
                if agree and js(child / child.sum(), g[0] / g[0].sum()) <= distance:
                    g[0], g[1] = g[0] + child, g[1] + label
                    g[2].append(name)
                    break
            else:
                groups.append([child, label, [name]])
        out = [(x, "{" + "|".join(sorted(g[2])) + "}" if len(g[2]) > 1 else x) for g in groups for x in g[2]]
        first = pdf.iloc[0]
        return pd.DataFrame({"host": first["host"], "node": first["node"], "value": [x for x, _ in out], "name": [y for _, y in out]})

    return run


def templates(shapes: DataFrame, tree: Tree, scratch: Scratch) -> DataFrame:
    """``host, shape, node, chain``: the template of every shape of ``shapes(host, shape, n, b, a)``, and the nodes that lead to it."""
    state = scratch.save(shapes.withColumns({"node": F.lit(""), "chain": F.array().cast("array<string>")}), "tree")
    for level in range(tree.depth + 1):
        inside = state.where(F.size("shape") > level).withColumn("raw", F.element_at("shape", level + 1))
        by_value = inside.groupBy("host", "node", "raw").agg(F.sum("n").alias("m"))
        totals = by_value.groupBy("host", "node").agg(F.sum("m").alias("total"))
        # values under the share have one name, so a node has a bounded number of children
        named = by_value.join(totals, ["host", "node"]).withColumn("value", F.when(F.col("m") >= F.col("total") * tree.literal, F.col("raw")).otherwise("*"))
        inside = scratch.save(inside.join(named.select("host", "node", "raw", "value"), ["host", "node", "raw"]), "level")
        below = F.array_join(F.slice("shape", level + 2, F.greatest(F.size("shape"), F.lit(1))), "/")  # the whole rest of a path
        stats = inside.withColumn("child", below)
        kids = stats.groupBy("host", "node", "child").agg(F.sum("n").alias("m"))
        kids = kids.join(kids.groupBy("host", "node").agg(F.sum("m").alias("total")), ["host", "node"])
        kids = kids.select("host", "node", "child", F.when(F.col("m") >= F.col("total") * tree.literal, F.col("child")).otherwise("*").alias("kid"))
        stats = (
            stats.join(kids, ["host", "node", "child"])
            .groupBy("host", "node", "value", F.col("kid").alias("child"))
            .agg(F.sum("n").alias("n"), F.sum("b").alias("b"), F.sum("a").alias("a"))
        )
        merged = stats.groupBy("host", "node").applyInPandas(_merge(tree.distance), "host string, node string, value string, name string")
        merged = merged.withColumnRenamed("node", "parent")
        deeper = inside.join(
            merged, (inside["host"] == merged["host"]) & (inside["node"] == merged["parent"]) & (inside["value"] == merged["value"])
        ).select(inside["host"], "shape", "n", "b", "a", F.concat("node", F.lit("/"), "name").alias("node"), "chain")
        deeper = deeper.withColumn("chain", F.concat("chain", F.array("node")))
        old, state = state, scratch.save(deeper.unionByName(state.where(F.size("shape") <= level).select(*deeper.columns)), "tree")
        scratch.drop(old, inside)
    return state


def purities(placed: DataFrame, weight: float) -> DataFrame:
    """``host, node, purity, labels``: smoothed purity of every template, and the labelled urls of its branch."""
    nodes = placed.select("host", F.explode(F.array_union("chain", F.array("node"))).alias("node"), "b", "a")
    nodes = nodes.groupBy("host", "node").agg(F.sum("b").alias("b"), F.sum("a").alias("a"))
    hosts = placed.groupBy("host").agg(F.sum("b").alias("hb"), F.sum("a").alias("ha"))
    world = hosts.agg(F.coalesce(F.sum("hb"), F.lit(0)), F.coalesce(F.sum("ha"), F.lit(0))).first()
    base = world[0] / (world[0] + world[1]) if world[0] + world[1] else 0.0
    of_host = (F.col("hb") + weight * base) / (F.col("hb") + F.col("ha") + weight)
    leaves = placed.select("host", "node", "chain").distinct().select("host", "node", F.posexplode(F.array_union("chain", F.array("node"))).alias("level", "at"))
    counted = leaves.join(nodes.withColumnRenamed("node", "at"), ["host", "at"])
    path = counted.groupBy("host", "node").agg(F.sort_array(F.collect_list(F.struct("level", "b", "a"))).alias("path"))  # depth + 1 entries
    step = F.aggregate("path", of_host, lambda share, x: (x["b"] + weight * share) / (x["b"] + x["a"] + weight))
    return path.join(hosts, "host").select("host", "node", step.alias("purity"), (F.col("path")[0]["b"] + F.col("path")[0]["a"]).alias("labels"))


def judge(
    pages: DataFrame, rules=RULES, tree: Tree = Tree(), id_col: str = "page_id", url_col: str = "url", hidden: Column | None = None
) -> DataFrame:
    """``page_id, host, path, rule, verdict, template, purity, rejected``: one row per row of ``pages``.

    The verdict is the longest fitting rule's, else ``block`` where the url's template is rejected
    and ``allow`` where not; ``rejected`` is the template's verdict in either case. Null urls and urls
    without ``://`` have an empty host and path, fit no rule and are judged as that host's empty path.
    Urls are taken whole, however long. Repeated rows repeat and count as often. Branches
    without labelled urls have no rejected template. An empty table gives no rows; other columns, whatever
    their names, are ignored. Rows for which ``hidden`` (over ``pages``) holds lend the tree no labels.
    """
    scratch = Scratch(pages.sparkSession)
    unseen = F.lit(False) if hidden is None else F.coalesce(hidden, F.lit(False))
    parsed = pages.select(
        F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"), unseen.alias("unseen")
    )
    rule, by_rule = rule_of(F.col("host"), F.col("path"), rules)
    rows = parsed.withColumns({"rule": rule, "by_rule": by_rule, "shape": shape_of(F.col("path"), tree.depth)})
    label = F.when(~F.col("unseen"), F.col("by_rule"))
    shapes = rows.groupBy("host", "shape").agg(
        F.count("*").alias("n"),
        F.coalesce(F.sum((label == "block").cast("long")), F.lit(0)).alias("b"),
        F.coalesce(F.sum((label == "allow").cast("long")), F.lit(0)).alias("a"),
    )
    placed = templates(shapes, tree, scratch)
    scored = purities(placed, tree.weight)
    lookup = placed.join(scored, ["host", "node"]).select(
        "host", "shape", F.col("node").alias("template"), "purity", ((F.col("purity") >= tree.purity) & (F.col("labels") >= tree.labelled)).alias("rejected")
    )
    lookup = scratch.save(lookup, "lookup")
    small = lookup.count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(lookup) if small else lookup, ["host", "shape"], "left").select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("by_rule", F.when(F.col("rejected"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        "template",
        "purity",
        "rejected",
    )
