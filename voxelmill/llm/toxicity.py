"""Toxicity by weak supervision: voters, a generative label model, and a linear classifier on its posteriors.

Voters are lexicons and patterns over the words of a text: a fixed list of insults, words and word
beginnings mined from labelled rows, each list dealt to several voters, bands of their density, and
patterns (shouting, repeated words, runs of marks, a person addressed next to an insult).
The label model sees only votes: their covariance over all documents is a rank-one part (what each
voter shares with the hidden label: its accuracy) and the rest (correlations given the label). The
posterior follows from both. A logistic regression on the voters' densities learns the posteriors of
all documents.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelmill.llm._labels import class_sizes, held_out, training_rows
from voxelmill.llm._shingles import shingles
from voxelmill.llm._spark import Scratch

#: Common insults.
INSULTS = ("bastard", "bitch", "clown", "creep", "disgusting", "dumb", "fool", "freak", "garbage", "idiot", "imbecile", "jerk", "loser",
           "moron", "pathetic", "pig", "scum", "stupid", "trash", "ugly", "vermin", "worthless")
#: Words that address somebody, in four languages.
ADDRESS = ("you", "your", "yours", "yourself", "u", "ur", "du", "dein", "deine", "dich", "dir", "tu", "toi", "ton", "vous", "votre", "te", "usted", "vosotros")
#: Labelled rows of each class that patterns are mined from, about.
PER_CLASS = 6000
#: Mined words and word beginnings, at most; rows of label 1 that have one at least.
MINED_WORDS, MINED_STARTS, SUPPORT = 400, 60, 4
#: A mined term is so many times likelier in rows of label 1, and its log-likelihood ratio against chance is so large.
ODDS, EVIDENCE = 3.0, 12.0
#: Terms or cells that a task counts before it passes the counts on.
COUNTED = 100_000
START_LENGTHS = (4, 5, 6, 7, 8)
#: Voters that the mined words and the mined beginnings are dealt to.
WORD_VOTERS, START_VOTERS = 12, 6
#: A lexicon voter's vote needs this share of the words; density bands vote for and against.
SHARE = 0.001
BANDS = ((0.004, 0.008), (0.006, 0.012), (0.008, 0.016))
#: Pattern voters: words in capitals, words that repeat the one before, runs of marks, and addresses within
#: ``REACH`` words of an insult; each votes from so many per word on.
PATTERNS = (0.2, 0.1, 0.02, 0.001)
REACH = 3
THRESHOLD = 0.5
#: Misfit of a pair of voters at which it counts half in the fit of accuracies.
MISFIT = 0.05
#: Shrinkage of the votes' correlations given the label.
SHRINK = 0.5
#: Steps of a feature that the classifier's training tells apart.
STEPS = 8
WORD, CAPITALS, MARKS = re.compile(r"\w+"), re.compile(r"\b[A-Z]{2,}\b"), re.compile(r"[!?*#@$%&]{3,}")


@dataclass(frozen=True)
class Voters:
    """Lexicons: word or word beginning to the number of its voter."""

    words: dict[str, int]
    starts: dict[str, int]

    @property
    def lexicons(self) -> int:
        return 1 + WORD_VOTERS + START_VOTERS

    @property
    def width(self) -> int:
        """Densities of a text: lexicons, patterns, all word lexicons, all beginning lexicons."""
        return self.lexicons + len(PATTERNS) + 2

    @property
    def size(self) -> int:
        return self.lexicons + len(PATTERNS) + 2 * len(BANDS)

    def densities(self, text: str | None) -> np.ndarray:
        """Hits per word: of each lexicon, of each pattern, of all word and of all beginning lexicons."""
        text = text or ""
        hits, insults, bad = np.zeros(self.width), set(INSULTS), set()
        sequence = WORD.findall(text.lower())
        for word, times in Counter(sequence).items():
            if word in insults:
                hits[0] += times
            k = self.words.get(word)
            if k is not None:
                hits[1 + k] += times
            if word in insults or k is not None:
                hits[-2] += times
                bad.add(word)
            for m in START_LENGTHS:
                k = self.starts.get(word[:m]) if len(word) >= m else None
                if k is not None:
                    hits[1 + WORD_VOTERS + k] += times
                    hits[-1] += times
                    break
        at = self.lexicons
        hits[at] = len(CAPITALS.findall(text))
        hits[at + 1] = sum(map(eq, sequence, sequence[1:]))
        hits[at + 2] = len(MARKS.findall(text))
        if bad:
            address = set(ADDRESS)
            hits[at + 3] = sum(not address.isdisjoint(sequence[max(k - REACH, 0) : k + REACH + 1]) for k, w in enumerate(sequence) if w in bad)
        return hits / max(len(sequence), 1)

    def votes(self, d: np.ndarray) -> np.ndarray:
        """Votes 1, -1 or 0 (abstains) from densities, a row for each text."""
        least = np.concatenate([np.full(self.lexicons, SHARE), PATTERNS])
        single = (d[:, :-2] >= least).astype(float)
        bands = [np.where(d[:, k] >= high, 1.0, np.where(d[:, k] < low, -1.0, 0.0)) for k in (-2, -1) for low, high in BANDS]
        return np.concatenate([single, np.stack(bands, 1)], 1)


def features(d: np.ndarray) -> np.ndarray:
    """Densities on a damped scale, as the classifier takes them."""
    return np.concatenate([np.log1p(np.minimum(d, 0.1) * 300), np.ones((len(d), 1))], 1)


def telling(one, all_, ones: int, zeros: int) -> tuple[Column, Column]:
    """How many times likelier a term is in rows of label 1, and the log-likelihood ratio of its counts against chance.

    Both take rates per class, so they don't depend on how many rows of either class were counted.
    """
    zero, p = all_ - one, ones / max(ones + zeros, 1)
    odds = (one + 0.5) / F.lit(ones + 1.0) / ((zero + 0.5) / F.lit(zeros + 1.0))
    part = F.when(zero > 0, zero * F.log(zero / (all_ * F.lit(max(1 - p, 1e-9))))).otherwise(0.0)
    return odds, 2 * (one * F.log(one / (all_ * F.lit(max(p, 1e-9)))) + part)


def mine(docs: DataFrame, labels: DataFrame, label: str) -> tuple[Voters, float]:
    """Words and beginnings that mark rows of label 1, and the share of label 1 among all labelled rows.

    Of near copies, told by the smallest shingle, one row counts. Counts are per task, then summed.
    Ties in evidence go to the first in the alphabet.
    """
    sample = training_rows(docs, labels, label, PER_CLASS).select("text", "y")

    def first_shingle(batches):
        for batch in batches:
            low = [int(s[0].view(np.int64)) if len(s) else 0 for s in shingles(batch["text"].tolist())]
            yield pd.DataFrame({"low": low, "y": batch["y"], "text": batch["text"]})

    def terms(batches):
        n = Counter()
        for batch in batches:
            for text, y in zip(batch["text"], batch["y"], strict=True):
                words = set(WORD.findall((text or "").lower()))
                own = {("w", w) for w in words if len(w) > 2} | {("s", w[:m]) for w in words for m in START_LENGTHS if len(w) >= m}
                n.update((*t, y) for t in own)
                n["n", "", y] += 1
                if len(n) > COUNTED:
                    yield pd.DataFrame([(*k, v) for k, v in n.items()], columns=["kind", "term", "y", "n"])
                    n = Counter()
        yield pd.DataFrame([(*k, v) for k, v in n.items()], columns=["kind", "term", "y", "n"])

    one = sample.mapInPandas(first_shingle, "low long, y int, text string").groupBy("low").agg(F.max(F.struct("y", "text")).alias("r"))
    scratch = Scratch(docs.sparkSession)
    counted = one.select("r.text", "r.y").mapInPandas(terms, "kind string, term string, y int, n long").groupBy("kind", "term")
    counted = counted.agg(F.sum(F.col("n") * F.col("y")).alias("one"), F.sum("n").alias("all")).where(f"kind = 'n' or one >= {SUPPORT}")
    counted = scratch.save(counted, "terms")
    rows = counted.where("kind = 'n'").first()
    ones, zeros = (rows["one"], rows["all"] - rows["one"]) if rows else (0, 0)
    odds, evidence = telling(F.col("one"), F.col("all"), ones, zeros)
    good = counted.where("kind != 'n'").withColumns({"odds": odds, "evidence": evidence}).where(f"odds >= {ODDS} and evidence >= {EVIDENCE}")
    top = [
        good.where(f"kind = '{kind}'").orderBy(F.desc(F.round("evidence", 6)), "term").limit(most).select("term").toPandas()["term"].tolist()
        for kind, most in (("w", MINED_WORDS), ("s", MINED_STARTS))
    ]
    scratch.drop(counted)
    words = [w for w in top[0] if w not in INSULTS]
    starts = [s for s in top[1] if not any(s != t and s.startswith(t) for t in top[1])]
    sizes = class_sizes(labels, label)
    prior = sizes.get(1, 0) / max(sum(sizes.values()), 1)
    return Voters({w: k % WORD_VOTERS for k, w in enumerate(words)}, {s: k % START_VOTERS for k, s in enumerate(starts)}), prior


@dataclass
class LabelModel:
    """Posterior of label 1 given votes: linear log-odds from accuracies and correlations."""

    weights: np.ndarray
    offset: float

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(votes @ self.weights + self.offset, -30, 30)))


def label_model(n: float, sums: np.ndarray, products: np.ndarray, prior: float, rounds: int = 30) -> LabelModel:
    """Fit from the number of documents and the sums of votes and of their products.

    Given the label y, independent voters have ``cov(i, j) = u_i u_j`` with ``u = cov(vote, y) / sd(y)``.
    u starts from medians over triples of voters and is fitted to the off-diagonal by alternating
    least squares that downweight pairs which fit badly: these are correlated given the label. The
    covariance within labels is what u leaves, shrunk towards independence; with it the log-odds of
    the label are linear in the votes. As u isn't negative, no voter gets a negative weight.
    """
    prior = float(np.clip(prior, 0.01, 0.99))
    mean = sums / max(n, 1)
    cov = products / max(n, 1) - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov), 0))
    live = sd > 1e-6
    if live.sum() < 3:
        return LabelModel(np.zeros(len(sums)), float(np.log(prior / (1 - prior))))
    corr = cov[np.ix_(live, live)] / np.outer(sd[live], sd[live])
    m = len(corr)
    off = ~np.eye(m, dtype=bool)
    u = np.zeros(m)
    for j in range(m):  # independent triples have corr(j, k) corr(j, l) / corr(k, l) = u_j squared
        k, others = np.triu_indices(m, 1)
        use = (k != j) & (others != j) & (corr[k, others] > 0.02)
        ratios = corr[j, k[use]] * corr[j, others[use]] / corr[k[use], others[use]]
        u[j] = np.sqrt(np.clip(np.median(ratios), 1e-4, 0.96)) if use.any() else 0.01
    for _ in range(rounds):
        residual = np.abs(corr - np.outer(u, u))
        weight = off / (1 + (residual / MISFIT) ** 2)
        for j in range(m):
            u[j] = (weight[j] * corr[j] * u).sum() / max((weight[j] * u * u).sum(), 1e-9)
        u = np.clip(u, 0.0, 0.98)
    spread = np.sqrt(prior * (1 - prior))
    within = corr - np.outer(u, u)
    within = (1 - SHRINK) * (within + within.T) / 2 + SHRINK * np.diag(np.diag(within))
    value, vector = np.linalg.eigh(within)
    within = (vector * np.maximum(value, 0.02)) @ vector.T + 0.02 * np.eye(m)
    gap = u / spread  # difference of the classes' means, in units of each vote's deviation
    w = np.zeros(m)
    for _ in range(500):  # coordinate descent with weights of zero at least
        for j in range(m):
            w[j] = max(0.0, w[j] + (gap[j] - within[j] @ w) / within[j, j])
    middle = mean[live] / sd[live] + (0.5 - prior) * gap  # between the classes' means
    weights = np.zeros(len(sums))
    weights[live] = w / sd[live]
    return LabelModel(weights, float(np.log(prior / (1 - prior)) - w @ middle))


def logistic_step(w: np.ndarray, gradient: np.ndarray, curvature: np.ndarray, n: float, ridge: float = 1e-3) -> np.ndarray:
    """The Newton step from sums over rows."""
    return np.linalg.solve(curvature / n + ridge * np.eye(len(w)), gradient / n + ridge * w)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    voters: Voters
    weights: np.ndarray

    def of_densities(self, d: np.ndarray) -> np.ndarray:
        return _sigmoid(features(d) @ self.weights)

    def score(self, texts: list[str | None]) -> np.ndarray:
        return self.of_densities(np.array([self.voters.densities(t) for t in texts]).reshape(len(texts), -1))


def densities(docs: DataFrame, voters: Voters, *carried: str) -> DataFrame:
    """``d``, the densities of each text, beside the columns ``carried``; texts are left behind."""

    @F.pandas_udf("binary")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([voters.densities(t).tobytes() for t in texts], dtype=object)

    return docs.select(*carried, of("text").alias("d"))


def _matrix(raw: pd.Series, voters: Voters) -> np.ndarray:
    return np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), voters.width)


def _summed(rows: DataFrame, sums) -> np.ndarray | None:
    """The sum of the arrays that ``sums`` gives for each task; None for no rows."""

    def run(batches):
        total = None
        for batch in batches:
            if len(batch):
                part = sums(batch)
                total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"k": np.arange(len(total)), "v": total})

    got = rows.mapInPandas(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).toPandas().sort_values("k")["v"].to_numpy()
    return got if len(got) else None


def cells_of(densities: DataFrame, voters: Voters, model: LabelModel) -> DataFrame:
    """``x, n, p``: how many documents share (rounded) features, and the sum of their posteriors."""

    def run(batches):
        held: dict[bytes, list[float]] = {}
        for batch in batches:
            d = _matrix(batch["d"], voters)
            x = np.rint(features(d)[:, :-1] * STEPS).astype(np.uint8)
            for key, p in zip(x, model.posterior(voters.votes(d)), strict=True):
                cell = held.setdefault(key.tobytes(), [0, 0.0])
                cell[0] += 1
                cell[1] += p
            if len(held) > COUNTED:
                yield pd.DataFrame([(k, *v) for k, v in held.items()], columns=["x", "n", "p"])
                held = {}
        yield pd.DataFrame([(k, *v) for k, v in held.items()], columns=["x", "n", "p"])

    return densities.mapInPandas(run, "x binary, n long, p double").groupBy("x").agg(F.sum("n").alias("n"), F.sum("p").alias("p"))


def train(cells: DataFrame, width: int, steps: int = 15) -> np.ndarray:
    """Newton's method for soft labels; each step is one sum over the table of cells.

    It ends when no weight moves by a twentieth: the next step, quadratically smaller, would not be seen.
    """
    w, m = np.zeros(width + 1), width + 1
    for _ in range(steps):

        def sums(batch, w=w):
            x = np.frombuffer(b"".join(batch["x"]), np.uint8).reshape(len(batch), width) / STEPS
            x = np.concatenate([x, np.ones((len(x), 1))], 1)
            n, q = batch["n"].to_numpy(np.float64), _sigmoid(x @ w)
            return np.concatenate([[n.sum()], x.T @ (n * q - batch["p"].to_numpy()), ((x * (n * q * (1 - q))[:, None]).T @ x).ravel()])

        got = _summed(cells, sums)
        if got is None:
            break
        step = logistic_step(w, got[1 : m + 1], got[m + 1 :].reshape(m, m), got[0])
        w = w - step
        if np.abs(step).max() < 0.05:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, scratch: Scratch, *carried: str, label: str = "toxic") -> tuple[Model, DataFrame]:
    """The model, and the table of all densities beside the columns ``carried`` of ``docs``.

    The label model takes the votes of all documents, as one row of sums per task. The classifier
    learns the posteriors of all documents, from a table of their counts by (rounded) features.
    """
    voters, prior = mine(docs, labels, label)
    table = scratch.save(densities(docs, voters, *carried), "densities")
    only = table.select("d")

    def moments(batch):
        v = voters.votes(_matrix(batch["d"], voters))
        return np.concatenate([[len(v)], v.sum(0), (v.T @ v).ravel()])

    got = _summed(only, moments)
    if got is None:
        return Model(voters, np.zeros(voters.width + 1)), table
    m = voters.size
    model = label_model(got[0], got[1 : m + 1], got[m + 1 :].reshape(m, m), prior)
    cells = scratch.save(cells_of(only, voters, model), "cells")
    return Model(voters, train(cells, voters.width)), table


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted``: one row per row of ``docs``.

    The score is a function of the whole text alone, however long; null and empty texts score as
    texts without any hit, and texts with equal densities tie. Labels of the held-out fold aren't
    learnt from. Without labels only the fixed list and the patterns vote. Repeated rows repeat, rows
    without an id have a score and aren't held out, an empty table gives no rows, and other columns,
    whatever their names, are ignored.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    model, table = fit(docs, labels, Scratch(docs.sparkSession), "doc_id")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(d: pd.Series) -> pd.Series:
        return pd.Series(shared.value.of_densities(_matrix(d, shared.value.voters)), dtype="float64")

    scored = table.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score("d").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns included, that are predicted to have label 0.

    Rows are judged as by ``classify``: null, empty and very long texts, repeated rows and rows without
    an id alike; an empty table stays empty. Texts are scored again after the fit rather than copied.
    """
    scratch = Scratch(docs.sparkSession)
    model, _ = fit(docs, labels, scratch)
    scratch.close()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(texts.tolist()), dtype="float64")

    return docs.where(score("text") < THRESHOLD)
