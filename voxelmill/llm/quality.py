"""Quality by nearest-neighbour voting in a latent-semantic space of words and word shapes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelmill.llm._labels import class_sizes, held_out, training_rows
from voxelmill.llm._shingles import PIECE, shingles, word_hashes
from voxelmill.llm._spark import bound_batches

#: Labelled rows of each class that vote, about; all documents are scored against each of them.
PER_CLASS = 1500
#: Dimensions: hashed words, shapes, and the latent space.
WORDS, SHAPES, LATENT = 2048, 768, 48
SHAPE_WEIGHT = 2.0
NEIGHBOURS, SHARPNESS = 24, 6
THRESHOLD = 0.3
#: Cosines are compared in steps of this size, so that the shape of a block doesn't decide who is nearest.
COSINE_STEP = 1e-6

_KIND = np.zeros(256, np.int64)  # letters 0 (with all bytes beyond ASCII), upper 1, digit 2, others below
_KIND[65:91] = 1
_KIND[48:58] = 2
for _k, _chars in enumerate((b".", b",", b"!?", b"|/\\", b"#$%&*+=<>@^_~`{}[]"), 3):
    _KIND[list(_chars)] = _k
_KIND[[c for c in range(33, 127) if not chr(c).isalnum() and not _KIND[c]]] = 4


def term_codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Document and term of every word (its hash) and of every word's shape.

    A shape is the kind of first and last character, upper case of none, some or all letters, the
    number of symbols, and whether the word equals the one before.
    """
    raws = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = b"\n".join(raws)
    words, starts = word_hashes(data)
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    raw = np.frombuffer(data, np.uint8)
    doc = np.searchsorted(np.cumsum([len(x) + 1 for x in raws]), starts, "right")
    kind = _KIND[raw]
    space = np.flatnonzero((raw == 32) | ((raw >= 9) & (raw <= 13)))
    ends = np.append(space, len(raw))[np.searchsorted(space, starts)]

    def within(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return total[ends] - total[starts]

    upper, lower, symbols = within(kind == 1), within((kind == 0)), within(kind >= 3)
    case = np.where(upper == 0, 0, np.where((lower == 0) & (upper > 1), 2, 1))
    again = np.concatenate([[0], (words[1:] == words[:-1]) & (doc[1:] == doc[:-1])]).astype(np.int64)
    first, last = np.minimum(kind[starts], 3), kind[ends - 1]
    shape = (((first * 8 + last) * 3 + case) * 4 + np.minimum(symbols, 3)) * 2 + again
    return np.concatenate([doc, doc]), np.concatenate([(words % np.uint64(WORDS)).astype(np.int64), WORDS + shape])


def counts(texts: list[str | None]) -> np.ndarray:
    """Term counts of a few texts, a row for each."""
    doc, term = term_codes(texts)
    size = WORDS + SHAPES
    return np.bincount(doc * size + term, minlength=len(texts) * size).reshape(len(texts), size).astype(np.float32)


def lots(texts: list, most: int = 128) -> Iterator[list]:
    """Runs of texts of bounded number and, unless one is longer, bounded characters."""
    lot, held = [], 0
    for t in texts:
        if lot and (len(lot) >= most or held + len(t or "") > PIECE):
            yield lot
            lot, held = [], 0
        lot.append(t)
        held += len(t or "")
    if lot:
        yield lot


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of all documents each term occurs, and their number; a row per term and task is summed."""

    def run(batches):
        total, n = np.zeros(WORDS + SHAPES, np.int64), 0
        for batch in batches:
            for lot in lots(batch["text"].tolist()):
                total += (counts(lot) > 0).sum(0)
                n += len(lot)
        some = np.flatnonzero(total)
        yield pd.DataFrame({"term": np.append(some, -1), "n": np.append(total[some], n)})

    rows = docs.select("text").mapInPandas(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    found = {r["term"]: r["n"] for r in rows}
    df = np.zeros(WORDS + SHAPES)
    for k, v in found.items():
        if k >= 0:
            df[k] = v
    return df, found.get(-1, 0)


@dataclass
class Model:
    """Weights of terms, projection to the latent space, the voters' unit vectors and labels, and the labelled rows each stands for."""

    idf: np.ndarray
    projection: np.ndarray
    voters: np.ndarray
    labels: np.ndarray
    stands_for: np.ndarray | float = 1.0

    def embed(self, texts: list[str | None]) -> np.ndarray:
        return _unit(weigh(counts(texts), self.idf).astype(np.float64) @ self.projection)

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Share of label 1 among the nearest voters, weighted by a power of their cosine and the rows they stand for.

        Of equally near voters the first ones vote. Without any voter the score is 0.5.
        """
        n = len(self.labels)
        if not n:
            return np.full(len(texts), 0.5)
        steps = np.rint(self.embed(texts) @ self.voters.T / COSINE_STEP).astype(np.int64)  # exact, a block of documents at a time
        k = min(NEIGHBOURS, n)
        order = np.arange(n) - steps * n  # ascending: nearer first, then the voter's number; no two are equal
        near = np.argpartition(order, k - 1, axis=1)[:, :k]
        near = np.take_along_axis(near, np.argsort(np.take_along_axis(order, near, 1), axis=1), 1)
        weight = np.maximum(np.take_along_axis(steps, near, 1) * COSINE_STEP, 0) ** SHARPNESS + 1e-9
        weight = weight * np.broadcast_to(self.stands_for, self.labels.shape)[near]
        return (weight * self.labels[near]).sum(1) / weight.sum(1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def weigh(c: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Words: damped counts times rarity. Shapes: shares of the text's words. Both parts of unit length."""
    words = _unit(np.log1p(c[:, :WORDS]) * idf[:WORDS])
    shapes = _unit(np.sqrt(c[:, WORDS:] / np.maximum(c[:, WORDS:].sum(1, keepdims=True), 1)))
    return np.concatenate([words, SHAPE_WEIGHT * shapes], 1)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """Rarity over all documents; latent space and voters from about ``PER_CLASS`` rows of a class.

    Of near copies among them, told by the smallest shingle, one votes. A voter stands for its share
    of its class, so that scores keep the natural shares of the classes however many rows are labelled.
    """
    bound_batches(docs.sparkSession)
    df, n = document_frequencies(docs)
    idf = np.log((1 + n) / (1 + df)).astype(np.float32)
    sample = training_rows(docs, labels, label, PER_CLASS)

    def rows(batches):  # only weighted terms go to the driver, however long the texts
        for batch in batches:
            at = 0
            for lot in lots(batch["text"].tolist()):
                x = weigh(counts(lot), idf).astype(np.float16)
                low = [int(s[0].view(np.int64)) if len(s) else 0 for s in shingles(lot)]
                part = batch.iloc[at : at + len(lot)]
                yield pd.DataFrame({"id": part["id"], "low": low, "x": [r.tobytes() for r in x], "y": part["y"]})
                at += len(lot)

    size = WORDS + SHAPES
    each = sample.mapInPandas(rows, "id long, low long, x binary, y int").groupBy("id").agg(F.max(F.struct("y", "low", "x")).alias("r"))
    got = each.select("r.*").groupBy("low").agg(F.max(F.struct("y", "x")).alias("r")).select("r.*").toPandas().sort_values(["x", "y"])
    x = np.frombuffer(b"".join(got["x"]), np.float16).reshape(len(got), size).astype(np.float32)
    if not len(x):
        return Model(idf, np.zeros((size, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0))
    rank = min(LATENT, *x.shape)
    rng = np.random.default_rng(3)
    basis = x.T @ (x @ rng.standard_normal((size, min(rank + 8, size))).astype(np.float32))
    for _ in range(4):  # subspace iteration for the leading right singular vectors
        basis, _ = np.linalg.qr(basis)
        basis = x.T @ (x @ basis)
    basis, _ = np.linalg.qr(basis)
    _, _, vt = np.linalg.svd(x @ basis, full_matrices=False)
    projection = (basis @ vt.T[:, :rank]).astype(np.float32)
    y = got["y"].to_numpy(np.float64)
    share = {k: n / max((y == k).sum(), 1) for k, n in class_sizes(labels, label).items()}
    return Model(idf, projection, _unit(x @ projection), y, np.array([share[int(k)] for k in y]))


def scorer(spark: SparkSession, model) -> Column:
    """A column function from text to score; the model is sent once to each executor."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(np.concatenate([shared.value.score(lot) for lot in lots(batch.tolist())] or [np.zeros(0)]))

    return score


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted``: one row per row of ``docs``.

    The score is a function of the whole text alone, however long, so equal texts have equal scores;
    null texts count as empty, whose vector has no neighbours nearer than others. Voters that are
    equally near (to a millionth) vote in their fixed order. Labels of the held-out fold aren't learnt
    from. Without labels all scores are 0.5. Repeated rows repeat, rows without an id have a score and
    aren't held out, an empty table gives no rows, and other columns, whatever their names, are ignored.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    score = scorer(docs.sparkSession, fit(docs, labels))
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.coalesce("text", F.lit(""))).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns included, that are predicted to have label 1.

    Rows are judged as by ``classify``: null and empty texts alike, very long texts whole, repeated
    rows each, rows without an id too; an empty table stays empty.
    """
    score = scorer(docs.sparkSession, fit(docs, labels))
    return docs.where(score(F.coalesce("text", F.lit(""))) >= THRESHOLD)
