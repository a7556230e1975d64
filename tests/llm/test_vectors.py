"""The operators on vectors against brute force, with the awkward rows and small bounds that force every way through them."""

import hashlib
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelmill.llm import entries, hard_negatives, hash_search, vector_codes
from voxelmill.llm._vectors import LIMIT, best, whole

SCHEMA = "vec_id long, embedding array<float>, label int, id string, vec int, code string, n int, q string, score int, rank int, cap int, of int, error string"
NAN, INF = float("nan"), float("inf")
ODD = [None, [], [NAN] + [1.0] * 15, [None] + [1.0] * 15, [INF] + [1.0] * 15]


def table_of(spark, rows):
    return spark.createDataFrame([(i, v, y, "x", 1, "c", 2, "q", 3, 4, 5, 6, "e") for i, v, y in rows], SCHEMA)


def points(n, dim=16, seed=0):
    """Vectors around a few centres, some alike."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((6, dim))[rng.integers(0, 6, n)] + 0.7 * rng.standard_normal((n, dim))
    x[n // 2 : n // 2 + n // 3] = x[n // 2]  # a third of all rows are copies
    return x.astype(np.float32)


@pytest.mark.parametrize("name", ["op11_hilbert_blocks", "op12_hard_negatives"])
def test_query_equals_its_sql(spark, name):
    data = Path("/root/testdata/sf0.001")
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{data}/embeddings.parquet'")
    want = con.sql(entries.oracle_sql()[name]).df()
    got = entries.queries()[name](spark, str(data)).toPandas()
    assert len(got) and sorted(got.columns) == sorted(want.columns)
    key = list(want.columns)
    assert sorted(map(tuple, got[key].values.tolist())) == sorted(map(tuple, want[key].values.tolist()))


# -- 11 -------------------------------------------------------------------------------------------


def plain_codes(rows, parts, entries_, rounds):
    """A literal loop over rows, parts and entries."""
    q = [[int(np.floor(256.0 * float(c))) for c in v] for _, v, _ in rows]
    width = len(q[0]) // parts
    cut = [[tuple(v[p * width : (p + 1) * width]) for p in range(parts)] for v in q]
    first = [min(cut[k] for k in range(len(rows)) if rows[k][0] == i) for i in sorted({i for i, _, _ in rows if i is not None})[:entries_]]
    books = [[v[p] for v in first] for p in range(parts)]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v, book: min((gap(v, e), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            held = {}
            for v in cut:
                held.setdefault(near(v[p], books[p])[1], []).append(v[p])
            books[p] = [tuple(sum(c) // len(held[k]) for c in zip(*held[k])) if k in held else e for k, e in enumerate(books[p])]
    found = [[near(v[p], books[p]) for p in range(parts)] for v in cut]
    errors = [sum(d for d, _ in f) for f in found]
    per = {}
    for (_, _, y), e in zip(rows, errors):
        per[y] = per.get(y, 0) + e
    digest = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{k:02x}" for _, k in f), e, per[y], digest) for (i, _, y), f, e in zip(rows, found, errors)), key=str)


@pytest.mark.parametrize("n, block", [(700, 16), (40, 64), (130, 8)])
def test_codes_against_a_plain_loop(spark, n, block):
    rows = [(3 * k, v.tolist(), [None, 0, 1, 1][k % 4]) for k, v in enumerate(points(n))]
    rows += [rows[5], (None, rows[7][1], 1), (9, rows[8][1], 0)]
    df = table_of(spark, rows + [(10_000 + k, v, 0) for k, v in enumerate([*ODD, [1.0] * 32, [1.0] * 5])]).repartition(3)
    got = vector_codes.compress(df, parts=8, entries=16, block=block)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_codes(rows, 8, 16, 2)


def test_codes_of_empty_and_extreme_tables(spark):
    assert not vector_codes.compress(table_of(spark, [(1, [1.0] * 16, 0)]).limit(0)).count()
    assert not vector_codes.compress(table_of(spark, [(1, v, 0) for v in [*ODD, [1.0] * 5]])).count()
    assert not vector_codes.compress(table_of(spark, [(None, [1.0] * 16, 0)])).count()
    far = vector_codes.compress(table_of(spark, [(1, [3e38] * 16, None), (2, [-3e38] * 16, None)])).collect()
    assert [r["error"] for r in sorted(far)] == [0, 0] and far[0]["label_error"] == 0
    with pytest.raises(ValueError):
        vector_codes.compress(table_of(spark, []), entries=257)


def test_curve_visits_neighbours():
    for axes, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * axes), -1).reshape(-1, axes)
        key = vector_codes.hilbert(cells, bits)
        assert sorted(key) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(1) == 1).all()


def test_shortlists_hold_the_nearest_entry(monkeypatch):
    monkeypatch.setattr(vector_codes, "STEP", 50_000)
    rng = np.random.default_rng(3)
    x, book = rng.integers(-200, 200, (40, 64, 4)), rng.integers(-200, 200, (64, 4))
    x = x // 8 + rng.integers(-200, 200, (40, 1, 4))
    listed = vector_codes.shortlists(x.min(1), x.max(1), book)
    want = ((x[:, :, None] - book) ** 2).sum(-1).argmin(-1)
    assert (vector_codes.nearest(x, listed, book)[0] == want).all()
    assert listed.mean() < 0.5


# -- 12 -------------------------------------------------------------------------------------------


def plain_negatives(rows, anchor, k=5, low=80, high=100):
    q = {i: [int(np.clip(np.floor(256.0 * float(c)), -LIMIT, LIMIT)) for c in v] for i, v, _ in rows}
    label, out = {i: y for i, _, y in rows}, []
    for a in filter(anchor, q):
        scored = sorted((-sum(x * y for x, y in zip(q[a], q[b])), b) for b in q if b != a and len(q[a]) == len(q[b]))
        for s, p in [x for x in scored if label[x[1]] == label[a]][:k]:
            inside = [x for x in scored if label[x[1]] != label[a] and low * -s <= 100 * -x[0] <= high * -s]
            out += [(a, p, r + 1, n, -s, -t) for r, (t, n) in enumerate(inside[:k])]
    return sorted(out)


@pytest.mark.parametrize("sample, passes, anchors", [(8192, 32_768, 256), (40, 7, 3), (1, 1000, 256)])
def test_negatives_against_all_products(spark, monkeypatch, sample, passes, anchors):
    monkeypatch.setattr(hard_negatives, "SAMPLE", sample)
    monkeypatch.setattr(hard_negatives, "PASS", passes)
    monkeypatch.setattr(hard_negatives, "ANCHORS", anchors)
    monkeypatch.setattr(hard_negatives, "PAIRS", 50)
    rows = [(k, v.tolist(), [0, 1, 0, 2, 7][k % 5]) for k, v in enumerate(points(300, seed=4))]
    rows += [(300, [1.0] * 8, 0), (301, [1.0] * 8, 0), (302, [0.9] * 8, 1), (304, [0.0] * 16, 0), (305, [3e38] * 16, 5), (306, [3e38] * 16, 5), (307, [2e38] * 16, 4)]
    more = [(1000 + k, v, 0) for k, v in enumerate(ODD)] + [(2000, [1.0] * 16, None), (None, [1.0] * 16, 0), rows[12], rows[300]]
    df = table_of(spark, rows + more).repartition(3)
    got = hard_negatives.mine(df, F.col("vec_id") % 17 == 0, F.col("label"))
    want = plain_negatives(rows, lambda i: i % 17 == 0)
    assert len(want) > 100 and sorted(tuple(r) for r in got.collect()) == want


def test_negatives_of_small_tables(spark):
    mine = lambda rows: hard_negatives.mine(table_of(spark, rows), F.col("vec_id") % 2 == 0, F.col("label")).collect()
    assert mine([]) == [] and mine([(2, [1.0, 0.0], 0)]) == [] and mine([(1, [1.0], 0), (3, [1.0], 0)]) == []
    zero = mine([(2, [0.0, 0.0], 0), (3, [1.0, 0.0], 0), (5, [0.0, 1.0], 1)])  # products of 0 lie between 0 and 0
    assert [tuple(r) for r in zero] == [(2, 3, 1, 5, 0, 0)]


def test_survivors_lose_no_pair():
    rng = np.random.default_rng(5)
    a, x = (np.floor(256 * rng.standard_normal((n, 12)) * np.geomspace(2, 0.1, 12)) for n in (30, 400))
    cuts = np.array([0, 3, 6, 9, 12])
    for share in (0.0, 0.5, 0.9, 0.99, 1.0):
        scores = a @ x.T
        low = np.quantile(scores, share, axis=1)
        i, j = hard_negatives.survivors(a, low, x, hard_negatives.rests(x, cuts), cuts, np.zeros(scores.shape, bool))
        want = set(zip(*(v.tolist() for v in np.nonzero(scores >= low[:, None]))))
        assert want <= set(zip(i.tolist(), j.tolist()))
    assert len(i) < 0.2 * scores.size


# -- 13 -------------------------------------------------------------------------------------------


def nearest_by_brute_force(rows, asked, k=5):
    out = {}
    vectors = {i: np.array(v, np.float64) for i, v, _ in rows}
    for a in filter(asked, vectors):
        u = vectors[a] / np.linalg.norm(vectors[a])
        scored = [(-round(float(u @ (v / np.linalg.norm(v))), 12), b) for b, v in vectors.items() if b != a and len(v) == len(u)]
        out[a] = sorted(scored)[:k]
    return out


@pytest.mark.parametrize("sample, passes", [(8192, 32_768), (400, 20), (3, 1000)])
def test_search_against_all_cosines(spark, monkeypatch, sample, passes):
    monkeypatch.setattr(hash_search, "SAMPLE", sample)
    monkeypatch.setattr(hash_search, "PASS", passes)
    monkeypatch.setattr(hash_search, "PAIRS", 300)
    rows = [(k, v.tolist(), 0) for k, v in enumerate(points(1500, dim=24, seed=6))]
    rows += [(1500 + k, [1.0, 0.5 * k], 0) for k in range(4)] + [(1600, [3e38] * 24, 0)]
    more = [(2000 + k, v, 0) for k, v in enumerate([*ODD, [0.0] * 24])] + [(None, [1.0] * 24, 0), rows[3], rows[10]]
    got = hash_search.search(table_of(spark, rows + more).repartition(3), F.col("vec_id") % 10 == 0).collect()
    want = nearest_by_brute_force(rows, lambda i: i % 10 == 0)
    found = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        assert r["rank"] == len(found.setdefault(r["query_id"], [])) + 1
        found[r["query_id"]].append((-round(r["score"], 12), r["vec_id"]))
    assert {q: len(v) for q, v in found.items()} == {q: len(v) for q, v in want.items()}
    assert len(want[1500]) == 3
    assert all(v == sorted(v) for v in found.values())
    hits = sum(len(set(found[q]) & set(v)) for q, v in want.items())
    assert hits >= 0.95 * sum(map(len, want.values()))
    assert hash_search.search(table_of(spark, rows).limit(0), F.col("vec_id") % 10 == 0).count() == 0


def test_probing_retrieves_every_code_in_the_radius():
    rng = np.random.default_rng(7)
    codes = rng.integers(0, 1 << 16, (500, 4)).astype(np.uint16)
    codes[250:] = codes[:250]
    codes[100:200] ^= (1 << rng.integers(0, 16, (100, 4))).astype(np.uint16)
    asked = codes[90:130]
    orders = np.argsort(codes, axis=0, kind="stable").T
    tables = [np.unique(codes[:, s], return_counts=True) for s in range(4)]
    gap = np.bitwise_count(asked[:, None] ^ codes).sum(-1)
    for r in (0, 1, 2, 3, 4, 5, 7, 20, 30, 64):
        i, j = hash_search.probe(asked, np.full(40, r), [v for v, _ in tables], [n for _, n in tables], orders, codes)
        assert sorted(zip(i.tolist(), j.tolist())) == sorted(zip(*(v.tolist() for v in np.nonzero(gap <= r))))


def test_best_keeps_ties_by_id():
    w, s, i = best(2, np.array([1, 0, 1, 1, 0]), np.array([5, 1, 5, 5, 2]), np.array([9, 4, 7, 8, 3]))
    assert list(zip(w.tolist(), s.tolist(), i.tolist())) == [(0, 2, 3), (0, 1, 4), (1, 5, 7), (1, 5, 8)]
    assert whole(np.array([0.0039, -0.0001, 1e30])).tolist() == [0, -1, LIMIT]
