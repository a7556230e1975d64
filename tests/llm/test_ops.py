"""The ten operators against brute force, on small tables with the awkward cases."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelmill.llm import embed_dedup, licenses, media, mixing, ngram_join, packing, quality, sharding, toxicity, urls
from voxelmill.llm._labels import held_out
from voxelmill.llm._shingles import shingles
from voxelmill.llm._spark import Scratch, running

DOCS = (
    "doc_id long, text string, source string, leader long, sig string, bucket int, mix_tokens int, score string, node long, u string, id string, "
    "k int, weight string, n_blocks int, showings int, row_no int, host string, tokens string, n int, y int"
)


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, s, 7, "x", 1, 2, "s", 3, "u", "id", 1, "w", 2, 3, 4, "h", "t", 5, 6) for i, t, s in rows], DOCS)


def words(rng, n, stem="w"):
    return " ".join(f"{stem}{rng.randrange(100_000)}" for _ in range(n))


AWKWARD = [
    (1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (4, "one two", "a"), (5, "One\ttwo", "b"), (6, "x" * 300_000, "b"),
    (7, "Grüße “ünïcödé” 日本語 \U0001f600 end", "c"), (8, "Grüße “ünïcödé” 日本語 \U0001f600 end", "c"), (8, "Grüße “ünïcödé” 日本語 \U0001f600 end", "c"),
    (None, "no id here", None),
]


@pytest.fixture(scope="module")
def awkward(spark):
    rng = random.Random(0)
    return docs_of(spark, AWKWARD + [(9, words(rng, 60_000), "b")]).cache()


def reach(ids, links):
    label = {i: i for i in ids}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        label[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


# -- 1 --------------------------------------------------------------------------------------------


def test_licenses(spark, awkward):
    mit = licenses.LICENSES["MIT"]
    same = "Copyright (c) 2020 Someone\n\n" + mit.replace("software", "SOFTWARE").replace('"', "'").replace("sublicense", "sublicence") + "\n  "
    rows = [(1, same, "a"), (2, mit + " and more", "a"), (3, "Some prose.\nReleased under the MIT licence!\nmore", "a"), (4, None, "a"), (5, "...", "a")]
    known = licenses.known_licenses(spark)
    assert known.count() == known.select("digest").distinct().count() == len(licenses.catalogue()) > 30
    got = {(r["doc_id"], r["line"]): r["license_id"] for r in licenses.scan(docs_of(spark, rows), known).collect()}
    assert got[1, -1] == "MIT" and got[2, -1] is None and got[4, -1] is None and got[5, -1] is None
    assert got[3, 1] == "MIT-line" and sum(k[1] >= 0 for k in got) == 1
    assert licenses.scan(awkward, known).count() == awkward.count()
    assert licenses.scan(awkward.limit(0), known).count() == 0


def test_every_known_licence_is_found_in_other_forms(spark):
    """Whole texts with other case, marks, line breaks, copyright lines and spellings; and with one word more or less."""
    rng, rows, want = random.Random(20), [], {}
    british = {new: old for old, new in licenses.SPELLINGS.items() if new not in ("https", "while")}
    for name, text in licenses.catalogue().items():
        for k in range(3):
            words = re.split(r"( +)", text)
            own = [british.get(w, w) if k else w for w in words]
            own = "".join(w.upper() if rng.random() < 0.3 else w.replace('"', "“") for w in own).replace(". ", " ; ")
            claims = f"Copyright (c) {1990 + k} A. N. Other\n" * k + ("All Rights Reserved.\n\n" if k == 2 else "")
            want[len(rows)] = name
            rows.append((len(rows), claims + own.replace("\n", "\r\n\t") + "\n", "a"))
        rows += [(len(rows), text + " indeed", "a"), (len(rows) + 1, text.strip().rsplit(None, 1)[0], "a")]
    got = {r["doc_id"]: r["license_id"] for r in licenses.scan(docs_of(spark, rows), licenses.known_licenses(spark)).where("line = -1").collect()}
    assert got == {i: want.get(i) for i, _, _ in rows}


# -- 2 --------------------------------------------------------------------------------------------


def test_embeddings_against_all_cosines(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((120, 16))
    near = np.concatenate([base[:1] + 0.12 * rng.standard_normal((1400, 16)), base[1:40] + 0.03 * rng.standard_normal((39, 16))])
    x = np.concatenate([base, near, base[:5] * 3, base[50:53]]).astype(np.float32)
    rows = [(k, v.tolist(), k % 3, 1) for k, v in enumerate(x)]
    n = len(rows)
    odd = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [float("inf")] + [1.0] * 15, [1.0] * 8]
    rows += [(n + k, v, 0, 1) for k, v in enumerate(odd)] + [rows[3]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, weight int")
    got = {r["vec_id"]: r for r in embed_dedup.near_duplicates(df).collect()}
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    linked = u @ u.T >= 0.95
    np.fill_diagonal(linked, False)
    label = reach(range(n), np.argwhere(linked).tolist())
    assert len(got) == n + len(odd)
    found = np.array([got[k]["n_links"] for k in range(n)])
    assert (found <= linked.sum(1)).all() and found.sum() >= 0.99 * linked.sum()
    assert all(got[k]["component_id"] == label[k] and got[k]["kept"] == (label[k] == k) for k in range(n))
    assert all(got[n + k]["n_links"] == 0 and got[n + k]["component_id"] == n + k for k in range(len(odd)))
    assert embed_dedup.near_duplicates(df.limit(0)).count() == 0


def planted(rng, n, dim, low, high):
    """n vectors and n partners, at cosines within the bounds."""
    base = rng.standard_normal((n, dim))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    side = rng.standard_normal((n, dim))
    side -= (side * base).sum(1, keepdims=True) * base
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    c = rng.uniform(low, high, (n, 1))
    return np.concatenate([base, c * base + np.sqrt(1 - c * c) * side])


def test_links_count_at_both_ends_of_many_vectors(spark):
    rng = np.random.default_rng(21)
    x, y = planted(rng, 11_000, 64, 0.9502, 0.955), planted(rng, 1500, 24, 0.9502, 0.97)
    rows = [(k, v.tolist()) for k, v in enumerate([*x, *y])]  # two lengths; both have an index
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = embed_dedup.near_duplicates(df).toPandas().sort_values("vec_id")
    links = got["n_links"].to_numpy()
    for at, n in ((0, 11_000), (22_000, 1500)):
        assert (links[at : at + n] == links[at + n : at + 2 * n]).all()  # none counts at one end only
        assert links[at : at + 2 * n].max() == 1 and links[at : at + 2 * n].mean() >= 0.995
    assert (got["component_id"] <= got["vec_id"]).all() and ((got["component_id"] != got["vec_id"]).sum() * 2 == links.sum())


def test_multi_sequence_visits_in_order():
    rng = np.random.default_rng(2)
    first, second = rng.random((9, 6)), rng.random((9, 5))
    row, a, b = embed_dedup.multi_sequence(first, second, 0.7)
    for k in range(9):
        cells = list(zip(a[row == k], b[row == k], strict=True))
        sums = [first[k, i] + second[k, j] for i, j in cells]
        inside = (first[k][:, None] + second[k]) <= first[k].min() + second[k].min() + 0.7
        assert sums == sorted(sums) and len(cells) == inside.sum() and all(inside[c] for c in cells)


# -- 3 --------------------------------------------------------------------------------------------


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def near_copies():
    rng = random.Random(3)
    rows = list(AWKWARD)
    k = 100

    def add(text):
        nonlocal k
        rows.append((k, text, "a"))
        k += 1

    passage = words(rng, 60)
    for _ in range(60):
        add(words(rng, rng.randrange(6, 300)) + " " + passage)
    base = words(rng, 150).split()
    for _ in range(150):  # a crowd of near copies, linked to some of the others only
        own = list(base)
        for _ in range(rng.randrange(0, 6)):
            own[rng.randrange(150)] = words(rng, 1, "v")
        add(" ".join(own))
    short = words(rng, 14).split()
    for _ in range(70):
        own = list(short)
        own[rng.choice([0, 1, 12, 13])] = words(rng, 1, "s")
        add(" ".join(own))
    for n in (5, 6, 9, 30, 700):
        one = words(rng, n).split()
        for _ in range(3):
            add(" ".join(one[: -1 if n > 6 else n]) + " " + words(rng, 1))
            add(" ".join(one).upper() + "\n")
    return rows


def test_ngram_join_against_all_pairs(spark):
    rows = near_copies()
    sets = {i: shingle_set(t) for i, t, _ in rows if i is not None}
    links = [
        (a, b)
        for a, b in itertools.combinations(sorted(sets), 2)
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    ]
    label = reach(sets, links)
    df = docs_of(spark, rows)
    got = ngram_join.near_duplicates(df).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["n_shingles"] == len(shingle_set(dict((i, t) for i, t, _ in rows)[r["doc_id"]]))
        assert r["component_id"] == (None if r["doc_id"] is None else label[r["doc_id"]])
    kept = {r["doc_id"] for r in ngram_join.distinct_documents(df).collect()}
    assert kept == set(label.values()) | {None}
    assert ngram_join.near_duplicates(df.limit(0)).count() == 0


def test_an_id_with_several_texts_is_one_node(spark):
    rng = random.Random(5)
    a, b = words(rng, 40), words(rng, 40)
    got = ngram_join.near_duplicates(docs_of(spark, [(1, a, "x"), (2, a, "x"), (2, b, "x"), (3, b, "x")])).collect()
    assert {r["component_id"] for r in got} == {1}
    near = b.split()
    near[-1] = "other"  # a near copy of the text that isn't a copy of another id's
    got = ngram_join.near_duplicates(docs_of(spark, [(1, a, "x"), (2, a, "x"), (2, b, "x"), (3, " ".join(near), "x")])).collect()
    assert {r["component_id"] for r in got} == {1}


def test_classes_of_tokens_hold_all_frequent_ones(spark, monkeypatch):
    rng = np.random.default_rng(31)
    often, rare = (rng.integers(0, 1 << 64, 500, np.uint64) for _ in range(2))
    rows = [(ngram_join._signed(often).tolist(),)] * (ngram_join.RARE + 1) + [(ngram_join._signed(rare).tolist(),)] * ngram_join.RARE
    sets = spark.createDataFrame(rows, "counted array<long>")
    for most, chunk in ((30, 23), (30, 8), (10, 8)):  # in one chunk, in several, and with too few bits
        monkeypatch.setattr(ngram_join, "MOST_BITS", most)
        monkeypatch.setattr(ngram_join, "CHUNK_BITS", chunk)
        table = ngram_join.frequent_tokens(sets, ngram_join.Scratch(spark))
        assert table.of(often).all() and (most == 10 or table.of(rare).mean() < 0.15) and int(often[0]) in table
    monkeypatch.undo()
    monkeypatch.setattr(ngram_join, "MOST_BITS", 10)  # most rare tokens are taken for frequent ones, and the join stays exact
    monkeypatch.setattr(ngram_join, "ROUTES", 3)
    test_ngram_join_against_all_pairs(spark)


def test_shingle_digests_match_sets():
    texts = [t for _, t, _ in near_copies()]
    got = list(shingles(texts))
    want = [shingle_set(t) for t in texts]
    assert [len(g) for g in got] == [len(w) for w in want]
    for k in range(1, len(texts)):
        assert len(np.intersect1d(got[k], got[k - 1])) == len(want[k] & want[k - 1])


# -- 4 --------------------------------------------------------------------------------------------


def test_bounds_are_optimal():
    rng = np.random.default_rng(4)
    for _ in range(40):
        lengths = np.sort(rng.choice(np.arange(1, 60), 7, replace=False))
        n = rng.integers(1, 9, 7)
        k = int(rng.integers(1, 5))

        def cost(bounds):
            return sum(c * min(b for b in bounds if b >= x) for x, c in zip(lengths, n, strict=True))

        best = min(cost([*c, lengths[-1]]) for m in range(k) for c in itertools.combinations(lengths[:-1], m))
        got = packing.optimal_bounds(lengths, n, k)
        assert len(got) <= k and cost(got) == best
    assert packing.optimal_bounds(np.zeros(0, int), np.zeros(0, int), 3) == []


def test_bounds_of_many_lengths():
    rng = np.random.default_rng(40)
    for h in (1, 2, 3, 50, 400):
        lengths, n = np.sort(rng.choice(np.arange(1, 5000), h, replace=False)), rng.integers(1, 100, h)
        total = np.concatenate([[0], np.cumsum(n)])
        best = lengths * total[1:]
        for k in range(2, 8):  # the plain recurrence
            best = np.minimum(best, [min((best[i] + lengths[j] * (total[j + 1] - total[i + 1]) for i in range(j)), default=best[j]) for j in range(h)])
            bounds = packing.optimal_bounds(lengths, n, k)
            padded = lengths[np.searchsorted(lengths, bounds)][np.searchsorted(bounds, lengths)]
            assert len(bounds) <= k and (n * padded).sum() == best[-1]


def test_packing(spark, awkward):
    rng = random.Random(6)
    df = docs_of(spark, [(k, words(rng, rng.randrange(1, 90)), "a") for k in range(400)]).unionByName(awkward)
    got = packing.pack(df, buckets=5, token_budget=500).toPandas()
    assert len(got) == df.count() and (got["n_tokens"] <= got["padded_len"]).all()
    want = Counter(len((r["text"] or "").split()) for r in df.collect())
    assert Counter(got["n_tokens"]) == want
    for _, g in got.groupby(["bucket", "batch"]):
        assert len(g) * g["padded_len"].iloc[0] <= 500 or len(g) == 1
        assert sorted(g["slot"]) == list(range(len(g)))
    lengths = np.array(sorted(want))
    bounds = packing.optimal_bounds(lengths, np.array([want[k] for k in lengths]), 5)
    assert all(r.padded_len == bounds[r.bucket] and r.bucket == packing.bucket_of(bounds, r.n_tokens) for r in got.itertuples())
    for _, g in got.groupby("bucket"):
        full = max(1, 500 // max(1, g["padded_len"].iloc[0]))
        sizes = g.groupby("batch").size().sort_index()
        assert list(sizes.index) == list(range(len(sizes))) and (sizes != full).sum() <= 3  # the last batch of each turn
    assert packing.pack(df.limit(0)).count() == 0


def test_repeated_rows_take_turns(spark):
    rng = random.Random(61)
    rows = [(k % 300, " ".join(["w"] * (1 + k % 40)), "a") for k in range(700)] + [(7, "w w w", "a")] * 30 + [(None, "w w", "a")] * 50
    rng.shuffle(rows)
    got = packing.pack(docs_of(spark, rows), buckets=3, token_budget=400).toPandas()
    assert len(got) == len(rows)
    few = got[got["doc_id"].notna()]
    assert not few.duplicated(["doc_id", "bucket", "batch"]).any()  # no batch holds a document twice
    for _, g in got.groupby(["bucket", "batch"]):
        assert sorted(g["slot"]) == list(range(len(g)))


# -- 5, 7 -----------------------------------------------------------------------------------------

DATA = "/root/testdata/sf0.1"


def accuracy(spark, module, label):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    got = module.classify(docs, labels)
    p = got.toPandas().merge(labels.toPandas(), on="doc_id")
    assert got.count() == docs.count() and p["score"].between(0, 1).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in zip(p["doc_id"], p["held_out"], strict=True))
    held = p[p["held_out"]]
    return held["predicted"].to_numpy(), held[label].to_numpy()


def test_quality_on_the_held_out_fold(spark, awkward):
    predicted, true = accuracy(spark, quality, "quality")
    assert (predicted == true).mean() > 0.97
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 1), (7, None, None), (None, 1, 1), (9, 1, 0), (9, 0, 1)], "doc_id long, quality int, toxic int")
    for rows in (labels, labels.limit(0)):
        got = quality.classify(awkward, rows)
        assert got.count() == awkward.count() and got.where("score is null or score < 0 or score > 1").count() == 0
    assert quality.classify(awkward.limit(0), labels).count() == 0


def test_toxicity_on_the_held_out_fold(spark, awkward):
    predicted, true = accuracy(spark, toxicity, "toxic")
    assert predicted[true == 1].mean() > 0.85 and predicted[true == 0].mean() < 0.01
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 1), (7, None, None), (None, 1, 1), (9, 1, 0), (9, 0, 1)], "doc_id long, quality int, toxic int")
    for rows in (labels, labels.limit(0)):
        got = toxicity.classify(awkward, rows)
        assert got.count() == awkward.count() and got.where("score is null or score < 0 or score > 1").count() == 0
    assert toxicity.classify(awkward.limit(0), labels).count() == 0


def test_votes_keep_the_shares_of_classes_at_two_sizes(spark, monkeypatch):
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{j}" for j in rng.integers(0, 300, 20)) for _ in range(1100)]
    docs = spark.createDataFrame(list(enumerate(texts[:1000])), "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 7 > 0)) for k in range(1000)], "doc_id long, quality int")
    for most in (1500, 100):  # no class is cut, and both are
        monkeypatch.setattr(quality, "PER_CLASS", most)
        assert abs(quality.fit(docs, labels).score(texts[1000:]).mean() - 6 / 7) < 0.05


def test_exact_neighbours_vote():
    rng = np.random.default_rng(7)
    texts = ["calm words in a row number %d here" % k for k in range(30)] + ["LOUD!! WORDS!! %d!!" % k for k in range(30)]
    x = quality.counts(texts)
    idf = np.ones(x.shape[1], np.float32)
    projection = rng.standard_normal((x.shape[1], 8)).astype(np.float32)
    voters = quality._unit(quality.weigh(x, idf) @ projection)
    model = quality.Model(idf, projection, voters, np.repeat([1.0, 0.0], 30))
    cosine = voters @ voters.T
    near = np.argsort(-cosine, axis=1)[:, : quality.NEIGHBOURS]
    w = np.maximum(np.take_along_axis(cosine, near, 1), 0) ** quality.SHARPNESS + 1e-9
    assert np.allclose(model.score(texts), (w * model.labels[near]).sum(1) / w.sum(1), atol=1e-3)


def test_label_model_recovers_accuracies():
    rng = np.random.default_rng(8)
    y = rng.random(20_000) < 0.2
    votes = np.stack([np.where(rng.random(len(y)) < a, 2 * y - 1, 1 - 2 * y) for a in (0.95, 0.9, 0.9, 0.85, 0.8)] + [np.zeros(len(y))], 1)
    votes[:, 2] = np.where(rng.random(len(y)) < 0.5, votes[:, 1], votes[:, 2])  # two that copy each other
    model = toxicity.label_model(len(y), votes.sum(0), votes.T @ votes, 0.2)
    assert ((model.posterior(votes) > 0.5) == y).mean() > 0.96
    assert model.weights[0] == max(model.weights) and model.weights[5] == 0


# -- 6 --------------------------------------------------------------------------------------------


def test_media_round_trip(spark, awkward):
    got = {(r["doc_id"], r["n_bytes"]): r for r in media.text_media(awkward).collect()}
    for r in awkward.collect():
        raw = (r["text"] or "").encode()
        payload = raw + b" " * (max(1, math.ceil(len(raw) / 192)) * 192 - len(raw))
        m = got[r["doc_id"], len(raw)]
        assert m["payload_bytes"] == len(payload) and m["payload_sha256"] == hashlib.sha256(payload).hexdigest()
        assert m["tail_crc32"] == zlib.crc32(payload[-16:])
        stored = media.write_container(payload)
        ranges = b"".join(stored[k["offset"] : k["offset"] + k["length"]] for k in m["keyframes"])
        assert ranges == b"".join(payload[k : k + 192] for k in range(0, len(payload), 192 * media.KEY_EVERY))
        assert (m["codec"], m["duration_s"], m["n_samples"]) == ("raw", len(payload) / media.RATE, len(payload) // 192)
        assert m["media_bytes"] == len(stored) and m["media_sha256"] == hashlib.sha256(stored).hexdigest()
    assert media.text_media(awkward.limit(0)).count() == 0


def test_containers_are_walked(spark):
    payload = bytes(range(192)) * 40
    data = media.write_container(payload)
    (t,) = media.tracks(data)
    assert (t["codec"], t["timescale"], t["duration"]) == ("raw ", media.RATE, len(payload))
    assert b"".join(data[o : o + s] for o, s in zip(t["offsets"], t["sizes"], strict=True)) == payload
    df = spark.createDataFrame([(1, data), (2, None), (3, b"junk"), (4, data[:200]), (5, b"")], "id long, media binary")
    got = {r["id"]: r for r in media.media_columns(df, "id", "media").collect()}
    assert len(got) == 5 and got[1]["n_keyframes"] == 3 and got[1]["codec"] == "raw "
    assert [(k["offset"], k["length"]) for k in got[1]["keyframes"]] == [(int(t["offsets"][k]), 192) for k in (0, 16, 32)]
    assert got[2]["track"] is None and got[3]["track"] is None


def test_hostile_containers_cost_no_more_than_their_bytes(spark):
    deep = b""
    for _ in range(3000):
        deep = media._box(b"moov", deep)

    def track(*tables):
        return media._box(b"moov", media._box(b"trak", media._box(b"mdia", media._box(b"minf", media._box(b"stbl", *tables)))))

    huge = media._full(b"stsz", (1).to_bytes(4, "big"), b"\xff" * 4)
    runs = media._full(b"stsc", (1).to_bytes(4, "big"), (1).to_bytes(4, "big"), b"\xff" * 4, (1).to_bytes(4, "big"))
    chunks = media._full(b"stco", (50).to_bytes(4, "big"), bytes(200))
    rng = random.Random(62)
    good = media.write_container(bytes(192 * 40))
    broken = [bytes(rng.randrange(256) if rng.random() < 0.02 else x for x in good[:900]) for _ in range(150)]
    many = track(huge)[8:] * 300
    unordered = media._full(b"stsc", (3).to_bytes(4, "big"), *((x).to_bytes(4, "big") for x in (9, 2, 1, 4, 5, 1, 20, 1, 1)))
    rows = list(enumerate([deep, track(huge), track(huge, runs, chunks), media._box(b"moov", many), track(huge, unordered, chunks), *broken]))
    got = media.media_columns(spark.createDataFrame(rows, "id long, media binary"), "id", "media").collect()
    assert {r["id"] for r in got} == set(range(len(rows)))
    total = Counter()
    for r in got:
        total[r["id"]] += r["n_samples"] or 0
    assert all(n <= len(rows[k][1]) for k, n in total.items())


def test_many_fragments_without_fields_cost_no_more_than_their_bytes():
    import time
    import tracemalloc

    tkhd = media._full(b"tkhd", *(int(x).to_bytes(4, "big") for x in (0, 0, 7, 0, 0)))
    head = media._box(b"moov", media._box(b"trak", tkhd))
    tfhd = media._box(b"tfhd", (0).to_bytes(4, "big"), (7).to_bytes(4, "big"))
    trun = media._box(b"trun", (0).to_bytes(4, "big"), b"\xff" * 4)
    data = head + media._box(b"moof", media._box(b"traf", tfhd, *[trun] * 1250))
    assert 19_000 < len(data) < 21_000
    began = time.perf_counter()
    (track,) = media.tracks(data)
    assert time.perf_counter() - began < 1 and len(track["sizes"]) <= len(data)
    tracemalloc.start()
    media.tracks(data)
    assert tracemalloc.get_traced_memory()[1] < 50e6
    tracemalloc.stop()
    inner = media._box(b"trak", media._full(b"mdhd", *(int(x).to_bytes(4, "big") for x in (0, 0, 1000, 5, 0))))
    for _ in range(200):
        inner = media._box(b"moov", inner)
    assert media.tracks(inner)[0]["timescale"] == 1000  # boxes are walked at any depth


def test_fragments_and_compact_sizes():
    def u(*x):
        return b"".join(int(v).to_bytes(4, "big") for v in x)

    tkhd, mdhd = media._full(b"tkhd", u(0, 0, 7, 0, 0)), media._full(b"mdhd", u(0, 0, 1000, 0, 0))
    entry = media._box(b"avc1", bytes(8))
    stbl = media._box(b"stbl", media._full(b"stsd", u(1), entry), media._full(b"stsz", u(0, 0)), media._full(b"stco", u(0)))
    trak = media._box(b"trak", tkhd, media._box(b"mdia", mdhd, media._box(b"minf", stbl)))
    moov = media._box(b"moov", trak, media._box(b"mvex", media._full(b"trex", u(7, 1, 40, 5, 0x10000))))
    tfhd = media._box(b"tfhd", u(0x020000, 7))
    sized = media._box(b"trun", u(0x000205, 3, 100, 0x02000000), u(11, 12, 13))  # offset, first flags, sizes
    plain = media._box(b"trun", u(0, 2))
    moof = media._box(b"moof", media._box(b"traf", tfhd, sized, plain))
    (t,) = media.tracks(moov + moof + media._box(b"mdat", bytes(60)))
    start = len(moov) + 100
    assert t["codec"] == "avc1" and t["duration"] == 5 * 40
    assert t["sizes"].tolist() == [11, 12, 13, 5, 5] and t["keys"].tolist() == [0]
    assert t["offsets"].tolist() == [start, start + 11, start + 23, start + 36, start + 41]
    for bits, raw in ((4, bytes([0x12, 0x30])), (8, bytes([1, 2, 3])), (16, bytes([0, 1, 0, 2, 0, 3]))):
        body = memoryview(u(0, bits, 3) + raw)
        assert media._sizes(body, 0, len(body), b"stz2", media.Samples(9)).tolist() == [1, 2, 3]


# -- 8 --------------------------------------------------------------------------------------------


def test_url_rules(spark):
    rows = [
        "http://A.Example.net/en/1", "https://example.net/de/2", "https://x.example.com/de/5?q", "https://x.example.com/de", "http://org/fr/x#y",
        "http://badorg/fr/x", "nourl", None, "", "http://h?x=/a", "a://b://c/d", "http://x.org/FR/1", "http://net", "http://net/",
    ]
    rows += [f"http://m.example.com/en/{k}" for k in range(30)] + [f"http://m.example.com/de/{k}.html" for k in range(30)]
    df = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string").selectExpr("*", "1 as host", "2 as shape", "3 as node")
    got = {r["page_id"]: r for r in urls.judge(df).collect()}
    assert len(got) == len(rows)
    for k, url in enumerate(rows):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host = re.sub("[A-Z]", lambda x: x[0].lower(), m[1]) if m else ""
        path = m[2] if m else ""
        fits = []
        for rule, verdict in urls.RULES:
            d, _, p = rule.partition("/")
            if (host == d or host.endswith("." + d)) and path.startswith("/" + p):
                fits.append((len(rule), rule, verdict))
        rule, verdict = max(fits)[1:] if fits else (None, None)
        assert (got[k]["host"], got[k]["path"], got[k]["rule"]) == (host, path, rule)
        assert got[k]["verdict"] == (verdict or got[k]["verdict"]) and got[k]["verdict"] in ("allow", "block")
    assert urls.judge(df.limit(0)).count() == 0


def test_templates_learn_from_labels(spark):
    rows = [f"http://shop.test/item/{k}/view" for k in range(80)] + [f"http://shop.test/ads/{k}/click" for k in range(80)]
    rows += [f"http://shop.test/ads/{k}/click/deep" for k in range(3)]
    df = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    rules = tuple((f"shop.test/ads/{k}", "block") for k in range(1, 10))  # most of the branch is labelled by its first digits
    got = {r["page_id"]: r for r in urls.judge(df, rules).collect()}
    assert all(got[k]["verdict"] == "allow" for k in range(80))
    assert got[80]["rule"] is None and got[80]["verdict"] == "block"  # like the labelled rest of its template


def test_the_tree_finds_hidden_labels(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    hidden = F.pmod(F.xxhash64("page_id"), F.lit(5)) == 0
    got = urls.judge(pages, hidden=hidden).join(pages.select("page_id", hidden.alias("hidden")), "page_id").toPandas()
    assert len(got) == pages.count()
    test = got[got["hidden"] & got["rule"].notna()]
    block = test["verdict"] == "block"
    assert (block == test["rejected"]).mean() > max(0.8, block.mean(), 1 - block.mean())  # the tree against the rules it didn't see
    free = got[got["rule"].isna()]
    assert (free["verdict"] == "block").any() and ((free["verdict"] == "block") == free["rejected"]).all()


def test_purity_and_merging_against_plain_loops(spark):
    rng = random.Random(81)
    rows = [f"http://{rng.choice('xyz')}.test/{rng.choice(['a', 'b', 'c'])}/{rng.choice(['p', 'q', 'r/s/t/u/v/w'])}" for _ in range(600)]
    rules = (("x.test/a/p", "block"), ("x.test/b/", "allow"), ("y.test/", "block"), ("y.test/c/", "allow"))
    tree = urls.Tree(distance=0.0)  # only siblings with equal children merge
    got = urls.judge(spark.createDataFrame(list(enumerate(rows)), "page_id long, url string"), rules, tree).toPandas()
    labels = {h: [0, 0] for h in "xyz"}
    nodes = {}
    for r in got.itertuples():
        steps = r.template.split("/", 5)  # the fifth level is the whole rest
        for k in range(2, len(steps) + 1):
            own = nodes.setdefault((r.host[0], "/".join(steps[:k])), [0, 0])
            if r.rule:
                own[r.verdict == "allow"] += 1
        if r.rule:
            labels[r.host[0]][r.verdict == "allow"] += 1
    b, a = (sum(x[k] for x in labels.values()) for k in (0, 1))
    for r in got.itertuples():
        share, steps = b / (a + b), r.template.split("/", 5)
        for own in (labels[r.host[0]], *(nodes[r.host[0], "/".join(steps[:k])] for k in range(2, len(steps) + 1))):
            share = (own[0] + 4 * share) / (sum(own) + 4)
        assert math.isclose(share, r.purity) and r.rejected == (share >= 0.7 and sum(nodes[r.host[0], "/".join(steps[:2])]) >= 5)
    assert got["template"].str.contains("r").any() and got.loc[got["host"] == "z.test", "verdict"].eq("allow").all()


# -- 9 --------------------------------------------------------------------------------------------


def test_mixing(spark, awkward):
    rng = random.Random(9)
    rows = [(k, words(rng, 50), "big") for k in range(4000)] + [(k, words(rng, 50), "mid") for k in range(4000, 5000)]
    rows += [(k, words(rng, 50), "small") for k in range(5000, 5200)]
    df = docs_of(spark, rows)
    got = mixing.schedule(df, block_tokens=500).toPandas().rename(columns=lambda c: c.removeprefix("_"))
    assert mixing.schedule(df).columns == [*df.columns, *("_mix_" + c for c in ("tokens", "weight", "epoch", "block", "rank"))]
    got = got.loc[:, ~got.columns.duplicated(keep="last")]
    tokens = {"big": 200_000, "mid": 50_000, "small": 10_000}
    shown = got.groupby("source")["doc_id"].count() * 50
    alpha = next(a / 10_000 for a in range(10_001) if (tokens["small"] / tokens["big"]) ** (a / 10_000 - 1) <= 2.0)
    weight = {s: n**alpha for s, n in tokens.items()}
    for s in tokens:
        assert abs(shown[s] / shown.sum() - weight[s] / sum(weight.values())) < 0.02
    assert set(got["doc_id"]) == set(range(5200)) and not got.duplicated(["doc_id", "mix_epoch"]).any()
    assert mixing.mix(df).columns == df.columns and set(r["mix_tokens"] for r in mixing.mix(df).select("mix_tokens").distinct().collect()) == {2}

    # the schedule row by row, from the same hashes
    seed, per = 29, 500
    h = {r[0]: r[1] for r in df.select("doc_id", F.xxhash64("doc_id", F.lit(seed))).collect()}
    budget = {s: round(n**alpha * 200_000 ** (1 - alpha)) for s, n in tokens.items()}
    exponent = mixing.solve_exponent(spark.createDataFrame(list(tokens.items()), "source string, tokens long"), mixing.Target())
    assert abs(exponent - alpha) < 2e-4
    budget = {s: round(n**exponent * 200_000.0 ** (1 - exponent)) for s, n in tokens.items()}
    want = set()
    pairs = spark.range(450).crossJoin(spark.range(3).withColumnRenamed("id", "e"))
    order = {(r[0], r[1]): r[2] for r in pairs.select("id", "e", F.xxhash64("id", F.lit(seed), "e")).collect()}
    for s, n in tokens.items():
        blocks = {}
        for i, _, own in rows:
            if own == s:
                blocks.setdefault(h[i] % (n // per), []).append(i)
        epochs, rest = divmod(budget[s], n)
        shown, last = {b: epochs for b in blocks}, 0
        for b in sorted(blocks, key=lambda b: (order[b, epochs], b)):
            if last < rest:
                shown[b] += 1
            last += 50 * len(blocks[b])
        for e in range(epochs + 1):
            ranked = sorted((b for b in blocks if shown[b] > e), key=lambda b: (order[b, e], b))
            want |= {(i, e, b, k) for k, b in enumerate(ranked) for i in blocks[b]}
    assert {(r.doc_id, r.mix_epoch, r.mix_block, r.mix_rank) for r in got.itertuples()} == want

    totals = spark.createDataFrame(list(tokens.items()), "source string, tokens long")
    free = mixing.solve_exponent(totals, mixing.Target(max_repeat=None, entropy=1.3))
    w = np.array([n**free for n in tokens.values()])
    w /= w.sum()
    assert abs(-(w * np.log2(w)).sum() - 1.3) < 1e-3
    assert mixing.solve_exponent(totals, mixing.Target(entropy=1.3)) == exponent  # repeats stay bounded
    tiny = docs_of(spark, [(k, words(rng, 300), "a") for k in range(50)] + [(99, "one", "b")])
    assert mixing.schedule(tiny, mixing.Target(entropy=1.0)).where("doc_id = 99").count() <= 2
    everything = mixing.mix(awkward)
    assert everything.select("doc_id").distinct().count() == awkward.select("doc_id").distinct().count()
    assert mixing.mix(awkward.limit(0)).count() == 0


def test_slices_keep_the_order(spark):
    rng = random.Random(91)
    rows = [(rng.choice("aab"), k, rng.randrange(9)) for k in range(500)]
    df = spark.createDataFrame(rows, "key string, id long, n long")
    got = {r["id"]: (r["before"], r["h"]) for r in running(df.withColumn("h", F.xxhash64("id")), ["key"], F.col("h"), ["id"], 7, {"before": F.col("n")}).collect()}
    for key in "ab":
        total = 0
        for _, i, n in sorted((got[i][1], i, n) for k, i, n in rows if k == key):
            assert got[i][0] == total
            total += n


# -- 10 -------------------------------------------------------------------------------------------


def test_shards(spark, awkward):
    rng = random.Random(10)
    df = docs_of(spark, [(1000 + k * 7, words(rng, 3), "a") for k in range(1000)]).unionByName(awkward)
    got = sharding.shard(df, 24).toPandas()
    sizes = got.groupby("shard").size()
    assert len(got) == df.count() and sizes.max() - sizes.min() <= 1 and len(sizes) == 24
    assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in got.groupby("shard"))
    text = {r["doc_id"]: r["text"] or "" for r in df.collect()}
    for r in got.itertuples():
        raw = text[None if math.isnan(r.doc_id) else int(r.doc_id)].encode()
        assert (r.size, r.text_crc32) == (len(raw) + 8, zlib.crc32(raw))
    order = got.sort_values(["doc_id", "size", "text_crc32"], na_position="first").reset_index(drop=True)
    unique = ~order["doc_id"].duplicated(keep=False)
    for k in order.index[unique]:
        assert sharding.shard_of(k, len(got)) == (order["shard"][k], order["slot"][k])
    assert sharding.shard(df.limit(0)).count() == 0


def test_labels_fold(spark):
    got = spark.range(200).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in got)


def test_a_row_repeated_many_times_with_a_near_copy(spark):
    rng = random.Random(71)
    base = [f"w{rng.randrange(300)}" for _ in range(120)]
    near = " ".join([*base[:-1], "other"])
    spaced = [" ".join(base).replace(" ", " " * k) for k in range(1, 4)]  # other texts with the same set
    rows = [(5, spaced[k % 3], "a") for k in range(30_000)] + [(9, near, "a")] * 3000 + [(2, "far from all of these words here", "a")]
    got = ngram_join.near_duplicates(docs_of(spark, rows)).groupBy("doc_id", "n_shingles", "component_id").count().collect()
    assert sorted(tuple(r) for r in got) == [(2, 3, 2, 1), (5, 116, 5, 30_000), (9, 116, 5, 3000)]


def test_hot_rows_are_told_apart(spark):
    """Rows without an id are dealt to blocks by what they hold; rows alike in all columns are sorted apart."""
    rows = [(None, f"some words {k % 500} of text", "a") for k in range(4000)]
    mixed = mixing.schedule(docs_of(spark, rows), block_tokens=500).toPandas()
    assert len(mixed) >= 4000 and mixed["_mix_block"].nunique() > 10
    same = docs_of(spark, [(1, "alike", "a")] * 5000).repartition(8)
    scratch = Scratch(spark)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the rows are few and small
    try:
        numbered, n = sharding.number_rows(same.select("doc_id"), ["doc_id"], scratch)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert n == 5000 and sorted(r["row_no"] for r in numbered.collect()) == list(range(5000))
    parts = spark.read.parquet(scratch.root + "/1-numbered").groupBy(F.shiftright("_mid", 33)).count().collect()
    assert len(parts) > 1 and max(r["count"] for r in parts) < 4000
