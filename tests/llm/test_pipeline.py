"""The pipeline over the smallest tables, stage by stage."""

from collections import Counter

import corpus_pipeline
import pytest

from voxelmill.llm import ngram_join, quality, toxicity
from voxelmill.llm._spark import Scratch, table

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def outputs(spark):
    scratch, docs, out = Scratch(spark), table(spark, DATA, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, scratch.save(stage(spark, docs, DATA), name)
        out.append((before, docs))
    return out


def ids(df):
    return Counter(r["doc_id"] for r in df.select("doc_id").collect())


def test_stages_keep_the_columns(spark, outputs):
    columns = table(spark, DATA, "documents").columns
    assert all(after.columns == columns for _, after in outputs[:-1])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "ngram_join", "mixing", "packing"]


def test_filters_follow_their_classifiers(spark, outputs):
    labels = table(spark, DATA, "labels")
    for (before, after), module, keep in ((outputs[0], toxicity, 0), (outputs[1], quality, 1)):
        want = module.classify(before, labels).where(f"predicted = {keep}")
        assert ids(after) == ids(want)


def test_one_of_each_group_stays(outputs):
    before, after = outputs[2]
    groups = {r["doc_id"]: r["component_id"] for r in ngram_join.near_duplicates(before).collect()}
    assert ids(after) == Counter({k: 1 for k in set(groups.values())})


def test_mixing_loses_nothing_and_packing_takes_all(outputs):
    before, mixed = outputs[3]
    assert set(ids(mixed)) == set(ids(before)) and max(ids(mixed).values()) <= 2
    _, packed = outputs[4]
    assert ids(packed) == ids(mixed)
    assert max(ids(mixed).values()) == 2 and not packed.groupBy("doc_id", "bucket", "batch").count().where("count > 1").count()


def test_run_is_the_stages(spark, outputs):
    got = corpus_pipeline.run(spark, DATA)
    assert got.columns == outputs[4][1].columns and ids(got) == ids(outputs[4][1])


def test_stages_take_awkward_rows(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "same words here", None, "a", 1), (3, "same words here", None, "a", 1)]
    rows += [(None, "no id", "en", None, 5), (4, "z" * 200_000 + " end", "en", "b", None), (5, "same words here", "en", "b", 2)]
    names = "doc_id long, text string, lang string, source string, n_chars long, k int, weight string, mix_note string, densities int, id long, low int"
    docs = spark.createDataFrame([(*r, 1, "w", "n", 2, 3, 4) for r in rows], names)
    seen = {}
    for df in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, DATA)
            assert name == "packing" or out.columns == docs.columns
            seen[name, df is docs] = ids(out)
    everything = ids(docs)
    assert seen["toxicity", True] == everything and seen["packing", True] == everything
    assert seen["ngram_join", True] == everything - Counter({5: 1})
    assert set(seen["mixing", True]) == set(everything)
    assert all(not v for (_, full), v in seen.items() if not full)
