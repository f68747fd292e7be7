from collections import Counter

import pytest

import corpus_pipeline
from tarnflow.llm import common, jaccard, linededup, packing, templates, toxicity
from tests.conftest import SF

from .conftest import prose
from .test_against_brute_force import ITEM, brute_lines


@pytest.fixture(scope="module")
def folder(spark, make, tmp_path_factory, hazards):
    d = tmp_path_factory.mktemp("corpus")
    docs = make([(100 + i, prose(100 + i, 80, 8)) for i in range(12)] + [(200, prose(100, 80, 8)), (201, "first\n" + prose(101, 80, 8)), (202, ITEM + " " + prose(500)), (203, prose(101, 80, 1) + " z")])
    docs.unionByName(hazards).coalesce(2).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d)


def test_stages_keep_columns_and_act(spark, folder):
    docs = common.table(spark, folder, "documents")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.stored(stage(spark, docs, folder))
        assert docs.columns == before.columns and docs.count() <= before.count(), name
    ids = Counter(r["doc_id"] for r in docs.collect())
    assert 200 not in ids and 202 not in ids and 203 not in ids  # copied lines, a benchmark item, a near copy
    assert all(ids[100 + i] == 1 for i in range(12))
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert text[201] == "first" and text[4] is None and ids[5] == 1
    packed = corpus_pipeline.run(spark, folder).collect()
    assert Counter(r["doc_id"] for r in packed if r["doc_offset"] == 0) == ids


def test_pipeline_equals_its_stages_in_plain_python(spark):
    """Over the whole small table: the classifier's decisions are taken as they are, the others are made again."""
    docs = common.table(spark, SF, "documents")
    model = toxicity.train(docs, common.table(spark, SF, "labels"))
    toxic = {r["doc_id"] for r in toxicity.toxic_documents(docs, model).collect()}
    left = [(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] not in toxic]
    cut = brute_lines(left, linededup.MIN_LINES, linededup.MIN_CHARS)
    left = [(i, cut[i]) for i, t in left if cut[i] == t or cut[i].strip()]
    kept = spark.createDataFrame(left, "doc_id bigint, text string")
    gone = {i for r in jaccard.grouped(kept).collect() for i in r["doc_ids"] if i != r["group_id"]}  # itself held against all pairs elsewhere
    left = [(i, t) for i, t in left if i not in gone]
    leaks = {r["doc_id"] for r in templates.leaks(spark.createDataFrame(left, "doc_id bigint, text string"), common.table(spark, SF, "benchmark")).collect()}
    left = sorted((i, t) for i, t in left if i not in leaks)
    sizes = {r["doc_id"]: r["tokens"] for r in packing.lengths(spark.createDataFrame(left, "doc_id bigint, text string")).collect()}
    p = packing.Packer(packing.WINDOW)
    want = [(i, *piece) for i, _ in left for piece in p.place(sizes[i])]
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r["doc_id"], r["window_id"], r["window_offset"], r["doc_offset"], r["n_tokens"]) for r in got) == sorted(want)


def test_registry_names():
    import __spark_entry__

    names = list(__spark_entry__.queries())
    assert {f"op{i}" for i in range(1, 11)} <= {n.split("_")[0] for n in names} and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)
