"""The stages on a small folder, each against a plain version, and the registered queries."""

import os
import random

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from seawake.checks.run import compare, connect
from seawake.llm import pii, queries
from tests.conftest import SF
from tests.llm.helpers import components, documents, edited, prose, shingles
from tests.llm.test_rules import toxic_corpus


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("sf"))
    rng = random.Random(9)
    texts, toxic = toxic_corpus(240, 5)
    items = [prose(rng, 30) for _ in range(4)]
    texts += [edited(rng, texts[k], k % 2) for k in range(1, 60)]
    texts += [prose(rng, 30) + " " + items[k % 4] + " " + prose(rng, 30) for k in range(12)]
    texts += [prose(rng, 40) + f" mail{k}@example.org" for k in range(10)] + [None, ""]
    documents(spark, texts).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(i, 1, toxic[i]) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame([*enumerate(items)], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return where, texts, toxic, items


def test_stages(spark, folder):
    where, texts, toxic, items = folder
    docs = spark.read.parquet(f"{where}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, where), "stage")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    first, second, third, fourth = kept.values()
    bad = {i for i in range(len(texts)) if i < 240 and toxic[i]}
    assert len(bad & first.keys()) <= len(bad) // 8 and len(texts) - len(first) <= len(bad) + 12
    root = components([(i, shingles(t)) for i, t in sorted(first.items())])
    assert second.keys() == {i for i in first if root[i] == i}
    assert third.keys() == {i for i, t in second.items() if not any(x in (t or "") for x in items)}
    assert fourth == {i: t if t is None else pii.masked(t) for i, t in third.items()} and any("[EMAIL]" in (t or "") for t in fourth.values())
    got = corpus_pipeline.run(spark, where)
    assert {r["doc_id"] for r in got.select("doc_id").distinct().collect()} == fourth.keys()
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_stages_work_in_small_batches(spark, folder):
    """A stage that is called by itself, and its rows asked for later, holds few texts at a time."""
    docs, size = spark.read.parquet(f"{folder[0]}/documents.parquet"), "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    try:
        for _, stage in corpus_pipeline.STAGES:
            spark.conf.set(size, "10000")
            stage(spark, docs, folder[0])
            assert int(spark.conf.get(size)) <= 2000
        spark.conf.set(size, "10000")
        corpus_pipeline.run(spark, folder[0])
        assert spark.conf.get(size) == "10000"
    finally:
        spark.conf.set(size, before)


def test_one_row_of_each_group_stays(spark):
    """Repeated rows, rows without doc_id, clashing columns, an empty table."""
    from pyspark.sql import functions as F

    rng = random.Random(2)
    a, b, c = (prose(rng, 40) for _ in "abc")
    rows = [(5, a), (5, a), (9, a + " more"), (None, a), (None, b), (None, b), (7, None), (8, ""), (None, None), (3, c), (3, b)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"component_id": F.lit(1), "_rows_": F.lit("x")})
    got = corpus_pipeline.one_of_each_group(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted([(5, a), (7, None), (8, ""), (None, None), (3, max(b, c))], key=str)
    assert corpus_pipeline.one_of_each_group(spark, docs.limit(0), "").count() == 0


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_with_sql(spark, con, name):
    assert compare(queries.QUERIES[name](spark, SF), con, queries.ORACLES[name]) is None


def test_all_are_registered():
    names = set(entry.queries())
    assert {f"op{n}" for n in range(1, 14)} <= {x.split("_")[0] for x in names} and "pipeline" in names
    assert set(entry.oracle_sql()) <= names


def test_nothing_else_imports_the_subpackage():
    import seawake

    root = os.path.dirname(seawake.__file__)
    for folder, _, files in os.walk(root):
        if os.path.basename(folder) != "llm":
            for f in files:
                if f.endswith(".py"):
                    with open(os.path.join(folder, f)) as source:
                        assert "seawake.llm" not in source.read()
