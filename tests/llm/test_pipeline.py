"""The pipeline's stages on the test tables, each against its own input."""

import os

import pytest

import corpus_pipeline
from quiver.llm import queries
from tests.helpers import bag, duck
from tests.llm.test_near_copies import brute

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    df = queries.queries()[name](spark, FOLDER)
    found = duck(FOLDER).sql(queries.oracle_sql()[name])
    assert sorted(df.columns) == sorted(found.columns)
    assert bag(df.columns, df.collect()) == bag(found.columns, found.fetchall())


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, kept[-1], FOLDER).write.parquet(str(tmp_path / name))
        kept.append(spark.read.parquet(str(tmp_path / name)))
    assert all(k.columns == columns for k in kept[:-1])
    ids = [[r.doc_id for r in k.select("doc_id").collect()] for k in kept]
    # Near duplicates: the least id of each component of the stage's input, by brute force over 5-word shingles.
    assert sorted(ids[2]) == sorted({least for _, least in brute([(r.doc_id, r.text) for r in kept[1].collect()])})
    # Leaks: what holds a whole benchmark item is gone, the rest stays.
    items = [r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    texts = {r.doc_id: r.text for r in kept[2].collect()}
    holding = {i for i, t in texts.items() if any(x in t for x in items)}
    assert holding and not holding & set(ids[3]) and len(ids[3]) >= len(ids[2]) - len(holding) - 3
    assert set(ids[4]) <= set(ids[3]) and len(ids[5]) == len(ids[4])


def odd_rows(spark):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, h bigint, root string"
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(0, None), (1, ""), (2, "same id one"), (2, "same id but another text"), (2, "same id one"), (None, "no id"), (None, "no id"), (3, long), (4, long), (5, "plain words of a clean document")]
    return spark.createDataFrame([(i, t, None if i == 5 else "en", None, None, 1, "x") for i, t in rows], schema), long


def test_near_stage_on_odd_rows(spark):
    docs, long = odd_rows(spark)
    kept = corpus_pipeline.drop_near_copies(spark, docs, FOLDER)
    assert kept.columns == corpus_pipeline.COLUMNS
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
    assert got == sorted([(0, None), (2, "same id one"), (2, "same id but another text"), (None, "no id"), (None, "no id"), (3, long), (5, "plain words of a clean document")], key=repr)


def test_all_stages_on_odd_rows(spark):
    docs, _ = odd_rows(spark)
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, FOLDER)
        assert name == "sharding" or found.columns == corpus_pipeline.COLUMNS
        n = found.count()
        assert n == {"near_duplicates": 7}.get(name, n) and (n == 10 or name in ("near_duplicates", "mixing"))
        assert stage(spark, docs.limit(0), FOLDER).count() == 0
