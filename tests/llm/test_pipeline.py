import os

import pytest

import __spark_entry__ as entry
import corpus_pipeline as P
from loamgrid.llm import shared


@pytest.fixture(scope="module")
def folder(awkward, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    awkward.write.parquet(f"{path}/documents.parquet")
    awkward.selectExpr("doc_id", "1 AS quality", "0 AS toxic").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_keep_the_columns_and_take_effect(spark, awkward, folder):
    docs, counts = awkward, []
    for name, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, folder).persist()
        assert docs.columns == awkward.columns, name
        counts.append(docs.count())
    assert counts[0] < awkward.count() and counts[2] < counts[1] <= counts[0]


def test_run(spark, folder):
    before = len(shared._MADE)
    rows = P.run(spark, folder).collect()
    assert rows and all(r["ids"][-1] == 2 for r in rows)
    assert [p.rsplit("/", 1)[1] for p in shared._MADE[before:]] == [f"stage{k}" for k in range(5)]
    assert not os.path.exists(shared._MADE[before].replace("stage0", "lines")) and os.path.exists(shared._MADE[-1])


def test_every_query_is_registered():
    names = entry.queries()
    for n in range(1, 11):
        assert sum(k.startswith(f"op{n}_") for k in names) == 1
    assert "pipeline" in names and set(entry.oracle_sql()) <= set(names)
