"""The queries of the subpackage on the smallest tables, and the pipeline's stages on their own input."""

import duckdb
import pytest
from llm_helpers import WORD

import corpus_pipeline
from entitle.llm.exact_dedup import exact_groups
from entitle.llm.near_dedup import near_groups
from entitle.llm.quality_rules import quality
from entitle.llm.registry import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"
NATIVE = ("op3_mix_sources", "op5_secret_scan")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in ("documents", "pages", "benchmark", "conversations", "embeddings"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    frame = QUERIES[name](spark, SMALL)
    if name in NATIVE:
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    got = frame.toPandas()
    assert len(got) > 0
    if name in ORACLES:
        want = duck.execute(ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        columns = sorted(got.columns)
        tidy = lambda f: sorted(map(tuple, f[columns].astype(str).values.tolist()))
        assert tidy(got) == tidy(want)


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, made = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SMALL).write.parquet(f"{tmp_path}/{k}")
        made.append((docs, docs := spark.read.parquet(f"{tmp_path}/{k}")))
    assert all(after.columns == columns for _, after in made[:-1])
    ids = lambda frame: {r.doc_id for r in frame.select("doc_id").collect()}
    assert ids(made[0][1]) == ids(quality(made[0][0]).where("kept"))
    assert ids(made[1][1]) == ids(exact_groups(made[1][0]).where("kept"))
    assert ids(made[2][1]) == ids(near_groups(made[2][0]).where("kept"))
    before, after = (sum(len(WORD.findall(r.text)) for r in frame.collect()) for frame in made[3])
    assert abs(after - 1.5 * before) < 0.02 * before
    tokens = made[4][1]
    assert tokens.columns == ["doc_id", "source", "n_tokens", "ids"] and tokens.count() == made[4][0].count()
    assert corpus_pipeline.run(spark, SMALL).count() == tokens.count()
