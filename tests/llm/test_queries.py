"""Registered queries against their SQL, and the pipeline on planted cases."""

import pytest

import corpus_pipeline
from episcope.llm import kdtree, mixing, queries, simhash
from episcope.llm.registry import ORACLE, QUERIES
from tests.oracle import compare, connect


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, sf, name):
    assert compare(connect(sf), ORACLE[name], QUERIES[name](spark, sf)) is None


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_pipeline_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{i}")
        after = spark.read.parquet(f"{tmp_path}/{i}")
        n = after.count()
        if i < 4:
            assert after.columns == columns
        if name in ("mix", "shards"):
            assert n == before
        if name == "near_duplicates":
            found = simhash.near_duplicates(after)
            assert n < before and found.select("component_id").distinct().count() == n
        docs, before = after, n
    assert {r["shard"] for r in docs.select("shard").distinct().collect()} <= set(range(24))


def test_pipeline_of_nothing(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.count() == 0


def test_pipeline_result_follows_the_mix(spark, sf):
    rows = sorted(corpus_pipeline.run(spark, sf).collect(), key=lambda r: r["mix_rank"])
    assert [r["mix_rank"] for r in rows] == list(range(len(rows)))
    for shard in {r["shard"] for r in rows}:
        own = [r["slot"] for r in rows if r["shard"] == shard]
        assert own == list(range(len(own)))


def test_mix_shares_survive_the_files(spark, tmp_path):
    weights, block = {"a": 5, "b": 2, "*": 3}, 200
    docs = spark.range(6000).selectExpr("id AS doc_id", "repeat('x', cast(1 + id % 59 AS int)) AS text",
                                        "element_at(array('a', 'b', 'c'), cast(1 + id * id % 3 AS int)) AS source", "'en' AS lang", "1L AS n_chars")
    mixing.mixed(docs, weights, block).write.parquet(f"{tmp_path}/mix")
    ranked = mixing.ranked_as_stored(spark.read.parquet(f"{tmp_path}/mix"))
    sharded = kdtree.kd_shards(ranked, queries.document_coordinates(), queries.document_size(), 4, order="mix_rank").collect()
    rows = sorted(sharded, key=lambda r: r["mix_rank"])
    assert [r["mix_rank"] for r in rows] == list(range(6000))
    left, had, total = {s: sum(len(r["text"]) for r in rows if r["source"] == s) for s in "abc"}, dict.fromkeys("abc", 0), 0
    for r in rows:
        if min(left[s] - had[s] for s in "abc" if left[s]) < 2 * block:
            break
        had[r["source"]] += len(r["text"])
        total += len(r["text"])
        for s in "abc":
            if left[s]:
                share = weights.get(s, weights["*"]) / sum(weights.get(x, weights["*"]) for x in "abc" if left[x])
                assert abs(had[s] - share * total) <= 2 * block
    assert total > 10_000
    for shard in range(4):
        own = [r["slot"] for r in rows if r["shard"] == shard]
        assert own == list(range(len(own)))
