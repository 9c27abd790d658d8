"""Probed vector search against the exact one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.operators import probing, semantic

QUERIES = "query_id string, variant_no int, vector array<float>, top int, namespaces array<string>, user_id string"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 16))
    points = (centres[rng.integers(0, 20, 1500)] + 0.3 * rng.normal(size=(1500, 16))).astype(np.float32)
    points[100:600] = points[100]  # a third of all vectors are equal
    rows = [(f"c{i}", f"u{i % 3}" if i % 7 else None, f"n{i % 50}", [float(x) for x in p]) for i, p in enumerate(points)]
    rows += [("none", "u1", "n1", None), ("zero", "u1", "n1", [0.0] * 16)]
    vectors = spark.createDataFrame(rows, "chunk_id string, owner string, namespace string, embedding array<float>").repartition(5)
    asked = [(f"q{i}", i % 2, [float(x) for x in points[i * 30] + 0.1], 8, ["n3"] if i == 4 else None, "u1" if i % 5 == 0 else None) for i in range(40)]
    index = probing.build(vectors, str(tmp_path_factory.mktemp("probes") / "lists"))
    return vectors, spark.createDataFrame(asked, QUERIES), index


def rows_of(found):
    return sorted((r.query_id, r.variant_no, r.chunk_id, r.score) for r in found.collect())


def test_every_vector_is_in_one_list(tables):
    vectors, _, index = tables
    stored = index.vectors.select("chunk_id", "list").collect()
    assert len(stored) == 1501 == index.sizes.sum() and len({r.chunk_id for r in stored}) == 1501
    assert len(index.centroids) == round(1501**0.5)
    counted = {r["list"]: r["count"] for r in index.vectors.groupBy("list").count().collect()}
    assert all(counted.get(i, 0) == n for i, n in enumerate(index.sizes))


def test_all_lists_give_the_exact_rows_and_few_lists_most_of_them(tables):
    vectors, asked, index = tables
    exact = semantic.vector_top_k(vectors.filter("embedding IS NOT NULL"), asked)
    assert rows_of(probing.search(index, asked, 10**6)) == rows_of(exact)
    probes, reached = probing.calibrate(index, asked, 0.9)
    assert reached >= 0.9 and probes <= len(index.centroids) // 4
    found = probing.search(index, asked, probes)
    assert probing.recall(found, exact) >= 0.9
    # many queries meet the lists in a grouped join, with equal rows
    assert rows_of(probing.search(index, asked, probes, broadcast_bytes=2000)) == rows_of(found)


def test_narrow_scopes_are_answered_exactly(tables):
    vectors, asked, index = tables
    narrow = asked.withColumn("namespaces", F.array(F.lit("n7"))).withColumn("user_id", F.lit(None).cast("string"))
    exact = semantic.vector_top_k(vectors.filter("embedding IS NOT NULL"), narrow)
    assert rows_of(probing.search(index, narrow, 1)) == rows_of(exact)


def test_only_probed_lists_are_read(tables):
    _, asked, index = tables
    plan = probing.probed(index, asked.limit(1), 2)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(list" in plan or "PartitionFilters: [list" in plan, plan


def test_no_vectors(spark, tables, tmp_path):
    vectors, asked, _ = tables
    index = probing.build(vectors.limit(0), str(tmp_path / "empty"))
    assert probing.search(index, asked, 3).count() == 0


def test_lists_are_found_after_a_text_function_was_used(spark, tables, tmp_path):
    vectors, asked, index = tables
    # a query that was planned binds the session to the text functions of the library
    semantic.query_variants(spark.createDataFrame([("q", "Ｒemember")], "query_id string, query string")).collect()
    assert probing.build(vectors, str(tmp_path / "again"), index.centroids).sizes.sum() == 1501
    assert rows_of(probing.search(index, asked, 2, broadcast_bytes=2000)) == rows_of(probing.search(index, asked, 2))


def test_scores_in_memory_do_not_grow_with_the_queries(monkeypatch):
    import pandas as pd

    rng = np.random.default_rng(1)
    ids, points = np.array([f"c{i}" for i in range(50)], dtype=object), list(rng.normal(size=(50, 4)))
    asked = pd.DataFrame(
        {"query_id": [f"q{i}" for i in range(30)], "variant_no": 0, "vector": points[:30], "top": 3, "namespaces": None, "user_id": None}
    )
    whole = pd.concat(semantic._best(ids, ids, ids, points, asked))
    monkeypatch.setattr(semantic, "SCORES", 200)
    blocks = list(semantic._best(ids, ids, ids, points, asked))
    assert [len(b) for b in blocks] == [12] * 7 + [6]
    assert pd.concat(blocks).reset_index(drop=True).equals(whole.reset_index(drop=True))
