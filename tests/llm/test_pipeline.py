import random

import public_tokenizers
import pyarrow as pa
import pytest
from helpers import SCHEMA, corpus, prose
from test_dedup import brute_classes, brute_removed
from test_text import brute_contamination, brute_quality

import corpus_pipeline
from threadloom.llm import encode, packing, suffix_dedup
from threadloom.llm.common import SLICE_ROWS, table


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(31)
    items = [(i, prose(rng, 30)) for i in range(4)]
    rows = [r for r in corpus() if r[0] is not None] + [
        (700 + i, f"{prose(rng, 60)} {text} {prose(rng, 60)}", "en", "s", 0) for i, (_, text) in enumerate(items)
    ]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows, items


def test_each_stage_takes_effect(spark, folder):
    path, _, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_duplicates", "repeats", "contamination", "packing"]
    seen = [list(map(tuple, docs.collect()))]
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        docs = table(stage(spark, docs, path))
        if name != "packing":
            assert docs.columns == columns
        seen.append(list(map(tuple, docs.collect())))
    raw, good, single, cut, clean, packed = seen
    base = [r for r in raw if not ((q := brute_quality(r[1]))[0] < 50 or 100 * q[4] > 50 * q[0])]
    assert set(good) <= set(base) and len(good) >= len(base) - 2
    assert set(single) <= set(good) and len(single) == sum(brute_classes(good).values())
    assert sorted(r[0] for r in cut) == sorted(r[0] for r in single)
    lengths = {eval(x)[0]: eval(x)[1] - eval(x)[2] for x in brute_removed(single)}
    assert all(len(r[1].encode()) == lengths[r[0]] for r in cut)
    flags = {eval(x)[0]: eval(x)[4] for x in brute_contamination(cut, items)}
    assert sorted(r[0] for r in clean) == sorted(i for i, bad in flags.items() if not bad)
    assert sum(flags.values()) >= 4
    totals = {r[0]: r[4] for r in packed}
    assert set(totals) == {r[0] for r in clean} and sum(r[2] for r in packed) == sum(totals.values())


def test_run_equals_its_stages(spark, folder):
    path, _, _ = folder
    assert corpus_pipeline.run(spark, path).columns[:5] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]


def test_tasks_that_encode_nothing_free_the_pieces_of_the_stage_before():
    encode.cache("words", "a file")["piece"] = b"1"
    rows = 2 * SLICE_ROWS + 1
    batch = pa.RecordBatch.from_pydict({"k1": list(range(rows)), "k2": list(range(rows)), "text": ["ab" * 300] * rows})
    found = list(suffix_dedup._runs([batch]))
    assert not encode.worker_state().caches and encode.worker_state().owner is None
    assert [len(set(b.column(0).to_pylist())) for b in found] == [SLICE_ROWS, SLICE_ROWS, 1]
