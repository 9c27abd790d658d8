"""What tables and steps leave on the disks: written tables, shuffle files, texts and signals that move."""

import os
import re
import time
import uuid

from pyspark.sql import functions as F

from threadloom.operators import lexical, ranking
from threadloom.session import checkpoint_dir, durable, stored, stored_in_turns


def test_shuffle_files_of_a_checkpoint_go_with_it(spark):
    blocks = lambda: spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllBlocks().mkString(",").split(",")
    before = {b for b in blocks() if b.startswith("shuffle_")}
    rows = spark.range(2000).groupBy((F.col("id") % 50).alias("k")).agg(F.sum("id").alias("s"))
    kept = durable(rows)
    end = time.time() + 10  # files are removed beside the statement
    while {b for b in blocks() if b.startswith("shuffle_")} - before and time.time() < end:
        time.sleep(0.1)
    assert not {b for b in blocks() if b.startswith("shuffle_")} - before
    assert kept.count() == 50 and kept.agg(F.sum("s")).first()[0] == 1999000


def test_tables_made_in_turns_hold_every_row_once(spark):
    rows = spark.range(100).withColumn("k", F.concat(F.lit("c"), "id"))
    made = stored_in_turns(spark, lambda turn: rows.filter(F.pmod(F.xxhash64("k"), F.lit(3)) == turn), 3)
    assert sorted(r.id for r in made.collect()) == list(range(100))


def test_stored_tables_are_compact(spark):
    words = spark.range(3000).select(F.concat_ws(" ", *[F.sha2((F.col("id") * 7 + i).cast("string"), 256) for i in range(4)]).alias("text"))
    size = lambda df: sum(os.path.getsize(f.removeprefix("file://").removeprefix("file:")) for f in df.inputFiles())
    plain = f"{checkpoint_dir(spark).removeprefix('file://')}/plain-{uuid.uuid4().hex}"
    words.write.parquet(plain)
    assert size(stored(words)) < 0.75 * size(spark.read.parquet(plain))


def test_chunks_are_the_same_in_several_turns(spark, monkeypatch):
    from threadloom.plans import search_queries

    d = "/root/testdata/sf0.001"
    key = lambda made: sorted((r.chunk_id, r.body, r.waits, r.owner) for r in made.chunks.select("chunk_id", "body", "waits", "owner").collect())
    whole = search_queries.Built(spark, d)
    monkeypatch.setattr(search_queries, "TURN_BYTES", 200_000)
    turns, real = [], search_queries.stored_in_turns
    monkeypatch.setattr(search_queries, "stored_in_turns", lambda s, make, n: turns.append(n) or real(s, make, n))
    cut = search_queries.Built(spark, d)
    assert key(cut) and turns[0] > 1
    monkeypatch.setattr(search_queries, "TURN_BYTES", 1 << 40)
    assert key(whole) == key(cut) and turns[1] == 1


def test_texts_of_chunks_are_not_moved_to_leave_out_those_that_wait(spark):
    from threadloom.plans import search_queries

    made = search_queries.Built(spark, "/root/testdata/sf0.001")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as if many revisions were waiting
    try:
        plan = made.indexed._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "Exchange" not in plan
    waiting = made.state.filter(F.col("status").isin("queued", "processing")).select("revision_id")
    assert waiting.count() and made.indexed.count() == made.chunks.join(waiting, "revision_id", "left_anti").count()


def test_matches_are_moved_as_one_row_per_chunk(spark):
    chunks = spark.createDataFrame([(f"c{i}", "", f"red dragon coast w{i % 7} w{i % 3}") for i in range(60)], "chunk_id string, title string, body string")
    index = lexical.stored_index(lexical.build_index(chunks))
    queries = spark.createDataFrame([("q", "red dragon coast w1 w2", 5, None, None)], "query_id string, query string, pool int, namespaces array<string>, user_id string")
    live = chunks.select("chunk_id", F.lit("n").alias("namespace"), F.lit("u").alias("owner"))
    best = lexical.best(lexical.weigh(index, lexical.query_terms(queries)), queries, live)
    plan = best._jdf.queryExecution().executedPlan().toString().split("\n")
    moved = [plan[i + 1] for i, line in enumerate(plan) if "Exchange hashpartitioning(chunk_id" in line]
    assert any("partial_collect_list(term_no" in line for line in moved)
    assert not any("freq" in line and "collect_list" not in line for line in moved)


def test_signals_are_not_moved_to_the_queries(spark, monkeypatch):
    plans, real = [], ranking.durable
    monkeypatch.setattr(ranking, "durable", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df))
    candidates = spark.createDataFrame(
        [(f"q{i % 7}", f"k{i % 20}", i, None, None) for i in range(140)],
        "query_id string, chunk_id string, lexical_rank int, semantic_raw double, recent_score double",
    )
    rows = spark.createDataFrame(
        [(f"k{i}", f"c{i}", "Caf\u00e9", f"The pier has w{i}.", None) for i in range(20)],
        "chunk_id string, conversation_id string, title string, body string, conversation_timestamp timestamp",
    )
    queries = spark.createDataFrame(
        [(f"q{i}", f"pier w{i}", [], None) for i in range(7)], "query_id string, query string, tags array<string>, as_of timestamp"
    )
    tags = spark.createDataFrame([], "conversation_id string, tag string, seq int")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = ranking.rank(candidates, rows, queries, tags).select("query_id", "chunk_id", "lexical_rank").collect()
        monkeypatch.setattr(ranking, "QUERIES_PER_ROW", 2)
        again = ranking.rank(candidates, rows, queries, tags).select("query_id", "chunk_id", "lexical_rank").collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    want = sorted((r.query_id, r.chunk_id, r.lexical_rank) for r in candidates.collect())
    assert sorted(map(tuple, found)) == sorted(map(tuple, again)) == want
    lines = plans[0].split("\n")
    depth = [len(re.match(r"[ :+-]*", line)[0]) for line in lines]
    for i, line in enumerate(lines):
        if "Exchange hashpartitioning(chunk_id" in line:
            below = [lines[j] for j in range(i + 1, len(lines)) if all(depth[k] > depth[i] for k in range(i + 1, j + 1))]
            assert not any("ArrowEvalPython" in x for x in below)
    assert any("ArrowEvalPython" in line for line in lines)
