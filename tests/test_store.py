"""Stores that are written, changed and read back: deletion, appends, poison revisions, states as a stream."""

import os
import random
import re
import tempfile

import pytest
from pyspark.sql import functions as F
from test_import import branched, node, write

from threadloom.functions import fixed
from threadloom.llm.common import table
from threadloom.operators import erasure, lexical, mutations, signals, state
from threadloom.session import CLEANUP, stored
from threadloom.sources import canonical, exports
from threadloom.streaming import ingest, lifecycle


def imported(spark, n=6, buckets=4):
    """A store with ``n`` conversations of owner u, all indexed."""
    folder = tempfile.mkdtemp(prefix="spark-")
    items = [{"id": f"c{i}", "title": f"t{i}", "mapping": {"x": node("x", None, [], f"only {i}")}} for i in range(n - 1)]
    write(folder, "a.json", [branched(), *items])
    store = folder + "/store"
    for name in ("revisions", "nodes", "index_state", "import_items", "chunks", "postings", "documents", "tombstones"):
        canonical.bucket_count(spark, f"{store}/{name}", buckets)
    now = F.current_timestamp()
    ingest.ingest_batch(exports.read_export(spark, folder), store, "u", "g", now)
    return store


def contents(spark, store):
    out = {}
    for name in sorted(n for n in os.listdir(store) if not n.endswith(".layout") and n != "deletions"):
        df = canonical.read_table(spark, f"{store}/{name}")
        if df is not None:
            out[name] = sorted(map(str, df.drop("at", "deleted_at", "seq").collect()))
    return out


REQUEST = "request_id string, conversation_id string, namespaces array<string>, user_id string"


@pytest.mark.parametrize("lost", [1, 5])
def test_deletion_is_resumed_where_it_was_lost(spark, monkeypatch, lost):
    store = imported(spark)
    ingest.index_batch(spark.read.parquet(f"{store}/revisions"), store, "g", F.current_timestamp())
    log = spark.read.parquet(f"{store}/revisions").collect()
    gone, foreign = log[0].conversation_id, log[1].conversation_id
    asked = spark.createDataFrame([("r1", gone, None, "u"), ("r2", foreign, None, "someone"), ("r3", "nobody", None, None), ("r4", foreign, ["else"], None)], REQUEST)
    real, calls = canonical.rewrite, []

    def failing(*args, **kwargs):
        calls.append(None)
        if len(calls) == lost + 1:
            raise OSError("lost")
        return real(*args, **kwargs)

    monkeypatch.setattr(canonical, "rewrite", failing)
    first = {r.request_id: (r.outcome, r.stage) for r in erasure.delete_conversations(spark, store, asked, "b", F.current_timestamp()).collect()}
    assert first["r1"] == ("failed", erasure.STEPS[lost][0]) and first["r2"] == first["r3"] == first["r4"] == ("missing", None)
    # readers stop seeing it at once
    heads, nodes = canonical.load_current(spark, store, asked)
    assert heads.count() == 0 and (nodes is None or nodes.count() == 0)
    done = len(calls)
    second = {r.request_id: r.outcome for r in erasure.delete_conversations(spark, store, asked, "b", F.current_timestamp()).collect()}
    assert second["r1"] == "deleted" and len(calls) - done == len(erasure.STEPS) - lost
    after = contents(spark, store)
    assert not any(gone in row for name, rows in after.items() if name != "tombstones" for row in rows)
    assert len(after["import_items"]) == 6 and len(after["revisions"]) == 5 and len(after["tombstones"]) == 1
    third = erasure.delete_conversations(spark, store, asked, "again", F.current_timestamp()).collect()
    assert {r.outcome for r in third} == {"missing"} and contents(spark, store) == after


def test_lookups_read_their_buckets_only(spark):
    store = imported(spark, 12, buckets=8)
    one = spark.read.parquet(f"{store}/revisions").select("conversation_id").limit(1)
    asked = stored(one.select(F.lit("r").alias("request_id"), "conversation_id", F.lit(None).cast("array<string>").alias("namespaces"), F.lit("u").alias("user_id")))
    heads, nodes = canonical.load_current(spark, store, asked)
    assert heads.count() == 1 and nodes.select("revision_id").distinct().count() == 1
    plan = nodes._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [(bucket" in plan or "PartitionFilters: [bucket" in plan, plan
    foreign = asked.withColumn("user_id", F.lit("v"))
    assert canonical.load_current(spark, store, foreign)[0].count() == 0
    assert canonical.bucket_count(spark, f"{store}/nodes", 99) == 8


def test_a_poison_revision_is_set_aside(spark, monkeypatch):
    store = imported(spark, 5)
    monkeypatch.setattr(fixed, "MAX_ATTEMPTS", 2)
    log = spark.read.parquet(f"{store}/revisions")
    bad = log.orderBy("revision_id").collect()[2].revision_id
    failing, made = [True], []

    def derive(todo, *args):
        asked = [r.revision_id for r in todo.select("revision_id").collect()]
        if failing[0] and bad in asked:
            raise ValueError("cannot be read")
        made.extend(asked)
        return todo.select("revision_id")

    monkeypatch.setattr(ingest, "_derive", derive)
    ingest.index_batch(log, store, "g", F.current_timestamp())
    events = lambda: {r.revision_id: r for r in state.latest_state(spark.read.parquet(f"{store}/index_state")).collect()}
    found = events()
    assert found[bad].status == "failed" and found[bad].error_message == "cannot be read"
    assert [r.status for k, r in found.items() if k != bad] == ["indexed"] * 4
    assert len(made) == 4 and bad not in made
    # later batches try it again, until its attempts are used up
    nothing = log.limit(0)
    with pytest.raises(ValueError):
        ingest.index_batch(nothing, store, "g", F.current_timestamp())
    latest = state.latest_state(spark.read.parquet(f"{store}/index_state"))
    assert [r.revision_id for r in state.dead_letter(latest).collect()] == [bad] and events()[bad].attempts == 2
    failing[0] = False
    ingest.index_batch(log, store, "g", F.current_timestamp())
    assert events()[bad].status == "failed"


@pytest.mark.filterwarnings("ignore::FutureWarning")
def test_states_from_a_stream_equal_the_batch(spark):
    rng = random.Random(3)
    kinds = ["queued", "processing", "indexed", "failed"]
    rows = [(f"r{rng.randrange(9)}", "g", rng.choice(kinds), 1_700_000_000 + rng.randrange(500), i) for i in range(200)]
    folder = tempfile.mkdtemp(prefix="spark-")
    schema = "revision_id string, generation_id string, status string, at long, seq long"
    typed = lambda df: df.withColumn("at", F.timestamp_seconds("at"))

    def deliver(some):
        spark.createDataFrame(some, schema).coalesce(1).write.mode("append").parquet(folder + "/in")
        events = typed(spark.readStream.schema(schema).parquet(folder + "/in"))
        lifecycle.latest_state_stream(events, folder + "/state", folder + "/progress").awaitTermination()

    mixed = rows[:]
    rng.shuffle(mixed)
    deliver(mixed[:120])
    deliver(mixed[90:] + mixed[:5])  # after a restart, some of them again
    want = sorted(map(tuple, state.latest_state(typed(spark.createDataFrame(rows, schema))).collect()))
    got = canonical.read_table(spark, folder + "/state").select(*state.latest_state(typed(spark.createDataFrame(rows, schema))).columns)
    assert sorted(map(tuple, got.collect())) == want


def test_appends_on_one_base(spark):
    nodes = spark.createDataFrame(
        [("c", "base", "a", None, "user", "hi", False), ("c", "base", "b", "a", "assistant", "yes", True), ("d", "other", "z", None, "user", "x", True)],
        "conversation_id string, revision_id string, node_id string, parent_id string, role string, text string, is_leaf boolean",
    )
    heads = spark.createDataFrame(
        [("c", "base", "b", 2, ["One", "two"], "T", "n"), ("d", "other", "z", 1, [], "D", "n")],
        "conversation_id string, revision_id string, current_node string, active_messages long, tags array<string>, title string, namespace string",
    )
    said = [("user", "more", None), ("assistant", "done", None)]
    appends = spark.createDataFrame(
        [("r1", "c", "base", 2, said, ["TWO", "new"]), ("r2", "c", "base", 1, said[:1], None), ("r3", "c", "old", 0, said, None), ("r4", "x", "base", 0, said, None)],
        "request_id string, conversation_id string, base_revision_id string, seq long, messages array<struct<role:string,content:string,timestamp:timestamp>>, tags array<string>",
    )
    done = mutations.append_revisions(appends, heads, nodes, F.lit("2026-01-02").cast("timestamp"))
    assert {tuple(r) for r in done.outcomes.collect()} == {("r1", "conflict"), ("r2", "applied"), ("r3", "conflict"), ("r4", "not_found")}
    made = {r.request_id: r for r in done.revisions.collect()}
    assert set(made) == {"r1", "r2"} and {r.base_revision_id for r in made.values()} == {"base"}
    assert made["r1"].tags == ["one", "two", "new"] and made["r2"].tags == ["one", "two"]
    assert [r.request_id for r in done.claims.collect()] == ["r2"]
    held = {}
    for r in done.nodes.collect():
        held.setdefault(r.revision_id, {})[r.node_id] = r
    lost = held[made["r1"].revision_id]  # can still be read
    assert len(lost) == 4 and len(held[made["r2"].revision_id]) == 3 and made["r1"].revision_id != made["r2"].revision_id
    last = lost[made["r1"].current_node]
    assert last.text == "done" and last.is_leaf and lost[last.parent_id].text == "more" and lost[last.parent_id].parent_id == "b"
    assert not lost["b"].is_leaf
    again = mutations.append_revisions(appends, heads, nodes, F.lit("2026-01-02").cast("timestamp"))
    assert {r.revision_id for r in again.revisions.collect()} == {r.revision_id for r in made.values()}


def test_signals_are_made_once_for_each_text(spark):
    chunks = spark.createDataFrame([("1", "T", "One body."), ("2", "T", "One body."), ("3", "TO", "ne body."), ("4", None, "x")], "chunk_id string, title string, body string")
    known = stored(signals.analysed(chunks))
    assert known.count() == 3
    more = chunks.unionByName(spark.createDataFrame([("5", "U", "new")], chunks.schema))
    assert signals.analysed(more, known).count() == 1
    assert signals.extended(known, more).select(signals.KEY).distinct().count() == 4


def test_bounded_scores_are_the_exact_ones(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(60)]
    chunks = [(f"c{i:03}", "", " ".join(rng.choices(words, [1 / (k + 1) for k in range(60)], k=rng.randint(5, 60)))) for i in range(300)]
    index = lexical.stored_index(lexical.build_index(spark.createDataFrame(chunks, "chunk_id string, title string, body string")))
    queries = [(f"q{i}", " ".join(rng.sample(words, 9)), 5, ["n1"] if i % 3 == 0 else None, "u" if i % 4 == 0 else None) for i in range(12)]
    queries = spark.createDataFrame(queries, "query_id string, query string, pool int, namespaces array<string>, user_id string")
    live = spark.createDataFrame([(f"c{i:03}", f"n{i % 2}", "u" if i % 5 else "v") for i in range(290)], "chunk_id string, namespace string, owner string")
    found = lexical.weigh(index, lexical.query_terms(queries))
    whole = lexical._summed(found)
    allowed = whole.join(live, "chunk_id").join(queries, "query_id").filter(
        lexical.in_scope(F.col("namespaces"), F.col("user_id"), F.col("namespace"), F.col("owner"))
    )
    want = lexical.top_k(allowed.withColumn("_s", F.round("score", 9)), F.col("pool"), 5, [F.col("_s").desc(), F.col("chunk_id")])
    key = lambda df: sorted((r.query_id, r.chunk_id, round(r.score, 9)) for r in df.collect())
    for rows in (40, 200, 10**6):
        best = lexical.best(found, queries, live, sample_rows=rows)
        ranked = lexical.top_k(best.join(queries.select("query_id", "pool"), "query_id").withColumn("_s", F.round("score", 9)), F.col("pool"), 5, [F.col("_s").desc(), F.col("chunk_id")])
        assert key(ranked) == key(want)
    # bounds leave most matches of common words out
    assert lexical.best(found, queries, live, sample_rows=200).count() < allowed.count() / 2


def test_recent_candidates_write_no_chunks_and_no_index(spark):
    from threadloom.plans import search_queries

    d = "/root/testdata/sf0.001"
    search_queries.recent_candidates(spark, d)
    made = vars(search_queries.built(spark, d))
    assert "heads" in made and not {"corpus", "chunks", "index"} & set(made)


def test_channels_chunk_only_what_they_search(spark):
    from threadloom.plans import search_queries

    made = search_queries.Built(spark, "/root/testdata/sf0.001")
    pending, owners = made.pending.select("conversation_id").distinct(), made.vectors.select("chunk_id", "conversation_id")
    narrow = [sorted(made.recent_chunks.select("chunk_id").collect()), sorted(owners.collect())]
    assert made.pending.count() and "chunks" not in vars(made)
    assert {r[0] for r in made.recent_chunks.select("conversation_id").collect()} <= {r[0] for r in pending.collect()}
    whole = search_queries.Built(spark, made.d)
    whole.chunks
    assert narrow == [sorted(whole.recent_chunks.select("chunk_id").collect()), sorted(whole.vectors.select("chunk_id", "conversation_id").collect())]


def test_pairs_of_queries_and_chunks_are_not_shuffled_to_be_summed(spark):
    chunks = spark.createDataFrame([(f"c{i}", "", f"red dragon w{i % 7} w{i % 3}") for i in range(60)], "chunk_id string, title string, body string")
    index = lexical.stored_index(lexical.build_index(chunks))
    queries = spark.createDataFrame(
        [(f"q{i}", f"red w{i % 7} dragon", 5, None, None) for i in range(6)],
        "query_id string, query string, pool int, namespaces array<string>, user_id string",
    )
    live = chunks.select("chunk_id", F.lit("n").alias("namespace"), F.lit("u").alias("owner"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as if there were many matches
    try:
        best = lexical.best(lexical.weigh(index, lexical.query_terms(queries)), queries, live)
        plan = best._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    shuffled = re.findall(r"hashpartitioning\(([^)]*)\)", plan)
    assert shuffled and not any("query_id" in keys and "chunk_id" in keys for keys in shuffled)


def test_a_phrase_is_looked_up_in_chunks_that_hold_its_rarest_tokens(spark, monkeypatch):
    bodies = ["red dragon coast bird", *[f"red x{i}" for i in range(9)], *[f"dragon coast y{i}" for i in range(9)]]
    chunks = spark.createDataFrame([(f"c{i}", "", b) for i, b in enumerate(bodies)], "chunk_id string, title string, body string")
    terms = spark.createDataFrame(
        [("q", 0, "t", ["red", "dragon", "coast"], False)], "query_id string, term_no int, kind string, tokens array<string>, prefix boolean"
    )
    asked, real = [], lexical._verified_phrases
    monkeypatch.setattr(lexical, "_verified_phrases", lambda c, *more: asked.extend(r.chunk_id for r in c.collect()) or real(c, *more))
    found = lexical.match(lexical.build_index(chunks), terms).collect()
    assert asked == ["c0"] and [(r.chunk_id, r.freq) for r in found] == [("c0", 1.0)]


def test_a_first_append_is_made_durable_once(spark, tmp_path, monkeypatch):
    from threadloom.sources import canonical

    calls, real = [], canonical.durable
    monkeypatch.setattr(canonical, "durable", lambda df: calls.append(df) or real(df))
    rows = spark.createDataFrame([("r1", "a"), ("r1", "a"), ("r2", None), ("r2", None)], "revision_id string, node_id string")
    path = str(tmp_path / "nodes")
    assert canonical.append_new(rows, path, ["revision_id", "node_id"], bucket_by="revision_id").count() == 2
    assert len(calls) == 1
    assert canonical.append_new(rows, path, ["revision_id", "node_id"], bucket_by="revision_id").count() == 0
    assert spark.read.parquet(path).count() == 2


def test_shuffle_files_go_with_the_write_that_made_them(spark):
    def shuffled():
        blocks = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllBlocks()
        return {b for b in blocks.mkString(",").split(",") if b.startswith("shuffle_")}

    rows = spark.range(2000).withColumn("k", F.col("id") % 50)
    for write in (stored, table):
        before = shuffled()
        kept = write(rows.groupBy("k").agg(F.sum("id").alias("s")).join(rows.repartition(5, "id"), "k"))
        assert not shuffled() - before
        assert kept.count() == 2000 and spark.conf.get(CLEANUP, "false") == "false"
