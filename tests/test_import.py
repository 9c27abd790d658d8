"""Exports, canonical tables and streaming."""

import json
import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.functions.ids import stable_json
from threadloom.operators import chunking, graph, state
from threadloom.sources import canonical, exports
from threadloom.streaming import ingest


def node(name, parent, children, text=None, role="user", **message):
    body = None
    if text is not None:
        body = {"author": {"role": role}, "content": {"content_type": "text", "parts": [text]}, "metadata": {}, **message}
    return {"id": name, "parent": parent, "children": children, "message": body}


def branched():
    return {
        "id": "chat-1",
        "title": "  Migration decision ",
        "create_time": 1_700_000_000,
        "update_time": 1_700_000_100.5,
        "current_node": "b-active",
        "mapping": {
            "root": node("root", None, ["a-user"]),
            "a-user": node("a-user", "root", ["b-active", "b-alt"], "How do we migrate?", create_time=1_700_000_010),
            "b-active": node("b-active", "a-user", [], "Use an additive migration.", "assistant", metadata={"model_slug": "m-1"}),
            "b-alt": node("b-alt", "a-user", [], "Rebuild from scratch.", "assistant", content={"parts": ["x", {"k": 1}, None]}),
            "deleted": {"id": "deleted", "parent": None, "children": [], "message": None, "odd": "kept"},
        },
        "plugin_ids": None,
    }


def write(folder, name, value):
    with open(f"{folder}/{name}", "w", encoding="utf-8") as out:
        out.write(value if isinstance(value, str) else json.dumps(value))


def test_normalize_export(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    untitled = {"conversation_id": "chat-2", "title": " ", "mapping": {"x": node("x", None, [], "only")}}
    write(folder, "a.json", [branched(), untitled, {"id": "broken", "title": "no graph"}])
    headers, nodes, rejected = exports.normalize_export(exports.read_export(spark, folder))
    heads = {h["source_id"]: h for h in headers.collect()}
    assert heads["chat-1"]["title"] == "Migration decision"
    assert heads["chat-2"]["title"] == "Untitled conversation" and heads["chat-2"]["current_node"] == "x"
    assert heads["chat-1"]["namespace"] == "personal"
    assert [r["error_message"] for r in rejected.collect()] == ["mapping: required"]
    found = {n["node_id"]: n for n in nodes.collect()}
    assert found["b-active"]["model_slug"] == "m-1" and found["a-user"]["role"] == "user"
    assert found["b-alt"]["text"] == 'x\n{"k":1}\nnull'
    assert json.loads(found["deleted"]["raw"])["odd"] == "kept"
    assert found["root"]["text"] == "" and found["b-active"]["line_number"] == 3
    assert str(found["a-user"]["created_at"]) == "2023-11-14 22:13:30"
    paths = graph.branches(nodes, headers, "conversation_id").orderBy("branch_key", "pos").collect()
    active = [p["node_id"] for p in paths if p["branch_key"] == "active" and p["node_id"] != "x"]
    assert active == ["root", "a-user", "b-active"]
    assert [p["node_id"] for p in paths if p["branch_key"] == "alternate:b-alt"] == ["a-user", "b-alt"]


def test_truncated_file_is_rejected_as_a_whole(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    write(folder, "bad.json", json.dumps([branched()])[:-5])
    _, nodes, rejected = exports.normalize_export(exports.read_export(spark, folder))
    assert nodes.count() == 0 and rejected.count() == 1


def test_stable_json_sorts_keys(spark):
    row = spark.createDataFrame([('{"b":1,"a":{"d":2,"c":[3,{"z":1,"y":2}]}}',)], "j string")
    assert row.select(stable_json(F.col("j"))).first()[0] == '{"a":{"c":[3,{"y":2,"z":1}],"d":2},"b":1}'


def test_segments_round_trip(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    headers = spark.createDataFrame([("c1", "t")], "conversation_id string, title string")
    nodes = spark.createDataFrame([("c1", "n1", 'a "quoted"\ntext'), ("c1", "n2", "ü")], "conversation_id string, node_id string, text string")
    canonical.write_segments(headers, nodes, folder + "/s", buckets=2)
    got_headers, got_nodes, bad = canonical.read_segments(
        spark, folder + "/s", "conversation_id string, title string", "conversation_id string, node_id string, text string"
    )
    assert got_headers.collect() == headers.collect() and bad.count() == 0
    assert sorted(got_nodes.collect()) == sorted(nodes.collect())


def test_streams_import_once_and_index_once(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    source, store = folder + "/in", folder + "/store"
    os.mkdir(source)
    write(source, "a.json", [branched(), {"id": "broken"}])

    def run():
        ingest.import_stream(spark, source, store, folder + "/cp1", "u1", "g1").awaitTermination()
        ingest.index_stream(spark, store, folder + "/cp2", "g1").awaitTermination()
        tables = {t: spark.read.parquet(f"{store}/{t}") for t in ("revisions", "nodes", "chunks", "index_state", "import_items")}
        return {t: df.count() for t, df in tables.items()}

    first = run()
    assert first == {"revisions": 1, "nodes": 5, "chunks": 2, "index_state": 3, "import_items": 2}
    assert run() == first  # nothing new
    longer = branched()
    longer["mapping"]["b-active"]["children"] = ["c-new"]
    longer["mapping"]["c-new"] = node("c-new", "b-active", [], "Done.")
    longer["current_node"], longer["update_time"] = "c-new", 1_700_000_200
    write(source, "b.json", [longer])
    write(source, "c.json", [branched()])  # the old export again
    after = run()
    assert after["revisions"] == 2 and after["nodes"] == 11
    # the alternate branch and the active one of the new revision (both messages are tiny and share a chunk)
    ids = spark.read.parquet(f"{store}/chunks").groupBy("revision_id").count().collect()
    assert len(ids) == 2
    bodies = [r["body"] for r in spark.read.parquet(f"{store}/chunks").collect()]
    assert any("Done." in b for b in bodies)


def rows_of(spark, store):
    """Contents of all tables without the times of the run."""
    out = {}
    for name in sorted(n for n in os.listdir(store) if not n.endswith(".layout")):
        df = spark.read.parquet(f"{store}/{name}")
        df = df.drop(*[c for c in ("seq", "at", "file") if c in df.columns])
        if name == "index_state":
            df = df.filter("status = 'indexed'")
        out[name] = sorted(map(str, df.collect()))
    return out


@pytest.mark.parametrize("lost", range(4))
def test_import_is_completed_by_the_next_delivery(spark, monkeypatch, lost):
    folder = tempfile.mkdtemp(prefix="spark-")
    write(folder, "a.json", [branched(), {"title": "x"}, {"title": "y"}, branched(), {"id": "z", "mapping": None}])
    write(folder, "b.json", [branched(), {"title": "x"}])
    raw = exports.read_export(spark, folder)
    now = F.current_timestamp()
    ingest.ingest_batch(raw, folder + "/whole", "u", "g", now)
    want = rows_of(spark, folder + "/whole")
    assert len(want["import_items"]) == 7 and len(want["revisions"]) == 1 and len(want["nodes"]) == 5
    calls, real = [], canonical.append_new

    def failing(*args, **kwargs):
        if len(calls) == lost:
            calls.append(None)
            raise OSError("lost")
        calls.append(None)
        return real(*args, **kwargs)

    monkeypatch.setattr(canonical, "append_new", failing)
    store = folder + "/store"
    with pytest.raises(OSError):
        ingest.ingest_batch(raw, store, "u", "g", now)
    ingest.ingest_batch(raw, store, "u", "g", now)
    assert rows_of(spark, store) == want
    ingest.ingest_batch(raw, store, "u", "g", now)
    assert rows_of(spark, store) == want


def test_index_is_completed_by_the_next_delivery(spark, monkeypatch):
    def letters(texts):
        return np.array([[t.count(c) for c in "aeiou"] for t in texts], dtype=np.float32)

    folder = tempfile.mkdtemp(prefix="spark-")
    write(folder, "a.json", [branched(), {"id": "two", "mapping": {"x": node("x", None, [], "only one")}}])
    store, now = folder + "/store", F.current_timestamp()
    ingest.ingest_batch(exports.read_export(spark, folder), store, "u", "g", now)
    batch = spark.read.parquet(f"{store}/revisions")
    real = canonical.replace_revisions
    for lost in range(4):
        calls = []

        def failing(*args, **kwargs):
            calls.append(None)
            if len(calls) >= lost + 1:
                raise OSError("lost")
            return real(*args, **kwargs)

        monkeypatch.setattr(canonical, "replace_revisions", failing)
        with pytest.raises(OSError):
            ingest.index_batch(batch, store, "g", now, encode=letters)
        events = spark.read.parquet(f"{store}/index_state")
        assert {r["status"] for r in state.latest_state(events).collect()} == {"failed"}
    monkeypatch.setattr(canonical, "replace_revisions", real)
    ingest.index_batch(batch, store, "g", now, encode=letters)
    latest = state.latest_state(spark.read.parquet(f"{store}/index_state")).collect()
    assert {r["status"] for r in latest} == {"indexed"} and sorted(r["chunk_count"] for r in latest) == [1, 2]
    assert {r["attempts"] for r in latest} == {5}
    done = rows_of(spark, store)
    assert len(done["chunks"]) == len(done["vectors"]) == len(done["documents"]) == 3 and done["postings"]
    ingest.index_batch(batch, store, "g", now, encode=letters)
    assert rows_of(spark, store) == done
    # another generation supersedes the vectors of the first
    ingest.index_batch(batch, store, "g2", now, encode=letters)
    assert {r["generation_id"] for r in spark.read.parquet(f"{store}/vectors").collect()} == {"g2"}


def test_a_new_title_is_a_new_revision(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    for name, title in (("a", "first"), ("b", "second")):
        os.mkdir(f"{folder}/{name}")
        write(f"{folder}/{name}", "x.json", [{**branched(), "title": title}])
        ingest.ingest_batch(exports.read_export(spark, f"{folder}/{name}"), folder + "/store", "u", "g", F.current_timestamp())
    rows = spark.read.parquet(folder + "/store/revisions").collect()
    assert len({r["revision_id"] for r in rows}) == len({r["segment_id"] for r in rows}) == 2
    assert len({r["conversation_id"] for r in rows}) == 1


def test_lines_are_numbered_across_parts(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    write(folder, "a.jsonl", "\n".join(json.dumps({"id": f"i{i:04d}", "title": "t" * 50}) for i in range(400)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = exports.with_ordinal(exports.read_export(spark, folder, lines=True)).select("id", "ordinal").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(r["ordinal"] for r in rows) == list(range(400)) and all(int(r["id"][1:]) == r["ordinal"] for r in rows)


def test_replacing_by_nothing_empties_the_bucket(spark):
    path = tempfile.mkdtemp(prefix="spark-") + "/chunks"
    rows = spark.createDataFrame([("r1", "g", "a")], "revision_id string, generation_id string, body string")
    canonical.replace_revisions(rows, path, rows)
    canonical.replace_revisions(rows.limit(0), path, rows)
    assert canonical.read_table(spark, path) is None or spark.read.parquet(path).count() == 0


def test_replace_revisions_keeps_the_others(spark):
    path = tempfile.mkdtemp(prefix="spark-") + "/chunks"
    rows = spark.createDataFrame([("r1", "g", "a"), ("r2", "g", "b")], "revision_id string, generation_id string, body string")
    canonical.replace_revisions(rows, path, rows, buckets=1)
    new = spark.createDataFrame([("r1", "g", "c"), ("r1", "g", "d")], rows.schema)
    canonical.replace_revisions(new, path, new, buckets=1)
    assert sorted(r["body"] for r in spark.read.parquet(path).collect()) == ["b", "c", "d"]
    assert chunking.SMALL_BRANCH_UNITS > 0
