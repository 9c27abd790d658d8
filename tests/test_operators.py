"""Chunking, graphs, text, full text and vectors: cases and brute-force comparisons."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.functions import fixed, ids, text as tx
from threadloom.operators import catalog, chunking, graph, lexical, mutations, scan, semantic, state
from threadloom.plans import corpus

SF = "/root/testdata/sf0.001"


def event_text(label):
    return f"[{label}]\n\n" + "Boats came in late, and the harbour clerk wrote down who had been waiting. " * 6


def chunks_of(spark, messages, **options):
    """Chunks of one linear conversation."""
    nodes = spark.createDataFrame(
        [("r", f"n{i:03d}", f"n{i - 1:03d}" if i else None, "user" if i % 2 == 0 else "assistant", t, i == len(messages) - 1) for i, t in enumerate(messages)],
        "revision_id string, node_id string, parent_id string, role string, text string, is_leaf boolean",
    )
    heads = spark.createDataFrame([("r", "c", "T", "ns", f"n{len(messages) - 1:03d}")], "revision_id string, conversation_id string, title string, namespace string, current_node string").withColumn("updated_at", F.lit(None).cast("timestamp"))
    paths = graph.branches(nodes, heads)
    return sorted(chunking.chunk(nodes, paths, heads.drop("current_node"), "g", **options).collect(), key=lambda c: c["ordinal"])


def test_one_message_is_one_chunk(spark):
    texts = [event_text(f"EVENT {i + 1}") for i in range(12)]
    found = chunks_of(spark, texts)
    assert [c["ordinal"] for c in found] == list(range(12))
    for i, c in enumerate(found):
        assert len(c["sources"]) == 1 and c["sources"][0]["char_end"] == len(texts[i]) and texts[i] in c["body"]
    assert [c["chunk_id"] for c in found] == [c["chunk_id"] for c in chunks_of(spark, texts)]


def test_tiny_messages_share_chunks(spark):
    texts = [event_text("BIG RECORD")] + ["ok" if i % 2 == 0 else "noted" for i in range(20)]
    found = chunks_of(spark, texts)
    assert [len(c["sources"]) for c in found] == [1, 6, 6, 6, 2]
    large = chunks_of(spark, texts, bound=0)  # pointer doubling instead of arrays
    assert [c["chunk_id"] for c in large] == [c["chunk_id"] for c in found]


def test_split_texts():
    prose = "Tide tables are printed every spring. " * 600 + "\n\n~~~\n" + "tide = heights[month];\n" * 500 + "~~~"
    sections = "\n\n".join(f"## EVENT {i + 1}\n" + "Ropes were coiled, lamps were lit and the gate was shut. " * 6 for i in range(24))
    odd = "\n\n" + "x" * 20000 + "é😀" * 3000
    for text in (prose, sections, odd):
        for tail in (False, True):
            ranges = chunking.split_text(text, 1797, tail)
            assert ranges[0][0] == 0 and ranges[-1][1] == len(text)
            assert all(a[1] == b[0] for a, b in zip(ranges, ranges[1:]))
            assert all(len(text[a:b].encode()) <= 3 * 1797 for a, b in ranges)
    starts = [a for a, _ in chunking.split_text(sections, 1797)]
    assert len(starts) > 1 and all(sections[a:].startswith("##") for a in starts)
    assert len(chunking.split_text(prose, 1797, True)) >= len(chunking.split_text(prose, 1797))


def random_graph(rng, conversation, size):
    """Mostly a tree; some dangling parents and one possible cycle."""
    names = [f"n{i:03d}" for i in range(size)]
    parent = {n: (names[rng.randrange(max(0, i - 3), i)] if i else None) for i, n in enumerate(names)}
    if conversation % 3 == 1:
        parent[names[rng.randrange(size)]] = "ghost"
    if conversation % 3 == 2:
        parent[names[0]] = names[rng.randrange(size)]
    used = set(parent.values())
    return [(str(conversation), n, p, n not in used) for n, p in parent.items()]


def plain_walk(rows, current):
    """Branch rows and anomalies of one conversation, by sets of ancestors."""
    parent = {n: p for _, n, p, _ in rows}
    leaves = {n for _, n, _, leaf in rows if leaf}
    found = set()
    head = current
    if current not in parent:
        head = max(leaves) if leaves else max(parent)
        if current:
            found.add((None, f"current_node_missing:{current}"))

    def line(node, stop):
        out = []
        while node in parent and node not in out:
            out.append(node)
            if node in stop:
                return out[::-1], None
            node = parent[node]
        return out[::-1], node

    path, end = line(head, ())
    if end:
        found.add((None, f"cycle:{end}" if end in parent else f"dangling_parent:{end}"))
    found |= {("active", i, n, i) for i, n in enumerate(path)}
    for leaf in leaves - set(path):
        side, _ = line(leaf, set(path))
        found |= {(f"alternate:{leaf}", i, n, path.index(n) if n in path else None) for i, n in enumerate(side)}
    return found


def test_graph_walk_equals_brute_force(spark):
    rng = random.Random(5)
    rows, heads, want = [], [], {}
    for c in range(24):
        made = random_graph(rng, c, rng.randrange(1, 40))
        rows += made
        heads.append((str(c), rng.choice([None, "gone", made[-1][1], made[len(made) // 2][1]])))
        want[str(c)] = plain_walk(made, heads[-1][1])
    chain = [("long", f"n{i:05d}", f"n{i - 1:05d}" if i else None, i == 5999) for i in range(6000)]
    star = [("star", "root", None, False)] + [("star", f"l{i:04d}", "root", True) for i in range(300)]
    rows += chain + star
    heads += [("long", "n05999"), ("star", "l0000")]
    want |= {"long": plain_walk(chain, "n05999"), "star": plain_walk(star, "l0000")}
    nodes = spark.createDataFrame(rows, "revision_id string, node_id string, parent_id string, is_leaf boolean")
    heads = spark.createDataFrame(heads, "revision_id string, current_node string")
    got = {k: set() for k in want}
    for r in graph.branches(nodes.unionByName(nodes.filter("revision_id = '3'")), heads).collect():
        got[r["revision_id"]].add((r["branch_key"], r["pos"], r["node_id"], r["sequence"]))
    for r in graph.anomalies(nodes, heads).collect():
        got[r["revision_id"]].add((None, r["anomaly"]))
    assert got == want


def test_both_groupings_agree(spark):
    rng = random.Random(7)
    rows = [(str(b), p, part, rng.choice([3, 20, 40, 60, 64, 65, 300]), rng.random() < 0.05) for b in range(6) for p in range(90) for part in range(rng.choice([1, 1, 2]))]
    units = spark.createDataFrame(rows, "k string, pos bigint, part int, tokens int, is_split boolean")
    small = sorted(chunking.group_units(units, ["k"]).collect())
    assert small == sorted(chunking.group_units(units, ["k"], bound=0).collect())
    keyed = units.withColumn("size", F.col("tokens"))
    blocks = chunking._group_large(keyed.select("k", "pos", "part", "size"), ["k"], block=7)
    arrays = chunking._group_small(keyed.select("k", "pos", "part", "size"), ["k"])
    assert sorted(blocks.collect()) == sorted(arrays.collect())


def test_positions_across_blocks(spark):
    rng = random.Random(3)
    rows = [(k, t, f"{k}{t}") for k in "ab" for t in rng.sample(range(500), 60)]
    df = spark.createDataFrame(rows, "k string, t bigint, id string")
    got = scan.with_position(df, ["k"], "t", "pos", {"before": ("id", -1), "after": ("id", 1)}, block_rows=9)
    for k in "ab":
        order = [r[2] for r in sorted(r for r in rows if r[0] == k)]
        found = sorted((r["pos"], r["id"], r["before"], r["after"]) for r in got.filter(F.col("k") == k).collect())
        assert [f[1] for f in found] == order and [f[0] for f in found] == list(range(60))
        assert [f[2] for f in found] == [None, *order[:-1]] and [f[3] for f in found] == [*order[1:], None]


def terms_of(spark, query):
    rows = lexical.query_terms(spark.createDataFrame([("q", query)], "query_id string, query string"))
    found = rows.orderBy("term_no").collect()
    return [" ".join(r["tokens"]) + ("*" if r["prefix"] else "") for r in found]


@pytest.mark.parametrize(
    "query,want",
    [
        ("dragons", ["dragons", "dragon*", "dragons*"]),
        ("people", ["people", "person*", "people*"]),
        ("how is the gateway working", ["gateway working", "gateway", "working", "work*", "working*"]),
        ("the the the", []),
        ('api.internal.example "quoted"', ["api internal example quoted", "api internal example", "quoted", "quot*", "quoted*"]),
    ],
)
def test_query_terms(spark, query, want):
    assert terms_of(spark, query) == want


def test_matching_against_brute_force(spark):
    docs = {
        "d1": ("Coastal bird", "The coastal puffin returns each spring. Red dragon, red dragon!"),
        "d2": ("Red lights", "later a dragon was seen; api.internal.example is up"),
        "d3": ("Accents", "Éternel café, internal example of an API"),
    }
    chunks = spark.createDataFrame([(k, *v) for k, v in docs.items()], "chunk_id string, title string, body string")
    terms = spark.createDataFrame(
        [("q", 0, "t", ["red", "dragon"], False), ("q", 1, "t", ["puff"], True), ("q", 2, "t", ["api", "internal", "exa"], True),
         ("q", 3, "t", ["cafe"], False), ("q", 4, "t", ["ab"], True), ("q", 5, "t", ["re"], True), ("q", 6, "t", ["zzz", "dragon"], False)],
        "query_id string, term_no int, kind string, tokens array<string>, prefix boolean",
    )
    got = {(r["term"], r["chunk_id"]): r["freq"] for r in lexical.match(lexical.build_index(chunks), terms).collect()}
    assert got == {
        ("red dragon", "d1"): 2.0, ("puff*", "d1"): 1.0, ("api internal exa*", "d2"): 1.0, ("cafe", "d3"): 1.0,
        ("re*", "d1"): 3.0, ("re*", "d2"): 1.0,
    }


def test_vector_paths_agree(spark):
    rng = np.random.default_rng(1)
    vectors = spark.createDataFrame(
        [(f"v{i:03d}", f"u{i % 3}", f"n{i % 4}", [float(x) for x in rng.normal(size=8).round(1)]) for i in range(300)],
        "chunk_id string, owner string, namespace string, embedding array<float>",
    ).repartition(3)
    queries = spark.createDataFrame(
        [(f"q{i}", 0, [float(x) for x in rng.normal(size=8)], 7, None if i % 2 else ["n1", "n2"], None if i % 3 else "u0") for i in range(9)],
        "query_id string, variant_no int, vector array<float>, top int, namespaces array<string>, user_id string",
    )
    local = sorted(semantic.vector_top_k(vectors, queries).collect())
    blocked = sorted(semantic.vector_top_k(vectors, queries, broadcast_bytes=2000, block_bytes=4000).collect())
    assert local == blocked and len(local) == 9 * 7


def test_variants(spark):
    cases = {
        "image that Mira chose as wallpaper on the day they became official with their families": 2,
        "ferry timetable for spring": 1,
        "  ": 0,
        "wallpaper lock screen phone background": 1,
        "which photo does Mira have on the lock screen": 2,
    }
    rows = spark.createDataFrame([(q, q) for q in cases], "query_id string, query string")
    got = semantic.query_variants(rows).groupBy("query_id").agg(F.count("*").alias("n"), F.max_by("variant", "variant_no").alias("v")).collect()
    assert {r["query_id"]: r["n"] for r in got} == {q: n for q, n in cases.items() if n}
    long = next(r["v"] for r in got if r["query_id"].startswith("image"))
    for label in ("picture photo image", "wallpaper lock screen phone background", "couple started dating official relationship"):
        assert label in long


def test_tags_and_text(spark):
    row = spark.createDataFrame([([" Storm-Log ", "storm-log", "Ｓａｉｌ", "sail", "HARBOUR", "harbour", "  ", "", "tide-line"],)], "t array<string>")
    assert row.select(tx.normalize_tags(F.col("t"))).first()[0] == ["storm-log", "sail", "harbour", "tide-line"]
    one = spark.range(1).select(
        tx.normalize_text(F.lit("Ｆｕｌｌ—Width ﬁle_name./ (Straße)")).alias("n"),
        tx.fold(F.lit("Éternel é Ǻ ß 한")).alias("f"),
        tx.field_labels(F.lit("Owner: me; a-b c  : x 9: y: " + "z" * 40 + ":")).alias("l"),
        ids.estimate_tokens(F.lit("")).alias("e"),
    ).first()
    assert one["n"] == "full width file_name./ straße" and one["f"] == "eternel e a ß 한"
    assert one["l"] == ["Owner", "a-b c", "y", "z" * 31] and one["e"] == 1
    long = spark.range(1).select(tx.field_labels(F.lit("Owner" + " " * 900 + ": x")).alias("l")).first()
    assert long["l"] == ["Owner"]
    folded = spark.range(1).select(tx.concept_phrase_map().alias("m"))
    assert set(folded.first()["m"]) == {n for n, _, _ in fixed.CONCEPTS} and folded.first()["m"]["packet-loss"][1] == "loss packet"


def test_appends_and_tags(spark):
    now = spark.createDataFrame([("c1", "r1"), ("c2", "r2")], "conversation_id string, revision_id string")
    asked = spark.createDataFrame(
        [("a", "c1", "r1", 2), ("b", "c1", "r1", 1), ("c", "c2", "old", 1), ("d", "nope", "r", 1)],
        "request_id string, conversation_id string, base_revision_id string, seq bigint",
    )
    applied, rejected = mutations.split_appends(asked, now)
    assert [r["request_id"] for r in applied.collect()] == ["b"]
    assert {r["request_id"]: r["reason"] for r in rejected.collect()} == {"a": "conflict", "c": "conflict", "d": "not_found"}
    events = spark.createDataFrame(
        [("c", "x", "add", 1, 0), ("c", "y", "add", 2, 0), ("c", "x", "add", 3, 0), ("c", "y", "remove", 4, 0), ("c", "y", "add", 4, 1), ("c", "z", "add", 5, 0), ("c", "z", "remove", 6, 0)],
        "conversation_id string, tag string, op string, seq int, step int",
    )
    assert [(r["tag"], r["seq"], r["step"]) for r in mutations.live_tags(events).orderBy("seq").collect()] == [("x", 1, 0), ("y", 4, 1)]


def test_state_machine(spark):
    rows = [("queued", 1), ("processing", 2), ("failed", 3), ("queued", 4), ("processing", 5)]
    events = spark.createDataFrame([("r", "g", s, i) for s, i in rows], "revision_id string, generation_id string, status string, seq bigint")
    events = events.withColumn("at", F.timestamp_seconds("seq"))
    row = state.latest_state(events).first()
    assert (row["status"], row["attempts"], row["failed_at"], row["indexed_at"]) == ("processing", 2, None, None)
    requeued = state.latest_state(events.filter("seq <= 4")).first()
    assert requeued["status"] == "queued" and requeued["started_at"] is None and requeued["failed_at"] is None


def test_listing_pages_cover_everything(spark):
    rows = corpus.headers(spark, SF)
    tags = rows.select("conversation_id", F.posexplode(corpus.tags_of(F.col("num"))).alias("seq", "tag"))
    seen, cursor = [], None
    while True:
        page = catalog.list_conversations(rows, tags, 100, cursor=cursor).collect()
        seen += [r["conversation_id"] for r in page]
        cursor = page[0]["next_cursor"]
        if cursor is None:
            break
    assert seen == sorted(r["conversation_id"] for r in rows.select("conversation_id").collect())


def test_filters_reach_the_scan(spark):
    rows = corpus.table(spark, SF, "conversations").filter("turn = 0").select("conv_id")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(turn,0)" in plan and "text" not in plan.split("ReadSchema")[1]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_top_k_prunes_before_the_shuffle(spark):
    # three queries: a constant key would be folded away, and the rule with it
    rows = spark.range(1000).select(
        (F.col("id") % 3).cast("string").alias("query_id"), F.col("id").cast("string").alias("chunk_id"),
        F.rand(1).alias("score"), F.lit(7).alias("pool"),
    )
    ranked = lexical.top_k(rows, F.col("pool"), fixed.POOL_MAX, [F.col("score").desc(), F.col("chunk_id")])
    plan = plan_of(ranked)
    assert plan.count("WindowGroupLimit") == 2 and ranked.count() == 21


def test_no_nested_loops_in_matching(spark):
    chunks = spark.createDataFrame([("d", "a title", "some body")], "chunk_id string, title string, body string")
    queries = spark.createDataFrame([("q", "some titles")], "query_id string, query string")
    plan = plan_of(lexical.match(lexical.build_index(chunks), lexical.query_terms(queries)))
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_context_is_for_its_scope_and_joins_ranges(spark):
    source = "array<struct<source_node_id:string,source_sequence:bigint,char_start:int,char_end:int>>"
    chunks = spark.createDataFrame(
        [
            ("k1", "c1", "a", [("n", 0, 0, 5), ("n", 0, 3, 9), ("n", 0, 9, 11), ("n", 0, 20, 30), ("m", 1, 2, 4), ("n", 0, 21, 22)]),
            ("k2", "c2", "b", [("n", 0, 0, 5)]),
            ("k3", "c3", "a", [("n", 0, 0, 5)]),  # deleted
        ],
        f"chunk_id string, conversation_id string, namespace string, sources {source}",
    )
    live = spark.createDataFrame([("c1", "u1"), ("c2", "u2")], "conversation_id string, user_id string")

    def seen(namespaces, user):
        rows = [(k, namespaces, user) for k in ("k1", "k2", "k3", "k4")]
        asked = spark.createDataFrame(rows, "chunk_id string, namespaces array<string>, user_id string")
        return catalog.visible_chunks(asked, chunks, live)

    got = {tuple(r) for r in catalog.matched_ranges(seen(None, "u1"), chunks).collect()}
    assert got == {("k1", "n", 0, 11), ("k1", "n", 20, 30), ("k1", "m", 2, 4)}
    assert catalog.matched_ranges(seen(None, "stranger"), chunks).count() == 0
    assert [r.chunk_id for r in seen(["b"], None).collect()] == ["k2"]
    assert sorted(r.chunk_id for r in seen([], None).collect()) == ["k1", "k2"]
    assert seen(["b"], "u1").count() == 0


def test_postings_are_counted_without_a_shuffle(spark):
    chunks = spark.createDataFrame(
        [("a", "Red red", "red blue Blue b"), ("b", None, "one two one"), ("c", "", ""), ("d", "x", None)],
        "chunk_id string, title string, body string",
    )
    index = lexical.build_index(chunks, title_weight=3.0, body_weight=0.5)
    assert "Exchange" not in plan_of(index.postings)
    found = {(r.chunk_id, r.token): (r.freq, r["size"]) for r in index.postings.collect()}
    assert found.pop(("b", "one"))[0] == 1.0 and found.pop(("b", "two"))[0] == 0.5 and found.pop(("d", "x"))[0] == 3.0
    assert found == {("a", "red"): (6.5, 6), ("a", "blue"): (1.0, 6), ("a", "b"): (0.5, 6)}


def test_texts_of_documents_and_single_messages_move_once(spark):
    d = "/root/testdata/sf0.001"
    documents = corpus.nodes(spark, d)._jdf.queryExecution().optimizedPlan().children().apply(1).toString()
    assert "Join" not in documents and "Aggregate" not in documents
    heads = corpus.catalog(spark, d)
    made = corpus.chunks(spark, d, heads)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    # a chunk of one message: nothing but a projection lies above the join that brings its text
    assert made[0].startswith("Union") and [line for line in made if "Join" in line or "Aggregate" in line][0].count("Join") == 1
