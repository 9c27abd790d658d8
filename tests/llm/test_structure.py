import random
import time
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from helpers import CLASHES, corpus, documents, prose
from pyspark.sql import functions as F

from threadloom.llm import chat_format, html_extract, sharding, toxicity


@pytest.mark.parametrize("limit", [3000, 10**9])
def test_shards_stay_within_their_limit(spark, limit):
    rows = corpus() + [(77, prose(random.Random(i), 60), "en", "s", 0) for i in range(30)]
    docs = documents(spark, rows)
    done = sharding.assigned(docs, limit)
    assert set(done.columns) == set(docs.columns)
    got = done.collect()
    assert len(got) == len(rows) and all(r[c] == f"own {c}" for r in got for c in CLASHES if c != "shard")
    sizes, ids = defaultdict(list), defaultdict(set)
    for r in got:
        sizes[r.shard.name].append(r.shard.bytes)
        ids[(r.shard.depth, r.shard.prefix)].add(r.doc_id)
    assert all(sum(v) <= limit or len(v) == 1 for v in sizes.values())
    buckets = Counter()
    for r in got:
        buckets[(r.shard.depth, r.shard.prefix)] += r.shard.bytes
    for depth, prefix in buckets:
        # the bucket exists because its parent was too large for one shard
        if depth:
            parent = sum(n for (d, p), n in buckets.items() if d >= depth - 1 and p >> (d - depth + 1) == prefix >> 1)
            assert parent > limit
    assert sharding.assigned(documents(spark, []), limit).count() == 0


def test_preferences(spark):
    def turns(conv, *said):
        return [(conv, i, role, text) for i, (role, text) in enumerate(said)]

    u, a = "user", "assistant"
    rows = turns(0, (u, "hi"), (a, "yes"), (u, "é"), (a, "one"), (a, "")) + turns(1, (u, "hi"), (a, "yes"), (u, "é"), (a, "two"))
    rows += turns(2, (u, "only")) + turns(4, (u, None), (None, "x")) + turns(5, (u, None), (None, "x"))
    rows += [(None, 0, u, "lost"), (7, None, a, "b"), (7, None, a, "a"), (7, 0, u, "c"), (7, 0, u, "c")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("pair_id", F.lit("x"))
    got = {r.pair_id: r for r in chat_format.preferences(chat_format.adjacent_pairs(frame), frame).collect()}
    assert set(got) == {0, 1, 2, 3}
    first = got[0]
    assert first.n_common == 3 and first.prompt == "<|user|>\nhi\n<|assistant|>\nyes\n<|user|>\né\n"
    assert first.chosen == "<|assistant|>\none\n<|assistant|>\n\n" and first.rejected == "<|assistant|>\ntwo\n"
    assert [first.chosen[s.start : s.end] for s in first.chosen_mask] == ["one"]
    assert [first.rejected[s.start : s.end] for s in first.rejected_mask] == ["two"]
    assert got[1].rejected == "" and got[1].prompt == "" and got[1].chosen == "<|user|>\nonly\n"
    assert got[2].n_common == 2 and got[2].chosen == got[2].rejected == "" and got[2].prompt == "<|user|>\n\n<||>\nx\n"
    assert got[3].chosen == "" and got[3].rejected == "<|assistant|>\na\n<|assistant|>\nb\n<|user|>\nc\n<|user|>\nc\n"
    assert chat_format.preferences(chat_format.adjacent_pairs(frame.limit(0)), frame).count() == 0


def page(rng, body):
    return f"<!doctype html><html><head><title>T</title><style>p{{}}</style></head><body>{body}</body></html>"


def templates(rng):
    def p(n):
        return prose(rng, n)

    def links(n):
        return "".join(f'<li><a href="/{i}">{p(1)}</a></li>' for i in range(n))

    good = [p(rng.randint(8, 60)) for _ in range(rng.randint(2, 6))]
    bad = [p(rng.randint(3, 20)) for _ in range(6)]
    inner = "".join(f"<p>{g}" for g in good)
    closed = "".join(f"<p>{g}</p>\n" for g in good)
    yield good, f"<nav><ul>{links(5)}</ul></nav><div class='ad'>{bad[0]}</div><article>{inner}</article><footer>{bad[1]}</footer>"
    yield good, f"<header class=site-header><a href=/>{bad[0]}</a></header><main>{closed}</main><aside class='sidebar'><p>{bad[1]}</p></aside><footer>&copy; {bad[2]}</footer>"
    yield good, f"<div id='navbar'><ul>{links(6)}</ul></div><div class='post-content'>{closed}</div><div class=\"comments\"><div class='comment'><p>{bad[3]} {bad[4]}</p></div></div><div id='footer'>{bad[2]}</div>"
    yield good, f"<nav>{links(4)}</nav><article><script>var x = '<p>no</p>';</script>{inner}<div class='cookie-notice'>{bad[0]}</div></article><form action='/s'><label>{bad[1]}</label><input name=q><button>{bad[2]}</button></form><footer>{bad[5]}</footer>"


def test_extraction_of_other_layouts(spark):
    rng = random.Random(13)
    made = [(good, page(rng, body)) for _ in range(30) for good, body in templates(rng)]
    rows = [(i, f"u{i}", h) for i, (_, h) in enumerate(made)]
    rows += [(900, "u", None), (901, "u", ""), (902, "u", "<p"), (903, "u", "<<<>>> &amp <article><p>x"), (None, None, "<div>" * 3000), rows[0]]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("own"))
    trees = html_extract.fit(pages, sample=60, layouts=400)
    got = {r.page_id: r.text for r in html_extract.extracted(pages, trees).collect()}
    right = sum(got[i] == " ".join(" ".join(good).split()) for i, (good, _) in enumerate(made))
    assert right >= 0.9 * len(made), right
    assert got[900] == got[901] == got[902] == "" and got[None] == ""
    empty = html_extract.fit(pages.limit(0), layouts=60)
    assert html_extract.extracted(pages.limit(0), empty).count() == 0


def test_markup_is_read_as_far_as_it_goes():
    def text(h):
        nodes = html_extract.parse(h)
        return html_extract.render(nodes, [True] * len(nodes))

    assert text("<p>a<b>b</b>c<br>d<p>e &lt;f&gt; &eacute;&#233;&#xe9;") == "abc d e <f> ééé"
    assert text("<ul><li>a<li>b</ul>c<table><tr><td>d<td>e</table>") == "a b c d e"
    assert text("<script>x<p>y</script>a<!-- b --><style>c</style><textarea>q</textarea>d") == "ad"
    assert text("a\n\t b&nbsp;c<h1> d </h1>") == "a b c d"
    assert text("<a href='x>y'>z</a> <div title=\"1 > 0\">w</div>") == "z w"


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 6)).astype(np.float32)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    trees = html_extract.Trees(rounds=30).fit(x[:2000], y[:2000])
    assert ((trees.margins(x[2000:]) > 0) == y[2000:]).mean() > 0.95


TOXIC = ["idiot", "scumbag", "moronic"]


def labelled(n=500):
    rng = random.Random(21)
    rows, labels = [], []
    for i in range(n):
        toxic = i % 6 == 0
        words = prose(rng, rng.randint(20, 80)).split()
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(TOXIC))
        rows.append((i, " ".join(words), "en", "s", 0))
        labels.append((i, int(toxic)))
    return rows, labels


def test_disguised_words_are_found(spark):
    rows, labels = labelled()
    rng = random.Random(5)
    held = [(10_000 + i, f"{prose(rng, 30)} {w} {prose(rng, 30)}") for i, w in enumerate(["1d10t", "i d i o t", "idiooot", "sc.um.bag", "m0r0n1c", "$cumbag", "IDIOT!"])]
    clean = [(20_000 + i, prose(rng, 60)) for i in range(40)] + [(30_000, None), (30_001, "")]
    docs = documents(spark, rows + [(i, t, None, None, None) for i, t in held + clean])
    model = toxicity.character_model(toxicity.trigram_counts(docs).toPandas())
    assert abs(np.exp(model[3, 5]).sum() - 1) < 1e-3
    weights, bias = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), model)
    done = toxicity.scored(docs, model, weights, bias)
    assert set(done.columns) == set(docs.columns)
    got = {r.doc_id: r.toxicity for r in done.collect()}
    assert all(0 <= s <= 1 for s in got.values())
    assert all(got[i] >= 0.5 for i, _ in held), {t[:200]: got[i] for i, t in held if got[i] < 0.5}
    assert all(got[i] < 0.5 for i, _ in clean)


def test_labels_of_one_kind(spark):
    docs = documents(spark, corpus()[:5])
    model = toxicity.character_model(toxicity.trigram_counts(docs).toPandas())
    none = spark.createDataFrame([], "doc_id long, toxic int")
    weights, bias = toxicity.fit(docs, none, model)
    assert weights == {} and all(r.toxicity < 0.01 for r in toxicity.scored(docs, model, weights, bias).collect())
    assert toxicity.scored(docs.limit(0), model, weights, bias).count() == 0


def test_every_disguise_reaches_the_lattice():
    rng = random.Random(1)
    plain = " ".join(rng.choice("you are such an idiot dumbass ass shit cat mat hello world".split()) for _ in range(4000))
    c = toxicity.codes(f"  {plain}  ")
    code, n = np.unique(c[:-2] << 12 | c[1:-1] << 6 | c[2:], return_counts=True)
    model = toxicity.character_model(pd.DataFrame({"code": code, "n": n}))
    restorer = toxicity.Restorer(model)
    forms = {"idiot": ["1d10t", "i d i o t.", "“i d i o t!”", "'i d i o t'", "idi" + 40 * "o" + "t"]}
    forms |= {"ass": ["a$$", "A$$!", "@$$", "a s s", "(a s s)"], "shit": ["s h i t.", "$hit"], "dumbass": ["dumba$$", '"dumba$$"']}
    for word, written in forms.items():
        for form in written:
            assert word in restorer.marked(f"hello {form} world")[1:-1].split(toxicity.END + toxicity.START), form
    assert restorer.restored("it is 2024 455", {"it", "is", "2024", "455"}) == set()


def test_sample_bounds_rows(spark):
    rows = [(1, f"text {i}", "en", "s", 0) for i in range(30)] + [(2, "one", "en", "s", 0)] * 20 + [(3, None, "en", "s", 0)]
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, toxic int")
    assert toxicity.labelled_sample(documents(spark, rows), labels, 10).count() == 10
    whole = toxicity.labelled_sample(documents(spark, rows), labels, 100).collect()
    assert Counter(r.toxic for r in whole) == {1: 30, 0: 2} and {r.text for r in whole} == {r[1] for r in rows}


def test_share_of_siblings_counts_all():
    nodes = html_extract.parse("<div>" + "<p>a</p>" * 30 + "<h2>b</h2>" * 10 + "</div>")
    shares = {n.tag: float(row[-3]) for n, row in zip(nodes, html_extract.measures(nodes)) if n.tag in ("p", "h2")}
    assert shares == {"p": 0.75, "h2": 0.25}


@pytest.mark.parametrize(
    "page",
    [
        "<a " * 330_000,
        "<div>" * 90_000 + "</b>" * 130_000,
        "<head>" * 170_000,
        "<title>" + "</title " * 120_000,
        "<li><ul>" + "<div>" * 80_000 + "<li></li>" * 60_000,
        "<b>" * 150_000 + "<div></div>" * 50_000,
        "<a '\"" * 200_000 + ">",
    ],
    ids=["open tags", "stray ends", "heads", "open ends", "items", "inline", "quotes"],
)
def test_broken_markup_takes_linear_time(page):
    start = time.process_time()
    html_extract.parse(page)
    assert time.process_time() - start < 5  # about half a second; minutes if a tag searched the page or its ancestors
