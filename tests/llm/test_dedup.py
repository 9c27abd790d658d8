import hashlib
import random
from collections import Counter, defaultdict

import pytest
from helpers import CLASHES, corpus, documents, edited, prose

from threadloom.llm import near_dedup, suffix_dedup
from threadloom.llm.components import components


def test_alignment_equals_plain_subsequence():
    rng = random.Random(5)

    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            corner = 0
            for j, y in enumerate(b, 1):
                row[j], corner = (corner + 1 if x == y else max(row[j], row[j - 1])), row[j]
        return row[-1]

    for _ in range(200):
        a = [rng.randint(0, 9) for _ in range(rng.randint(1, 180))]
        b = [x for x in a if rng.random() < 0.9] or [0]
        for _ in range(rng.randint(0, 20)):
            b.insert(rng.randrange(len(b) + 1), rng.randint(0, 9))
        want = plain(a, b)
        assert near_dedup.aligned(a, b, len(a) + len(b) - 2 * want) == want
        assert near_dedup.aligned(a, b, 2) <= want


def test_components_equal_union(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(12)]
    parent = {v: v for e in edges for v in e}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        low, high = sorted((root(a), root(b)))
        parent[high] = low
    want = {(v, root(v)) for e in edges if e[0] != e[1] for v in e}
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(got) == len(want) and set(map(tuple, got)) == want


def own_words(text):
    """Lower-cased runs of ASCII letters and digits and of anything beyond ASCII."""
    found, run = [], ""
    for c in (text or "") + " ":
        if c > "\x7f" or (c.isascii() and c.isalnum()):
            run += c.lower() if c.isascii() else c
        elif run:
            found.append(run)
            run = ""
    return tuple(found)


def near(a, b):
    """Whether two word sequences align to 0.8 or more, by the plain table of common subsequences."""
    if 10 * min(len(a), len(b)) < 8 * max(len(a), len(b)):
        return False
    row = [0] * (len(b) + 1)
    for x in a:
        corner = 0
        for j, y in enumerate(b, 1):
            row[j], corner = (corner + 1 if x == y else max(row[j], row[j - 1])), row[j]
    return 10 * row[-1] >= 8 * (len(a) + len(b) - row[-1])


def brute_classes(rows):
    groups = defaultdict(list)
    for i, row in enumerate(rows):
        groups[own_words(row[1]) or i].append(i)
    texts = [t for t in groups if isinstance(t, tuple)]
    parent = {t: t for t in groups}

    def root(t):
        while parent[t] != t:
            t = parent[t]
        return t

    for i, a in enumerate(texts):
        for b in texts[:i]:
            if root(a) != root(b) and (Counter(a) & Counter(b)).total() >= 0.44 * (len(a) + len(b)) and near(a, b):
                parent[root(a)] = root(b)
    classes = defaultdict(list)
    for t, members in groups.items():
        classes[root(t)] += members
    return Counter(tuple(sorted(str(rows[i][0]) for i in members)) for members in classes.values())


def test_near_dedup_equals_brute_force(spark):
    rows = corpus()
    rng = random.Random(9)
    base = prose(rng, 200)
    rows += [(1000 + i, edited(rng, base, rng.randint(0, 4)), "en", "s", 0) for i in range(12)]
    # texts that differ in every tenth word
    for i in range(10):
        text = prose(rng, rng.choice([30, 60, 120])).split(" ")
        rows.append((1100 + 2 * i, " ".join(text), "en", "s", 0))
        text[5::10] = [f"new{j}" for j in range(len(text[5::10]))]
        rows.append((1101 + 2 * i, " ".join(text), "en", "s", 0))
    got = near_dedup.classes(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    members = defaultdict(list)
    for i, r in enumerate(got):
        # two rows without an id are both of class null, though of different classes
        members[(r.class_id, r.n_class, i if r.n_class == 1 else None)].append(str(r.doc_id))
    assert Counter(tuple(sorted(m)) for m in members.values()) == brute_classes(rows)
    assert all(len(m) == k[1] for k, m in members.items())


def shares_key(a, b):
    keys = [set(near_dedup.sketch_keys(" ".join(t).encode()).tolist()) for t in (a, b)]
    return bool(keys[0] & keys[1])


@pytest.mark.parametrize("n_words", [4, 5, 8, 9, 12, 19, 20, 23, 24, 25, 28, 60])
def test_similar_texts_of_every_length_share_a_key(n_words):
    rng = random.Random(n_words)
    for _ in range(300):
        a = prose(rng, n_words).split(" ")
        # as many words more as a similar text can have
        b = a + prose(rng, n_words // 4).split(" ")
        assert near(a, b) and near_dedup.similarity(" ".join(a), " ".join(b))
        assert shares_key(a, b)


@pytest.mark.parametrize("n_words", [9, 18, 20, 40, 100, 400])
def test_scattered_edits_share_a_key(n_words):
    """The most words that may be replaced, or left out, at random places: at least 95 of 100 pairs meet."""
    rng = random.Random(n_words)
    met = Counter()
    for _ in range(200):
        a = prose(rng, n_words).split(" ")
        b, places = list(a), rng.sample(range(n_words), n_words // 9)
        for i in places:
            b[i] = f"new{i}"
        gone = set(rng.sample(range(n_words), n_words // 5))
        c = [x for i, x in enumerate(a) if i not in gone]
        met["replaced"] += shares_key(a, b)
        met["left out"] += shares_key(a, c)
    assert min(met["replaced"], met["left out"]) >= 190, met


def test_long_texts_of_frequent_words_align():
    rng = random.Random(31)
    a = [f"w{int(rng.random() ** 3 * 2000)}" for _ in range(60_000)]
    b = [x for x in a if rng.random() > 0.02]
    assert near_dedup.similarity(" ".join(a), " ".join(b)) > 0.97
    assert near_dedup.similarity(" ".join(a), " ".join(sorted(a))) == 0


def drifting(rng, n_words, steps):
    """Versions that change one word each, from the start on."""
    text = prose(rng, n_words).split(" ")
    for i in range(steps):
        yield " ".join(text)
        text[(i * 7) % n_words] = prose(rng, 1)


def forms(rng, count):
    """Forms of one frame, each with a first word of its own and twice with another end: 85 of 105 words in
    common with the other text of the form, 84 of 106 with all others."""
    frame = prose(rng, 84)
    for i in range(count):
        for end in "ab":
            yield f"own{i} {frame} {' '.join(f'{end}{i}x{j}' for j in range(10))}"


def test_large_buckets_lose_no_link(spark):
    rng = random.Random(12)
    texts = [t for n in (60, 100) for t in drifting(rng, n, 20)] + list(forms(rng, 15))
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    want = brute_classes(rows)
    assert sorted(map(len, want)) == [2] * 15 + [20, 20]
    members = defaultdict(list)
    for r in near_dedup.classes(documents(spark, rows)).collect():
        members[r.class_id].append(str(r.doc_id))
    assert Counter(tuple(sorted(m)) for m in members.values()) == want


def test_near_dedup_keeps_one_whole_row(spark):
    docs = documents(spark)
    kept = near_dedup.deduplicated(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert sum(brute_classes(corpus()).values()) == len(rows)
    assert all(r[c] == f"own {c}" for r in rows for c in CLASHES)
    assert near_dedup.classes(documents(spark, [])).collect() == []


def test_merged_transforms_equal_counts():
    rng = random.Random(3)
    parts = [bytes(rng.choice(b"abc") for _ in range(700)) for _ in range(3)]
    contexts = []
    for _ in range(16):
        low = rng.randint(0, 250)
        contexts.append(prose(rng, 12).encode() + rng.choice(parts)[low : low + rng.randint(380, 450)] + prose(rng, 9).encode())
    contexts += [b"ab" * 300, b"x" * 405]
    counts = Counter(c[i : i + 400] for c in contexts for i in range(len(c) - 399))
    want = [[i for i in range(len(c) - 399) if counts[c[i : i + 400]] > 1] for c in contexts]
    for shards in (1, 2, 4):
        got = suffix_dedup.repeated_starts(contexts, [i % shards for i in range(len(contexts))])
        assert [list(g) for g in got] == want
    assert sum(map(len, want)) > 200


def brute_removed(rows):
    texts = [(r[1] or "").encode() for r in rows]
    counts = Counter(t[i : i + 400] for t in texts for i in range(len(t) - 399))
    out = []
    for row, t in zip(rows, texts):
        gone = bytearray(len(t))
        for i in range(len(t) - 399):
            if counts[t[i : i + 400]] > 1:
                gone[i : i + 400] = b"\1" * 400
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((row[0], len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(map(repr, out))


@pytest.mark.parametrize("wide", [4096, 1])
def test_suffix_dedup_equals_brute_force(spark, wide):
    rows = corpus()
    rng = random.Random(4)
    base = prose(rng, 400)
    rows += [(2000 + i, edited(rng, base, 3) + "é" * (i % 3), "en", "s", 0) for i in range(8)]
    done = suffix_dedup.removed(documents(spark, rows), wide)
    got = done.select("doc_id", "repeats.n_bytes", "repeats.n_removed", "repeats.n_spans", "repeats.kept_sha256")
    assert sorted(repr(tuple(r)) for r in got.collect()) == brute_removed(rows)
    assert suffix_dedup.removed(documents(spark, [])).collect() == []


def test_suffix_dedup_shortens_texts(spark):
    docs = documents(spark)
    done = suffix_dedup.deduplicated(docs)
    assert done.columns == docs.columns and done.count() == docs.count()
    for r in done.collect():
        assert all(r[c] == f"own {c}" for c in CLASHES)
        if r.text is not None and r.doc_id is not None and r.doc_id != 0:
            assert r.n_chars == len(r.text)


def test_a_pair_of_texts_meets_seldom_more_than_once(spark):
    rng = random.Random(17)
    base, texts = [f"w{rng.randrange(4000)}" for _ in range(300)], []
    for i in range(24):
        texts.append(" ".join(w if rng.random() > 0.07 else f"u{i}x{k}" for k, w in enumerate(base)))
    nodes = spark.createDataFrame([(v, v) for v in range(len(texts))], "v long, c long")
    held = spark.createDataFrame(list(enumerate(texts)), "v long, text string")
    met = [tuple(r) for r in near_dedup.met(near_dedup.rarest(nodes, held)).collect()]
    similar = {(a, b) for a in range(24) for b in range(a) if near_dedup.similarity(texts[a], texts[b])}
    assert len(similar) > 50 and similar <= set(met)
    assert len(met) <= 2 * len(set(met))  # they have about two hundred word pairs in common
