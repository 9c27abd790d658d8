import hashlib
import random

import pytest
from helpers import corpus, documents, edited, prose

from threadloom.llm import fingerprints


def bits(text):
    return int(text, 16)


def apart(a, b):
    return (bits(a) ^ bits(b)).bit_count()


def corpus_rows():
    rng = random.Random(11)
    long = prose(rng, 9000)
    rows = corpus() + [(2000 + i, t, "en", "s", 0) for i, t in enumerate([long, edited(rng, long, 3), "x", "é", "?!", "  "])]
    return rows, rng


@pytest.mark.parametrize("partitions", [1, 7])
def test_edited_texts_and_neighbours_equal_brute_force(spark, partitions):
    rows, _ = corpus_rows()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = fingerprints.with_next(documents(spark, rows)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(got) == len(rows)
    # rows of distinct ids follow by descending id, null ids last and in an order of their own
    texts, prints = {}, {}
    for r in rows:
        texts.setdefault(r[0], r[1] or "")
    for r in got:
        if r.doc_id is not None:
            prints.setdefault(r.doc_id, r.fingerprint)
            assert prints[r.doc_id] == r.fingerprint
    order = sorted((i for i in texts if i is not None), reverse=True)
    following = dict(zip(order, order[1:]))
    for r in got:
        assert len(r.fingerprint) == 64 and r.near_edited == 1 - apart(r.fingerprint, r.edited_fingerprint) / 256
        if r.doc_id in following and r.doc_id != rows[0][0]:
            text, other = texts[r.doc_id], texts[following[r.doc_id]]
            half = len(text) // 2
            want = text[: len(text) - half] + other[:half]
            assert r.n_chars == len(text)
            assert r.edited_sha256 == hashlib.sha256(want.encode()).hexdigest()
            assert r.near_next == 1 - apart(r.fingerprint, prints[following[r.doc_id]]) / 256
            assert r.edited_fingerprint == fingerprints.fingerprint(want).hex()
    # two of the three whole copies are followed by a copy
    copies = [r for r in got if r.doc_id == rows[0][0]]
    assert len(copies) == 3 and sum(r.near_next == 1 for r in copies) >= 2
    # after the last row comes the first
    nulls = [r for r in got if r.doc_id is None]
    assert len(nulls) == 2 and min(r.n_chars for r in nulls) == 0


def test_equal_texts_and_small_edits():
    rng = random.Random(3)
    near, far = [], []
    for n in (40, 200, 2000):
        text = prose(rng, n)
        assert fingerprints.fingerprint(text) == fingerprints.fingerprint(str(text))
        near.append(fingerprints.likeness(fingerprints.fingerprint(text), fingerprints.fingerprint(edited(rng, text, 1))))
        far.append(fingerprints.likeness(fingerprints.fingerprint(text), fingerprints.fingerprint(prose(rng, n))))
    assert min(near) > 0.9 and max(far) < 0.65
    assert fingerprints.fingerprint("") == bytes(32) != fingerprints.fingerprint("?")
    assert fingerprints.fingerprint("?") != fingerprints.fingerprint("!")


@pytest.mark.parametrize("radius, blocks", [(7, 8), (2, 4), (1, 4), (0, 2)])
def test_search_finds_all_within_the_radius(spark, radius, blocks, monkeypatch):
    monkeypatch.setattr(fingerprints, "CHUNK", 5)
    rng = random.Random(radius)
    prints = []
    for _ in range(6):
        base = rng.getrandbits(256)
        for _ in range(12):
            changed = base
            for _ in range(rng.randint(0, radius + 2)):
                changed ^= 1 << rng.randrange(256)
            prints += [f"{changed:064x}"] * rng.randint(1, 2)
    held = spark.createDataFrame([(p,) for p in prints], "fingerprint string")
    asked = held.filter("fingerprint < '8'")
    got = {r.fingerprint: r.n_within for r in fingerprints.within(asked, held, radius, blocks).collect()}
    want = {p: sum(apart(p, q) <= radius for q in prints) for p in prints if p < "8"}
    assert got == want
    pairs = fingerprints.within(asked, held, radius, blocks, pairs=True).collect()
    assert len(pairs) == len({(r.fingerprint, r.other) for r in pairs})
    assert sum(r.n for r in pairs) == sum(want.values())
    assert all(r.distance == apart(r.fingerprint, r.other) for r in pairs)
    assert fingerprints.within(asked.limit(0), held, radius, blocks).count() == 0


def test_small_tables(spark):
    assert fingerprints.with_next(documents(spark, [])).count() == 0
    (row,) = fingerprints.with_next(documents(spark, [(4, "one two three", None, None, None)])).collect()
    assert row.near_next == 1.0 and row.edited_sha256 == hashlib.sha256(b"one two" + b"one tw").hexdigest()
