import random
import zlib
from collections import Counter

from helpers import documents

from threadloom.llm import spelling

A_TO_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def brute_words(rows):
    counted = Counter()
    for doc_id, text, *_ in rows:
        run, runs = "", []
        for c in (text or "") + " ":
            if c.isascii() and c.isalpha() or "À" <= c <= "ÿ":
                run += c.lower() if c in A_TO_Z else c
            elif run:
                runs.append(run)
                run = ""
        for run in runs:
            h = zlib.crc32(f"{'null' if doc_id is None else doc_id}:{run}".encode())
            letters = list(run)
            if h % 31 == 0:
                del letters[h % len(letters)]
            counted["".join(letters)] += 1
    return {w: n for w, n in counted.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) < len(b):
        a, b = b, a
    return any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def brute_variants(words):
    out = {}
    for word, n in words.items():
        near = [v for v in words if one_edit(word, v)]
        form = min(near, key=lambda v: (-words[v], v), default=None)
        if form is not None and words[form] < 10 * n:
            form = None
        out[word] = [form, n, len(near)]
    found = set()
    for word, (form, n, near) in out.items():
        root = word
        while out[root][0] is not None:
            root = out[root][0]
        found.add((word, form, root, n, near, words[form] if form else None))
    return found


def corpus(rng):
    """Words of few letters, so that grams repeat and many words are near, some at the ends, some twice."""
    base = ["".join(rng.choice("abcß") for _ in range(rng.randint(7, 10))) for _ in range(30)]
    base += ["aaaaaaa", "aaaaaaaa", "abababa", "bababab", "Éaaaaaé", "x" * 400]
    pool = []
    for word in base:
        pool += [word] * rng.choice([2, 3, 40, 400])
        for _ in range(6):
            letters = list(word)
            at = rng.randrange(len(letters))
            kind = rng.randrange(3)
            letters[at : at + (kind != 1)] = [rng.choice("abcß")] * (kind != 0)
            pool += ["".join(letters)] * rng.choice([1, 2, 4, 30])
    rng.shuffle(pool)
    rows, sep = [], [" ", ", ", "-", "1", "_", "Ā", ". "]
    for i in range(0, len(pool), 90):
        part = pool[i : i + 90]
        rows.append((i, "".join((w.upper() if rng.random() < 0.1 else w) + rng.choice(sep) for w in part), "en", "s", 1))
    return rows + [rows[0], (None, rows[1][1], None, None, None), (5, None, None, None, None), (6, "", None, None, None), (7, "!?", None, None, None)]


def test_variants_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(spelling, "HELD", 50)
    rows = corpus(random.Random(4))
    want = brute_words(rows)
    got = spelling.variants(spelling.words(documents(spark, rows)))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    found = list(map(tuple, got.collect()))
    assert len(found) == len(want) and set(found) == brute_variants(want)
    assert any(root not in (word, form) for word, form, root, *_ in found)
    assert sum(row[4] for row in found) > 200


def test_pivots_are_disjoint_and_rarest():
    rng = random.Random(6)
    for _ in range(300):
        grams = [(rng.randint(1, 6), at) for at in sorted(rng.sample(range(1, 12), rng.randint(3, 6)))]
        a, b = spelling.pivots(grams)
        cost = dict((at, n) for n, at in grams)
        best = min(n + m for n, p in grams for m, q in grams if q - p >= 2)
        assert b - a >= 2 and cost[a] + cost[b] == best


def test_no_words(spark):
    assert spelling.variants(spelling.words(documents(spark, []))).count() == 0
    assert spelling.variants(spelling.words(documents(spark, [(1, "short one", None, None, None)]))).count() == 0
    one = spelling.variants(spelling.words(documents(spark, [(1, "longword longword", None, None, None)]))).collect()
    assert [tuple(r) for r in one] == [tuple(brute_variants(brute_words([(1, "longword longword")])).pop())]
