"""Small documents with everything that an operator must take: nulls, empties, copies, ties, odd columns."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators also use.
CLASHES = ["quality", "contamination", "repeats", "shard", "toxicity", "row_key", "k1", "k2", "spans", "found", "kept", "bytes", "hash"]


def prose(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(n))


def edited(rng: random.Random, text: str, edits: int) -> str:
    words = text.split(" ")
    for _ in range(edits):
        words[rng.randrange(len(words))] = prose(rng, 1)
    return " ".join(words)


def corpus(seed: int = 1) -> list[tuple]:
    rng = random.Random(seed)
    bases = [prose(rng, n) for n in (60, 120, 200, 300)]
    texts = [prose(rng, rng.randint(55, 160)) for _ in range(10)]
    for base in bases:
        texts += [base, base, base.upper(), edited(rng, base, 1), edited(rng, base, 2), edited(rng, base, len(base.split()) // 4)]
    passage = prose(rng, 90)
    texts += [f"{prose(rng, 60)} {passage} {prose(rng, 60)}" for _ in range(3)]
    texts += ["", "!!! ???", "one", "one two three", "ab" * 300, "Ünï " * 120, "x" * 401, "word " * 80, "ñ" * 250 + prose(rng, 5)]
    rows = [(i, t, rng.choice(["en", "de", None]), "s", len(t)) for i, t in enumerate(texts)]
    rows += [(900, None, None, None, None), (None, prose(rng, 70), "en", "s", 1), rows[0], rows[0], (None, None, "en", "s", 0)]
    return rows


def documents(spark, rows=None, clashes: bool = True):
    df = spark.createDataFrame(corpus() if rows is None else rows, SCHEMA).repartition(3)
    return df.withColumns({c: F.lit(f"own {c}") for c in CLASHES}) if clashes else df


def as_set(df, *columns):
    return sorted(map(repr, df.select(*columns).collect()))
