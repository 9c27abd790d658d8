"""Quality rules by tokeniser fertility.

Base rules look at words, symbols and repetition. The method itself encodes each text with a public
byte-fallback vocabulary and measures

* ``chars_per_token``: code points of words per token (few: noise that the vocabulary must spell out),
* ``byte_share``: share of tokens that are single fallback bytes,
* ``entropy``: entropy of the token distribution, divided by its largest value for that many tokens.

A document is rejected when a measure leaves the band of its language (its script where no language is
given). Bands come from all documents of the language: quartiles of an exact histogram, widened by
``spread`` times the distance between them, and never narrower than ``floor`` on either side.

Nulls and texts without a word have no tokens and fail the base rules. Repeated rows are judged each.
Every language has its own band, however few its documents are. To its n documents come ``least / (n + 1)`` with
the distribution of its most frequent script (of all texts where that is none of ``SCRIPTS``), so that single
documents are judged by their script and more by themselves, and the reach grows by ``2 / sqrt(n)``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from . import encode
from .common import SLICE_ROWS, free, source, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
#: Ranges of code points that tell the common scripts apart.
SCRIPTS = {
    "latin": "A-Za-zÀ-ɏ",
    "greek": "Ͱ-Ͽ",
    "cyrillic": "Ѐ-ԯ",
    "hebrew": "֐-׿",
    "arabic": "؀-ۿ",
    "devanagari": "ऀ-ॿ",
    "kana": "぀-ヿ",
    "hangul": "가-힣",
    "han": "一-鿿",
}
#: Bin width, least half-width beyond the quartiles, and the sides that count (-1 low, 1 high).
MEASURES = {
    "chars_per_token": (0.01, 0.1, (-1, 1)),
    "byte_share": (0.001, 0.02, (1,)),
    "entropy": (0.005, 0.1, (-1, 1)),
}
FIELDS = [
    ("n_words", T.LongType()),
    ("word_chars", T.LongType()),
    ("n_symbols", T.LongType()),
    ("n_dup_lines", T.LongType()),
    ("n_repeat_words", T.LongType()),
    ("n_tokens", T.LongType()),
    ("chars_per_token", T.DoubleType()),
    ("byte_share", T.DoubleType()),
    ("entropy", T.DoubleType()),
    ("script", T.StringType()),
]
ARROW = {T.LongType: pa.int64(), T.DoubleType: pa.float64(), T.StringType: pa.string()}


def repeated_words(words: list[str]) -> int:
    """Words inside any window of three words that occurs twice or more."""
    n = len(words) - 2
    if n < 2:
        return 0
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == n:
        return 0
    ids: dict = {}
    codes = np.fromiter((ids.setdefault(w, len(ids)) for w in windows), np.int64, n)
    twice = np.bincount(codes)[codes] > 1
    covered = np.zeros(n + 2, bool)
    for shift in range(3):
        covered[shift : shift + n] |= twice
    return int(covered.sum())


def duplicate_lines(text: str) -> int:
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return len(lines) - len(set(lines))


def script_of(text: str) -> str:
    if text.isascii():
        return "latin"
    counts = {name: sum(map(len, re.findall(f"[{chars}]+", text))) for name, chars in SCRIPTS.items()}
    best = max(counts, key=counts.get)
    return best if counts[best] else "other"


def measure(text: str | None, model: encode.PieceModel) -> tuple:
    text = text or ""
    words = WORD.findall(text)
    chars = sum(map(len, words))
    symbols = sum(map(text.count, SYMBOLS))
    base = (len(words), chars, symbols, duplicate_lines(text), repeated_words(words))
    ids = model.ids(words)
    n = len(ids)
    if not n:
        return (*base, 0, None, None, None, script_of(text))
    counts = np.unique(ids, return_counts=True)[1]
    share = counts / n
    most = np.log2(min(n, len(model.is_byte)))
    entropy = float(-(share * np.log2(share)).sum() / most) if n > 1 else 1.0
    return (*base, n, chars / n, float(model.is_byte[ids].mean()), entropy, script_of(text))


def measured(docs: DataFrame, path: str, text: str = "text", into: str = "quality") -> DataFrame:
    """``docs`` with a struct column ``into`` that holds the fields of ``FIELDS``."""
    struct = T.StructType([T.StructField(n, t) for n, t in FIELDS])
    kinds = [ARROW[type(t)] for _, t in FIELDS]
    fields = [pa.field(n, kind) for (n, _), kind in zip(FIELDS, kinds)]

    @F.arrow_udf(struct)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = encode.PieceModel(path)
        for texts in batches:
            found = [[] for _ in FIELDS]
            for start in range(0, len(texts), SLICE_ROWS):
                for text in texts.slice(start, SLICE_ROWS).to_pylist():
                    for values, value in zip(found, measure(text, model)):
                        values.append(value)
            yield pa.StructArray.from_arrays([pa.array(v, kind) for v, kind in zip(found, kinds)], fields=fields)

    return docs.withColumn(into, run(F.col(text)))


def bands(measures: DataFrame, group: str, spread: float = 2.5, least: int = 200) -> DataFrame:
    """One row per group with ``low_*`` and ``high_*``."""
    binned = [
        F.struct(F.lit(name).alias("name"), F.floor(F.col(name) / width).cast("long").alias("bin"))
        for name, (width, _, _) in MEASURES.items()
    ]
    cells = table(
        measures.filter("n_tokens > 0")
        .select(group, "script", F.explode(F.array(*binned)).alias("m"))
        .groupBy(group, "script", "m.name", "m.bin")
        .agg(F.count("*").alias("n"))
    )
    own = cells.groupBy(group, "name", "bin").agg(F.sum("n").cast("double").alias("n"))
    # the most frequent script of each group, and how many documents the group has
    most = F.max(F.struct("n", "script"))["script"]
    first = next(iter(MEASURES))
    scripts = cells.filter(F.col("name") == first).groupBy(group, "script").agg(F.sum("n").alias("n"))
    scripts = table(scripts.groupBy(group).agg(most.alias("script"), F.sum("n").alias("n_group")))
    anywhere = cells.filter(~F.col("script").isin(*SCRIPTS)).select("script").distinct()
    every = cells.groupBy("name", "bin").agg(F.sum("n").alias("n"))
    known = cells.filter(F.col("script").isin(*SCRIPTS)).groupBy("script", "name", "bin").agg(F.sum("n").alias("n"))
    prior = known.unionByName(every.crossJoin(anywhere))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("script", "name"))
    prior = prior.select("script", "name", "bin", share.alias("share")).join(scripts, "script")
    added = prior.select(group, "name", "bin", (F.col("share") * least / (F.col("n_group") + 1)).alias("n"))
    mixed = own.unionByName(added).groupBy(group, "name", "bin").agg(F.sum("n").alias("n"))
    ranked = mixed.withColumn("upto", F.sum("n").over(Window.partitionBy(group, "name").orderBy("bin"))).withColumn(
        "all", F.sum("n").over(Window.partitionBy(group, "name"))
    )
    # sums of shares are not exact
    quartiles = ranked.groupBy(group, "name").agg(
        F.min(F.when(F.col("upto") * 4 >= F.col("all") * (1 - 1e-9), F.col("bin"))).alias("q1"),
        F.min(F.when(F.col("upto") * 4 >= F.col("all") * 3 * (1 - 1e-9), F.col("bin"))).alias("q3"),
    )
    wider = F.max(1 + 2 / F.sqrt("n_group"))
    outputs = []
    for name, (width, floor, sides) in MEASURES.items():
        low, high = (F.max(F.when(F.col("name") == name, F.col(q))) for q in ("q1", "q3"))
        reach = F.greatest((high - low + 1) * spread, F.lit(floor / width)) * width * wider
        outputs.append((low * width - reach if -1 in sides else F.lit(float("-inf"))).alias(f"low_{name}"))
        outputs.append(((high + 1) * width + reach if 1 in sides else F.lit(float("inf"))).alias(f"high_{name}"))
    return quartiles.join(scripts, group).groupBy(group).agg(F.max("n_group").alias("n_group"), *outputs)


def judged(docs: DataFrame, path: str, lang: str | None = "lang", into: str = "quality", **options) -> DataFrame:
    """``docs`` with the struct column ``into``: measures, ``base_failed`` and ``kept``.

    An input column of that name is replaced; all others stay as they are.
    """
    done = table(measured(docs, path, into=into))
    group_name, own_name = free(done, "band_group", "own_band")
    named = F.col(lang) if lang and lang in done.columns else F.lit(None).cast("string")
    group = F.coalesce(named, F.col(into)["script"])
    # one row per language: the number of languages bounds it, not the number of documents
    limits = table(bands(done.select(group.alias(group_name), f"{into}.*"), group_name, **options))
    own = limits.select(F.struct(*limits.columns).alias(own_name))
    joined = done.join(F.broadcast(own), group == F.col(own_name)[group_name], "left")
    inside = F.lit(True)
    for name in MEASURES:
        value = F.col(into)[name]
        low, high = (F.col(own_name)[f"{side}_{name}"] for side in ("low", "high"))
        inside &= (value >= low) & (value <= high)
    n_words, n_repeat = F.col(into)["n_words"], F.col(into)["n_repeat_words"]
    failed = (n_words < 50) | (n_repeat * 100 > n_words * 50)
    verdict = F.when(failed, False).otherwise(F.coalesce(inside, F.lit(False)))
    quality = F.col(into).withField("base_failed", failed).withField("kept", verdict)
    return joined.withColumn(into, quality).select(*done.columns)


def kept(docs: DataFrame, path: str, **options) -> DataFrame:
    """The rows of ``docs`` that pass."""
    (into,) = free(docs, "quality")
    return judged(docs, path, into=into, **options).filter(F.col(into)["kept"]).select(*docs.columns)


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Fertility measures and verdict of every document."""
    import public_tokenizers

    docs = source(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    done = judged(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return done.select("doc_id", "quality.*")
