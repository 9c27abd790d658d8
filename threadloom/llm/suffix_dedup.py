"""Removal of repeated byte strings by merging Burrows-Wheeler transforms.

A byte goes if it lies in a string of ``least`` (400) bytes that starts anywhere else too.

1. Every start of such a string has an anchor: the leftmost 200-byte window of least hash inside the 400
   bytes. Equal strings have equal anchors, so an anchor that occurs once rules its starts out. Starts that
   share an anchor occurrence form a run; a run's context is all the bytes its strings cover.
2. Anchors are counted over all documents. If all contexts of an anchor are equal, the runs repeat as wholes.
3. The distinct contexts of the other anchors meet by anchor, once each however often they occur. They are
   split into shards by document. The alphabet of the transform is windows of 50 bytes: each context is 50
   interleaved strings of symbols 50 bytes apart, so that every byte position is a suffix and 400 bytes are
   eight symbols. Each shard is transformed by itself; the transforms are merged by refining their
   interleaving symbol by symbol, which also gives the common prefixes of neighbours. Suffixes that are
   still together after eight symbols are the repeated intervals. Nothing is sorted again.
4. An anchor of more than ``wide`` distinct contexts (a large group of near copies) would make one task
   large. Its starts are counted by the hash of their 400 bytes instead, one row per start, with partial
   counts before the shuffle; the result is the same.

Matches never cross documents. Null is empty; texts below 400 bytes keep all bytes. Copies and repeated rows
repeat each other and so are removed as wholes. ``deduplicated`` drops the bytes of a character that was cut.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import encode
from .common import free, partitions, row_key, slices, source, table
from .hashing import Substrings, mix

LEAST, ANCHOR, SYMBOL, SHARDS = 400, 200, 50, 4
LEVELS = LEAST // SYMBOL
#: Positions merged at a time; below 65536 symbols a stable sort is a counting sort.
BATCH = 60_000
WIDE = 4096


def runs(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, context hash, first start and number of starts of each run of ``data``."""
    n = len(data) - LEAST + 1
    if n <= 0:
        none = np.empty(0, np.int64)
        return none.view(np.uint64), none.view(np.uint64), none, none
    substrings = Substrings(data)
    hashes = substrings.windows(ANCHOR)
    width = LEAST - ANCHOR + 1
    padded = np.full(-(-len(hashes) // width) * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[: len(hashes)] = hashes
    blocks = padded.reshape(-1, width)
    upto = np.minimum.accumulate(blocks, 1).ravel()
    onward = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    least = np.minimum(onward[:n], upto[width - 1 : width - 1 + n])
    # a run ends where the least value changes or the leftmost window that has it is left behind
    first = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (least[:-1] == hashes[: n - 1])]))
    count = np.diff(np.append(first, n))
    return least[first], substrings.hashes(first, first + count - 1 + LEAST), first, count


def transform(symbols: np.ndarray, before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in the order of their first eight symbols, and the symbol before each: a shard's transform."""
    rank, reach = symbols, after
    for _ in range(LEVELS.bit_length() - 1):
        following = np.where(reach >= 0, rank[reach], 0)
        pairs = rank.astype(np.int64) << 32 | following
        rank = np.unique(pairs, return_inverse=True)[1].astype(np.int64) + 1
        rank[symbols == 0] = 0
        reach = np.where(reach >= 0, reach[reach], -1)
    order = np.argsort(rank, kind="stable")
    previous = before[order]
    return order, np.where(previous >= 0, symbols[previous], 0).astype(symbols.dtype)


def interleave(transforms: list[np.ndarray], levels: int = LEVELS) -> tuple[np.ndarray, np.ndarray]:
    """Merge transforms: the shard of each suffix in merged order, and its common symbols with the one before.

    Symbol 0 ends a string and equals nothing. Common prefixes are counted up to ``levels`` symbols.
    """
    shard = np.repeat(np.arange(len(transforms)), [len(t) for t in transforms]).astype(np.uint8)
    n = len(shard)
    common = np.full(n, levels, np.uint8)
    block = np.zeros(n, np.int32)
    symbols = np.empty(n, transforms[0].dtype)
    for level in range(levels):
        for s, shard_symbols in enumerate(transforms):
            symbols[shard == s] = shard_symbols
        order = np.argsort(symbols, kind="stable")
        shard, ordered, block = shard[order], symbols[order], block[order]
        apart = np.ones(n, bool)
        apart[1:] = (ordered[1:] != ordered[:-1]) | (block[1:] != block[:-1]) | (ordered[1:] == 0)
        common[apart & (common == levels)] = level
        block = np.cumsum(apart, dtype=np.int32)
    return shard, common


def repeated_starts(contexts: list[bytes], shards: list[int]) -> list[np.ndarray]:
    """For each context, the starts whose 400 bytes start elsewhere in the contexts too."""
    sizes = np.array([len(c) + 1 for c in contexts])
    offsets = np.cumsum(sizes) - sizes
    n = int(sizes.sum())
    place = np.arange(n) - np.repeat(offsets, sizes)
    has_symbol = place <= np.repeat(sizes, sizes) - 1 - SYMBOL
    hashes = np.concatenate([Substrings(c).windows(SYMBOL) for c in contexts])
    values, codes = np.unique(hashes, return_inverse=True)
    symbols = np.zeros(n, np.uint16 if len(values) < 65535 else np.int64)
    symbols[has_symbol] = codes + 1
    owner = np.repeat(np.array(shards), sizes)
    parts, transforms = [], []
    for s in np.unique(owner):
        mine = np.flatnonzero(owner == s)
        local = np.full(n, -1)
        local[mine] = np.arange(len(mine))
        before = np.where(place[mine] >= SYMBOL, local[mine - SYMBOL], -1)
        after = np.where(has_symbol[mine], local[np.minimum(mine + SYMBOL, n - 1)], -1)
        order, previous = transform(symbols[mine], before, after)
        parts.append(mine[order])
        transforms.append(previous)
    shard, common = interleave(transforms)
    suffix = np.empty(n, np.int64)
    for s, part in enumerate(parts):
        suffix[shard == s] = part
    together = common == LEVELS
    together[:-1] |= together[1:]
    found = np.zeros(n, bool)
    found[suffix[together]] = True
    return [np.flatnonzero(found[o : o + k]) for o, k in zip(offsets, sizes)]


def spans(starts: np.ndarray) -> list[int]:
    """Runs of consecutive starts as first, last, first, last, ..."""
    if not len(starts):
        return []
    gaps = np.flatnonzero(np.diff(starts) > 1)
    return np.stack([starts[np.append(0, gaps + 1)], starts[np.append(gaps, len(starts) - 1)]], 1).ravel().tolist()


def _runs(batches):
    encode.release()
    for batch in slices(batches):
        out, rows = [[], [], [], []], []
        for i, data in enumerate(batch.column(2).cast(pa.binary()).to_pylist()):
            found = runs(data or b"")
            rows.append(np.full(len(found[0]), i))
            for values, value in zip(out, found):
                values.append(value)
        if not rows:
            continue
        keys = batch.select([0, 1]).take(pa.array(np.concatenate(rows)))
        h, c, first, count = (np.concatenate(v) for v in out)
        arrays = [*keys.columns, pa.array(h.view(np.int64)), pa.array(c.view(np.int64)), pa.array(first), pa.array(count)]
        yield pa.RecordBatch.from_arrays(arrays, names=["k1", "k2", "anchor", "context", "first", "n_starts"])


def _contexts(batches):
    names = ["anchor", "context", "n", "shard", "bytes", "wide"]
    for batch in slices(batches):
        out = [[] for _ in names]
        for data, k1, wanted in zip(
            batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
        ):
            for w in wanted:
                piece = data[w["first"] : w["first"] + w["n_starts"] - 1 + LEAST]
                row = (w["anchor"], w["context"], w["n"], k1 % SHARDS, piece, w["wide"])
                for values, value in zip(out, row):
                    values.append(value)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds)], names=names)


def _merged(batches):
    names = ["anchor", "context", "starts"]

    def solved(rows):
        found = repeated_starts([r[3] for r in rows], [r[2] for r in rows])
        arrays = [[r[0] for r in rows], [r[1] for r in rows], [spans(f) for f in found]]
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(a, k) for a, k in zip(arrays, kinds)], names=names)

    held, size = [], 0
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4))):
            if size >= BATCH and row[0] != held[-1][0]:
                yield solved(held)
                held, size = [], 0
            held.append(row)
            size += len(row[3]) + 1
    if held:
        yield solved(held)


def _windows(batches):
    names = ["w1", "w2", "anchor", "context", "start", "n"]
    for batch in batches:
        for anchor, context, n, data in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4))):
            substrings = Substrings(data)
            w1 = substrings.windows(LEAST)
            w2 = mix(substrings.windows(LEAST // 2)[: len(w1)] * np.uint64(3) + substrings.windows(LEAST // 2)[LEAST // 2 :])
            rows = len(w1)
            arrays = [w1.view(np.int64), w2.view(np.int64), np.full(rows, anchor), np.full(rows, context), np.arange(rows), np.full(rows, n)]
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=names)


def repeated(docs: DataFrame, wide: int = WIDE) -> DataFrame:
    """``k1, k2, spans``: for each row with repeats, the first and last starts of its repeated runs."""
    keyed = docs.select(*row_key({"doc_id": F.col("doc_id"), "text": F.col("text")}), "text")
    found = table(
        keyed.mapInArrow(_runs, "k1 long, k2 long, anchor long, context long, first long, n_starts long")
    )
    anchors = (
        found.groupBy("anchor")
        .agg(F.count("*").alias("n"), F.min("context").alias("low"), F.max("context").alias("high"))
        .filter("n > 1")
        .select("anchor", (F.col("low") != F.col("high")).alias("mixed"))
    )
    # a table, so that the join below has plain exchanges, which Spark splits where an anchor is frequent
    shared = table(found.join(table(anchors), "anchor"))
    whole = shared.filter("NOT mixed").select(
        "k1", "k2", F.struct(F.col("first").alias("low"), (F.col("first") + F.col("n_starts") - 1).alias("high")).alias("s")
    )
    mixed = table(
        shared.filter("mixed")
        .groupBy("anchor", "context")
        .agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "first", "n_starts")).alias("at"))
    )
    sizes = mixed.groupBy("anchor").agg(F.count("*").alias("n_contexts"))
    wanted = (
        mixed.join(sizes, "anchor")
        .select(
            "at.k1",
            "at.k2",
            F.struct("anchor", "context", "n", "at.first", "at.n_starts", (F.col("n_contexts") > wide).alias("wide")).alias("w"),
        )
        .groupBy("k1", "k2")
        .agg(F.collect_list("w").alias("wanted"))  # runs of one document
    )
    contexts = table(
        keyed.join(wanted, ["k1", "k2"])
        .dropDuplicates(["k1", "k2"])
        .select("text", "k1", "wanted")
        .mapInArrow(_contexts, "anchor long, context long, n long, shard long, bytes binary, wide boolean")
    )
    merged = (
        contexts.filter("NOT wide")
        .repartition(partitions(docs.sparkSession), "anchor")
        .sortWithinPartitions("anchor", "context")
        .mapInArrow(_merged, "anchor long, context long, starts array<long>")
    )
    windows = contexts.filter("wide").mapInArrow(
        _windows, "w1 long, w2 long, anchor long, context long, start long, n long"
    )
    twice = windows.groupBy("w1", "w2").agg(F.count("*").alias("rows")).filter("rows > 1")
    counted = (
        windows.join(twice, ["w1", "w2"], "left_semi")
        .groupBy("anchor", "context")
        .agg(F.flatten(F.collect_list(F.array("start", "start"))).alias("starts"))
    )
    starts = merged.unionByName(counted).select(F.col("anchor").alias("a"), F.col("context").alias("c"), "starts")
    # a context that occurs twice repeats as a whole
    own = mixed.join(starts, (F.col("a") == F.col("anchor")) & (F.col("c") == F.col("context")), "left").select(
        "anchor",
        "context",
        F.when(F.col("n") > 1, F.array(F.lit(0).cast("long"), F.col("at.n_starts") - 1)).otherwise(F.col("starts")).alias("starts"),
    )
    pairs = F.transform(
        F.sequence(F.lit(0), F.expr("size(starts) DIV 2 - 1").cast("int")),
        lambda i: F.struct(
            (F.col("first") + F.get("starts", i * 2)).alias("low"), (F.col("first") + F.get("starts", i * 2 + 1)).alias("high")
        ),
    )
    partly = (
        shared.filter("mixed")
        .join(own.filter(F.size("starts") > 0), ["anchor", "context"])
        .select("k1", "k2", F.explode(pairs).alias("s"))
    )
    return whole.unionByName(partly).groupBy("k1", "k2").agg(F.collect_set("s").alias("spans"))


CUT_FIELDS = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def cut(texts: pd.Series, lists: pd.Series) -> pd.DataFrame:
    rows = []
    for text, found in zip(texts, lists):
        data = (text or "").encode("utf-8", "surrogatepass")
        kept, end, n_spans = [], 0, 0
        for low, high in sorted((s["low"], s["high"]) for s in (found if found is not None else ())):
            if low > end or not n_spans:
                kept.append(data[end:low])
                n_spans += 1
            end = max(end, high + LEAST)
        rest = b"".join(kept) + data[end:]
        rows.append((len(data), len(data) - len(rest), n_spans, hashlib.sha256(rest).hexdigest(), rest))
    return pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def decoded(data: pd.Series) -> pd.Series:
    return data.map(lambda b: b.decode("utf-8", "ignore"), na_action="ignore")


def removed(docs: DataFrame, wide: int = WIDE, into: str = "repeats") -> DataFrame:
    """``docs`` with a struct column ``into``: ``n_bytes, n_removed, n_spans, kept_sha256, kept``.

    ``kept`` holds the remaining bytes. An input column of that name is replaced.
    """
    key_name, spans_name = free(docs, "row_key", "spans")
    found = table(repeated(docs, wide)).select(F.struct("k1", "k2").alias(key_name), F.col("spans").alias(spans_name))
    key = F.struct(*row_key({"doc_id": F.col("doc_id"), "text": F.col("text")}))
    joined = docs.withColumn(key_name, key).join(found, key_name, "left")
    columns = [c for c in docs.columns if c != into]
    return joined.select(*columns, F.pandas_udf(cut, CUT_FIELDS)("text", spans_name).alias(into))


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` without the repeated bytes; ``n_chars``, if present, is counted anew."""
    (into,) = free(docs, "repeats")
    done = removed(docs, into=into)
    changed = F.col(into)["n_removed"] > 0
    text = F.pandas_udf(decoded, "string")(F.col(into)["kept"])
    done = done.withColumn("text", F.when(changed, text).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        n_chars = F.length("text").cast(docs.schema["n_chars"].dataType)
        done = done.withColumn("n_chars", F.when(changed, n_chars).otherwise(F.col("n_chars")))
    return done.select(*docs.columns)


def op7_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Removed bytes of every document."""
    done = removed(source(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select(
        "doc_id", "repeats.n_bytes", "repeats.n_removed", "repeats.n_spans", "repeats.kept_sha256"
    )
