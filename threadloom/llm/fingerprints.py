"""Document fingerprints: SimHash, and permuted block tables for the search within a Hamming radius.

The terms of a text are its lower-cased words and its pairs of adjacent words; a text without words but with
characters is one term. Every term has a hash of ``BITS`` bits and votes on each with its weight, which is the
bit length of the number of its occurrences; a bit of the fingerprint is set if more than half of all weight
votes for it. Votes are whole numbers, so equal texts have equal fingerprints everywhere. The likeness of two
fingerprints is the share of equal bits: about one half for unrelated texts, 1 for equal ones.

For a search within ``radius`` bits a fingerprint is cut into ``blocks`` (more than ``radius``): two within the
radius agree in at least ``blocks - radius`` of them. There is one table for each choice of that many blocks,
keyed by their bits, and candidates meet in a table, are compared in chunks of bounded size and counted in the
first table that they share. Equal fingerprints are one entry with a count.

A null or empty text has no terms and the fingerprint zero. Texts of any length are read whole, in blocks of
terms. In ``with_next`` rows follow one another by descending id, null ids last, then by the hashes of text and
id; repeated rows follow each other in any order, which gives the same rows. Ties of votes give 0. An empty table
gives no rows, and a single row follows itself. Only id and text are read.
"""

from __future__ import annotations

import hashlib
import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .common import row_key, source, table
from .hashing import Substrings, mix

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BITS = 256
RADIUS, BLOCKS = 7, 8
TERMS, CHUNK = 4096, 1024


def terms(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct terms of a text and their numbers of occurrences."""
    normal = " ".join(WORD.findall(text.lower() if text.isascii() else text.translate(LOWER))).encode("utf-8", "surrogatepass")
    if not normal:
        rest = text.encode("utf-8", "surrogatepass")
        return Substrings(rest).hashes(np.array([0]), np.array([len(rest)])), np.ones(1, np.int64)
    gaps = np.flatnonzero(np.frombuffer(normal, np.uint8) == 32)
    starts = np.concatenate([[0], gaps + 1])
    stops = np.concatenate([gaps, [len(normal)]])
    known = Substrings(normal)
    found = np.concatenate([known.hashes(starts, stops), known.hashes(starts[:-1], stops[1:])])
    return np.unique(found, return_counts=True)


def fingerprint(text: str) -> bytes:
    """The fingerprint of one text, ``BITS // 8`` bytes."""
    if not text:
        return bytes(BITS // 8)
    hashes, counts = terms(text)
    weights = np.frexp(counts.astype(np.float64))[1].astype(np.float32)
    votes = np.zeros(BITS)
    lanes = mix(np.arange(1, BITS // 64 + 1, dtype=np.uint64) << np.uint64(40))
    for low in range(0, len(hashes), TERMS):
        part = mix(hashes[low : low + TERMS, None] ^ lanes)
        bits = np.unpackbits(part.view(np.uint8).reshape(len(part), -1), axis=1)
        # whole numbers below 2 ** 24, so sums of single precision are exact
        votes += weights[low : low + TERMS] @ bits.astype(np.float32)
    return np.packbits(2 * votes > weights.sum(dtype=np.float64)).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    return 1 - (int.from_bytes(a) ^ int.from_bytes(b)).bit_count() / (8 * len(a))


def edit(text: str, following: str) -> str:
    """``text`` with its last half replaced by the first code points of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


PAIR = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
PAIR_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def compared(doc_id, text: str, own: bytes, following: str, theirs: bytes) -> tuple:
    changed = edit(text, following)
    other = fingerprint(changed)
    digest = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
    return doc_id, len(text), digest, own.hex(), other.hex(), likeness(own, other), likeness(own, theirs)


def with_next(docs: DataFrame) -> DataFrame:
    """Each row with its fingerprint, that of its edited text, and its likeness to both and to the next row's.

    Rows are dealt and sorted by range, so a text moves once, and each task reads its range as a stream. Only the
    first and the last row of a task carry their texts on, to meet the neighbouring task.
    """
    names = [part.split()[0] for part in PAIR.split(", ")] + ["part", "place", "text"]

    def run(batches):
        part, before, first = TaskContext.get().partitionId(), None, None

        def batch_of(rows):
            columns = list(zip(*rows)) if rows else [[] for _ in names]
            kinds = [*PAIR_TYPES, pa.int64(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        for batch in batches:
            done = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = text or ""
                own = fingerprint(text) if before is None or before[1] != text else before[2]
                if before is None:
                    first = (None, None, None, own.hex(), None, None, None, part, "first", text)
                else:
                    done.append((*compared(*before, text, own), part, "row", None))
                before = doc_id, text, own
            yield batch_of(done)
        if before is not None:
            yield batch_of([first, (before[0], None, None, before[2].hex(), None, None, None, part, "last", before[1])])

    columns = {"doc_id": F.col("doc_id"), "text": F.col("text")}
    order = [F.col("doc_id").desc_nulls_last(), "k1", "k2", "n"]
    keyed = docs.select("doc_id", "text", *row_key(columns), F.monotonically_increasing_id().alias("n"))
    dealt = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    found = table(dealt.mapInArrow(run, PAIR + ", part long, place string, text string"))
    # one row for each task that had rows; texts are joined, not sorted
    ranks = found.filter("place = 'first'").select(
        "part", F.row_number().over(Window.orderBy("part")).alias("rank"), F.count("*").over(Window.partitionBy()).alias("parts")
    )
    ranks = table(ranks)
    firsts = found.filter("place = 'first'").join(ranks, "part").select(
        F.col("rank"), F.col("text").alias("following"), F.col("fingerprint").alias("theirs")
    )
    lasts = found.filter("place = 'last'").join(ranks, "part").withColumn("rank", F.col("rank") % F.col("parts") + 1)

    def close(batches):
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns))
            done = [compared(i, t, bytes.fromhex(own), f, bytes.fromhex(theirs)) for i, t, own, f, theirs in rows]
            columns = list(zip(*done)) if done else [[] for _ in PAIR_TYPES]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, PAIR_TYPES)], names=names[:7])

    borders = lasts.join(firsts, "rank").select("doc_id", "text", "fingerprint", "following", "theirs")
    return found.filter("place = 'row'").select(*names[:7]).unionByName(borders.mapInArrow(close, PAIR))


def choices(radius: int, blocks: int) -> list[tuple[int, ...]]:
    """The blocks that each table is keyed by."""
    if not 0 <= radius < blocks or BITS // 4 % blocks:
        raise ValueError("blocks must be more than the radius and divide the hexadecimal digits of a fingerprint")
    return list(itertools.combinations(range(blocks), blocks - radius))


def keyed(held: DataFrame, radius: int, blocks: int) -> DataFrame:
    """``held`` once for each table, with the number of the table ``t`` and the ``key`` there."""
    digits = BITS // 4 // blocks
    cut = [F.substring("fingerprint", 1 + digits * b, digits) for b in range(blocks)]
    entries = [F.struct(F.lit(t).alias("t"), F.concat(*(cut[b] for b in chosen)).alias("key")) for t, chosen in enumerate(choices(radius, blocks))]
    return held.select("*", F.explode(F.array(*entries)).alias("entry")).select(*held.columns, "entry.t", "entry.key")


def chunks(entries: DataFrame, name: str) -> DataFrame:
    """``t, key`` and lists of about ``CHUNK`` entries, which a large group is dealt into."""
    sizes = entries.groupBy("t", "key").agg(F.count("*").alias("size"))
    dealt = entries.join(sizes, ["t", "key"]).withColumn("chunk", F.pmod(F.xxhash64("fingerprint"), F.ceil(F.col("size") / CHUNK)))
    return dealt.groupBy("t", "key", "chunk").agg(F.collect_list(F.struct("fingerprint", "n")).alias(name)).drop("chunk")


def within(queries: DataFrame, fingerprints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, pairs: bool = False) -> DataFrame:
    """All rows of ``fingerprints`` within ``radius`` bits of each fingerprint of ``queries``.

    Returns ``fingerprint, n_within`` with the number of rows, or, as ``pairs``, ``fingerprint, other, distance, n``
    with each different fingerprint found and its rows.
    """
    held = table(fingerprints.groupBy("fingerprint").agg(F.count("*").alias("n")))
    asked = keyed(queries.groupBy("fingerprint").agg(F.count("*").alias("n")), radius, blocks)
    asked = table(asked)
    members = keyed(held, radius, blocks).join(asked.select("t", "key").distinct(), ["t", "key"], "left_semi")
    met = chunks(asked, "asked").join(chunks(members, "members"), ["t", "key"])
    chosen = np.array(choices(radius, blocks), np.int64)
    bytes_of, width = BITS // 8, blocks - radius

    def run(batches):
        def unpacked(entries):
            raw = bytes.fromhex("".join(e["fingerprint"] for e in entries))
            return np.frombuffer(raw, np.uint64).reshape(len(entries), -1), np.array([e["n"] for e in entries], np.int64)

        for batch in batches:
            rows = []
            for t, left, right in zip(*(c.to_pylist() for c in batch.columns)):
                (a, _), (b, n) = unpacked(left), unpacked(right)
                for low in range(0, len(a), 256):
                    apart = np.zeros((len(a[low : low + 256]), len(b)), np.int64)
                    for lane in range(a.shape[1]):
                        apart += np.bitwise_count(a[low : low + 256, None, lane] ^ b[None, :, lane])
                    i, j = np.nonzero(apart <= radius)
                    # a pair counts in the first table that it shares
                    unlike = (a[low + i] ^ b[j]).view(np.uint8).reshape(len(i), -1)
                    digits = np.stack([unlike >> 4, unlike & 15], axis=2).reshape(len(i), blocks, -1)
                    same = ~digits.any(axis=2)
                    first = same & (np.cumsum(same, axis=1) <= width)
                    wanted = np.zeros(blocks, bool)
                    wanted[chosen[t]] = True
                    here = (first == wanted).all(axis=1)
                    i, j = i[here], j[here]
                    if pairs:
                        rows += [(left[low + x]["fingerprint"], right[y]["fingerprint"], int(apart[x, y]), int(n[y])) for x, y in zip(i, j)]
                    else:
                        total = np.bincount(i, n[j], len(apart)).astype(np.int64)
                        rows += [(left[low + x]["fingerprint"], None, None, int(total[x])) for x in np.flatnonzero(total)]
            columns = list(zip(*rows)) if rows else [[]] * 4
            kinds = [pa.string(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["fingerprint", "other", "distance", "n"])

    found = met.select("t", "asked", "members").mapInArrow(run, "fingerprint string, other string, distance long, n long")
    return found if pairs else found.groupBy("fingerprint").agg(F.sum("n").alias("n_within"))


def op11_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text; ``n_near``, the number of other documents within the
    radius, is given for the ids divisible by 50 and null for the others.
    """
    done = table(with_next(source(spark, sf_dir, "documents")))
    asks = F.coalesce(F.col("doc_id") % 50 == 0, F.lit(False))
    near = within(done.filter(asks), done.select("fingerprint"))
    asked = done.filter(asks).join(near, "fingerprint").withColumn("n_near", F.col("n_within") - 1)
    return asked.select(*done.columns, "n_near").unionByName(done.filter(~asks).withColumn("n_near", F.lit(None).cast("long")))
