"""Near-duplicates by Order MinHash, verified by banded alignment.

A text is its sequence of words (as in decontamination: lower-cased, cut at ASCII punctuation and space). Texts
are compared by alignment: with m words matched in order out of a and b, their similarity is m / (a + b - m), and
texts of 0.8 or more are linked. Texts of 0.8 by five-word shingles are always among them: m shingles in order
cover m + 4 words.

Sketches only choose candidates. The k-mers of a text (two words; one for texts of fewer than ``SHORT`` words) are
labelled with their occurrence number; each hash function picks the labelled k-mers of least hash and keeps them in
text order, and texts with an equal pick share a bucket. Two words rather than five, since a changed word takes
two of the former and five of the latter with it. Texts are also sketched like the shortest text that can be
similar to them.

Texts with equal words are one node before anything else, so copies are never paired. In a bucket every node
meets the most central node only, the one that shares most buckets with others: the original of edited copies
is nearer to each of them than they are to each other. What buckets then still hold in several components is
compared exactly (``overlapping``): a pair can only be similar if enough of its word pairs are common, and then it
shares one of the rarest of these. So of two texts that share a bucket either both are in one class or they were
compared, or counting their word pairs ruled them out, whatever the size of the bucket.

A document without words (null, empty, punctuation) is a class of its own. Repeated rows are in one class.
Ties go to the least id; a class whose ids are all null has a null id. Very long texts are compared whole: an
alignment holds one bit a word in each row of it. Columns besides id and text are not read and pass through
``deduplicated``.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import encode
from .common import free, row_key, slices, source, table
from .components import components
from .hashing import Substrings, mix

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ANY_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SIMILARITY = 0.8
#: Words of a k-mer, sketches, and k-mers picked by each; the second line is for texts of fewer than SHORT words.
GRAM, SKETCHES, PICKED = 2, 36, 4
SHORT, SHORT_GRAM, SHORT_SKETCHES, SHORT_PICKED = 20, 1, 24, 3
#: Bits of the parity signature that is held against the number of differing words.
SIGNATURE = 1024
#: Counters that tell rare word pairs from frequent ones; pairs that share one count together.
COUNTERS = 1 << 20
#: Word pairs before a common one that are looked at for an earlier common one.
EARLIER = 16
#: Word pairs that a task sends at a time.
ROWS = 20_000
#: Bits of the match masks that one alignment may keep.
MASK_BITS = 1 << 29


def words(text: str) -> list[str]:
    return WORD.findall(text.translate(LOWER) if not text.isascii() else text.lower())


def labelled_grams(normal: bytes, size: int = GRAM) -> np.ndarray:
    """Hashes of the occurrence-labelled k-mers of words joined by spaces, in text order."""
    gaps = np.flatnonzero(np.frombuffer(normal, np.uint8) == 32)
    starts = np.concatenate([[0], gaps + 1])
    stops = np.concatenate([gaps, [len(normal)]])
    k = min(size, len(starts))
    hashes = Substrings(normal).hashes(starts[: len(starts) - k + 1], stops[k - 1 :])
    order = np.argsort(hashes, kind="stable")
    ordered = hashes[order]
    first = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    if first.all():
        return mix(hashes)
    at = np.arange(len(hashes))
    number = np.empty(len(hashes), np.uint64)
    number[order] = at - np.maximum.accumulate(np.where(first, at, 0))
    return mix(hashes + number * np.uint64(0xD1B54A32D192ED03))


def order_sketches(labelled: np.ndarray, sketches: int = SKETCHES, picked: int = PICKED) -> np.ndarray:
    """One key per sketch: the picked k-mers in text order."""
    seeds = mix(np.arange(1, sketches + 1, dtype=np.uint64) << np.uint64(32))
    keys = np.empty(sketches, np.uint64)
    step = max(1, (1 << 21) // len(labelled))  # bounds the memory for very long texts
    for low in range(0, sketches, step):
        seed = seeds[low : low + step, None]
        ranks = mix(labelled[None, :] ^ seed)
        if len(labelled) > picked:
            at = np.sort(np.argpartition(ranks, picked - 1, axis=1)[:, :picked], axis=1)
            chosen = np.take_along_axis(ranks, at, axis=1)
        else:
            chosen = ranks
        key = seed[:, 0]
        for column in chosen.T:
            key = mix(key * np.uint64(31) + column)
        keys[low : low + step] = key
    return keys


def sketch_keys(normal: bytes) -> np.ndarray:
    """Keys of a text: two texts that may be similar have those of the shorter one's kind in common."""
    n, kinds = normal.count(b" ") + 1, []
    # with fewer words in common than this, only equal texts are similar
    if n < math.ceil(SIMILARITY / (1 - SIMILARITY) - 1e-9):
        return np.empty(0, np.uint64)
    if math.ceil(SIMILARITY * n - 1e-9) < SHORT:
        kinds.append(order_sketches(labelled_grams(normal, SHORT_GRAM), SHORT_SKETCHES, SHORT_PICKED))
    if n >= SHORT:
        kinds.append(order_sketches(labelled_grams(normal), SKETCHES, PICKED))
    return np.concatenate(kinds)


def aligned(a: list, b: list, band: int) -> int:
    """Length of the longest common subsequence within ``band`` of the diagonal, by bit-parallel rows."""
    low = 0
    while low < len(a) and low < len(b) and a[low] == b[low]:
        low += 1
    high = 0
    while high < len(a) - low and high < len(b) - low and a[-1 - high] == b[-1 - high]:
        high += 1
    same = low + high
    a, b = a[low : len(a) - high], b[low : len(b) - high]
    if not a or not b:
        return same
    places: dict = {}
    for i, x in enumerate(a):
        places.setdefault(x, []).append(i)
    # words of many places keep a mask of them; there are few such words
    many = max(16, len(a) * len(a) // MASK_BITS)
    masks = {}
    for x, found in places.items():
        if len(found) > many:
            bits = np.zeros(len(a), np.uint8)
            bits[found] = 1
            masks[x] = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
    rows, block = (1 << len(a)) - 1, 64
    for top in range(0, len(b), block):
        left, right = max(0, top - band), min(len(a), top + block + band)
        if left >= right:
            break
        full = (1 << (right - left)) - 1
        row = (rows >> left) & full
        for x in b[top : top + block]:
            if x in masks:
                match = (masks[x] >> left) & full
            else:
                match = 0
                for i in places.get(x, ()):
                    if left <= i < right:
                        match |= 1 << (i - left)
            if match:
                up = row & match
                row = ((row + up) | (row - up)) & full
        rows = rows & ~(full << left) | row << left
    return same + len(a) - rows.bit_count()


def similarity(text_a: str, text_b: str, least: float = SIMILARITY) -> float:
    """Similarity of two texts, or 0 if it is below ``least``."""
    a, b = words(text_a), words(text_b)
    if not a or not b or min(len(a), len(b)) < least * max(len(a), len(b)):
        return 0.0
    need = math.ceil(least / (1 + least) * (len(a) + len(b)) - 1e-9)
    # no alignment matches more than the words in common
    if (Counter(a) & Counter(b)).total() < need:
        return 0.0
    m = aligned(a, b, len(a) + len(b) - 2 * need)
    return m / (len(a) + len(b) - m) if m >= need else 0.0


def sketched(docs: DataFrame) -> DataFrame:
    """``doc_id, k1, k2, same, size, keys``: identity and number of the words and sketch keys of each row with words."""

    def run(batches):
        encode.release()
        for batch in slices(batches):
            rows, same, sizes, keys = [], [], [], []
            for i, text in enumerate(batch.column(3).to_pylist()):
                normal = " ".join(words(text or "")).encode("utf-8", "surrogatepass")
                if normal:
                    rows.append(i)
                    same.append(hashlib.blake2b(normal, digest_size=16).digest())
                    sizes.append(normal.count(b" ") + 1)
                    keys.append(sketch_keys(normal).view(np.int64))
            kept = batch.select([0, 1, 2]).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [
                    *kept.columns,
                    pa.array(same, pa.binary()),
                    pa.array(sizes, pa.int64()),
                    pa.array(keys, pa.list_(pa.int64())),
                ],
                names=["doc_id", "k1", "k2", "same", "size", "keys"],
            )

    keyed = docs.select("doc_id", *row_key({"doc_id": F.col("doc_id"), "text": F.col("text")}), "text")
    return keyed.mapInArrow(run, "doc_id long, k1 long, k2 long, same binary, size long, keys array<long>")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs ``a, b`` of nodes whose ``texts(v, text)`` are similar."""

    def run(batches):
        encode.release()
        for batch in slices(batches):
            a, b, text_a, text_b = (c.to_pylist() for c in batch.columns)
            kept = [i for i in range(len(a)) if similarity(text_a[i], text_b[i])]
            yield batch.select([0, 1]).take(pa.array(kept, pa.int64()))

    return table(
        pairs.join(texts.select(F.col("v").alias("a"), F.col("text").alias("text_a")), "a")
        .join(texts.select(F.col("v").alias("b"), F.col("text").alias("text_b")), "b")
        .select("a", "b", "text_a", "text_b")
        .mapInArrow(run, "a long, b long")
    )


def ordered(x, y) -> list:
    return [F.greatest(x, y).alias("a"), F.least(x, y).alias("b")]


def classes(docs: DataFrame) -> DataFrame:
    """``doc_id, k1, k2, class_id, n_class, representative`` of every row; the class id is its least doc id."""
    key = row_key({"doc_id": F.col("doc_id"), "text": F.col("text")})
    rows = table(sketched(docs))
    # one row per text: a row of it stands for all
    least = table(rows.groupBy("same").agg(F.min("k1").alias("k1")))
    first = rows.join(least, ["same", "k1"]).dropDuplicates(["same"])
    nodes = table(first.select("same", "k1", "k2", "size", "keys")).withColumn("v", F.monotonically_increasing_id())
    nodes = table(nodes)
    members = nodes.select("v", "size", F.explode("keys").alias("key"))
    shared = table(members.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"))
    members = table(members.join(shared, "key"))
    central = members.groupBy("v").agg(F.sum("n").alias("met"))
    # the order of nodes by how many others they meet; of equal ones the first comes first
    rank = F.struct("met", (-F.col("v")).alias("first"), "size")
    members = table(members.join(table(central), "v").select("key", "v", "size", rank.alias("rank")))
    wanted = nodes.select("v", "k1", "k2").join(members.select("v").distinct(), "v")
    # one plan at every size: the nodes of shared buckets grow with the documents, so they are never broadcast
    texts = docs.select(*key, "text").join(table(wanted).hint("merge"), ["k1", "k2"])
    # rows that share both keys are equal, one of them is enough
    texts = table(texts.select("v", "text").dropDuplicates(["v"]))
    hubs = table(members.groupBy("key").agg(F.max("rank").alias("hub")))
    pairs = members.join(hubs, "key").select("v", "size", (-F.col("hub.first")).alias("h"), F.col("hub.size").alias("h_size"))
    # texts of more different lengths cannot be similar
    near = F.least("size", "h_size") >= SIMILARITY * F.greatest("size", "h_size") - 1e-9
    tested = table(pairs.filter("v <> h").filter(near).select(*ordered("v", "h")).distinct())
    links = verified(tested, texts)
    found = components(links)
    placed = members.join(found, "v", "left").select("key", "v", F.coalesce("c", "v").alias("c"))
    rest = overlapping(crowded(table(placed)), texts).join(tested, ["a", "b"], "left_anti")
    new = verified(table(rest), texts)
    if not new.isEmpty():
        found = components(links.unionByName(new))
    placed = table(
        rows.select("doc_id", "k1", "k2", "same")
        .join(nodes.select("same", "v"), "same")
        .join(found, "v", "left")
        .select("doc_id", "k1", "k2", F.coalesce("c", "v").alias("c"))
    )
    heads = placed.groupBy("c").agg(
        F.min("doc_id").alias("class_id"),
        F.count("*").alias("n_class"),
        F.min(F.struct("doc_id", "k1", "k2")).alias("head"),
    )
    judged = placed.join(table(heads), "c").select(
        "doc_id",
        "k1",
        "k2",
        "class_id",
        "n_class",
        F.struct("doc_id", "k1", "k2").eqNullSafe(F.col("head")).alias("representative"),
    )
    wordless = docs.filter(~F.coalesce("text", F.lit("")).rlike(ANY_WORD)).select(
        "doc_id",
        *key,
        F.col("doc_id").alias("class_id"),
        F.lit(1).cast("long").alias("n_class"),
        F.lit(True).alias("representative"),
    )
    return judged.unionByName(wordless)


def crowded(placed: DataFrame) -> DataFrame:
    """``v, c`` of the nodes in buckets ``key, v, c`` of several components."""
    several = placed.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).filter("low <> high")
    return table(placed.join(several.select("key"), "key").select("v", "c").distinct())


def signature(grams: np.ndarray) -> np.ndarray:
    """For each bit, whether an odd number of ``grams`` falls on it, as longs."""
    odd = np.bincount(grams.view(np.uint64) % np.uint64(SIGNATURE), minlength=SIGNATURE).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view(np.int64)


def matched(a, b):
    """Words that an alignment of similar texts of ``a`` and ``b`` words matches at least."""
    return F.ceil(SIMILARITY / (1 + SIMILARITY) * (a + b) - 1e-9)


def needed(a, b):
    """Labelled word pairs that similar texts of ``a`` and ``b`` words have in common at least."""
    return 3 * matched(a, b) - 1 - a - b


def counted(grams: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``COUNTERS`` counters, how many of ``grams(slot, c)`` fall on it, and whether they are of several components."""
    seen = grams.groupBy("slot").agg(F.count("*").alias("n"), F.min("c").alias("low"), F.max("c").alias("high"))
    n, several = np.zeros(COUNTERS, np.uint32), np.zeros(COUNTERS, bool)
    found = seen.select("slot", F.least("n", F.lit(2**32 - 1)).alias("n"), (F.col("low") != F.col("high")).alias("several")).toArrow()
    at = found["slot"].to_numpy()  # one row a counter, whatever the size of the input
    n[at], several[at] = found["n"].to_numpy(), found["several"].to_numpy()
    return n, several


def overlapping(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs ``a, b`` across the components of ``nodes(v, c)`` that may be similar; no similar pair is missing."""
    return met(rarest(nodes, texts)).distinct()


def rarest(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """``v, c, size, s, left, earlier, signed``: the word pairs of ``nodes(v, c)`` of which similar texts share one.

    An alignment of m words out of a and b keeps m - 1 neighbours, less one at most for each of the a + b - 2m
    other words, so similar texts have ``need`` labelled word pairs in common. The word pairs of every text are put
    into one order: from rare to frequent by the counter that they fall on, which all texts read alike; those on a
    counter of one component only are left out. Both texts then have as many as needed from the first common one on.
    A pair of texts meets where they have a word pair in common but none among the few before it: always at the first
    one, seldom again. Each text also has a signature, the parity of its labelled words by hash: two signatures differ
    in no more bits than the texts in words, which excludes most texts that are less similar.
    """

    def run(batches):
        for batch in slices(batches):
            normal = [" ".join(words(t)).encode("utf-8", "surrogatepass") for t in batch.column(2).to_pylist()]
            labelled = [labelled_grams(t).view(np.int64) for t in normal]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([t.count(b" ") + 1 for t in normal], pa.int64()),
                    pa.array(labelled, pa.list_(pa.int64())),
                    pa.array([signature(labelled_grams(t, 1)) for t in normal], pa.list_(pa.int64())),
                ],
                names=["v", "c", "size", "grams", "signed"],
            )

    held = table(
        nodes.join(texts, "v").select("v", "c", "text").mapInArrow(run, "v long, c long, size long, grams array<long>, signed array<long>")
    )
    slots = held.select("c", F.explode("grams").alias("s")).select("c", F.pmod("s", F.lit(COUNTERS)).cast("int").alias("slot"))
    counters = nodes.sparkSession.sparkContext.broadcast(counted(slots))

    def packed(columns):
        kinds = [pa.int64()] * 5 + [pa.list_(pa.int64())] * 2
        arrays = [pa.array(x, k) for x, k in zip(columns, kinds)]
        return pa.RecordBatch.from_arrays(arrays, names=["v", "c", "size", "s", "left", "earlier", "signed"])

    def begin(batches):
        n, several = counters.value
        columns = [[] for _ in range(7)]
        for batch in batches:
            for v, c, size, grams, signed in zip(*(x.to_pylist() for x in batch.columns)):
                grams = np.array(grams, np.int64)
                grams = grams[several[grams % COUNTERS]]
                grams = grams[np.lexsort((grams, n[grams % COUNTERS]))]
                fewest = math.ceil(SIMILARITY * size - 1e-9)
                least = 3 * math.ceil(SIMILARITY / (1 + SIMILARITY) * (size + fewest) - 1e-9) - 1 - size - fewest
                for at in range(len(grams) - max(least, 1) + 1):
                    row = (v, c, size, grams[at], len(grams) - at, grams[max(0, at - EARLIER) : at], signed)
                    for values, value in zip(columns, row):
                        values.append(value)
                    if len(columns[0]) == ROWS:
                        yield packed(columns)
                        columns = [[] for _ in range(7)]
        if columns[0]:
            yield packed(columns)

    # ``left``: common word pairs from this one on
    return table(
        held.select("v", "c", "size", "grams", "signed").mapInArrow(
            begin, "v long, c long, size long, s long, left long, earlier array<long>, signed array<long>"
        )
    )


def met(first: DataFrame) -> DataFrame:
    """The pairs ``a, b`` that meet by :func:`rarest`, seldom more than once."""
    need = needed(F.col("x.size"), F.col("y.size"))
    near = F.least("x.size", "y.size") >= SIMILARITY * F.greatest("x.size", "y.size") - 1e-9
    differ = sum(F.bit_count(F.col("x.signed")[i].bitwiseXOR(F.col("y.signed")[i])) for i in range(SIGNATURE // 64))
    most = F.col("x.size") + F.col("y.size") - 2 * matched(F.col("x.size"), F.col("y.size"))
    again = F.arrays_overlap("x.earlier", "y.earlier")
    pairs = first.alias("x").join(first.alias("y"), "s").filter("x.v > y.v AND x.c <> y.c")
    pairs = pairs.filter(near & (F.least("x.left", "y.left") >= need) & (differ <= most) & ~again)
    return pairs.select(*ordered("x.v", "y.v"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class, the one of least id."""
    (name,) = free(docs, "row_key")
    heads = table(classes(docs).filter("representative").select(F.struct("k1", "k2").alias(name)))
    keyed = docs.withColumn(name, F.struct(*row_key({"doc_id": F.col("doc_id"), "text": F.col("text")})))
    same = keyed.join(heads.distinct(), name, "left_semi")
    if heads.count() != heads.distinct().count():  # rows repeated as a whole
        same = same.dropDuplicates([name])
    return same.select(*docs.columns)


def op1_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Class of every document."""
    done = classes(source(spark, sf_dir, "documents"))
    return done.select("doc_id", "class_id", "n_class", "representative")
