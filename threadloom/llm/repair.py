"""Conversation structure repair: the cheapest edits that give the roles ``(s?(ua)+)?``.

Faults of a row, the first of these: blank (no character but white space), duplicate (role and text stand earlier
in the conversation), truncated (the last character that is not white space is none of ``.!?``). Edits, by row:
Keep 0, Rerole to user or assistant 1, Delete 2; Insert an empty text of user or assistant 5, anywhere. A blank or
duplicate row must go; a truncated one that stays costs 5 more. Of equally cheap audits the least counts.

Every path is one whole number. Its high digits are the cost; below them each row has three octal digits for its
letters (D 1, I 2, K 3, R 4): up to two inserts before the row and the edit of the row, then zeros. Such groups are
never beginnings of each other, so the order of the numbers is the order of cost and audit, and a plain minimum
over the paths decides everything. Rows are nodes of an acyclic graph with four states (nothing yet, after
system, user, assistant). Paths of neighbouring stretches are joined by writing their digits one after the other,
so a long conversation is cut into blocks of ``BLOCK`` rows, whose tables of paths between states are joined
``FAN`` at a time until one is left.

Rows are taken by turn (null turns first), then by role and text; repeated rows stand side by side. A null role
or text is one space, so a null text is blank; null conversation ids are one conversation. Texts of any length are
compared by two 64-bit hashes and length. An empty table gives no rows. Other columns are not read. The repaired
rows are a table of their own (``repaired``); only the audit of a conversation is one value.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import source, table

BLANK = r"\A[\x20\x09-\x0D]*\z"
OPEN = r"[^.!?\x20\x09-\x0D][\x20\x09-\x0D]*\z"
PUNCTUATION = "[.!?]"
BLOCK, FAN = 64, 64
NEXT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
LETTERS = str.maketrans({"0": None, "1": "D", "2": "I", "3": "K", "4": "R"})
GROUP = 9  # bits of the three octal digits of a row
INSERT, REROLE, DELETE, UNFINISHED = 5, 1, 2, 5


def inserts(state: int) -> list[tuple[int, int, str]]:
    """``state, cost, digits`` after no, one or two inserts; more are never cheapest."""
    found, at = [(state, 0, "")], [(state, 0, "")]
    for _ in range(2):
        at = [(NEXT[r][s], c + INSERT, d + "2") for s, c, d in at for r in "ua" if s in NEXT[r]]
        found += at
    return found


def steps(kind: str) -> dict[tuple[int, int], tuple[int, int]]:
    """The least ``cost, digits`` between states over one row: its role's initial and ``d``, ``t`` or ``-`` for
    a row that must go, is truncated, or neither."""
    initial, fault = kind
    late = UNFINISHED if fault == "t" else 0
    found: dict[tuple[int, int], tuple[int, int]] = {}
    for start in range(4):
        for state, cost, digits in inserts(start):
            ways = [(state, DELETE, "1")]
            if fault != "d":
                ways += [(NEXT[initial][state], late, "3")] if state in NEXT.get(initial, {}) else []
                ways += [(NEXT[r][state], REROLE + late, "4") for r in "ua" if state in NEXT[r]]
            for stop, more, letter in ways:
                way = cost + more, int((digits + letter).ljust(3, "0"), 8)
                found[start, stop] = min(found.get((start, stop), way), way)
    return found


def endings() -> dict[int, tuple[int, int]]:
    """The least ``cost, digits`` of inserts from a state to an end: nothing at all, or after an assistant."""
    found: dict[int, tuple[int, int]] = {}
    for start in range(4):
        for state, cost, digits in inserts(start):
            if state in (0, 3):
                way = cost, int(digits.ljust(3, "0"), 8)
                found[start] = min(found.get(start, way), way)
    return found


def paths(kinds: str, starts: tuple[int, ...]) -> dict[tuple[int, int], int]:
    """Least path between states over rows of these ``kinds`` (two characters each), as one number."""
    rows = len(kinds) // 2
    high = GROUP * rows
    known = {k: steps(k) for k in {kinds[i : i + 2] for i in range(0, len(kinds), 2)}}
    out = {}
    for start in starts:
        best = {start: 0}
        for i in range(rows):
            low, after = GROUP * (rows - 1 - i), {}
            for (a, b), (cost, digits) in known[kinds[2 * i : 2 * i + 2]].items():
                if a in best:
                    weight = best[a] + (cost << high) + (digits << low)
                    if b not in after or weight < after[b]:
                        after[b] = weight
            best = after
        out.update({(start, stop): weight for stop, weight in best.items()})
    return out


def joined(left: dict, right: dict, rows_left: int, rows_right: int) -> dict[tuple[int, int], int]:
    """Least paths over two stretches, one after the other."""
    high_left, high_right = GROUP * rows_left, GROUP * rows_right
    out: dict[tuple[int, int], int] = {}
    for (a, b), x in left.items():
        for (c, d), y in right.items():
            if b == c:
                cost = (x >> high_left) + (y >> high_right)
                digits = ((x & (1 << high_left) - 1) << high_right) | y & (1 << high_right) - 1
                weight = (cost << high_left + high_right) | digits
                if (a, d) not in out or weight < out[a, d]:
                    out[a, d] = weight
    return out


def packed(found: dict[tuple[int, int], int]) -> list[dict]:
    return [{"a": a, "b": b, "w": w.to_bytes((w.bit_length() + 7) // 8)} for (a, b), w in found.items()]


def unpacked(listed) -> dict[tuple[int, int], int]:
    return {(p["a"], p["b"]): int.from_bytes(p["w"]) for p in listed}


def decided(found: dict[tuple[int, int], int], rows: int) -> tuple[int, str]:
    """Cost and audit of the least path from nothing to an end."""
    high, ends = GROUP * (rows + 1), endings()
    best = min(
        ((w >> GROUP * rows) + ends[b][0] << high) | (w & (1 << GROUP * rows) - 1) << GROUP | ends[b][1]
        for (a, b), w in found.items()
        if a == 0
    )
    return best >> high, f"{best & (1 << high) - 1:o}".zfill(3 * (rows + 1)).translate(LETTERS)


PATHS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("w", pa.binary())]))
PATHS_SQL = "array<struct<a:int,b:int,w:binary>>"


def block_paths(blocks: DataFrame) -> DataFrame:
    """``conv_id, block, rows, paths`` of ``conv_id, block, kinds``."""

    def run(batches):
        for batch in batches:
            numbers, kinds = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            # the first block of a conversation starts with nothing
            done = [packed(paths(k, (0,) if n == 0 else (0, 1, 2, 3))) for n, k in zip(numbers, kinds)]
            rows = pa.array([len(k) // 2 for k in kinds], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), rows, pa.array(done, PATHS)], names=["conv_id", "block", "rows", "paths"])

    return blocks.select("conv_id", "block", "kinds").mapInArrow(run, f"conv_id long, block long, rows long, paths {PATHS_SQL}")


def merged(blocks: DataFrame) -> DataFrame:
    """Neighbouring blocks of a conversation, ``FAN`` at a time, as one."""

    def run(batches):
        for batch in batches:
            rows, done = [], []
            for parts in batch.column(2).to_pylist():
                parts.sort(key=lambda part: part["block"])
                n, found = parts[0]["rows"], unpacked(parts[0]["paths"])
                for part in parts[1:]:
                    found = joined(found, unpacked(part["paths"]), n, part["rows"])
                    n += part["rows"]
                rows.append(n)
                done.append(packed(found))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.int64()), pa.array(done, PATHS)], names=["conv_id", "block", "rows", "paths"])

    group = F.floor(F.col("block") / FAN).cast("long").alias("block")
    grouped = blocks.select("conv_id", group, F.struct("block", "rows", "paths").alias("part")).groupBy("conv_id", "block")
    parts = grouped.agg(F.collect_list("part").alias("parts"))
    return parts.select("conv_id", "block", "parts").mapInArrow(run, f"conv_id long, block long, rows long, paths {PATHS_SQL}")


def audits(rows: DataFrame) -> DataFrame:
    """``conv_id, cost, audit`` of ``rows(conv_id, pos, kind)``."""
    block = F.floor(F.col("pos") / BLOCK).cast("long").alias("block")
    listed = rows.select("conv_id", block, F.struct("pos", "kind").alias("x")).groupBy("conv_id", "block")
    kinds = listed.agg(F.concat_ws("", F.sort_array(F.collect_list("x")).getField("kind")).alias("kinds"))
    found = block_paths(kinds)
    # how often the longest conversation has to be joined
    longest, size = rows.agg(F.max("pos")).first()[0] or 0, BLOCK
    while longest >= size:
        found, size = table(merged(found)), size * FAN

    def run(batches):
        for batch in batches:
            done = [decided(unpacked(p), n) for n, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            costs, letters = zip(*done) if done else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(costs, pa.int64()), pa.array(letters, pa.string())], names=["conv_id", "cost", "audit"])

    return found.select("conv_id", "rows", "paths").mapInArrow(run, "conv_id long, cost long, audit string")


def placed(rows: DataFrame) -> DataFrame:
    """``rows(conv_id, turn, role, text)`` with nulls filled, ``pos`` in the conversation and ``fault``.

    Positions come from counts of the turns before and places among the rows of a turn, so only rows of one turn
    are sorted in one task.
    """
    filled = rows.select(
        "conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text")
    ).withColumns({"h1": F.xxhash64("role", "text"), "h2": F.xxhash64("text", F.lit(1), "role", F.length("text"))})
    in_turn = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    numbered = filled.withColumn("within", F.row_number().over(in_turn) - 1)
    turns = filled.groupBy("conv_id", "turn").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))
    at = numbered.alias("x").join(
        turns.alias("y"), F.col("x.conv_id").eqNullSafe(F.col("y.conv_id")) & F.col("x.turn").eqNullSafe(F.col("y.turn"))
    )
    numbered = table(at.select("x.conv_id", "x.turn", "role", "text", "h1", "h2", (F.col("offset") + F.col("within")).alias("pos")))
    first = numbered.groupBy("conv_id", "h1", "h2").agg(F.min("pos").alias("first"))
    seen = numbered.alias("x").join(
        first.alias("y"),
        F.col("x.conv_id").eqNullSafe(F.col("y.conv_id")) & (F.col("x.h1") == F.col("y.h1")) & (F.col("x.h2") == F.col("y.h2")),
    )
    fault = (
        F.when(F.col("text").rlike(BLANK), "blank")
        .when(F.col("first") < F.col("pos"), "duplicate")
        .when(F.col("text").rlike(OPEN), "truncated")
    )
    return seen.select("x.conv_id", "turn", "pos", "role", "text", fault.alias("fault"))


def edits(found: DataFrame) -> DataFrame:
    """``conv_id, item, pos, role`` of every row that a repaired conversation has, from its ``audit``.

    ``pos`` is null for an inserted row; ``role`` is null for one that is kept.
    """

    def run(batches):
        for batch in batches:
            for conv_id, audit, system in zip(*(c.to_pylist() for c in batch.columns)):
                out: list[tuple] = []
                pos, item = 0, 0
                for letter in audit:
                    if letter != "D":
                        even = (item - system) % 2 == 0
                        role = None if letter == "K" else "user" if even else "assistant"
                        out.append((conv_id, item, None if letter == "I" else pos, role))
                        item += 1
                    pos += letter != "I"
                    if len(out) == 10_000:
                        yield made(out)
                        out = []
                yield made(out)

    def made(rows):
        columns = list(zip(*rows)) if rows else [[]] * 4
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["conv_id", "item", "pos", "role"])

    return found.select("conv_id", "audit", "system").mapInArrow(run, "conv_id long, item long, pos long, role string")


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``conv_id, item, role, text`` of the repaired conversations; ``rows`` as ``placed``, ``found`` as ``audits``."""
    # the first row that stays is system only if it is kept and is one
    kept = F.length(F.regexp_extract("audit", "^D*", 0))
    opening = found.withColumn("pos", F.when(F.substring("audit", kept + 1, 1) == "K", kept).cast("long"))
    initials = rows.select("conv_id", "pos", (F.substring("role", 1, 1) == "s").cast("int").alias("system"))
    opened = opening.alias("x").join(
        initials.alias("y"), F.col("x.conv_id").eqNullSafe(F.col("y.conv_id")) & (F.col("x.pos") == F.col("y.pos")), "left"
    ).select("x.conv_id", "audit", F.coalesce("system", F.lit(0)).alias("system"))
    items = edits(opened)
    staying = items.filter("pos IS NOT NULL").alias("x").join(
        rows.alias("y"), F.col("x.conv_id").eqNullSafe(F.col("y.conv_id")) & (F.col("x.pos") == F.col("y.pos"))
    ).select("x.conv_id", "item", F.coalesce("x.role", "y.role").alias("role"), "text")
    return staying.unionByName(items.filter("pos IS NULL").select("conv_id", "item", "role", F.lit("").alias("text")))


def digests(repaired_rows: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256``: rows are sorted outside memory and hashed as they come."""

    def run(batches):
        now, hashed, started = None, None, False
        out: list[tuple] = []

        def made():
            columns = list(zip(*out)) if out else [[], []]
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string())], names=["conv_id", "repaired_sha256"])

        for batch in batches:
            out.clear()
            for conv_id, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if not started or conv_id != now:
                    if started:
                        out.append((now, hashed.hexdigest()))
                    now, hashed, started = conv_id, hashlib.sha256(), True
                else:
                    hashed.update(b"\n")
                hashed.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
            yield made()
        out.clear()
        if started:
            out.append((now, hashed.hexdigest()))
        yield made()

    dealt = repaired_rows.repartition("conv_id").sortWithinPartitions("conv_id", "item")
    return dealt.select("conv_id", "role", "text").mapInArrow(run, "conv_id long, repaired_sha256 string")


def report(rows: DataFrame) -> DataFrame:
    """One row per conversation of ``rows(conv_id, turn, role, text)``: its faults, cost, audit and digest."""
    at = table(placed(rows))
    initial = F.substring("role", 1, 1)
    kind = F.concat(
        F.when(initial.isin("s", "u", "a"), initial).otherwise("x"),
        F.when(F.col("fault").isin("blank", "duplicate"), "d").when(F.col("fault") == "truncated", "t").otherwise("-"),
    )
    found = table(audits(at.select("conv_id", "pos", kind.alias("kind"))))
    counted = at.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0).cast("long")).alias("gaps"),
        *(F.count(F.when(F.col("fault") == name, 1)).alias(name) for name in ("blank", "duplicate", "truncated")),
    )
    heads = at.select("conv_id", "pos", initial.alias("i"))
    pairs = heads.alias("x").join(
        heads.alias("y"), F.col("x.conv_id").eqNullSafe(F.col("y.conv_id")) & (F.col("x.pos") + 1 == F.col("y.pos"))
    )
    pair = F.concat("x.i", "y.i")
    illegal = pairs.filter(~pair.isin("su", "ua", "au")).groupBy("x.conv_id").agg(F.count("*").alias("illegal"))
    done = counted
    for part in (illegal, found, digests(repaired(at, found))):
        done = done.alias("l").join(part.alias("r"), F.col("l.conv_id").eqNullSafe(F.col("r.conv_id")), "left").drop(F.col("r.conv_id"))
    return done


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with planted faults, by a hash of conversation and turn."""
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    conv, turn = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn"))
    key = F.concat(conv, F.lit(":"), turn)
    h = F.crc32(key.cast("binary")) % 20
    changed = F.when(h == 1, "").when(h == 2, F.regexp_replace(text, PUNCTUATION, "")).otherwise(text)
    return (
        conversations.select("conv_id", "turn", F.when(h == 4, "user").otherwise(role).alias("role"), changed.alias("text"), h.alias("h"))
        .filter("h <> 0")
        .withColumn("copy", F.explode(F.when(F.col("h") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
        .select("conv_id", "turn", "role", "text")
    )


def op13_repair(spark, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every conversation, after planted damage."""
    rows = source(spark, sf_dir, "conversations")
    done = report(damaged(rows))
    every = rows.select("conv_id").distinct().alias("l")
    joined_up = every.join(done.alias("r"), F.col("l.conv_id").eqNullSafe(F.col("r.conv_id")), "left")
    zero, empty = F.lit(0).cast("long"), F.lit(hashlib.sha256(b"").hexdigest())
    counts = [F.coalesce(c, zero).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined_up.select(
        "l.conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", empty).alias("repaired_sha256")
    )
