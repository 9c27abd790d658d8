import hashlib
import random
import re
import zlib
from functools import cache
from itertools import product

import pytest

from threadloom.llm import repair

SPACE = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        conv_text, turn_text = (" " if x is None else x for x in (conv, turn))
        role, text = (" " if x is None else x for x in (role, text))
        h = zlib.crc32(f"{conv_text}:{turn_text}".encode()) % 20
        if h == 0:
            continue
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        out += [(conv, turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    return out


def fault_of(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        bare = text.strip(SPACE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def cheapest(rows, faults):
    """Least (cost, audit, repaired rows) from every row and role before it, written as text and compared as text."""
    follows = {None: "su", "s": "u", "u": "a", "a": "u"}

    @cache
    def best(i, before, inserted):
        found = []
        if i == len(rows) and before in (None, "a"):
            found.append((0, "", ()))
        if inserted < 2:
            for role in ("user", "assistant"):
                if role[0] in follows[before]:
                    cost, audit, kept = best(i, role[0], inserted + 1)
                    found.append((cost + 5, "I" + audit, (f"{role}:", *kept)))
        if i < len(rows):
            role, text = rows[i][2:]
            cost, audit, kept = best(i + 1, before, 0)
            found.append((cost + 2, "D" + audit, kept))
            if faults[i] not in ("blank", "duplicate"):
                late = 5 if faults[i] else 0
                for letter, as_role, price in (("K", role, 0), ("R", "user", 1), ("R", "assistant", 1)):
                    if as_role and as_role[0] in follows[before]:
                        cost, audit, kept = best(i + 1, as_role[0], 0)
                        found.append((cost + price + late, letter + audit, (f"{as_role}:{text}", *kept)))
        return min(found, default=(10**9, "", ()))

    for i in range(len(rows), -1, -100):  # the depth of the recursion stays small
        for before in follows:
            best(i, before, 0)
    return best(0, None, 0)


def brute(rows):
    out, grouped = {}, {}
    for row in rows:
        grouped.setdefault(row[0], [])
    for row in damage(rows):
        grouped[row[0]].append(row)
    for conv, found in grouped.items():
        found.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        faults = fault_of(found)
        turns = [r[1] for r in found if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        pairs = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(found, found[1:]))
        cost, audit, kept = cheapest(found, faults) if found else (0, "", ())
        digest = hashlib.sha256("\n".join(kept).encode()).hexdigest()
        out[conv] = (conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), pairs, cost, audit, digest)
    return out


def conversations(rng, n):
    rows = []
    for conv in range(n):
        for turn in range(rng.randint(1, 9)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "aide", None])
            text = rng.choice(["Yes.", "Yes.", "no", "Really?\n", " ", "", None, "a. b", "é!", " ", "fine "])
            rows.append((conv, rng.choice([turn, turn * 2, None, 3]), role, text))
    rows += [(None, 0, "user", "lost."), (None, 1, "assistant", "Found!"), (None, None, "assistant", "Found!")]
    return rows + rows[:5]


def result(done):
    return {r.conv_id: tuple(r) for r in done.collect()}


def run(spark, rows, tmp_path):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    return result(repair.op13_repair(spark, str(tmp_path)))


@pytest.mark.parametrize("block, fan", [(64, 64), (1, 2), (3, 2)])
def test_repair_equals_brute_force(spark, tmp_path, monkeypatch, block, fan):
    monkeypatch.setattr(repair, "BLOCK", block)
    monkeypatch.setattr(repair, "FAN", fan)
    rows = conversations(random.Random(block), 60)
    got, want = run(spark, rows, tmp_path), brute(rows)
    assert got.keys() == want.keys()
    for conv in want:
        assert got[conv] == want[conv], conv
    assert {c for row in got.values() for c in row[7]} == set("DKR")  # deleting a row is cheaper than inserting one


def test_paths_equal_all_edits():
    """Short conversations against every sequence of edits there is."""
    letters = {"K": 0, "D": 2, "R": 1}
    shape = re.compile("(s?(ua)+)?")
    for kinds in product(("s-", "u-", "a-", "ut", "at", "xd", "x-"), repeat=3):
        found = []
        for acts in product("KDR", repeat=3):
            if any(a != "D" and k[1] == "d" for a, k in zip(acts, kinds)):
                continue
            price = sum(letters[a] + (5 if k[1] == "t" and a != "D" else 0) for a, k in zip(acts, kinds))
            choices = [[k[0]] if a == "K" else [""] if a == "D" else ["u", "a"] for a, k in zip(acts, kinds)]
            for gaps in product((0, 1, 2), repeat=4):
                if sum(gaps) > 2:
                    continue
                audit = "".join("I" * g + a for g, a in zip(gaps, acts)) + "I" * gaps[3]
                new = [list(product("ua", repeat=g)) for g in gaps]
                if any(
                    shape.fullmatch("".join("".join(i) + r for i, r in zip(ins, roles)) + "".join(ins[3]))
                    for roles in product(*choices)
                    for ins in product(*new)
                ):
                    found.append((price + 5 * sum(gaps), audit))
        assert repair.decided(repair.paths("".join(kinds), (0,)), 3) == min(found)


def test_long_and_lost_conversations(spark, tmp_path):
    rng = random.Random(8)
    said = [(1, t, rng.choice(["user", "assistant"]), f"{t} " + "word " * 20 + ".") for t in range(700)]
    gone = next((c, t, "user", "x.") for c in range(2, 500) for t in [0] if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    rows = said + [gone, (900, 0, "user", "y" * 300_000 + "."), (900, 1, "assistant", "z" * 300_000)]
    got, want = run(spark, rows, tmp_path), brute(rows)
    assert got == want
    assert got[gone[0]][1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_no_rows_and_other_columns(spark, tmp_path):
    assert run(spark, [], tmp_path / "none") == {}
    frame = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes.")], SCHEMA).selectExpr("*", "'x' AS pos", "1 AS fault", "2 AS kind", "3 AS h", "4 AS copy")
    frame.write.parquet(str(tmp_path / "more" / "conversations.parquet"))
    assert result(repair.op13_repair(spark, str(tmp_path / "more"))) == brute([(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes.")])
