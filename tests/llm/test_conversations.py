import hashlib
import heapq
import random
import zlib

import pytest
from pyspark.sql import functions as F

from plumbline.llm import conversations as C

SCHEMA = "conv_id long, turn long, role string, text string"
SPACES = " \t\n\x0b\x0c\r"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind:
            text = "" if kind == 1 else text.translate(str.maketrans("", "", ".!?")) if kind == 2 else text
            out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def cheapest(rows):
    """By a search of states (row, place) in order of cost and audit."""
    faults, seen, counts = [], set(), {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, _, role, text in rows:
        t = text.rstrip(SPACES)
        fault = "blank" if not t else "duplicate" if (role, text) in seen else "truncated" if t[-1] not in ".!?" else ""
        seen.add((role, text))
        faults.append(fault)
        if fault:
            counts[fault] += 1
    heap, done = [(0, "", 0, "e", ())], set()
    while True:
        cost, audit, i, place, out = heapq.heappop(heap)
        if (i, place) in done:
            continue
        done.add((i, place))
        if i == len(rows) and place in "ea":
            break
        following = "a" if place == "u" else "u"
        name = {"u": "user", "a": "assistant"}[following]
        heapq.heappush(heap, (cost + 3, audit + "I", i, following, (*out, f"{name}:")))
        if i < len(rows):
            (_, _, role, text), fault = rows[i], faults[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, place, out))
            if fault not in ("blank", "duplicate"):
                extra = 3 * (fault == "truncated")
                if place + role[:1] in ("es", "eu", "su", "au", "ua"):
                    heapq.heappush(heap, (cost + extra, audit + "K", i + 1, role[:1], (*out, f"{role}:{text}")))
                heapq.heappush(heap, (cost + extra + 3, audit + "R", i + 1, following, (*out, f"{name}:{text}")))
    initials = [r[2][:1] for r in rows]
    numbers = {r[1] for r in rows} - {None}
    gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
    illegal = sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:], strict=False))
    return counts | {"gaps": gaps, "illegal": illegal, "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(out).encode()).hexdigest()}


def brute(rows):
    found = {r[0]: [] for r in rows}
    for r in damaged(rows):
        found[r[0]].append(r)
    order = lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest())
    return {conv: cheapest(sorted(rows, key=order)) for conv, rows in found.items()}


def conversations(n, seed):
    rng, rows = random.Random(seed), []
    for conv in [*range(n), None]:
        for turn in range(rng.randrange(14)):
            for _ in range(rng.choice([1, 1, 1, 1, 2])):
                role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""])
                rows.append((conv, rng.choice([turn, turn, turn, None]), role, rng.choice(["A b.", "x", "y!", "  ", " ok? \n", None, "Same.", "é…"])))
    return rows


def check(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("digest", F.lit(1)).withColumn("a.b", F.lit(2)).withColumn("kind", F.lit("x"))
    got = {r.conv_id: r.asDict() for r in C.digests(C.damage(C.turns(df))).collect()}
    want = brute(rows)
    assert set(got) == set(want)
    for conv, row in want.items():
        assert {k: got[conv][k] for k in row} == row, conv


def test_like_a_search_of_all_edits(spark):
    check(spark, conversations(80, 3))


def test_segments_make_no_difference(spark, monkeypatch):
    for name, value in (("SEGMENT_BITS", 1), ("FAN_BITS", 1), ("FAN", 2)):
        monkeypatch.setattr(C, name, value)
    check(spark, conversations(25, 4))


def test_long_and_repeated_turns(spark):
    rows = [(1, 5, "user", "the same turn?")] * 5000 + [(1, 6, "assistant", "a long one " * 50_000 + ".")] + [(2, 3, "user", None)] * 40
    check(spark, rows)


def test_few_and_no_rows(spark):
    dropped = next(t for t in range(200) if zlib.crc32(f"9:{t}".encode()) % 20 == 0)
    check(spark, [(9, dropped, "user", "gone.")])
    assert C.digests(C.damage(C.turns(spark.createDataFrame([], SCHEMA)))).collect() == []


def test_repaired_turns_alternate(spark):
    df = spark.createDataFrame(conversations(20, 5), SCHEMA)
    rows = C.repaired(df).orderBy("conv_id", "place").collect()
    by = {}
    for r in rows:
        by.setdefault(r.conv_id, []).append(r)
    assert by
    for own in by.values():
        assert [r.place for r in own] == list(range(len(own)))
        initials = "".join(r.role[:1] for r in own).removeprefix("s")
        assert initials == "ua" * (len(initials) // 2) and initials


@pytest.mark.parametrize("audit, expected", [("", []), ("II", [("I", "user", ""), ("I", "assistant", "")]), ("KDR", [("K", "user", "a"), ("R", "assistant", "b")])])
def test_replay(audit, expected):
    rows = [("user", "a", 2), ("x", "b", 1)] if "K" in audit else []
    assert list(C.replay(audit, iter(rows))) == expected
