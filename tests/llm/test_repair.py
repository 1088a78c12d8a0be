import hashlib
import heapq
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from boxwright.llm import queries, repair

SCHEMA = "conv_id long, turn long, role string, text string, part string, present string"
GRAMMAR = re.compile(r"(s?(ua)+)?\Z")


def damaged(rows):
    """Plain form of the damage: conv_id -> rows that are left."""
    out = defaultdict(list)
    for c, t, r, x in rows:
        out[c] += []
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        x = "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x
        r = "user" if k == 4 else r
        out[c] += [(t, r, x)] * (0 if k == 0 else 2 if k == 3 else 1)
    return {c: sorted(v, key=lambda y: (y[0] is not None, y[0] or 0, y[1].encode(), y[2].encode())) for c, v in out.items()}


def faults(rows):
    seen, out = set(), []
    for _, r, x in rows:
        solid = re.sub("[\x20\x09-\x0d]", "", x)
        out.append("blank" if not solid else "duplicate" if (r, x) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((r, x))
    return out


def cheapest(rows, kinds):
    """(cost, audit, repaired) by shortest paths over (row, last role's initial), all edits tried."""
    heap, best = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, state, made = heapq.heappop(heap)
        if (i, state) in best:
            continue
        best.add((i, state))
        if i == len(rows) and state in ("", "a"):
            return cost, audit, made
        after = {"": "su", "s": "u", "u": "a", "a": "u"}[state]
        if i < len(rows):
            _, r, x = rows[i]
            more = kinds[i] == "truncated"
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state, made))
            if kinds[i] not in ("blank", "duplicate"):
                if r[:1] and r[:1] in after:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, r[:1], (*made, (r, x))))
                for role in ("user", "assistant"):
                    if role[0] in after:
                        heapq.heappush(heap, (cost + 2 + more, audit + "R", i + 1, role[0], (*made, (role, x))))
        for role in ("user", "assistant"):
            if role[0] in after:
                heapq.heappush(heap, (cost + 2, audit + "I", i, role[0], (*made, (role, ""))))
    raise AssertionError("no way through")


def expected(rows):
    out = {}
    for c, turns in damaged(rows).items():
        kinds = faults(turns)
        cost, audit, made = cheapest(turns, kinds)
        assert GRAMMAR.match("".join(r[:1] for r, _ in made))
        known = [t for t, _, _ in turns if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        initials = [r[:1] for _, r, _ in turns]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        digest = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in made).encode()).hexdigest()
        out[c] = (gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest)
    return out


def got(spark, rows):
    turns = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    made = repair.report(repair.repair(queries.damaged(turns.select("conv_id", "turn", "role", "text")), queries.F.col("present"))).collect()
    assert len({r.conv_id for r in made}) == len(made)
    return {r.conv_id: tuple(r)[1:] for r in made}


def sample(seed, n=120):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None]
    texts = ["Yes.", "No!", "open", "", " \t", None, "é?", "x\ny.", "Yes."]
    rows = []
    for c in [*range(n), None]:
        for t in range(rng.randint(1, 9)):
            turn = None if rng.random() < 0.1 else t + rng.choice((0, 0, 0, 1, 3))
            rows.append((c, turn, rng.choice(roles), rng.choice(texts)))
    return rows


@pytest.mark.parametrize("long", [4096, 3])
def test_repair_against_shortest_paths(spark, monkeypatch, long):
    """With pieces of three rows most conversations are put together from several."""
    rows = sample(long)
    monkeypatch.setattr(repair, "LONG", long)
    assert got(spark, rows) == expected(rows)


def test_one_conversation_in_many_pieces(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(7, t // 2, rng.choice(["user", "assistant", "user", "system"]), rng.choice(["One.", "two", "", f"{t}!", f"{t}"])) for t in range(900)] + [(8, 1, "user", "x")] * 40
    monkeypatch.setattr(repair, "LONG", 50)
    assert got(spark, rows) == expected(rows)


def test_defined_cases(spark):
    empty = hashlib.sha256(b"").hexdigest()
    whole = repair.report(repair.repair(spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "assistant", "y" * 200_000 + "."), (2, None, "assistant", "a."), (3, 0, "user", None)], "conv_id long, turn long, role string, text string")))
    found = {r.conv_id: r for r in whole.collect()}
    assert (found[1].cost, found[1].audit) == (0, "KK") and (found[2].cost, found[2].audit, found[2].gaps) == (2, "IK", 0)
    assert (found[3].blank, found[3].cost, found[3].audit, found[3].repaired_sha256) == (1, 3, "D", empty)
    none = spark.createDataFrame([], "conv_id string, turn int, role string, text string, whole int")
    assert repair.report(repair.repair(none)).collect() == []
