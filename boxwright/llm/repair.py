"""Repair of conversations' structure (operator 13).

Rows have faults: blank (no text but blanks), duplicate (role and text seen earlier in the conversation), truncated (the
last character that is no blank ends no sentence); the first that holds counts. Edits make the roles' initials
follow the grammar (s?(ua)+)?: Keep costs nothing, Rerole (to user or assistant) 2, Delete 3 and is forced on blank and
duplicate rows, Insert (an empty user or assistant row, anywhere) 2; a truncated row that isn't deleted adds 1.

A forward Viterbi pass carries, for each of the grammar's four states (nothing yet, behind the system row, behind a
user, behind an assistant), the least (cost, audit), audit being the edits' initials; after each row the layer is
closed by inserts, of which two at most can help. Of two prefixes in one state with equal cost none is a prefix
of the other, so least prefixes give the least whole; and a state and an audit leave one choice of roles.

Rows are range-partitioned by conversation and turn, so a conversation with many rows is spread over tasks.
A conversation that lies whole in one partition and has at most LONG rows is repaired there. All others are
cut into pieces of at most LONG rows: duplicates are found by grouping, each piece gets its least (cost, audit)
from every state to every state, a pass over a conversation's pieces picks the states between them, and each
piece is repaired from the state it starts in. Repaired texts stay one row for each piece.

Defined results: null role or text is one space; turns go by number, nulls first, then by role and text; rows that
repeat are duplicates; a null conv_id is one conversation; other roles than those of the grammar must be rerouted or
deleted; very long texts stay whole; present = false keeps a row out and its conversation in; a conversation without
rows has zeros and an empty audit; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, mapped

#: Rows of a piece, and of a conversation that is repaired at once.
LONG = 4096
START, SYSTEM, USER, ASSISTANT = range(4)
#: State behind a row of this initial, by the state before.
MOVES = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
FAULTS = ("", "blank", "duplicate", "truncated")
_SOME, _LAST = re.compile(r"[^\x20\x09-\x0D]"), re.compile(r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\Z")
Layer = list  # of four (cost, audit) or None


def fault(text: str, seen: bool) -> int:
    """Number of a row's first fault in FAULTS."""
    if not _SOME.search(text):
        return 1
    if seen:
        return 2
    return 0 if _LAST.search(text)[1] in ".!?" else 3


def closed(layer: Layer) -> Layer:
    """The layer with what inserts reach: a user behind all but a user, then an assistant behind a user."""
    for to, sources in ((USER, (START, SYSTEM, ASSISTANT)), (ASSISTANT, (USER,))):
        for s in sources:
            if layer[s] is not None:
                x = (layer[s][0] + 2, layer[s][1] + "I")
                if layer[to] is None or x < layer[to]:
                    layer[to] = x
    return layer


def step(layer: Layer, initial: str, kind: int) -> Layer:
    """The closed layer behind one more row."""
    out: Layer = [None if x is None else (x[0] + 3, x[1] + "D") for x in layer]
    if kind not in (1, 2):
        more = 1 if kind == 3 else 0
        for edit, cost, moves in (("K", more, MOVES.get(initial, {})), ("R", 2 + more, MOVES["u"]), ("R", 2 + more, MOVES["a"])):
            for s, to in moves.items():
                if layer[s] is not None:
                    x = (layer[s][0] + cost, layer[s][1] + edit)
                    if out[to] is None or x < out[to]:
                        out[to] = x
    return closed(out)


def passed(rows: list[tuple[str, int]], state: int) -> Layer:
    """The layer behind rows (initial, fault) from a state whose layer was closed before."""
    layer: Layer = [None] * 4
    layer[state] = (0, "")
    for initial, kind in rows:
        layer = step(layer, initial, kind)
    return layer


def walk(audit: str, state: int, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """The repaired (role, text) that an audit makes of rows, from a state."""
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        if edit != "K":
            role = "assistant" if state == USER else "user"
        state = MOVES[role[:1]][state]
        yield role, text


def ending(layer: Layer) -> tuple[int, str]:
    return min(x for x in (layer[START], layer[ASSISTANT]) if x is not None)


def _opened() -> Layer:
    """The layer before any row: nothing, or rows inserted in front."""
    return closed([(0, ""), None, None, None])


def repaired_at_once(rows: list[tuple[str, str]], kinds: list[int]) -> tuple[int, str, list[tuple[str, str]]]:
    """Cost, audit and repaired rows of a whole conversation."""
    layer = _opened()
    for (role, _), kind in zip(rows, kinds, strict=True):
        layer = step(layer, role[:1], kind)
    cost, audit = ending(layer)
    return cost, audit, list(walk(audit, START, iter(rows)))


def _illegal(initials: list[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))


def _kinds(rows: list[tuple[str, str]]) -> list[int]:
    seen: set = set()
    out = []
    for x in rows:
        out.append(fault(x[1], x in seen))
        seen.add(x)
    return out


_NUMBERS = "low long, high long, distinct long, blank long, duplicate long, truncated long, illegal long, first string, last string"


def _numbers(turns: list, rows: list[tuple[str, str]], kinds: list[int]) -> tuple:
    known = [t for t in turns if t is not None]
    initials = [r[:1] for r, _ in rows]
    return (min(known, default=None), max(known, default=None), len(set(known)), *(kinds.count(k) for k in (1, 2, 3)), _illegal(initials), initials[0] if rows else None, initials[-1] if rows else None)


def _table(rows: list[tuple], fields: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(fields)], schema=fields)


def _arrow(spark, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(ddl))


def repair(turns: DataFrame, present: Column | None = None) -> DataFrame:
    """Conversations in pieces: conv_id, part, piece, n_kept, repaired (rows `role:text`, newline-joined), cost, audit and counts.

    part and piece order a conversation's pieces; whole says that there is one. cost, audit and counts of a conversation
    are those of its pieces together (see report).
    """
    spark = turns.sparkSession
    kind = turns.schema["conv_id"].dataType.simpleString()
    space = F.lit(" ")
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), (F.lit(True) if present is None else present).alias("present"))
    keys = ["conv_id", "turn", "role", "text"]
    placed = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    raw = f"conv_id {kind}, part int, pos long, turn long, role string, text string, present boolean"
    done = f"whole boolean, n_kept long, repaired string, cost long, audit string, {_NUMBERS}"
    schema = f"{raw}, {done}"
    fields = _arrow(spark, schema)
    n_raw, n_done = 7, len(fields) - 7

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        out, held, conv, first, long = [], [], None, True, False
        pos = 0

        def flush(edge: bool) -> None:
            nonlocal held
            if edge:
                out.extend((*x, *[None] * n_done) for x in held)
            elif held:
                live = [x for x in held if x[6]]
                own = [(x[4], x[5]) for x in live]
                kinds = _kinds(own)
                cost, audit, made = repaired_at_once(own, kinds)
                out.append((conv, part, 0, *[None] * (n_raw - 3), True, len(made), "\n".join(f"{r}:{t}" for r, t in made), cost, audit, *_numbers([x[3] for x in live], own, kinds)))
            held = []

        began = False
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if began and row[0] != conv:
                    flush(first or long)
                    first = long = False
                conv, began = row[0], True
                held.append((row[0], part, pos, *row[1:]))
                pos += 1
                if len(held) > LONG:
                    long = True
                    flush(True)
                if len(out) >= 1000:
                    yield _table(out, fields)
                    out = []
        flush(True)  # the last conversation may go on in the next partition, as the first may come from the last one
        if out:
            yield _table(out, fields)

    split = cut(mapped(placed, run, schema))
    whole = split.filter("whole").select("conv_id", "part", F.lit(0).cast("long").alias("piece"), "whole", "n_kept", "repaired", "cost", "audit", *_names())
    return whole.unionByName(_in_pieces(split.filter("whole is null").select("conv_id", "part", "pos", "turn", "role", "text", "present"), kind))


def _names() -> list[str]:
    return [x.split()[0] for x in _NUMBERS.split(", ")]


def _in_pieces(rows: DataFrame, kind: str) -> DataFrame:
    """What repair gives, for conversations that lie in several partitions or are long."""
    spark = rows.sparkSession
    by = ["conv_id", "part", "piece"]
    rows = rows.withColumn("piece", F.floor(F.col("pos") / LONG)).withColumn("text_key", F.sha2("text", 256))
    where = F.struct("part", "pos")
    again = rows.filter("present").groupBy("conv_id", "role", "text_key").agg(F.min(where).alias("least"), F.count("pos").alias("n")).filter("n > 1").drop("n")
    marked = rows.alias("r").join(again.alias("a"), F.col("r.conv_id").eqNullSafe(F.col("a.conv_id")) & (F.col("r.role") == F.col("a.role")) & (F.col("r.text_key") == F.col("a.text_key")), "left")
    pieces = cut(marked.select("r.conv_id", "r.part", "r.piece", "r.pos", "r.turn", "r.role", "r.text", "r.present", F.coalesce(F.struct("r.part", "r.pos") != F.col("a.least"), F.lit(False)).alias("seen")))

    inner = f"conv_id {kind}, part int, piece long, starts array<int>, ends array<int>, costs array<long>, audits array<string>, {_NUMBERS}"
    fields = _arrow(spark, inner)

    def measure(key, table):
        table = table.sort_by("pos").filter(pa.compute.field("present"))
        own = list(zip(table["role"].to_pylist(), table["text"].to_pylist(), strict=True))
        kinds = [fault(t, s) for (_, t), s in zip(own, table["seen"].to_pylist(), strict=True)]
        short = [(r[:1], k) for (r, _), k in zip(own, kinds, strict=True)]
        ways = [(s, e, *x) for s in range(4) for e, x in enumerate(passed(short, s)) if x is not None]
        return pa.Table.from_batches([_table([(key[0].as_py(), key[1].as_py(), key[2].as_py(), *([w[i] for w in ways] for i in range(4)), *_numbers(table["turn"].to_pylist(), own, kinds))], fields)])

    measured = cut(pieces.groupBy(*by).applyInArrow(measure, inner))

    chosen = f"conv_id {kind}, part int, piece long, state int, cost long, audit string, {_NUMBERS}"
    out_fields = _arrow(spark, chosen)
    n_fixed = 7

    def choose(batches):
        """The least way through each conversation's pieces, which come in order; the audits of the pieces on it."""
        conv, layer, ways, began = None, _opened(), [], False

        def picked():
            end = min(((layer[s], s) for s in (START, ASSISTANT) if layer[s] is not None))[1]
            trail = []
            for row, back in reversed(ways):
                state, way = back[end]
                trail.append((row, state, way))
                end = state
            lead = ("", "I", "I", "II")[end]  # what stands in front of all rows
            for i, (row, state, way) in enumerate(reversed(trail)):
                more = i == 0 and end != START
                yield (*row[:3], START if more else state, row[5][way] + (2 * len(lead) if more else 0), (lead if more else "") + row[6][way], *row[n_fixed:])

        out = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if began and row[0] != conv:
                    out.extend(picked())
                    layer, ways = _opened(), []
                conv, began = row[0], True
                after: Layer = [None] * 4
                back: list = [None] * 4
                for i, (s, e, cost, audit) in enumerate(zip(*row[3:n_fixed], strict=True)):
                    if layer[s] is not None:
                        x = (layer[s][0] + cost, layer[s][1] + audit)
                        if after[e] is None or x < after[e]:
                            after[e], back[e] = x, (s, i)
                layer = after
                ways.append((row, back))
                if len(out) >= 100:
                    yield _table(out, out_fields)
                    out = []
        if began:
            out.extend(picked())
        if out:
            yield _table(out, out_fields)

    ordered = measured.repartition("conv_id").sortWithinPartitions(*by)
    ways = mapped(ordered, choose, chosen)
    last = f"conv_id {kind}, part int, piece long, whole boolean, n_kept long, repaired string, cost long, audit string, {_NUMBERS}"
    last_fields = _arrow(spark, last)

    def made(key, left, right):
        left = left.sort_by("pos").filter(pa.compute.field("present"))
        own = list(zip(left["role"].to_pylist(), left["text"].to_pylist(), strict=True))
        way = right.to_pylist()[0]
        rows = list(walk(way["audit"], way["state"], iter(own)))
        fixed = (*(k.as_py() for k in key), False, len(rows), "\n".join(f"{r}:{t}" for r, t in rows), way["cost"], way["audit"])
        return pa.Table.from_batches([_table([(*fixed, *(way[n] for n in _names()))], last_fields)])

    return pieces.groupBy(*by).cogroup(ways.groupBy(*by)).applyInArrow(made, last)


def report(parts: DataFrame) -> DataFrame:
    """One row for each conversation of repair: gaps, counts, cost, audit, repaired_sha256.

    Those of several pieces pass in order, piece by piece, through one task each: a digest is made from front to back.
    """
    kind = parts.schema["conv_id"].dataType.simpleString()
    out = f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    fields = _arrow(parts.sparkSession, out)
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("distinct"), F.lit(0).cast("long"))
    same = ["blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    once = parts.filter("whole").select("conv_id", gaps.alias("gaps"), *same, F.sha2("repaired", 256).alias("repaired_sha256"))
    order = ["conv_id", "part", "piece", "n_kept", "repaired", *same, "low", "high", "distinct", "first", "last"]

    def run(batches):
        conv, began, rows = None, False, []
        low = high = last = None
        distinct, sums, audit, digest, some = 0, [0] * 5, [], hashlib.sha256(), False

        def result():
            return (conv, 0 if low is None else high - low + 1 - distinct, *sums, "".join(audit), digest.hexdigest())

        for batch in batches:
            for r in (dict(zip(order, x, strict=True)) for x in zip(*(c.to_pylist() for c in batch.columns), strict=True)):
                if began and r["conv_id"] != conv:
                    rows.append(result())
                    low = high = last = None
                    distinct, sums, audit, digest, some = 0, [0] * 5, [], hashlib.sha256(), False
                conv, began = r["conv_id"], True
                if r["low"] is not None:
                    distinct += r["distinct"] - (r["low"] == high)  # a turn may go on from the piece before
                    low, high = r["low"] if low is None else low, r["high"]
                sums = [a + r[n] for a, n in zip(sums, same, strict=False)]
                if r["first"] is not None:
                    sums[3] += last is not None and last + r["first"] not in ("su", "ua", "au")
                    last = r["last"]
                audit.append(r["audit"])
                if r["n_kept"]:
                    digest.update(("\n" if some else "").encode() + r["repaired"].encode())
                    some = True
                if len(rows) >= 1000:
                    yield _table(rows, fields)
                    rows = []
        if began:
            rows.append(result())
        if rows:
            yield _table(rows, fields)

    rest = parts.filter("not whole").select(*order).repartition("conv_id").sortWithinPartitions("conv_id", "part", "piece")
    return once.unionByName(mapped(rest, run, out))
