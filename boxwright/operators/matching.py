"""Grouped solvers: greedy one-to-one matching, non-maximum suppression, assignment, first-fit, singleton rescue.

Each runs on one bounded group (a clip, a frame, a component, a cluster, a track) with applyInPandas.
"""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import cut


def greedy_pairs(pairs: DataFrame, group: str | list[str], left: str, right: str, score: str) -> DataFrame:
    """Pairs by falling score (ties: left, right), each side once."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([score, left, right], ascending=[False, True, True], kind="stable")
        a, b, keep = set(), set(), []
        for x, y in zip(pdf[left], pdf[right], strict=True):
            ok = x not in a and y not in b
            keep.append(ok)
            if ok:
                a.add(x)
                b.add(y)
        return pdf[keep]

    return _alone_or(pairs, group, run)


def dominant(pairs: DataFrame, by: list[str], left: str, right: str, score: str) -> DataFrame:
    """Pairs that are the best of both their sides, by falling score (ties: left, right)."""
    rank = lambda side, other: F.row_number().over(Window.partitionBy(*by, side).orderBy(F.desc(score), other))
    return pairs.withColumns({"_a": rank(left, right), "_b": rank(right, left)}).filter("_a = 1 and _b = 1").drop("_a", "_b")


def dominant_pairs(pairs: DataFrame, by: list[str], left: str, right: str, score: str, rounds: int = 8) -> DataFrame:
    """As greedy_pairs, in rounds of joins: pairs that are the best of both sides are taken, their ends leave.

    In one order of all pairs, such a pair can't lose an end to any other, so the rounds give what the loop gives, for
    all groups at once. Each round is a written table; what is left after so many rounds goes to the loop.
    """
    rest, taken = cut(pairs), None
    for _ in range(rounds):
        if rest.isEmpty():
            break
        won = cut(dominant(rest, by, left, right, score))
        taken = won if taken is None else taken.unionByName(won)
        rest = cut(rest.join(won.select(*by, left), [*by, left], "left_anti").join(won.select(*by, right), [*by, right], "left_anti").select(*pairs.columns))
    if not rest.isEmpty():
        last = greedy_pairs(rest, by, left, right, score)
        taken = last if taken is None else taken.unionByName(last)
    return rest if taken is None else taken


def in_turn(pairs: DataFrame, group: str | list[str], left: str, right: str, score: str) -> DataFrame:
    """Each left of a group, in order, takes its best right that is still free (ties: the greatest right)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([left, score, right], ascending=[True, False, False], kind="stable")
        done, taken, keep = set(), set(), []
        for x, y in zip(pdf[left], pdf[right], strict=True):
            ok = x not in done and y not in taken
            keep.append(ok)
            if ok:
                done.add(x)
                taken.add(y)
        return pdf[keep]

    return _alone_or(pairs, group, run)


def _columns(group: str | list[str]) -> list[str]:
    return [group] if isinstance(group, str) else list(group)


def _alone_or(rows: DataFrame, group: str | list[str], run) -> DataFrame:
    """Rows alone in their group as they are; the others through run, group by group."""
    by = _columns(group)
    counted = rows.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    more = counted.filter("_n > 1").drop("_n").groupBy(*by).applyInPandas(run, rows.schema)
    return counted.filter("_n = 1").drop("_n").unionByName(more)


#: Boxes of a frame that one expression suppresses; frames of more go to a loop over arrays.
FEW = 32


def suppress(boxes: DataFrame, group: str | list[str], limit: float = 0.7, few: int = FEW) -> DataFrame:
    """Non-maximum suppression within a frame: by falling conf (ties: event_id), drop overlaps above limit.

    Most frames hold few boxes, so they are folded as rows, without a call of Python for each; the loop takes the
    frames of more than `few`. Both compare the same doubles.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["conf", "event_id"], ascending=[False, True], kind="stable").reset_index(drop=True)
        b = pdf[["x1", "y1", "x2", "y2"]].to_numpy()
        area = (b[:, 2] - b[:, 0]) * (b[:, 3] - b[:, 1])
        alive = np.ones(len(b), bool)
        for i in range(len(b)):
            if alive[i] and i + 1 < len(b):
                rest = b[i + 1 :]
                w = np.clip(np.minimum(b[i, 2], rest[:, 2]) - np.maximum(b[i, 0], rest[:, 0]), 0, None)
                h = np.clip(np.minimum(b[i, 3], rest[:, 3]) - np.maximum(b[i, 1], rest[:, 1]), 0, None)
                alive[i + 1 :] &= w * h / np.maximum(area[i] + area[i + 1 :] - w * h, 1e-6) <= limit
        return pdf[alive]

    by = _columns(group)
    rest = [c for c in boxes.columns if c not in by]
    kind = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in boxes.schema if f.name in rest)
    frames = boxes.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(F.col("conf").isNull().alias("_z"), (-F.col("conf")).alias("_s"), F.col("event_id").alias("_e"), F.struct(*rest).alias("_b")))).alias("_all"))
    area = lambda b: (b["x2"] - b["x1"]) * (b["y2"] - b["y1"])
    side = lambda a, b, c: F.greatest(F.lit(0.0), F.least(a[f"{c}2"], b[f"{c}2"]) - F.greatest(a[f"{c}1"], b[f"{c}1"]))

    def apart(a, b):
        both = side(a, b, "x") * side(a, b, "y")
        return both / F.greatest(area(a) + area(b) - both, F.lit(1e-6)) <= limit

    kept = F.aggregate("_all", F.array().cast(f"array<struct<{kind}>>"), lambda acc, x: F.when(F.forall(acc, lambda k: apart(k, x["_b"])), F.array_append(acc, x["_b"])).otherwise(acc))
    alive = frames.filter(F.size("_all") <= few).select(*by, F.explode(kept).alias("_b")).select(*by, "_b.*").select(*boxes.columns)
    more = frames.filter(F.size("_all") > few).select(*by, F.explode("_all").alias("_x")).select(*by, "_x._b.*").select(*boxes.columns)
    return alive.unionByName(more.groupBy(*by).applyInPandas(run, boxes.schema))


def assign(weights: np.ndarray) -> np.ndarray:
    """Maximum-weight matching of a square matrix, weights >= 0: column of each row (shortest augmenting paths)."""
    n = len(weights)
    cost = weights.max(initial=0.0) - weights
    u, v = np.zeros(n + 1), np.zeros(n + 1)
    match = np.zeros(n + 1, int)
    for row in range(1, n + 1):
        match[0] = row
        least, way, used, j0 = np.full(n + 1, np.inf), np.zeros(n + 1, int), np.zeros(n + 1, bool), 0
        while True:
            used[j0] = True
            free = np.flatnonzero(~used[1:]) + 1
            reduced = cost[match[j0] - 1, free - 1] - u[match[j0]] - v[free]
            better = reduced < least[free]
            least[free[better]], way[free[better]] = reduced[better], j0
            j1 = free[int(least[free].argmin())]
            delta = least[j1]
            u[match[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    out = np.empty(n, int)
    out[match[1:] - 1] = np.arange(n)
    return out


Graph = tuple[Sequence[int], Sequence[int], Sequence[float]]


def _graph(rows: np.ndarray, cols: np.ndarray, weights: np.ndarray, n: int) -> Graph:
    """Edges by row (row i has those from ends[i] to ends[i + 1]), in few bytes: ends, columns, weights."""
    by = np.argsort(rows, kind="stable")
    kind = "q" if weights.dtype.kind == "i" else "d"
    return np.searchsorted(rows[by], np.arange(n + 1)).tolist(), array("q", cols[by].astype(np.int64).tobytes()), array(kind, weights[by].tobytes())


def augment(graph: Graph, price: list, gain: list, owner: list[int], mate: list[int], todo: list[int]) -> None:
    """Match the rows of todo one after the other, or leave them free, which weighs 0.

    Prices keep gain[i] >= weight - price on every edge; each row is matched along the cheapest path (Dijkstra over
    columns) to a free column or to a row that gives up its own. owner: the row of a column, mate: the column of a row.
    """
    ends, col, weight = graph
    for start in todo:
        gain[start] = max(0, max(weight[e] - price[col[e]] for e in range(ends[start], ends[start + 1])))
        dist, via, heap, done, reached = {}, {}, [], {}, [(start, 0)]
        row, at, leave, leaver = start, 0, float("inf"), start
        while True:
            if at + gain[row] < leave:
                leave, leaver = at + gain[row], row
            for e in range(ends[row], ends[row + 1]):
                j = col[e]
                if j not in done:
                    d = at + max(0, gain[row] - weight[e] + price[j])
                    if d < dist.get(j, leave):
                        dist[j], via[j] = d, row
                        heapq.heappush(heap, (d, j))
            while heap and heap[0][1] in done:
                heapq.heappop(heap)
            if not heap or leave <= heap[0][0]:
                total, row = leave, leaver
                end = mate[row] if row != start else -1
                mate[row] = -1
                break
            at, j = heapq.heappop(heap)
            if owner[j] < 0:
                total, end = at, j
                break
            done[j], row = at, owner[j]
            reached.append((row, at))
        for j, d in done.items():
            price[j] += total - d
        for i, d in reached:
            gain[i] -= total - d
        while end >= 0:  # the columns of the path move on to the rows that reached them
            i = via[end]
            before = mate[i]
            owner[end], mate[i] = i, end
            end = before if i != start else -1


def bid(graph: Graph, price: list, gain: list, owner: list[int], mate: list[int], todo: list[int], step: int) -> list[int]:
    """Rows take their best column and raise its price by what it is better than their second best, and by step.

    Who loses its column bids again. With steps of 0, rows that have two best columns stop, and so do all after so many
    bids; these rows are returned. Lists as for augment.
    """
    ends, col, weight = graph
    stack, rest = todo[::-1], []
    left = BIDS * len(todo) if not step else -1
    while stack and left:
        left -= 1
        i = stack.pop()
        best, second, at = 0, 0, -1  # to stay free weighs 0
        for e in range(ends[i], ends[i + 1]):
            v = weight[e] - price[col[e]]
            if v > best:
                best, second, at = v, best, e
            elif v > second:
                second = v
        if at < 0:
            gain[i] = 0
            continue
        j = col[at]
        k = owner[j]
        if not step and k >= 0 and best == second:
            rest.append(i)
            continue
        price[j] += best - second + step
        gain[i], owner[j], mate[i] = second - step, i, j
        if k >= 0:
            mate[k] = -1
            stack.append(k)
    return rest + stack[::-1]


#: Rows from which prices are found in steps first, parts of the greatest weight that the steps are, and the bids of each row without a step.
STEPPED, STEPS, BIDS = 2_000, (10, 50, 250, 1250, 5000), 8


def _in_steps(rows: np.ndarray, cols: np.ndarray, weights: np.ndarray, n: int, m: int) -> list[int]:
    """The column of each row, or -1, as augment finds them, for weights that are whole numbers.

    Path after path is too slow where many rows want few columns: a path then leads through most of the graph. Bids with
    smaller and smaller steps find prices near the final ones; what is matched and isn't best within a step bids again,
    and columns that are left free above price 0 bid for rows in the same way. At last there is no step, so what is left
    goes along paths, which are short by then, and the sum is exact: no edge weighs more than its gain and its price,
    those matched weigh as much, and the free have 0.
    """
    forth, back = _graph(rows, cols, weights, n), _graph(cols, rows, weights, m)
    first = np.array(forth[0][:-1])
    price, owner, mate = np.zeros(m, np.int64), np.full(m, -1), np.full(n, -1)
    for step in [*filter(None, (int(weights.max()) // s for s in STEPS)), 0]:
        value = weights - price[cols]
        best = np.maximum(0, np.maximum.reduceat(value, first))
        e = np.flatnonzero((mate[rows] == cols) & (value >= best[rows] - step))
        mate, owner, gain = np.full(n, -1), np.full(m, -1), best
        mate[rows[e]], owner[cols[e]] = cols[e], rows[e]
        gain[rows[e]] = value[e]
        todo = np.flatnonzero((mate < 0) & (gain > 0)).tolist()
        price, gain, owner, mate = price.tolist(), gain.tolist(), owner.tolist(), mate.tolist()
        rest = bid(forth, price, gain, owner, mate, todo, step)
        if not step:
            augment(forth, price, gain, owner, mate, rest)
        rest = bid(back, gain, price, mate, owner, [j for j in range(m) if owner[j] < 0 and price[j] > 0], step)
        if not step:
            augment(back, gain, price, mate, owner, rest)
        price, owner, mate = np.maximum(0, np.array(price)), np.array(owner), np.array(mate)
    return mate.tolist()


def assign_edges(rows: np.ndarray, cols: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Which edges (rows ascending, weights >= 0) a maximum-weight matching takes: as assign, over the edges alone.

    Any row may stay free, which weighs 0. Many rows count weights as whole numbers of nine digits.
    """
    n, m = int(rows.max(initial=-1)) + 1, int(cols.max(initial=-1)) + 1
    if n < STEPPED:
        mate = [-1] * n
        augment(_graph(rows, cols, weights, n), [0.0] * m, [0.0] * n, [-1] * m, mate, list(range(n)))
    else:
        whole = np.rint(weights * 1e9).astype(np.int64)
        mate = _in_steps(rows, cols, whole // max(1, np.gcd.reduce(whole)), n, m)
    e = np.flatnonzero(np.array(mate, int)[rows] == cols)
    e = e[np.lexsort((-weights[e], rows[e]))]  # of edges between the same two, the heaviest
    chosen = np.zeros(len(cols), bool)
    chosen[e[np.unique(rows[e], return_index=True)[1]]] = True
    return chosen


#: Edges of a partition that is solved in one task: few bytes, much work, so bytes must not decide how many tasks there are.
SOLVED = 2_000


def assignment(edges: DataFrame, group: str, share: int = SOLVED) -> DataFrame:
    """The chosen edges (from_id, to_id, score) of each group: maximum total score, each end once.

    An edge alone in its group is taken as it is; the others are solved in a partition for each `share` of edges.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["from_id", "to_id"], kind="stable").reset_index(drop=True)
        r = np.unique(pdf["from_id"], return_inverse=True)[1]
        c = np.unique(pdf["to_id"], return_inverse=True)[1]
        return pdf[assign_edges(r, c, pdf["score"].to_numpy(float))]

    counted = cut(edges.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(group))))
    more = counted.filter("_n > 1").drop("_n")
    solved = more.repartition(max(1, -(-more.count() // share)), group).groupBy(group).applyInPandas(run, edges.schema)
    return counted.filter("_n = 1 and score > 0").drop("_n").unionByName(solved)


def first_fit(members: DataFrame, group: str, slack: float = 0.05, few: int = 4 * FEW) -> DataFrame:
    """members (group, id, start, end) with part: the first part whose latest end is at most start + slack.

    Groups of `few` members at most are folded as rows, without a call of Python for each; the loop takes larger ones.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["start", "id"], kind="stable")
        ends: list[float] = []
        part = []
        for s, e in zip(pdf["start"], pdf["end"], strict=True):
            k = next((i for i, x in enumerate(ends) if x - slack <= s), len(ends))
            ends[k : k + 1] = [max(e, ends[k]) if k < len(ends) else e]
            part.append(k)
        return pdf.assign(part=part)

    rest = [c for c in members.columns if c != group]
    groups = members.groupBy(group).agg(F.sort_array(F.collect_list(F.struct(F.col("start").alias("_s"), F.col("id").alias("_i"), F.struct(*rest).alias("_m")))).alias("_all"))

    def placed(acc, x):
        free = F.array_position(F.transform(acc["ends"], lambda e: e - slack <= x["_s"]), True)
        end = x["_m"]["end"].cast("double")
        held = F.transform(acc["ends"], lambda e, i: F.when(i == free - 1, F.greatest(e, end)).otherwise(e))
        part = F.when(free > 0, free - 1).otherwise(F.size(acc["ends"]).cast("long"))
        return F.struct(F.when(free > 0, held).otherwise(F.array_append(acc["ends"], end)).alias("ends"), F.array_append(acc["parts"], part).alias("parts"))

    zero = F.struct(F.array().cast("array<double>").alias("ends"), F.array().cast("array<bigint>").alias("parts"))
    parts = F.aggregate("_all", zero, placed, lambda acc: acc["parts"])
    some = groups.filter(F.size("_all") <= few).select(group, F.explode(F.arrays_zip("_all", parts.alias("_p"))).alias("_x"))
    some = some.select(group, F.col("_x")["_all"]["_m"].alias("_m"), F.col("_x")["_p"].alias("part")).select(group, "_m.*", "part").select(*members.columns, "part")
    many = groups.filter(F.size("_all") > few).select(group, F.explode("_all").alias("_x")).select(group, "_x._m.*").select(*members.columns)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in members.schema)
    return some.unionByName(many.groupBy(group).applyInPandas(run, f"{fields}, part long"))


def rescue_singletons(chunks: DataFrame, track: str, gap: float) -> DataFrame:
    """chunks (track, chunk, start, end, n): single rows join the previous chunk within gap, else the next; repeated."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk", kind="stable")
        groups = [[s, e, n, [c]] for s, e, n, c in zip(pdf["start"], pdf["end"], pdf["n"], pdf["chunk"], strict=True)]
        moved = True
        while moved:
            moved = False
            for i, g in enumerate(groups):
                if g[2] != 1:
                    continue
                if i and g[0] - groups[i - 1][1] <= gap:
                    j = i - 1
                elif i + 1 < len(groups) and groups[i + 1][0] - g[1] <= gap:
                    j = i + 1
                else:
                    continue
                a, b = groups[min(i, j)], groups[max(i, j)]
                groups[min(i, j) : max(i, j) + 1] = [[a[0], b[1], a[2] + b[2], a[3] + b[3]]]
                moved = True
                break
        to = {c: k for k, g in enumerate(groups) for c in g[3]}
        return pdf.assign(merged=pdf["chunk"].map(to))

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in chunks.schema)
    return chunks.groupBy(track).applyInPandas(run, f"{fields}, merged long")
