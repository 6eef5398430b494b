"""Units: parts of a graph that no link leaves. What is small is solved in one task, many units at a time; what is large stays with Spark.

``marked`` finds the unit of each row. Rows are dealt by ranges of one end and joined inside slices of a range by union-find; only nodes
that more than one slice names are then joined on Spark (``dyck.components``). Identifiers that follow each other by module or function
leave few such nodes; where they don't, the result is the same and Spark has more to join.

``split`` tells small units from large ones by a bound on what solving one can cost, ``in_tasks`` deals the small ones out and hands them to a
function in slices of whole units, so that a task's memory is bounded by the slice and by the bound, not by the input.

Defined cases: a row whose second end is null links nothing; a link of a node with itself is none; nodes are whole numbers of any sign;
empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators import dyck

#: Rows of a slice that are joined or solved at once.
SLICE = 250_000
#: What solving one unit in a task may cost, in the terms of ``split``; what is solved at once has no more than this in all either.
MOST_COST = 5_000_000


def roots(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For nodes 0 to n - 1 the smallest node that links (x, y) lead to."""
    root = np.arange(n)
    while True:
        rx, ry = root[x], root[y]
        apart = np.flatnonzero(rx != ry)
        if not len(apart):
            return root
        x, y, rx, ry = x[apart], y[apart], rx[apart], ry[apart]
        np.minimum.at(root, np.maximum(rx, ry), np.minimum(rx, ry))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up


def slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Tables of at least so many rows but for the last."""
    held, n = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def whole(column: pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy()


def marked(rows: DataFrame, a: str, b: str, cut, slice_rows: int = SLICE) -> DataFrame:
    """``rows`` and ``unit``: the smallest of the nodes that links (a, b) of its slices join its ``a`` with. Both ends are longs, ``a`` never null."""
    names = rows.columns

    def each(batches):
        for t in slices(batches, slice_rows):
            x, linked = whole(t.column(a)), t.column(b).is_valid().to_numpy()
            y = np.where(linked, pc.fill_null(t.column(b), 0).to_numpy(), x)
            nodes, where = np.unique(np.r_[x, y], return_inverse=True)
            own = where[: len(x)]
            root = roots(len(nodes), own, where[len(x) :])
            low, high = own.min(), own.max()
            # nodes that other slices may name: all but its first ends strictly inside its range, which are nobody else's first ends
            inner = np.bincount(own, minlength=len(nodes)) > 0
            inner[low], inner[high] = False, False
            met = np.flatnonzero(~inner)
            none = len(met)
            out = [pa.concat_arrays([*t.column(c).chunks, pa.nulls(none, t.schema.field(c).type)]) for c in names]
            at = np.r_[np.full(len(x), False), np.full(none, True)]
            out += [pa.array(np.r_[nodes[root[own]], nodes[root[met]]]), pa.array(np.r_[x, nodes[met]]), pa.array(at)]
            yield from pa.Table.from_arrays(out, [*names, "_root", "_node", "_met"]).to_batches(max_chunksize=50_000)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    every = cut(rows.repartitionByRange(F.col(a)).sortWithinPartitions(a).mapInArrow(each, f"{kinds}, _root long, _node long, _met boolean"), "_met")
    own, met = every.where("not _met"), every.where("_met").select("_node", "_root").distinct()
    # a node that is another slice's first end is met there too
    ends = own.agg(F.min("_node").alias("low"), F.max("_node").alias("high")).first()
    inside = met.where(F.col("_node").between(F.lit(ends.low), F.lit(ends.high))).select("_node").distinct()
    met = cut(met.unionByName(own.join(inside, "_node", "left_semi").select("_node", "_root")).distinct())
    least = met.groupBy("_node").agg(F.min("_root").alias("least"), F.max("_root").alias("most")).where("least < most").select("_node", "least")
    links = cut(met.join(least, "_node").where("_root <> least").select(F.col("_root").alias("a"), F.col("least").alias("b")).distinct())
    if links.isEmpty():
        return own.select(*names, F.col("_root").alias("unit"))
    names_of = cut(dyck.components(links, cut)).select(F.col("node").alias("_root"), F.col("root").alias("_to"))
    return own.join(names_of, "_root", "left").select(*names, F.coalesce("_to", "_root").alias("unit"))


def split(rows: DataFrame, cut, most_cost: int = MOST_COST) -> tuple[DataFrame, DataFrame | None]:
    """The rows of units that a task can solve, and those of the others, None if there are none. ``weight`` says how many objects a row
    brings: a unit of n rows and k objects has at most n * k facts, so its cost is n * (k + 10)."""
    costs = cut(rows.groupBy("unit").agg((F.count(F.lit(1)) * (F.sum("weight") + 10.0)).alias("cost")))
    large = costs.where(F.col("cost") > most_cost).select("unit")
    if large.isEmpty():
        return rows, None
    return rows.join(large, "unit", "left_anti"), rows.join(large, "unit", "left_semi")


def _parts(t: pa.Table, most_cost: int) -> Iterator[pa.Table]:
    """Whole units of ``t``, sorted by them, together as long as their cost is bounded."""
    unit, weight = whole(t.column("unit")), whole(t.column("weight"))
    first = np.r_[0, np.flatnonzero(np.diff(unit)) + 1, len(unit)]
    cost = np.cumsum(np.diff(first) * (np.add.reduceat(weight.astype(np.int64), first[:-1]) + 10))
    at, done = 0, 0
    while at < len(cost):
        to = max(at + 1, int(np.searchsorted(cost, done + most_cost, "right")))
        yield t.slice(first[at], first[to] - first[at])
        at, done = to, cost[to - 1]


def in_tasks(rows: DataFrame, solve: Callable[[pa.Table], pa.Table], schema: str, most_cost: int = MOST_COST) -> DataFrame:
    """What ``solve`` makes of the rows of whole units, many at a time."""

    def each(batches):
        rest = []
        for t in slices(batches, SLICE):
            t = pa.concat_tables([*rest, t])
            unit = whole(t.column("unit"))
            last = int(np.searchsorted(unit, unit[-1]))
            rest = [t.slice(last)]
            for part in _parts(t.slice(0, last), most_cost) if last else ():
                yield from solve(part).to_batches(max_chunksize=50_000)
        for t in rest:
            yield from solve(t).to_batches(max_chunksize=50_000)

    return rows.repartition("unit").sortWithinPartitions("unit").mapInArrow(each, schema)
