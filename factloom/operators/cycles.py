"""Cycles of copies: strongly connected components on Spark, and inclusion-based points-to sets with cycles as one node.

All variables on a cycle of copies have one points-to set. ``strong_components`` finds such cycles by trimming (a node without an edge
in, or out, is on none), colours (the smallest node that reaches a node) and backward reach inside a colour from the node that gave it; what
is left goes on with the edges inside colours alone, and once it is no more than a bounded number of edges, in one task. ``inclusion`` joins them between waves: facts then travel over a graph without
cycles, as deep as its longest chain, and are kept once for a cycle.

Defined cases: null operands give no edge and no fact; repeated constraints count once; an edge from a node to itself is no cycle;
empty tables give an empty result; nodes are whole numbers of any sign. A fixpoint that doesn't end within its bound raises.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators import lineage, pointsto, units

#: Steps of a fixpoint that share one job: most small graphs are then done in one or two.
HOPS = 3


def _trimmed(edges: DataFrame) -> DataFrame:
    into, out = edges.select(F.col("dst").alias("src")).distinct(), edges.select(F.col("src").alias("dst")).distinct()
    return edges.join(into, "src", "left_semi").join(out, "dst", "left_semi")


def strong_components(edges: DataFrame, most_rounds: int = 10_000, edges_a_task: int = 200_000) -> DataFrame:
    """node, component (its smallest node) of the nodes of edges (dst, src) that lie on a cycle of two nodes or more.

    ``edges_a_task``: what is left of the edges is one task's work when it is no more than so many; 0 leaves all to Spark.
    """
    spark = edges.sparkSession
    with lineage.rounds(spark) as cut:
        rest = cut(edges.where("dst <> src").select("dst", "src").distinct())
        n, found = rest.count(), []
        for _ in range(most_rounds):
            before = None
            while n > edges_a_task and n != before:  # a chain is trimmed from both of its ends
                rest = cut(_trimmed(_trimmed(rest)))
                n, before = rest.count(), n
            if n <= edges_a_task:
                found.append(cut(_in_one_task(rest)))
                break
            inner = cut(_in_colours(rest, _coloured(rest, cut, most_rounds)))
            on = _reaching(inner, cut, most_rounds)
            found.append(cut(on.select("node", F.col("colour").alias("component"))))
            gone = on.select("node")
            rest = cut(inner.select("dst", "src").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").join(gone.withColumnRenamed("node", "src"), "src", "left_anti").select("dst", "src"))
            n = rest.count()
        else:
            raise RuntimeError("strong components have not been found")
        every = edges.select(F.col("dst").alias("node"), F.col("src").alias("component")).limit(0)
        for part in found:
            every = every.unionByName(part)
        return lineage.cut(every)


def _in_one_task(edges: DataFrame) -> DataFrame:
    """node, component of a bounded number of edges, by one depth-first search that keeps its own stack."""

    def each(batches):
        parts = [b for b in batches if b.num_rows]
        if parts:
            t = pa.Table.from_batches(parts)
            nodes, where = np.unique(np.r_[t.column("src").to_numpy(), t.column("dst").to_numpy()], return_inverse=True)
            label = _components_of(len(nodes), where[: t.num_rows], where[t.num_rows :])
            least = np.full(len(nodes), len(nodes))
            np.minimum.at(least, label, np.arange(len(nodes)))
            on = np.flatnonzero(np.bincount(label, minlength=len(nodes))[label] > 1)
            yield pa.RecordBatch.from_arrays([pa.array(nodes[on], t.schema.field("dst").type), pa.array(nodes[least[label[on]]], t.schema.field("dst").type)], ["node", "component"])

    kind = edges.schema["dst"].dataType.simpleString()
    return edges.coalesce(1).mapInArrow(each, f"node {kind}, component {kind}")


def _components_of(n: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """A number for each node that the nodes of its strong component share: path-based search, linear in the edges."""
    order = np.argsort(src, kind="stable")
    to, first = dst[order].tolist(), np.searchsorted(src[order], np.arange(n + 1)).tolist()
    at, seen, label, count = first[:-1], [-1] * n, [-1] * n, 0
    for root in range(n):
        path = [root] if seen[root] < 0 else []
        open_, heads = [], []  # nodes without a component yet, and where each component on the path may begin
        while path:
            v = path[-1]
            if seen[v] < 0:
                seen[v], count = count, count + 1
                open_.append(v)
                heads.append(v)
            if at[v] < first[v + 1]:
                w = to[at[v]]
                at[v] += 1
                if seen[w] < 0:
                    path.append(w)
                elif label[w] < 0:
                    while seen[heads[-1]] > seen[w]:
                        heads.pop()
                continue
            path.pop()
            if heads[-1] == v:
                heads.pop()
                while label[v] < 0:
                    label[open_.pop()] = v
    return np.array(label, np.int64)


def _coloured(edges: DataFrame, cut, most_rounds: int) -> DataFrame:
    """node, colour: the smallest node that reaches it."""
    colours = cut(edges.select(F.col("dst").alias("node")).unionByName(edges.select(F.col("src").alias("node"))).distinct().select("node", F.col("node").alias("colour")))
    total = None
    for _ in range(most_rounds):
        for _ in range(HOPS):
            sent = edges.join(colours.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node"), "colour")
            colours = colours.unionByName(sent).groupBy("node").agg(F.min("colour").alias("colour"))
        colours = cut(colours)
        before, total = total, colours.agg(F.sum(F.col("colour").cast("decimal(38,0)"))).first()[0]
        if total == before:  # colours only fall, so that an equal sum is an equal table
            return colours
    raise RuntimeError("colours have not settled")


def _in_colours(edges: DataFrame, colours: DataFrame) -> DataFrame:
    """dst, src, colour of the edges inside a colour; no cycle leaves its colour."""
    ends = edges.join(colours.select(F.col("node").alias("src"), "colour"), "src").join(colours.select(F.col("node").alias("dst"), F.col("colour").alias("other")), "dst")
    return ends.where("colour = other").select("dst", "src", "colour")


def _reaching(inner: DataFrame, cut, most_rounds: int) -> DataFrame:
    """node, colour of the nodes from which an edge path inside the colour leads back to the node that gave it, and of that node."""
    on = cut(inner.where("dst = colour").select(F.col("src").alias("node"), "colour").distinct())
    on = cut(on.unionByName(on.select(F.col("colour").alias("node"), "colour")).distinct())
    n = on.count()
    for _ in range(most_rounds):
        for _ in range(HOPS):
            back = inner.join(on.select(F.col("node").alias("dst")), "dst").select(F.col("src").alias("node"), "colour")
            on = on.unionByName(back).distinct()
        on = cut(on)
        before, n = n, on.count()
        if n == before:
            return on
    raise RuntimeError("backward reach has not ended")


def inclusion(constraints: DataFrame, most_waves: int = 10_000, edges_a_task: int = 200_000, most_cost: int = units.MOST_COST) -> DataFrame:
    """ptr, site: the solution of ``pointsto.inclusion``. What is too large for a task there is solved by waves (``inclusion_by_waves``)."""
    return pointsto.inclusion(constraints, most_cost=most_cost, large_by=lambda rest: inclusion_by_waves(rest, most_waves, edges_a_task))


def inclusion_by_waves(constraints: DataFrame, most_waves: int = 10_000, edges_a_task: int = 200_000) -> DataFrame:
    """ptr, site on Spark alone. A wave joins the cycles of copies, sends facts along the copies until nothing
    is new, and makes new copies of what loads and stores meet then. Cycles are looked for again once a tenth of the copies is new:
    sets are right with cycles, too, only larger."""
    spark = constraints.sparkSession
    known = constraints.where("dst is not null and src is not null")
    of = lambda op: known.where(F.col("op") == op).select("dst", "src").distinct()
    with lineage.rounds(spark) as cut:
        load, store, copies = cut(of("LOAD")), cut(of("STORE")), cut(of("COPY").where("dst <> src"))
        pts = cut(of("ADDR").select(F.col("dst").alias("v"), F.col("src").alias("o")))
        names = cut(copies.select(F.col("dst").alias("node"), F.col("src").alias("name")).limit(0))  # nodes that go by another's name
        new, fresh, total = pts, 1, 1
        for _ in range(most_waves):
            cycles = None
            if 10 * fresh >= total:
                cycles, fresh = cut(strong_components(copies, edges_a_task=edges_a_task).where("node <> component")), 0
            if cycles is not None and not cycles.isEmpty():
                load, store = (cut(_named(_named(df, "dst", cycles), "src", cycles).distinct()) for df in (load, store))
                copies = cut(_named(_named(copies, "dst", cycles), "src", cycles).where("dst <> src").distinct())
                pts = cut(_named(pts, "v", cycles).distinct())
                names = cut(_named(names, "name", cycles).unionByName(cycles.select("node", F.col("component").alias("name"))))
                # the loads and stores of a cycle meet all that it points to
                joined = pts.join(cycles.select(F.col("component").alias("v")).distinct(), "v", "left_semi")
                new = cut(_named(new, "v", cycles).unionByName(joined).distinct())
            pts, sent = _sent(pts, copies, cut, most_waves)
            new = new.unionByName(sent)
            by_load = _named(new.join(load, F.col("v") == F.col("src")).select("dst", F.col("o").alias("src")), "src", names)
            by_store = _named(new.join(store, F.col("v") == F.col("dst")).select(F.col("o").alias("dst"), "src"), "dst", names)
            links = cut(by_load.unionByName(by_store).where("dst <> src").distinct().join(copies, ["dst", "src"], "left_anti"))
            if links.isEmpty():
                own = names.join(pts, F.col("name") == F.col("v")).select(F.col("node").alias("v"), "o")
                return lineage.cut(pts.unionByName(own).select(F.col("v").alias("ptr"), F.col("o").alias("site")))
            fresh += links.count()
            copies, new = cut(copies.unionByName(links)), pts.limit(0)
            total = copies.count()
    raise RuntimeError("points-to sets have not converged")


def _named(df: DataFrame, column: str, names: DataFrame) -> DataFrame:
    """``df`` with the nodes of a column by the names (node, then the name) that stand for them."""
    node, name = names.columns
    to = names.select(F.col(node).alias(column), F.col(name).alias("_name"))
    return df.join(to, column, "left").withColumn(column, F.coalesce("_name", column)).select(*df.columns)


def _sent(pts: DataFrame, copies: DataFrame, cut, most_rounds: int) -> tuple[DataFrame, DataFrame]:
    """All facts (v, o) once those of ``pts`` have gone along the copies, and those that were not there before."""
    with lineage.Growing(pts.sparkSession, "first") as table:
        last = table.add(pts.withColumn("first", F.lit(True))).select("v", "o")
        for _ in range(most_rounds):
            along = last.join(copies, F.col("v") == F.col("src")).select(F.col("dst").alias("v"), "o").distinct()
            last = table.add(along.join(table.all().select("v", "o"), ["v", "o"], "left_anti").withColumn("first", F.lit(False))).select("v", "o")
            if last.isEmpty():
                return cut(table.all().select("v", "o")), cut(table.all().where("not first").select("v", "o"))
    raise RuntimeError("facts have not come to rest")
