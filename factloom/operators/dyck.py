"""Unification over labelled edges of any depth: two nodes of one class have their successors by one label in one class, too.

Labels are what a path of dereferences and fields is made of, so that ``*(p + 1)`` and ``*(q + 1)`` fall together once p and q do, however long
the path. A round joins the classes that are linked (``components``), moves the edges of those that were joined to their common
class and links what one class reaches by one label. Only these edges are looked at again: afterwards a class has one edge a label, so none is a
hot key however large it is. Of joined classes the largest keeps its name, so that a node is renamed about log n times at most;
what an edge leads to is renamed only when it is looked at. A label that a third of all edges share for one class is
reduced in salted parts before the whole.

Defined cases: null ends or labels give no edge and no link; repeated rows count once; a node linked with itself alone is a class; nodes
are whole numbers of any sign; empty tables give an empty result. A fixpoint that doesn't end within its bound raises.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators import lineage

#: Parts that the edges of one class and label are dealt to before they meet.
SALTS = 64


def components(links: DataFrame, cut, most_rounds: int = 1_000) -> DataFrame:
    """node, root (its component's smallest node) of links (a, b), for the nodes that aren't roots; by large and small stars."""
    e = cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(most_rounds):
        size = e.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("u").alias("u")).first()
        if size.n == size.u and e.join(e.select(F.col("v").alias("u")), "u", "left_semi").isEmpty():
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # every larger neighbour goes to the least
        large = cut(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        # and of the smaller ones all but the least, and the node itself
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
    raise RuntimeError("components have not converged")


def _renamed(df: DataFrame, column: str, names: DataFrame) -> DataFrame:
    """``df`` with the values of a column by names (node, root), where there is one."""
    new = names.select(F.col("node").alias(column), "root")
    return df.join(new, column, "left").withColumn(column, F.coalesce("root", column)).drop("root")


def _met(edges: DataFrame, cut) -> tuple[DataFrame, DataFrame]:
    """One edge for each class and label, and links (a, b) between all that these led to."""
    dealt = cut(edges.distinct().withColumn("salt", F.pmod(F.xxhash64("dst"), F.lit(SALTS))))
    part = cut(dealt.groupBy("src", "label", "salt").agg(F.min("dst").alias("least")))
    one = cut(part.groupBy("src", "label").agg(F.min("least").alias("dst")))
    links = dealt.join(part, ["src", "label", "salt"]).select(F.col("dst").alias("a"), F.col("least").alias("b"))
    links = links.unionByName(part.join(one, ["src", "label"]).select(F.col("least").alias("a"), F.col("dst").alias("b")))
    return one, cut(links.where("a <> b").distinct())


def closure(edges: DataFrame, equal: DataFrame, most_rounds: int = 10_000) -> DataFrame:
    """node, class (its smallest node): the least classes that join ``equal`` (a, b) and, for edges (src, label, dst) from one class by one label,
    what they lead to."""
    spark = edges.sparkSession
    with lineage.rounds(spark) as cut:
        edges = cut(edges.where("src is not null and label is not null and dst is not null").select(*[F.col(c).cast("long").alias(c) for c in ("src", "label", "dst")]).distinct())
        equal = cut(equal.where("a is not null and b is not null").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).distinct())
        ends = [edges.select(F.col("src").alias("node")), edges.select(F.col("dst").alias("node")), equal.select(F.col("a").alias("node")), equal.select(F.col("b").alias("node"))]
        nodes = cut(ends[0].unionByName(ends[1]).unionByName(ends[2]).unionByName(ends[3]).distinct())
        # at first every edge is looked at
        edges, links = _met(edges, cut)
        links = cut(links.unionByName(equal.where("a <> b")))
        names = cut(nodes.limit(0).select("node", F.col("node").alias("root")))
        for _ in range(most_rounds):
            if links.isEmpty():
                break
            stars = cut(components(links, cut))
            members = stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
            sizes = names.groupBy("root").agg((F.count(F.lit(1)) + 1).alias("size")).withColumnRenamed("root", "node")
            members = cut(members.join(sizes, "node", "left").select("node", "root", F.coalesce("size", F.lit(1)).alias("size")))
            largest = members.groupBy("root").agg(F.max_by("node", F.struct("size", -F.col("node"))).alias("keeps"))
            moved = cut(members.join(largest, "root").select("node", F.col("keeps").alias("root")))
            gone = cut(moved.where("node <> root"))
            again = gone.select(F.col("node").alias("root"), F.col("root").alias("to"))
            names = cut(names.join(again, "root", "left").select("node", F.coalesce("to", "root").alias("root")).unionByName(gone))
            touched = moved.select(F.col("node").alias("src"))
            active = _renamed(_renamed(edges.join(touched, "src", "left_semi"), "src", gone), "dst", names)
            one, links = _met(active.select("src", "label", "dst"), cut)
            edges = cut(edges.join(touched, "src", "left_anti").select("src", "label", "dst").unionByName(one))
        else:
            raise RuntimeError("classes have not converged")
        classes = nodes.join(names, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
        least = classes.groupBy("root").agg(F.min("node").alias("class"))
        return lineage.cut(classes.join(least, "root").select("node", "class"))


#: The label of a dereference; a field's is its offset.
DEREF = 0


def of_constraints(constraints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges and equal nodes of constraints (op, dst, src, offset): ADDR, LOAD and STORE are dereferences, GEP the edge of a field; COPY, and GEP without
    an offset, make equal."""
    deref = F.when(F.col("op") == "LOAD", F.struct(F.col("src").alias("src"), F.col("dst").alias("dst"))).otherwise(F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
    edges = constraints.where("op in ('ADDR', 'LOAD', 'STORE')").select(deref.alias("e")).select("e.src", F.lit(DEREF).alias("label"), "e.dst")
    # a negative offset is the way back of a positive one
    back = F.col("offset") < 0
    field = F.when(back, F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))).otherwise(F.struct("src", "dst"))
    edges = edges.unionByName(constraints.where("op = 'GEP' and offset <> 0").select(field.alias("e"), F.abs("offset").alias("label")).select("e.src", "label", "e.dst"))
    return edges, constraints.where("op = 'COPY' or op = 'GEP' and coalesce(offset, 0) = 0").select(F.col("dst").alias("a"), F.col("src").alias("b"))
