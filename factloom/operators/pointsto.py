"""Points-to sets and aliases: inclusion, unification and type-based solvers, and the queries over their results.

Constraints (op, dst, src): ADDR dst = &src, COPY dst = src, LOAD dst = *src, STORE *dst = src. Solvers run as fixpoints
of joins. Of a pointer that isn't known (``status.known`` false) nothing can be excluded; one that is known and has no
targets points nowhere: the two stay apart in every query.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from factloom.operators import lineage, local, units


def _all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _of(constraints: DataFrame, op: str) -> DataFrame:
    return constraints.where(F.col("op") == op).select("dst", "src")


#: How rows that are handed to tasks call the constraints.
OPS = {"ADDR": 0, "COPY": 1, "LOAD": 2, "STORE": 3}


def constraint_rows(constraints: DataFrame) -> DataFrame:
    """op (by ``OPS``), a, b, weight of constraints: rows for ``units``."""
    code = F.create_map(*[F.lit(x) for pair in OPS.items() for x in pair])[F.col("op")].cast("tinyint")
    known = constraints.where(F.col("op").isin(*OPS) & F.col("dst").isNotNull() & F.col("src").isNotNull())
    return known.select(code.alias("op"), F.col("dst").cast("long").alias("a"), F.col("src").cast("long").alias("b"), (F.col("op") == "ADDR").cast("int").alias("weight"))


def _given_back(rows: DataFrame, like: DataFrame) -> DataFrame:
    """Constraints that ``constraint_rows`` made."""
    name = F.create_map(*[F.lit(x) for op, code in OPS.items() for x in (code, op)])[F.col("op").cast("int")]
    return rows.select(name.alias("op"), F.col("a").cast(like.schema["dst"].dataType).alias("dst"), F.col("b").cast(like.schema["src"].dataType).alias("src"))


def _solved(t: pa.Table) -> pa.Table:
    op, a, b = (units.whole(t.column(c)) for c in ("op", "a", "b"))
    nodes, where = np.unique(np.r_[a, b], return_inverse=True)
    a, b = where[: len(a)], where[len(a) :]
    v, o = local.inclusion(len(nodes), *[(a[op == k], b[op == k]) for k in range(4)])
    return pa.table({"ptr": nodes[v], "site": nodes[o]})


def inclusion(constraints: DataFrame, most_rounds: int = 10_000, calls: tuple[DataFrame, DataFrame] | None = None, most_cost: int = units.MOST_COST, large_by: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """ptr, site: the inclusion-based solution (subset constraints). Parts of the program that no constraint links are solved by a task each, many
    at a time (``units``), if they are small; the others together by ``large_by``, or rounds of joins (``inclusion_by_rounds``). Null operands
    give no fact."""
    if calls is not None or not all(isinstance(constraints.schema[c].dataType, IntegralType) for c in ("dst", "src")):
        return inclusion_by_rounds(constraints, most_rounds, calls)
    with lineage.rounds(constraints.sparkSession) as cut:
        small, large = units.split(units.marked(constraint_rows(constraints), "a", "b", cut), cut, most_cost)
        found = units.in_tasks(small, _solved, "ptr long, site long", most_cost)
        found = found.select(F.col("ptr").cast(constraints.schema["dst"].dataType), F.col("site").cast(constraints.schema["src"].dataType))
        if large is not None:
            rest = _given_back(large, constraints)
            found = found.unionByName(large_by(rest) if large_by else inclusion_by_rounds(rest, most_rounds))
        return lineage.cut(found)


def inclusion_by_rounds(
    constraints: DataFrame, most_rounds: int = 10_000, calls: tuple[DataFrame, DataFrame] | None = None,
    reads: Callable[[Column], Column] | None = None, moves: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """ptr, site: the inclusion-based solution by semi-naive iteration.

    A round first turns new points-to facts into new copy edges by LOAD and STORE, then sends new facts over all copy edges
    and old facts over the new edges; both results are one cut frame. With ``calls`` (operand, pos, node) and (site, pos, node), calls
    through pointers are resolved on the way: a function's site in the operand's set makes copies from what is passed at a
    position to its parameter there, and at position -1 from what it returns to the call. ``reads`` tells which cells a load from an
    object reads (an array; itself alone by default), ``moves`` which facts (v, o) follow at once from new ones: see ``fields``.
    """
    spark = constraints.sparkSession
    edge = lambda df, fact, x, y: df.select(F.lit(fact).alias("fact"), F.col(x).alias("x"), F.col(y).alias("y"))
    with lineage.rounds(spark) as cut, lineage.Growing(spark, "fact") as table:
        load, store = cut(_of(constraints, "LOAD").distinct()), cut(_of(constraints, "STORE").distinct())
        if calls is not None:
            given, formals = cut(calls[0].select("operand", "pos", F.col("node").alias("given"))), cut(calls[1].select("site", "pos", "node"))
        last = table.add(edge(_of(constraints, "ADDR"), True, "dst", "src").unionByName(edge(_of(constraints, "COPY"), False, "dst", "src")).distinct())
        for _ in range(most_rounds):
            delta = last.where("fact").select(F.col("x").alias("v"), F.col("y").alias("o"))
            pts = table.all().where("fact").select(F.col("x").alias("v"), F.col("y").alias("o"))
            copies = table.all().where("not fact").select(F.col("x").alias("dst"), F.col("y").alias("src"))
            by_load = delta.join(load, F.col("v") == F.col("src")).select("dst", (F.explode(reads(F.col("o"))) if reads else F.col("o")).alias("src"))
            by_store = delta.join(store, F.col("v") == F.col("dst")).select(F.col("o").alias("dst"), "src")
            links = by_load.unionByName(by_store)
            if calls is not None:
                met = delta.join(given, F.col("v") == F.col("operand")).join(formals, (F.col("o") == F.col("site")) & (given["pos"] == formals["pos"]))
                back = given["pos"] == -1
                links = links.unionByName(met.select(F.when(back, F.col("given")).otherwise(F.col("node")).alias("dst"), F.when(back, F.col("node")).otherwise(F.col("given")).alias("src")))
            fresh = links.where("dst <> src").distinct().join(copies, ["dst", "src"], "left_anti")
            along = delta.join(copies, F.col("v") == F.col("src")).select(F.col("dst").alias("v"), "o")
            along = along.unionByName(pts.join(fresh, F.col("v") == F.col("src")).select(F.col("dst").alias("v"), "o"))
            along = along.unionByName(moves(delta)) if moves else along
            new = along.distinct().join(pts, ["v", "o"], "left_anti")
            last = table.add(edge(new, True, "v", "o").unionByName(edge(fresh, False, "dst", "src")))
            if last.isEmpty():
                return lineage.cut(pts.select(F.col("v").alias("ptr"), F.col("o").alias("site")))
    raise RuntimeError("points-to sets have not converged")


def copy_closure(constraints: DataFrame) -> DataFrame:
    """ptr, site by ADDR and COPY alone: what a solver without memory gives."""
    return inclusion(constraints.where("op in ('ADDR', 'COPY')"))


#: Levels (of dst, of src) of the terms that a constraint unifies.
LEVELS = {"ADDR": (1, 0), "COPY": (1, 1), "LOAD": (1, 2), "STORE": (2, 1)}


def _unified(t: pa.Table) -> pa.Table:
    op, a, b = (units.whole(t.column(c)) for c in ("op", "a", "b"))
    nodes, where = np.unique(np.r_[a, b], return_inverse=True)
    level = np.array([LEVELS[name] for name in OPS])[op]
    terms = np.arange(3 * len(nodes))
    label = local.unification(len(terms), where[: len(a)] * 3 + level[:, 0], where[len(a) :] * 3 + level[:, 1], np.where(terms % 3 < 2, terms + 1, -1))
    return pa.table({"node": nodes[terms // 3], "level": (terms % 3).astype(np.int32), "label": nodes[label // 3] * 3 + label % 3})


def unification(constraints: DataFrame, most_rounds: int = 10_000, most_cost: int = units.MOST_COST) -> DataFrame:
    """node, level, label: classes of the terms v, *v, **v (levels 0 to 2) of the unification-based solution.

    ``label`` is the smallest node * 3 + level of the class. Parts of the program that no constraint links are solved by a task each, many at a time,
    if they are small; the others by rounds of joins (``unification_by_rounds``). Null operands link nothing and are no nodes.
    """
    with lineage.rounds(constraints.sparkSession) as cut:
        rows = constraint_rows(constraints).withColumn("weight", F.lit(0))
        small, large = units.split(units.marked(rows, "a", "b", cut), cut, most_cost)
        found = units.in_tasks(small, _unified, "node long, level int, label long", most_cost).select(F.col("node").cast("int"), "level", "label")
        if large is not None:
            found = found.unionByName(unification_by_rounds(_given_back(large, constraints), most_rounds))
        return lineage.cut(found)


def unification_by_rounds(constraints: DataFrame, most_rounds: int = 10_000) -> DataFrame:
    """node, level, label by congruence closure of labels: a term takes the smallest label of what it is unified with; terms of one class have
    their pointees unified; labels jump to their own labels."""
    links = _all([_of(constraints, op).select((F.col("dst").cast("long") * 3 + a).alias("x"), (F.col("src").cast("long") * 3 + b).alias("y")) for op, (a, b) in LEVELS.items()]).distinct()
    nodes = constraints.select(F.col("dst").alias("n")).unionByName(constraints.select(F.col("src").alias("n"))).distinct()
    term = nodes.select(F.explode(F.array(*[F.col("n").cast("long") * 3 + k for k in range(3)])).alias("t"))
    with lineage.rounds(constraints.sparkSession) as cut:
        links = cut(links.unionByName(links.select(F.col("y").alias("x"), F.col("x").alias("y"))))
        labels = cut(term.select("t", F.col("t").alias("l")))
        before = None
        for _ in range(most_rounds):
            # the smallest label among neighbours
            near = links.join(labels, F.col("y") == F.col("t")).groupBy("x").agg(F.min("l").alias("m")).select(F.col("x").alias("t"), "m")
            # pointees of one class: the smallest label among them, for all of them
            up = labels.where("pmod(t, 3) < 2").select(F.col("l").alias("c"), (F.col("t") + 1).alias("t"))
            up = up.join(labels, "t")
            least = up.groupBy("c").agg(F.min("l").alias("m"))
            congruent = up.join(least, "c").groupBy("t").agg(F.min("m").alias("m"))
            # the label's own label
            jump = labels.join(labels.select(F.col("t").alias("l"), F.col("l").alias("m")), "l").select("t", "m")
            best = near.unionByName(congruent).unionByName(jump).groupBy("t").agg(F.min("m").alias("m"))
            labels = cut(labels.join(best, "t", "left").select("t", F.least("l", "m").alias("l")))
            now = labels.agg(F.sum(F.col("l").cast("decimal(38,0)"))).first()[0]
            if now == before:
                break
            before = now
        else:
            raise RuntimeError("classes have not converged")
        return lineage.cut(labels.select(F.floor(F.col("t") / 3).cast("int").alias("node"), F.pmod("t", F.lit(3)).cast("int").alias("level"), F.col("l").alias("label")))


def unification_pts(classes: DataFrame) -> DataFrame:
    """ptr, site: the objects (negative nodes) in the class of a variable's pointee. The alias oracle asked for every site
    becomes an equi-join on the class."""
    pointee = classes.where("level = 1 and node >= 0").select(F.col("node").alias("ptr"), "label")
    return pointee.join(classes.where("level = 0 and node < 0").select(F.col("node").alias("site"), "label"), "label").select("ptr", "site")


#: Functions of one signature and layer that travel together, and parts that the calls of one signature are dealt to.
TOGETHER, DEALT = 1024, 64


def type_based(sites: DataFrame, functions: DataFrame, layers: int = 2) -> DataFrame:
    """callsite, callee: indirect calls go to functions whose address is taken and whose signature is the call's; with two
    layers, a call through a field known by ``layer`` goes to functions stored in such fields only, if there are any.

    Which calls have such functions is told from signatures and layers alone, so that the product of calls and functions, which is the
    result, is made last and never shuffled. Functions meet calls as arrays, in ``DEALT`` parts of each signature.
    """
    taken = functions.where("is_taken").select(F.col("vid").alias("callee"), "signature", F.col("layer").alias("stored"))
    own = sites.where("kind = 'indirect'").select("callsite", "signature", "layer")
    most = taken.groupBy("signature", "stored").count().agg(F.max("count")).first()[0] or 0
    group = F.pmod(F.xxhash64("callee"), F.lit(-(-most // TOGETHER) or 1))
    groups = taken.groupBy("signature", "stored", group.alias("g")).agg(F.collect_list("callee").alias("callees"))
    groups = groups.select("signature", "stored", "callees", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))).alias("part"))
    own = own.withColumn("part", F.pmod(F.xxhash64("callsite"), F.lit(DEALT)).cast("int"))
    tasks = int(sites.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a few calls make many pairs, so that their own size must not join tasks
    everywhere = lambda calls: calls.repartition(tasks, "signature", "part").join(groups, ["signature", "part"]).select("callsite", F.explode("callees").alias("callee"))
    if layers < 2:
        return everywhere(own)
    there = taken.where("stored is not null").select("signature", F.col("stored").alias("layer")).distinct().withColumn("hit", F.lit(True))
    own = own.join(there, ["signature", "layer"], "left")
    exact = own.where("hit").select("callsite").distinct()
    own = own.join(exact.withColumn("exact", F.lit(True)), "callsite", "left")
    inside = own.where("exact").repartition(tasks, "signature", "layer", "part").join(groups.withColumnRenamed("stored", "layer"), ["signature", "layer", "part"]).select("callsite", F.explode("callees").alias("callee"))
    return everywhere(own.where("exact is null")).unionByName(inside)


# ---- queries -------------------------------------------------------------------------------------------------------


def status_of(pointers: DataFrame, unknown: DataFrame) -> DataFrame:
    """ptr, known."""
    return pointers.join(unknown.select("ptr", F.lit(False).alias("known")), "ptr", "left").select("ptr", F.coalesce("known", F.lit(True)).alias("known"))


def pts_of(pointers: DataFrame, pts: DataFrame, status: DataFrame) -> DataFrame:
    """ptr, known, n_sites, sites (sorted; null if unknown) of the pointers (ptr)."""
    own = pts.join(pointers, "ptr", "left_semi").groupBy("ptr").agg(F.array_sort(F.collect_set("site")).alias("s"))
    out = pointers.join(status, "ptr", "left").join(own, "ptr", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    sites = F.when(F.col("known"), F.coalesce("s", F.array().cast("array<int>")))
    return out.select("ptr", "known", F.when(F.col("known"), F.size(sites)).cast("long").alias("n_sites"), sites.alias("sites"))


def pt(pairs: DataFrame, pts: DataFrame, status: DataFrame) -> DataFrame:
    """ptr, site, result: May if the pointer is unknown or has the site, else No."""
    hit = pts.select("ptr", "site", F.lit(True).alias("hit"))
    out = pairs.join(status, "ptr", "left").join(hit, ["ptr", "site"], "left")
    return out.select("ptr", "site", F.when(F.coalesce("hit", ~F.coalesce("known", F.lit(False))), "May").otherwise("No").alias("result"))


def alias(pairs: DataFrame, pts: DataFrame, status: DataFrame) -> DataFrame:
    """a, b, result with a <= b: May if either is unknown or they share a site, else No. Each unordered pair is answered once.

    Shared sites are found by joining the pairs with both sides' sets, so work follows the pairs asked, not all pairs.
    """
    asked = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left, right = pts.select(F.col("ptr").alias("a"), "site"), pts.select(F.col("ptr").alias("b"), "site")
    share = asked.join(left, "a").join(right, ["b", "site"], "left_semi").select("a", "b").distinct().withColumn("share", F.lit(True))
    known = lambda c: status.select(F.col("ptr").alias(c), F.col("known").alias(f"known_{c}"))
    out = asked.join(known("a"), "a", "left").join(known("b"), "b", "left").join(share, ["a", "b"], "left")
    blind = ~(F.coalesce("known_a", F.lit(False)) & F.coalesce("known_b", F.lit(False)))
    return out.select("a", "b", F.when(blind | F.coalesce("share", F.lit(False)), "May").otherwise("No").alias("result"))


def alias_set(pointers: DataFrame, pts: DataFrame) -> DataFrame:
    """ptr, other: all that share a site with the pointers asked."""
    own = pts.join(pointers, "ptr", "left_semi")
    return own.join(pts.select(F.col("ptr").alias("other"), "site"), "site").where("other <> ptr").select("ptr", "other").distinct()


def expand_fields(pts: DataFrame, fields: DataFrame) -> DataFrame:
    """``pts`` and, for each site that is a base, all its fields (base, field)."""
    return pts.unionByName(pts.join(fields, F.col("site") == F.col("base")).select("ptr", F.col("field").alias("site"))).distinct()


def sweep(pts: DataFrame, status: DataFrame) -> DataFrame:
    """Every pointer asked once: how many are known, have targets or none, and the largest set."""
    sizes = status.join(pts.groupBy("ptr").agg(F.count(F.lit(1)).alias("n")), "ptr", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return sizes.agg(
        F.count(F.lit(1)).alias("n_pointers"), F.count_if(~F.col("known")).alias("n_unknown"), F.count_if(F.col("known") & (F.col("n") == 0)).alias("n_empty"),
        F.coalesce(F.max("n"), F.lit(0)).cast("long").alias("largest"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_facts"),
    )


SOLVERS = {"inclusion": inclusion, "copy": copy_closure, "unification": lambda c: unification_pts(unification(c))}


def solve(spark: SparkSession, constraints: DataFrame, solver: str = "none") -> DataFrame:
    """ptr, site by the named solver; 'none' knows nothing (give every pointer the status unknown)."""
    return spark.createDataFrame([], "ptr int, site int") if solver == "none" else SOLVERS[solver](constraints)
