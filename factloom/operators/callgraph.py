"""Call graphs: edges from call sites, points-to sets and patches; neighbours, reachability, paths and bounded trees.

An edge is (type, caller, callsite, callee): direct, indirect (of a pointer's targets, or patched in, then without a call
site) or unknown (callee null: the call may go anywhere). Fixpoints run as frontier joins: a round joins what is new with
the edges, drops what was seen (left anti join) and is cut into the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators import lineage, local, units

EDGE = ["type", "caller", "callsite", "callee"]


def build_edges(sites: DataFrame, functions: DataFrame, targets: DataFrame, status: DataFrame) -> DataFrame:
    """Edges of call sites (callsite, caller, kind, operand).

    ``targets`` (ptr, site) and ``status`` (ptr, known) tell what a pointer called may be. A pointer that isn't known gives
    one unknown edge; a known one without targets none; targets that aren't functions and intrinsics are dropped.
    """
    callable_ = functions.where("not is_intrinsic").select(F.col("vid").alias("callee"))
    direct = sites.where("kind = 'direct'").join(callable_, F.col("operand") == F.col("callee")).select(F.lit("direct").alias("type"), "caller", "callsite", "callee")
    indirect = sites.select("callsite", "caller", "kind", "operand").where("kind = 'indirect'").join(status, F.col("callsite") == F.col("ptr"), "left").drop("ptr").withColumn("known", F.coalesce("known", F.lit(False)))
    unknown = indirect.where("not known").select(F.lit("unknown").alias("type"), "caller", "callsite", F.lit(None).cast("int").alias("callee"))
    resolved = indirect.where("known").join(targets, F.col("callsite") == F.col("ptr")).join(callable_, F.col("site") == F.col("callee")).select(F.lit("indirect").alias("type"), "caller", "callsite", "callee")
    return reduce(DataFrame.unionByName, [direct, unknown, resolved])


def patch_edges(patches: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges of patches (seq, caller_name, callee_name) by exact raw names, in order of seq; and the patches that name nothing or many."""
    found = index.where("is_real").groupBy("name").agg(F.min("vid").alias("vid"), F.count(F.lit(1)).alias("n")).where("n = 1")
    a, b = found.select(F.col("name").alias("caller_name"), F.col("vid").alias("caller")), found.select(F.col("name").alias("callee_name"), F.col("vid").alias("callee"))
    joined = patches.join(a, "caller_name", "left").join(b, "callee_name", "left")
    good = joined.where("caller is not null and callee is not null").select("seq", F.lit("indirect").alias("type"), "caller", F.lit(None).cast("int").alias("callsite"), "callee")
    return good, joined.where("caller is null or callee is null").select("seq", "caller_name", "callee_name")


def with_patches(edges: DataFrame, patched: DataFrame, functions: DataFrame) -> DataFrame:
    """Edges and place among their caller's: those of call sites in order, then patched ones (seq, ..) in order of seq.

    A function without a body has no edges, patched ones included.
    """
    bodies = functions.where("not is_decl and not is_intrinsic").select(F.col("vid").alias("caller"))
    both = edges.select(*EDGE, F.lit(None).cast("long").alias("seq")).unionByName(patched.join(bodies, "caller", "left_semi").select(*EDGE, F.col("seq").cast("long").alias("seq")))
    order = Window.partitionBy("caller").orderBy(F.col("callsite").asc_nulls_last(), F.col("seq").asc_nulls_first(), F.col("callee").asc_nulls_last())
    return both.select(*EDGE, F.row_number().over(order).alias("place"))


def without_silenced(edges: DataFrame, quiet: DataFrame) -> DataFrame:
    """Edges whose callee isn't one of the functions ``quiet`` (vid); unknown edges stay."""
    return edges.join(quiet.select(F.col("vid").alias("callee")), "callee", "left_anti").select(*EDGE)


def callout(edges: DataFrame, callers: DataFrame) -> DataFrame:
    """Edges out of the functions (caller)."""
    return edges.join(callers, "caller", "left_semi").select(*EDGE)


def first_of_pairs(edges: DataFrame) -> DataFrame:
    """One edge for each caller and callee, the first by call site (patched ones last); its type stays."""
    first = F.min(F.struct(F.col("callsite").isNull().alias("patched"), "callsite", "type")).alias("f")
    return edges.groupBy("caller", "callee").agg(first).select("f.type", "caller", "f.callsite", "callee")


def callin(edges: DataFrame, callees: DataFrame) -> DataFrame:
    """Edges into the functions (callee), section 'known'; and every unknown edge once, section 'unknown'."""
    known = edges.join(callees, "callee", "left_semi").select(F.lit("known").alias("section"), *EDGE)
    return known.unionByName(edges.where("type = 'unknown'").select(F.lit("unknown").alias("section"), *EDGE))


def callsite_targets(edges: DataFrame) -> DataFrame:
    """callsite, n_targets, targets (sorted) and unknown for each call site."""
    return edges.where("callsite is not null").groupBy("callsite").agg(F.count("callee").alias("n_targets"), F.array_sort(F.collect_set("callee")).alias("targets"), F.max(F.col("type") == "unknown").alias("unknown"))


#: Edges between different pairs of functions that each task may hold in memory (12 bytes or so each); more are searched by joins.
MOST_EDGES = 8_000_000
#: Rows of a result that a task holds before it hands them on.
HELD = 200_000


def _searched(edges: DataFrame, asked: DataFrame, search: Callable, schema: str, cut, most_edges: int) -> DataFrame | None:
    """What ``search`` (graph, source, targets) yields as columns, for each source of ``asked`` (source, target; longs): sources are dealt to tasks, each of
    which has all edges. None if there are more than ``most_edges``."""
    spark = edges.sparkSession
    known = cut(edges.where("caller is not null and callee is not null").select(F.col("caller").cast("long").alias("a"), F.col("callee").cast("long").alias("b")).distinct())
    if known.count() > most_edges:
        return None
    blind = edges.where("type = 'unknown' and caller is not null").select(F.col("caller").cast("long").alias("a")).distinct().toArrow()
    pairs = known.toArrow()
    held = spark.sparkContext.broadcast(local.Graph(*(units.whole(c) for c in (pairs.column("a"), pairs.column("b"), blind.column("a")))))

    def each(batches):
        graph, out, n = held.value, [], 0
        names = [f.split()[0] for f in schema.split(", ")]
        for t in units.slices(batches, HELD):
            source, target = units.whole(t.column("source")), units.whole(t.column("target"))
            first = np.r_[0, np.flatnonzero(np.diff(source)) + 1, len(source)]
            for i, j in zip(first, first[1:]):
                for columns in search(graph, source[i], target[i:j]):
                    out.append(pa.table(dict(zip(names, columns, strict=True))))
                    n += out[-1].num_rows
                if n >= HELD:
                    yield from pa.concat_tables(out).combine_chunks().to_batches(max_chunksize=50_000)
                    out, n = [], 0
        if out:
            yield from pa.concat_tables(out).combine_chunks().to_batches(max_chunksize=50_000)

    # few rows with much work each: as many tasks as a shuffle has, whatever the rows' size
    dealt = asked.where("source is not null").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "source")
    return dealt.sortWithinPartitions("source").mapInArrow(each, schema)


def _all_reached(graph: local.Graph, source: int, targets: np.ndarray) -> Iterator[tuple]:
    at = graph.at(np.array([source]))[0]
    if at >= 0:
        waves = list(graph.waves(at, np.full(len(graph.nodes), -1, np.int32)))
        nodes = np.concatenate(waves)
        yield np.full(len(nodes), source), graph.nodes[nodes], np.repeat(np.arange(1, len(waves) + 1), [len(w) for w in waves]).astype(np.int32)


def reach_set(edges: DataFrame, sources: DataFrame, hops_a_round: int = 4, most_edges: int = MOST_EDGES) -> DataFrame:
    """source, node, hops: what each source reaches over one known edge or more, and in how few. A source reaches itself only over a cycle.

    While the edges fit a task, tasks search them from their sources (``_searched``); else all sources go by joins (``reach_by_hops``).
    """
    with lineage.rounds(edges.sparkSession) as cut:
        asked = sources.select(F.col("vid").cast("long").alias("source"), F.lit(0).cast("long").alias("target")).distinct()
        found = _searched(edges, asked, _all_reached, "source long, node long, hops int", cut, most_edges)
        if found is None:
            return reach_by_hops(edges, sources, hops_a_round)
        return lineage.cut(found.select(F.col("source").cast(sources.schema["vid"].dataType), F.col("node").cast(edges.schema["callee"].dataType), "hops"))


def reach_by_hops(edges: DataFrame, sources: DataFrame, hops_a_round: int = 4, most_rounds: int = 10_000) -> DataFrame:
    """source, node, hops by joins.

    A round takes several hops in one job, each without what earlier rounds have found, so that long chains need few jobs. What was
    found is one growing table.
    """
    spark = edges.sparkSession
    with lineage.rounds(spark) as cut, lineage.Growing(spark, "part") as table:
        step = cut(edges.where("callee is not null").select(F.col("caller").alias("node"), F.col("callee").alias("next")).distinct())
        frontier, seen = sources.select(F.col("vid").alias("source"), F.col("vid").alias("node"), F.lit(0).alias("hops")), None
        for _ in range(most_rounds):
            found, at = [], frontier
            for _ in range(hops_a_round):
                at = at.join(step, "node").groupBy("source", F.col("next").alias("node")).agg((F.min("hops") + 1).alias("hops"))
                at = at if seen is None else at.join(seen, ["source", "node"], "left_anti")
                found.append(at)
            new = reduce(DataFrame.unionByName, found).groupBy("source", "node").agg(F.min("hops").alias("hops"))
            new = table.add(new.select("source", "node", "hops", F.lit(0).alias("part")))
            last = new.agg(F.max("hops")).first()[0]
            if last is None:
                return lineage.cut(table.all().select("source", "node", "hops"))
            # only what the last hop found leads on: what came before was already followed
            frontier, seen = new.where(F.col("hops") == last).select("source", "node", "hops"), table.all().select("source", "node")
    raise RuntimeError("reachable sets have not converged")


def _targets_reached(graph: local.Graph, source: int, targets: np.ndarray) -> Iterator[tuple]:
    """source, target of the targets that are reached; a null target if the source or what it reaches has an unknown edge."""
    at, wanted = graph.at(np.array([source]))[0], graph.at(targets)
    if at >= 0:
        via = np.full(len(graph.nodes), -1, np.int32)
        blind = graph.blind[at]
        for wave in graph.waves(at, via):
            blind |= graph.blind[wave].any()
        hit = targets[(wanted >= 0) & (via[wanted] >= 0)]
        yield np.full(len(hit), source), pa.array(hit, pa.int64())
        if blind:
            yield np.array([source]), pa.nulls(1, pa.int64())


def reachable(edges: DataFrame, pairs: DataFrame, ignore_unknown: bool = False, most_edges: int = MOST_EDGES) -> DataFrame:
    """source, target, reachable for each pair; unless unknown edges are ignored, one that the source itself or a function
    that it reaches has makes everything reachable."""
    with lineage.rounds(edges.sparkSession) as cut:
        asked = pairs.select(F.col("source").cast("long").alias("source"), F.coalesce("target", "source").cast("long").alias("target")).distinct()
        found = _searched(edges, asked, _targets_reached, "source long, target long", cut, most_edges)
        if found is None:
            return _reachable_by_hops(edges, pairs, ignore_unknown)
        found = lineage.cut(found.distinct().select(*[F.col(c).cast(pairs.schema[c].dataType) for c in ("source", "target")]))
    hit = pairs.join(found.where("target is not null").withColumn("hit", F.lit(True)), ["source", "target"], "left")
    hit = hit.join(found.where("target is null").select("source", (F.lit(True) if not ignore_unknown else F.lit(None).cast("boolean")).alias("blind")), "source", "left")
    return hit.select("source", "target", F.coalesce("hit", "blind", F.lit(False)).alias("reachable"))


def _reachable_by_hops(edges: DataFrame, pairs: DataFrame, ignore_unknown: bool) -> DataFrame:
    found = reach_by_hops(edges, pairs.select(F.col("source").alias("vid")).distinct()).select("source", "node")
    hit = pairs.join(found.withColumnRenamed("node", "target").withColumn("hit", F.lit(True)), ["source", "target"], "left")
    if not ignore_unknown:
        blind = edges.where("type = 'unknown'").select(F.col("caller").alias("node")).distinct()
        every = found.unionByName(pairs.select("source", F.col("source").alias("node")))
        blind = every.join(blind, "node", "left_semi").select("source").distinct().withColumn("blind", F.lit(True))
        hit = hit.join(blind, "source", "left")
    else:
        hit = hit.withColumn("blind", F.lit(None).cast("boolean"))
    return hit.select("source", "target", F.coalesce("hit", "blind", F.lit(False)).alias("reachable"))


def waves(edges: DataFrame, pairs: DataFrame, ignore_unknown: bool, table: lineage.Growing, most_hops: int) -> DataFrame:
    """source, node, via, hops: what each source reaches, in how few edges, and the smallest caller one edge before; and at hops 0
    the source itself. One wave a job, each added to ``table``.

    A source is followed while one of its pairs (source, target) is open: not reached, and no shorter way to an unknown edge. That is looked at
    in every fourth wave, as following a source for longer than needed changes no answer.
    """
    spark = edges.sparkSession
    with lineage.rounds(spark) as cut:
        step = cut(edges.where("callee is not null").select(F.col("caller").alias("node"), F.col("callee").alias("next")).distinct())
        blind = cut(edges.where("type = 'unknown'").select(F.col("caller").alias("node")).distinct())
        asked = cut(pairs.select("source", "target").distinct())
        start = asked.select("source", F.col("source").alias("node"), F.lit(None).cast(asked.schema["source"].dataType).alias("via"), F.lit(0).alias("hops"), F.lit(0).alias("part")).distinct()
        last = table.add(start)
        for hop in range(1, most_hops + 1):
            # the source itself may be met again over a cycle, so its start doesn't count as seen
            seen = table.all().where("hops > 0").select("source", "node")
            if hop % 4 == 1:
                open_ = asked.join(seen.withColumnRenamed("node", "target"), ["source", "target"], "left_anti").select("source").distinct()
                if not ignore_unknown:
                    open_ = open_.join(table.all().where(F.col("hops") < hop - 1).join(blind, "node", "left_semi").select("source").distinct(), "source", "left_anti")
                open_ = cut(open_)
            at = last.join(open_, "source", "left_semi").join(step, "node").groupBy("source", F.col("next").alias("found")).agg(F.min("node").alias("via"))
            new = at.withColumnRenamed("found", "node").join(seen, ["source", "node"], "left_anti").select("source", "node", "via", F.lit(hop).alias("hops"), F.lit(0).alias("part"))
            last = table.add(new)
            if last.isEmpty():
                return table.all().select("source", "node", "via", "hops")
    raise RuntimeError(f"paths of more than {most_hops} edges")


def _ways(ignore_unknown: bool, most_hops: int) -> Callable:
    """For ``paths``: source, target, hop, caller, callee of the steps to each target, or to an unknown edge; hop -1 if that takes too many."""

    def search(graph, source, targets):
        at, wanted = graph.at(np.array([source]))[0], graph.at(targets)
        if at < 0:
            return
        via, hops, hop = np.full(len(graph.nodes), -1, np.int32), np.zeros(len(graph.nodes), np.int32), 0
        blind = (0, at) if graph.blind[at] and not ignore_unknown else None  # where the nearest unknown edge is met
        there, elsewhere = wanted[wanted >= 0], not ignore_unknown and (wanted < 0).any()
        for wave in graph.waves(at, via) if len(there) or elsewhere else ():
            hop += 1
            hops[wave] = hop
            if blind is None and not ignore_unknown and graph.blind[wave].any():
                blind = (hop, wave[graph.blind[wave]][0])
            if blind and hop > blind[0] or not (elsewhere and blind is None) and hops[there].all():
                break
            if hop >= most_hops and len(wave):
                yield [np.array([source]), targets[:1], np.array([-1], np.int32), np.array([source]), pa.nulls(1, pa.int64())]
                return
        steps = []
        for target, node in zip(targets.tolist(), wanted.tolist()):
            n = int(hops[node]) if node >= 0 else 0
            if blind and not 0 < n <= blind[0] + 1:
                n, node = int(blind[0]), int(blind[1])
                steps.append((target, n + 1, node, -1))
            while n > 0:
                steps.append((target, n, int(via[node]), node))
                node, n = int(via[node]), n - 1
        if steps:
            target, n, caller, callee = np.array(steps).T
            yield [np.full(len(n), source), target, n.astype(np.int32), graph.nodes[caller], pa.array(graph.nodes[callee], mask=callee < 0)]

    return search


def paths(edges: DataFrame, pairs: DataFrame, ignore_unknown: bool = False, most_hops: int = 10_000, most_edges: int = MOST_EDGES) -> DataFrame:
    """source, target, hop, type, caller, callsite, callee: for each pair a call path of one edge or more, as short as can be.

    It ends in the target or, unless these are ignored, in an unknown edge, which may go anywhere; of equally short ones that to the
    target counts, then the smallest caller at each step from the end, and of the edges between two functions the first by call
    site. Pairs without a path have no row. While the edges fit a task, tasks search them from their sources; else see ``paths_by_waves``.

    Defined cases: repeated pairs count once; a source that is its target needs a cycle; identifiers that no edge has, nulls
    and empty tables give no rows; patched edges (without call site) are edges like others, after those with one.
    """
    with lineage.rounds(edges.sparkSession) as cut:
        edges = cut(edges.select(*EDGE))
        asked = pairs.where("source is not null and target is not null").select(F.col("source").cast("long").alias("source"), F.col("target").cast("long").alias("target")).distinct()
        steps = _searched(edges, asked, _ways(ignore_unknown, most_hops), "source long, target long, hop int, caller long, callee long", cut, most_edges)
        if steps is None:
            return paths_by_waves(edges, pairs, ignore_unknown, most_hops)
        steps = cut(steps.select(*[F.col(c).cast((pairs if c in pairs.columns else edges if c in EDGE else steps).schema[c].dataType) for c in steps.columns]))
        if not steps.where("hop < 0").isEmpty():
            raise RuntimeError(f"paths of more than {most_hops} edges")
        first, own = first_of_pairs(edges), steps.withColumnRenamed("caller", "from").withColumnRenamed("callee", "into")
        on = (F.col("from") == F.col("caller")) & F.col("into").eqNullSafe(F.col("callee"))
        return lineage.cut(own.join(first, on).select("source", "target", "hop", *EDGE))


def paths_by_waves(edges: DataFrame, pairs: DataFrame, ignore_unknown: bool = False, most_hops: int = 10_000) -> DataFrame:
    """``paths`` by joins. Paths are read back from the waves by pointer doubling: jumps of 2^i edges are
    joined from two of half the length, and a path's edges are found by jumping from those already found, longest jumps
    first, so that a path of n edges takes about log n rounds.
    """
    spark = edges.sparkSession
    with lineage.rounds(spark) as cut, lineage.Growing(spark, "part") as table:
        edges = cut(edges.select(*EDGE))
        met = cut(waves(edges, pairs, ignore_unknown, table, most_hops))
        asked = pairs.select("source", "target").distinct()
        known = met.where("hops > 0").select("source", F.col("node").alias("target"), F.col("hops").alias("to_target"))
        ends = asked.join(known, ["source", "target"], "left")
        if ignore_unknown:
            ends = ends.withColumn("u", F.lit(None).cast("struct<hops: int, node: int>"))
        else:
            blind = met.join(edges.where("type = 'unknown'").select(F.col("caller").alias("node")).distinct(), "node", "left_semi")
            # the source's own unknown edge is met before any other, and hops 0 stands for it alone
            ends = ends.join(blind.groupBy("source").agg(F.min(F.struct("hops", "node")).alias("u")), "source", "left")
        by_target = F.col("to_target").isNotNull() & (F.col("u").isNull() | (F.col("to_target") <= F.col("u.hops") + 1))
        ends = ends.where("to_target is not null or u is not null").withColumn("blind", ~by_target)
        ends = cut(ends.select("source", "target", "blind", F.when(by_target, F.col("target")).otherwise(F.col("u.node")).alias("node"), F.when(by_target, F.col("to_target")).otherwise(F.col("u.hops")).alias("hops")))
        longest = ends.agg(F.max("hops")).first()[0] or 0
        # jumps over 2^i edges back, of every node that was met
        jump = cut(met.where("hops > 1").select("source", "node", "hops", F.col("via").alias("to"), (F.col("hops") - 1).alias("to_hops")))
        jumps = [jump] if longest > 1 else []
        while 2 ** len(jumps) < longest:
            on = jumps[-1].select("source", F.col("node").alias("to"), F.col("hops").alias("to_hops"), F.col("to").alias("far"), F.col("to_hops").alias("far_hops"))
            jumps.append(cut(jumps[-1].join(on, ["source", "to", "to_hops"]).select("source", "node", "hops", F.col("far").alias("to"), F.col("far_hops").alias("to_hops"))))
        found = ends.where("hops > 0").select("source", "target", "node", "hops")
        for jump in reversed(jumps):
            found = cut(found.unionByName(found.join(jump, ["source", "node", "hops"]).select("source", "target", F.col("to").alias("node"), F.col("to_hops").alias("hops"))))
        steps = found.join(met, ["source", "node", "hops"]).select("source", "target", F.col("hops").alias("hop"), F.col("via").alias("caller"), F.col("node").alias("callee"))
        first = first_of_pairs(edges)
        own = steps.join(first.where("callee is not null"), ["caller", "callee"]).select("source", "target", "hop", *EDGE)
        last = ends.where("blind").select("source", "target", (F.col("hops") + 1).alias("hop"), F.col("node").alias("caller")).join(first.where("callee is null"), "caller").select("source", "target", "hop", *EDGE)
        return lineage.cut(own.unionByName(last))


def path(edges: DataFrame, source: int, target: int, most_hops: int = 10_000) -> DataFrame:
    """hop, type, caller, callsite, callee of one shortest call path over known edges (see ``paths``); empty without one. More than
    ``most_hops`` edges raise."""
    pair = edges.sparkSession.createDataFrame([(source, target)], "source int, target int")
    return paths(edges, pair, True, most_hops).drop("source", "target")


def call_tree(edges: DataFrame, roots: DataFrame, depth: int = 5, silent: DataFrame | None = None) -> DataFrame:
    """root, caller, callee, depth of the call tree down to ``depth``: edges out of functions less deep than it.

    A function's depth is the fewest shown functions that lead to it: a step to a silenced function (vid) costs nothing and
    isn't shown, what it calls hangs under the shown function before it. A null callee is a call to anywhere.
    """
    quiet = (silent if silent is not None else roots.where("false")).select(F.col("vid").alias("callee"), F.lit(True).alias("quiet"))
    with lineage.rounds(edges.sparkSession) as cut:
        step = cut(edges.select("caller", "callee").distinct().join(quiet, "callee", "left").select("caller", "callee", F.coalesce("quiet", F.lit(False)).alias("quiet")))
        # (shown, node): node is reached from the shown function over silenced ones only
        at = cut(roots.select(F.col("vid").alias("root"), F.col("vid").alias("shown"), F.col("vid").alias("node"), F.lit(0).alias("depth")))
        seen, out = at, []
        level = 0
        while level < depth:
            # silenced steps to their end, within this level
            hidden = at
            while True:
                more = hidden.join(step.where("quiet"), F.col("node") == F.col("caller")).select("root", "shown", F.col("callee").alias("node"), "depth").distinct()
                more = cut(more.join(at, ["root", "shown", "node"], "left_anti"))
                if more.isEmpty():
                    break
                at, hidden = at.unionByName(more), more
            shown = cut(at.join(step.where("not quiet"), F.col("node") == F.col("caller")).select("root", F.col("shown").alias("caller"), "callee", (F.col("depth") + 1).alias("depth")).distinct())
            out.append(shown)
            level += 1
            new = shown.where("callee is not null").select("root", F.col("callee").alias("shown"), F.col("callee").alias("node"), "depth").distinct()
            new = cut(new.join(seen.select("root", "shown"), ["root", "shown"], "left_anti"))
            if new.isEmpty():
                break
            seen, at = seen.unionByName(new), new
        return lineage.cut(reduce(DataFrame.unionByName, out)) if out else edges.selectExpr("caller as root", "caller", "callee", "0 as depth").where("false")


def indirect_targets(edges: DataFrame, names: DataFrame) -> DataFrame:
    """callsite, n_targets, targets: the names (vid, name) of what each indirect call site may call, joined by commas."""
    own = edges.where("type = 'indirect' and callsite is not null").join(names, F.col("callee") == F.col("vid"))
    return own.groupBy("callsite").agg(F.count(F.lit(1)).alias("n_targets"), F.concat_ws(",", F.array_sort(F.collect_list("name"))).alias("targets"))


def statistics(edges: DataFrame) -> DataFrame:
    """One row: edges by type, call sites, callers, and targets of indirect call sites."""
    return edges.agg(
        F.count_if(F.col("type") == "direct").alias("n_direct"), F.count_if(F.col("type") == "indirect").alias("n_indirect"), F.count_if(F.col("type") == "unknown").alias("n_unknown"),
        F.countDistinct("callsite").alias("n_sites"), F.countDistinct("caller").alias("n_callers"), F.countDistinct("callee").alias("n_callees"),
    )


def in_order(edges: DataFrame) -> DataFrame:
    """Edges with their place among their caller's: by call site, patched ones last."""
    return edges.withColumn("place", F.row_number().over(Window.partitionBy("caller").orderBy(F.col("callsite").asc_nulls_last(), F.col("callee").asc_nulls_last())))
