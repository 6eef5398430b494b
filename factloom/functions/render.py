"""Text forms of rows, as Column expressions: the DataFrames are the results, these are for reading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def value_text(detailed: bool = True) -> Column:
    """A row of ``value``: its id, and with ``detailed`` its name or where it stands."""
    vid = F.col("vid").cast("string")
    if not detailed:
        return vid
    place = F.when(F.col("kind") == "Inst", F.concat(F.lit("inst of "), F.col("func_vid"))).when(F.col("kind") == "Block", F.concat(F.lit("block of "), F.col("func_vid"))).when(F.col("kind") == "Arg", F.col("func_vid").cast("string"))
    return F.concat_ws(" ", vid, F.coalesce(place, F.col("name")))


def edge_text(caller: bool = True, callee: bool = True, callsite: bool = True) -> Column:
    """``direct FROM 1 TO 2 BY 3``: a row of ``call_edge``, any part of it left out."""
    parts = [F.col("type")]
    if caller:
        parts += [F.lit("FROM"), F.col("caller").cast("string")]
    if callee:
        parts += [F.lit("TO"), F.when(F.col("type") == "unknown", "UNKNOWN").otherwise(F.col("callee").cast("string"))]
    if callsite:
        parts += [F.lit("BY"), F.coalesce(F.col("callsite").cast("string"), F.lit("-"))]
    return F.concat_ws(" ", *parts)


def key_values(one_row: DataFrame) -> DataFrame:
    """ord, line: ``key: value`` for each column of a row."""
    columns = one_row.columns
    pairs = F.array(*[F.struct(F.lit(k).alias("ord"), F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit(""))).alias("line")) for k, c in enumerate(columns)])
    return one_row.select(F.explode(pairs).alias("x")).select("x.ord", "x.line")


def dot(edges: DataFrame, of: str, source: str, target: str) -> DataFrame:
    """The column ``of`` and value: one graph text for each of its values, of its edges from ``source`` to ``target``.

    A null target is left out. Written with ``partitionBy(of)``, each is a file of its own.
    """
    line = F.concat(F.lit('  "'), F.col(source).cast("string"), F.lit('" -> "'), F.col(target).cast("string"), F.lit('";'))
    return edges.groupBy(of).agg(F.concat_ws("\n", F.concat(F.lit('digraph "'), F.col(of).cast("string"), F.lit('" {')), F.array_sort(F.collect_set(line)), F.lit("}")).alias("value"))


def framed(answers: DataFrame) -> DataFrame:
    """qid, value: the lines (qid, line) of each query's answer between the marks that readers of a stream look for."""
    return answers.groupBy("qid").agg(F.concat_ws("\n", F.lit("<queryresult>"), F.array_sort(F.collect_list("line")), F.lit("</queryresult>")).alias("value"))


def tree_lines(edges: DataFrame, root: int) -> list[str]:
    """A bounded call tree (caller, callee; null callee: unknown) of one root as indented lines.

    The tree of one root and depth is small by its bound; it is the only thing brought to the driver. Children go by id.
    """
    children: dict[int, list] = {}
    for r in edges.where(F.col("root") == root).orderBy("caller", F.col("callee").asc_nulls_last()).select("caller", "callee").distinct().collect():
        children.setdefault(r["caller"], []).append(r["callee"])
    lines, seen = [], set()
    todo = [(root, "", "", ())]
    while todo:
        node, lead, below, above = todo.pop()
        if node is None:
            lines.append(f"{lead}call to UNKNOWN")
            continue
        mark = " (recursive)" if node in above else " (visited)" if node in seen else ""
        lines.append(f"{lead}{node}{mark}")
        if not mark:
            seen.add(node)
            own = sorted(children.get(node, []), key=lambda x: (x is None, x))
            for k, child in reversed(list(enumerate(own))):
                last = k == len(own) - 1
                todo.append((child, below + ("└ " if last else "├ "), below + ("  " if last else "│ "), (*above, node)))
    return lines
