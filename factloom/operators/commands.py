"""One-line queries answered in batch: a table of query lines is parsed by Column expressions and answered by joins.

``callout F [i]``, ``callin F``, ``pts V``, ``pt P O``, ``alias A B`` and ``list PREFIX`` (and the short forms ``a``, ``l``) are
what many users ask at once; each kind is one join of its queries with the facts, whatever their number.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.names import bare, strict_int
from factloom.functions.render import edge_text
from factloom.operators import callgraph, pointsto
from factloom.operators.lineage import cut

#: Commands with their least and greatest number of arguments, and short forms.
COMMANDS = {"callout": (1, 2), "callin": (1, 1), "pts": (1, 1), "pt": (2, 2), "alias": (2, 2), "list": (1, 1)}
SHORT = {"a": "alias", "l": "list"}


def parse(lines: DataFrame) -> DataFrame:
    """qid, command, x, y, prefix, ignore, problem of rows (qid, line); blank lines are left out."""
    words = F.split(F.trim(F.regexp_replace("line", r"[ \t\r\n]+", " ")), " ")
    short = F.create_map(*[F.lit(v) for kv in SHORT.items() for v in kv])
    own = lines.select("qid", words.alias("w")).where(F.element_at("w", 1) != "").withColumn("c", F.coalesce(short[F.element_at("w", 1)], F.element_at("w", 1)))
    n = F.size("w") - 1
    known = F.col("c").isin(*COMMANDS)
    fits = reduce(lambda a, c: a | ((F.col("c") == c) & n.between(*COMMANDS[c])), COMMANDS, F.lit(False))
    x, y = strict_int(F.get("w", F.lit(1))), strict_int(F.get("w", F.lit(2)))
    flag = (F.col("c") == "callout") & (F.get("w", F.lit(2)) == "i")
    numbers = F.when(F.col("c") == "list", True).when(F.col("c").isin("pt", "alias"), x.isNotNull() & y.isNotNull()).otherwise(x.isNotNull() & ((n < 2) | flag))
    problem = F.when(~known, F.concat(F.lit("syntax: unknown command "), F.col("c"))).when(~fits, F.lit("syntax: wrong number of arguments")).when(~numbers, F.lit("syntax: not a number"))
    return own.select("qid", F.col("c").alias("command"), x.alias("x"), y.alias("y"), bare(F.get("w", F.lit(1))).alias("prefix"), F.coalesce(flag, F.lit(False)).alias("ignore"), problem.alias("problem"))


def answer(lines: DataFrame, edges: DataFrame, pts: DataFrame, status: DataFrame, index: DataFrame) -> DataFrame:
    """qid, line: the lines of each query's answer; a query without any has no row, one with a problem has it as its line."""
    asked = cut(parse(lines))  # once for all kinds; put into each kind's filter, its code would outgrow what Java compiles
    good = asked.where("problem is null")
    of = lambda c: good.where(F.col("command") == c)
    out = [asked.where("problem is not null").select("qid", F.col("problem").alias("line"))]
    full, once = edges, callgraph.first_of_pairs(edges)
    for some, source, site in ((of("callout").where("not ignore"), full, True), (of("callout").where("ignore"), once, False)):
        out.append(some.join(source, F.col("x") == F.col("caller")).select("qid", edge_text(caller=False, callsite=site).alias("line")))
    out.append(of("callin").join(full, F.col("x") == F.col("callee")).select("qid", edge_text(callee=False).alias("line")))
    blind = status.withColumnRenamed("ptr", "x")
    own = of("pts").join(blind, "x", "left")
    out.append(own.where("not coalesce(known, false)").select("qid", F.lit("unknown").alias("line")))
    out.append(own.where("known").join(pts, F.col("x") == F.col("ptr")).select("qid", F.col("site").cast("string").alias("line")))
    two = of("pt").select("qid", F.col("x").alias("ptr"), F.col("y").alias("site"))
    out.append(two.join(pointsto.pt(two.select("ptr", "site").distinct(), pts, status), ["ptr", "site"]).select("qid", F.col("result").alias("line")))
    two = of("alias").select("qid", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    out.append(two.join(pointsto.alias(two.select("a", "b").distinct(), pts, status), ["a", "b"]).select("qid", F.col("result").alias("line")))
    # prefixes: an equi-join on a name's beginnings, of the lengths that are asked for only, so that names which begin alike
    # don't meet in one key
    some = of("list").select("qid", "prefix")
    lengths = some.agg(F.sort_array(F.collect_set(F.length("prefix"))).alias("lengths"))  # one row, an entry a length
    starts = index.join(F.broadcast(lengths)).withColumn("n", F.explode(F.filter("lengths", lambda n: n <= F.length("name"))))
    hits = starts.withColumn("prefix", F.expr("substring(name, 1, n)")).select("name", "vid", "prefix").join(some, "prefix")
    out.append(hits.groupBy("qid", "vid").agg(F.min("name").alias("name")).select("qid", F.concat_ws(" ", F.col("vid").cast("string"), "name").alias("line")))
    return reduce(DataFrame.unionByName, out)
