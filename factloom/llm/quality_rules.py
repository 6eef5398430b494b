"""Quality rules: statistics of whole texts, and a decision list learned from labelled ones, in DataFrame functions only.

Sequential covering: a rule is grown from the rows that no earlier rule covers by adding, one at a time, the threshold
condition with the largest information gain, then pruned back on rows held out from growing; rules that hold up are kept
in order, and the list is emitted as one ordered Spark conditional (``when ... when ... otherwise``). Each growing step
is one aggregation of the labelled rows into counts by feature and bin; only these counts reach the driver.

The list is fitted on at most ``max_labelled`` labelled rows (those with the smallest hash of doc_id), a documented bound;
the statistics and the verdict cover every row and the whole text.

Defined cases: a null or empty text has no words and every count 0, so it fails the base rule; a document labelled more
than once counts once with its smallest label; null labels are ignored; without labels of both kinds the list is empty
and keeps all that pass the base rule; repeated doc_ids each get a row; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import SPACES, cut

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Every feature is a ratio of statistics, so that it does not depend on how long a text is, but for n_words.
FEATURES = {
    "n_words": "double(n_words)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbol_ratio": "n_symbols / greatest(word_chars, 1)",
    "dup_line_ratio": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_ratio": "n_repeat_words / greatest(n_words, 1)",
    "upper_ratio": "n_upper / greatest(word_chars, 1)",
    "bang_ratio": "n_bang / greatest(word_chars, 1)",
    "line_words": "n_words / greatest(n_lines, 1)",
}


def _removed(pattern: str) -> Column:
    """How many characters of the text match, each match being one character."""
    return (F.length("_t") - F.length(F.regexp_replace("_t", pattern, ""))).cast("long")


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics. Arrays stay inside their row; nothing is shuffled.

    A 3-word window is compared by a 64-bit hash. Only texts where a hash repeats go on to find where: windows sorted by
    (hash, position), those equal to a neighbour, and the words that these cover (a window adds as many words as it
    starts after the one before, three at most).
    """
    t = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_t"))
    t = t.withColumn("_w", F.array_remove(F.split("_t", SPACES), "")).withColumn("_l", F.filter(F.split("_t", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")))
    t = t.select(
        "doc_id", "_w", F.size("_w").cast("long").alias("n_words"), F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        _removed("[#*$%&|<>]").alias("n_symbols"), (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.size("_l").cast("long").alias("n_lines"), _removed("[A-Z]").alias("n_upper"), _removed("!").alias("n_bang"),
    )
    t = t.withColumn("_h", F.transform("_w", lambda w, i: F.xxhash64(w, F.get("_w", i + 1), F.get("_w", i + 2)))).withColumn("_h", F.slice("_h", 1, F.greatest(F.size("_h") - 2, F.lit(0))))
    t = t.drop("_w").withColumn("_r", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    t = t.drop("_h").withColumn("_p", F.sort_array(F.filter(F.transform("_r", lambda x, i: F.when((x["h"] == F.get("_r", i + 1)["h"]) | (x["h"] == F.get("_r", i - 1)["h"]), x["i"])), lambda i: i.isNotNull())))
    covered = F.aggregate(F.transform("_p", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("_p", i + 1) - p, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    return t.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_r", "_p")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = F.expr(FEATURES[self.feature])
        return value >= self.threshold if self.above else value < self.threshold


Rule = tuple[Condition, ...]


def conjunction(rule: Rule) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & c.column()
    return out


def verdict(rules: list[Rule]) -> Column:
    """The list as one ordered conditional: the first rule that holds rejects; else the row is kept."""
    out = None
    for rule in rules:
        out = F.when(conjunction(rule), False) if out is None else out.when(conjunction(rule), False)
    return F.lit(True) if out is None else out.otherwise(True)


def _gain(p: float, n: float, p0: float, n0: float) -> float:
    return p * (math.log2((p + 1e-9) / (p + n + 1e-9)) - math.log2((p0 + 1e-9) / (p0 + n0 + 1e-9))) if p else 0.0


def _reached(edges: list[float], value: Column) -> Column:
    return F.size(F.filter(F.array(*[F.lit(float(x)) for x in edges]), lambda x: x <= value))


def learn(labelled: DataFrame, max_rules: int = 8, max_conditions: int = 4, bins: int = 32, least_precision: float = 0.8, least_covered: int = 5) -> list[Rule]:
    """Rules that reject, learned from rows with the statistics, ``bad`` (boolean) and ``grow`` (boolean)."""
    names = list(FEATURES)
    cuts = labelled.agg(*[F.percentile_approx(F.expr(FEATURES[f]), [k / bins for k in range(1, bins)], 1000).alias(f) for f in names]).first()
    if cuts is None or cuts[names[0]] is None:
        return []
    edges = {f: sorted(set(cuts[f])) for f in names}
    binned = [_reached(edges[f], F.expr(FEATURES[f])) for f in names]
    # which bin a value is in: how many edges it reaches; so "bin > k" says value >= edges[k]
    rows = cut(labelled.withColumn("_b", F.array(*binned)))
    score = lambda rule, over: over.where(conjunction(rule)).agg(F.coalesce(F.sum(F.col("bad").cast("int")), F.lit(0)), F.count(F.lit(1))).first()
    rules: list[Rule] = []
    while len(rules) < max_rules:
        left = rows.where(verdict(rules))
        rule: Rule = ()
        while len(rule) < max_conditions:
            counted = left.where(F.col("grow") & conjunction(rule)).select(F.posexplode("_b").alias("f", "b"), "bad").groupBy("f", "b").agg(F.sum(F.col("bad").cast("int")).alias("p"), F.count(F.lit(1)).alias("n")).collect()
            best, most = None, 1e-6
            for k, f in enumerate(names):
                by_bin = {r["b"]: (r["p"], r["n"] - r["p"]) for r in counted if r["f"] == k}
                p0, n0 = sum(p for p, _ in by_bin.values()), sum(n for _, n in by_bin.values())
                for j, edge in enumerate(edges[f]):
                    p = sum(v[0] for b, v in by_bin.items() if b > j)
                    n = sum(v[1] for b, v in by_bin.items() if b > j)
                    for c, pc, nc in ((Condition(f, True, float(edge)), p, n), (Condition(f, False, float(edge)), p0 - p, n0 - n)):
                        if pc >= least_covered and (g := _gain(pc, nc, p0, n0)) > most:
                            best, most = (c, nc), g
            if best is None:
                break
            rule = (*rule, best[0])
            if best[1] == 0:
                break
        if not rule:
            break
        # prune: of the rule's beginnings the one that is worth most on the rows held out
        held = left.where(~F.col("grow"))
        worth = []
        for k in range(1, len(rule) + 1):
            p, n = score(rule[:k], held)
            worth.append(((2 * p - n) / max(n, 1), -k, p / max(n, 1), n))
        value, k, precision, covered = max(worth)
        if not covered or precision < least_precision:
            break
        rules.append(rule[:-k])
    return rules


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000) -> list[Rule]:
    """Quality 0 is what the rules reject. At most ``max_labelled`` labels are read, so their list may be broadcast."""
    chosen = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("_q")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    own = docs.select("doc_id", "text").join(F.broadcast(cut(chosen)), "doc_id")
    quality = own.select("doc_id", "_q").distinct()
    labelled = statistics(own).dropDuplicates(["doc_id"]).join(quality, "doc_id").withColumn("bad", F.col("_q") == 0).withColumn("grow", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(3)) > 0)
    return learn(cut(labelled))


def quality_rules(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000) -> DataFrame:
    rules = fit(docs, labels, max_labelled)
    out = statistics(docs).withColumn("base_failed", base_failed())
    return out.withColumn("kept", ~F.col("base_failed") & verdict(rules))


def op8_quality_rules(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return quality_rules(docs, labels).select("doc_id", *BASE, "base_failed", "kept")
