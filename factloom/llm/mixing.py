"""Mixing sources to target weights by the cube method.

A source of size S with target T takes every row T div S times and once more with the inclusion probability that is
left. The cube method draws those extra copies at random with exact balance on two totals, tokens and rows: the flight
phase moves the vector of probabilities along directions in the null space of the balancing constraints until a
coordinate hits 0 or 1, and again, until no more coordinates are left than there are constraints.

On Spark the flight runs in groups of at most about ``group_rows`` rows of one source, dealt by a hash, so a source with
a third of all rows is many groups; each group ends with two undecided rows at most and exact totals. What is left of
the groups flies again in the next round, until a source is one group: the landing problem, a
dozen rows of each source, settled by trying every rounding.

Sizes and sources alone are shuffled, never texts. Defined cases: a null or empty text has size 0 and is taken like the
others (it only counts as a row); a null source is a source of its own and the last; the probabilities depend on a hash
of (seed, doc_id, text) and on values only, so reruns agree, and rows that are equal in all of these are interchangeable; a
source of size 0 has target 0 and takes nothing; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import cut, n_words, packed_others, unpacked

WEIGHTS = (5, 2, 1)


def targets(sizes: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, source_size, n_rows, target, of rows (source, size).

    Each source's cap is ``cap`` times its size, so with w the weights the target is min(cap, level * w); the level
    follows from sorting by cap / w. The windows run over one row per source.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    names = F.array(*[F.lit(float(w)) for w in weights])
    one = Window.orderBy("_ratio", F.col("source").asc_nulls_last())
    before = one.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    ranked = totals.withColumn("_w", F.element_at(names, (F.row_number().over(order) - 1) % len(weights) + 1)).withColumn("_cap", F.col("source_size") * F.lit(cap)).withColumn("_ratio", F.col("_cap") / F.col("_w"))
    level = (F.sum("source_size").over(every) * F.lit(share) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / (F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
    # the first source, by ratio, that the level of it and all later ones does not fill fixes the level
    first = F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_k", "_level"))).over(every)
    leveled = ranked.withColumn("_level", level).withColumn("_k", F.row_number().over(one)).withColumn("_at", first["_level"])
    return leveled.select("source", "source_size", "n_rows", F.when(F.col("_at").isNull() | (F.col("_ratio") <= F.col("_at")), F.col("_cap")).otherwise(F.col("_at") * F.col("_w")).alias("target"))


def flight(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Moves ``p`` to 0 and 1 keeping sum(p * size) and sum(p), until two entries at most are between.

    Three undecided rows are held at a time. For the constraints (size, 1) their null vector is the cross product
    (s1 - s2, s2 - s0, s0 - s1); where the sizes are equal, (1, -1, 0) is one. The step's length and sign come from a
    hash-seeded draw made by the caller's order, so that the move is a martingale.
    """
    p, out = p.astype(float).copy(), None
    draw = np.random.default_rng(len(p) * 1_000_003 + int(size.sum()) % 1_000_003)
    held: list[int] = []
    for i in range(len(p)):
        if not 1e-9 < p[i] < 1 - 1e-9:
            p[i] = round(p[i])
            continue
        held.append(i)
        while len(held) == 3:
            a, b, c = held
            u = [float(size[b] - size[c]), float(size[c] - size[a]), float(size[a] - size[b])]
            if not any(u):
                u = [1.0, -1.0, 0.0]
            up = min((1 - p[k]) / x if x > 0 else p[k] / -x for k, x in zip(held, u, strict=True) if x)
            down = min(p[k] / x if x > 0 else (1 - p[k]) / -x for k, x in zip(held, u, strict=True) if x)
            step = up if draw.random() < down / (up + down) else -down
            for k, x in zip(held, u, strict=True):
                p[k] += step * x
                if not 1e-9 < p[k] < 1 - 1e-9:
                    p[k] = round(p[k])
            held = [k for k in held if 0 < p[k] < 1]
    return p


def _ordered(group: pd.DataFrame) -> pd.DataFrame:
    """Large rows first: those that stay undecided to the end, and are rounded, are then small."""
    return group.sort_values(["size", "_order", "doc_id"], ascending=[False, True, True], kind="stable", na_position="last").reset_index(drop=True)


def _fly(group: pd.DataFrame) -> pd.DataFrame:
    group = _ordered(group)
    group["_p"] = flight(group["_p"].to_numpy(), group["size"].to_numpy())
    return group


def _land(group: pd.DataFrame, held_back: int = 12) -> pd.DataFrame:
    """The flight of a source's last rows but ``held_back`` of them, evenly spaced by size; the landing problem is these
    and the two rows that the flight leaves, and every choice of 0s and 1s for them is tried: the one whose tokens, and
    then whose rows, come nearest to what the probabilities promise is taken."""
    group = _ordered(group)
    p, size = group["_p"].to_numpy().astype(float), group["size"].to_numpy()
    undecided = np.flatnonzero((p > 0) & (p < 1))
    back = undecided[np.unique(np.linspace(0, len(undecided) - 1, min(held_back, len(undecided))).astype(int))] if len(undecided) else undecided
    promised, rows = (p[undecided] * size[undecided]).sum(), p[undecided].sum()
    flown = np.setdiff1d(undecided, back)
    p[flown] = flight(p[flown], size[flown])
    left = np.r_[flown[(p[flown] > 0) & (p[flown] < 1)], back].astype(int)
    if len(left):
        choices = (np.arange(1 << len(left))[:, None] >> np.arange(len(left))) & 1
        sure = flown[p[flown] == 1]
        far = np.abs(choices @ size[left] + size[sure].sum() - promised) + 0.1 * size[undecided].mean() * np.abs(choices.sum(axis=1) + len(sure) - rows)
        p[left] = choices[int(np.argmin(far))]
    group["_p"] = p
    return group


def cube_mix(docs: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = WEIGHTS, seed: int = 7, group_rows: int = 2000) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken (= copies * size) of every row of ``docs``."""
    sizes = docs.select("doc_id", "source", F.xxhash64("text").alias("_digest"), n_words().alias("size"))
    aims = cut(targets(sizes, share, cap, weights))  # one row per source, and each later step starts from it
    rows = sizes.join(aims, sizes["source"].eqNullSafe(aims["source"]), "left").select(sizes["*"], "source_size", "n_rows", "target")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = cut(rows.withColumn("_whole", F.floor(rate)).withColumn("_p", rate - F.floor(rate)).withColumn("_order", F.xxhash64(F.lit(seed), "doc_id", "_digest")))
    done = []
    widest = aims.agg(F.max("n_rows")).first()[0] or 0
    while True:
        last = widest <= group_rows
        parts = F.lit(1) if last else F.ceil(F.col("n_rows") / F.lit(group_rows))
        keyed = rows.withColumn("_part", F.pmod(F.xxhash64("_order", F.lit(widest)), parts))
        flown = keyed.groupBy("source", "_part").applyInPandas((lambda g: _land(g)) if last else _fly, keyed.schema).drop("_part")
        if last:
            done.append(flown)
            break
        flown = cut(flown)
        open_rows = (F.col("_p") > 0) & (F.col("_p") < 1)
        done.append(flown.where(~open_rows))
        # what is left of a group is two rows at most
        rows = flown.where(open_rows).withColumn("n_rows", F.ceil(F.col("n_rows") / F.lit(group_rows)) * 2)
        widest = rows.agg(F.max("n_rows")).first()[0] or 0
    out = done[0].select(*RESULT)
    for d in done[1:]:
        out = out.unionByName(d.select(*RESULT))
    copies = (F.col("_whole") + F.col("_p").cast("long")).cast("long")
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), "_digest")


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with the columns of ``docs``.

    A row is known by doc_id, source and a hash of its text; of rows that share all three it makes no difference which one a
    number of copies belongs to, but each number goes to one row.
    """
    key = ["_doc", "_source", "_text"]
    taken = cube_mix(docs, **how).select(F.col("doc_id").alias("_doc"), F.col("source").alias("_source"), F.col("_digest").alias("_text"), "copies")
    taken = taken.groupBy(*key).agg(F.sort_array(F.collect_list("copies"), asc=False).alias("_copies"))
    rows = packed_others(docs, "doc_id", "source", "text").withColumn("_digest", F.xxhash64("text"))
    own = rows.join(taken, F.col("doc_id").eqNullSafe(F.col("_doc")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("_digest") == F.col("_text")))
    alone = own.where(F.size("_copies") == 1).withColumn("_n", F.element_at("_copies", 1))
    several = own.where(F.size("_copies") > 1).withColumn("_at", F.row_number().over(Window.partitionBy(*key).orderBy(F.xxhash64("_others")))).withColumn("_n", F.element_at("_copies", F.col("_at"))).drop("_at")
    out = alone.unionByName(several).where("_n > 0")
    return unpacked(out.withColumn("_turn", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int")))), docs.columns)


RESULT = ["doc_id", "source", "size", "source_size", "target", "_whole", "_p", "_digest"]


def op1_cube_mixing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return cube_mix(docs).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")
