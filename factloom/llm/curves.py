"""Nearest vectors by inner product: shifted space-filling curves.

Vectors are lifted onto a sphere by one more coordinate, sqrt(M^2 - |x|^2) with M the largest length (a query, whose length
doesn't matter, gets 0): there, the largest inner product is the smallest distance, and the rows of long vectors are no special
case. Several times over, the lifted vectors are projected on four directions of their own, shifted, and ordered by a Hilbert
curve. Splitters from a sample cut each ordering into blocks of like size; a row lies in one block of each ordering, a query
looks into its own block and ``reach`` blocks to either side, and what the orderings give is merged by the exact inner product.

``reach`` is measured, not guessed: for a bounded set of queries (``calibration``) the true neighbours are found by comparing
them with every row, and the least reach that finds ``target`` of them is taken for all queries. So recall doesn't depend on
the data: where neighbourhoods are tight a window of three blocks does; where vectors have no structure at all windows grow until
they do. Every row is in the index and no block, list or window has a cap.

Memory and skew: equal vectors are one class with the k + 1 smallest of its identifiers, which is all that any answer can hold of
them, as ties go to the smaller identifier; a class that a third of all rows share is one row of the index, gathered in two steps
of at most k + 1 rows a group. Rows of a block are dealt to parts of ``block_rows`` and the queries that look into it to parts of
``block_queries``; a task compares a part with a part in slices of bounded size.

Defined cases: vectors that are null, empty, zero, hold a null or non-finite entry, are longer than doubles can square, or haven't
the most frequent length take no part, and neither does a row without an identifier; of rows with one identifier the smallest
vector counts; with fewer than k others all are returned; one row alone has no neighbours; an empty table gives an empty result;
columns besides vec_id and embedding are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import mix, settle
from factloom.llm.vectors import finite, list_array, matrix

DIMENSIONS, BITS, TIE_BITS = 4, 12, 15


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place of each cell (a row of coordinates below 2^bits) on the Hilbert curve, by Skilling's transposition of coordinates."""
    x = [cells[:, i].astype(np.int64) for i in range(cells.shape[1])]
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        for i in range(len(x)):
            on, swap = (x[i] & q) > 0, (x[0] ^ x[i]) & (q - 1)
            x[i], x[0] = np.where(on, x[i], x[i] ^ swap), np.where(on, x[0] ^ (q - 1), x[0] ^ swap)
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    flip = np.zeros_like(x[0])
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        flip = np.where((x[-1] & q) > 0, flip ^ (q - 1), flip)
    key = np.zeros_like(flip)
    for b in range(bits - 1, -1, -1):
        for c in x:
            key = (key << 1) | (((c ^ flip) >> b) & 1)
    return key


@dataclass
class Curves:
    """The orderings: a projection and a shift each, made by rule from ``seed``."""

    dimension: int
    longest: float
    count: int = 8
    seed: int = 11

    def __post_init__(self):
        rng = np.random.default_rng(self.seed)
        width = min(DIMENSIONS, self.dimension + 1)
        self.turns = [np.linalg.qr(rng.normal(size=(self.dimension + 1, width)))[0] for _ in range(self.count)]
        self.shifts = [rng.random(width) / 2 for _ in range(self.count)]

    def keys(self, v: np.ndarray, ids: np.ndarray, query: bool = False) -> np.ndarray:
        """A column of keys for each ordering; equal places are spread by a hash of the identifier, so that blocks stay even."""
        size = np.linalg.norm(v, axis=1)
        lifted = np.c_[v / self.longest, np.sqrt(np.maximum(0, 1 - (size / self.longest) ** 2))] if not query else np.c_[v / size[:, None], np.zeros(len(v))]
        tie = (mix(ids.astype(np.uint64)) >> np.uint64(64 - TIE_BITS)).astype(np.int64)
        places = [np.clip((((lifted @ w + 1) / 4 + s) * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1) for w, s in zip(self.turns, self.shifts, strict=True)]
        return np.stack([(hilbert(p) << TIE_BITS) | tie for p in places], axis=1)


def usable(vectors: DataFrame) -> tuple[DataFrame, int, float]:
    """Rows (vec_id, v) that take part, one an identifier, written once; their length and the longest vector's norm."""
    v = F.transform("embedding", lambda c: c.cast("double"))
    rows = vectors.where(F.col("vec_id").isNotNull() & finite(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    squares = F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c)
    rows = rows.withColumn("squares", squares).where((F.col("squares") > 0) & (F.col("squares") < float("inf")))
    rows = settle(rows.groupBy("vec_id").agg(F.min(F.struct("v", "squares")).alias("r")).select("vec_id", "r.v", "r.squares"))
    best = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max("squares").alias("most")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    d, most = (best[0]["d"], best[0]["most"]) if best else (0, 0.0)
    return rows.where(F.size("v") == d).select("vec_id", "v"), d, float(np.sqrt(most))


def classes(rows: DataFrame, k: int, salts: int = 64) -> DataFrame:
    """A row for each different vector: v and the k + 1 smallest identifiers that have it, ascending.

    A first step keeps k + 1 rows of each salted part (Spark drops most of them before the shuffle already), so that a group
    of the second has at most salts * (k + 1).
    """
    few = rows.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(salts)))
    for part in (["v", "salt"], ["v"]):
        few = few.withColumn("nth", F.row_number().over(Window.partitionBy(*part).orderBy("vec_id"))).where(F.col("nth") <= k + 1)
    return few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def placed(groups: DataFrame, curves: Curves) -> DataFrame:
    """Classes with their keys, written once."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                first = b.column("ids").flatten().to_numpy()[np.r_[0, np.cumsum(pc.list_value_length(b.column("ids")).to_numpy())[:-1]]]
                yield pa.RecordBatch.from_arrays([pa.array(first), b.column("ids"), b.column("v"), list_array(curves.keys(matrix(b.column("v")), first))], ["first", "ids", "v", "keys"])

    return settle(groups.mapInArrow(run, "first long, ids array<long>, v array<double>, keys array<long>"))


def splitters(index: DataFrame, n: int, blocks: int) -> list[np.ndarray]:
    """Where each ordering's blocks begin, from a sample of 20,000 rows or 32 a block, by a hash (all rows where there are fewer)."""
    want = max(20_000, 32 * blocks)
    some = index.where(F.pmod(F.xxhash64("first"), F.lit(max(1, n // want))) == 0).select("keys").collect()
    keys = np.sort(np.array([r["keys"] for r in some], np.int64), axis=0)
    at = (np.arange(1, blocks) * len(keys)) // blocks
    return [keys[at, c] for c in range(keys.shape[1])]


HITS = "array<struct<s: double, vec_id: long>>"


def _packed(owner: np.ndarray, score: np.ndarray, ids: np.ndarray, n: int, keys: np.ndarray | None = None) -> pa.Array:
    """Lists of hits by owner, which is sorted."""
    fields = {"s": pa.array(-score), "vec_id": pa.array(ids)} | ({} if keys is None else {"keys": list_array(keys)})
    return pa.ListArray.from_arrays(np.searchsorted(owner, np.arange(n + 1)).astype(np.int32), pa.StructArray.from_arrays(list(fields.values()), list(fields)))


def best_of(q: np.ndarray, own: np.ndarray, x: np.ndarray, first: np.ndarray, ids: np.ndarray, k: int, most: int = 1 << 21) -> tuple[np.ndarray, ...]:
    """The k best identifiers of classes for each query: its row, the score, the identifier, the class. ``ids`` are all classes'
    identifiers one behind the other, those of class i from ``first[i]`` on. Scores come from the products of a pair summed in one
    order, whatever else is in the task; the matrix product only says which pairs are worth it."""
    out = []
    lengths, scale = np.diff(first), np.linalg.norm(x, axis=1).max() if len(x) else 0.0

    def some(lo: int, hi: int) -> None:
        s = q[lo:hi] @ x.T
        if s.shape[1] > k + 1:
            least = np.partition(s, s.shape[1] - k - 1, axis=1)[:, s.shape[1] - k - 1] - 1e-13 * scale * np.linalg.norm(q[lo:hi], axis=1)
            row, c = np.nonzero(s >= least[:, None])
        else:
            row, c = (a.ravel() for a in np.indices(s.shape))
        if len(row) > most >> 4 and hi - lo > 1:  # many ties: fewer queries at once
            some(lo, (lo + hi) // 2)
            return some((lo + hi) // 2, hi)
        score = np.concatenate([np.zeros(0)] + [(q[lo + row[i : i + 65536]] * x[c[i : i + 65536]]).sum(1) for i in range(0, len(row), 65536)])
        n = lengths[c]
        member = np.repeat(first[c] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        row, score, c, vec = np.repeat(row, n) + lo, np.repeat(score, n), np.repeat(c, n), ids[member]
        other = vec != own[row]
        row, score, c, vec = row[other], score[other], c[other], vec[other]
        order = np.lexsort((vec, -score, row))
        row, score, c, vec = row[order], score[order], c[order], vec[order]
        near = np.arange(len(row)) - np.searchsorted(row, row) < k
        out.append((row[near], score[near], vec[near], c[near]))

    step = max(1, most // max(1, len(x)))
    for lo in range(0, len(q), step):
        some(lo, min(len(q), lo + step))
    return tuple(np.concatenate(z) for z in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))


def merged(hits: DataFrame, k: int, *key: str, copies: int = 1) -> DataFrame:
    """The k best of all lists of hits of a key, which hold a hit ``copies`` times at most: the first k * copies hold the k best."""
    best = F.slice(F.sort_array(F.flatten(F.collect_list("hits"))), 1, k * copies)
    return hits.groupBy(*key).agg(F.slice(F.array_distinct(best) if copies > 1 else best, 1, k).alias("hits"))


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where the lists of a column begin (the end last) and all their values."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.r_[0, np.cumsum(pc.list_value_length(column).to_numpy())].astype(np.int64), column.flatten().to_numpy()


def true_neighbours(index: DataFrame, q: np.ndarray, own: np.ndarray, k: int) -> list[tuple[int, list]]:
    """For each of a few queries its k nearest of all rows, with their keys: one pass over the index."""

    def run(batches):
        kept = None
        for i, b in enumerate(batches):
            if not b.num_rows:
                continue
            first, ids = _lists(b.column("ids"))
            row, score, vec, c = best_of(q, own, matrix(b.column("v")), first, ids, k)
            new = (row, score, vec, matrix(b.column("keys"), np.int64)[c])
            row, score, vec, keys = new if kept is None else (np.concatenate(z) for z in zip(kept, new, strict=True))
            order = np.lexsort((vec, -score, row))
            row, score, vec, keys = row[order], score[order], vec[order], keys[order]
            near = np.arange(len(row)) - np.searchsorted(row, row) < k
            kept = row[near], score[near], vec[near], keys[near]
        if kept is not None:
            row, score, vec, keys = kept
            part = pa.array(np.full(len(q), hash(tuple(keys[0])) % 64 if len(keys) else 0))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(q))), part, _packed(row, score, vec, len(q), keys)], ["q", "part", "hits"])

    hits = index.mapInArrow(run, "q long, part long, hits array<struct<s: double, vec_id: long, keys: array<long>>>")
    return [(r["q"], r["hits"]) for r in merged(merged(hits, k, "q", "part"), k, "q").collect()]


def needed_reach(index: DataFrame, queries: DataFrame, curves: Curves, bounds: list[np.ndarray], k: int, target: float, calibration: int) -> int:
    """The least reach that finds ``target`` of the true neighbours of the calibration queries (those with the least hashes)."""
    some = queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(calibration).collect()
    q, own = np.array([r["v"] for r in some]), np.array([r["vec_id"] for r in some], np.int64)
    keys = curves.keys(q, own, query=True)
    here = np.stack([np.searchsorted(b, keys[:, c], "right") for c, b in enumerate(bounds)], axis=1)
    away = []
    for i, hits in true_neighbours(index, q, own, k):
        if hits:
            there = np.array([h["keys"] for h in hits], np.int64)
            away.append(np.min([np.abs(np.searchsorted(b, there[:, c], "right") - here[i, c]) for c, b in enumerate(bounds)], axis=0))
    away = np.sort(np.concatenate(away)) if away else np.zeros(1, np.int64)
    return int(away[min(len(away) - 1, int(np.ceil(target * len(away))) - 1)])


def nearest(vectors: DataFrame, is_query, k: int = 20, n_curves: int = 8, target: float = 0.96, calibration: int = 200, block_rows: int = 32_768, block_queries: int = 16_384) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each row for which ``is_query`` holds, but for itself."""
    rows, d, longest = usable(vectors)
    queries = rows.where(is_query)
    empty = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not d or queries.isEmpty():
        return empty
    curves = Curves(d, longest, n_curves)
    index = placed(classes(rows, k), curves)
    n = index.count()
    blocks = int(min(max(n // 2048, 32), 4096))
    bounds = splitters(index, n, blocks)
    reach = needed_reach(index, queries, curves, bounds, k, target, calibration)
    used = range(n_curves if reach < blocks - 1 else 1)  # a window over all of an ordering needs no other

    def looked_at(keys: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Row and cell (ordering and block) of each block that a key's window covers."""
        rows_, cells = [], []
        for c in used:
            block = np.searchsorted(bounds[c], keys[:, c], "right")[:, None] + np.arange(-width, width + 1)
            inside = (block >= 0) & (block < blocks)
            rows_.append(np.nonzero(inside)[0])
            cells.append(block[inside] + c * blocks)
        return np.concatenate(rows_), np.concatenate(cells)

    def counts(df: DataFrame, query: bool) -> np.ndarray:
        def run(batches):
            total = np.zeros(n_curves * blocks, np.int64)
            for b in batches:
                if b.num_rows:
                    keys = curves.keys(matrix(b.column("v")), b.column("vec_id").to_numpy(), True) if query else matrix(b.column("keys"), np.int64)
                    total += np.bincount(looked_at(keys, reach if query else 0)[1], minlength=len(total))
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["cell", "n"])

        out = np.zeros(n_curves * blocks, np.int64)
        read = df.select("vec_id", "v") if query else df.select("keys")
        for r in read.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
            out[r["cell"]] = r["n"]
        return out

    row_parts = np.maximum(1, -(-counts(index, False) // block_rows))
    query_parts = np.maximum(1, -(-counts(queries, True) // block_queries))

    def spread(where: np.ndarray, cells: np.ndarray, own: np.ndarray, mine: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, ...]:
        """Each (row, cell) goes to its own part by a hash, and there to every part of the other side."""
        part = (mix(own[where].astype(np.uint64)) % mine[cells].astype(np.uint64)).astype(np.int64)
        times = others[cells]
        other = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        return np.repeat(where, times), np.repeat(cells, times), np.repeat(part, times), other

    def deal_rows(batches):
        for b in batches:
            if b.num_rows:
                own = b.column("first").to_numpy()
                where, cells, part, other = spread(*looked_at(matrix(b.column("keys"), np.int64), 0), own, row_parts, query_parts)
                take = pa.array(where)
                yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(part), pa.array(other), pa.nulls(len(where), pa.int64()), b.column("ids").take(take), b.column("v").take(take)], DEALT_NAMES)

    def deal_queries(batches):
        for b in batches:
            if b.num_rows:
                own = b.column("vec_id").to_numpy()
                where, cells, part, other = spread(*looked_at(curves.keys(matrix(b.column("v")), own, True), reach), own, query_parts, row_parts)
                take = pa.array(where)
                yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(other), pa.array(part), pa.array(own).take(take), pa.nulls(len(where), pa.list_(pa.int64())), b.column("v").take(take)], DEALT_NAMES)

    def match(table: pa.Table) -> pa.Table:
        asks = table.column("query_id").is_valid()
        q, x = table.filter(asks).combine_chunks(), table.filter(pc.invert(asks)).combine_chunks()
        own = q.column("query_id").to_numpy()
        if not len(q) or not len(x):
            return pa.table({"query_id": pa.array([], pa.int64()), "hits": pa.array([], pa.list_(pa.struct([("s", pa.float64()), ("vec_id", pa.int64())])))})
        first, ids = _lists(x.column("ids"))
        row, score, vec, _ = best_of(matrix(q.column("v")), own, matrix(x.column("v")), first, ids, k)
        return pa.table({"query_id": pa.array(own), "hits": _packed(row, score, vec, len(own))})

    dealt = index.select("first", "ids", "v", "keys").mapInArrow(deal_rows, DEALT).unionByName(queries.mapInArrow(deal_queries, DEALT))
    hits = dealt.groupBy("cell", "row_part", "query_part").applyInArrow(match, f"query_id long, hits {HITS}")
    best = merged(hits, k, "query_id", copies=len(used)).select("query_id", F.posexplode("hits"))
    return best.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("col.vec_id").alias("vec_id"), (F.lit(0.0) - F.col("col.s")).alias("score"))


DEALT = "cell long, row_part long, query_part long, query_id long, ids array<long>, v array<double>"
DEALT_NAMES = ["cell", "row_part", "query_part", "query_id", "ids", "v"]


def op11_curve_neighbours(spark, sf_dir):
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
