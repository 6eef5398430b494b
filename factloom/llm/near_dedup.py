"""MinHash near-dedup by an inverted join on signature coordinates.

Every distinct shingle set gets a signature of ``k`` MinHash coordinates. Sets are posted under each coordinate-value
pair; a first pass tells which pairs are shared at all and how often. A set with fewer than ``least`` shared pairs can't
match and is skipped; the others are posted again, under their rarest pairs only (the prefix filter), and collisions are
counted within the lists. Sets with at least ``least`` equal coordinates become candidates; all candidates are confirmed
on their full sets, of all texts, exactly. With k = 64 and least = 32, a pair of similarity 0.8 is missed with a
probability of about 1e-8.

Equal sets (copies) are one item from the start, so a group of copies is never expanded; of groups of near copies only
spanning forests of links are passed on.

Defined cases: a document without words has an empty set, is linked with nothing and is its own component; one with fewer
words than a shingle has its whole sequence as one shingle; of repeated identifiers each row gets the component of its
own text; a null identifier doesn't name a component (component_id is null where a component has no other) and is kept
only there; an empty table gives an empty result; columns besides doc_id and text are ignored.

Links between different sets are confirmed on the words themselves. Only that two sets are equal is told by a 64-bit hash of
them (of 10^9 different sets, two share one with a probability of 3%).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import near
from factloom.llm.common import LOWER, SPACE, binaries, cut, distinct_in_rows, exact_shingles, mix, packed, packed_others, run_hashes, runs, settle, shingle_hashes, slices, small_batches, unpacked

ADDED = ["n_shingles", "component_id", "kept"]


def word_shingles(column: pa.Array, size: int, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one text after the other, and where each text's begin."""
    data, offs = packed(column)
    data = LOWER[data] if lower else data
    s, e, row = runs(~SPACE[data], offs)
    n = len(offs) - 1
    h, rows = distinct_in_rows(*shingle_hashes(run_hashes(data, s, e), row, size, n))
    return h, np.searchsorted(rows, np.arange(n + 1))


def set_ids(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set (none empty): of the sum and of the xor of its elements' hashes, and its size."""
    if len(starts) < 2:
        return np.zeros(0, np.int64)
    m = mix(h + np.uint64(1))
    total, crossed = np.add.reduceat(m, starts[:-1]), np.bitwise_xor.reduceat(mix(m), starts[:-1])
    return mix(total ^ mix(crossed + np.diff(starts).astype(np.uint64))).view(np.int64)


def with_digest(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text and a hash of both, which tells rows of one identifier apart; and further columns."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.col("doc_id").cast("long"), "text").alias("digest"), *more)


def describe(docs: DataFrame, size: int, k: int) -> DataFrame:
    """doc_id, digest, n_shingles, id (of the set; null if empty) and sig."""
    schema = pa.schema([("doc_id", pa.int64()), ("digest", pa.int64()), ("n_shingles", pa.int64()), ("id", pa.int64()), ("sig", pa.binary())])

    def each(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                h, starts = word_shingles(part.column("text"), size)
                n = np.diff(starts)
                full = np.flatnonzero(n)
                own = np.r_[starts[full], len(h)]
                ids = np.zeros(len(n), np.int64)
                ids[full] = set_ids(h, own)
                sig = near.signatures(h, own, k)
                bounds = np.r_[0, np.cumsum(np.where(n > 0, k, 0))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("digest"), pa.array(n), pa.array(ids, mask=n == 0), binaries(sig.ravel(), bounds)], schema=schema)

    return with_digest(docs).mapInArrow(each, "doc_id long, digest long, n_shingles long, id long, sig binary")


def near_rows(docs: DataFrame, size: int = 5, num: int = 4, den: int = 5, k: int = 64, least: int = 32, item_rows: int = 8192, list_rows: int = 1024, cluster_rows: int = 512) -> DataFrame:
    """doc_id, digest (see ``with_digest``), n_shingles, component_id, kept, for each row of ``docs``."""
    form = near.coordinates(k, least, near.coordinate_tokens)
    rows = settle(describe(small_batches(docs), size, k))
    items = settle(rows.where("id is not null").dropDuplicates(["id"]).select("id", "sig"))
    parts = max(8, -(-items.count() // item_rows))
    items = items.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(parts)))
    shared = near.shared_tokens(items, form, parts)
    lists = near.post(items, shared, form, near.prefix_of(least), parts, list_rows)
    clusters = near.candidates(lists, form, list_rows)

    # one row's text for each candidate set
    chosen = rows.where("id is not null").groupBy("id").agg(F.min("doc_id").alias("_doc"), F.min_by("digest", F.struct(F.col("doc_id").isNull(), "doc_id", "digest")).alias("_digest")).join(clusters.select("id"), "id")
    texts = with_digest(docs)
    texts = texts.join(chosen, (texts["digest"] == chosen["_digest"]) & texts["doc_id"].eqNullSafe(chosen["_doc"])).select("id", "text")
    texts = settle(texts.dropDuplicates(["id"]))
    found = near.components(near.verify(texts, "text", clusters, lambda column: exact_shingles(column, size), num, den, cluster_rows))

    grouped = rows.drop("sig").join(found, "id", "left").withColumn("_group", F.coalesce("component", "id"))
    # cut, so that the join below reads two exchanges and Spark can split a large group
    least_doc = cut(grouped.where("_group is not null").groupBy("_group").agg(F.min("doc_id").alias("_least")))
    out = grouped.join(least_doc, "_group", "left")
    component = F.when(F.col("_group").isNull(), F.col("doc_id")).otherwise(F.col("_least"))
    return out.select("doc_id", "digest", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def near_groups(docs: DataFrame, **how) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, for each row of ``docs``: similarity num / den or more links."""
    return near_rows(docs, **how).drop("digest")


def near_dedup(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with one document of each component left; the columns of ``docs`` stay as they are, whatever their names.

    Rows that share identifier and text are told apart by nothing else, so they go or stay together.
    """
    kept = near_rows(docs, **how).where("kept").select(F.col("doc_id").alias("_doc"), F.col("digest").alias("_digest")).distinct()
    rows = packed_others(docs, "doc_id", "text")
    key = F.xxhash64(F.col("doc_id").cast("long"), "text")
    return unpacked(rows.join(kept, (key == kept["_digest"]) & rows["doc_id"].eqNullSafe(kept["_doc"]), "left_semi"), docs.columns)


def op6_minhash_near_dedup(spark, sf_dir):
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), size=2)


OP6_SQL = r"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from documents),
s as (
  select doc_id, case when len(w) = 0 then [] when len(w) = 1 then [w[1]]
    else list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) end as s
  from w),
f as (select doc_id, len(s) as n, unnest(s) as x from s),
p as (
  select a.doc_id as a, b.doc_id as b from f a join f b on a.x = b.x and a.doc_id <> b.doc_id
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r as (select a, b from p union select r.a, p.b from r join p on r.b = p.a)
select s.doc_id, len(s.s)::bigint as n_shingles, least(s.doc_id, coalesce(min(r.b), s.doc_id)) as component_id,
  least(s.doc_id, coalesce(min(r.b), s.doc_id)) = s.doc_id as kept
from s left join r on r.a = s.doc_id group by s.doc_id, s.s
"""
