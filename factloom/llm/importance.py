"""Quality classifier by importance resampling: the ratio of two hashed n-gram models, sampled by Gumbel top-k.

Words, word pairs and strings of three bytes of whole texts are hashed into ``buckets`` each. The raw model counts all
documents; the target model counts documents labelled good and is shrunk towards the raw one, so that a bucket that the
target has hardly seen says nothing. A document's log importance weight is the sum of the log ratios of all its n-grams,
the log ratio of what the two models say of the whole text.

That sum grows with the text, so that drawing by it would be choosing by length. Sampling goes by the score: of each kind the
mean log ratio times half * tanh(n / half), n being how many n-grams there are; it is the same rule at every length, near the
sum for short texts and near ``half`` times the mean for long ones. A document's key is its score plus a Gumbel draw that depends on (seed, doc_id) alone; the k rows
with the largest keys are the sample, which is drawing k without replacement in proportion to exp(score).

k is the number of documents whose score reaches a threshold, chosen on labelled documents that neither model's target
side has seen. The k-th largest key is found exactly by counting keys by their leading bits, 16 at a time, so that no task
and not the driver ever holds the keys.

The target model and the threshold use at most ``max_labelled`` labelled documents (those with the smallest hash of
doc_id), a documented bound, so their list may be shipped to the tasks; raw counts, scores and the sample cover all
documents and whole texts.

Defined cases: a null or empty text has no n-grams, score 0 and competes like any other; without labels of both kinds all
documents are kept; null labels are ignored; a document labelled more than once counts with its worst label; a null doc_id
draws as one identifier; rows with equal keys at the k-th place all stay; an empty table gives an empty result; columns
besides doc_id and text are carried along, but for ones named like the added columns.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.common import PRIME, SPACE, byte_grams, mix, named, packed, packed_others, run_hashes, runs, settle, slices, small_batches, unpacked

ADDED = ["log_weight", "score", "key", "kept"]
BYTES = 3
KINDS = 3


def ngram_buckets(column: pa.Array, buckets: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Bucket and row of each word, of each pair of neighbouring words, and of each string of ``BYTES`` bytes of a text; each
    of the three kinds has ``buckets`` of its own, one after the other."""
    data, offs = packed(column)
    s, e, row = runs(~SPACE[data], offs)
    h = run_hashes(data, s, e)
    same = row[1:] == row[:-1]
    pairs = mix(h[:-1] * PRIME + h[1:])[same]
    own = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    grams = byte_grams(data, BYTES) if len(data) >= BYTES else np.zeros(0, np.uint64)
    inside = own[: len(grams)] == own[len(own) - len(grams) :]
    found = (h, row), (pairs, row[:-1][same]), (grams[inside], own[: len(grams)][inside])
    return [((x % np.uint64(buckets)).astype(np.int64) + k * buckets, r) for k, (x, r) in enumerate(found)]


def count_models(docs: DataFrame, target: np.ndarray, buckets: int) -> DataFrame:
    """bucket, raw and target counts; ``target``: sorted ids of the documents of the target model."""
    schema = pa.schema([("bucket", pa.int64()), ("raw", pa.int64()), ("target", pa.int64())])

    def each(batches):
        raw, own = np.zeros(KINDS * buckets, np.int64), np.zeros(KINDS * buckets, np.int64)
        for batch in batches:
            for part in slices(batch, "text", 1 << 18):
                b, row = (np.concatenate(x) for x in zip(*ngram_buckets(part.column("text"), buckets), strict=True))
                raw += np.bincount(b, minlength=KINDS * buckets)
                chosen = np.isin(part.column("doc_id").fill_null(-1).to_numpy(zero_copy_only=False), target) & ~np.asarray(part.column("doc_id").is_null())
                if chosen.any():
                    own += np.bincount(b[chosen[row]], minlength=KINDS * buckets)
        full = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(raw[full]), pa.array(own[full])], schema=schema)

    counted = docs.select("doc_id", "text").mapInArrow(each, "bucket long, raw long, target long")
    return counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratios(counts, buckets: int, prior: float) -> np.ndarray:
    """log p_target / p_raw of each bucket; the target's model has ``prior`` pseudo-counts a bucket, dealt as the raw one's."""
    raw, own = np.zeros(KINDS * buckets), np.zeros(KINDS * buckets)
    for r in counts:
        raw[r["bucket"]], own[r["bucket"]] = r["raw"], r["target"]
    raw, own = raw.reshape(KINDS, buckets) + 1, own.reshape(KINDS, buckets)
    p = raw / raw.sum(axis=1, keepdims=True)
    q = (own + prior * buckets * p) / (own.sum(axis=1, keepdims=True) + prior * buckets)
    return np.log(q / p).ravel()


def weigh(docs: DataFrame, ratios: np.ndarray, half: float, columns: list[str]) -> DataFrame:
    """The columns of ``docs`` with log_weight and score."""
    kept = [f for f in docs.schema.fields if f.name in columns]
    docs = docs.select(*[named(f.name) for f in docs.schema.fields if f.name in columns or f.name == "text"])
    buckets = len(ratios) // KINDS

    def each(batches):
        for batch in batches:
            for part in slices(batch, "text", 1 << 18):
                weight, score = np.zeros(part.num_rows), np.zeros(part.num_rows)
                for b, row in ngram_buckets(part.column("text"), buckets):
                    n = np.bincount(row, minlength=part.num_rows)
                    total = np.bincount(row, ratios[b], minlength=part.num_rows)
                    weight += total
                    score += total / np.maximum(n, 1) * half * np.tanh(n / half)
                yield pa.RecordBatch.from_arrays([*[part.column(f.name) for f in kept], pa.array(weight), pa.array(score)], [*[f.name for f in kept], "log_weight", "score"])

    return docs.mapInArrow(each, T.StructType([*kept, T.StructField("log_weight", T.DoubleType()), T.StructField("score", T.DoubleType())]))


def threshold(scored: list[tuple[float, int]], good_is_worth: float) -> float:
    """Where the labelled (score, 1 good or -1 bad) part best, a good document lost counting as much as ``good_is_worth`` bad ones
    kept (as shares of the good and of the bad); in the middle of the gap that is found."""
    good = np.sort([w for w, y in scored if y > 0])
    bad = np.sort([w for w, y in scored if y < 0])
    if not len(good) or not len(bad):
        return -np.inf
    at = np.r_[-np.inf, np.unique(np.r_[good, bad])]
    cost = good_is_worth * np.searchsorted(good, at) / len(good) + 1 - np.searchsorted(bad, at) / len(bad)
    best = int(np.argmin(cost))
    return float((at[best] + at[best - 1]) / 2) if best > 1 else float(at[best])


def gumbel(seed: int) -> Column:
    """A standard Gumbel draw of (seed, doc_id)."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(u))


def _ordered_bits(key: np.ndarray) -> np.ndarray:
    """Unsigned integers in the order of the doubles."""
    x = np.ascontiguousarray(key, np.float64).view(np.uint64)
    return np.where(x >> np.uint64(63) == 1, ~x, x | np.uint64(1 << 63))


def kth_largest(keys: DataFrame, k: int) -> float:
    """The k-th largest of the doubles ``key``, exactly: four counts by 16 bits; at most 65,536 counts reach the driver each time."""

    def counter(prefix: int, level: int):
        def each(batches):
            total = np.zeros(1 << 16, np.int64)
            for batch in batches:
                x = _ordered_bits(batch.column("key").to_numpy())
                if level:
                    x = x[x >> np.uint64(64 - 16 * level) == np.uint64(prefix)]
                total += np.bincount(((x >> np.uint64(48 - 16 * level)) & np.uint64(0xFFFF)).astype(np.int64), minlength=1 << 16)
            full = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(total[full])], ["digit", "n"])

        return each

    prefix = 0
    for level in range(4):
        counted = keys.select("key").mapInArrow(counter(prefix, level), "digit long, n long").groupBy("digit").agg(F.sum("n").alias("n")).collect()
        for digit, n in sorted(((r["digit"], r["n"]) for r in counted), reverse=True):
            if k <= n:
                prefix = prefix << 16 | digit
                break
            k -= n
    x = prefix & ~(1 << 63) if prefix >> 63 else ~prefix & 0xFFFFFFFFFFFFFFFF
    return float(np.array([x], np.uint64).view(np.float64)[0])


def resample(docs: DataFrame, labels: DataFrame, buckets: int = 1 << 16, prior: float = 5.0, half: float = 32.0, good_is_worth: float = 60.0, max_labelled: int = 20_000, seed: int = 11, columns: list[str] | None = None) -> DataFrame:
    """``columns`` of ``docs`` (all by default) with log_weight, score, key and kept (whether the row is among the k of the sample).

    Scored rows are written once, so that texts are read twice in all: for the counts and for the scores. ``good_is_worth``: a
    filter that loses one good document in a hundred is as bad as one that keeps 60 of a hundred bad ones.
    """
    docs = small_batches(docs)
    columns = [c for c in (docs.columns if columns is None else columns) if c not in ADDED]
    good = F.when((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), 1).when(F.col("quality") == 0, -1)
    chosen = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min(good).alias("y")).where("y is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled).collect()
    ids = np.array([r["doc_id"] for r in chosen], np.int64)
    y = np.array([r["y"] for r in chosen], np.int8)
    held = mix(ids.astype(np.uint64) + np.uint64(seed)) % np.uint64(4) == 0  # a quarter is for the threshold
    ratios = log_ratios(count_models(docs, np.sort(ids[(y > 0) & ~held]), buckets).collect(), buckets, prior)

    weighed = weigh(docs.withColumn("doc_id", F.col("doc_id").cast("long")), ratios, half, columns)
    keys = settle(weighed.withColumn("key", F.col("score") + gumbel(seed)))
    spark = docs.sparkSession
    held_out = spark.createDataFrame([(int(i), int(v)) for i, v in zip(ids[held | (y < 0)], y[held | (y < 0)], strict=True)], "doc_id long, y int")
    scored = keys.join(F.broadcast(held_out), "doc_id").groupBy("doc_id").agg(F.min("score").alias("w"), F.min("y").alias("y")).collect()
    least = threshold([(r["w"], r["y"]) for r in scored], good_is_worth)
    n, k = keys.agg(F.count(F.lit(1)), F.coalesce(F.sum((F.col("score") >= F.lit(least)).cast("long")), F.lit(0))).first()
    at = kth_largest(keys, k) if 0 < k < n else (-np.inf if k else np.inf)
    return keys.withColumn("kept", F.col("key") >= F.lit(float(at)))


def keep_sampled(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` in the sample, with all columns of ``docs``, whatever their names."""
    return unpacked(resample(packed_others(docs, "doc_id", "text"), labels, **how).where("kept"), docs.columns)


def op2_importance_resampling(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return resample(docs, labels, columns=["doc_id"]).select("doc_id", "log_weight", "score", "key", "kept")
