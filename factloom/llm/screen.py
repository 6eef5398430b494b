"""Which fingerprints of a text occur more than once anywhere: the step before all work on substrings and passages.

Texts are dealt into blocks of about ``block_bytes`` by a hash of the identifier. A block posts each of its distinct
64-bit fingerprints once, as 32 bits below a bucket and with a count up to 255; a bucket adds the counts up and tells each
block which of its fingerprints occur twice or more. Cutting a fingerprint short can only let too much through, and all
that follows compares in full. A fingerprint that a third of all texts have is one entry for each block.

``met`` brings what is known to the text again: the text's exchange stands in the plan more than once and Spark runs it
once (ReusedExchange), so a text is shuffled once however often it is read.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.near import _dealt, groups_of

#: The place of a null identifier in the order: behind all others.
NO_ID = (1 << 63) - 1

SIDE = "block long, kind int, bucket long, a binary, b binary"
SIDE_SCHEMA = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int64()), ("a", pa.binary()), ("b", pa.binary())])
SHARED, OTHER, RESULT = 0, 1, 2
#: A fingerprint with more occurrences (at most 255 of a block count) is marked as frequent; see suffix_dedup.
FREQUENT = 2000


def blocks_of(docs: DataFrame, block_bytes: int) -> tuple[DataFrame, int]:
    """doc_id, digest (of doc_id and text), doc (the identifier's place in the order), text (null: empty) and block, of all
    rows; and how many blocks. Blocks go by the digest, so that rows without an identifier, or of one, are in many."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    n = max(8, -(-total // block_bytes))
    rows = rows.withColumn("digest", F.xxhash64("doc_id", "text"))
    return rows.select("doc_id", "digest", F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), "text", F.pmod("digest", F.lit(n)).alias("block")), n


def in_order(table: pa.Table) -> pa.Table:
    """The block's rows in an order that does not depend on how they arrived."""
    return table.sort_by([("doc", "ascending"), ("text", "ascending")]).combine_chunks()


def _keys(tokens: np.ndarray, buckets: int) -> np.ndarray:
    return ((tokens % np.uint64(buckets)) << np.uint64(32)) | (tokens >> np.uint64(32))


class Known:
    """Of a side table (see SIDE): the fingerprints that are shared, and the rest by kind."""

    def __init__(self, table: pa.Table, buckets: int):
        kind = table.column("kind").to_numpy() if table.num_rows else np.zeros(0)
        own = table.filter(pa.array(kind == SHARED))
        parts = [(np.uint64(b) << np.uint64(32)) | np.frombuffer(a.as_py(), np.uint32).astype(np.uint64) for b, a in zip(own.column("bucket").to_pylist(), own.column("a"), strict=True)]
        keys = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        often = np.concatenate([np.frombuffer(b.as_py(), np.uint8) for b in own.column("b")]) if parts else np.zeros(0, np.uint8)
        order = np.argsort(keys)
        self.keys, self.often = keys[order], often[order] > 0
        self.rest = {k: table.filter(pa.array(kind == k)) for k in (OTHER, RESULT)}
        self.buckets = buckets

    def __call__(self, tokens: np.ndarray) -> np.ndarray:
        """Which of the fingerprints are shared."""
        if not len(self.keys):
            return np.zeros(len(tokens), bool)
        k = _keys(tokens, self.buckets)
        return self.keys[np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)] == k

    def frequent(self, tokens: np.ndarray) -> np.ndarray:
        """Which of the (shared) fingerprints occur more than FREQUENT times."""
        return self.often[np.searchsorted(self.keys, _keys(tokens, self.buckets))] if len(tokens) else np.zeros(0, bool)


def _posted(table: pa.Table, side: pa.Table, tokens_of: Callable, buckets: int) -> pa.Table:
    if not table.num_rows:
        return SIDE_SCHEMA.empty_table()
    block = table.column("block")[0].as_py()
    key, n = np.unique(_keys(tokens_of(in_order(table), Known(side, buckets)), buckets), return_counts=True)
    value, n = key.astype(np.uint32), np.minimum(n, 255).astype(np.uint8)
    _, parts = _dealt((key >> np.uint64(32)).astype(np.int64))
    return pa.table([[block] * len(parts), [SHARED] * len(parts), [b for b, _, _ in parts], [value[s:e].tobytes() for _, s, e in parts], [n[s:e].tobytes() for _, s, e in parts]], schema=SIDE_SCHEMA)


def _added_up(table: pa.Table) -> pa.Table:
    values = np.frombuffer(b"".join(x.as_py() for x in table.column("a")), np.uint32)
    counts = np.frombuffer(b"".join(x.as_py() for x in table.column("b")), np.uint8)
    size = np.array([len(x.as_py()) // 4 for x in table.column("a")], np.int64)
    order, start, end = groups_of(values)
    total = np.zeros(len(values), np.int64)
    if len(values):
        total[order] = np.repeat(np.add.reduceat(counts[order].astype(np.int64), start), end - start)
    many, often = total > 1, (total > FREQUENT).astype(np.uint8)
    out, at = [], 0
    for block, bucket, n in zip(table.column("block").to_pylist(), table.column("bucket").to_pylist(), size, strict=True):
        kept = many[at : at + n]
        if kept.any():
            out.append((block, SHARED, bucket, values[at : at + n][kept].tobytes(), often[at : at + n][kept].tobytes()))
        at += n
    return pa.table([list(x) for x in zip(*out, strict=True)] if out else [[]] * 5, schema=SIDE_SCHEMA)


def met(blocks: DataFrame, side: DataFrame, use: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``use(the block's texts in order, what is known of the block)`` for each block."""

    def each(texts: pa.Table, known: pa.Table) -> pa.Table:
        return use(texts, known)

    return blocks.groupBy("block").cogroup(side.groupBy("block")).applyInArrow(each, schema)


def shared_fingerprints(blocks: DataFrame, side: DataFrame, tokens_of: Callable, buckets: int) -> DataFrame:
    """The side table of shared fingerprints; ``tokens_of(texts, known)`` gives a block's, as often as each counts."""
    posted = met(blocks, side, lambda texts, known: _posted(texts, known, tokens_of, buckets), SIDE)
    return posted.groupBy("bucket").applyInArrow(_added_up, SIDE)
